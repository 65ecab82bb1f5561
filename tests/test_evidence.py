from tessellum.operators import evidence


def test_merge_fields_folds_all_tiers_of_a_field(spark):
    rows = [("d", "f", i, f"v{i}", i / 5000, "s") for i in range(3000)] + [("d", "g", 0, "only", 0.5, "s")]
    merged = evidence.merge_fields(spark.createDataFrame(rows, "doc_id string, field string, tier int, value string, confidence double, source string"))
    assert {r.field: r.value for r in merged.collect()} == {"f": "v2999", "g": "only"}
