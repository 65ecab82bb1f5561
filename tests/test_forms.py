"""Code tokens, reports, layout, labels and checks on small cases with nulls, ties and empty tables."""

from pyspark.sql import functions as F

from tessellum.functions import codes, labels
from tessellum.operators import checks, forms, layout


def test_code_tokens(spark):
    texts = ["§1245 property", "Section 168(e)(3)(B) applies", "Class 00.11 office furniture", "in 5 years", "", None, "57.0 and 57.0", "a12b 123 é x9"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in rows.orderBy("i").select(codes.code_tokens(F.col("text"))).collect()]
    assert got[0] == ["§1245", "1245", "property"]
    assert got[1] == ["168(e)(3)(b)", "168", "section", "applies"]
    assert got[2] == ["00.11", "class", "office", "furniture"]
    assert got[3] == ["in", "years"] and got[4] == [] and got[5] == []
    assert got[6] == ["57.0", "57.0", "and"] and got[7] == ["123", "a12b", "x9"]
    plain = rows.where("i = 0").select(codes.tokens_for(F.lit(None).cast("string"), F.col("text")), codes.tokens_for(F.lit("irs"), F.col("text"))).first()
    assert plain[0] == ["property"] and plain[1][0] == "§1245"


def test_reports(spark):
    rows = [(1, "Year built: 1700, built in 1999. Market value: $1,200.50\nTotal value: ,"), (2, None), (3, "")]
    got = {r.id: r for r in forms.report_fields(spark.createDataFrame(rows, "d int, t string"), "d", "t").collect()}
    assert got[1].year_built == 1999 and got[1].total_value == 1200.5 and abs(got[1].coverage - 2 / 25) < 1e-9
    assert all(v is None for k, v in got[2].asDict().items() if k not in ("id", "coverage")) and got[3].coverage == 0
    found = forms.field_rows(forms.report_fields(spark.createDataFrame(rows, "d int, t string"), "d", "t"), ["year_built"])
    assert {(r.field, r.confidence) for r in found.collect()} == {("year_built", 0.7), ("total_value", 0.8)}
    assert forms.report_fields(spark.createDataFrame([], "d int, t string"), "d", "t").count() == 0


def test_a_paragraph_keeps_its_first_indent(spark):
    # each line is within 50 of the one before it, but the third is not within 50 of the first
    lines = [(1, i, f"l{i}", 40.0 * i, 20.0 * i, 300.0, 20.0 * i + 12, 10.0) for i in range(3)]
    df = spark.createDataFrame(lines, "page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font double")
    assert [r.text for r in layout.paragraphs(df, ["page"]).orderBy("place").collect()] == ["l0 l1", "l2"]
    assert layout.paragraphs(df.limit(0), ["page"]).count() == 0


def test_section_paths(spark):
    kinds = ["paragraph", "heading", "heading", "heading", "heading", "title", "paragraph", "heading"]
    df = spark.createDataFrame([(1, i, k, f"t{i}") for i, k in enumerate(kinds)], "doc_id int, seq int, element_type string, text string")
    got = [r.path for r in layout.section_paths(df, "doc_id").orderBy("seq").collect()]
    assert got == [[], ["t1"], ["t1", "t2"], ["t1", "t2", "t3"], ["t2", "t3", "t4"], ["t5"], ["t5"], ["t5", "t7"]]
    assert layout.section_paths(df, "doc_id").columns == [*df.columns, "path"]


def test_interleaved(spark):
    chunk = lambda rows: spark.createDataFrame(rows, "doc_id int, chunk_id string, start int")
    got = layout.interleaved(chunk([(1, "c10", 1), (1, "c2", 1), (1, "c3", 2)]), chunk([(1, "a", 1)])).orderBy("place").collect()
    assert [r.chunk_id for r in got] == ["c10", "c2", "a", "c3"]


def test_labels(spark):
    pairs = [("wood cabinet", "cabinet"), ("refrigerator", "appliance"), ("hardwood", "flooring"), ("cabinet", "toilet"), (None, "sink")]
    got = spark.createDataFrame(pairs, "a string, b string").select(labels.same_thing(F.col("a"), F.col("b")), labels.related(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False] == [r[1] for r in got]


def test_answers(spark):
    answers = [(1, '{"a": {"value": 5, "confidence": 2}, "b": {"value": ""}}'), (2, "```json\n{\"a\": {\"value\": \"x\"}}\n```"), (3, "no"), (4, None)]
    got = checks.answered_fields(spark.createDataFrame(answers, "i int, t string"), "i", "t").collect()
    assert sorted(map(tuple, got)) == [(1, "a", "5", 1.0), (2, "a", "x", 0.7)]
    found = checks.detections(spark.createDataFrame([(1, '[{"label": "Cabinet", "box": [64, 48, 320, 240]}, {"box": [1]}]'), (2, "["), (3, None)], "i int, t string"), "i", "t", []).collect()
    assert len(found) == 1 and found[0].box.x_min == 0.1 and found[0].prompt is None and found[0].confidence == 0


def test_checks(spark):
    df = spark.range(1).select(
        checks.area_warnings(F.lit(90.0), F.lit(200.0)).alias("small"), checks.area_warnings(F.lit(None).cast("double"), F.lit(1.0)).alias("none"),
        checks.class_years(F.lit("27.5-YEAR")).alias("years"), checks.class_years(F.lit(None).cast("string")).alias("other"),
        checks.checklist(F.create_map(F.lit("site"), F.lit(True))).alias("list"), labels.valid_date(F.lit("1/5/2024")).alias("date"), labels.valid_date(F.lit(None).cast("string")).alias("no_date"),
    )
    r = df.first()
    assert r.small == ["small", "basement"] and r.none == [] and (r.years, r.other) == (27, 39)
    assert (r["list"].verified, r["list"].percent, r["list"].overall) == (1, 13.0, False) and r.date and not r.no_date
    assets = spark.createDataFrame([(1, 1, 1, None), (1, 2, 2, True), (1, 3, 3, False)], "study_id int, id int, seq int, verified boolean")
    assert {(x.id, x.next_id) for x in checks.next_unverified(assets).collect()} == {(1, 3), (3, 1)}
    assert checks.progress(assets).first().percent == 33.0
