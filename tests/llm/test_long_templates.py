"""Templates longer than a block's usual step."""

from tessellum.llm import licenses


def test_templates_of_any_length_are_found_wherever_they_stand(spark):
    texts = {f"long{n}.full": " ".join(f"term{n}x{i}" for i in range(n)) for n in (90, 170)}
    rows = [(f"{k} {at}", " ".join(f"pad{i}" for i in range(at)) + " " + v + " tail" * 90) for k, v in texts.items() for at in (0, 1, 37, 63, 100)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"), templates=texts).collect()
    assert {r.doc_id: (r.labels, r.score) for r in found} == {k: (k.split(".")[0], 1.0) for k, _ in rows}


def test_words_of_a_short_notice_spread_over_a_sentence_are_no_license(spark):
    spread = "released the board voted under new rules while the court in mit quarter issued its license"
    rows = [(1, spread), (2, "all of it is Released under the MIT License today"), (3, "pad " * 300 + licenses.TEMPLATES["isc.full"].replace("WARRANTIES", "GUARANTEES") + " tail" * 50)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "" and found[2].labels == "mit" and found[3].labels == "isc" and 0.85 <= found[3].score < 1
