"""Repeated lines in the pipeline's quality stage."""

import corpus_pipeline


def test_one_short_line_twice_is_kept_and_mostly_repeated_lines_go(spark):
    prose = " ".join(f"word{i}" for i in range(70))
    short = "all rights are reserved here"
    unique = lambda k: " ".join(f"other{k}x{i}" for i in range(6))
    repeated = "\n".join(f"buy this now or tomorrow morning please\n{unique(k)}" for k in range(12))
    rows = [(1, f"{short}\n{prose}\n{short}"), (2, repeated), (3, prose), (4, f"{short}\n \n{short}")]
    kept = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in kept} == {1, 3}
