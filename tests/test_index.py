"""The stored index answers as the texts do, reads only what it is asked for, and is none when it is cut short. Exports with varying keys."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellum.operators import search
from tessellum.plans.search import _BM25
from tessellum.sources import files, index

DOCS = [(1, "red fox runs"), (2, "red red dog"), (3, ""), (4, None), (5, "blue cat and a red hat"), (6, "green dog"), (7, "gray owl"), (8, "owl of gray stone")]


def held(df):
    return sorted((r.query_id, r.id, round(r.score, 9)) for r in df.collect())


def test_the_same_scores_as_over_the_texts_and_only_their_buckets(spark, tmp_path):
    tokens = search.tokenized(spark.createDataFrame(DOCS, "id long, t string"), "id", "t")
    asked = spark.createDataFrame([(1, "red dog dog"), (2, "unknown"), (3, "gray"), (4, None)], "query_id long, text string")
    assert index.load(spark, str(tmp_path)) is None
    index.build(tokens, str(tmp_path), buckets=8)
    found = index.load(spark, str(tmp_path)).bm25(asked)
    assert held(found) == held(search.bm25(tokens, asked)) and len(held(found)) == 6
    plan = found._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [bucket") >= 2 and "ReadSchema: struct<term:string,df:bigint>" in plan


def test_no_index_of_nothing_or_of_half(spark, tmp_path):
    tokens = search.tokenized(spark.createDataFrame(DOCS[2:4], "id long, t string"), "id", "t")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(index.F, "avg", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.build(search.tokenized(spark.createDataFrame(DOCS, "id long, t string"), "id", "t"), str(tmp_path / "half"))
    assert index.load(spark, str(tmp_path / "half")) is None
    index.build(tokens, str(tmp_path / "none"))
    assert index.load(spark, str(tmp_path / "none")) is None


def test_keys_that_first_appear_in_the_last_partition(spark, tmp_path):
    rows = [(k, {"b": str(k), "a": None if k % 2 else "x,\"y\""}) for k in range(50)] + [(50, {"z": "late", "b": "50"}), (51, None), (52, {})]
    lists = [(n, None if m is None else list(m), None if m is None else list(m.values())) for n, m in rows]
    table = spark.createDataFrame(lists, "n long, k array<string>, v array<string>").select("n", F.map_from_arrays("k", "v").alias("record")).repartition(7, "n")
    assert files.header(table, "record", "n") == ["b", "a", "z"]
    files.export_csv(files.flattened(table, "record", "n"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["b", "a", "z"] and back.count() == 53 and back.where("b = '48'").first().a == 'x,"y"' and back.where("z = 'late'").first().b == "50"
    files.export_json(table, str(tmp_path / "json"), "record")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "json")).where(F.col("value").contains("late")).collect()) == ['{"z":"late","b":"50"}']
    assert spark.read.text(str(tmp_path / "json")).where("value = '{\"b\":\"1\"}'").count() == 1


def test_texts_are_read_once_and_postings_moved_once(spark, tmp_path):
    rows = [(k, " ".join(f"w{(k * j) % 97}x" for j in range(k % 40 + 1))) for k in range(300)]
    asked = spark.createDataFrame([(q, " ".join(f"w{(q + j) % 97}x" for j in range(30))) for q in range(60)], "query_id long, text string")
    # two rows of id 7 and of a null id, of one length and of two
    for more in ([], [(7, rows[7][1]), (None, "w1x w2x"), (None, "w1x"), (None, "w1x w3x"), (9, "w5x"), (9, "w5x"), (400, "")]):
        tokens = search.tokenized(spark.createDataFrame(rows + more, "id long, t string"), "id", "t")
        counted = index._counted(tokens)
        if not more:
            assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        index.build(tokens, str(tmp_path / str(len(more))), buckets=8)
        found = index.load(spark, str(tmp_path / str(len(more))))
        scores = found.bm25(asked)
        documents, benchmark = (pa.table({k: [r[i] for r in x] for i, k in enumerate(names)}) for x, names in ((rows + more, ("doc_id", "text")), ([tuple(r) for r in asked.collect()], ("item_id", "text"))))
        with duckdb.connect() as db:
            db.register("documents", documents), db.register("benchmark", benchmark)
            told = db.sql(f"WITH {_BM25} SELECT query_id, id, score FROM s").fetchall()
        scored = {(r.query_id, r.id): r.score for r in scores.collect()}
        assert scored == pytest.approx({(q, k): score for q, k, score in told}, abs=1e-7) and len(told) > 5000
        assert found.postings.where("term = ''").count() == 0 and found.n == tokens.where(F.size("tokens") > 0).count()
        # queries meet postings after the exchange by id
        plan = scores._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [id" in plan
