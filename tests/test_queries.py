"""Each registered query against its SQL, and small cases with nulls, ties and empty tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellum.functions import geometry, text
from tessellum.operators import chunks, evidence, search, takeoffs
from tessellum.plans import catalogue
from tessellum.sources import files
from tessellum.streaming import changes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = duck.sql(catalogue.ORACLE_SQL[name])
    at = [sql.columns.index(c) for c in columns]
    assert sorted(sql.columns) == columns
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)


def test_text_functions(spark):
    rows = [("a1,234.5", "$1,234", "ab-cd_e"), (None, None, None), ("", "", "")]
    df = spark.createDataFrame(rows, "n string, money string, label string")
    got = df.select(text.number(F.lit("1,234.5")), text.currency(F.col("money")), text.slug(F.col("label")), text.snake(F.col("label")), text.simple_tokens(F.col("label"))).collect()
    assert tuple(got[0]) == (1234.5, 1234, "AB_CD_E", "ab_cd_e", ["ab"]) and tuple(got[1])[1:] == (0, "", "", [])
    assert spark.range(1).select(text.half_up(F.lit(-2.5)), text.half_up(F.lit(2.5))).first()[:] == (-2.0, 3.0)


def test_boxes(spark):
    b = lambda *x: geometry.box(*map(F.lit, x))
    one, two, apart = b(0.0, 0.0, 0.5, 0.5), b(0.25, 0.25, 0.75, 0.75), b(0.5, 0.5, 1.0, 1.0)
    row = spark.range(1).select(geometry.iou(one, two), geometry.iou(one, apart), geometry.iou(one, one), geometry.valid(one), geometry.valid(b(0.5, 0.5, 0.5, 0.6))).first()
    assert math.isclose(row[0], 0.0625 / 0.4375) and tuple(row)[1:] == (0.0, 1.0, True, False)


def test_windows_at_their_edges(spark):
    df = spark.createDataFrame([(n, " ".join(map(str, range(n)))) for n in (0, 1, 400, 401, 720, 721)], "id long, t string")
    got = {}
    for r in chunks.windows(df, "id", "t").collect():
        got.setdefault(r.id, []).append(r.n_tokens)
    assert {k: sorted(v, reverse=True) for k, v in got.items()} == {1: [1], 400: [400], 401: [400, 81], 720: [400, 400], 721: [400, 400, 81]}
    with pytest.raises(ValueError):
        chunks.windows(df, "id", "t", 10, 10)


def test_bm25_drops_after_the_cut_and_breaks_ties_by_id(spark):
    docs = spark.createDataFrame([(3, "red fox"), (1, "red fox"), (2, "blue cat"), (4, ""), (5, None), (6, "green dog"), (7, "gray owl")], "id long, t string")
    asked = spark.createDataFrame([(1, "red unknown"), (2, ""), (3, None)], "query_id long, text string")
    hits = search.top_k(search.bm25(search.tokenized(docs, "id", "t"), asked), 1, positive=True).collect()
    assert [(r.query_id, r.id) for r in hits] == [(1, 1)]


def test_vector_search_keeps_negative_scores(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])], "id long, vector array<float>")
    got = search.vector_top_k(v, v.where("id = 1").withColumnRenamed("id", "query_id"), 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (3, 1.0), (2, -1.0)]
    odd = v.unionByName(spark.createDataFrame([(4, None), (0, []), (5, [1.0]), (6, [1.0, None]), (7, None)], v.schema))
    got = search.vector_top_k(odd, odd.where("id in (1, 4, 5)").withColumnRenamed("id", "query_id"), 5).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(1, 1, 1.0), (1, 3, 1.0), (1, 2, -1.0)]
    assert search.vector_top_k(v.limit(0), v.limit(0).withColumnRenamed("id", "query_id"), 5).count() == 0


def test_merge_fields_ties_and_empty_values(spark):
    rows = [(1, "a", 1, "x", 0.5, "p"), (1, "a", 2, "y", 0.5, "q"), (1, "b", 1, "", 0.9, "p"), (1, "b", 2, "z", 0.1, "q"), (1, "c", 1, "x", 0.5, "p"), (1, "c", 2, None, 0.6, "q")]
    got = {r.field: (r.value, r.source) for r in evidence.merge_fields(spark.createDataFrame(rows, "doc_id long, field string, tier int, value string, confidence double, source string")).collect()}
    assert got == {"a": ("x", "p"), "b": ("z", "q"), "c": (None, "q")}


def test_votes_tie_to_the_first(spark):
    rows = [(1, "b", 1), (1, "a", 2), (2, "a", 1), (2, "a", 2), (2, "b", 3)]
    got = {r.item_id: (r.vote, r.needs_review) for r in evidence.majority_vote(spark.createDataFrame(rows, "item_id long, vote string, pass long")).collect()}
    assert got == {1: ("b", True), 2: ("a", True)}


def test_filters_ignore_all_and_null(spark):
    df = spark.createDataFrame([("K", "Oak Door"), (None, "oak floor"), ("B", None)], "room string, d string")
    assert takeoffs.filtered(df, equal={"room": "all"}, search="OAK", fields=["d"]).count() == 2
    assert takeoffs.filtered(df, equal={"room": "B"}, search=None, fields=["d"]).count() == 1


def test_records_and_exports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id long, t string")
    files.write_records(df, str(tmp_path / "r"))
    assert sorted(map(tuple, files.read_records(spark, str(tmp_path / "r"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    files.export_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).where("id = 1").first().t == 'a "b", c'
    assert files.files(spark, str(tmp_path / "r"), "*.json").count() >= 1
    files.write_index(df, str(tmp_path / "i"), "id")
    assert spark.read.parquet(str(tmp_path / "i")).where("id = 2").count() == 1


def test_stream_of_changes_equals_the_table(spark, tmp_path):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, None), (2, 2, None), (2, 3, "x"), (1, 4, "a")]
    df = spark.createDataFrame(rows, "k long, n long, v string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changes.stream_changes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "n", "v")
    q = stream.writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, changes.changes(df, "k", ["n"], "v").collect()), key=repr)
    assert sorted(map(tuple, spark.sql("SELECT k, n, v FROM changed").collect()), key=repr) == want == sorted([rows[i] for i in (0, 2, 3, 5, 6)], key=repr)


def test_page_elements_and_xml_of_odd_rows(spark):
    from tessellum.operators import ingest

    html = '<script>var t="<p>no</p>";</script><p class="a">One <b>two</b></p><P>three</P><p></p><!-- <li>no</li> --><pre>no</pre><li>x\ny</li>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    got = sorted(tuple(r) for r in ingest.page_elements(pages, "id", "html").collect())
    assert got == [(1, "list_item", 0, "x y"), (1, "paragraph", 0, "One two")]
    docs = spark.createDataFrame([(1, "<a><Name>x</Name></a>"), (2, "<a><Na"), (3, None), (4, '<m:a xmlns:m="u"><m:Name>y</m:Name></m:a>')], "id long, xml string")
    assert sorted((r.id, r.value) for r in ingest.xml_fields(docs, "id", "xml", {"name": "Name"}).collect()) == [(1, "x"), (4, "y")]
