"""Edge rows of chunks with sources, cell tables, answers, grounding and studies."""

from pyspark.sql import functions as F

from tessellum.functions import typed, workflow
from tessellum.operators import answers, chunks, grid, studies


def test_document_windows_at_their_edges(spark):
    rows = [(1, 0, 1, "a", "x " * 6), (1, 1, 1, "b", None), (1, 2, 2, "c", "y " * 7), (1, 3, 3, "d", "z"), (2, 0, 1, "e", "  "), (3, 0, 1, "f", "w " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, page long, element_id string, text string")
    got = {(r.doc_id, r.chunk): (r.n_tokens, r.first_page, r.last_page, r.element_ids) for r in chunks.document_windows(df, 10, 4).collect()}
    assert got == {(1, 0): (10, 1, 2, ["a", "c"]), (1, 1): (8, 2, 3, ["c", "d"]), (3, 0): (10, 1, 1, ["f"])}
    assert chunks.document_windows(df.limit(0)).count() == 0


def test_grid_of_nulls_and_unknown_tables(spark):
    cells = [(1, 0, 0, None, None), (2, 0, 0, "Site Value", 0.0), (2, 0, 1, "$5", None), (2, 1, 0, "Total cost new", 0.5), (3, 0, 0, "Borrower", None)]
    df = spark.createDataFrame(cells, "table_id long, row int, col int, content string, confidence double")
    assert {tuple(r) for r in grid.kinds(df).collect()} == {(2, "cost_approach"), (3, "subject")}
    assert [tuple(r) for r in grid.table_fields(df).collect()] == [(2, "cost_approach", "site_value", "5", 0.85)]
    assert grid.table_fields(df.limit(0)).count() == 0


def test_answers_and_values_that_are_none(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "```json\n{bad}\n```")], "id long, t string")
    assert {r.component_type for r in answers.components(df, "id", "t").collect()} == {"unknown"}
    for kind in answers.KINDS:
        assert all(r.failed for r in answers.answered(df, "id", "t", kind).collect())
    v = spark.range(1).select(typed.service_value(F.lit("year_built"), F.lit(None).cast("string")).alias("a"), typed.xml_value(F.lit("site_value"), F.lit("$1,000.5")).alias("b"), typed.vision_value(F.lit("x.tax_year"), F.lit("y. 2001")).alias("c")).first()
    assert tuple(v)[:2] == (None, "1000.5")


def test_rooms_and_moves_of_odd_rows(spark):
    none = spark.createDataFrame([(1, 1, 1, None, None, None)], "study_id long, place long, file_id long, type string, room_type string, objects array<struct<label string, potential_asset boolean>>")
    assert studies.rooms(none).count() == studies.objects(none).count() == 0
    row = spark.range(1).select(workflow.step(F.lit(None).cast("string")).alias("a"), workflow.valid_move(F.lit("odd"), F.lit("uploading_documents")).alias("b"), workflow.reachable(F.lit("x"), F.array(F.lit("y")), F.lit("completed")).alias("c")).first()
    assert tuple(row) == (-1, False, False)
