"""The mixing stage takes every row for itself: rows whose nulls, maps or nested values differ are not one."""

from tessellum.llm import mixing


def _taken(docs, **how):
    return sorted(str(r.asDict(recursive=True)) for r in mixing.mixed_documents(docs, **how).collect())


def test_values_in_other_columns_and_nulls_in_other_places_are_other_rows(spark):
    rows = [(1, "hello big world", None, "a"), (1, None, "hello big world", "a"), (1, "hello big world", None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string, source string")
    once = _taken(docs, weights=(1,), max_copies=1)
    assert once == sorted(str(r.asDict()) for r in docs.where("text is not null").collect())
    texts = [(i, None if i % 2 else f"word{i} again", f"word{i} again" if i % 2 else None, "a") for i in range(20)]
    docs = spark.createDataFrame([(0, t, n, s) for i, t, n, s in texts], "doc_id long, note string, other string, source string").selectExpr("*", "'same text here' text")
    assert _taken(docs, weights=(1,), max_copies=1) == sorted(str(r.asDict()) for r in docs.collect())


def test_rows_that_differ_only_within_maps_arrays_structs_and_variants(spark):
    docs = spark.sql("""
        select 1L doc_id, 'one two three' text, 'a' source, m, l, named_struct('p', p, 'q', q) s, parse_json(v) j from values
        (map('x', 1), array(1, null), 1, null, '{"a": 1}'), (map('x', 2), array(1, null), 1, null, '{"a": 1}'),
        (map('x', 1), array(null, 1), 1, null, '{"a": 1}'), (map('x', 1), array(1, null), null, 1, '{"a": 1}'),
        (map('x', 1), array(1, null), 1, null, '{"a": 2}'), (map('x', 1, 'y', 2), cast(null as array<int>), 1, null, null),
        (map('y', 2, 'x', 1), cast(null as array<int>), 1, null, null) as t(m, l, p, q, v)""").selectExpr("doc_id", "text", "source", "m", "l", "s", "j")
    shown = lambda df: sorted(tuple(r) for r in df.selectExpr("to_json(array_sort(map_entries(m)))", "to_json(l)", "to_json(s, map('ignoreNullFields', 'false'))", "to_json(j)").na.fill("-").collect())
    assert shown(mixing.mixed_documents(docs, weights=(1,), max_copies=1)) == shown(docs)
