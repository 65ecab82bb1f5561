"""Queries over coded text, report fields, paragraphs, section paths and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import codes, labels
from tessellum.operators import forms, layout, search
from tessellum.sources import tables

WORDS = [w for label, words in labels.SYNONYMS.items() for w in (label, *words)]
CRITICAL = ["property_address", "total_value", "year_built"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A text with codes for each part, SQL that both engines read.
_CODED = """concat('Section ', p_partkey + 90, '(e)(', p_size, ')(B) applies to §', p_partkey, ' and § ', p_size, '.5 of abc', p_partkey, 'x; class ', p_size + 50, '.', p_partkey % 13, ', ', p_size, ' years, ', p_name, ' 1,', p_partkey, ' class 57.0 57')"""
_SPLIT = """concat(upper(substr(p_name, 1, 1)), '  ', substr(p_name, 2), ' Le gal  P art e ')"""
#: A report for each order: every field in some of its forms, some without.
_REPORT = r"""concat(
CASE WHEN o_orderkey % 3 = 0 THEN 'Property Address: ' WHEN o_orderkey % 3 = 1 THEN 'Seen: ' ELSE '' END, o_orderkey, ' Long Mill Road', chr(10),
CASE WHEN o_orderkey % 5 < 3 THEN 'Appraisal Date: ' ELSE 'On ' END, o_custkey % 12 + 1, '/', o_custkey % 28 + 1, '/2021', chr(10),
CASE WHEN o_orderkey % 2 = 0 THEN 'Effective date: March 3, 2020' ELSE 'none' END, chr(10),
CASE WHEN o_orderkey % 4 = 0 THEN 'Total Value: $1,' WHEN o_orderkey % 4 = 1 THEN 'Total Value: , Market value $' ELSE 'Appraised value ' END, o_custkey % 900 + 100, chr(10),
'Land value: ', o_custkey, '.50', chr(10), 'improvement value ', o_orderkey, chr(10),
CASE WHEN o_orderkey % 7 = 0 THEN 'An office in a hotel' WHEN o_orderkey % 7 = 1 THEN 'Mixed use, residential rental' ELSE 'House' END, chr(10),
'Construction class: ', substr('ABCDSE', CAST(o_orderkey % 6 AS INT) + 1, 1), chr(10),
CASE WHEN o_orderkey % 2 = 0 THEN 'Quality: Very Good' ELSE 'fair quality' END, ', poor condition', chr(10),
'GBA: ', o_custkey, ' sf, rentable area ', o_custkey % 77, chr(10), 'Lot size: 1,', o_custkey % 900 + 100, ' sq. ft', chr(10),
'Land of ', o_custkey % 9, '.', o_orderkey % 9, CASE WHEN o_orderkey % 11 = 0 THEN '.1' ELSE '' END, ' acres', chr(10),
o_custkey % 9, ' stories, Units: ', o_orderkey % 40, chr(10),
'Year built: ', 1700 + o_custkey % 400, ' Constructed in ', 1900 + o_custkey % 100, chr(10),
'Effective age: ', o_custkey % 60, ' years, total economic life ', o_custkey % 90, chr(10),
CASE WHEN o_orderkey % 2 = 0 THEN 'City: green hill' ELSE '' END, chr(10), 'Old Town, TX ', 10000 + o_custkey % 80000, chr(10), 'hays county', chr(10),
'Location factor: ', o_custkey % 4, '.', o_orderkey % 10, ' Local multiplier 1.1')"""


def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 T4 T5."""
    coded = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_CODED).alias("text"))
    return coded.select("p_partkey", F.array_join(codes.code_tokens(F.col("text")), "|").alias("tokens"), F.size(codes.class_codes(F.col("text"))).alias("classes"), codes.cites_section(F.col("text")).alias("cites"))


def token_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each source taken as a type of document."""
    kind = F.when(F.col("doc_id") % 2 == 0, "irs").otherwise(F.col("source"))
    return tables.spread(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", F.size(codes.tokens_for(kind, F.col("text"))).alias("n_tokens"))


def repaired_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 T15."""
    return _table(spark, sf_dir, "part").select("p_partkey", codes.repaired(F.expr(_SPLIT)).alias("text"), codes.to_number(F.expr("concat('$ 1,', p_size + 100, '.5')")).alias("number"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.report_fields(_table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_REPORT).alias("text")), "o_orderkey", "text")


def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 X2 X3 X4 X5 X6 X7 X8 X9 X10 X11 X12 X13 X14 X15 X16 X17 X18."""
    return _reports(spark, sf_dir).withColumn("coverage", F.round("coverage", 6))


def field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reports have a field at each confidence."""
    rows = forms.field_rows(_reports(spark, sf_dir), CRITICAL)
    return rows.groupBy("field", "confidence").agg(F.count("*").alias("n"))


_LINES = """SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(floor(seq / 40) AS BIGINT) AS page, text,
CAST(50 + (seq * 7 % 5) * 20 AS DOUBLE) AS x0, CAST(seq % 40 * 24 + seq % 3 * 2 AS DOUBLE) AS y0, CAST(300 + length(text) AS DOUBLE) AS x1, CAST(seq % 40 * 24 + 12 AS DOUBLE) AS y1, CAST(10 + seq % 4 * 0.6 AS DOUBLE) AS font"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, laid out by their number."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    found = layout.paragraphs(docs.selectExpr(*_columns(_LINES)), ["doc_id", "page"])
    return found.select("doc_id", "page", F.col("place").cast("long"), F.md5("text").alias("text"), "x0", "y0", "x1", "y1", "font")


def _columns(select: str) -> list[str]:
    """The columns of a SELECT, split at its commas outside parentheses."""
    out, depth, at = [], 0, 7
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[at:i])
            at = i + 1
    return [*out, select[at:]]


_TYPES = "CASE WHEN seq % 11 = 3 THEN 'title' WHEN seq % 4 = 1 THEN 'heading' ELSE 'paragraph' END"


def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines of documents as titles, headings and paragraphs; the path is given by its md5."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    typed = docs.withColumn("element_type", F.expr(_TYPES))
    return layout.section_paths(typed, "doc_id").select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5(F.array_join("path", "/")).alias("path"))


def _word(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WORDS]), F.expr(f"cast(({key}) % {len(WORDS)} as int) + 1"))


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of vectors against each other and against a vote."""
    a, b = F.concat(F.upper(_word("vec_id")), F.when(F.col("vec_id") % 3 == 0, " door").otherwise("")), _word("vec_id * 5 + label")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", labels.same_thing(a, b).alias("same"), labels.voted(a, b, (F.col("label") / 10.0)).alias("v"))
    return rows.select("vec_id", "same", "v.label", "v.agreed")


def label_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14."""
    a, b = F.concat(F.lit("Wall "), F.upper(_word("vec_id"))), F.concat(_word("vec_id * 5 + label"), F.lit(" set"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", labels.related(a, b).alias("related"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaled vectors, three of their values each."""
    v = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    return _table(spark, sf_dir, "embeddings").select("vec_id", search.unit(v).alias("v")).select("vec_id", *[F.round(F.col("v")[i], 5).alias(f"v{i}") for i in (0, 1, 63)])


def relative_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in pixels and in parts of an image."""
    e = lambda i: F.abs(F.col("embedding")[i].cast("double")) * F.when(F.col("vec_id") % 2 == 0, 400.0).otherwise(1.0)
    box = _table(spark, sf_dir, "embeddings").select("vec_id", labels.relative_box(e(0), e(1), e(2), e(3)).alias("b"))
    return box.select("vec_id", *[F.round(F.col("b")[k], 6).alias(k) for k in ("x_min", "y_min", "x_max", "y_max")])


def valid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders have a date that can be read, by the form it is written in."""
    form = F.col("o_orderkey") % 5
    at = F.col("o_orderdate")
    text = F.when(form == 0, F.date_format(at, "MM/dd/yyyy")).when(form == 1, F.date_format(at, "M-d-yyyy")).when(form == 2, F.date_format(at, "yyyy-MM-dd")).when(form == 3, F.concat(F.lit("13/"), F.date_format(at, "M/yyyy"))).otherwise("soon")
    return _table(spark, sf_dir, "orders").select(form.alias("form"), labels.valid_date(text).alias("valid")).groupBy("form", "valid").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (code_tokens, token_dispatch, repaired_text, report_fields, field_rows, paragraphs, section_paths, label_match, label_related, unit_vectors, relative_boxes, valid_dates)}


def _tokens_sql(text: str) -> str:
    found = f"list_filter(regexp_extract_all({text}, '{codes.CODE}'), lambda c: NOT regexp_full_match(c, '\\d{{1,2}}'))"
    bare, base = "replace(lower(x[1]), ' ', '')", r"regexp_extract(x[1], '\d+(?:\.\d+)?')"
    more = f"list_concat(acc, [{bare}], CASE WHEN x[1] LIKE '%§%' THEN [replace({bare}, '§', '')] ELSE []::VARCHAR[] END)"
    one = f"list_concat({more}, CASE WHEN list_contains({more}, {base}) THEN []::VARCHAR[] ELSE [{base}] END)"
    first = f"list_reduce(list_transform({found}, lambda c: [c]), lambda acc, x: {one}, []::VARCHAR[])"
    whole = "split_part(x[1], '.', 1)"
    classed = f"CASE WHEN list_contains(acc, x[1]) THEN acc WHEN list_contains(acc, {whole}) THEN list_concat(acc, x) ELSE list_concat(acc, x, [{whole}]) END"
    both = f"list_reduce(list_transform(regexp_extract_all({text}, '{codes.CLASS}'), lambda c: [c]), lambda acc, x: {classed}, {first})"
    return f"list_concat({both}, {_plain_sql(f"regexp_replace({text}, '{codes.LONG_CODE}', ' ', 'g')")})"


def _plain_sql(text: str) -> str:
    words = rf"list_filter(regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z][a-zA-Z0-9]+'))"
    return f"list_transform({words}, lambda w: lower(w))"


def _rule_sql(rule: forms.Rule) -> str:
    reads = []
    for p in rule.patterns:
        x = f"nullif(trim(regexp_extract(text, '{p}', 1, '{'i' if rule.any_case else 'c'}')), '')"
        if rule.kind in ("double", "bigint"):
            x = f"TRY_CAST(replace({x}, ',', '') AS {rule.kind})"
        elif rule.kind == "title":
            x = f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
        elif rule.kind == "upper":
            x = f"upper({x})"
        reads.append(f"CASE WHEN {x} BETWEEN {rule.within[0]} AND {rule.within[1]} THEN {x} END" if rule.within else x)
    return f"coalesce({', '.join(reads)}) AS {rule.field}"


def _list_sql(field: str) -> str:
    cases = " ".join(f"WHEN lower(text) LIKE '%{w}%' THEN '{w.title()}'" for w in forms.LISTS[field])
    return f"CASE {cases} END AS {field}"


_FIELDS = f"SELECT o_orderkey AS id, {', '.join([_rule_sql(r) for r in forms.RULES] + [_list_sql(f) for f in forms.LISTS])} FROM (SELECT o_orderkey, {_REPORT} AS text FROM orders)"
_COVERAGE = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in forms.COUNTED)
_EACH = " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM f" for c in [r.field for r in forms.RULES] + list(forms.LISTS))
_SPLIT_LINES = "(SELECT doc_id, unnest(range(len(l))) AS seq, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_NEAR = f"x[1].y0 - acc[-1].y1 < {layout.GAP} AND abs(x[1].font - acc[-1].font) < {layout.FONT} AND abs(x[1].x0 - acc[-1].x0) < {layout.INDENT}"
_JOINED = "struct_pack(text := acc[-1].text || ' ' || x[1].text, x0 := acc[-1].x0, y0 := acc[-1].y0, x1 := greatest(acc[-1].x1, x[1].x1), y1 := x[1].y1, font := acc[-1].font)"
_REPAIR = _SPLIT
for _pattern, _by in codes.REPAIRS:
    _REPAIR = f"regexp_replace({_REPAIR}, '{_pattern}', '{_by.replace('$', chr(92))}', 'g')"
_LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_SETS = " OR ".join(f"(a IN {s} AND b IN {s})" for s in [str((label, *words)) for label, words in labels.SYNONYMS.items()])
_HAS = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_RELATED = " OR ".join(f"({_HAS('a', w)} AND {_HAS('b', w)})" for w in labels.CATEGORIES.values())
ORACLE_SQL: dict[str, str] = {
    "code_tokens": f"SELECT p_partkey, array_to_string({_tokens_sql('text')}, '|') AS tokens, CAST(len(regexp_extract_all(text, '{codes.CLASS}')) AS INT) AS classes, true AS cites FROM (SELECT p_partkey, {_CODED} AS text FROM part)",
    "token_dispatch": f"SELECT doc_id, CAST(len(CASE WHEN doc_id % 2 = 0 THEN {_tokens_sql('t')} ELSE {_plain_sql('t')} END) AS INT) AS n_tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "repaired_text": f"SELECT p_partkey, trim({_REPAIR}) AS text, CAST(concat('1', p_size + 100, '.5') AS DOUBLE) AS number FROM part",
    "report_fields": f"SELECT *, round(({_COVERAGE}) / 25.0, 6)::DOUBLE AS coverage FROM ({_FIELDS})",
    "field_rows": f"""WITH f AS ({_FIELDS}), r AS ({_EACH})
SELECT field, CAST(CASE WHEN field IN {tuple(CRITICAL)} THEN 0.7 WHEN length(value) > 5 THEN 0.8 ELSE 0.75 END AS DOUBLE) AS confidence, count(*) AS n FROM r WHERE value <> '' GROUP BY ALL""",
    "paragraphs": f"""WITH l AS ({_LINES} FROM {_SPLIT_LINES}),
g AS (SELECT doc_id, page, list(struct_pack(text := text, x0 := x0, y0 := y0, x1 := x1, y1 := y1, font := font) ORDER BY seq) AS lines FROM l GROUP BY doc_id, page),
f AS (SELECT doc_id, page, list_reduce(list_transform(lines, lambda s: [s]), lambda acc, x: CASE WHEN {_NEAR} THEN list_concat(acc[:-2], [{_JOINED}]) ELSE list_concat(acc, x) END) AS p FROM g),
u AS (SELECT doc_id, page, unnest(range(len(p))) AS place, unnest(p) AS p FROM f)
SELECT doc_id, page, place, md5(p.text) AS text, p.x0 AS x0, p.y0 AS y0, p.x1 AS x1, p.y1 AS y1, p.font AS font FROM u""",
    "section_paths": f"""WITH e AS (SELECT doc_id, seq, text, {_TYPES} AS t FROM {_SPLIT_LINES})
SELECT doc_id, seq, md5(coalesce((SELECT string_agg(text, '/' ORDER BY seq) FROM (SELECT h.seq, h.text FROM e h WHERE h.doc_id = o.doc_id AND h.seq <= o.seq AND h.t <> 'paragraph'
AND h.seq >= coalesce((SELECT max(k.seq) FROM e k WHERE k.doc_id = o.doc_id AND k.seq <= o.seq AND k.t = 'title'), 0) ORDER BY h.seq DESC LIMIT 3)), '')) AS path FROM e o""",
    "label_match": f"""WITH w AS (SELECT vec_id, label AS n, concat(upper({_LIST}[CAST(vec_id % {len(WORDS)} AS INT) + 1]), CASE WHEN vec_id % 3 = 0 THEN ' door' ELSE '' END) AS la, {_LIST}[CAST((vec_id * 5 + label) % {len(WORDS)} AS INT) + 1] AS b FROM embeddings), v AS (SELECT *, lower(la) AS a FROM w)
SELECT vec_id, contains(a, b) OR contains(b, a) OR {_SETS} AS same, CASE WHEN n / 10.0 >= 0.67 THEN b ELSE la END AS label, n / 10.0 >= 0.67 AS agreed FROM v""",
    "label_related": f"""WITH v AS (SELECT vec_id, concat('wall ', {_LIST}[CAST(vec_id % {len(WORDS)} AS INT) + 1]) AS a, concat({_LIST}[CAST((vec_id * 5 + label) % {len(WORDS)} AS INT) + 1], ' set') AS b FROM embeddings)
SELECT vec_id, contains(a, b) OR contains(b, a) OR {_RELATED} AS related FROM v""",
    "unit_vectors": """WITH n AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)
SELECT vec_id, round(e[1] / n, 5)::DOUBLE AS v0, round(e[2] / n, 5)::DOUBLE AS v1, round(e[64] / n, 5)::DOUBLE AS v63 FROM n""",
    "relative_boxes": """WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: abs(CAST(v AS DOUBLE)) * CASE WHEN vec_id % 2 = 0 THEN 400 ELSE 1 END) AS b FROM embeddings), p AS (SELECT vec_id, b, greatest(b[1], b[2], b[3], b[4]) > 1 AS px FROM e)
SELECT vec_id, round(CASE WHEN px THEN b[1] / 640 ELSE b[1] END, 6) AS x_min, round(CASE WHEN px THEN b[2] / 480 ELSE b[2] END, 6) AS y_min, round(CASE WHEN px THEN b[3] / 640 ELSE b[3] END, 6) AS x_max, round(CASE WHEN px THEN b[4] / 480 ELSE b[4] END, 6) AS y_max FROM p""",
    "valid_dates": "SELECT o_orderkey % 5 AS form, o_orderkey % 5 < 4 AS valid, count(*) AS n FROM orders GROUP BY ALL",
}
