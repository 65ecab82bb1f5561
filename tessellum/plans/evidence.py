"""Queries over boxes, votes, fields, reviews and corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellum.functions import geometry
from tessellum.operators import evidence, validation

CRITICAL = ["date", "price"]
THRESHOLDS = {"click": 0.7, "error": 0.75, "purchase": 0.6}
HIGH_VALUE = ["purchase", "signup"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight boxes an image, made of the first values of vectors; even ids are detections, odd ones artifacts."""
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    box = geometry.box(e(0), e(1), F.least(F.lit(1.0), e(0) + e(2) + 0.05), F.least(F.lit(1.0), e(1) + e(3) + 0.05))
    return _table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("image_id"), F.col("vec_id").alias("id"), box.alias("box"))


def bbox_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 G2 G3 G6."""
    b = F.col("box")
    padded, pixels = geometry.pad(b, 0.25), geometry.to_pixels(b, 640, 480)
    return _boxes(spark, sf_dir).select("id", F.round(geometry.area(b), 6).alias("area"), pixels["x_max"].alias("px"), pixels["y_max"].alias("py"), F.round(geometry.area(padded), 6).alias("padded"), geometry.valid(b).alias("valid"))


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 G15 G16."""
    boxes = _boxes(spark, sf_dir)
    found = evidence.best_match(boxes.where("id % 2 = 1").withColumnRenamed("id", "artifact_id"), boxes.where("id % 2 = 0").withColumnRenamed("id", "detection_id"))
    return found.withColumn("iou", F.round("iou", 6))


def grounding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G18."""
    return evidence.grounding_score(best_match(spark, sf_dir)).withColumn("score", F.round("score", 6))


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are passes, their types votes."""
    votes = _table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("vote"), F.col("event_id").alias("pass"))
    return evidence.majority_vote(votes).withColumn("agreement", F.round("agreement", 6))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    values = {"date": F.date_format("o_orderdate", "yyyy-MM-dd"), "price": F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "priority": F.col("o_orderpriority")}
    rows = []
    for tier, source in enumerate(("xml", "layout", "vision"), 1):
        for k, (field, value) in enumerate(sorted(values.items())):
            seen = F.when((key + tier + k) % 4 != 0, value).otherwise("")
            rows.append(F.struct(F.lit(field).alias("field"), F.lit(tier).alias("tier"), seen.alias("value"), (((key * (7 + tier) + 13 * k) % 50 + 50) / 100).alias("confidence"), F.lit(source).alias("source")))
    return orders.select(key.alias("doc_id"), F.inline(F.array(*rows)))


def merge_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 M5 M6 M9: three tiers of fields of each order."""
    return evidence.merge_fields(_tiers(spark, sf_dir))


def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 M8."""
    return evidence.overall(merge_tiers(spark, sf_dir), CRITICAL)


def weak_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 M4 M10 M11."""
    return evidence.weak_fields(merge_tiers(spark, sf_dir), CRITICAL)


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("component"), (F.col("event_id") * 7919 % 1000 / 1000).alias("confidence"),
        (F.col("event_id") % 5 != 0).alias("grounded"), (F.col("event_id") % 11 == 0).alias("flagged"),
    )


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts to review, with their reasons and priority."""
    c = F.col
    reasons = evidence.review_reasons(c("component"), c("confidence"), c("grounded"), c("flagged"), THRESHOLDS, HIGH_VALUE)
    found = _artifacts(spark, sf_dir).withColumn("reasons", reasons).where(F.size("reasons") > 0)
    return found.select("event_id", F.array_join("reasons", ",").alias("reasons"), F.round(evidence.review_priority(c("reasons"), c("confidence")), 6).alias("priority"))


def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue by band of priority."""
    p = F.col("priority")
    band = F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")
    return review_queue(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def review_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue by reason, up to its first underscore."""
    each = review_queue(spark, sf_dir).select(F.explode(F.split("reasons", ",")).alias("reason"))
    return each.groupBy(F.substring_index("reason", "_", 1).alias("reason")).agg(F.count("*").alias("n"))


def artifact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component in any case, a least confidence, grounded; a criterion that is null is ignored."""
    criteria = {"component": "PURCHASE", "least": 0.6, "grounded": None}
    found = _artifacts(spark, sf_dir)
    for name, rule in (("component", lambda v: F.lower("component") == v.lower()), ("least", lambda v: F.col("confidence") >= v), ("grounded", lambda v: F.col("grounded") == v)):
        found = found if criteria[name] is None else found.where(rule(criteria[name]))
    return found.select("event_id", "component", "confidence")


def artifact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before and after the middle of January 2024, keyed by user, last one wins."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    cut = events.agg(F.floor(F.max("event_id") / 2).alias("cut"))
    parted = events.crossJoin(F.broadcast(cut))  # one row
    none = events.limit(0)
    old = evidence.merge_by_id(none, parted.where("event_id <= cut").drop("cut"), "user_id", "event_id")
    return evidence.merge_by_id(old, parted.where("event_id > cut").drop("cut"), "user_id", "event_id")


def corrections_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 in part: corrections (an event each) by field and by engineer (user modulo 10)."""
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("field"), (F.col("user_id") % 10).alias("engineer")).agg(F.count("*").alias("n"))


def corrections_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 in part: the ten artifacts (users) with most corrections, ties by id, as a top-k report."""
    return _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("artifact_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artifact_id").limit(10)


def training_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each correction with the value it replaced in its artifact and field."""
    before = F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("field"), before.alias("old_value"), F.col("value").alias("new_value"))


def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on each order's year, four amounts, and gap between price and the sum of its lines.

    Some orders have a year from 1700 on, or one that doesn't read as four digits, amounts are a thousandfold or negative for some, so that each rule finds some.
    """
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    o = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey")
    price = F.round(F.col("o_totalprice") * 100).cast("long")
    year = F.when(key % 7 == 0, 1700 + key % 400).otherwise(F.year("o_orderdate")).cast("string")
    year = F.when(key % 23 == 5, F.concat(F.lit("'"), F.substring(year, 3, 2))).when(key % 29 == 6, F.concat(year, F.lit("?"))).when(key % 31 == 7, " ").otherwise(year)
    amounts = {name: price * F.when(key % m == 0, 1000).when(key % m == 1, -1).otherwise(1) for name, m in (("price", 11), ("land", 13), ("cost", 17), ("rent", 19))}
    rules = [
        *validation.year_rules(year, F.year(F.current_date())),
        *[rule for name, cents in amounts.items() for rule in validation.amount_rules(name, cents)],
        validation.gap_rule(price, F.col("cents")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.struct(F.lit(a).alias("rule"), F.lit(b).alias("severity"))) for a, b, r in rules]))
    return o.select("o_orderkey", F.inline(found))


def presence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on the critical fields of each order's merged tiers, and whether it goes to review."""
    of = lambda c, name: F.max(F.when(F.col("field") == c, F.col(name)))
    wide = merge_tiers(spark, sf_dir).groupBy("doc_id").agg(*[of(c, n).alias(f"{c}_{n}") for c in CRITICAL for n in ("value", "confidence")])
    rules = validation.presence_rules({c: (F.col(f"{c}_value"), F.col(f"{c}_confidence")) for c in CRITICAL})
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(a).alias("rule"), F.lit(b).alias("severity"))) for a, b, rule in rules]))
    text = F.array_join(F.transform("f", lambda x: F.concat(x["rule"], F.lit(":"), x["severity"])), ",")
    return wide.select("doc_id", found.alias("f")).select("doc_id", text.alias("findings"), validation.needs_review(F.col("f"), CRITICAL).alias("needs_review"))


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule and severity."""
    return validate_rules(spark, sf_dir).groupBy("rule", "severity").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (bbox_ops, best_match, grounding_score, majority_vote, merge_tiers, overall_confidence, weak_fields, review_queue, review_stats,
              review_reason_counts, artifact_search, artifact_merge, corrections_stats, corrections_top, training_export, validate_rules, validation_summary, presence_findings)
}

_BOXES = """
e AS (SELECT vec_id AS id, vec_id // 8 AS image_id, abs(CAST(embedding[1] AS DOUBLE)) AS a, abs(CAST(embedding[2] AS DOUBLE)) AS b, abs(CAST(embedding[3] AS DOUBLE)) AS c, abs(CAST(embedding[4] AS DOUBLE)) AS d FROM embeddings),
x AS (SELECT id, image_id, a AS x0, b AS y0, least(1.0, a + c + 0.05) AS x1, least(1.0, b + d + 0.05) AS y1 FROM e)
"""
_MATCH = f"""{_BOXES},
p AS (SELECT m.image_id, m.id AS artifact_id, d.id AS detection_id, greatest(0, least(m.x1, d.x1) - greatest(m.x0, d.x0)) * greatest(0, least(m.y1, d.y1) - greatest(m.y0, d.y0)) AS i,
 (m.x1 - m.x0) * (m.y1 - m.y0) + (d.x1 - d.x0) * (d.y1 - d.y0) AS s FROM x m JOIN x d USING (image_id) WHERE m.id % 2 = 1 AND d.id % 2 = 0),
r AS (SELECT *, i / (s - i) AS iou, row_number() OVER (PARTITION BY artifact_id ORDER BY i / (s - i) DESC, detection_id) AS k FROM p WHERE i > 0),
g AS (SELECT x.image_id, x.id AS artifact_id, r.detection_id, coalesce(r.iou, 0) AS iou, r.iou IS NOT NULL AS grounded FROM x LEFT JOIN r ON x.id = r.artifact_id AND k = 1 WHERE x.id % 2 = 1)
"""
_SEEN = ", ".join(f"CASE WHEN (k + {t} + i) % 4 <> 0 THEN v ELSE '' END AS v{t}, CAST((k * {7 + t} + 13 * i) % 50 + 50 AS DOUBLE) / 100 AS c{t}" for t in (1, 2, 3))
_MERGED = f"""
f AS (SELECT o_orderkey AS k, unnest([struct_pack(f := 'date', i := 0, v := strftime(o_orderdate, '%Y-%m-%d')), struct_pack(f := 'price', i := 1, v := CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)), struct_pack(f := 'priority', i := 2, v := o_orderpriority)], recursive := true) FROM orders),
s AS (SELECT k, f, {_SEEN} FROM f),
a AS (SELECT *, c2 > c1 OR (v1 = '' AND v2 <> '') AS t2 FROM s),
b AS (SELECT k, f, v3, c3, CASE WHEN t2 THEN v2 ELSE v1 END AS v, CASE WHEN t2 THEN c2 ELSE c1 END AS c, CASE WHEN t2 THEN 'layout' ELSE 'xml' END AS s FROM a),
m AS (SELECT k AS doc_id, f AS field, CASE WHEN t3 THEN v3 ELSE v END AS value, CASE WHEN t3 THEN c3 ELSE c END AS confidence, CASE WHEN t3 THEN 'vision' ELSE s END AS source FROM (SELECT *, c3 > c OR (v = '' AND v3 <> '') AS t3 FROM b))
"""
_QUEUE = """
a AS (SELECT event_id, event_type AS component, CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS confidence, event_id % 5 <> 0 AS grounded, event_id % 11 = 0 AS flagged FROM events),
r AS (SELECT *, list_filter([CASE WHEN NOT grounded THEN 'ungrounded' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END,
 CASE WHEN confidence < CASE component WHEN 'click' THEN 0.7 WHEN 'error' THEN 0.75 WHEN 'purchase' THEN 0.6 END THEN 'component_threshold' END,
 CASE WHEN component IN ('purchase', 'signup') AND confidence < 0.8 THEN 'high_value' END], lambda x: x IS NOT NULL) AS found FROM a),
q AS (SELECT *, CASE WHEN len(found) = 0 AND flagged THEN ['previously_flagged'] ELSE found END AS reasons FROM r),
w AS (SELECT event_id, array_to_string(reasons, ',') AS reasons, round(least(1.0, (1 - confidence) * 0.4 + CASE WHEN list_contains(reasons, 'ungrounded') THEN 0.2 ELSE 0 END
 + CASE WHEN list_contains(reasons, 'high_value') THEN 0.2 ELSE 0 END + least(greatest(len(reasons) - 1, 0), 3) * 0.1), 6) AS priority FROM q WHERE len(reasons) > 0)
"""
_RULES = """
l AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 1700 + o_orderkey % 400 ELSE year(o_orderdate) END AS y0, CAST(round(o_totalprice * 100) AS BIGINT) AS p, cents FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
t AS (SELECT *, CASE WHEN k % 23 = 5 THEN '''' || substr(CAST(y0 AS VARCHAR), 3, 2) WHEN k % 29 = 6 THEN y0 || '?' WHEN k % 31 = 7 THEN ' ' ELSE CAST(y0 AS VARCHAR) END AS s FROM o), y AS (SELECT *, CASE WHEN regexp_full_match(s, '[0-9]{4}') THEN CAST(s AS INT) END AS y FROM t),
m(rule, d) AS (VALUES ('price', 11), ('land', 13), ('cost', 17), ('rent', 19)),
a AS (SELECT k, rule, p * CASE k % d WHEN 0 THEN 1000 WHEN 1 THEN -1 ELSE 1 END AS c FROM o, m),
v AS (SELECT k AS o_orderkey, 'year' AS rule, 'warning' AS severity FROM y WHERE y < 1800 UNION ALL SELECT k, 'year', 'error' FROM y WHERE y > year(current_date) + 2 UNION ALL SELECT k, 'year_format', 'error' FROM y WHERE y IS NULL AND trim(s) <> ''
 UNION ALL SELECT k, rule, 'error' FROM a WHERE c < 0 UNION ALL SELECT k, rule, 'warning' FROM a WHERE c > 10000000000 UNION ALL SELECT k, 'gap', 'warning' FROM o WHERE abs(p - cents) * 5 > cents)
"""
ORACLE_SQL: dict[str, str] = {
    "bbox_ops": f"""WITH {_BOXES}, w AS (SELECT *, (x1 - x0) * 0.25 AS pw, (y1 - y0) * 0.25 AS ph FROM x)
SELECT id, round((x1 - x0) * (y1 - y0), 6) AS area, CAST(trunc(x1 * 640) AS INT) AS px, CAST(trunc(y1 * 480) AS INT) AS py,
round((least(1.0, x1 + pw) - greatest(0.0, x0 - pw)) * (least(1.0, y1 + ph) - greatest(0.0, y0 - ph)), 6) AS padded, x0 >= 0 AND y0 >= 0 AND x1 <= 1 AND y1 <= 1 AND x1 > x0 AND y1 > y0 AS valid FROM w""",
    "best_match": f"WITH {_MATCH} SELECT image_id, artifact_id, detection_id, round(iou, 6) AS iou, grounded FROM g",
    "grounding_score": f"WITH {_MATCH} SELECT image_id, round(avg(CAST(grounded AS INT)), 6) AS score FROM g GROUP BY image_id",
    "majority_vote": """WITH e AS (SELECT user_id AS item_id, event_type AS vote, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) AS k, sum(n) OVER (PARTITION BY item_id) AS total FROM e)
SELECT item_id, vote, round(n / total, 6) AS agreement, n / total < 0.67 AS needs_review FROM r WHERE k = 1""",
    "merge_tiers": f"WITH {_MERGED} SELECT * FROM m",
    "overall_confidence": f"""WITH {_MERGED} SELECT doc_id, coalesce(min(confidence) FILTER (field <> 'priority' AND value <> ''), 0) AS overall_confidence,
count(*) FILTER (field <> 'priority' AND value <> '' AND confidence >= 0.9) < 2 AS needs_review FROM m GROUP BY doc_id""",
    "weak_fields": f"""WITH {_MERGED} SELECT doc_id, field, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CAST(field = 'priority' AS INT), field) AS INT) AS place FROM m WHERE value = '' OR confidence < 0.85""",
    "review_queue": f"WITH {_QUEUE} SELECT * FROM w",
    "review_stats": f"WITH {_QUEUE} SELECT CASE WHEN priority >= 0.7 THEN 'high' WHEN priority >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM w GROUP BY 1",
    "review_reason_counts": f"WITH {_QUEUE} SELECT split_part(r, '_', 1) AS reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS r FROM w) GROUP BY 1",
    "artifact_search": "SELECT event_id, event_type AS component, CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS confidence FROM events WHERE lower(event_type) = 'purchase' AND event_id * 7919 % 1000 >= 600",
    "artifact_merge": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "corrections_stats": "SELECT event_type AS field, user_id % 10 AS engineer, count(*) AS n FROM events GROUP BY ALL",
    "corrections_top": "SELECT user_id AS artifact_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, artifact_id LIMIT 10",
    "training_export": "SELECT event_id, event_type AS field, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old_value, value AS new_value FROM events",
    "presence_findings": f"""WITH {_MERGED}, g AS (SELECT doc_id, field, CASE WHEN value = '' THEN field || ':error' WHEN confidence < 0.9 THEN field || ':warning' END AS x FROM m WHERE field <> 'priority')
SELECT doc_id, coalesce(string_agg(x, ',' ORDER BY field), '') AS findings, count(x) > 0 AS needs_review FROM g GROUP BY doc_id""",
    "validate_rules": f"WITH {_RULES} SELECT * FROM v",
    "validation_summary": f"WITH {_RULES} SELECT rule, severity, count(*) AS n FROM v GROUP BY ALL",
}
