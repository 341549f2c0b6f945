"""Contract checks, key audits and joined panels: what a study asserts of its tables, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import checks as K
from ..sources.tables import table
from .evaluation import PRED, predictions
from .registry import query
from .sessions import GRID, month_grid


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY 1, 2)
 SELECT 'null_key' AS "check", count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS violations FROM lineitem UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity) OR isinf(l_quantity)) FROM lineitem
 UNION ALL SELECT 'out_of_range', count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 0.05) FROM lineitem UNION ALL SELECT 'shipped_before_order', count(*) FILTER (WHERE l_shipdate <= o_orderdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'repeated_key', count(*) FILTER (WHERE k > 1) FROM d""")
def panel_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique keys, finite features, value ranges and the information set (known before the forecast) of a panel."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    q = F.col("l_quantity")
    own = K.row_checks(lines, {"null_key": F.col("l_orderkey").isNull() | F.col("l_linenumber").isNull(), "not_finite": q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), "out_of_range": ~F.col("l_discount").between(0, 0.05)})
    dated = K.row_checks(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), {"shipped_before_order": F.col("l_shipdate") <= F.col("o_orderdate")})
    return own.unionByName(dated).unionByName(K.repeated_keys(lines, ["l_orderkey", "l_linenumber"]))


@query("""WITH f AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
 SELECT o_orderkey, o_orderstatus, n_lines, quantity, CAST(l_orderkey IS NOT NULL AS INTEGER) AS matched FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def joined_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base panel with features joined by exact key, and a match flag; every base row stays once."""
    f = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    return K.joined_panel(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), f, ["o_orderkey"])


@query("""WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT o_orderpriority, count(*) AS rows, count(l_orderkey) AS matched, count(*) - count(l_orderkey) AS unmatched FROM orders LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY 1""")
def match_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched and unmatched rows of a panel by group."""
    f = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    j = K.joined_panel(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), f, ["o_orderkey"])
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("rows"), F.count_if(F.col("matched") == 1).alias("matched"), F.count_if(F.col("matched") == 0).alias("unmatched"))


@query("""SELECT 'only_left' AS "check", count(*) AS violations FROM (SELECT DISTINCT o_custkey AS k FROM orders) a WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k)
 UNION ALL SELECT 'only_right', count(*) FROM (SELECT DISTINCT c_custkey AS k FROM customer) b WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = k)""")
def key_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that one of two panels lacks, both ways."""
    return K.key_difference(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query(f"""{PRED}, s AS (SELECT *, count(*) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS k FROM p), c AS (SELECT month, nation, actual, predicted FROM s WHERE k = 6), b AS (SELECT month, nation, actual, persistence FROM s WHERE actual > 0 AND persistence IS NOT NULL)
 SELECT coalesce(c.month, b.month) AS month, coalesce(c.nation, b.nation) AS nation, CASE WHEN b.nation IS NULL THEN 'candidate' WHEN c.nation IS NULL THEN 'base' ELSE 'both' END AS side, round(power(c.actual - predicted, 2), 6) AS candidate_loss, round(power(b.actual - persistence, 2), 6) AS base_loss, round(power(c.actual - predicted, 2) - power(b.actual - persistence, 2), 6) + 0.0 AS delta, CAST(c.actual = b.actual AS INTEGER) AS same_actual FROM c FULL JOIN b ON c.month = b.month AND c.nation = b.nation""")
def prediction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate and base predictions aligned by key, with the side that a row comes from, losses and their difference.

    The candidate needs six sessions before, the base one session and a value: either may lack a row of the other.
    """
    g = month_grid(spark, sf_dir)
    w = Window.partitionBy("nation").orderBy("month")
    p = g.select("month", "nation", F.log1p("n").alias("actual"), F.log1p(F.lag("n").over(w)).alias("persistence"), F.avg(F.log1p("n")).over(w.rowsBetween(-6, -1)).alias("predicted"), F.count("*").over(w.rowsBetween(-6, -1)).alias("k"))
    c = p.where("k = 6").select("month", "nation", F.col("actual").alias("ca"), "predicted", F.lit(1).alias("c"))
    b = p.where("actual > 0 and persistence is not null").select("month", "nation", F.col("actual").alias("ba"), "persistence", F.lit(1).alias("b"))
    j = c.join(b, ["month", "nation"], "full")
    x, y = (F.col("ca") - F.col("predicted")) ** 2, (F.col("ba") - F.col("persistence")) ** 2
    side = F.when(F.col("b").isNull(), "candidate").when(F.col("c").isNull(), "base").otherwise("both")
    return j.select("month", "nation", side.alias("side"), F.round(x, 6).alias("candidate_loss"), F.round(y, 6).alias("base_loss"), (F.round(x - y, 6) + F.lit(0.0)).alias("delta"), (F.col("ca") == F.col("ba")).cast("int").alias("same_actual"))


@query("""WITH s AS (SELECT doc_id, quality, md5(CAST(doc_id AS VARCHAR)) AS h FROM labels), a AS (SELECT doc_id, source, md5(CAST(CASE WHEN n_chars % 5 = 0 THEN doc_id + 1 ELSE doc_id END AS VARCHAR)) AS h FROM documents)
 SELECT a.doc_id, source, quality, CASE WHEN s.doc_id IS NULL THEN 'unscored' WHEN s.h <> a.h THEN 'changed' ELSE 'attached' END AS status FROM a LEFT JOIN s ON a.doc_id = s.doc_id""")
def attach_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments with scores many to one; a score counts only if it was made for the same content hash."""
    s = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), "quality", F.md5(F.col("doc_id").cast("string")).alias("sh"))
    a = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.when(F.col("n_chars") % 5 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).cast("string")).alias("h"))
    j = a.join(s, F.col("doc_id") == F.col("k"), "left")
    return j.select("doc_id", "source", "quality", F.when(F.col("k").isNull(), "unscored").when(F.col("sh") != F.col("h"), "changed").otherwise("attached").alias("status"))


@query("""WITH scope AS (SELECT o_orderkey AS id, 1 + o_orderkey % 7 AS declared FROM orders), source AS (SELECT l_orderkey AS id, count(*) AS n, min(l_quantity) AS least FROM lineitem GROUP BY 1), chosen AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
 SELECT 'count_differs' AS "check", count(*) FILTER (WHERE coalesce(n, 0) <> declared) AS violations FROM scope LEFT JOIN source USING (id) UNION ALL SELECT 'weight_not_positive', count(*) FILTER (WHERE least <= 1) FROM source
 UNION ALL SELECT 'chosen_beyond_source', count(*) FILTER (WHERE c.n > coalesce(s.n, 0)) FROM chosen c LEFT JOIN source s USING (id) UNION ALL SELECT 'outside_scope', count(*) FROM source WHERE id NOT IN (SELECT id FROM scope)""")
def ledger_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and selected ledgers against their scope: counts, positive weights, subset, no id outside."""
    lines = table(spark, sf_dir, "lineitem")
    scope = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 7).alias("declared"))
    source = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"))
    chosen = lines.where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("c"))
    a = K.row_checks(scope.join(source, "id", "left"), {"count_differs": F.coalesce("n", F.lit(0)) != F.col("declared")})
    b = K.row_checks(source, {"weight_not_positive": F.col("least") <= 1})
    c = K.row_checks(chosen.join(source, "id", "left"), {"chosen_beyond_source": F.col("c") > F.coalesce("n", F.lit(0))})
    d = source.join(scope, "id", "left_anti").agg(F.count("*").alias("violations")).select(F.lit("outside_scope").alias("check"), "violations")
    return a.unionByName(b).unionByName(c).unionByName(d)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, list_sort(list(DISTINCT event_type)) AS targets, count(*) AS n FROM events WHERE value > 20 GROUP BY 1), u AS (SELECT list_sort(list(DISTINCT event_type)) AS whole FROM events)
 SELECT day, len(targets) AS targets, n AS rows, CAST(targets = whole AS INTEGER) AS complete FROM d, u""")
def row_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every date holds the same set of targets."""
    e = table(spark, sf_dir, "events")
    d = e.where("value > 20").groupBy(F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("t"), F.count("*").alias("rows"))
    u = e.agg(F.array_sort(F.collect_set("event_type")).alias("whole"))
    return d.crossJoin(F.broadcast(u)).select("day", F.size("t").cast("long").alias("targets"), "rows", (F.col("t") == F.col("whole")).cast("int").alias("complete"))


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{m}' AS measure, l_returnflag AS target, count({m}) AS valid, CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last, round(avg({m}), 4) AS mean, round(stddev_samp({m}), 4) AS sd, min({m}) AS least, max({m}) AS most FROM lineitem GROUP BY l_returnflag" for m in _MEASURES))
def target_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per measure and target: valid rows, first and last date, mean, deviation and range, in one pass."""
    rows = table(spark, sf_dir, "lineitem").unpivot(["l_returnflag", "l_shipdate"], list(_MEASURES), "measure", "v").where("v is not null")
    day = F.to_date("l_shipdate")
    return rows.groupBy("measure", F.col("l_returnflag").alias("target")).agg(F.count("v").alias("valid"), F.min(day).alias("first"), F.max(day).alias("last"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))


@query(f"""WITH {GRID}, s AS (SELECT nation, month, n, sum(n) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead, count(*) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS k, sum(n) OVER (PARTITION BY nation ORDER BY month) AS total FROM grid),
 r AS (SELECT nation, CASE WHEN k = 5 THEN ahead END AS ahead, lead(total, 5) OVER (PARTITION BY nation ORDER BY month) - total AS again FROM s) SELECT nation, count(ahead) AS targets, CAST(count(*) FILTER (WHERE (ahead IS NULL) <> (again IS NULL)) AS BIGINT) AS mismatched, CAST(max(abs(ahead - again)) AS DOUBLE) AS error FROM r GROUP BY 1""")
def recomputed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward sums of five sessions, and the same by differences of running totals: where they disagree, and by how much."""
    w = Window.partitionBy("nation").orderBy("month")
    s = month_grid(spark, sf_dir).select("nation", "month", "n").withColumns({"ahead": F.when(F.count("*").over(w.rowsBetween(1, 5)) == 5, F.sum("n").over(w.rowsBetween(1, 5))), "total": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    r = s.withColumn("again", F.lead("total", 5).over(w) - F.col("total"))
    return r.groupBy("nation").agg(F.count("ahead").alias("targets"), F.count_if(F.col("ahead").isNull() != F.col("again").isNull()).alias("mismatched"), F.max(F.abs(F.col("ahead") - F.col("again"))).cast("double").alias("error"))


@query(f"""{PRED}, g2 AS (SELECT month, nation, ln(1 + n) AS truth FROM grid) SELECT nation, count(*) AS rows, round(max(abs(actual - truth)), 6) + 0.0 AS error, CAST(max(abs(actual - truth)) <= 1e-9 AS INTEGER) AS same FROM q JOIN g2 USING (month, nation) GROUP BY 1""")
def frozen_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the actuals stored beside predictions are those of the panel, by target."""
    g = month_grid(spark, sf_dir).select("month", "nation", F.log1p("n").alias("truth"))
    d = F.abs(F.col("actual") - F.col("truth"))
    return predictions(spark, sf_dir).join(g, ["month", "nation"]).groupBy("nation").agg(F.count("*").alias("rows"), (F.round(F.max(d), 6) + F.lit(0.0)).alias("error"), (F.max(d) <= 1e-9).cast("int").alias("same"))


@query(f"""{PRED} SELECT fold, count(*) AS rows, count(DISTINCT nation) AS targets, count(DISTINCT month) * 25 AS expected, CAST(count(*) = count(DISTINCT month) * 25 AS INTEGER) AS complete, CAST(max(abs(predicted)) < 10 AND bool_and(NOT isinf(predicted)) AS INTEGER) AS bounded FROM q GROUP BY 1""")
def prediction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a prediction panel against those expected by fold, and whether the values are bounded."""
    expected = F.countDistinct("month") * 25
    return predictions(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("rows"), F.countDistinct("nation").alias("targets"), expected.alias("expected"), (F.count("*") == expected).cast("int").alias("complete"), (F.max(F.abs("predicted")) < 10).cast("int").alias("bounded"))


@query(f"""{PRED}, r AS (SELECT *, avg(actual - predicted) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS e FROM q) SELECT month, nation, fold, round(persistence, 6) AS persistence, round(predicted, 6) AS base, round(coalesce(e, 0), 6) + 0.0 AS correction, round(predicted + 0.5 * coalesce(e, 0), 6) AS prediction, round(tanh(predicted + 0.5 * coalesce(e, 0)), 6) AS correlation FROM r""")
def residual_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base predictions plus half the mean residual of the last year, beside persistence and the inverse transform."""
    w = Window.partitionBy("nation").orderBy("month").rowsBetween(-12, -1)
    e = F.coalesce(F.avg(F.col("actual") - F.col("predicted")).over(w), F.lit(0.0))
    p = predictions(spark, sf_dir).withColumn("e", e).withColumn("z", F.col("predicted") + 0.5 * F.col("e"))
    return p.select("month", "nation", "fold", F.round("persistence", 6).alias("persistence"), F.round("predicted", 6).alias("base"), (F.round("e", 6) + F.lit(0.0)).alias("correction"), F.round("z", 6).alias("prediction"), F.round(F.tanh("z"), 6).alias("correlation"))


@query("""SELECT role, count(*) AS requests, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest, count(*) FILTER (WHERE length(text) > 300) AS overflow, count(*) - count(DISTINCT (conv_id, turn)) AS repeated FROM conversations GROUP BY GROUPING SETS ((role), ())""")
def preflight_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests before a run: totals of bytes and characters, the longest, those beyond the limit, and repeated ids, by role."""
    c, n = table(spark, sf_dir, "conversations"), F.length("text")
    one = F.struct("conv_id", "turn")
    aggs = [F.count("*").alias("requests"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(n).alias("chars"), F.max(n).cast("long").alias("longest"), F.count_if(n > 300).alias("overflow"), (F.count("*") - F.countDistinct(one)).alias("repeated")]
    return c.groupingSets([[F.col("role")], []], F.col("role")).agg(*aggs).select("role", "requests", "bytes", "chars", "longest", "overflow", "repeated")


@query("""SELECT column_name AS feature, CAST(regexp_matches(column_name, 'date$|^l_return') AS INTEGER) AS leaky FROM (DESCRIBE lineitem)""")
def leaky_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature names, and which a model may not see."""
    columns = table(spark, sf_dir, "lineitem").columns
    bad = K.leaky_names(columns, "date$|^l_return")
    return spark.createDataFrame([(c, int(c in bad)) for c in columns], "feature string, leaky int")


@query("""WITH v AS (SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN 'inf' WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 17 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS raw FROM events), t AS (SELECT event_type, raw, TRY_CAST(raw AS DOUBLE) AS x FROM v)
 SELECT event_type, count(*) FILTER (WHERE raw IS NULL) AS missing, count(*) FILTER (WHERE raw IS NOT NULL AND x IS NULL) AS text, count(*) FILTER (WHERE isinf(x)) AS infinite, count(*) FILTER (WHERE x IS NOT NULL AND NOT isinf(x)) AS finite FROM t GROUP BY 1""")
def numeric_or_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that may be missing but neither text nor infinite, counted by kind."""
    i, x = F.col("event_id"), F.col("raw").try_cast("double")
    v = table(spark, sf_dir, "events").select("event_type", F.when(i % 11 == 0, "inf").when(i % 13 == 0, "n/a").when(i % 17 == 0, None).otherwise(F.get_json_object("props", "$.k")).alias("raw"))
    infinite = F.abs(x) == float("inf")
    return v.groupBy("event_type").agg(F.count_if(F.col("raw").isNull()).alias("missing"), F.count_if(F.col("raw").isNotNull() & x.isNull()).alias("text"), F.count_if(infinite).alias("infinite"), F.count_if(x.isNotNull() & ~infinite).alias("finite"))


@query(f"""WITH {GRID}, c AS (SELECT month, lead(month) OVER (ORDER BY month) AS forecast FROM (SELECT DISTINCT month FROM grid)), f AS (SELECT month, nation, ln(1 + n) AS x1, CASE WHEN count(n) OVER w5 = 5 THEN avg(ln(1 + n)) OVER w5 END AS x5, CASE WHEN count(n) OVER w21 = 12 THEN avg(ln(1 + n)) OVER w21 END AS x12, ln(1 + n) - avg(ln(1 + n)) OVER (PARTITION BY month, n_regionkey) AS gap FROM grid JOIN nation ON nation = n_nationkey WINDOW w5 AS (PARTITION BY nation ORDER BY month ROWS 4 PRECEDING), w21 AS (PARTITION BY nation ORDER BY month ROWS 11 PRECEDING)),
 y AS (SELECT month AS forecast, nation, ln(1 + n) AS target FROM grid) SELECT f.month AS asof, c.forecast, f.nation, round(x1, 6) AS x1, round(x5, 6) AS x5, round(x12, 6) AS x12, round(gap, 6) + 0.0 AS gap, round(target, 6) AS target FROM f JOIN c USING (month) JOIN y ON y.forecast = c.forecast AND y.nation = f.nation WHERE x12 IS NOT NULL""")
def modeling_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each as-of session carried to the next forecast session by the calendar, complete cases, with the target."""
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    g = month_grid(spark, sf_dir).select("month", "nation", F.log1p("n").alias("x1"))
    w, peers = Window.partitionBy("nation").orderBy("month"), Window.partitionBy("month", "region")
    mean = lambda k: F.when(F.count("x1").over(w.rowsBetween(1 - k, 0)) == k, F.avg("x1").over(w.rowsBetween(1 - k, 0)))
    f = g.join(F.broadcast(regions), "nation").select(F.col("month").alias("asof"), "nation", "x1", mean(5).alias("x5"), mean(12).alias("x12"), (F.col("x1") - F.avg("x1").over(peers)).alias("gap"))
    c = g.select(F.col("month").alias("asof")).distinct().withColumn("forecast", F.lead("asof").over(Window.orderBy("asof")))
    y = g.select(F.col("month").alias("forecast"), "nation", F.col("x1").alias("target"))
    j = f.where("x12 is not null").join(F.broadcast(c), "asof").join(y, ["forecast", "nation"])
    return j.select("asof", "forecast", "nation", *[(F.round(k, 6) + F.lit(0.0)).alias(k) for k in ("x1", "x5", "x12", "gap", "target")])
