"""Record queries: linkage through shared keys, nested fields, unpivoting, preflight checks, stability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linkage import linked_groups
from ..sources.tables import table
from .registry import query


@query("""WITH RECURSIVE k AS (SELECT doc_id, md5(text) AS k FROM documents UNION SELECT doc_id, md5(split_part(text, chr(10), 1)) || n_chars FROM documents), m AS (SELECT k, min(doc_id) AS lo FROM k GROUP BY 1), e AS (SELECT DISTINCT doc_id AS a, lo AS b FROM k JOIN m USING (k) WHERE doc_id <> lo UNION SELECT DISTINCT lo, doc_id FROM k JOIN m USING (k) WHERE doc_id <> lo),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS doc_id, min(b) AS "group" FROM r GROUP BY 1""")
def connected_components_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share their text, or first line and length, directly or through other records."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.md5("text"), F.concat(F.md5(F.split("text", "\n", 2)[0]), F.col("n_chars").cast("string"))).alias("keys"))
    return linked_groups(d.select("doc_id", F.explode("keys").alias("key")), "doc_id", "key")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", p.alias("k"), F.when(p % 2 == 0, "even").otherwise("odd").alias("kind"))


@query("""SELECT field, CAST(value AS VARCHAR) AS value, count(*) AS n FROM (UNPIVOT (SELECT o_orderstatus, o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority INTO NAME field VALUE value) GROUP BY 1, 2""")
def label_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    return o.unpivot([], ["o_orderstatus", "o_orderpriority"], "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) AS kinds, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, CAST(bool_and({c} IS NOT DISTINCT FROM l_quantity) AS INTEGER) AS redundant FROM lineitem" for c in NUMBERS))
def feature_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values, missing share, and exact redundancy with the first feature; one pass for all features."""
    t = table(spark, sf_dir, "lineitem").select(*NUMBERS)
    stats = t.agg(*[F.struct(F.lit(c).alias("field"), F.countDistinct(c).alias("kinds"), F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias("missing"), F.bool_and(F.col(c).eqNullSafe(F.col("l_quantity"))).cast("int").alias("redundant")).alias(c) for c in NUMBERS])
    return stats.select(F.explode(F.array(*NUMBERS)).alias("s")).select("s.*")


@query("""WITH s AS (SELECT DISTINCT s_nationkey % 5 AS fold, CAST(floor(s_acctbal / 1000) AS BIGINT) AS feature FROM supplier), n AS (SELECT fold, count(*) AS k FROM s GROUP BY 1), i AS (SELECT a.fold AS a, b.fold AS b, count(*) AS k FROM s a JOIN s b ON a.feature = b.feature AND a.fold < b.fold GROUP BY 1, 2)
 SELECT x.fold AS a, y.fold AS b, round(coalesce(i.k, 0) / (x.k + y.k - coalesce(i.k, 0)), 6) AS jaccard FROM n x JOIN n y ON x.fold < y.fold LEFT JOIN i ON i.a = x.fold AND i.b = y.fold""")
def selection_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the features chosen in each two folds; a fold's features are one array of a fixed list."""
    s = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).alias("fold")).agg(F.collect_set(F.floor(F.col("s_acctbal") / 1000)).alias("f"))
    a, b = s.select(F.col("fold").alias("a"), F.col("f").alias("x")), s.select(F.col("fold").alias("b"), F.col("f").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


# Fine labels and the coarse ones they map to.
COARSE = {"AUTOMOBILE": "durable", "MACHINERY": "durable", "FURNITURE": "durable", "BUILDING": "durable", "HOUSEHOLD": "everyday"}


@query(f"""SELECT c_custkey, CASE {' '.join(f"WHEN c_mktsegment = '{k}' THEN '{v}'" for k, v in COARSE.items())} ELSE 'other' END AS coarse, CASE WHEN c_acctbal > 0 THEN 'applicable' ELSE 'not_applicable' END AS gate FROM customer""")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = reduce(lambda e, kv: e.when(F.col("c_mktsegment") == kv[0], kv[1]), list(COARSE.items())[1:], F.when(F.col("c_mktsegment") == next(iter(COARSE)), COARSE[next(iter(COARSE))]))
    return table(spark, sf_dir, "customer").select("c_custkey", mapped.otherwise("other").alias("coarse"), F.when(F.col("c_acctbal") > 0, "applicable").otherwise("not_applicable").alias("gate"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-08-01").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, CAST(date_trunc('year', o_orderdate) AS DATE) AS year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def regional_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts joined to their orders, then to small dimensions by their size; lines are summed per order first."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    dims = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    orders = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name", F.trunc(F.to_date("o_orderdate"), "year").alias("year")).agg(F.round(F.sum("revenue"), 4).alias("revenue"), F.count("*").alias("orders"))
