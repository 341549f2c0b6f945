"""Top-K pools, deterministic splits, round robin, permutation controls, set operations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching
from ..operators import rolling as R
from ..sources.tables import table
from .registry import query


def _hash(c: str, seed: str):
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")), 256)


def _hash_sql(c: str, seed: str) -> str:
    return f"sha256('{seed}:' || {c})"


_POOLS = """WITH d AS (SELECT o_orderkey AS id, o_orderpriority AS pool, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice AS w, o_orderdate FROM orders),
 a AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY pool, month ORDER BY w DESC, o_orderdate DESC, id) AS r FROM d) WHERE r <= 16), b AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY month ORDER BY w DESC, o_orderdate DESC, id) AS r FROM d) WHERE r <= 16)
 SELECT id, CAST(id IN (SELECT id FROM a) AS INTEGER) AS in_pool, CAST(id IN (SELECT id FROM b) AS INTEGER) AS in_month FROM (SELECT id FROM a UNION SELECT id FROM b)"""


@query(_POOLS)
def topk_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen heaviest of each pool and of each month; their union, with the pools that chose a row."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pool"), F.trunc(F.to_date("o_orderdate"), "month").alias("month"), F.col("o_totalprice").alias("w"), "o_orderdate")
    order = [F.desc("w"), F.desc("o_orderdate"), F.asc("id")]
    top = lambda *k: d.withColumn("r", F.row_number().over(Window.partitionBy(*k).orderBy(*order))).where("r <= 16").select("id")
    both = top("pool", "month").withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).union(top("month").withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    return both.groupBy("id").agg(F.max("a").alias("in_pool"), F.max("b").alias("in_month"))


_SPLIT = f"""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_hash_sql('doc_id', 's1')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN r <= greatest(1, least(n - 1, CAST(floor(0.3 * n + 0.5) AS BIGINT))) THEN 'development' ELSE 'evaluation' END AS split FROM h"""


@query(_SPLIT)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tenths of each stratum, rounded half up, at least one row on either side, in the order of a seeded hash."""
    w = Window.partitionBy("lang")
    h = table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("r", F.row_number().over(w.orderBy(_hash("doc_id", "s1"), "doc_id"))).withColumn("n", F.count("*").over(w))
    quota = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(0.3 * F.col("n") + 0.5)))
    return h.select("doc_id", "lang", F.when(F.col("r") <= quota, "development").otherwise("evaluation").alias("split"))


_ROBIN = f"""WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_hash_sql('doc_id', 'rr')}, doc_id) AS depth FROM documents) SELECT doc_id, source, depth, row_number() OVER (PARTITION BY depth ORDER BY source) AS turn FROM h"""


@query(_ROBIN)
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of taking turns between sources: the n-th of every source by a seeded hash, then the sources by name."""
    h = table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("depth", F.row_number().over(Window.partitionBy("source").orderBy(_hash("doc_id", "rr"), "doc_id")))
    return h.withColumn("turn", F.row_number().over(Window.partitionBy("depth").orderBy("source")))


_ASSIGN = """WITH t AS (SELECT r_regionkey AS k, r_name AS name FROM region) SELECT doc_id, arg_min(name, row(sha256(doc_id || ':' || name), name)) AS target FROM documents CROSS JOIN t GROUP BY 1"""


@query(_ASSIGN)
def assign_target_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligible target of the least hash with the row's id; targets are a fixed dimension of five names."""
    names = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list("r_name")).alias("names"))
    scored = F.transform("names", lambda n: F.struct(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), n), 256).alias("h"), n.alias("name")))
    return table(spark, sf_dir, "documents").select("doc_id").distinct().crossJoin(F.broadcast(names)).select("doc_id", F.array_min(scored)["name"].alias("target"))


_ROT = """WITH m AS (SELECT s_suppkey AS id, s_nationkey AS g, s_acctbal AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
 o AS (SELECT *, CASE WHEN n > 1 THEN (i + 1 + CAST('0x' || substr(sha256('p' || g), 1, 12) AS BIGINT) % (n - 1)) % n ELSE i END AS j FROM m) SELECT a.id, a.g AS grp, b.id AS donor, b.v AS donated FROM o a JOIN m b ON a.g = b.g AND a.j = b.i"""


@query(_ROT)
def hash_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control: values rotated within their group by an offset from a seeded hash, never onto themselves."""
    w = Window.partitionBy("g")
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("v"))
    m = m.withColumn("i", (F.row_number().over(w.orderBy("id")) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    shift = F.conv(F.substring(F.sha2(F.concat(F.lit("p"), F.col("g").cast("string")), 256), 1, 12), 16, 10).cast("long")
    o = m.withColumn("j", F.when(F.col("n") > 1, (F.col("i") + 1 + shift % F.nullif(F.col("n") - 1, F.lit(0))) % F.col("n")).otherwise(F.col("i")))
    b = m.select("g", F.col("i").alias("j"), F.col("id").alias("donor"), F.col("v").alias("donated"))
    return o.join(b, ["g", "j"]).select("id", F.col("g").alias("grp"), "donor", "donated")


_GATE = """WITH s AS (SELECT c_custkey AS id, c_mktsegment AS seg, CAST(round(c_acctbal / 500) AS BIGINT) AS v FROM customer WHERE c_acctbal > 0) SELECT id, seg, round((rank() OVER (PARTITION BY seg ORDER BY v) + (count(*) OVER (PARTITION BY seg, v) - 1) / 2.0) / count(*) OVER (PARTITION BY seg), 6) AS pct FROM s"""


@query(_GATE)
def variant_gate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank as a share with ties averaged, among the eligible."""
    s = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.round(F.col("c_acctbal") / 500).cast("long").alias("v"))
    return s.select("id", "seg", F.round(R.average_rank_share(["seg"], F.col("v")), 6).alias("pct"))


@query("""SELECT o_orderkey, CAST(l.k IS NOT NULL AS INTEGER) AS has_lines, coalesce(n, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON k = o_orderkey WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)""")
def key_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a match in one table (anti), with the match flag of another that is aggregated before the join."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bad = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    kept = o.join(bad, F.col("o_custkey") == F.col("c_custkey"), "left_anti").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return kept.select("o_orderkey", F.col("l_orderkey").isNotNull().cast("int").alias("has_lines"), F.coalesce("n", F.lit(0)).alias("lines"))


@query("""WITH a AS (SELECT doc_id, quality AS x FROM labels), b AS (SELECT doc_id, CAST(n_chars > 200 AS INTEGER) AS x FROM documents WHERE lang = 'en') SELECT CASE WHEN a.doc_id IS NULL THEN 'right_only' WHEN b.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS rows, max(abs(a.x - b.x)) AS worst, round(avg(abs(a.x - b.x)), 6) AS mean FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1""")
def full_outer_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i"), F.col("quality").alias("x"))
    b = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("j"), (F.col("n_chars") > 200).cast("int").alias("y"))
    gap = F.abs(F.col("x") - F.col("y"))
    side = F.when(F.col("i").isNull(), "right_only").when(F.col("j").isNull(), "left_only").otherwise("both")
    return a.join(b, F.col("i") == F.col("j"), "full").groupBy(side.alias("side")).agg(F.count("*").alias("rows"), F.max(gap).alias("worst"), F.round(F.avg(gap), 6).alias("mean"))


@query("""WITH s AS (SELECT doc_id, max(CASE WHEN source IN ('src0', 'src1') THEN 1 ELSE 0 END) AS a, max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS b, max(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS c FROM documents GROUP BY 1) SELECT CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c, CAST(sum(a * b) AS BIGINT) AS ab, CAST(sum(a * c) AS BIGINT) AS ac, CAST(sum(b * c) AS BIGINT) AS bc, CAST(sum(a * b * c) AS BIGINT) AS abc FROM s""")
def set_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of three id sets and of all their intersections in one pass."""
    flags = {"a": F.col("source").isin("src0", "src1"), "b": F.col("lang") == "en", "c": F.col("n_chars") > 2000}
    s = table(spark, sf_dir, "documents").groupBy("doc_id").agg(*[F.max(c.cast("int")).alias(k) for k, c in flags.items()])
    product = lambda k: F.sum(F.expr(" * ".join(k))).alias(k)
    return s.agg(*[product(k) for k in ("a", "b", "c", "ab", "ac", "bc", "abc")])


@query("""SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr') EXCEPT SELECT doc_id, lang FROM documents WHERE n_chars < 500 INTERSECT SELECT doc_id, lang FROM documents""")
def except_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("lang").isin("en", "fr")).select("doc_id", "lang").subtract(d.where("n_chars < 500").select("doc_id", "lang").intersect(d.select("doc_id", "lang")))


@query("""SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10""")
def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten by count, then name: the limit is the feature."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT event_id, user_id, CAST(CAST('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 15) AS BIGINT) % 8 AS BIGINT) AS shard FROM events")
def shard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", T.hash_shard(F.col("user_id").cast("string"), 8).alias("shard"))


@query("""WITH l AS (SELECT user_id, event_type, arg_max(value, row(ts, event_id)) AS latest, count(*) AS attempts, arg_min(CASE WHEN value > 50 THEN event_id END, row(ts, event_id)) FILTER (WHERE value > 50) AS first_valid FROM events GROUP BY 1, 2) SELECT * FROM l""")
def attempt_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest attempt, number of attempts and first valid one per logical key."""
    at = F.struct("ts", "event_id")
    valid = F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", at).alias("latest"), F.count("*").alias("attempts"), F.min_by(F.when(valid, F.col("event_id")), F.when(valid, at)).alias("first_valid"))


@query()
def quota_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts for every nation with suppliers, among the parts that they delivered, no part serving two nations; a matching has no SQL."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key"))
    parts = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("item")).distinct()
    return matching.quota_matching(parts.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("key", "item"), s.select("key"), 4)
