"""Composition aggregates and label-score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composition as K
from ..sources.tables import table
from .registry import query

FOUR = [f"embedding[{i}]" for i in range(1, 9)]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score vectors of four labels each: canonical order, and reversed order turned back."""
    e = table(spark, sf_dir, "embeddings")
    d = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", "label", F.slice(d, 1, 4).alias("a"), F.reverse(F.slice(d, 5, 4)).alias("b"))


SCORES = """s AS (SELECT vec_id, label, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS a, list_reverse(list_transform(embedding[5:8], lambda x: CAST(x AS DOUBLE))) AS b FROM embeddings),
 e AS (SELECT *, list_transform(a, lambda x: exp(x - list_max(a))) AS ea, list_transform(b, lambda x: exp(x - list_max(b))) AS eb FROM s),
 p AS (SELECT *, list_transform(ea, lambda x: x / list_sum(ea)) AS p, list_transform(eb, lambda x: x / list_sum(eb)) AS q FROM e),
 m AS (SELECT *, list_transform(list_zip(p, q), lambda t: (t[1] + t[2]) / 2) AS c FROM p),
 h AS (SELECT *, -list_sum(list_transform(p, lambda x: x * ln(x))) AS hp, -list_sum(list_transform(q, lambda x: x * ln(x))) AS hq, -list_sum(list_transform(c, lambda x: x * ln(x))) AS hc FROM m)"""


@query(f"WITH {SCORES} SELECT vec_id, round(c[1], 6) AS c1, round(c[2], 6) AS c2, round(c[3], 6) AS c3, round(c[4], 6) AS c4, round(hc / ln(4), 6) AS entropy, round((hc - (hp + hq) / 2) / ln(2), 6) + 0.0 AS js FROM h")
def score_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of both orders' softmaxes, its normalised entropy, and the orders' Jensen-Shannon divergence."""
    s = _scores(spark, sf_dir).select("vec_id", K.softmax(F.col("a")).alias("p"), K.softmax(F.col("b")).alias("q")).withColumn("c", K.mean_of(F.col("p"), F.col("q")))
    return s.select("vec_id", *[F.round(F.col("c")[i], 6).alias(f"c{i + 1}") for i in range(4)], F.round(K.entropy_of(F.col("c")) / F.log(F.lit(4.0)), 6).alias("entropy"), (F.round(K.jensen_shannon(F.col("p"), F.col("q")), 6) + F.lit(0.0)).alias("js"))


@query(f"""WITH {SCORES} SELECT vec_id, list_position(a, list_max(a)) AS canonical, list_position(b, list_max(b)) AS turned, list_position(c, list_max(c)) AS best,
 round(list_reverse_sort(a)[1] - list_reverse_sort(a)[2], 6) AS margin, CASE WHEN list_position(a, list_max(a)) <> list_position(b, list_max(b)) THEN 'disagreement' WHEN list_reverse_sort(a)[1] - list_reverse_sort(a)[2] < 0.05 THEN 'low_margin' WHEN label >= 8 THEN 'unvalidated_class' ELSE 'accepted' END AS status FROM h""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of both orders, the consensus label, margin, and the reason why a label isn't accepted."""
    a, b = F.col("a"), F.col("b")
    c = K.mean_of(K.softmax(a), K.softmax(b))
    x, y = K.first_argmax(a), K.first_argmax(b)
    status = F.when(x != y, "disagreement").when(K.top_margin(a) < 0.05, "low_margin").when(F.col("label") >= 8, "unvalidated_class").otherwise("accepted")
    return _scores(spark, sf_dir).select("vec_id", x.alias("canonical"), y.alias("turned"), K.first_argmax(c).alias("best"), F.round(K.top_margin(a), 6).alias("margin"), status.alias("status"))


@query(f"""WITH {SCORES}, pri AS (SELECT label % 4 AS k, (count(*) + 1.0) / ((SELECT count(*) FROM embeddings) + 4.0) AS prior FROM embeddings GROUP BY 1), l AS (SELECT list(ln(prior) ORDER BY k) AS lp FROM pri),
 z AS (SELECT vec_id, list_transform(list_zip(a, lp), lambda t: t[1] - 0.5 * t[2]) AS z FROM h, l) SELECT vec_id, list_position(z, list_max(z)) AS calibrated FROM z""")
def calibrated_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of the largest score less half the log of its smoothed prior; the priors are one row of four numbers."""
    e = table(spark, sf_dir, "embeddings")
    counts = e.agg(F.count("*").alias("n"), *[F.count_if(F.col("label") % 4 == k).alias(f"n{k}") for k in range(4)])
    logs = counts.select(F.array(*[F.log((F.col(f"n{k}") + 1.0) / (F.col("n") + 4.0)) for k in range(4)]).alias("lp"))
    z = F.zip_with("a", "lp", lambda s, p: s - 0.5 * p)
    return _scores(spark, sf_dir).crossJoin(F.broadcast(logs)).select("vec_id", K.first_argmax(z).alias("calibrated"))


@query("""WITH k AS (SELECT lang, source, count(*) AS k FROM documents GROUP BY 1, 2) SELECT lang, CAST(sum(k) AS BIGINT) AS n, count(*) AS kinds, round(ln(sum(k)) - sum(k * ln(k)) / sum(k), 6) AS entropy, round(sum(k * k) / (sum(k) * sum(k)), 6) AS hhi FROM k GROUP BY 1""")
def source_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K.entropy_by(table(spark, sf_dir, "documents").select("lang", "source"), ["lang"], "source")
    return e.select("lang", "n", "kinds", F.round("entropy", 6).alias("entropy"), F.round("hhi", 6).alias("hhi"))


_STOCK_DAY = """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS target, user_id, value, hour(ts) AS h FROM events), g AS (SELECT day, target, count(*) AS n, count(DISTINCT user_id) AS users, sum(CASE WHEN h < 9 THEN 1 ELSE 0 END) AS early, min(24 - h) AS freshest, sum(exp(-ln(2) * (24 - h) / 12.0)) AS decayed, sum(value) AS mass FROM e GROUP BY 1, 2),
 grid AS (SELECT day, target FROM (SELECT DISTINCT day FROM e) CROSS JOIN (SELECT DISTINCT target FROM e))
 SELECT day, target, coalesce(n, 0) AS n, coalesce(users, 0) AS users, round(coalesce(early / n, 0.0), 6) AS early_share, freshest, round(coalesce(decayed, 0), 6) AS decayed, round(coalesce(n / sum(n) OVER (PARTITION BY day), 0.0), 6) AS attention FROM grid LEFT JOIN g USING (day, target)"""


@query(_STOCK_DAY)
def stock_day_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, shares, recency and decayed sums per day and target, zero where nothing came, on the dense grid."""
    from pyspark.sql import Window

    h = F.hour("ts")
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("target"), "user_id", h.alias("h"))
    g = e.groupBy("day", "target").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("h") < 9).alias("early"), F.min(24 - F.col("h")).alias("freshest"), F.sum(F.exp(-F.log(F.lit(2.0)) * (24 - F.col("h")) / 12.0)).alias("decayed"))
    grid = e.select("day").distinct().crossJoin(e.select("target").distinct()).join(g, ["day", "target"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return grid.select("day", "target", zero("n").alias("n"), zero("users").alias("users"), F.round(K.share(F.col("early"), F.col("n")), 6).alias("early_share"), "freshest", F.round(F.coalesce("decayed", F.lit(0.0)), 6).alias("decayed"), F.round(K.share(F.col("n"), F.sum("n").over(Window.partitionBy("day"))), 6).alias("attention"))


_W = """WITH w AS (SELECT l_orderkey, l_suppkey % 50 AS scope, l_returnflag AS role, l_quantity AS w, l_discount AS p FROM lineitem), a AS (SELECT scope, sum(w) AS total, {sums}, sum(w * w) / (sum(w) * sum(w)) AS hhi FROM w GROUP BY 1) SELECT scope, round(total, 2) AS total, {outs}, round(hhi, 9) AS hhi FROM a"""


@query(_W.format(sums=", ".join(f"sum(CASE WHEN role = '{r}' THEN w * p ELSE 0 END) / sum(w) AS m_{r}" for r in "ANR"), outs=", ".join(f"round(m_{r}, 6) AS m_{r.lower()}" for r in "ANR") + ", round(m_A - m_N - m_R, 6) + 0.0 AS coupling"))
def weighted_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted masses by role, their coupling (common less own less peer), and the concentration of weights."""
    w = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("scope"), F.col("l_returnflag").alias("role"), F.col("l_quantity").alias("w"), F.col("l_discount").alias("p"))
    a = w.groupBy("scope").agg(F.sum("w").alias("total"), *[(F.sum(F.when(F.col("role") == r, F.col("w") * F.col("p")).otherwise(0.0)) / F.sum("w")).alias(f"m_{r.lower()}") for r in "ANR"], (F.sum(F.col("w") ** 2) / (F.sum("w") * F.sum("w"))).alias("hhi"))
    return a.select("scope", F.round("total", 2).alias("total"), *[F.round(f"m_{r}", 6).alias(f"m_{r}") for r in "anr"], (F.round(F.col("m_a") - F.col("m_n") - F.col("m_r"), 6) + F.lit(0.0)).alias("coupling"), F.round("hhi", 9).alias("hhi"))
