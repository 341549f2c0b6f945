"""Metrics, gates, resampling, portfolio construction and backtest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import table
from .registry import query
from .sessions import GRID, month_grid

PRED = f"""WITH {GRID}, p AS (SELECT month, nation, year(month) AS fold, ln(1 + n) AS actual, ln(1 + lag(n) OVER w) AS persistence, avg(ln(1 + n)) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS predicted FROM grid WINDOW w AS (PARTITION BY nation ORDER BY month)),
 q AS (SELECT * FROM p WHERE persistence IS NOT NULL AND predicted IS NOT NULL)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel of actual values, a trailing mean as prediction, and persistence, by yearly fold."""
    w = Window.partitionBy("nation").orderBy("month")
    p = month_grid(spark, sf_dir).select("month", "nation", F.year("month").cast("long").alias("fold"), F.log1p("n").alias("actual"), F.log1p(F.lag("n").over(w)).alias("persistence"), F.avg(F.log1p("n")).over(w.rowsBetween(-6, -1)).alias("predicted"))
    return p.where("persistence is not null and predicted is not null")


_OUT = "count(*) AS n, round(sqrt(avg(power(actual - predicted, 2))), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae, round(1 - sum(power(actual - predicted, 2)) / nullif(sum(power(actual - persistence, 2)), 0), 6) AS oos_r2"


@query(f"{PRED} SELECT fold, nation, {_OUT} FROM q GROUP BY GROUPING SETS ((fold), (nation), ())")
def summarize_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE, MAE and R2 against persistence, by fold, by entity and pooled, in one pass of grouping sets."""
    p = predictions(spark, sf_dir)
    out = p.groupingSets([[F.col("fold")], [F.col("nation")], []], F.col("fold"), F.col("nation")).agg(*M.error_metrics(F.col("actual"), F.col("predicted"), F.col("persistence")))
    return out.select("fold", "nation", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "oos_r2")])


@query(f"""{PRED}, l AS (SELECT fold, month, sum(power(actual - predicted, 2)) AS a, sum(power(actual - persistence, 2)) AS b, count(*) AS k FROM q GROUP BY 1, 2) SELECT fold, count(*) AS dates, CAST(sum(CASE WHEN a < b THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(sum(b - a) / sum(b), 6) + 0.0 AS improvement, CAST(bool_and(k = 25) AS INTEGER) AS whole FROM l GROUP BY 1""")
def paired_date_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    loss = p.groupBy("fold", "month").agg(F.sum((F.col("actual") - F.col("predicted")) ** 2).alias("a"), F.sum((F.col("actual") - F.col("persistence")) ** 2).alias("b"), F.count("*").alias("k"))
    return loss.groupBy("fold").agg(F.count("*").alias("dates"), F.count_if(F.col("a") < F.col("b")).alias("wins"), (F.round(F.sum(F.col("b") - F.col("a")) / F.sum("b"), 6) + F.lit(0.0)).alias("improvement"), F.bool_and(F.col("k") == 25).cast("int").alias("whole"))


@query(f"""{PRED}, s AS (SELECT nation, fold, 1 - sum(power(actual - predicted, 2)) / nullif(sum(power(actual - persistence, 2)), 0) AS r2 FROM q GROUP BY 1, 2) SELECT nation, arg_max(fold, row(r2, -fold)) AS best_fold, CAST(count(*) FILTER (WHERE r2 > 0) AS BIGINT) AS better, CAST(count(*) FILTER (WHERE r2 > 0) >= 2 AS INTEGER) AS gate FROM s WHERE r2 IS NOT NULL GROUP BY 1""")
def best_model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target the fold of the best score (ties: the first), how many improve, and the gate of two."""
    r2 = F.try_divide(F.sum((F.col("actual") - F.col("persistence")) ** 2) - F.sum((F.col("actual") - F.col("predicted")) ** 2), F.sum((F.col("actual") - F.col("persistence")) ** 2))
    s = predictions(spark, sf_dir).groupBy("nation", "fold").agg(r2.alias("r2")).where("r2 is not null")
    better = F.count_if(F.col("r2") > 0)
    return s.groupBy("nation").agg(F.max_by("fold", F.struct("r2", (-F.col("fold")).alias("f"))).alias("best_fold"), better.alias("better"), (better >= 2).cast("int").alias("gate"))


GUESS = "g AS (SELECT l.doc_id, quality AS truth, CASE WHEN regexp_matches(text, '[#$%&*|]{1}') THEN 0 ELSE 1 END AS guess FROM labels l JOIN documents d USING (doc_id))"


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").rlike("[#$%&*|]"), 0).otherwise(1).alias("guess"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"), "toxic").join(d, "doc_id")


@query(f"""WITH {GUESS}, c AS (SELECT truth, guess, count(*) AS k FROM g GROUP BY 1, 2), t AS (SELECT truth AS c, sum(k) AS t, sum(CASE WHEN truth = guess THEN k ELSE 0 END) AS hit FROM c GROUP BY 1), u AS (SELECT guess AS c, sum(k) AS g FROM c GROUP BY 1),
 b AS (SELECT coalesce(t, 0) AS t, coalesce(hit, 0) AS hit, coalesce(g, 0) AS g FROM t FULL JOIN u ON t.c = u.c), s AS (SELECT CAST(sum(t) AS BIGINT) AS n, sum(hit) / sum(t) AS a, max(t) / sum(t) AS m, sum(t * g) / (sum(t) * sum(t)) AS e, avg(CASE WHEN t > 0 THEN 2.0 * hit / (t + g) END) AS f FROM b)
 SELECT n, round(a, 6) AS accuracy, round(m, 6) AS majority, round((a - e) / nullif(1 - e, 0), 6) AS kappa, round(f, 6) AS macro_f1 FROM s""")
def closed_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.label_metrics(_guesses(spark, sf_dir), "truth", "guess")
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "majority", "kappa", "macro_f1")])


@query("""WITH s AS (SELECT p_partkey, list_distinct([p_brand, p_type, p_name]) AS a, list_distinct([p_brand, 'x', p_type]) AS b FROM part), k AS (SELECT len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM s)
 SELECT round(sum(i) / sum(nb), 6) AS precision, round(sum(i) / sum(na), 6) AS recall, round(2.0 * sum(i) / (sum(na) + sum(nb)), 6) AS f1, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE i / u END), 6) AS jaccard, round(avg(CASE WHEN i = u THEN 1.0 ELSE 0.0 END), 6) AS exact FROM k""")
def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro precision, recall and F1, mean Jaccard and exact share of label sets."""
    a, b = F.array_distinct(F.array("p_brand", "p_type", "p_name")), F.array_distinct(F.array("p_brand", F.lit("x"), "p_type"))
    k = table(spark, sf_dir, "part").select(F.size(a).alias("na"), F.size(b).alias("nb"), F.size(F.array_intersect(a, b)).alias("i"), F.size(F.array_union(a, b)).alias("u"))
    return k.agg(F.round(F.sum("i") / F.sum("nb"), 6).alias("precision"), F.round(F.sum("i") / F.sum("na"), 6).alias("recall"), F.round(2 * F.sum("i") / (F.sum("na") + F.sum("nb")), 6).alias("f1"), F.round(F.avg(F.when(F.col("u") == 0, 1.0).otherwise(F.try_divide("i", "u"))), 6).alias("jaccard"), F.round(F.avg((F.col("i") == F.col("u")).cast("double")), 6).alias("exact"))


@query(f"""WITH {GUESS}, d AS (SELECT count(*) FILTER (WHERE truth = guess AND truth <> 1) AS b, count(*) FILTER (WHERE truth <> guess AND truth = 1) AS c FROM g) SELECT b AS only_rule, c AS only_majority, round(power(abs(b - c) - 1, 2) / greatest(b + c, 1), 6) AS chi2 FROM d""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discordant pairs of a rule and the majority label, and their corrected chi-squared."""
    right, base = F.col("truth") == F.col("guess"), F.col("truth") == 1
    d = _guesses(spark, sf_dir).agg(F.count_if(right & ~base).alias("b"), F.count_if(~right & base).alias("c"))
    return d.select(F.col("b").alias("only_rule"), F.col("c").alias("only_majority"), F.round((F.abs(F.col("b") - F.col("c")) - 1) ** 2 / F.greatest(F.col("b") + F.col("c"), F.lit(1)), 6).alias("chi2"))


STRAT = f"""WITH {GRID}, x AS (SELECT month, k.n_regionkey AS sector, nation, ln(1 + n) AS v, ln(1 + n) - ln(1 + lag(n) OVER w) AS s FROM grid JOIN nation k ON nation = n_nationkey WINDOW w AS (PARTITION BY nation ORDER BY month)),
 d AS (SELECT *, s - avg(s) OVER (PARTITION BY month, sector) AS c FROM x WHERE s IS NOT NULL), wt AS (SELECT *, c / nullif(sum(abs(c)) OVER (PARTITION BY month, sector), 0) / 5 AS w FROM d)"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector-demeaned signals, gross-normalised within sectors; five sectors share the book."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("sector"))
    w = Window.partitionBy("nation").orderBy("month")
    sector = Window.partitionBy("month", "sector")
    x = month_grid(spark, sf_dir).join(F.broadcast(nations), "nation").select("month", "sector", "nation", F.log1p("n").alias("v"), (F.log1p("n") - F.log1p(F.lag("n").over(w))).alias("s")).where("s is not null")
    d = x.withColumn("c", F.col("s") - F.avg("s").over(sector))
    return d.withColumn("w", F.col("c") / F.nullif(F.sum(F.abs("c")).over(sector), F.lit(0.0)) / 5)


@query(f"{STRAT} SELECT month, sector, nation, round(w, 6) + 0.0 AS weight FROM wt")
def sleeve_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).select("month", "sector", "nation", (F.round("w", 6) + F.lit(0.0)).alias("weight"))


SLEEVES = f"""{STRAT}, cal AS (SELECT month, row_number() OVER (ORDER BY month) AS seq FROM (SELECT DISTINCT month FROM grid)), pos AS (SELECT h.month AS day, nation, sum(w) / 3 AS w FROM wt JOIN cal c ON c.month = wt.month JOIN cal h ON h.seq BETWEEN c.seq + 1 AND c.seq + 3 GROUP BY 1, 2)"""


def positions(spark: SparkSession, sf_dir: str, hold: int = 3) -> DataFrame:
    """Each position lives `hold` sessions at one part in `hold`; overlapping ones are netted."""
    wt = weights(spark, sf_dir).select("month", "nation", "w")
    cal = month_grid(spark, sf_dir).select("month").distinct().withColumn("seq", F.row_number().over(Window.orderBy("month")))
    spread = wt.join(cal, "month").withColumn("seq", F.explode(F.sequence(F.col("seq") + 1, F.col("seq") + hold)))
    return spread.join(cal.select("seq", F.col("month").alias("day")), "seq").groupBy("day", "nation").agg((F.sum("w") / hold).alias("w"))


@query(f"{SLEEVES} SELECT day, nation, round(w, 6) + 0.0 AS weight FROM pos")
def sleeve_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("day", "nation", (F.round("w", 6) + F.lit(0.0)).alias("weight"))


DAILY = f"""{SLEEVES}, r AS (SELECT month AS day, nation, 0.01 * (ln(1 + n) - ln(1 + lag(n) OVER w)) AS r FROM grid WINDOW w AS (PARTITION BY nation ORDER BY month)),
 g AS (SELECT p.day, sum(w * coalesce(r, 0)) AS gross, sum(abs(w)) AS size FROM pos p LEFT JOIN r USING (day, nation) GROUP BY 1),
 net AS (SELECT c.month AS day, b.bps, coalesce(gross, 0) - 2 * coalesce(size, 0) * b.bps / 10000.0 AS r FROM cal c CROSS JOIN (VALUES (0), (2), (5)) b(bps) LEFT JOIN g ON g.day = c.month)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy returns on the dense calendar at several costs (in hundredths of a percent of gross, both ways)."""
    w = Window.partitionBy("nation").orderBy("month")
    r = month_grid(spark, sf_dir).select(F.col("month").alias("day"), "nation", (0.01 * (F.log1p("n") - F.log1p(F.lag("n").over(w)))).alias("r"))
    g = positions(spark, sf_dir).join(r, ["day", "nation"], "left").groupBy("day").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("gross"), F.sum(F.abs("w")).alias("size"))
    days = month_grid(spark, sf_dir).select(F.col("month").alias("day")).distinct().join(g, "day", "left").fillna(0.0, ["gross", "size"])
    return days.select("day", F.explode(F.array(F.lit(0), F.lit(2), F.lit(5))).alias("bps"), "gross", "size").withColumn("r", F.col("gross") - 2 * F.col("size") * F.col("bps") / 10000.0)


@query(f"{DAILY} SELECT day, bps, round(r, 9) + 0.0 AS r FROM net")
def daily_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("day", "bps", (F.round("r", 9) + F.lit(0.0)).alias("r"))


@query(f"""{DAILY}, v AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY bps ORDER BY day)) AS wealth FROM net), dd AS (SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY bps ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM v)
 SELECT bps, year(day) AS fold, count(*) AS n, round(avg(r) * 12, 6) + 0.0 AS mean, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12), 4) + 0.0 AS sharpe, round(exp(sum(ln(1 + r))) - 1, 6) + 0.0 AS compounded, round(min(dd), 6) + 0.0 AS drawdown, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS hits FROM dd GROUP BY GROUPING SETS ((bps), (bps, year(day)))""")
def performance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("bps").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    v = daily(spark, sf_dir).withColumn("wealth", F.exp(F.sum(F.log1p("r")).over(w)))
    x = v.withColumn("dd", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w)) - 1).withColumn("fold", F.year("day").cast("long"))
    z = F.lit(0.0)
    return x.groupingSets([[F.col("bps")], [F.col("bps"), F.col("fold")]], F.col("bps"), F.col("fold")).agg(
        F.count("*").alias("n"), (F.round(F.avg("r") * 12, 6) + z).alias("mean"), (F.round(F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0)) * F.sqrt(F.lit(12.0)), 4) + z).alias("sharpe"),
        (F.round(F.exp(F.sum(F.log1p("r"))) - 1, 6) + z).alias("compounded"), (F.round(F.min("dd"), 6) + z).alias("drawdown"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("hits"))


@query(f"""{DAILY}, u AS (SELECT bps, day, r, r - avg(r) OVER (PARTITION BY bps) AS u FROM net), l AS (SELECT *, u * lag(u, 1) OVER w AS u1, u * lag(u, 2) OVER w AS u2 FROM u WINDOW w AS (PARTITION BY bps ORDER BY day)), s AS (SELECT bps, count(*) AS n, avg(r) AS m, (sum(u * u) + 2 * (2.0 / 3) * sum(u1) + 2 * (1.0 / 3) * sum(u2)) / count(*) AS v FROM l GROUP BY 1) SELECT bps, n, round(m, 9) + 0.0 AS mean, round(CASE WHEN v > 0 THEN m / sqrt(v / n) END, 4) + 0.0 AS t_stat FROM s""")
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.newey_west(daily(spark, sf_dir), ["bps"], "day", "r", 2)
    return t.select("bps", "n", (F.round("mean", 9) + F.lit(0.0)).alias("mean"), (F.round("t_stat", 4) + F.lit(0.0)).alias("t_stat"))


@query(f"""{DAILY}, dr AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, r, count(*) OVER () AS n FROM net WHERE bps = 2), draws AS (SELECT b.s AS sample, k.k AS block, CAST('0x' || substr(sha256(b.s || ':' || k.k), 1, 12) AS BIGINT) AS h FROM range(200) b(s), range(8) k(k)),
 j AS (SELECT sample, avg(r) AS m FROM draws, (SELECT unnest(range(10)) AS o), dr WHERE dr.i = h % (n - 9) + o GROUP BY 1) SELECT sample, round(m, 9) + 0.0 AS mean FROM j""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 moving-block resamples (8 blocks of 10 sessions) whose starts are drawn by a hash, so any engine draws them."""
    d = daily(spark, sf_dir).where("bps = 2").withColumn("i", (F.row_number().over(Window.orderBy("day")) - 1).cast("long")).select("i", "r")
    n = d.agg(F.count("*").alias("n"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("sample").cast("string"), F.col("block").cast("string")), 256), 1, 12), 16, 10).cast("long")
    draws = spark.range(200).withColumnRenamed("id", "sample").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("h", h).crossJoin(F.broadcast(n))
    picked = draws.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("i", F.col("h") % (F.col("n") - 9) + F.col("o"))
    return picked.join(d, "i").groupBy("sample").agg((F.round(F.avg("r"), 9) + F.lit(0.0)).alias("mean"))
