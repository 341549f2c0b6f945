"""Collection, window, view and reducer queries over timestamped items."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""WITH s AS (SELECT r_name AS symbol FROM region), y AS (SELECT unnest(generate_series(1995, 2001)) AS y) SELECT symbol, make_date(y, 1, 1) AS first, least(make_date(y, 12, 31), DATE '2001-08-01') AS last FROM s CROSS JOIN y""")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by inclusive calendar years, the last one cut at the end date."""
    years = F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-08-01").cast("date"), F.expr("interval 1 year")))
    plan = table(spark, sf_dir, "region").select(F.col("r_name").alias("symbol"), years.alias("first"))
    return plan.select("symbol", "first", F.least(F.date_sub(F.add_months("first", 12), 1), F.lit("2001-08-01").cast("date")).alias("last"))


@query("""SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS TIMESTAMP) AS local_time, CASE WHEN hour(timezone('America/New_York', timezone('UTC', ts))) * 60 + minute(ts) >= 570 AND hour(timezone('America/New_York', timezone('UTC', ts))) < 16 THEN 'regular' WHEN hour(timezone('America/New_York', timezone('UTC', ts))) BETWEEN 4 AND 9 THEN 'premarket' WHEN hour(timezone('America/New_York', timezone('UTC', ts))) BETWEEN 16 AND 19 THEN 'aftermarket' ELSE 'closed' END AS phase FROM events""")
def market_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants to local time (with daylight saving) and the phase of the trading day."""
    t = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    h, m = F.hour(t), F.hour(t) * 60 + F.minute(t)
    phase = F.when((m >= 570) & (h < 16), "regular").when(h.between(4, 9), "premarket").when(h.between(16, 19), "aftermarket").otherwise("closed")
    return events(spark, sf_dir).select("event_id", t.cast("timestamp_ntz").alias("local_time"), phase.alias("phase"))


@query("""SELECT event_id, ts AS published, CASE WHEN ts = date_trunc('day', ts) OR event_id % 7 = 0 THEN CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) ELSE date_trunc('second', ts) END AS available FROM events""")
def conservative_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items known by their date alone are available the next day; others at their second."""
    date_only = (F.col("ts") == F.date_trunc("day", "ts").cast("timestamp_ntz")) | (F.col("event_id") % 7 == 0)
    return events(spark, sf_dir).select("event_id", F.col("ts").alias("published"), F.when(date_only, F.date_add(F.to_date("ts"), 1).cast("timestamp_ntz")).otherwise(F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("available"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, count(*) AS days, min(n) AS least, CAST(bool_and(n >= 5) AS INTEGER) AS complete FROM d GROUP BY 1) SELECT event_type, days, least, complete, CAST(days = (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AS INTEGER) AS covers FROM t""")
def assess_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each target was collected on every day, and with enough items."""
    d = events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    t = d.groupBy("event_type").agg(F.count("*").alias("days"), F.min("n").alias("least"), F.bool_and(F.col("n") >= 5).cast("int").alias("complete"))
    whole = d.agg(F.countDistinct("day").alias("all_days"))
    return t.crossJoin(F.broadcast(whole)).select("event_type", "days", "least", "complete", (F.col("days") == F.col("all_days")).cast("int").alias("covers"))


@query("""SELECT count(*) AS rows, count(DISTINCT md5(text)) AS documents, round(1 - count(DISTINCT md5(text)) / count(*), 6) AS duplicate_share, count(DISTINCT source) AS sources, min(n_chars) AS shortest, max(n_chars) AS longest, quantile_cont(n_chars, 0.5) AS middle FROM documents""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, u = F.count("*"), F.countDistinct(F.md5("text"))
    return table(spark, sf_dir, "documents").agg(n.alias("rows"), u.alias("documents"), F.round(1 - u / n, 6).alias("duplicate_share"), F.countDistinct("source").alias("sources"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.percentile("n_chars", 0.5).alias("middle"))


_VIEWS = """WITH v AS (SELECT user_id, event_type, CASE WHEN hour(ts) < 12 THEN 'a' ELSE 'b' END AS view, round(avg(value) / 50) AS label FROM events GROUP BY 1, 2, 3), p AS (SELECT user_id, event_type, max(CASE WHEN view = 'a' THEN label END) AS a, max(CASE WHEN view = 'b' THEN label END) AS b FROM v GROUP BY 1, 2)
 SELECT event_type, count(*) AS items, count(*) FILTER (WHERE a = b) AS agreed, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS single, round(avg(CASE WHEN a = b THEN 1.0 WHEN a IS NULL OR b IS NULL THEN NULL ELSE 0.0 END), 6) AS agreement FROM p GROUP BY 1"""


def rounded_mean(value: Column, unit: int) -> Column:
    """The mean in units, rounded half away from zero, by an exact sum: of doubles the order of addition decides ties.

    Values that six decimals don't give back exactly are averaged as doubles.
    """
    exact = value.try_cast("decimal(18,6)")
    whole = F.bool_and(F.coalesce(exact.cast("double") == value, value.isNull()))
    total, n = F.sum(exact), F.count(value)
    halves = F.abs(total) + F.abs(total) + n * unit
    return F.when(n > 0, F.when(whole, F.signum(total) * F.call_function("div", halves, n * (2 * unit))).otherwise(F.round(F.avg(value) / unit)))


@query(_VIEWS)
def adjudicate_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of an item side by side: how often their labels agree."""
    v = events(spark, sf_dir).groupBy("user_id", "event_type", F.when(F.hour("ts") < 12, "a").otherwise("b").alias("view")).agg(rounded_mean(F.col("value"), 50).alias("label"))
    p = v.groupBy("user_id", "event_type").pivot("view", ["a", "b"]).agg(F.max("label"))
    same, single = F.col("a") == F.col("b"), F.col("a").isNull() | F.col("b").isNull()
    return p.groupBy("event_type").agg(F.count("*").alias("items"), F.count_if(same).alias("agreed"), F.count_if(single).alias("single"), F.round(F.avg(F.when(~single, same.cast("double"))), 6).alias("agreement"))


_REDUCE = """WITH s AS (SELECT conv_id, role, length(coalesce(text, '')) AS score FROM conversations), l AS (SELECT conv_id, role, avg(score) AS m, max(score) AS x, count(*) AS k FROM s GROUP BY 1, 2)
 SELECT conv_id, arg_max(role, row(m, role)) AS by_mean, arg_max(role, row(x, role)) AS by_max, arg_max(role, row(k, role)) AS by_count FROM l GROUP BY 1"""


@query(_REDUCE)
def reduce_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to one label per whole by mean score, largest score, or number of parts; ties go to the later name."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", "role", F.length(F.coalesce("text", F.lit(""))).alias("score"))
    l = parts.groupBy("conv_id", "role").agg(F.avg("score").alias("m"), F.max("score").alias("x"), F.count("*").alias("k"))  # noqa: E741
    return l.groupBy("conv_id").agg(*[F.max_by("role", F.struct(c, "role")).alias(n) for n, c in (("by_mean", "m"), ("by_max", "x"), ("by_count", "k"))])


@query("""WITH a AS (SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)), p AS (SELECT lang, (sum(quality) + 1.0) / (count(*) + 2.0) AS prior FROM a GROUP BY 1) SELECT lang, round(prior, 6) AS prior, round(ln(prior / (1 - prior)), 6) + 0.0 AS log_odds FROM p""")
def class_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    p = a.groupBy("lang").agg(((F.sum("quality") + 1.0) / (F.count("*") + 2.0)).alias("prior"))
    return p.select("lang", F.round("prior", 6).alias("prior"), (F.round(F.log(F.col("prior") / (1 - F.col("prior"))), 6) + F.lit(0.0)).alias("log_odds"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
 SELECT user_id, CAST(n AS BIGINT) AS session, min(ts) AS starts, max(ts) AS ends, count(*) AS events FROM s GROUP BY 1, 2""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, ended by two quiet hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    g = events(spark, sf_dir).select("user_id", "ts", "event_id", F.when(gap.isNull() | (gap > F.expr("interval '2' hour")), 1).otherwise(0).alias("opens"))
    s = g.withColumn("session", F.sum("opens").over(w))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("starts"), F.max("ts").alias("ends"), F.count("*").alias("events"))


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, h AS slot, n, CAST(n > 6 AS INTEGER) AS split, CASE WHEN n > 6 THEN h + INTERVAL 30 MINUTE END AS bisect FROM h""")
def result_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices that reach the result ceiling, and where they are to be cut in two."""
    slot = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    h = events(spark, sf_dir).groupBy("event_type", slot.alias("slot")).agg(F.count("*").alias("n"))
    return h.select("event_type", "slot", "n", (F.col("n") > 6).cast("int").alias("split"), F.when(F.col("n") > 6, F.col("slot") + F.expr("interval 30 minutes")).alias("bisect"))


#: Bytes of a passage's anchor, at most; a power of two.
ANCHOR = 64
_FACTOR = 0x9E3779B97F4A7C15


def _rolled(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of all runs of n bytes) for n = 1, 2, 4, ... up to ANCHOR, each from two halves of the one before."""
    h, n, factor = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), 1, _FACTOR
    while n <= ANCHOR and len(h):
        yield n, h
        h = h[:-n] * np.uint64(factor) + h[n:]
        n, factor = 2 * n, factor * factor % (1 << 64)


class Passages:
    """Finds which of many passages stand verbatim in a text: hashes of their first bytes propose, a whole comparison decides."""

    def __init__(self, passages: list[str]) -> None:
        self.everywhere = [p for p in passages if not p]
        self.anchored: dict[int, dict[int, list[tuple[str, bytes]]]] = defaultdict(lambda: defaultdict(list))
        for p in filter(None, passages):
            raw = p.encode()
            n = min(ANCHOR, 1 << len(raw).bit_length() - 1)
            self.anchored[n][int(dict(_rolled(raw[:n]))[n][0])].append((p, raw))
        self.marked = {n: np.zeros(1 << 16, bool) for n in self.anchored}
        for n, own in self.anchored.items():
            self.marked[n][[h >> 48 for h in own]] = True

    def found(self, text: str, known: set[str]) -> set[str]:
        """The passages in `text` that aren't in `known`."""
        raw = text.encode()
        out = set(self.everywhere) - known
        for n, h in _rolled(raw):
            if n not in self.anchored:
                continue
            for value in np.unique(h[self.marked[n][h >> np.uint64(48)]]).tolist():
                out.update(p for p, own in self.anchored[n].get(value, ()) if p not in known and own in raw)
        return out


@query("""SELECT item_id, length(text) AS chars, CAST(EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS INTEGER) AS verbatim FROM benchmark b""")
def verbatim_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a passage stands verbatim anywhere in some document, also within a line or across lines.

    Documents are read once, without a shuffle; each worker holds the distinct passages.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", F.md5("text").alias("k"), F.length("text").cast("long").alias("chars"), "text")
    shared = spark.sparkContext.broadcast([r.text for r in b.where("text IS NOT NULL").select("text").distinct().collect()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, known = Passages(shared.value), set()
        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid:
                    known |= passages.found(text.as_py(), known)
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(p.encode()).hexdigest() for p in known], pa.string())], ["k"])

    hits = table(spark, sf_dir, "documents").select("text").mapInArrow(search, "k string").distinct().withColumn("hit", F.lit(1))
    return b.join(hits, "k", "left").select("item_id", "chars", F.coalesce("hit", F.lit(0)).alias("verbatim"))
