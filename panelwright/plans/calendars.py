"""Session calendars, request windows, extended hours, controls over sessions, slices, batches and subsamples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import table
from .evaluation import PRED, predictions
from .registry import query
from .sessions import GRID, month_grid

# Regular and early closes, as minutes of the day, and the bounds of the extended session.
OPEN, CLOSE, EARLY, PRE, POST, STEP = 570, 960, 780, 240, 1200, 15

DAYS = f"""days AS (SELECT DISTINCT CAST(ts AS DATE) AS day, CASE WHEN dayofweek(ts) = 5 THEN {EARLY} ELSE {CLOSE} END AS close FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekdays of the event stream; Fridays close early. Minutes of the day."""
    day = F.to_date("ts")
    days = table(spark, sf_dir, "events").select(day.alias("day")).distinct().where("weekday(day) < 5")
    return days.withColumn("close", F.when(F.weekday("day") == 4, EARLY).otherwise(CLOSE))


def clock(minutes: Column) -> Column:
    return F.format_string("%02d:%02d:00", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


@query(f"WITH {DAYS} SELECT day, row_number() OVER (ORDER BY day) AS seq, close, (close - {OPEN}) // {STEP} AS n_keys, array_to_string([printf('%02d:%02d:00', m // 60, m % 60) FOR m IN range({OPEN}, close, {STEP})], ' ') AS keys FROM days WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'")
def session_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of an inclusive range with their place, close and the bar starts that are expected."""
    s = sessions(spark, sf_dir).where("day between DATE '2024-01-03' and DATE '2024-01-25'")
    keys = F.transform(F.sequence(F.lit(OPEN), F.col("close") - STEP, F.lit(STEP)), clock)
    return s.select("day", F.row_number().over(Window.orderBy("day")).cast("long").alias("seq"), F.col("close").cast("long").alias("close"), F.size(keys).cast("long").alias("n_keys"), F.array_join(keys, " ").alias("keys"))


@query(f"""WITH {DAYS}, w AS (SELECT day, 'premarket' AS phase, {PRE} AS low, {OPEN} AS high FROM days UNION ALL SELECT day, 'aftermarket', close, {POST} FROM days), e AS (SELECT CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS m, value FROM events)
 SELECT w.day, phase, low, high, count(m) AS n, max(value) AS most FROM w LEFT JOIN e ON e.day = w.day AND m >= low AND m < high GROUP BY 1, 2, 3, 4""")
def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premarket and aftermarket windows of every session, early closes included, and what fell into them."""
    s = sessions(spark, sf_dir)
    one = lambda phase, low, high: F.struct(F.lit(phase).alias("phase"), low.alias("low"), high.alias("high"))
    w = s.select("day", F.explode(F.array(one("premarket", F.lit(PRE), F.lit(OPEN)), one("aftermarket", F.col("close"), F.lit(POST)))).alias("w")).select("day", "w.*")
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("m"), "value")
    j = w.join(e.join(F.broadcast(w), "day").where("m >= low and m < high").groupBy("day", "phase").agg(F.count("*").alias("n"), F.max("value").alias("most")), ["day", "phase"], "left")
    return j.select("day", "phase", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "most")


@query(f"""WITH e AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, first(value ORDER BY ts, event_id) AS open, last(value ORDER BY ts, event_id) AS close, count(*) AS bars, sum(floor(value)) AS volume FROM events WHERE hour(ts) * 60 + minute(ts) >= {CLOSE} OR hour(ts) * 60 + minute(ts) < {OPEN} GROUP BY 1, 2),
 r AS (SELECT *, CASE WHEN count(*) OVER w >= 10 THEN avg(volume) OVER w END AS usual FROM e WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT symbol, day, bars, round(ln(close / open), 6) + 0.0 AS ret, volume, round(volume / usual, 6) AS rel_volume FROM r""")
def extended_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended-hours bars: first open, last close, volume, and volume against the trailing twenty sessions, ten at least."""
    m = F.hour("ts") * 60 + F.minute("ts")
    order = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").where((m >= CLOSE) | (m < OPEN)).groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"))
    e = e.agg(F.min_by("value", order).alias("open"), F.max_by("value", order).alias("close"), F.count("*").alias("bars"), F.sum(F.floor("value")).cast("double").alias("volume"))
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-20, -1)
    usual = F.when(F.count("*").over(w) >= 10, F.avg("volume").over(w))
    return e.withColumn("usual", usual).select("symbol", "day", "bars", (F.round(F.log(F.col("close") / F.col("open")), 6) + F.lit(0.0)).alias("ret"), "volume", F.round(F.col("volume") / F.col("usual"), 6).alias("rel_volume"))


@query(f"""WITH {DAYS}, n AS (SELECT day, close, lead(day) OVER (ORDER BY day) AS next FROM days), a AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, max(value) AS most FROM events e JOIN days d ON CAST(ts AS DATE) = d.day AND hour(ts) * 60 + minute(ts) >= d.close GROUP BY 1, 2)
 SELECT next AS session, event_type, n, most FROM a JOIN n USING (day) WHERE next IS NOT NULL""")
def aftermarket_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened after the close belongs to the next session."""
    s = sessions(spark, sf_dir).withColumn("next", F.lead("day").over(Window.orderBy("day")))
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("m"), "event_type", "value")
    a = e.join(F.broadcast(s), "day").where("m >= close and next is not null")
    return a.groupBy(F.col("next").alias("session"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


@query(f"""WITH {GRID}, c AS (SELECT month, row_number() OVER (ORDER BY month) AS seq FROM (SELECT DISTINCT month FROM grid)), s AS (SELECT DISTINCT year(month) AS fold, month FROM grid WHERE nation = 3 AND n > 0), b AS (SELECT fold, min(seq) AS a, max(seq) + 4 AS z FROM s JOIN c USING (month) GROUP BY 1)
 SELECT fold, month AS session, seq - a AS place FROM b JOIN c ON seq BETWEEN a AND z""")
def evaluation_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fold the sessions from its first signal to the end of the last position, five sessions later in all."""
    g = month_grid(spark, sf_dir)
    c = g.select(F.col("month").alias("session")).distinct().withColumn("seq", F.row_number().over(Window.orderBy("session")).cast("long"))
    s = g.where("nation = 3 and n > 0").select(F.year("month").cast("long").alias("fold"), F.col("month").alias("session"))
    b = s.join(c, "session").groupBy("fold").agg(F.min("seq").alias("a"), F.max("seq").alias("z"))
    lives = b.select("fold", "a", F.explode(F.sequence("a", F.col("z") + 4)).alias("seq"))
    return lives.join(c, "seq").select("fold", "session", (F.col("seq") - F.col("a")).alias("place"))


@query("""SELECT d.doc_id, CAST(l.doc_id IS NOT NULL AS TINYINT) AS has_labels, CAST(l.toxic IS NOT NULL AND l.toxic = 1 AS TINYINT) AS has_toxic, CAST(d.lang IS NOT NULL AS TINYINT) AS has_lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def availability_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small flags of which source has something for a row."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(1).alias("has"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("tinyint")
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return j.select("doc_id", flag(F.col("has").isNotNull()).alias("has_labels"), flag(F.col("toxic") == 1).alias("has_toxic"), flag(F.col("lang").isNotNull()).alias("has_lang"))


@query(f"""WITH {GRID}, s AS (SELECT month, nation, n, lag(n, 20) OVER w AS stale, row_number() OVER w AS k FROM grid WINDOW w AS (PARTITION BY nation ORDER BY month)), r AS (SELECT nation, lead(nation, 1, first_in) OVER (PARTITION BY region ORDER BY nation) AS other FROM (SELECT n_nationkey AS nation, n_regionkey AS region, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS first_in FROM nation))
 SELECT s.month, s.nation, s.n, coalesce(s.stale, 0) AS stale, CAST(s.k > 20 AS INTEGER) AS has_stale, o.n AS wrong_stock FROM s JOIN r USING (nation) JOIN grid o ON o.month = s.month AND o.nation = r.other""")
def control_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control features from the full history: twenty sessions stale with a flag, and another member's of the same sector."""
    g = month_grid(spark, sf_dir).select("month", "nation", "n")
    w = Window.partitionBy("nation").orderBy("month")
    s = g.select("month", "nation", "n", F.coalesce(F.lag("n", 20).over(w), F.lit(0)).alias("stale"), (F.row_number().over(w) > 20).cast("int").alias("has_stale"))
    in_region = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    first = F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))
    other = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.coalesce(F.lead("n_nationkey").over(in_region), first).alias("other"))
    o = g.select("month", F.col("nation").alias("other"), F.col("n").alias("wrong_stock"))
    return s.join(F.broadcast(other), "nation").join(o, ["month", "other"]).drop("other")


@query("""WITH b AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM events), t AS (SELECT DISTINCT event_type AS ticker FROM events), s AS (SELECT ticker, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 7 DAY)) AS low, z FROM t, b)
 SELECT s.ticker, low, least(low + INTERVAL 7 DAY, CAST(z + 1 AS TIMESTAMP)) - INTERVAL 1 MINUTE AS high, count(event_id) AS n FROM s LEFT JOIN events e ON e.event_type = s.ticker AND e.ts >= low AND e.ts < least(low + INTERVAL 7 DAY, CAST(z + 1 AS TIMESTAMP)) GROUP BY s.ticker, low, z""")
def news_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of seven days by ticker with closed minute bounds, the last one cut at the end, and what each returns."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("day"))
    b = e.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    counts = e.crossJoin(F.broadcast(b)).groupBy("ticker", F.floor(F.datediff("day", "a") / 7).alias("k")).agg(F.count("*").alias("n"))
    plan = e.select("ticker").distinct().crossJoin(F.broadcast(b)).select("ticker", "a", "z", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("z", "a") / 7).cast("int"))).alias("k"))
    j = plan.join(counts, ["ticker", "k"], "left")
    low = F.date_add("a", F.col("k") * 7)
    end = F.least(F.date_add("a", F.col("k") * 7 + 7), F.date_add("z", 1))
    return j.select("ticker", low.cast("timestamp_ntz").alias("low"), (end.cast("timestamp_ntz") - F.expr("interval 1 minute")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


_SAMPLES = "(VALUES ('all', 1996), ('all', 1997), ('all', 1998), ('all', 1999), ('all', 2000), ('early', 1996), ('early', 1997), ('late', 1999), ('late', 2000))"


@query(f"""{PRED} SELECT sample, count(*) AS n, round(sqrt(avg(power(actual - predicted, 2))), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae, round(1 - sum(power(actual - predicted, 2)) / nullif(sum(power(actual - persistence, 2)), 0), 6) AS oos_r2 FROM q JOIN {_SAMPLES} s(sample, year) ON fold = year GROUP BY 1""")
def subsample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of named subsets of folds that overlap."""
    f = F.col("fold")
    names = F.array_compact(F.array(F.when(f.between(1996, 2000), "all"), F.when(f.isin(1996, 1997), "early"), F.when(f.isin(1999, 2000), "late")))
    rows = predictions(spark, sf_dir).withColumn("sample", F.explode(names))
    out = rows.groupBy("sample").agg(*M.error_metrics(F.col("actual"), F.col("predicted"), F.col("persistence")))
    return out.select("sample", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "oos_r2")])


@query("""SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 20) AS BIGINT) AS batch, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 20 AS place FROM documents""")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of twenty documents in order of their ids, source by source."""
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long") - 1
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(k / 20).alias("batch"), (k % 20).alias("place"))


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice) / 100, 1) AS market FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) / 100.0 AS momentum FROM orders WHERE o_orderpriority LIKE '2%' GROUP BY 1)
 SELECT coalesce(a.day, b.day) AS day, CAST(a.day IS NOT NULL AS INTEGER) AS has_market, momentum FROM a FULL JOIN b ON a.day = b.day WHERE coalesce(a.day, b.day) BETWEEN DATE '1995-06-01' AND DATE '2000-12-31'""")
def merged_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factor series merged by date, either one missing, within a range; percent become shares."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    a = o.where("o_orderstatus = 'P'").groupBy("day").agg(F.lit(1).alias("m"))
    b = o.where("o_orderpriority like '2%'").groupBy("day").agg((F.count("*") / 100.0).alias("momentum"))
    j = a.join(b, "day", "full").where("day between DATE '1995-06-01' and DATE '2000-12-31'")
    return j.select("day", F.coalesce("m", F.lit(0)).alias("has_market"), "momentum")


@query("""WITH t AS (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS et FROM events) SELECT event_id, CAST(et AS DATE) AS release_date, strftime(et, '%H:%M') AS release_time, CAST(hour(et) * 60 + minute(et) < 570 AS INTEGER) AS before_open FROM t""")
def release_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release instants in local time, and whether they come before the open."""
    et = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    return table(spark, sf_dir, "events").select("event_id", F.to_date(et).alias("release_date"), F.date_format(et, "HH:mm").alias("release_time"), (F.hour(et) * 60 + F.minute(et) < OPEN).cast("int").alias("before_open"))


@query("""WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id, strlen(html) AS n FROM pages) SELECT host, count(*) AS files, min(page_id) AS first, max(page_id) AS last, CAST(sum(n) AS BIGINT) AS bytes, max(n) AS largest FROM p GROUP BY 1""")
def query_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of collected files by the name that their path tells."""
    n = F.octet_length("html").cast("long")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("files"), F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.sum(n).alias("bytes"), F.max(n).alias("largest"))
