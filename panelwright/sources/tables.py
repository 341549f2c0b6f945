"""Scans: star-schema tables by name, and staged files with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, timestamp_utc timestamp, trade_date date, bar_start_et string, open double, high double, low double, close double, volume double"
ARTICLE_SCHEMA = "id string, publisher struct<name:string,homepage_url:string>, title string, published_utc string, article_url string, tickers array<string>, keywords array<string>, description string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Bar files (CSV, gzip or not) with their explicit schema. A missing key or a non-positive price rejects the file."""
    bars = spark.read.schema(BAR_SCHEMA).option("mode", "FAILFAST").csv(paths, header=True)
    good = F.col("symbol").isNotNull() & F.col("timestamp_utc").isNotNull() & (F.col("open") > 0) & (F.col("close") > 0)
    reason = F.concat(F.lit("bad bar in "), F.input_file_name())
    return bars.withColumn("symbol", F.when(F.coalesce(good, F.lit(False)), F.col("symbol")).otherwise(F.raise_error(reason).cast("string")))


def read_pages(spark: SparkSession, path: str, field: str = "results") -> DataFrame:
    """Vendor pages: one JSON object a file with an array of articles, one row an article with its file."""
    pages = spark.read.schema(f"{field} array<struct<{ARTICLE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return pages.select(F.input_file_name().alias("page"), F.explode(field).alias("a")).select("page", "a.*")


def read_missing_dots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Series files whose missing values are a dot."""
    return spark.read.schema(schema).csv(path, header=True, nullValue=".")


def unique_bars(bars: DataFrame) -> DataFrame:
    """Fails on a repeated (symbol, timestamp) when its rows are computed."""
    one = F.when(F.count("*") == 1, F.first("open")).otherwise(F.raise_error(F.lit("repeated bar")).cast("double"))
    return bars.groupBy("symbol", "timestamp_utc").agg(one.alias("open"), F.first("close").alias("close"))


def complete_chunks(spark: SparkSession, manifests: str) -> DataFrame:
    """(path, status, sha256) of chunks whose manifest says complete; a file that isn't what its hash says fails the read."""
    named = spark.read.schema("path string, status string, sha256 string").json(manifests).where("status = 'complete'").distinct()
    paths = [r.path for r in named.select("path").distinct().toLocalIterator()]  # file names, not rows
    if not paths:
        return named
    found = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("p"), F.sha2("content", 256).alias("actual"))
    j = named.join(found, F.regexp_replace("path", "^[a-z0-9]+:/*", "/") == F.col("p"), "left")
    same = F.when(F.col("actual") == F.col("sha256"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("hash differs: "), F.col("path"))).cast("string"))
    return j.select("path", "status", same.alias("sha256"))


RECORD_SUFFIXES = ("json", "jsonl", "ndjson", "json.gz", "jsonl.gz", "ndjson.gz")


def read_records(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON lines below a root, at any depth, gzipped or not, with the file that each record comes from."""
    pattern = "*.{" + ",".join(RECORD_SUFFIXES) + "}"
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.json(root).withColumn("file", F.input_file_name())


def read_payloads(spark: SparkSession, root: str, schema: str, keys: tuple[str, ...] = ("results", "feed", "data", "records", "articles")) -> DataFrame:
    """Records out of whole JSON files: a list, or the first known key that holds one, also a level below; else the file itself."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    raw = F.col("value")
    places = [f"$.{k}" for k in keys] + [f"$.{a}.{b}" for a in keys for b in keys]
    lists = [F.when(F.startswith(F.ltrim(raw), F.lit("[")), raw), *[F.when(F.startswith(v, F.lit("[")), v) for v in (F.get_json_object(raw, p) for p in places)]]
    found = F.coalesce(*lists, F.concat(F.lit("["), raw, F.lit("]")))
    records = F.from_json(found, f"array<struct<{schema}>>")
    return text.select(F.input_file_name().alias("file"), F.explode(records).alias("r")).select("file", "r.*")


def whole_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of an append-only journal; a last line that was torn off while it was written is passed over, others fail."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    parts = F.split("value", "\n")
    ended = F.slice(parts, F.lit(1), F.size(parts) - 1)  # what follows the last line feed is torn, or empty
    rows = lines.select("file", F.explode(ended).alias("line")).where("line <> ''")
    return rows.select("file", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "r.*")


def read_factor_archives(spark: SparkSession, path: str) -> DataFrame:
    """(date, name, value) of zipped factor files: text before the header is skipped, percent become shares, -99.99 is missing."""

    def rows(batches):
        import csv
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            out = []
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        header = None
                        for line in csv.reader(io.StringIO(z.read(member).decode("latin-1"))):
                            cells = [c.strip() for c in line]
                            if header is None:
                                header = cells if len(cells) > 1 and not cells[0] and all(cells[1:]) else None
                            elif len(cells) == len(header) and cells[0].isdigit() and len(cells[0]) == 8:
                                day = pd.Timestamp(cells[0]).date()
                                out += [(day, n, None if float(v) <= -99.99 else float(v) / 100) for n, v in zip(header[1:], cells[1:], strict=True)]
                            else:
                                break
            yield pd.DataFrame(out, columns=["date", "name", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "date date, name string, value double")


def read_release_table(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(release, date, time) of an HTML calendar's table rows whose release is one of those wanted."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))
    found = rows.select(cells.alias("c")).where("size(c) >= 3").select(F.col("c")[2].alias("release"), F.try_to_date(F.regexp_extract(F.col("c")[0], r"([A-Z][a-z]+ \d{1,2}, \d{4})", 1), "MMMM d, y").alias("date"), F.col("c")[1].alias("time"))
    return found.where(F.col("date").isNotNull() & F.exists(F.array(*map(F.lit, wanted)), lambda w: F.contains(F.col("release"), w)))


def read_meeting_headings(spark: SparkSession, path: str) -> DataFrame:
    """(year, first, last) of meetings under year headings of an HTML page; a range of days may cross a month."""
    text = spark.read.text(path, wholetext=True)
    years = F.regexp_extract_all("value", F.lit(r"(?is)(<h[1-6][^>]*>\s*(?:<[^>]*>)*\s*\d{4}\b.*?)(?=<h[1-6][^>]*>\s*(?:<[^>]*>)*\s*\d{4}\b|\z)"), F.lit(1))
    sections = text.select(F.explode(years).alias("s")).select(F.regexp_extract("s", r"(\d{4})", 1).cast("int").alias("year"), F.regexp_replace("s", "<[^>]*>", " ").alias("s"))
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    m = sections.select("year", F.explode(F.regexp_extract_all("s", F.lit(rf"((?:{months})(?:/(?:{months}))?\s+\d{{1,2}}(?:\s*-\s*\d{{1,2}})?)"), F.lit(1))).alias("m"))
    names, days = F.regexp_extract_all("m", F.lit(f"({months})"), F.lit(1)), F.regexp_extract_all("m", F.lit(r"(\d{1,2})"), F.lit(1))
    day = lambda which: F.try_to_date(F.concat_ws(" ", F.element_at(names, which), F.element_at(days, which), F.col("year").cast("string")), "MMMM d y")
    return m.select("year", day(1).alias("first"), day(-1).alias("last"))


def read_bucket_listing(spark: SparkSession, path: str) -> DataFrame:
    """(key, bytes) of the objects in XML listings of a bucket."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<Contents>(.*?)</Contents>"), F.lit(1))).alias("c"))
    return items.select(F.regexp_extract("c", r"<Key>(.*?)</Key>", 1).alias("key"), F.regexp_extract("c", r"<Size>(\d+)</Size>", 1).cast("long").alias("bytes"))


def read_earnings(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """(symbol, fiscal_end, reported, surprise, timing_known) of quarterly earnings reported within a range."""
    schema = "symbol string, quarterlyEarnings array<struct<fiscalDateEnding:string,reportedDate:string,surprise:string,reportTime:string>>"
    q = spark.read.schema(schema).option("multiLine", True).json(path).select("symbol", F.explode("quarterlyEarnings").alias("q")).select("symbol", "q.*")
    day = F.to_date("reportedDate")
    return q.where(day.between(first, last)).select("symbol", F.to_date("fiscalDateEnding").alias("fiscal_end"), day.alias("reported"), F.col("surprise").try_cast("double").alias("surprise"), F.coalesce(F.col("reportTime").isin("pre-market", "post-market"), F.lit(False)).alias("timing_known"))


def read_csv_head(spark: SparkSession, path: str) -> DataFrame:
    """(file, column, place) of the header of CSV files, gzipped or not; the first line of a file alone."""
    lines = spark.read.text(path, wholetext=False).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    return heads.select("file", F.posexplode(F.transform(F.split("head", ","), lambda x: F.trim(x))).alias("place", "column"))


def cursor_of(url):
    """The value of a URL's only `cursor` parameter; null if there is none, or more than one."""
    found = F.regexp_extract_all(url, F.lit(r"[?&]cursor=([^&#]*)"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))
