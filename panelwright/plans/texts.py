"""Text queries: normalisation, cues, routing, quality gates, chunks, linkage and deduplication of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunks import packed_paragraphs as packed
from ..sources.tables import table
from .registry import query

LATIN = r"[^a-zA-Z0-9]+"
#: Parts over which the documents of one linkage key are dealt.
SALTS = 16


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


FIRST = r"split_part(text, chr(10), 1)"


@query(f"SELECT doc_id, trim(regexp_replace(lower({FIRST}), '[^a-z0-9]+', ' ', 'g')) AS title, length(text) AS chars FROM documents")
def title_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", T.normalized_title(F.split("text", "\n", 2)[0]).alias("title"), F.length("text").cast("long").alias("chars"))


_URL = r"""WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u, url FROM pages), p AS (SELECT page_id, url,
 regexp_replace(regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
 regexp_replace(regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
 list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_.*|gclid|fbclid|ref|source)='))) AS q FROM b)
 SELECT page_id, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS clean, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^(www|m)\.', '') AS publisher FROM p"""


@query(_URL)
def url_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normalized_url(F.col("url")).alias("clean"), T.publisher_host(F.col("url")).alias("publisher"))


def _re(p: str) -> str:
    return p.replace("'", "''")


@query("SELECT doc_id, " + ", ".join(f"CAST(regexp_matches(text, '{_re(p)}') AS INTEGER) AS {k}" for k, p in T.CUES.items()) + f", CASE WHEN regexp_matches(text, '{T.POSITIVE}') AND regexp_matches(text, '{T.NEGATIVE}') THEN 'mixed' WHEN regexp_matches(text, '{T.POSITIVE}') THEN 'positive' WHEN regexp_matches(text, '{T.NEGATIVE}') THEN 'negative' ELSE 'none' END AS surprise FROM documents")
def cue_multihot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", *[F.col("text").rlike(p).cast("int").alias(k) for k, p in T.CUES.items()], T.surprise(F.col("text")).alias("surprise"))


# Aliases of the entities that texts are searched for.
ALIASES = [("EN", "The"), ("EN", "of"), ("DE", "der"), ("DE", "und"), ("FR", "les"), ("FR", "dans"), ("ES", "que"), ("ES", "los")]


@query(f"""WITH a(target, alias) AS (VALUES {", ".join(f"('{t}', '{a}')" for t, a in ALIASES)}), hits AS (SELECT doc_id, target, count(*) AS aliases FROM documents, a WHERE regexp_matches(text, '(^|[^A-Za-z0-9])' || alias || '([^A-Za-z0-9]|$)') GROUP BY 1, 2)
 SELECT doc_id, target, aliases, count(*) OVER (PARTITION BY doc_id) AS entities FROM hits""")
def literal_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose aliases a text names; one expression per alias instead of a theta join."""
    per = {t: [a for u, a in ALIASES if u == t] for t in dict(ALIASES)}
    found = F.array(*[F.struct(F.lit(t).alias("target"), sum((T.literal_present(F.col("text"), a).cast("long") for a in names), F.lit(0)).alias("aliases")) for t, names in per.items()])
    hits = F.filter(found, lambda x: x["aliases"] > 0)
    return docs_of(spark, sf_dir).select("doc_id", hits.alias("h")).select("doc_id", F.size("h").cast("long").alias("entities"), F.explode("h").alias("e")).select("doc_id", "e.target", "e.aliases", "entities")


_ROLE = r"""WITH f AS (SELECT doc_id, lang, regexp_matches(text, '(^|[^A-Za-z0-9])The([^A-Za-z0-9]|$)') AS direct, regexp_matches(text, '(^|[^A-Za-z0-9])that([^A-Za-z0-9]|$)') AS peer, regexp_matches(text, '(^|[^A-Za-z0-9])this([^A-Za-z0-9]|$)') AS common FROM documents)
 SELECT doc_id, CASE WHEN common THEN 'C' WHEN direct THEN 'I' WHEN peer THEN 'P' ELSE 'N' END AS role, CAST(direct OR peer OR common AS INTEGER) AS relevant FROM f"""


@query(_ROLE)
def role_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by priority: common, then own, then peer news."""
    d, p, c = (T.literal_present(F.col("text"), w) for w in ("The", "that", "this"))
    return docs_of(spark, sf_dir).select("doc_id", F.when(c, "C").when(d, "I").when(p, "P").otherwise("N").alias("role"), (d | p | c).cast("int").alias("relevant"))


@query("""SELECT lang, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 150 THEN 'under_150' WHEN length(text) < 300 THEN 'under_300' WHEN length(text) < 600 THEN 'under_600' ELSE 'over_600' END AS stratum,
 count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest, quantile_cont(length(text), 0.5) AS middle FROM documents GROUP BY 1, 2""")
def length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return docs_of(spark, sf_dir).groupBy("lang", T.length_stratum(F.col("text")).alias("stratum")).agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.percentile(n, 0.5).alias("middle"))


_QUALITY = r"""WITH r AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\x00-\x{024F}]', '', 'g')) AS latin, length(regexp_replace(text, '[^\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS control, length(regexp_replace(text, '[^#$%&*|<>]', '', 'g')) AS marks, length(regexp_replace(text, '[^.]', '', 'g')) AS stops FROM documents)
 SELECT doc_id, CASE WHEN n < 50 THEN 'short' WHEN latin < 0.8 * n THEN 'non_latin' WHEN control > 0 THEN 'control' WHEN marks > 0.1 * n THEN 'marks' WHEN stops = 0 THEN 'no_prose' ELSE 'ok' END AS reason, round(marks / greatest(n, 1), 6) AS mark_share FROM r"""


@query(_QUALITY)
def fulltext_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reason by ratios of character classes, the first that applies."""
    count = lambda keep: F.length(F.regexp_replace("text", keep, ""))
    n, latin, control, marks, stops = F.length("text"), count(r"[^\x00-ɏ]"), count(r"[^\x00-\x08\x0b\x0c\x0e-\x1f]"), count(r"[^#$%&*|<>]"), count(r"[^.]")
    reason = F.when(n < 50, "short").when(latin < 0.8 * n, "non_latin").when(control > 0, "control").when(marks > 0.1 * n, "marks").when(stops == 0, "no_prose").otherwise("ok")
    return docs_of(spark, sf_dir).select("doc_id", reason.alias("reason"), F.round(marks / F.greatest(n, F.lit(1)), 6).alias("mark_share"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT *, sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS reach FROM p)
 SELECT doc_id, CAST(floor((reach - length(part)) / 1000) AS BIGINT) AS chunk, count(*) AS paragraphs, CAST(sum(length(part)) AS BIGINT) AS chars FROM s GROUP BY 1, 2""")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by the thousand characters in which they begin: chunks of whole paragraphs."""
    parts = docs_of(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "part"))
    w = Window.partitionBy("doc_id").orderBy("i")
    starts = parts.withColumn("reach", F.sum(F.length("part") + 1).over(w) - 1)
    return starts.groupBy("doc_id", F.floor((F.col("reach") - F.length("part")) / 1000).alias("chunk")).agg(F.count("*").alias("paragraphs"), F.sum(F.length("part")).cast("long").alias("chars"))


@query()
def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole paragraphs of at most 2000 characters, oversized paragraphs being cut; no SQL, as a chunk's start depends on all before it."""
    return packed(docs_of(spark, sf_dir), 2000).select("doc_id", "chunk", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("""SELECT conv_id, count(*) AS turns, CAST(max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS INTEGER) AS contiguous, md5(string_agg(coalesce(role, '') || ':' || coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) = count(*)""")
def chunk_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts put together in order, with a check that none is missing, and a digest of the whole."""
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("turn").alias("d"), F.max("turn").alias("b"), F.min("turn").alias("a"), F.array_sort(F.collect_list(F.struct("turn", F.concat(F.coalesce("role", F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).alias("t")))).alias("p"))
    return parts.where("d = turns").select("conv_id", "turns", ((F.col("b") - F.col("a") + 1 == F.col("turns")) & (F.col("d") == F.col("turns"))).cast("int").alias("contiguous"), F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("digest"))


@query("""WITH u AS (SELECT md5(text) AS k, min(doc_id) AS doc_id, count(*) AS copies, list_sort(list(DISTINCT source)) AS sources, count(DISTINCT lang) AS langs FROM documents GROUP BY 1) SELECT doc_id, copies, array_to_string(sources, ';') AS sources, CAST(langs > 1 AS INTEGER) AS conflict FROM u""")
def dedup_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per text, with the union of its sources and whether a fixed field disagrees."""
    u = docs_of(spark, sf_dir).groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.array_sort(F.collect_set("source")).alias("s"), F.countDistinct("lang").alias("langs"))
    return u.select("doc_id", "copies", F.array_join("s", ";").alias("sources"), (F.col("langs") > 1).cast("int").alias("conflict"))


_BEST = r"""WITH d AS (SELECT DISTINCT doc_id, md5(text) AS whole, md5(split_part(text, chr(10), 1)) AS first, n_chars FROM documents), k AS (SELECT DISTINCT doc_id, 1 AS priority, whole AS key FROM d WHERE whole IS NOT NULL UNION ALL SELECT DISTINCT doc_id, 2, first || ':' || n_chars FROM d WHERE first IS NOT NULL AND n_chars IS NOT NULL),
 w AS (SELECT doc_id, priority, CASE WHEN row_number() OVER g = 1 THEN lead(doc_id) OVER g ELSE first_value(doc_id) OVER g END AS other FROM k WHERE doc_id IS NOT NULL WINDOW g AS (PARTITION BY priority, key ORDER BY doc_id))
 SELECT doc_id, arg_min(other, row(priority, other)) AS match, min(priority) AS priority FROM w WHERE other IS NOT NULL GROUP BY 1"""


@query(_BEST)
def match_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best other document by the whole text, else by first line and length; of equals the least.

    A key's documents all match its least, which matches the next; both come from aggregation, so no pairs are made.
    """
    first = F.concat(F.md5(F.split("text", "\n", 2)[0]), F.lit(":"), F.col("n_chars").cast("string"))
    both = F.array(*[F.struct(F.lit(p).alias("priority"), k.alias("key")) for p, k in ((1, F.md5("text")), (2, first))])
    rows = docs_of(spark, sf_dir).where("doc_id IS NOT NULL").select("doc_id", F.explode(both).alias("k")).select("doc_id", "k.priority", "k.key").where("key IS NOT NULL")
    shared = rows.groupBy("priority", "key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("priority", "key", "least")
    # documents of a key are dealt over salts, so a large group isn't one task's
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    m = rows.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(salted, ["priority", "key", "salt"])
    others = m.where("doc_id <> least")
    following = others.groupBy("priority", "key", "least").agg(F.min("doc_id").alias("other"))
    found = others.select("doc_id", "priority", F.col("least").alias("other")).union(following.select(F.col("least").alias("doc_id"), "priority", "other"))
    return found.groupBy("doc_id").agg(F.min_by("other", F.struct("priority", "other")).alias("match"), F.min("priority").alias("priority"))


@query("SELECT doc_id, sha256('v1' || chr(31) || source || chr(31) || doc_id) AS assignment, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % 16 AS BIGINT) AS shard FROM documents")
def assignment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", T.stable_hash(F.lit("v1"), F.col("source"), F.col("doc_id").cast("string")).alias("assignment"), T.hash_shard(F.col("doc_id").cast("string"), 16).alias("shard"))


@query(r"""SELECT page_id, length(t) AS chars, t AS title FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", t.alias("title"), F.length(t).cast("long").alias("chars"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN substr(text, 201, 1) IN (' ', chr(10)) THEN regexp_replace(substr(text, 1, 200), '[ \n]+$', '') ELSE regexp_replace(regexp_replace(substr(text, 1, 200), '[ \n][^ \n]*$', ''), '[ \n]+$', '') END AS description, CAST(length(text) > 200 AS INTEGER) AS truncated FROM documents""")
def bounded_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound is the feature here: a description of at most 200 characters, cut at a space."""
    return docs_of(spark, sf_dir).select("doc_id", T.bounded(F.col("text"), 200).alias("description"), (F.length("text") > 200).cast("int").alias("truncated"))
