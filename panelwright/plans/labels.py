"""Label records: parsing, closed vocabularies, evidence, gates, views and reducers; article text fields and their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import table
from .registry import query

# The vocabularies that the label queries know.
FIELDS, DIRECTIONS, WORDS = ("up", "down", "flat"), ("click", "view", "purchase"), ("special", "final", "the")


@query("""SELECT p_partkey, p_name || chr(10) || chr(10) || p_type AS model_text, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS keyword, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def keyword_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline, blank line and description; keywords with only letters and digits; and as slugs."""
    t = F.lower("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n\n", "p_name", "p_type").alias("model_text"), F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")).alias("keyword"), F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_+|_+$", "").alias("slug"))


@query("""WITH k AS (SELECT doc_id, text, list_distinct(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) AS words FROM documents), m AS (SELECT doc_id, len(list_intersect(words, ['the', 'de', 'und', 'para'])) > 1 AS by_keyword, regexp_matches(lower(text), '\\bterms of use\\b|\\ball rights\\b') AS by_phrase FROM k)
 SELECT doc_id, CAST(by_keyword AS INTEGER) AS by_keyword, CAST(by_phrase AS INTEGER) AS by_phrase, CAST(by_keyword OR by_phrase AS INTEGER) AS evidence FROM m""")
def macro_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a macro item: enough configured keywords, or a phrase in its text."""
    words = F.array_distinct(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z]+", " ")), " "))
    a = F.size(F.array_intersect(words, F.array(*map(F.lit, ("the", "de", "und", "para"))))) > 1
    b = F.lower("text").rlike(r"\bterms of use\b|\ball rights\b")
    return table(spark, sf_dir, "documents").select("doc_id", a.cast("int").alias("by_keyword"), b.cast("int").alias("by_phrase"), (a | b).cast("int").alias("evidence"))


@query("""WITH s AS (SELECT p_type AS sector, lower(split_part(p_type, ' ', 1)) AS term FROM (SELECT DISTINCT p_type FROM part)), v AS (SELECT sector, unnest(list_sort(list_distinct([term, regexp_replace(term, 's$', '')]))) AS variant FROM s) SELECT sector, variant, count(p_partkey) AS parts FROM v LEFT JOIN part ON lower(p_name) LIKE '%' || variant || '%' GROUP BY 1, 2""")
def sector_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each sector with their singulars, and how many names hold them. Names are met as words' variants, few of them."""
    parts = table(spark, sf_dir, "part")
    v = parts.select(F.col("p_type").alias("sector")).distinct().select("sector", F.explode(F.array_sort(F.array_distinct(F.array(F.lower(F.split_part("sector", F.lit(" "), F.lit(1))), F.regexp_replace(F.lower(F.split_part("sector", F.lit(" "), F.lit(1))), "s$", ""))))).alias("variant"))
    names = parts.groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("k"))
    variants = v.select("variant").distinct()
    hits = names.join(F.broadcast(variants), F.expr("contains(name, variant)")).groupBy("variant").agg(F.sum("k").alias("k"))
    return v.join(hits, "variant", "left").select("sector", "variant", F.coalesce("k", F.lit(0)).alias("parts"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || ',"type":"' || p_type || '"}' AS canonical, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || ',"type":"' || p_type || '"}') AS digest FROM part""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as compact JSON with sorted keys, and its hash."""
    names = {"type": "p_type", "size": "p_size", "name": "p_name", "brand": "p_brand"}
    j = F.to_json(F.struct(*[F.col(names[k]).alias(k) for k in sorted(names)]))
    return table(spark, sf_dir, "part").select("p_partkey", j.alias("canonical"), F.sha2(j, 256).alias("digest"))


@query("""WITH j AS (SELECT page_id, '{"@graph":[{"@type":"WebPage","name":"' || page_id || '"},{"@type":"Article","articleBody":"' || CASE WHEN page_id % 3 = 0 THEN 'short' ELSE url END || '","hasPart":{"articleBody":"part ' || page_id || '"}}]}' AS ld FROM pages), b AS (SELECT page_id, unnest(list_concat(json_extract_string(ld, '$.@graph[*].articleBody'), json_extract_string(ld, '$.@graph[*].hasPart.articleBody'))) AS body FROM j)
 SELECT page_id, count(*) AS bodies, arg_max(body, row(length(body), body)) AS longest FROM b GROUP BY 1""")
def json_ld_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article bodies wherever they stand in a page's linked data; the longest one counts."""
    body = F.when(F.col("page_id") % 3 == 0, "short").otherwise(F.col("url"))
    ld = F.concat(F.lit('{"@graph":[{"@type":"WebPage","name":"'), F.col("page_id").cast("string"), F.lit('"},{"@type":"Article","articleBody":"'), body, F.lit('","hasPart":{"articleBody":"part '), F.col("page_id").cast("string"), F.lit('"}}]}'))
    found = F.regexp_extract_all(ld, F.lit(r'"articleBody":"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1))
    b = table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("body"))
    return b.groupBy("page_id").agg(F.count("*").alias("bodies"), F.max_by("body", F.struct(F.length("body"), "body")).alias("longest"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), u AS (SELECT doc_id, i, lines[i] AS line FROM l, range(1, len(lines) + 1) r(i)), f AS (SELECT doc_id, min(i) AS i, trim(line) AS line FROM u WHERE trim(line) <> '' GROUP BY doc_id, trim(line)), n AS (SELECT doc_id, count(*) AS kept, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM f GROUP BY 1)
 SELECT l.doc_id, coalesce(kept, 0) AS kept, digest FROM l LEFT JOIN n ON l.doc_id = n.doc_id""")
def unique_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in order, each once."""
    kept = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("long").alias("kept"), F.when(F.size(kept) > 0, F.md5(F.array_join(kept, "\n"))).alias("digest"))


@query("""SELECT page_id, CAST(regexp_matches(lower(html), 'subscribe to (continue|read)|subscribers only') AS INTEGER) AS phrase, CAST(regexp_matches(html, '(?i)<input[^>]*type=.?password') AS INTEGER) AS login, CAST(regexp_matches(lower(html), 'subscri|newsletter|sign in') AS INTEGER) AS mention FROM pages""")
def paywall_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of pages whose text stands behind a login or a subscription."""
    low = F.lower("html")
    return table(spark, sf_dir, "pages").select("page_id", low.rlike("subscribe to (continue|read)|subscribers only").cast("int").alias("phrase"), F.col("html").rlike("(?i)<input[^>]*type=.?password").cast("int").alias("login"), low.rlike("subscri|newsletter|sign in").cast("int").alias("mention"))


ADDRESS = "CASE page_id % 9 WHEN 0 THEN 'http://127.0.0.1/a' WHEN 1 THEN 'https://10.1.2.3/x' WHEN 2 THEN 'ftp://host.org/f' WHEN 3 THEN 'https://user:pw@host.org/' WHEN 4 THEN 'http://localhost:8080/' WHEN 5 THEN 'https://host.org:8443/y' WHEN 6 THEN 'https://192.168.0.9/z' ELSE url END"


@query(f"""WITH a AS (SELECT page_id, {ADDRESS} AS address FROM pages), p AS (SELECT page_id, address, regexp_extract(address, '^([a-z]+)://', 1) AS scheme, regexp_extract(address, '^[a-z]+://([^/]*)', 1) AS authority FROM a), h AS (SELECT *, regexp_extract(authority, '^(?:[^@]*@)?([^:]*)', 1) AS host, regexp_extract(authority, ':([0-9]+)$', 1) AS port FROM p)
 SELECT page_id, address, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN authority LIKE '%@%' THEN 'credentials' WHEN host IN ('localhost', '') OR regexp_matches(host, '^(127|10|0)\\.|^192\\.168\\.|^169\\.254\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.') THEN 'private host' WHEN port NOT IN ('', '80', '443') THEN 'port' END AS reason FROM h""")
def address_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an address must not be fetched: scheme, credentials, a private host or an odd port; null if it may."""
    a = table(spark, sf_dir, "pages").select("page_id", F.expr(ADDRESS).alias("address"))
    authority = F.regexp_extract("address", "^[a-z]+://([^/]*)", 1)
    host, port = F.regexp_extract(authority, "^(?:[^@]*@)?([^:]*)", 1), F.regexp_extract(authority, ":([0-9]+)$", 1)
    private = host.isin("localhost", "") | host.rlike(r"^(127|10|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.")
    reason = F.when(~F.regexp_extract("address", "^([a-z]+)://", 1).isin("http", "https"), "scheme").when(authority.contains("@"), "credentials").when(private, "private host").when(~port.isin("", "80", "443"), "port")
    return a.select("page_id", "address", reason.alias("reason"))


@query("""WITH r AS (SELECT n_name AS agent, unnest(['/', '/private/a', '/private/open/b', '/tmp']) AS path, CASE WHEN n_nationkey % 2 = 0 THEN ['/private'] ELSE ['/private', '/tmp'] END AS deny, CASE WHEN n_nationkey % 3 = 0 THEN ['/private/open'] ELSE [] END AS allow FROM nation),
 m AS (SELECT agent, path, coalesce(list_max([CASE WHEN starts_with(path, x) THEN length(x) ELSE 0 END FOR x IN deny]), 0) AS d, coalesce(list_max([CASE WHEN starts_with(path, x) THEN length(x) ELSE 0 END FOR x IN allow]), 0) AS a FROM r) SELECT agent, path, CAST(d = 0 OR a >= d AS INTEGER) AS allowed FROM m""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an agent may fetch a path: the longest rule decides, an allowing one before a denying one of its length."""
    n = F.col("n_nationkey")
    strings = lambda *s: F.array(*map(F.lit, s))
    r = table(spark, sf_dir, "nation").select(F.col("n_name").alias("agent"), F.explode(strings("/", "/private/a", "/private/open/b", "/tmp")).alias("path"), F.when(n % 2 == 0, strings("/private")).otherwise(strings("/private", "/tmp")).alias("deny"), F.when(n % 3 == 0, strings("/private/open")).otherwise(F.array().cast("array<string>")).alias("allow"))
    longest = lambda rules: F.coalesce(F.array_max(F.transform(rules, lambda x: F.when(F.startswith(F.col("path"), x), F.length(x)).otherwise(0))), F.lit(0))
    d, a = longest(F.col("deny")), longest(F.col("allow"))
    return r.select("agent", "path", ((d == 0) | (a >= d)).cast("int").alias("allowed"))


RAW = "'COMPANIES: ' || split_part(p_name, ' ', 1) || '; ' || CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 1) WHEN p_partkey % 4 = 1 THEN 'Unseen Co' ELSE split_part(p_name, ' ', 2) END || ' / SECTORS: ' || p_type"


@query(f"""WITH r AS (SELECT p_partkey, p_name, {RAW} AS raw FROM part), e AS (SELECT p_partkey, p_name, list_filter([trim(x) FOR x IN string_split(regexp_extract(raw, 'COMPANIES: (.*?) / SECTORS: ', 1), ';')], lambda x: x <> '') AS companies, trim(regexp_extract(raw, '/ SECTORS: (.*)$', 1)) AS sectors FROM r)
 SELECT p_partkey, array_to_string(companies, '|') AS companies, sectors, CAST(len(companies) <> len(list_distinct([lower(x) FOR x IN companies])) AS INTEGER) AS repeated, CAST(len(list_filter(companies, lambda x: NOT contains(lower(p_name), lower(x)))) > 0 AS INTEGER) AS unseen FROM e""")
def parsed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities out of an answer's text; repeated ones, and ones that the source doesn't hold, are errors."""
    r = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(RAW).alias("raw"))
    companies = F.filter(F.transform(F.split(F.regexp_extract("raw", "COMPANIES: (.*?) / SECTORS: ", 1), ";"), lambda x: F.trim(x)), lambda x: x != "")
    e = r.select("p_partkey", "p_name", companies.alias("c"), F.trim(F.regexp_extract("raw", "/ SECTORS: (.*)$", 1)).alias("sectors"))
    unseen = F.exists("c", lambda x: ~F.contains(F.lower(F.col("p_name")), F.lower(x)))
    return e.select("p_partkey", F.array_join("c", "|").alias("companies"), "sectors", (F.size("c") != F.size(F.array_distinct(F.transform("c", lambda x: F.lower(x))))).cast("int").alias("repeated"), unseen.cast("int").alias("unseen"))


ANSWER = "CASE event_id % 5 WHEN 0 THEN 'up|' || event_type WHEN 1 THEN ' Down | view' WHEN 2 THEN 'up' WHEN 3 THEN 'sideways|click' ELSE 'flat|click|extra' END"


@query(f"""WITH a AS (SELECT event_id, {ANSWER} AS raw FROM events), p AS (SELECT event_id, [trim(lower(x)) FOR x IN string_split(raw, '|')] AS parts, raw FROM a)
 SELECT event_id, CASE WHEN parts[1] IN ('up', 'down', 'flat') THEN parts[1] END AS direction, CASE WHEN parts[2] IN ('click', 'view', 'purchase') THEN parts[2] END AS kind, CAST(len(parts) = 2 AND parts[1] IN ('up', 'down', 'flat') AND coalesce(parts[2] IN ('click', 'view', 'purchase'), FALSE) AS INTEGER) AS valid, CAST(array_to_string(parts, '|') = raw AS INTEGER) AS strict FROM p""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two closed fields between bars: what is in the vocabulary, whether all is, and whether it was written so."""
    p = table(spark, sf_dir, "events").select("event_id", F.expr(ANSWER).alias("raw")).withColumn("parts", F.transform(F.split("raw", "[|]"), lambda x: F.trim(F.lower(x))))
    a, b = F.get("parts", 0), F.get("parts", 1)
    both = (F.size("parts") == 2) & a.isin(*FIELDS) & F.coalesce(b.isin(*DIRECTIONS), F.lit(False))
    return p.select("event_id", F.when(a.isin(*FIELDS), a).alias("direction"), F.when(b.isin(*DIRECTIONS), b).alias("kind"), both.cast("int").alias("valid"), (F.array_join("parts", "|") == F.col("raw")).cast("int").alias("strict"))


@query(f"""WITH a AS (SELECT event_id, event_type, {ANSWER} AS raw FROM events), c AS (SELECT event_type, avg(CASE WHEN raw LIKE '%|%' THEN 1.0 ELSE 0.0 END) AS parsed, avg(CASE WHEN raw = lower(raw) THEN 1.0 ELSE 0.0 END) AS plain, count(*) AS n FROM a GROUP BY 1)
 SELECT event_type, n, round(parsed, 6) AS parsed, round(plain, 6) AS plain, CAST(parsed >= 0.75 AS INTEGER) AS parsed_ok, CAST(plain >= 0.75 AS INTEGER) AS plain_ok, CAST(parsed >= 0.75 AND plain >= 0.75 AND n >= 10 AS INTEGER) AS promoted FROM c""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate that opens only if every check holds."""
    a = table(spark, sf_dir, "events").select("event_type", F.expr(ANSWER).alias("raw"))
    c = a.groupBy("event_type").agg(F.avg(F.col("raw").contains("|").cast("double")).alias("p"), F.avg((F.col("raw") == F.lower("raw")).cast("double")).alias("q"), F.count("*").alias("n"))
    p, q = F.col("p") >= 0.75, F.col("q") >= 0.75
    return c.select("event_type", "n", F.round("p", 6).alias("parsed"), F.round("q", 6).alias("plain"), p.cast("int").alias("parsed_ok"), q.cast("int").alias("plain_ok"), (p & q & (F.col("n") >= 10)).cast("int").alias("promoted"))


@query("""WITH a AS (SELECT doc_id, quality AS q, toxic AS t FROM labels), b AS (SELECT doc_id, CAST(n_chars > 500 AS INTEGER) AS q, CAST(n_chars % 7 = 0 AS INTEGER) AS t FROM documents) SELECT a.doc_id, b.q AS quality, a.t AS toxic, CASE WHEN a.t = 1 THEN NULL ELSE b.q END AS dependent, CAST(a.q = b.q AS INTEGER) AS agrees FROM a JOIN b USING (doc_id)""")
def hybrid_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields taken from one of two prediction sets each; a field that depends on another is skipped where that one rules it out."""
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("toxic"))
    b = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"))
    return a.join(b, "doc_id").select("doc_id", "quality", "toxic", F.when(F.col("toxic") == 1, None).otherwise(F.col("quality")).alias("dependent"), (F.col("q") == F.col("quality")).cast("int").alias("agrees"))


@query("""WITH l AS (SELECT list_sort(list(r_name)) AS names FROM region), k AS (SELECT names, unnest(range(0, len(names))) AS turn FROM l), r AS (SELECT turn, list_concat(names[turn + 1:], names[:turn]) AS rotated FROM k), s AS (SELECT turn, i AS place, rotated[i] AS label, ln((turn + 2.0 * i) / 40) AS log_prob FROM r, range(1, 6) t(i))
 SELECT label, count(*) AS turns, round(avg(exp(log_prob)), 6) AS score, string_agg(CAST(place AS VARCHAR), '' ORDER BY turn) AS places FROM s GROUP BY 1""")
def rotation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rotation of a label list, the score of each label by its place in it, and their mean over rotations."""
    l = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list("r_name")).alias("names"))  # noqa: E741
    k = l.select("names", F.explode(F.sequence(F.lit(0), F.size("names") - 1)).alias("turn"))
    r = k.select("turn", F.concat(F.expr("slice(names, turn + 1, size(names))"), F.expr("slice(names, 1, turn)")).alias("rotated"))
    s = r.select("turn", F.posexplode("rotated").alias("at", "label")).select("turn", "label", (F.col("at") + 1).alias("place"), F.log((F.col("turn") + 2.0 * (F.col("at") + 1)) / 40).alias("log_prob"))
    return s.groupBy("label").agg(F.count("*").alias("turns"), F.round(F.avg(F.exp("log_prob")), 6).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "place"))), lambda x: x["place"].cast("string")), "").alias("places"))


@query("""WITH r AS (SELECT b.item_id, b.text, CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN substr(text, 5, 30) ELSE substr(text, 5, 30) || ' xx' END AS evidence, CASE WHEN item_id % 4 = 0 THEN 'sideways' ELSE 'up' END AS label FROM benchmark b)
 SELECT item_id, CAST(evidence IS NULL AS INTEGER) AS missing, CAST(label NOT IN ('up', 'down', 'flat') AS INTEGER) AS unknown_label, CAST(evidence IS NOT NULL AND NOT contains(text, evidence) AS INTEGER) AS not_verbatim, CAST(coalesce(contains(text, evidence), FALSE) AND label IN ('up', 'down', 'flat') AS INTEGER) AS valid FROM r""")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields, closed labels and verbatim evidence of label records."""
    i, t = F.col("item_id"), F.col("text")
    part = F.substring("text", 5, 30)
    r = table(spark, sf_dir, "benchmark").select("item_id", "text", F.when(i % 3 == 0, None).when(i % 3 == 1, part).otherwise(F.concat(part, F.lit(" xx"))).alias("evidence"), F.when(i % 4 == 0, "sideways").otherwise("up").alias("label"))
    e, known = F.col("evidence"), F.col("label").isin(*FIELDS)
    held = F.contains(t, e)
    return r.select("item_id", e.isNull().cast("int").alias("missing"), (~known).cast("int").alias("unknown_label"), (e.isNotNull() & ~held).cast("int").alias("not_verbatim"), (F.coalesce(held, F.lit(False)) & known).cast("int").alias("valid"))


@query("""WITH rules(scope, alignment) AS (VALUES ('F', 'A'), ('F', 'R'), ('O', 'N'), ('P', 'N')), l AS (SELECT o_orderkey, o_orderstatus AS scope, min(l_returnflag) AS alignment FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
 SELECT l.scope, l.alignment, count(*) AS records, CAST(count(r.scope) = count(*) AS INTEGER) AS allowed FROM l LEFT JOIN rules r ON r.scope = l.scope AND r.alignment = l.alignment GROUP BY 1, 2""")
def label_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of fields against a table of those that are allowed."""
    rules = spark.createDataFrame([("F", "A"), ("F", "R"), ("O", "N"), ("P", "N")], "scope string, alignment string").withColumn("ok", F.lit(1))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("alignment"))
    l = table(spark, sf_dir, "orders").join(lines, "o_orderkey").groupBy(F.col("o_orderstatus").alias("scope"), "alignment").agg(F.count("*").alias("records"))  # noqa: E741
    return l.join(F.broadcast(rules), ["scope", "alignment"], "left").select("scope", "alignment", "records", F.coalesce("ok", F.lit(0)).alias("allowed"))


@query("""WITH d AS (SELECT doc_id, count(*) AS k, count(DISTINCT h) AS kinds FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, md5(lower(text)) FROM documents WHERE n_chars > 500) GROUP BY 1), w AS (SELECT DISTINCT doc_id FROM labels)
 SELECT 'missing' AS "check", count(*) AS violations FROM w WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT 'unexpected', count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM w) UNION ALL SELECT 'repeated', count(*) FROM d WHERE k > 1 UNION ALL SELECT 'conflicting', count(*) FROM d WHERE kinds > 1""")
def merged_label_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a labelling merged: documents that are missing, unexpected, repeated or in conflict."""
    from ..operators import checks as K

    d = table(spark, sf_dir, "documents")
    parts = d.where("lang = 'en'").select("doc_id", F.md5("text").alias("h")).unionAll(d.where("n_chars > 500").select("doc_id", F.md5(F.lower("text")).alias("h")))
    merged = parts.groupBy("doc_id").agg(F.count("*").alias("k"), F.countDistinct("h").alias("kinds"))
    sides = K.key_difference(table(spark, sf_dir, "labels"), merged, ["doc_id"]).withColumn("check", F.when(F.col("check") == "only_left", "missing").otherwise("unexpected"))
    return sides.unionByName(K.row_checks(merged, {"repeated": F.col("k") > 1, "conflicting": F.col("kinds") > 1}))


@query("""WITH g AS (SELECT source, tau, quality AS truth, CAST(n_chars >= tau AS INTEGER) AS guess FROM labels JOIN documents USING (doc_id), (VALUES (100), (300), (600), (1200)) t(tau)), s AS (SELECT source, tau, avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n,
 2.0 * count(*) FILTER (WHERE truth = 1 AND guess = 1) / nullif(count(*) FILTER (WHERE truth = 1) + count(*) FILTER (WHERE guess = 1), 0) AS f1, 2.0 * count(*) FILTER (WHERE truth = 0 AND guess = 0) / nullif(count(*) FILTER (WHERE truth = 0) + count(*) FILTER (WHERE guess = 0), 0) AS f0 FROM g GROUP BY 1, 2)
 SELECT source, n, arg_max(tau, row(round(coalesce(f1, 0) + coalesce(f0, 0), 9), round(accuracy, 9), -tau)) AS tau, round(max((coalesce(f1, 0) + coalesce(f0, 0)) / 2), 6) AS macro_f1 FROM s GROUP BY 1, 2""")
def selected_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of each source with the best macro F1, then accuracy, then the lowest, of a small grid."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    g = d.select("source", F.col("quality").alias("truth"), "n_chars", F.explode(F.array(*map(F.lit, (100, 300, 600, 1200)))).alias("tau")).withColumn("guess", (F.col("n_chars") >= F.col("tau")).cast("int"))
    f = lambda v: F.coalesce(F.try_divide(2.0 * F.count_if((F.col("truth") == v) & (F.col("guess") == v)), F.count_if(F.col("truth") == v) + F.count_if(F.col("guess") == v)), F.lit(0.0))
    s = g.groupBy("source", "tau").agg(F.avg((F.col("truth") == F.col("guess")).cast("double")).alias("accuracy"), F.count("*").alias("n"), (f(1) + f(0)).alias("both"))
    return s.groupBy("source", "n").agg(F.max_by("tau", F.struct(F.round("both", 9), F.round("accuracy", 9), -F.col("tau"))).alias("tau"), F.round(F.max("both") / 2, 6).alias("macro_f1"))


@query("""WITH v AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), p AS (SELECT a.conv_id, CASE WHEN a.n > 200 THEN 'long' WHEN a.n < 60 THEN NULL ELSE 'short' END AS x, CASE WHEN b.n > 200 THEN 'long' WHEN b.n < 60 THEN NULL ELSE 'short' END AS y, a.n - b.n AS margin FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1)
 SELECT coalesce(x, 'abstain') AS first, coalesce(y, 'abstain') AS second, count(*) AS pairs, round(avg(margin), 6) AS margin FROM p GROUP BY 1, 2""")
def paired_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of an item: transitions between labels and abstention, and the mean change of the margin."""
    n = F.length("text")
    label = F.when(n > 200, "long").when(n < 60, "abstain").otherwise("short")
    c = table(spark, sf_dir, "conversations")
    a, b = (c.where(F.col("turn") == t).select("conv_id", label.alias(name), n.alias(f"n{t}")) for t, name in ((0, "first"), (1, "second")))
    return a.join(b, "conv_id").groupBy("first", "second").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("n0") - F.col("n1")), 6).alias("margin"))


@query("""WITH s AS (SELECT conv_id, list(length(text) ORDER BY turn) AS lens, list(DISTINCT role) AS roles FROM conversations GROUP BY 1), d AS (SELECT conv_id, len(lens) AS turns, list_max(lens) - list_min(lens) AS spread, CAST(len(roles) > 2 AS INTEGER) AS has_system FROM s) SELECT turns, has_system, count(*) AS n, round(avg(spread), 6) AS mean_spread, max(spread) AS most FROM d GROUP BY 1, 2""")
def decoder_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How scores of an item spread over its orders, by the number of orders."""
    n = F.length("text")
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), (F.max(n) - F.min(n)).cast("long").alias("spread"), (F.countDistinct("role") > 2).cast("int").alias("has_system"))
    return d.groupBy("turns", "has_system").agg(F.count("*").alias("n"), F.round(F.avg("spread"), 6).alias("mean_spread"), F.max("spread").alias("most"))


@query("""WITH k AS (SELECT doc_id, md5(text) AS h FROM documents), s AS (SELECT h, count(*) AS n, min(doc_id) AS first FROM k GROUP BY 1) SELECT k.doc_id, CASE WHEN d.n_chars = 0 THEN 'not_provided' WHEN n = 1 THEN 'unmatched' WHEN n > 2 THEN 'ambiguous' ELSE 'matched' END AS method, CASE WHEN n = 2 AND first <> k.doc_id THEN first END AS source_id FROM k JOIN s USING (h) JOIN documents d ON d.doc_id = k.doc_id""")
def linked_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that an item's summary comes from, with how it was found; several candidates are ambiguous."""
    k = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5("text").alias("h"))
    s = k.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    j = k.join(s, "h")
    method = F.when(F.col("n_chars") == 0, "not_provided").when(F.col("n") == 1, "unmatched").when(F.col("n") > 2, "ambiguous").otherwise("matched")
    return j.select("doc_id", method.alias("method"), F.when((F.col("n") == 2) & (F.col("first") != F.col("doc_id")), F.col("first")).alias("source_id"))


@query("""SELECT source, sha256(string_agg(doc_id || ':' || strlen(text) || ':' || md5(text), ';' ORDER BY doc_id)) AS fingerprint, count(*) AS files FROM documents WHERE doc_id IS NOT NULL GROUP BY 1""")
def root_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the sorted names, sizes and hashes of what a root holds; the lists hold digests, not texts."""
    one = F.struct("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.octet_length("text").cast("string"), F.md5("text")).alias("s"))
    d = table(spark, sf_dir, "documents").where("doc_id is not null").groupBy("source").agg(F.array_sort(F.collect_list(one)).alias("l"), F.count("*").alias("files"))
    return d.select("source", F.sha2(F.array_join(F.transform("l", lambda x: x["s"]), ";"), 256).alias("fingerprint"), "files")


@query("""WITH i AS (SELECT user_id, list_sort(list(DISTINCT event_type || '=' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END)) AS insights, list_sort(list(DISTINCT event_type)) AS keywords FROM events GROUP BY 1) SELECT user_id, array_to_string(insights, ';') AS insights, array_to_string(keywords, ';') AS keywords, len(insights) AS n FROM i""")
def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct insights of an item, sorted, and its lists as text."""
    i = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "event_type", F.when(F.col("value") > 50, "high").otherwise("low")))).alias("i"), F.array_sort(F.collect_set("event_type")).alias("k"))
    return i.select("user_id", F.array_join("i", ";").alias("insights"), F.array_join("k", ";").alias("keywords"), F.size("i").cast("long").alias("n"))


@query("""WITH t AS (SELECT p_partkey, CAST(regexp_matches(lower(p_name), '^[a-m]') AS INTEGER) AS cue, length(p_name) AS n FROM part) SELECT l_orderkey, l_linenumber, cue, n, CAST(n > 12 AS INTEGER) AS long_text FROM lineitem JOIN t ON l_partkey = p_partkey""")
def enriched_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of a text computed once an item, and joined back to every assignment of it."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").rlike("^[a-m]").cast("int").alias("cue"), F.length("p_name").cast("long").alias("n"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(t, "l_partkey").select("l_orderkey", "l_linenumber", "cue", "n", (F.col("n") > 12).cast("int").alias("long_text"))


@query("""WITH g AS (SELECT source, quality AS truth, CAST(n_chars > 300 AS INTEGER) AS a, CAST(n_chars > 600 AS INTEGER) AS b FROM labels JOIN documents USING (doc_id)), d AS (SELECT source, count(*) FILTER (WHERE truth = a AND truth <> b) AS x, count(*) FILTER (WHERE truth <> a AND truth = b) AS y FROM g GROUP BY 1),
 t AS (SELECT source, x, y, x + y AS n, least(x, y) AS k FROM d), c AS (SELECT source, sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) AS tail FROM t, range(0, 100000) r(i) WHERE i <= k GROUP BY 1) SELECT source, x AS only_first, y AS only_second, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6) AS p FROM t JOIN c USING (source)""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discordant pairs of two rules, and the exact two-sided binomial probability of them."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    truth, a, b = F.col("quality"), (F.col("n_chars") > 300).cast("int"), (F.col("n_chars") > 600).cast("int")
    d = j.groupBy("source").agg(F.count_if((truth == a) & (truth != b)).alias("only_first"), F.count_if((truth != a) & (truth == b)).alias("only_second"))
    return d.select("source", "only_first", "only_second", F.round(M.exact_binomial_p(F.col("only_first"), F.col("only_second")), 6).alias("p"))
