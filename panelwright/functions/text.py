"""Text, title, URL and hash expressions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and the cue families' patterns.
TRACKING = r"(?i)^(utm_.*|gclid|fbclid|ref|source)="
CUES = {
    "toxic_cue": r"\b(idiot|moron|stupid|loser|trash|scum|clown)\b",
    "code_cue": r"[{}<>|]",
    "shout_cue": r"!!",
    "contact_cue": r"[a-z0-9]+@[a-z0-9]+|[0-9]{3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "secret_cue": r"(token|key|password) *=",
}
POSITIVE, NEGATIVE = r"\b(the|and|of)\b", r"\b(worthless|pathetic|disgusting|trash)\b"


def normalized_title(c: Column) -> Column:
    """Lower case, anything but letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def normalized_url(c: Column) -> Column:
    """Lower-case host without www. or default port, no fragment, no tracking parameters, sorted query, single slashes."""
    bare = F.regexp_replace(c, r"#.*$", "")
    head = F.regexp_extract(bare, r"^[a-zA-Z]+://([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(head), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[a-zA-Z]+://[^/?]*([^?]*)", 1), r"/+", "/"), r"/$", "")
    pairs = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.array_join(pairs, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def publisher_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://([^/?#:]*)", 1)), r"^(www|m)\.", "")


def literal_present(text: Column, phrase: str) -> Column:
    """The phrase between characters that are no ASCII letters or digits, case-sensitively.

    Texts without the phrase are told by their bytes; the others are searched for the phrase first, then for its neighbours.
    """
    return text.contains(phrase) & text.rlike(rf"{phrase}(?![A-Za-z0-9])(?<![A-Za-z0-9]{phrase})")


def length_stratum(c: Column) -> Column:
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, "empty").when(n < 150, "under_150").when(n < 300, "under_300").when(n < 600, "under_600").otherwise("over_600")


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def hash_shard(c: Column, shards: int) -> Column:
    """The first 15 hex digits of SHA-256, modulo the number of shards."""
    return F.pmod(F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("long"), F.lit(shards))


def surprise(c: Column) -> Column:
    p, n = c.rlike(POSITIVE), c.rlike(NEGATIVE)
    return F.when(p & n, "mixed").when(p, "positive").when(n, "negative").otherwise("none")


def bounded(c: Column, most: int) -> Column:
    """At most `most` characters, cut at the last space within them if there is one."""
    head = F.substring(c, 1, most)
    cut = F.regexp_replace(F.regexp_replace(head, r"[ \n][^ \n]*\z", ""), r"[ \n]+\z", "")
    return F.when(F.length(c) <= most, c).when(F.substring(c, most + 1, 1).rlike(r"^[ \n]\z"), F.regexp_replace(head, r"[ \n]+\z", "")).otherwise(cut)
