"""Jaccard self-join on word n-grams: rare-first prefix, length, positional and suffix filters, one verification a pair."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .runtime import drop_written, slices, tidied, written
from .units import kept
from .words import WordTable, mix

#: Counters of words, shared by words of one hash; a fixed size, whatever the input. An n-gram is as rare as its rarest word.
COUNTERS = 1 << 21
#: Counters in one row of the shuffle that adds them up.
CHUNK = 1 << 15
#: Documents, and shingles of them, that one task compares; larger families are cut into blocks by length and by a hash.
BLOCK, SHINGLES = 8192, 1 << 21
#: Shingles of the documents whose marks one task compares; at 80 % a mark takes 1 to 2 bits a shingle.
MARKED = 1 << 25
#: Classes that share an n-gram on a rung, up to which they are met in pairs; more are met by a star.
LIST = 16
#: Bytes of text that a task holds as words at a time.
SLICE = 1 << 21

_LOW56 = np.uint64((1 << 56) - 1)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _table() -> WordTable:
    """One a worker, between tasks, until another stage's cache takes its place."""
    return kept(WordTable, _hashes, 150_000)


def shingles(texts: list[str | None], n: int, levels: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the distinct n-word shingles as sorted 64-bit hashes, the whole of a shorter sequence being one; and, given
    levels of words, the same shingles as integers that sort rare-first: the level of the rarest word, then the hash."""
    table = _table()
    table.trim()
    # bytes.lower() changes A-Z only, and bytes.split() splits at 0x20 and 0x09-0x0D only
    rows = [table.at((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    hashes = table.filled()
    level = levels[_counter(hashes)] if levels is not None else np.zeros(len(hashes), np.uint8)
    out = []
    for at in rows:
        h, rare = hashes[at], level[at]
        width = min(n, len(h))
        if not width:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
            continue
        m = len(h) - width + 1
        acc, least = np.full(m, width, np.uint64), rare[:m]
        for k in range(width):
            acc = mix(acc ^ h[k : k + m])
            least = np.minimum(least, rare[k : k + m])
        own, first = np.unique(acc, return_index=True)
        out.append((own, np.sort((least[first].astype(np.uint64) << np.uint64(56)) | (own & _LOW56)) if levels is not None else own))
    return out


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (COUNTERS - 1).bit_length())).astype(np.int64)


def _need(total: np.ndarray | int, percent: int):
    """The least overlap that two sets of that total size need: J >= p/100 means (100 + p) * overlap >= p * total."""
    return -(-percent * total // (100 + percent))


def rarity(docs: DataFrame) -> np.ndarray:
    """A level of 0 to 255 per counter, higher for counters of more words of all documents.

    Tasks count in arrays of COUNTERS integers, sent in compressed chunks of CHUNK and added in two steps: a task of the
    first adds one chunk of one in 256 of the tasks, a task of the second 256 sums. The driver gets COUNTERS bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seed, table = np.zeros(COUNTERS, np.int64), 0, _table()
        for part in slices(batches, "text", SLICE):
            table.trim()
            rows = [table.at((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in part.column("text").to_pylist()]
            hashes = table.filled()
            if any(map(len, rows)):
                each = np.bincount(np.concatenate(rows), minlength=len(hashes))[: len(table)]
                total += np.bincount(_counter(hashes[: len(table)]), each, minlength=COUNTERS).astype(np.int64)
                seed = seed or xxhash.xxh3_64_intdigest(each.tobytes()) % 256
        if total.any():
            rows = [(k, seed, zlib.compress(total[k * CHUNK : (k + 1) * CHUNK].tobytes(), 1)) for k in range(COUNTERS // CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["k", "salt", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for raw in rows["counts"]:
            total += np.frombuffer(zlib.decompress(raw), np.int64)
        return pd.DataFrame({"k": [rows["k"].iat[0]], "salt": [0], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "k int, salt int, counts binary"
    parts = docs.select("text").mapInArrow(tidied(count), schema)
    summed = parts.groupBy("k", "salt").applyInPandas(add, schema).groupBy("k").applyInPandas(add, schema)
    total = np.zeros(COUNTERS, np.int64)
    for row in summed.toLocalIterator():
        total[row["k"] * CHUNK : (row["k"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return np.minimum(255, np.round(8 * np.log2(total + 1))).astype(np.uint8)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """An upper bound of the overlap of two sorted arrays: cut both at the middle of one, and bound the halves."""
    if not len(x) or not len(y):
        return 0
    if depth == 0 or min(len(x), len(y)) < 4:
        return min(len(x), len(y))
    if len(x) < len(y):
        x, y = y, x
    mid = len(x) // 2
    at = int(np.searchsorted(y, x[mid]))
    same = int(at < len(y) and y[at] == x[mid])
    return suffix_bound(x[:mid], y[:at], depth - 1) + same + suffix_bound(x[mid + 1 :], y[at + same :], depth - 1)


def linked_blocks(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Forest:
    """Union of linked sets (rare-first ordered arrays). `side` is 0 or 1 in two blocks whose own pairs other tasks
    compare, 2 in a block by itself, and 3 or 4 in a rung and the rung above, whose own pairs another task compares.

    Sets are taken by length. One finds its candidates by the postings of earlier sets' prefixes, under the length and
    positional filters; those already in one component with it need no more; the suffix filter bounds the others, and
    the overlap of what remains is computed, once a pair.
    """
    forest = Forest(len(sets))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    prefixes = sizes - -(-percent * sizes // 100) + 1
    postings: dict[int, list[int]] = defaultdict(list)
    places: dict[int, list[int]] = defaultdict(list)
    heads, times = np.unique(np.concatenate([x[:p] for x, p in zip(sets, prefixes.tolist(), strict=True)]), return_counts=True)
    shared = heads[times > 1]  # a shingle of one prefix only finds nothing
    roots, merged = forest.up, True
    for i in np.argsort(sizes, kind="stable").tolist():
        x, n = sets[i], int(sizes[i])
        found, here, there = [], [], []
        head = x[: prefixes[i]]
        at = np.minimum(np.searchsorted(shared, head), max(0, len(shared) - 1))
        common = np.flatnonzero(shared[at] == head) if len(shared) else np.zeros(0, np.int64)
        head = list(zip(common.tolist(), head[common].tolist(), strict=True))
        for p, gram in head:
            if got := postings.get(gram):
                found.append(np.array(got))
                there.append(np.array(places[gram]))
                here.append(np.full(len(got), p))
        if found:
            js, q, p = np.concatenate(found), np.concatenate(there), np.concatenate(here)
            ok = 100 * sizes[js] >= percent * n
            if side[i] in (0, 1, 4):
                ok &= side[js] != side[i]
            js, q, p = js[ok], q[ok], p[ok]
            js, first = np.unique(js, return_index=True)  # the first common prefix shingle of each
            most = 1 + np.minimum(n - p[first] - 1, sizes[js] - q[first] - 1)
            js = js[most >= _need(n + sizes[js], percent)]
            if len(js):
                if merged:
                    roots, merged = forest.roots(), False
                js = js[roots[js] != roots[i]]
            for j in js.tolist():
                if forest.find(i) == forest.find(j):
                    continue
                need = _need(n + int(sizes[j]), percent)
                if suffix_bound(x, sets[j]) < need:
                    continue
                if len(np.intersect1d(x, sets[j], assume_unique=True)) >= need:
                    forest.join(i, j)
                    merged = True
        for p, gram in head:
            postings[gram].append(i)
            places[gram].append(p)
    return forest


def mark(s: np.ndarray, percent: int) -> bytes:
    """The parities of a set's numbers by their low bits: of two sets, at most as many differ as there are elements that one
    set has alone. As many bits as tell unrelated sets apart, a power of two, 64 at least; a half folds onto the other."""
    bits = 64
    while bits * (100 + percent) < 9 * (100 - percent) * len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def near_blocks(marks: list[bytes], sizes: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Per set the least place (by length) of those that it reaches by pairs whose marks allow a link; sides as in linked_blocks."""
    order = np.argsort(sizes, kind="stable")
    n, side = sizes[order].astype(np.int64), side[order]
    words = np.array([len(marks[k]) // 8 for k in order], np.int64)  # ascending, as lengths are
    kinds = {}
    for w in np.unique(words).tolist():
        lo, hi = np.searchsorted(words, [w, w + 1]).tolist()
        kinds[w] = lo, hi, np.frombuffer(b"".join(marks[k] for k in order[lo:hi]), np.uint64).reshape(-1, w)
    label = np.arange(len(n))
    for i, first in enumerate(np.searchsorted(n, -(-percent * n // 100)).tolist()):
        own = kinds[int(words[i])]
        x, found = own[2][i - own[0]], []
        for w in sorted((w for w in kinds if w <= words[i]), reverse=True):
            lo, hi, rows = kinds[w]
            while len(x) > w:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            js = np.arange(max(lo, first), min(hi, i))
            if side[i] in (0, 1, 4):
                js = js[side[js] != side[i]]
            if len(js):
                total = n[js] + n[i]
                y = rows[js - lo] if len(js) <= js[-1] - js[0] else rows[js[0] - lo : js[-1] + 1 - lo]
                found.append(js[np.bitwise_count(y ^ x).sum(axis=1, dtype=np.int64) <= total - 2 * _need(total, percent)])
        if found:
            joined = np.unique(np.append(label[np.concatenate(found)], label[i]))
            for k in joined[1:].tolist():
                label[label == k] = joined[0]
    out = np.empty(len(n), np.int64)
    out[order] = order[label]
    return out


def _key(docs: DataFrame):
    """Tells rows apart by doc_id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def _once(rows: DataFrame, key: str, repeated: DataFrame) -> DataFrame:
    """One row of each key: only rows of the repeated keys, if there are any, are shuffled."""
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").dropDuplicates([key]))


def _met_edges(met: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges whose components hold every link of `met` (gram, rep, n, own, rung): who shares a prefix n-gram on a rung.

    Elements common to two sets up to the lesser of their prefixes' ends are in both prefixes, and at most the rest of
    the set with that prefix follows; so a pair's overlap is at most the n-grams that it shares here, and the longer
    rest. N-grams of more than LIST classes aren't paired: the lesser number that the two have of them is added.
    """
    lists = met.groupBy("gram", "rung").agg(F.min("rep").alias("b"), F.max("rep").alias("top"), F.count("*").alias("k")).where("b < top").select("gram", "rung", "b", "k")
    listed = met.join(lists, ["gram", "rung"])
    large = listed.where(F.col("k") > LIST)
    # the rungs of a pair's own lengths meet on the higher of them alone, so there each n-gram counts once
    both = f"""flatten(transform(l, x -> transform(filter(l, y -> y.rep > x.rep and greatest(x.own, y.own) = rung
        and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)), y -> struct(x.rep as a, y.rep as b, x.n as na, y.n as nb))))"""
    small = listed.where(F.col("k") <= LIST).groupBy("gram", "rung").agg(F.collect_list(F.struct("rep", "n", "own")).alias("l"))
    pairs = small.select("rung", F.explode(F.expr(both)).alias("p")).groupBy("rung", "p.a", "p.b", "p.na", "p.nb").agg(F.count("*").alias("c"))
    more = large.groupBy("rep", "rung").agg(F.count("*").alias("more"))
    of = lambda side: more.select(F.col("rep").alias(side), "rung", F.col("more").alias(f"more_{side}"))
    pairs = pairs.join(of("a"), ["a", "rung"], "left").join(of("b"), ["b", "rung"], "left")
    known = F.col("c") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    rest = F.expr(f"({percent} * greatest(na, nb) + 99) div 100 - 1")
    need = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    return pairs.where(known + rest >= need).select("a", "b").union(large.select(F.col("rep").alias("a"), "b"))


def _sized(member: DataFrame, shingles: int) -> DataFrame:
    """`member` (component, rung, n and more) with the blocks of its family in all and of the family's fullest rung."""
    load = F.greatest(F.count("*") / BLOCK, F.sum("n") / shingles)
    sizes = member.groupBy("component", "rung").agg(load.alias("k")).groupBy("component").agg(F.sum("k").alias("whole"), F.max("k").alias("most"))
    return member.join(sizes, "component")


def _cells(member: DataFrame, *more: str) -> DataFrame:
    """node, component, key and more columns of sized members, once for each task (component, low, high) that compares them, with a side."""
    # one block for a small family; else by rung, whose neighbours alone can link, and by a hash
    salts = F.ceil("most").cast("int")
    small = F.col("whole") <= 1
    member = member.select("node", "component", "key", *more, small.alias("small"), salts.alias("salts"), F.when(small, 0).otherwise(F.col("rung")).alias("rung"), F.when(small, 0).otherwise(F.pmod(F.xxhash64("node"), salts)).cast("int").alias("salt"))
    # a task holds one family; or a rung and the rung above; or two blocks of one rung or of neighbouring ones
    here = F.struct("rung", "salt")
    cell = lambda low, high, side: F.struct(low.alias("low"), high.alias("high"), side.alias("side"))
    at = lambda r: F.struct(r.alias("rung"), F.lit(0).alias("salt"))
    blocks = F.flatten(F.transform(F.array(F.col("rung") - 1, F.col("rung"), F.col("rung") + 1), lambda r: F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: F.struct(r.alias("rung"), k.cast("int").alias("salt")))))
    cells = F.when(F.col("small"), F.array(cell(here, here, F.lit(2)))).when(F.col("salts") == 1, F.array(cell(here, at(F.col("rung") + 1), F.lit(3)), cell(at(F.col("rung") - 1), here, F.lit(4))))
    cells = cells.otherwise(F.transform(blocks, lambda o: cell(F.least(here, o), F.greatest(here, o), F.when(here == o, 2).when(here < o, 0).otherwise(1))))
    return member.select("node", "component", "key", *more, F.explode(cells).alias("c")).select("node", "component", "key", *more, "c.*")


def jaccard_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text; other columns are ignored).

    Two documents link when their sets of n-word shingles have 100 * intersection >= percent * union; component_id is
    the least doc_id reachable by links. A null text, or one without words, has an empty set and links with nothing.
    Rows with a null doc_id are answered, with the least doc_id of their group, or null. Repeated rows and texts are
    answered each; rows that share a doc_id are linked by their own texts. An empty table gives no rows.

    Plan: equal sets become a class, represented by its row of the least doc_id, by partial minima. Each class deals out the
    prefix of its set, rarest shingles first. Two sets that link share a prefix shingle and stand on one rung of a
    ladder of lengths or on neighbouring ones. Where at most LIST classes share one there, they are paired, and a pair
    joins if the shingles that both prefixes hold, and what can follow them, reach the overlap that a link needs; where
    more do, all are joined with the least of them. The components of that join are families that hold every link. Families are compared in tasks of bounded blocks, by
    rungs and within one by a hash; they return stars, at most a row a document. A family beyond a block, which may be a chain
    of chance, is first taken apart by marks, parities of a set's hashes that bound the overlap of two from above: pairs that
    they allow make its families, and only those texts are dealt out. Exact copies are never paired, nor pairs of one component verified again,
    so no pair is ever a row. The driver holds COUNTERS bytes.
    """
    return _grouped(docs, n, percent)[0].select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, component_id, the row's key and the key of its group's first row; and keys that stand in several rows."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"], _key(docs).alias("key"))
    levels = spark.sparkContext.broadcast(rarity(docs))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            rows: list[tuple] = []
            for s, ordered in shingles(part.column("text").to_pylist(), n, levels.value):
                head = ordered[: len(s) - -(-percent * len(s) // 100) + 1] if len(s) else s
                rows.append((len(s), *_set_hash(s), head.view(np.int64), mark(s, percent)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.binary())], ["doc_id", "key", "n_shingles", "h1", "h2", "prefix", "mark"])

    prefixed = written(docs.mapInArrow(tidied(prefixes), "doc_id long, key long, n_shingles long, h1 long, h2 long, prefix array<long>, mark binary"), "prefixed")
    sets = written(prefixed.drop("prefix", "mark"), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = prefixed.where("n_shingles > 0").groupBy("h1", "h2").agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("mark").alias("mark"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    drop_written(prefixed)
    repeated = sets.where("n_shingles > 0").groupBy("key").count().where("count > 1").select("key")
    # a link bridges at most one rung of this ladder of lengths
    step = float(np.log(100 / percent)) * (1 + 1e-9)
    rung = F.floor(F.log("n") / step).cast("int")
    grams = classes.select("rep", "n", F.explode("prefix").alias("gram"))
    shared = grams.groupBy("gram").agg(F.min("rep").alias("least"), F.max("rep").alias("top")).where("least < top").select(F.col("gram").alias("g"))
    met = written(grams.join(shared, F.col("gram") == F.col("g")).select("gram", "rep", "n", rung.alias("own"), F.explode(F.array(rung, rung + 1)).alias("rung")), "met")
    reps = written(classes.select(F.col("rep").alias("node"), "first", "n", "h1", "h2", "mark"), "reps")
    drop_written(classes)  # prefixes are read no more
    edges = written(_met_edges(met, percent), "met-edges")
    drop_written(met)
    family = written(components(edges), "families")
    drop_written(edges)

    member = _sized(family.join(reps.select("node", F.col("first.key").alias("key"), "n"), "node").withColumn("rung", rung), SHINGLES)
    large = written(member.where("whole > 1").select("node", "component", "key", "n", "rung"), "large")
    if not large.isEmpty():

        def near(rows: pd.DataFrame) -> pd.DataFrame:
            node = rows["node"].to_numpy()
            up = near_blocks([bytes(m) for m in rows["mark"]], rows["n"].to_numpy(), rows["side"].to_numpy(), percent)
            moved = np.flatnonzero(up != np.arange(len(up)))
            return pd.DataFrame({"a": node[moved], "b": node[up[moved]]})

        marked = _cells(_sized(large, MARKED), "n").join(reps.select("node", "mark"), "node")
        allowed = components(marked.groupBy("component", "low", "high").applyInPandas(near, "a long, b long"))
        family, chained = written(family.join(large.select("node"), "node", "left_anti").unionByName(allowed), "near-families"), family
        drop_written(chained)
        member = _sized(family.join(reps.select("node", F.col("first.key").alias("key"), "n"), "node").withColumn("rung", rung), SHINGLES)
    drop_written(large)
    dealt = _cells(member)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):  # the shuffle carries each text in a third of its bytes
            zipper = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([zipper.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()], pa.binary())], ["key", "text"])

    squeezed = docs.select("key", "text").mapInArrow(tidied(squeeze), "key long, text binary")
    texts = dealt.join(_once(squeezed, "key", repeated), "key").select("component", "low", "high", "side", "node", "text")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        unzip, texts, sets, held = zstandard.ZstdDecompressor().decompress, [], [], 0
        for k, packed in enumerate(rows["text"]):
            texts.append(unzip(bytes(packed)).decode("utf-8", "surrogatepass"))
            held += len(texts[-1])
            if held > SLICE or k + 1 == len(rows):
                sets += [ordered for _, ordered in shingles(texts, n, levels.value)]
                texts, held = [], 0
        node, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        # a block that meets itself is one block; of two, the same side's pairs belong to another task
        forest = linked_blocks(sets, side, percent)
        up = forest.roots()
        moved = np.flatnonzero(up != np.arange(len(up)))
        return pd.DataFrame({"a": node[moved], "b": node[up[moved]]})

    links = texts.groupBy("component", "low", "high").applyInPandas(compare, "a long, b long")
    linked = components(links)
    own = reps.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leasts = own.groupBy("component").agg(F.min("first").alias("least"))
    groups = own.join(leasts, "component").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "least")
    out = sets.join(groups, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    alone = F.col("least").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), "key", F.when(alone, F.col("key")).otherwise(F.col("least.key")).alias("first_key")), repeated


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set of shingles."""
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def one_of_each_group(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of `docs`, with all their columns, one of each group: that of the least doc_id, a null one coming last.

    Rows are judged one by one, so rows that share a doc_id but not a text stay or go by their own groups; of rows equal in
    doc_id and text one stays. Rows without words belong to no group and stay, repeated or not.
    """
    rows, repeated = _grouped(docs, n, percent)
    gone = rows.where("key <> first_key").select(F.col("key").alias("_gone")).distinct()
    left = docs.withColumn("_key", _key(docs)).join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    return _once(left, "_key", repeated.withColumnRenamed("key", "_key")).drop("_key")
