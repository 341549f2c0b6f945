"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

For unit vectors, cosine >= t means a distance of at most r = sqrt(2 - 2t). A list is probed if the query lies within
r * min(1, SPREAD / sqrt(dimension)) of the plane that separates the list's cell from the query's own: a pair's difference
has a component of r / sqrt(dimension) along a given direction by the root mean square, so SPREAD counts such deviations.
Up to SPREAD ** 2 dimensions that is r itself, and no link can be lost; beyond, a link is lost only if its difference
points at the plane. A member is reranked if its table-lookup distance is at most r plus the member's own quantisation
error, which follows from the triangle inequality and loses nothing. Centroids and codes are fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .runtime import drop_written, tidied, written

#: Vectors a list that centroids and codes are fitted on; least and most lists (between them, the square root of the largest
#: label's vectors); parts of a vector; codes of a part.
SAMPLE, LISTS, PARTS, CODES = 64, (32, 2048), 8, 256
#: Deviations that a probe allows for.
SPREAD = 5.0
#: Members and queries of a list that one task compares, at most; longer lists are cut into blocks by a hash.
BLOCK = 2048


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    own = np.square(c).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *((own - 2 * x[k : k + 4096] @ c.T).argmin(1) for k in range(0, len(x), 4096))])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 0.5 to 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(k, len(c))).astype(int)]
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.stack([np.bincount(at, x[:, j], minlength=len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Quantizer:
    """Coarse centroids, and a codebook of residuals for each part of a vector."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.centroids = _k_means(sample, lists, 8)
        residual = sample - self.centroids[_nearest(sample, self.centroids)]
        edges = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.books = [_k_means(residual[:, p], CODES, 6) for p in self.parts]

    def assign(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Own list, codes, quantisation error, and which lists a query must probe."""
        c = self.centroids
        d2 = np.square(x).sum(1)[:, None] - 2 * x @ c.T + np.square(c).sum(1)
        home = d2.argmin(1)
        apart = np.sqrt(np.maximum(np.square(c).sum(1)[:, None] - 2 * c @ c.T + np.square(c).sum(1), 0))[home]
        near = radius * min(1.0, SPREAD / np.sqrt(x.shape[1]))
        probe = d2 - d2[np.arange(len(x)), home][:, None] <= 2 * apart * near + 1e-9
        residual = x - c[home]
        codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        kept = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return home, codes, np.sqrt(np.square(residual - kept).sum(1)), probe

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the members of list `at` by their codes alone."""
        residual = queries - self.centroids[at]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            r = residual[:, p]
            lookup = (np.square(r).sum(1)[:, None] - 2 * r @ b.T + np.square(b).sum(1)).astype(np.float32)
            total += lookup[:, codes[:, i]]
        return total


def _matrix(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, dim)


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding, label; others are ignored).

    Vectors link if their labels (of any type that casts to a string) are equal and not null, their dimensions are equal
    and their cosine is >= `cosine`, whatever their magnitudes.
    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing. n_links counts the
    rows linked directly, equal vectors included; component_id is the least vec_id reachable; kept tells whether that
    is the row's own. Rows of a null or repeated vec_id are vectors like others, linked by their own embeddings; a
    component without any vec_id is null, and its rows are kept. An empty table gives no rows.

    Plan: equal rows (label and vector) become a class of counted rows by partial aggregation. A class goes to its own
    list as a member and, as a query, to each later list that it must probe, so a pair is met once. Blocks of members
    and queries are compared in tasks of at most BLOCK by BLOCK; each returns a row per linked vector (count, star),
    never pairs. The driver holds the sample's vectors and the model, both of bounded size. A dimension that the sample
    doesn't hold has few vectors: it is one list, whose members are all reranked.
    """
    spark = vectors.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    e = F.col("embedding")
    usable = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), e.cast("array<double>").alias("embedding")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("k1", F.when(F.col("usable"), F.xxhash64("label", "embedding"))).withColumn("k2", F.when(F.col("usable"), F.xxhash64(F.lit(1), "label", "embedding")))
    classes = written(rows.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("node", F.monotonically_increasing_id()), "vectors")

    models: dict[int, Quantizer] = {}
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    lists = int(min(max(LISTS[0], np.sqrt(most)), LISTS[1]))
    picked = classes.orderBy(F.xxhash64("k1"), "k1", "k2").limit(SAMPLE * lists).select("embedding").toPandas()["embedding"]
    for dim, own in picked.groupby(picked.map(len)):
        x = _scaled(np.stack(own.to_list()))
        models[int(dim)] = Quantizer(x / np.linalg.norm(x, axis=1)[:, None], lists)
    shared = spark.sparkContext.broadcast(models)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.select(["node", "mult", "label"]).to_pandas().assign(vec=[np.array(v) for v in batch.column("embedding").to_pylist()])
            for dim, own in found.groupby(found["vec"].map(len)):
                x = np.stack(own["vec"].to_list())
                x = _scaled(x)
                raw = [v.tobytes() for v in x]
                x = x / np.linalg.norm(x, axis=1)[:, None]
                n = len(x)
                if int(dim) in shared.value:
                    home, codes, error, probe = shared.value[int(dim)].assign(x, radius)
                else:  # a dimension that the sample doesn't hold: one list, all members reranked
                    home, codes, error, probe = np.zeros(n, int), np.zeros((n, 0), np.uint8), np.full(n, np.inf), np.zeros((n, 1), bool)
                probe &= np.arange(probe.shape[1]) > home[:, None]
                q, lists = np.nonzero(probe)
                at = np.concatenate([np.arange(n), q])
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "node": own["node"].to_numpy()[at], "mult": own["mult"].to_numpy()[at], "label": own["label"].to_numpy()[at], "dim": int(dim), "list": np.concatenate([home, lists]), "query": np.arange(len(at)) >= n,
                    "vec": [raw[i] for i in at], "codes": [codes[i].tobytes() for i in at], "error": error[at]}), schema=pa.schema([("node", pa.int64()), ("mult", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("list", pa.int32()), ("query", pa.bool_()), ("vec", pa.binary()), ("codes", pa.binary()), ("error", pa.float64())]), preserve_index=False)

    dealt = written(classes.mapInArrow(tidied(deal), "node long, mult long, label string, dim int, list int, query boolean, vec binary, codes binary, error double"), "lists")
    sizes = dealt.groupBy("label", "dim", "list").agg(F.ceil(F.count_if(~F.col("query")) / BLOCK).cast("int").alias("mbs"), F.ceil(F.count_if("query") / BLOCK).cast("int").alias("qbs"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    cell = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.alias("side"))
    upto = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f))
    placed = dealt.join(sizes, ["label", "dim", "list"]).withColumn("mb", block(F.col("mbs"))).withColumn("qb", block(F.col("qbs")))
    within = upto("mbs", lambda o: cell(0, F.least("mb", o), F.greatest("mb", o), F.when(F.col("mb") == o, 2).when(F.col("mb") < o, 0).otherwise(1)))
    asked = upto("qbs", lambda o: cell(1, F.col("mb"), o, F.lit(0)))
    asks = upto("mbs", lambda o: cell(1, o, F.col("qb"), F.lit(1)))
    none = F.array().cast("array<struct<kind:int,low:int,high:int,side:int>>")
    cells = placed.select("node", "mult", "label", "dim", "list", "vec", "codes", "error", F.explode(F.when(F.col("query"), F.coalesce(asks, none)).otherwise(F.concat(F.coalesce(within, none), F.coalesce(asked, none)))).alias("c")).select("*", "c.*").drop("c")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        dim, at, side = int(rows["dim"].iat[0]), int(rows["list"].iat[0]), rows["side"].to_numpy()
        node, mult, x = rows["node"].to_numpy(), rows["mult"].to_numpy(), _matrix(rows["vec"], dim)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        norms = np.sqrt(np.square(x).sum(1))
        members = np.flatnonzero(side != 1)
        queries = members if side[0] == 2 else np.flatnonzero(side == 1)
        model, links, forest = shared.value.get(dim), np.zeros(len(node), np.int64), Forest(len(node))
        codes = np.frombuffer(b"".join(rows["codes"].to_numpy()[members]), np.uint8).reshape(len(members), -1)
        bound = np.square(radius + rows["error"].to_numpy()[members] + 1e-3)
        for k in range(0, len(queries), 256):
            q = queries[k : k + 256]
            near = model.distances(unit[q], at, codes) <= bound if model is not None else np.ones((len(q), len(members)), bool)
            if side[0] == 2:
                near &= members[None, :] > q[:, None]
            some = np.flatnonzero(near.any(1))
            if not len(some):
                continue
            exact = (x[q[some]] @ x[members].T) / (norms[q[some]][:, None] * norms[members])
            linked = near[some] & (exact >= cosine)
            links[q[some]] += linked @ mult[members]
            links[members] += mult[q[some]] @ linked
            for i, row in zip(q[some].tolist(), linked, strict=True):
                for j in np.unique(forest.up[members[row]]).tolist():
                    forest.join(i, j)
        up, own = forest.roots(), np.flatnonzero(links)
        return pd.DataFrame({"node": node[own], "links": links[own], "star": node[up[own]]})

    found = written(cells.groupBy("label", "dim", "list", "kind", "low", "high").applyInPandas(compare, "node long, links long, star long"), "links")
    drop_written(dealt)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("node").alias("a"), F.col("star").alias("b")))
    own = classes.select("k1", "k2", "node", "rep", "mult").join(counts, "node", "left").join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leasts = own.groupBy("component").agg(F.min("rep").alias("least"))
    info = own.join(leasts, "component").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "least")
    out = rows.join(info, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
