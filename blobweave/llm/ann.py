"""Nearest neighbours by inner product: anisotropic product quantisation, table scans, exact reranking.

Method: each pair of dimensions is coded with four bits. Codebooks and codes minimise the
score-aware loss that weighs the residual parallel to the vector more than the rest, by coordinate
descent over subspaces. A query's inner products with all codewords form tables; a scan sums
table entries by code; the best ``RERANK`` of a block, and those within the scan's usual error of them,
are scored with 16-bit components, which keeps vectors apart that lie close together and share codes. What may
still be among the best of all blocks is scored exactly on the original vectors.

The codebooks are fitted on at most ``SAMPLE`` vectors in expectation, chosen by a hash; every vector is
indexed, but of equal vectors only as many as one query can be given. Codes and queries are dealt into blocks of bounded
size and each pair of blocks is one group, so no task holds more than two blocks. Only codes and queries are sent to
the blocks; originals are joined with the merged candidates by vec_id, those that many queries share in parts.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without a vec_id; rows that repeat a vec_id count
once, with the smallest vector; ties go to the smaller vec_id; an empty table gives no rows; fewer
candidates than asked for give all of them; other columns than vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, join_split

SAMPLE = 6000
RERANK = 120
#: Of the root mean square error of an approximate score, for a query of length 1.
MARGIN = 1.5
CODE_BLOCK, QUERY_BLOCK = 65536, 8192
#: Blocks of codes that a smaller table is dealt into, so that all cores work.
LEAST_BLOCKS = 16
#: Standard errors of a score of 16-bit components by which a candidate may be behind.
BEHIND = 5.0
#: Inner products above this share of the norms count as high; it sets the weight of the parallel residual.
HIGH = 0.2


class Quantiser:
    """Codebooks of shape (subspaces, 16, width); an odd number of dimensions is padded with zeros."""

    def __init__(self, x: np.ndarray, width: int = 2, rounds: int = 10):
        self.dims, self.width = x.shape[1], width
        self.subspaces = -(-self.dims // (2 * width)) * 2  # an even number, as two codes share a byte
        self.weight = max(1.0, (self.dims - 1) * HIGH**2 / (1 - HIGH**2))
        z = self._split(x)
        rng = np.random.default_rng(0)
        pick = rng.choice(len(x), 16, replace=len(x) < 16)
        self.books = z[pick].transpose(1, 0, 2).copy()
        for m in range(self.subspaces):  # plain k-means to begin with
            for _ in range(8):
                at = ((z[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1)
                n = np.bincount(at, minlength=16)
                for d in range(width):
                    s = np.bincount(at, z[:, m, d], 16)
                    self.books[m, :, d] = np.where(n > 0, s / np.maximum(n, 1), self.books[m, :, d])
        for _ in range(rounds):
            self._update(z, self.encode(x))
        error = x - self.decode(self.encode(x))
        ask = x[:256] / np.sqrt((x[:256] ** 2).sum(1, keepdims=True))
        self.margin = MARGIN * float(np.sqrt(((error @ ask.T) ** 2).mean()))

    def _split(self, x: np.ndarray) -> np.ndarray:
        pad = self.subspaces * self.width - x.shape[1]
        return np.pad(x.astype(np.float64), ((0, 0), (0, pad))).reshape(len(x), self.subspaces, self.width)

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        return z / np.sqrt((z * z).sum((1, 2), keepdims=True))

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of shape (vectors, subspaces): nearest codewords, then coordinate descent on the score-aware loss."""
        z = self._split(x)
        unit = self._unit(z)
        codes = np.empty((len(z), self.subspaces), np.int64)
        parallel = np.zeros(len(z))
        every = np.arange(len(z))
        for m in range(self.subspaces):
            codes[:, m] = ((z[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1)
            parallel += ((z[:, m] - self.books[m][codes[:, m]]) * unit[:, m]).sum(1)
        for _ in range(sweeps):
            for m in range(self.subspaces):
                r = z[:, m, None] - self.books[m]
                along = (r * unit[:, m, None]).sum(2)
                rest = parallel - along[every, codes[:, m]]
                codes[:, m] = ((r * r).sum(2) + (self.weight - 1) * (rest[:, None] + along) ** 2).argmin(1)
                parallel = rest + along[every, codes[:, m]]
        return codes

    def _update(self, z: np.ndarray, codes: np.ndarray) -> None:
        """The least-squares codewords of the score-aware loss, one subspace after the other."""
        unit = self._unit(z)
        parallel = np.zeros(len(z))
        for m in range(self.subspaces):
            parallel += ((z[:, m] - self.books[m][codes[:, m]]) * unit[:, m]).sum(1)
        for m in range(self.subspaces):
            u = unit[:, m]
            rest = parallel - ((z[:, m] - self.books[m][codes[:, m]]) * u).sum(1)
            aim = z[:, m] + (self.weight - 1) * u * (rest + (z[:, m] * u).sum(1))[:, None]
            outer = (self.weight - 1) * u[:, :, None] * u[:, None, :] + np.eye(self.width)
            for c in range(16):
                mine = codes[:, m] == c
                if mine.any():
                    self.books[m, c] = np.linalg.solve(outer[mine].sum(0), aim[mine].sum(0))
            parallel = rest + ((z[:, m] - self.books[m][codes[:, m]]) * u).sum(1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[m][codes[:, m]] for m in range(self.subspaces)], axis=1)[:, : self.dims]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of a packed code the sum of both codewords' inner products: (queries, bytes, 256)."""
        products = np.einsum("qmw,mcw->qmc", self._split(q), self.books).astype(np.float32)
        return (products[:, 1::2, :, None] + products[:, ::2, None, :]).reshape(len(q), -1, 256)

    def scan(self, table: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate scores of one query; packed: (bytes, vectors)."""
        out = np.take(table[0], packed[0])
        for t, p in zip(table[1:], packed[1:], strict=True):
            out += np.take(t, p)
        return out


def usable(v: Column) -> Column:
    sound = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return v.isNotNull() & sound & F.exists(v, lambda c: c != 0)


def likely(scores: np.ndarray, n: int, margin: float) -> np.ndarray:
    """Indexes of the n largest approximate scores, and of all that are less by the margin at most.

    Vectors that lie close together share codes; the margin keeps all of them for the exact scores.
    """
    if len(scores) <= n:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n] - margin)


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit components and the unit of each row."""
    unit = np.abs(x).max(1) / 32767
    return np.rint(x / unit[:, None]).astype(np.int16), unit


def search(vectors: DataFrame, is_query: Column, k: int = 20, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score). vectors: vec_id, embedding; is_query: over vec_id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    sound = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding")
    table = scratch.save(sound.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    lengths = table.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, n = lengths["d"], lengths["count"]
    table = table.where(F.size("embedding") == dims)
    draw = F.pmod(F.xxhash64("vec_id", F.lit("codebooks")), F.lit(1 << 20)) < min(1.0, sample / n) * (1 << 20)
    x = matrix(table.where(draw | (F.lit(n) < 64)).orderBy("vec_id").limit(2 * sample).select("embedding").toArrow()["embedding"])
    quantiser = Quantiser(x if len(x) else matrix(table.orderBy("vec_id").limit(64).select("embedding").toArrow()["embedding"]))

    def index(batches):
        for b in batches:
            if len(b):
                v = matrix(b.column("embedding"))
                packed = quantiser.pack(quantiser.encode(v))
                fine, unit = rounded(v)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array([p.tobytes() for p in fine], pa.binary()), pa.array(unit)], names=["vec_id", "code", "fine", "unit"])

    equal = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    few = table.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1).select("vec_id", "embedding")
    indexed = scratch.save(few.mapInArrow(index, "vec_id bigint, code binary, fine binary, unit double"))
    queries = table.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    code_blocks = max(-(-n // CODE_BLOCK), min(LEAST_BLOCKS, -(-n // 1024)))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def block(by: str, count: int) -> Column:
        return F.pmod(F.xxhash64(by, F.lit("block")), F.lit(count))

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = queries.withColumn("qb", block("query_id", query_blocks)).withColumn("cb", each(code_blocks))
    right = indexed.withColumn("cb", block("vec_id", code_blocks)).withColumn("qb", each(query_blocks))

    def scan(q: pa.Table, c: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        if len(q) and len(c):
            ids, unit = c["vec_id"].to_numpy(), c["unit"].to_numpy()
            packed = np.frombuffer(b"".join(c["code"].to_pylist()), np.uint8).reshape(len(c), -1).T.copy()
            fine = np.frombuffer(b"".join(c["fine"].to_pylist()), np.int16).reshape(len(c), -1)
            want = matrix(q["query"])
            norms = np.sqrt((want * want).sum(1))
            for first in range(0, len(q), 64):
                for i, t in enumerate(quantiser.tables(want[first : first + 64]), first):
                    own = q["query_id"][i].as_py()
                    near = likely(quantiser.scan(t, packed), rerank + 1, quantiser.margin * norms[i])
                    near = near[ids[near] != own]
                    close = (fine[near] @ want[i]) * unit[near]
                    slack = BEHIND * norms[i] * unit[near].max(initial=0) / np.sqrt(12)
                    top = likely(close, k, 2 * slack)
                    found[0].append(np.full(len(top), own))
                    found[1].append(ids[near[top]])
                    found[2].append(close[top])
                    found[3].append(np.full(len(top), slack))
        return pa.table({c: np.concatenate(f) for c, f in zip(("query_id", "vec_id", "close", "slack"), found, strict=True)})

    result = "query_id bigint, vec_id bigint, close double, slack double"
    blocks = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(scan, result)
    every = Window.partitionBy("query_id")
    placed = blocks.withColumn("place", F.row_number().over(every.orderBy(F.desc("close"))))
    last = F.max(F.when(F.col("place") == k, F.col("close"))).over(every)
    near = placed.withColumn("last", last).withColumn("slack", F.max("slack").over(every)).where(F.col("last").isNull() | (F.col("close") >= F.col("last") - 2 * F.col("slack")))
    near = scratch.save(near.select("query_id", "vec_id"))
    scored = join_split(near, table, "vec_id").join(queries, "query_id")

    def exact(batches):
        for b in batches:
            if len(b):
                score = (matrix(b.column("embedding")) * matrix(b.column("query"))).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])

    scored = scored.select("query_id", "vec_id", "embedding", "query").mapInArrow(exact, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
