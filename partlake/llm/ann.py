"""Nearest neighbours by inner product: anisotropic product quantisation, four-bit table scans, exact reranking.

A vector is cut into pairs of components, each quantised to one of 16 centres. Centres and codes minimise a score-aware
loss: the residual's part along the vector costs more than the part across it, since it is what errs for the queries
that the vector matters to. Codebooks are fitted on a bounded sample; every row is coded.

A query's inner products with the centres are a table; two neighbouring codes are looked up as one byte. The best by
these sums, many times the wanted number, are reranked by exact inner products in double precision.

Every row is dealt to one chunk of bounded bytes, and each query goes to every chunk; a task codes a chunk once, holds it,
and lets its queries stream past. So vectors are shuffled once, and queries as often as there are chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partlake.session import ship

CENTRES = 16
SUB = 2  # components of a subspace
SAMPLE_VECTORS = 8_000
ROUNDS = 8
THRESHOLD = 0.2  # of the score-aware weight: inner products from this share of the norms on matter
CHUNK_BYTES = 64 << 20  # of a chunk's vectors
LEAST_CHUNK = 1_000  # vectors of a chunk, about, where there are more cores than chunks of that size
RERANK = 8  # times the wanted number, at least RERANK_LEAST
RERANK_LEAST = 200


@dataclass
class Index:
    """Codebooks (subspaces, CENTRES, SUB), and the weight of parallel residuals against orthogonal ones."""

    books: np.ndarray
    dimensions: int
    eta: float

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.books.shape[0] * SUB - x.shape[1])))

    def encode(self, x: np.ndarray, rounds: int = 1) -> np.ndarray:
        """Four-bit codes (rows, subspaces): nearest centres, then improved by coordinate descent on the score-aware loss."""
        m = len(self.books)
        y = self.padded(x).reshape(len(x), m, SUB)
        unit = y / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        gap = y[:, :, None, :] - self.books[None]  # rows, subspaces, centres, SUB
        square = (gap * gap).sum(axis=3)
        along = (gap * unit[:, :, None, :]).sum(axis=3)
        codes = square.argmin(axis=2)
        total = np.take_along_axis(along, codes[..., None], 2)[..., 0].sum(axis=1)
        for _ in range(rounds):
            for j in range(m):
                rest = total - along[np.arange(len(x)), j, codes[:, j]]
                loss = square[:, j] + (self.eta - 1) * (rest[:, None] + along[:, j]) ** 2
                codes[:, j] = loss.argmin(axis=1)
                total = rest + along[np.arange(len(x)), j, codes[:, j]]
        return codes.astype(np.uint8)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Codes of two subspaces in a byte."""
        codes = self.encode(x)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256) sums of both codes' inner products."""
        m = len(self.books)
        t = np.einsum("qjs,jcs->qjc", self.padded(q).reshape(len(q), m, SUB), self.books)
        if m % 2:
            t = np.concatenate([t, np.zeros((len(q), 1, CENTRES))], axis=1)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)


def fit(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> Index:
    """Codebooks of a sample: k-means centres, then alternating score-aware codes and least squares."""
    d = x.shape[1]
    m = -(-d // SUB)
    y = np.pad(x, ((0, 0), (0, m * SUB - d))).reshape(len(x), m, SUB)
    draw = np.random.default_rng(0)
    books = np.stack([y[draw.choice(len(x), CENTRES, replace=len(x) < CENTRES), j] for j in range(m)])
    eta = max(1.0, (d - 1) * threshold**2 / max(1e-9, 1 - threshold**2))
    index = Index(books, d, eta)
    for _ in range(rounds):
        for j in range(m):
            near = ((y[:, j, None, :] - index.books[j][None]) ** 2).sum(axis=2).argmin(axis=1)
            for c in range(CENTRES):
                if (own := near == c).any():
                    index.books[j, c] = y[own, j].mean(axis=0)
    unit = y / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for _ in range(rounds):
        codes = index.encode(x)
        got = np.take_along_axis(index.books[None], codes[:, :, None, None].astype(int), 2)[:, :, 0]
        total = ((y - got) * unit).sum(axis=(1, 2))
        for j in range(m):  # centres of one subspace at a time, the others' parallel residuals fixed
            u = unit[:, j]
            rest = total - ((y[:, j] - got[:, j]) * u).sum(axis=1)
            for c in range(CENTRES):
                own = codes[:, j] == c
                if not own.any():
                    continue
                uu = np.einsum("ns,nt->st", u[own], u[own])
                left = own.sum() * np.eye(SUB) + (eta - 1) * uu
                right = y[own, j].sum(axis=0) + (eta - 1) * (uu_y(u[own], y[own, j]) + (rest[own][:, None] * u[own]).sum(axis=0))
                index.books[j, c] = np.linalg.solve(left, right)
            got[:, j] = index.books[j][codes[:, j]]
            total = rest + ((y[:, j] - got[:, j]) * u).sum(axis=1)
    return index


def uu_y(u: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (u * (u * y).sum(axis=1, keepdims=True)).sum(axis=0)


def scan(codes: np.ndarray, tables: np.ndarray, many: int, out_of: np.ndarray) -> np.ndarray:
    """(queries, many) rows with the largest table sums; of equal sums those that stand first.

    ``out_of``: (queries, 2), where the rows that are passed over begin and end for each query; they come last, if at all.
    """
    out = np.empty((len(tables), min(many, len(codes))), np.int64)
    at = np.ascontiguousarray(codes.T).astype(np.intp)
    for k, table in enumerate(tables):
        sums = table[0].take(at[0])
        for j in range(1, len(table)):
            sums += table[j].take(at[j])
        sums[out_of[k, 0] : out_of[k, 1]] = -np.inf
        if len(sums) > many:
            edge = np.partition(sums, len(sums) - many)[len(sums) - many]
            above = np.flatnonzero(sums > edge)
            out[k] = np.concatenate([above, np.flatnonzero(sums == edge)[: many - len(above)]])
        else:
            out[k] = np.arange(len(sums))
    return out


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vector of rows that take part: not null or zero, no null or non-finite component."""
    v = F.col(vector_column).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_column).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Chunk:
    """Coded vectors, ids ascending, that queries are held against."""

    def __init__(self, index: Index, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.index, self.ids, self.v = index, ids[order], v[order]
        self.codes = np.concatenate([index.packed(self.v[k : k + 2048]) for k in range(0, len(v), 2048)])

    def best(self, queries: np.ndarray, q: np.ndarray, nearest: int, many: int) -> list[np.ndarray]:
        """query, id and exact score of the nearest found of each query."""
        out = []
        own = np.stack([np.searchsorted(self.ids, queries, side) for side in ("left", "right")], axis=1)
        for k in range(0, len(q), 64):
            for query, vector, rows in zip(queries[k : k + 64], q[k : k + 64], scan(self.codes, self.index.tables(q[k : k + 64]), many, own[k : k + 64])):
                rows = rows[self.ids[rows] != query]
                score = (self.v[rows] * vector).sum(axis=1)
                order = np.lexsort((self.ids[rows], -score))[:nearest]
                out.append((np.full(len(order), query), self.ids[rows][order], score[order]))
        return [np.concatenate(x) for x in zip(*out)]


def search(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, nearest: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` rows found for each id that is divisible by ``every``.

    Scores are exact inner products in double precision; ties go to the smaller id. An id asks once: of rows that share
    it, the one with the least vector. A query is not its own candidate, and neither is any row with its id. Other rows
    are candidates each, so a repeated one can take several ranks. Rows with a null id, a null or zero vector, or a null
    or non-finite component take no part; vectors have one length, that of most usable rows, and others take no part
    either. With fewer candidates all are returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = _usable(vectors, id_column, vector_column)
    lengths = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, total = lengths[0]["n"], lengths[0]["count"]
    usable = usable.where(F.size("v") == size)
    draw = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
    share = int(min(1.0, 1.5 * SAMPLE_VECTORS / total) * (1 << 30))
    drawn = usable.select("v", draw.alias("draw")).where(F.col("draw") < share).dropDuplicates(["draw"]).orderBy("draw").limit(SAMPLE_VECTORS).collect()
    index = fit(np.array([r["v"] for r in drawn]) if drawn else np.eye(size))
    shared = spark.sparkContext.broadcast(index)
    many = max(RERANK * nearest, RERANK_LEAST)
    cores = spark.sparkContext.defaultParallelism
    chunks = max(1, -(-total * size * 8 // chunk_bytes), min(2 * cores, total // LEAST_CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk, its vectors before its queries."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        own, chunk = None, None
        for batch in batches:
            keys, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ids, v = batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3))
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), len(keys)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if keys[a] != own:
                    own, chunk, held = keys[a], None, []
                if not asks[a]:
                    held.append((ids[a:z], v[a:z]))
                    continue
                if held:
                    chunk = Chunk(shared.value, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                    held = []
                if chunk is not None:
                    found = chunk.best(ids[a:z], v[a:z], nearest, many)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    place = F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).cast("int")
    rows = usable.select(place.alias("chunk"), F.lit(False).alias("asks"), "id", "v")
    asked = usable.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(True).alias("asks"), "id", "v")
    met = rows.unionByName(asked).repartition(chunks, "chunk").sortWithinPartitions("chunk", "asks")
    met = met.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= nearest)
