"""Similarity of a target material to donors: eligibility, scores, top neighbours, estimates.

Pairs meet by an equality join on their partition (and are pruned to the k best by a window); a partition may be hot, so
callers give a finer ``block`` where one is known.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.functions.semantics import known

#: Fixed policy values.
WEIGHTS = {"structured": 0.40, "text": 0.40, "business": 0.20}
EMBEDDING_SHARE = 0.6
FLOOR, TOP, MIN_NEIGHBOURS, MIN_HISTORY = 0.60, 5, 2, 12


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [0, 1] to six places; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.round(F.least(F.greatest(dot(a, b) / norm, F.lit(0.0)), F.lit(1.0)), 6))


def categorical(a: Column, b: Column) -> Column:
    """Similarity 1 or 0; unknown contributes nothing."""
    return F.when(known(a, b), (F.upper(a.cast("string")) == F.upper(b.cast("string"))).cast("double"))


def numeric(a: Column, b: Column, spread: float) -> Column:
    """1 less the share of the population's spread that lies between the values."""
    return F.when(known(a, b), 1 - F.least(F.abs(a - b) / spread, F.lit(1.0)) if spread > 0 else F.lit(1.0))


def mean_known(*scores: Column) -> Column:
    """Mean of the known scores; null if none is. Plain arithmetic, so that it compiles with the join."""
    top, n = F.lit(0.0), F.lit(0)
    for score in scores:
        top = top + F.coalesce(score, F.lit(0.0))
        n = n + score.isNotNull().cast("int")
    return F.when(n > 0, top / n)


def log_price(a: Column, b: Column, spread: float) -> Column:
    return F.when((a > 0) & (b > 0), numeric(F.log(a), F.log(b), spread))


def business(maker_a: Column, maker_b: Column, price_a: Column, price_b: Column, spread: float) -> Column:
    """Mean of same manufacturer and log-price proximity, of what is known."""
    return mean_known(categorical(maker_a, maker_b), log_price(price_a, price_b, spread))


def text_dimension(cosine_score: Column, fuzzy_score: Column) -> Column:
    """0.6 of the embeddings' cosine and 0.4 of the token ratios; the one that is known where the other is not."""
    both = EMBEDDING_SHARE * cosine_score + (1 - EMBEDDING_SHARE) * fuzzy_score
    return F.coalesce(both, cosine_score, fuzzy_score)


def combine(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the dimensions that are known, weights renormalised."""
    w = weights or WEIGHTS
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, score in scores.items():
        top = top + F.coalesce(score, F.lit(0.0)) * w[name]
        bottom = bottom + F.when(score.isNotNull(), w[name]).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def normalise_description(c: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """Upper-case words and numbers, abbreviations spelt out."""
    words = F.split(F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " ")), " ")
    if abbreviations:
        table = F.create_map(*[F.lit(x) for pair in abbreviations.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(table[w], w))
    return F.array_join(words, " ")


def _indel(a: str, b: str) -> float:
    """1 less insertions and deletions over both lengths, by the longest common subsequence in bit vectors."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    common = len(a) - s.bit_count()
    return 2 * common / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return _indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of: common words against each side's common and own words, and the two sides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(filter(None, [both, " ".join(sorted(x - y))])), " ".join(filter(None, [both, " ".join(sorted(y - x))]))
    if both and (not x - y or not y - x):
        return 1.0
    return max(_indel(left, right), *([_indel(both, left), _indel(both, right)] if both else [0.0]))


def fuzzy(pairs: DataFrame, a: str, b: str, out: str = "fuzzy") -> DataFrame:
    """Mean of token-set and token-sort ratios, over Arrow batches: no built-in has the insertion-deletion ratio."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else round((token_set_ratio(p, q) + token_sort_ratio(p, q)) / 2, 6) for p, q in zip(x, y)], dtype="float64")

    return pairs.withColumn(out, score(F.col(a), F.col(b)))


def eligibility(same_plant_required: bool = False) -> Column:
    """Why a donor (d_ columns) may not serve a target (t_ columns), in fixed order; null if it may."""
    reason = (
        F.when((F.col("t_id") == F.col("d_id")), "SAME_MATERIAL")
        .when(~F.col("d_active"), "INACTIVE")
        .when(F.col("d_partition").isNull() | (F.col("t_partition") != F.col("d_partition")), "OTHER_CRITICALITY")
        .when(F.coalesce(F.col("d_history"), F.lit(0)) < MIN_HISTORY, "SHORT_HISTORY")
    )
    return reason.when(F.col("t_plant") != F.col("d_plant"), "OTHER_PLANT") if same_plant_required else reason


def neighbours(targets: DataFrame, donors: DataFrame, score: Column, k: int = TOP, floor: float = FLOOR) -> DataFrame:
    """The k best donors of each target in its partition, admitted from the floor on; ties by donor id.

    Both sides carry t_/d_ columns with t_partition = d_partition; the floor filters before the window.
    """
    met = targets.join(donors, F.col("t_partition") == F.col("d_partition")).where(F.col("t_id") != F.col("d_id"))
    admitted = met.withColumn("score", F.round(score, 6)).where(F.col("score") >= floor)
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy(F.desc("score"), "d_id"))
    return admitted.withColumn("rank", rank).where(F.col("rank") <= k)


#: Donors that one task holds, donors under one bound, and targets that look for theirs together.
GOWER_SLICE, GOWER_CHUNK, GOWER_BLOCK = 1 << 15, 128, 256
#: A pair's place in a target's order as one exact double: millionths of the score that are missing, then the donor's id by rank.
GOWER_MOST, GOWER_RANKS = 1 << 20, 1 << 32


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; a nan is like a nan."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([(x[1:] != x[:-1]) & ((x[1:] == x[1:]) | (x[:-1] == x[:-1])) for x in columns], axis=0)
    return out


def _since(fresh: np.ndarray) -> np.ndarray:
    """Rows since the last fresh one."""
    at = np.arange(len(fresh))
    return at - np.maximum.accumulate(np.where(fresh, at, 0))


class GowerDonors:
    """A slice of donors in chunks of like ones, each with the bounds of its values: what a chunk can score at most is known
    before its donors are. A row is known (bits: type, size, price), code (of its type), size, price (its logarithm), id.

    Of donors that are alike in all but their id, the smallest ids win; those that can be among no target's ``k`` are left out.
    A type's donors lie in bands of sizes, and by price in a band.
    """

    def __init__(self, known: np.ndarray, code: np.ndarray, size: np.ndarray, price: np.ndarray, ids: np.ndarray, spreads: tuple[float, float], k: int) -> None:
        self.spreads, self.k = spreads, k
        order = np.lexsort((ids, price, size, code, known))
        like = _runs(*(x[order] for x in (known, code, size, price)))
        named = like | _runs(ids[order])
        before = np.cumsum(named)
        before -= np.maximum.accumulate(np.where(like, before, 0))
        order = order[(before <= k) & (_since(named) < k)]  # a target's own id may be one of them

        kind = _runs(known[order], code[order])
        first = np.flatnonzero(kind)
        group, count = np.cumsum(kind) - 1, np.diff([*first, len(order)])
        with np.errstate(invalid="ignore", divide="ignore"):
            wide = [np.nan_to_num(np.fmin((np.fmax.reduceat(x[order], first) - np.fmin.reduceat(x[order], first)) / spread, 1)) + 1e-3 for x, spread in zip((size, price), spreads)]
        chunks = np.ceil(count / GOWER_CHUNK)
        bands = np.clip(np.rint(np.sqrt(chunks * wide[0] / wide[1])), 1, chunks)
        band = _since(kind) // (GOWER_CHUNK * np.ceil(chunks / bands)).astype(int)[group]
        self.order = order = order[np.lexsort((price[order], band, group))]
        self.known, self.code, self.size, self.price, self.ids = (x[order] for x in (known, code, size, price, ids))

        # small types share chunks; a chunk's rows know the same
        large = (count >= GOWER_CHUNK)[group]
        cut = _runs(self.known) | (kind & (large | np.roll(large, 1)))
        self.starts = np.flatnonzero(_since(cut) % GOWER_CHUNK == 0)
        self.ends = np.append(self.starts[1:], len(order))
        self.by_id = np.argsort(self.ids, kind="stable")
        self.rank = np.empty(len(order))
        self.rank[self.by_id] = np.arange(len(order))
        low, high = ([f.reduceat(x, self.starts) for x in (self.code, self.size, self.price)] for f in (np.fmin, np.fmax))
        self.bounds, self.knows, self.least = list(zip(low, high)), self.known[self.starts], np.minimum.reduceat(self.rank, self.starts)

    def lost(self, known: int, kind: np.ndarray, size: np.ndarray, price: np.ndarray) -> np.ndarray | None:
        """Millionths below ``GOWER_MOST`` of the score, as high digits. Of equal types (or not) and distances, by what both sides
        know; the arithmetic of ``combine``, to six places."""
        near = lambda x, spread: 1 - np.fmin(x / spread, 1) if spread > 0 else np.ones(x.shape)
        structured = [x for bit, x in ((1, lambda: kind.astype(float)), (2, lambda: near(size, self.spreads[0]))) if known & bit]
        top, bottom = 0.0, 0.0
        if structured:
            top, bottom = sum(x() for x in structured) / len(structured) * WEIGHTS["structured"], WEIGHTS["structured"]
        if known & 4:
            top, bottom = top + near(price, self.spreads[1]) * WEIGHTS["business"], bottom + WEIGHTS["business"]
        return (GOWER_MOST - np.floor(top / bottom * 1e6 + 0.5)) * GOWER_RANKS if bottom else None

    def best(self, known: int, code: np.ndarray, size: np.ndarray, price: np.ndarray, ids: np.ndarray, floor: float) -> tuple[np.ndarray, ...]:
        """(target's place, donor's place, score) of the k best of each target; the targets know the same.

        In a round each target takes the chunk that may hold its best, until none can hold one before its k-th.
        """
        lowest = next((q for q in range(math.ceil(floor * 1e6) - 1, GOWER_MOST) if q / 1e6 >= floor), GOWER_MOST)
        none = float((GOWER_MOST - lowest + 1) * GOWER_RANKS)  # what the floor admits comes before it
        (c0, c1), (s0, s1), (p0, p1) = self.bounds
        away = lambda x, low, high: np.maximum(np.maximum(low - x, x - high), 0)
        may = np.full((len(ids), len(self.starts)), np.inf)
        found = np.full((len(ids), self.k), none)
        with np.errstate(invalid="ignore"):
            for own in np.unique(self.knows):
                at = np.flatnonzero(self.knows == own)
                c, s, p = code[:, None], size[:, None], price[:, None]
                lost = self.lost(known & own, (c >= c0[at]) & (c <= c1[at]), away(s, s0[at], s1[at]), away(p, p0[at], p1[at]))
                if lost is not None:
                    may[:, at] = lost + self.least[at]
            rows = np.arange(len(ids))
            while len(rows):
                chunk = may[rows].argmin(axis=1)
                fine = may[rows, chunk] < found[rows, self.k - 1]
                rows, chunk = rows[fine], chunk[fine]
                may[rows, chunk] = np.inf
                for own in np.unique(self.knows[chunk]):
                    at = self.knows[chunk] == own
                    t, places = rows[at], self.starts[chunk[at], None] + np.arange(GOWER_CHUNK)
                    outside = places >= self.ends[chunk[at], None]
                    places[outside] = 0
                    c, s, p = code[t, None], size[t, None], price[t, None]
                    keys = self.lost(known & own, c == self.code[places], np.abs(s - self.size[places]), np.abs(p - self.price[places])) + self.rank[places]
                    keys[outside | (self.ids[places] == ids[t, None])] = none
                    found[t] = np.partition(np.concatenate([found[t], keys], axis=1), self.k - 1, axis=1)[:, : self.k]
        row, j = np.nonzero(found < none)
        key = found[row, j]
        high = np.floor(key / GOWER_RANKS)
        return row, self.by_id[(key - high * GOWER_RANKS).astype(int)], (GOWER_MOST - high) / 1e6


def gower_top(targets: DataFrame, donors: DataFrame, size_spread: float, price_spread: float, k: int = TOP, floor: float = FLOOR, keep: tuple[str, ...] = (), slice_rows: int = GOWER_SLICE) -> DataFrame:
    """t_id, d_id, score, rank and the donor's ``keep`` columns: the rows of ``neighbours`` where type and size are the
    structured dimension and the logarithm of the price the business one, without a score for each pair.

    Both sides carry id (a long), partition, type, size and price with their prefix. A partition's donors are dealt to slices;
    its targets go to each of them. In a slice donors lie in chunks of like ones, and targets take chunks from the one that can
    score most, until no other can reach their k-th best. That skips donors only where it is proven that they lose.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        price = F.col(f"{p}_price")
        kept = F.struct(*[F.col(x) for x in keep]) if p == "d" and keep else F.lit(None).cast(held)
        return df.where(F.col(f"{p}_partition").isNotNull() & F.col(f"{p}_id").isNotNull()).select(
            F.col(f"{p}_partition").alias("p"), F.col(f"{p}_id").cast("long").alias("id"), F.upper(F.col(f"{p}_type").cast("string")).alias("type"),
            F.col(f"{p}_size").cast("double").alias("size"), F.when(price > 0, F.log(price)).alias("price"), kept.alias("kept"))

    held = donors.select(F.struct(*[F.col(x) for x in keep])).schema[0].dataType if keep else "int"
    own, asking = side(donors, "d"), side(targets, "t")
    sizes = own.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
    both = own.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True))).join(sizes, "p")
    slots = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")))
    dealt = both.select("p", F.explode(slots).alias("s"), "asks", "id", "type", "size", "price", "kept")

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """known, size, price, id"""
        known = sum(bit * batch.column(k).is_valid().to_numpy(zero_copy_only=False).astype(int) for bit, k in ((1, 4), (2, 5), (4, 6)))
        numbers = (batch.column(k).fill_null(0.0).to_numpy(zero_copy_only=False) for k in (5, 6))
        return known, *numbers, batch.column(3).to_numpy(zero_copy_only=False)

    def build(rows: list[pa.RecordBatch]) -> tuple[GowerDonors, pa.Array, pa.Array]:
        """Donors, their types by code and what is kept of them."""
        known, size, price, ids = map(np.concatenate, zip(*map(columns, rows)))
        types = pa.concat_arrays([x.column(4) for x in rows]).fill_null("").dictionary_encode()
        return GowerDonors(known, types.indices.to_numpy(), size, price, ids, (size_spread, price_spread), k), types.dictionary, pa.concat_arrays([x.column(7) for x in rows])

    def search(found: GowerDonors, names: pa.Array, kept: pa.Array, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, size, price, ids = columns(batch)
        code = pc.index_in(batch.column(4).fill_null(""), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
        for own in np.unique(known):
            order = np.flatnonzero(known == own)
            for at in range(0, len(order), GOWER_BLOCK):
                some = order[at : at + GOWER_BLOCK]
                row, place, score = found.best(int(own), code[some], size[some], price[some], ids[some], floor)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][row]), pa.array(found.ids[place]), pa.array(score), kept.take(pa.array(found.order[place]))], names=["t_id", "d_id", "score", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, found = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            differs = [pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False) for x in map(batch.column, range(3))]
            edges = [0, *(np.flatnonzero(np.any(differs, axis=0)) + 1).tolist(), batch.num_rows]
            for a, z in zip(edges, edges[1:]):
                *slot, asks = (batch.column(c)[a].as_py() for c in range(3))
                if slot != now:
                    rows, now, found = [], slot, None
                if not asks:
                    rows.append(batch.slice(a, z - a))
                elif rows:
                    found = found or build(rows)
                    yield from search(*found, batch.slice(a, z - a))

    met = dealt.repartition("p", "s").sortWithinPartitions("p", "s", "asks")
    kind = met.schema["kept"].dataType.simpleString()
    top = met.mapInArrow(run, f"t_id long, d_id long, score double, kept {kind}")
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy(F.desc("score"), "d_id"))
    return top.withColumn("rank", rank).where(F.col("rank") <= k).select("t_id", "d_id", "score", "rank", *[f"kept.`{x}`" for x in keep])


#: Bytes of vectors that are multiplied at once, and targets in a block.
SLICE_BYTES = 16 << 20
TARGET_BLOCK = 1024


def cosine_top(vectors: DataFrame, partition: str, id_column: str, vector: str, every: int, k: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The k nearest by cosine within a partition for each target (id divisible by ``every``), as blocks of matrix products.

    A partition's donors are dealt to as many slices as their bytes need, so a large one spreads over tasks; its targets go
    to each of its slices. Rows come sorted by slice, donors first: a task holds one slice while its targets stream past,
    and keeps k of them for each target. Vectors of a partition have one length.
    """
    base = vectors.select(F.col(partition).alias("p"), F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND p IS NOT NULL")
    sizes = base.groupBy("p").agg(F.greatest(F.ceil(F.sum(F.size("v") * 8) / slice_bytes), F.lit(1)).cast("int").alias("slices"))
    dealt = base.join(sizes, "p")
    donors = dealt.select("p", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("s"), F.lit(False).alias("asks"), "id", "v")
    targets = dealt.where(F.col("id") % every == 0).select("p", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"), F.lit(True).alias("asks"), "id", "v")

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def best(held: list[tuple], ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        own, donors = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        norms, out = np.linalg.norm(donors, axis=1), []
        for at in range(0, len(ids), TARGET_BLOCK):
            block = q[at : at + TARGET_BLOCK]
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.round(np.clip(block @ donors.T / np.outer(np.linalg.norm(block, axis=1), norms), 0, 1), 6)
            for target, row in zip(ids[at : at + TARGET_BLOCK], scores):
                fine = np.flatnonzero((own != target) & ~np.isnan(row))
                order = fine[np.lexsort((own[fine], -row[fine]))[:k]]
                out.append((np.full(len(order), target), own[order], row[order]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["t_id", "d_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            slots = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            asks, ids, v = batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
            edges = [0, *(i for i in range(1, len(slots)) if slots[i] != slots[i - 1] or asks[i] != asks[i - 1]), len(slots)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if slots[a] != now:
                    held, now = [], slots[a]
                if not asks[a]:
                    held.append((ids[a:z], matrix(v.slice(a, z - a))))
                elif held:
                    yield best(held, ids[a:z], matrix(v.slice(a, z - a)))

    met = donors.unionByName(targets).repartition("p", "s").sortWithinPartitions("p", "s", "asks")
    found = met.mapInArrow(run, "t_id long, d_id long, score double")
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy(F.desc("score"), "d_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def ensure_embeddings(texts: DataFrame, store: DataFrame, embed: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """The store (text, embedding) with a vector for every different normalised text that it lacked.

    ``embed`` gets a batch of texts and gives a row of floats for each; it runs once for a text, where the batch is. Null and
    blank texts have no vector. Look a text up by its normalised form.
    """
    fresh = texts.select(F.nullif(normalise_description(F.col(text)), F.lit("")).alias("text")).where("text IS NOT NULL").distinct().join(store.select("text"), "text", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0)
                vectors = np.asarray(embed(own.to_pylist()), np.float32)
                yield pa.RecordBatch.from_arrays([own, pa.array(list(vectors), pa.list_(pa.float32()))], names=["text", "embedding"])

    return store.select("text", "embedding").unionByName(fresh.mapInArrow(run, "text string, embedding array<float>"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def weighted_median(pairs: Column) -> Column:
    """Of (value, weight) structs: the value at which the running weight passes half, the midpoint at an exact half."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def step(s: Column, p: Column, total: Column) -> Column:
        run = s["sum"] + p["weight"]
        twice = F.round(2 * run - total, 9)
        low = F.coalesce(s["low"], F.when(twice >= 0, p["value"]))
        high = F.coalesce(s["high"], F.when(twice > 0, p["value"]))
        return F.struct(run.alias("sum"), low.alias("low"), high.alias("high"))

    middle = lambda done: (done["low"] + F.coalesce(done["high"], done["low"])) / 2
    walked = lambda x: _once(F.aggregate(x, F.lit(0.0), lambda s, p: s + p["weight"]), lambda total: _once(F.aggregate(x, start, lambda s, p: step(s, p, total)), middle))
    positive = F.array_sort(F.filter(pairs, lambda p: (p["weight"] > 0) & p["value"].isNotNull()))
    return _once(positive, lambda x: F.when(F.size(x) > 0, walked(x)))


def weighted_mean(value: Column, weight: Column) -> Column:
    fine = F.when(value.isNotNull() & (weight > 0), weight)
    return F.sum(value * fine) / F.sum(fine)


def estimate(found: DataFrame, fields: list[str], minimum: int = MIN_NEIGHBOURS) -> DataFrame:
    """Weighted medians of the neighbours' fields, whole units up; too few neighbours give a status and no values."""
    pairs = {f: F.collect_list(F.struct(F.col(f).cast("double").alias("value"), F.col("score").alias("weight"))) for f in fields}
    grouped = found.groupBy("t_id").agg(F.count(F.lit(1)).alias("neighbours"), F.max("score").alias("best"), *[c.alias(n) for n, c in pairs.items()])
    enough = F.col("neighbours") >= minimum
    values = [F.when(enough, F.ceil(F.round(weighted_median(F.col(f)), 6))).alias(f) for f in fields]
    return grouped.select("t_id", "neighbours", F.when(enough, "SUCCESS").otherwise("NOT_EVALUABLE_INSUFFICIENT_NEIGHBOURS").alias("status"), grade(F.col("neighbours"), F.col("best")).alias("confidence"), *values)


def grade(count: Column, best: Column) -> Column:
    return F.when((count >= 4) & (best >= 0.85), "HIGH").when((count >= 2) & (best >= 0.70), "MEDIUM").otherwise("LOW")


def precision_recall(ranked: DataFrame, relevant: DataFrame, k: int, total: DataFrame | None = None) -> DataFrame:
    """precision@k and recall@k of each target. ``ranked``: t_id, d_id, rank; ``relevant``: t_id, d_id, those of ranked pairs at
    least where ``total`` (t_id, relevant) counts a target's."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("t_id", "d_id", F.lit(1).alias("hit")), ["t_id", "d_id"], "left")
    per = hits.groupBy("t_id").agg(F.count(F.lit(1)).alias("shown"), F.count("hit").alias("hits"))
    total = relevant.groupBy("t_id").agg(F.count(F.lit(1)).alias("relevant")) if total is None else total
    return total.join(per, "t_id", "left").select("t_id", (F.coalesce("hits", F.lit(0)) / F.coalesce("shown", F.lit(1))).alias("precision"), (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"))


def same_class(pairs: DataFrame, targets: DataFrame, donors: DataFrame, classes: list[str]) -> DataFrame:
    """(t_id, d_id) of the ``pairs`` (t_id, d_id) whose rows are of one class, a row for each two rows of them; a class is large,
    so its pairs are not made. Nulls are in no class."""
    own = targets.select("t_id", *classes).join(pairs.select("t_id", "d_id").distinct(), "t_id")
    return own.join(donors.select("d_id", *classes), ["d_id", *classes]).where("t_id <> d_id").select("t_id", "d_id")


def class_totals(targets: DataFrame, donors: DataFrame, classes: list[str]) -> DataFrame:
    """(t_id, relevant): how many rows of its class each target has beside those of its own id, where it has any."""
    n = F.count(F.lit(1))
    sizes, own = donors.groupBy(*classes).agg(n.alias("all")), donors.groupBy(F.col("d_id").alias("t_id"), *classes).agg(n.alias("own"))
    met = targets.select("t_id", *classes).join(sizes, classes).join(own, ["t_id", *classes], "left")
    return met.groupBy("t_id").agg(F.sum(F.col("all") - F.coalesce("own", F.lit(0))).alias("relevant")).where("relevant > 0")


#: Values that a bootstrap draws at once, or those of one draw.
BOOTSTRAP_BLOCK = 1 << 18
#: Cells of the table of how often each draw takes each place, up to which keys of one size share it; means held at once.
BOOTSTRAP_TABLE, BOOTSTRAP_MEANS = 1 << 22, 1 << 20


def bootstrap_interval(rows: DataFrame, key: str, value: str, draws: int = 2000, percentile: float = 85.0, seed: int = 42) -> DataFrame:
    """Percentile of the bootstrapped mean of each key's values, seeded; drawn in blocks, which change no draw.

    Every key starts from the seed, so keys of one size draw the same places: the draws are made once for a size and a matrix
    product gives the means of all its keys (whole values: to the bit). Keys of equal values have one estimate.
    """
    kind, session = rows.schema[key].dataType.simpleString(), rows.sparkSession
    parts = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))

    def drawn(n: int) -> Iterator[np.ndarray]:
        """The places that each draw takes, a row for a draw."""
        rng, step = np.random.default_rng(seed), max(1, BOOTSTRAP_BLOCK // n)
        return (rng.integers(0, n, (min(step, draws - k), n)) for k in range(0, draws, step))

    def table(n: int) -> np.ndarray:
        """How often each draw (a column) takes each place."""
        counts = [np.bincount((at + n * np.arange(len(at))[:, None]).ravel(), minlength=at.size).reshape(at.shape) for at in drawn(n)]
        return np.ascontiguousarray(np.concatenate(counts).T, dtype=float)

    def estimates(x: np.ndarray, taken: np.ndarray | None) -> np.ndarray:
        """One for each row of sorted values."""
        n, out, step = x.shape[1], [], max(1, BOOTSTRAP_MEANS // draws)
        for k in range(0, len(x), step):
            some = x[k : k + step]
            if taken is not None and np.isfinite(some).all():
                means = some @ taken / n
            else:
                means = np.stack([np.concatenate([row[at].mean(axis=1) for at in drawn(n)]) for row in some])
            means.sort(axis=1)  # faster than a partition
            # as numpy's percentile goes between two; from a nan on all is nan
            low, part = divmod((draws - 1) * (percentile / 100), 1)
            a, b = means[:, int(low)], means[:, min(int(low) + 1, draws - 1)]
            between = a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part)
            out.append(np.where(np.isnan(means[:, -1]), np.nan, between))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, taken = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, n = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ends, found = np.cumsum(n), []
            edges = [0, *(np.flatnonzero(np.diff(n)) + 1), len(n)]
            for a, z in zip(edges, edges[1:]):
                if n[a] != size:
                    size, taken = n[a], table(n[a]) if draws * int(n[a]) <= BOOTSTRAP_TABLE else None
                x = flat[ends[a] - size : ends[z - 1]].reshape(-1, size)
                fresh = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
                found.append(estimates(x[fresh], taken)[np.cumsum(fresh) - 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.concatenate(found))], names=[key, "n", "estimate"])

    # draws do not hang on the order of rows
    own = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("x"))
    met = own.repartition(parts, F.xxhash64("x")).sortWithinPartitions(F.size("x"), F.xxhash64("x"))  # equal lists lie together
    return met.select(key, "x").mapInArrow(run, f"`{key}` {kind}, n long, estimate double")
