"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits through a pigeonring index.

The 64 bits are a ring of segments. If two fingerprints differ in at most ``t`` bits, then from some segment on every
chain of l consecutive segments differs in at most l * t / segments bits. So an exact segment with a next one that differs in at
most the budget of a chain of two is a key for an equality join: one side is stored under its exact bits, the other asks for
each variant within the budget. Longer chains prune what the join finds before the full Hamming check.

Only distinct fingerprints are indexed, so exact copies cost one row. A key that very many different fingerprints share is not
joined pairwise: two fingerprints within ``t`` bits have a common point within half of ``t`` of each, so those fingerprints meet
at the points around them, each point holding no more than a ball's volume. Components come from alternating star
contraction, a few joins and sums for each halving of the distances.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake.llm.common import map_batches
from partlake.session import cut_lineage

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
SEGMENTS = 5
#: Different fingerprints under one key beyond which they are linked through points and not in pairs.
CROWD = 256


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text; 0 if it has no words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*(s - 1 for s in starts[shingle:]), len(joined)]
    total, counts, ones = len(ends), None, np.zeros(64, np.int64)
    for k in range(0, total, 65536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + 65536], ends[k : k + 65536])], ">u8")
        counts = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        ones += counts.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set: the SimHash of a set; 0 if it is empty."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
        return {"id": batch.column(0), "fp": pa.array(fp.view(np.int64))}

    return map_batches(docs.select(id_column, text_column), make, f"id {kind}, fp bigint")


def layout(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment of the ring."""
    wide = 64 % segments
    widths = [64 // segments + (k < wide) for k in range(segments)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def bits(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def key_of(fp: Column, k: int, segments: int) -> Column:
    """Segment k, the one after it, and k as one long."""
    (a, wa), (b, wb) = layout(segments)[k], layout(segments)[(k + 1) % segments]
    return bits(fp, a, wa) + bits(fp, b, wb) * F.lit(1 << wa) + F.lit(k << (wa + wb))


def stored(fps: DataFrame, segments: int) -> DataFrame:
    """Each fingerprint under each of its exact keys."""
    return fps.select("fp", F.explode(F.array(*[key_of(F.col("fp"), k, segments) for k in range(segments)])).alias("key"))


def asked(fps: DataFrame, segments: int, most: int) -> DataFrame:
    """Each fingerprint under each key that a partner within a chain of two's budget is stored under."""
    budget, ring, keys = 2 * most // segments, layout(segments), []
    if most // segments:
        raise ValueError("the first segment of a chain must be exact: take more segments than bits")
    for k in range(segments):
        width, (_, wb) = ring[k][1], ring[(k + 1) % segments]
        base = key_of(F.col("fp"), k, segments)
        for n in range(budget + 1):
            for flips in combinations(range(wb), n):
                keys.append(base.bitwiseXOR(F.lit(sum(1 << (width + x) for x in flips))))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def chain(a: Column, b: Column, segments: int, most: int) -> Column:
    """Whether from some segment on all prefixes of the ring keep their proportional budgets."""
    x = a.bitwiseXOR(b)
    diffs = [F.bit_count(bits(x, s, w)) for s, w in layout(segments)]
    starts = []
    for k in range(segments):
        sums, tests = None, []
        for n in range(1, segments + 1):
            d = diffs[(k + n - 1) % segments]
            sums = d if sums is None else sums + d
            tests.append(sums <= F.lit(n * most // segments))
        one = tests[0]
        for t in tests[1:]:
            one = one & t
        starts.append(one)
    out = starts[0]
    for s in starts[1:]:
        out = out | s
    return out


def around(fps: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint at each point within ``radius`` bits of it."""
    masks = [signed(sum(1 << x for x in flips)) for n in range(radius + 1) for flips in combinations(range(64), n)]
    mask = F.explode(F.array(*map(F.lit, masks)))  # at most 2081 literals for radius 2
    return fps.select("fp", mask.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))


def links(fps: DataFrame, *, most: int = MAX_BITS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(a, b) with a < b whose components are those of all pairs of fingerprints within ``most`` bits.

    ``fps`` has one row for each distinct fp. Pairs are emitted outside crowded keys, stars to a point's least inside.
    """
    index = stored(fps, segments)
    crowded = cut_lineage(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key"))
    some = not crowded.isEmpty()
    if some:
        index = index.join(crowded, "key", "left_anti")
    left, right = index.withColumnRenamed("fp", "a"), asked(fps, segments, most).withColumnRenamed("fp", "b")
    a, b = F.col("a"), F.col("b")
    pairs = left.join(right, "key").where((a < b) & chain(a, b, segments, most) & (F.bit_count(a.bitwiseXOR(b)) <= most)).select("a", "b")
    if some:
        near = asked(fps, segments, most).join(crowded, "key", "left_semi").select("fp").distinct()
        points = around(near.repartition(F.col("fp")), (most + 1) // 2)
        met = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_set("fp").alias("all")).where("a <> z")
        stars = met.select("a", F.explode("all").alias("b")).where("a <> b")
        if most % 2:  # points lie (most + 1) / 2 away, so two fingerprints at one may be a bit too far apart
            raise ValueError("an even number of bits is needed")
        pairs = pairs.unionByName(stars.distinct())
    return pairs


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list (a, b): root is the least node reachable. Alternating stars."""
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if edges.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large star: each larger neighbour of a node goes to the node's least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("low", "node").alias("m"))
        large = edges.join(least, F.col("b") == F.col("node")).select("a", F.col("m").alias("b")).where("a <> b")
        # small star: each node and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        after = cut_lineage(small.distinct())
        # done when no node is both under another and above one
        if after.select("b").distinct().join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE_WORDS,
                    most: int = MAX_BITS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """One row per input row: the id, fp (signed long), component (the least id reachable, the row's own included).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows each get a row. A null id is skipped
    when the least is taken; a component of null ids alone has a null. An empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, id_column=id_column, text_column=text_column, shingle=shingle))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), most=most, segments=segments, crowd=crowd))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("least").alias("component"))
    labels = member.join(lowest, "root").select("fp", "component")
    return rows.join(labels, "fp").select(F.col("id").alias(id_column), "fp", "component")


def drop_near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of one document of each component, the one of the least id; all columns stay as they are.

    Of rows that share the least id (repeated rows), each stays. Rows of a component without any id stay.
    """
    found = near_duplicates(docs, id_column=id_column, text_column=text_column, **how)
    kept = found.where(F.col(id_column).eqNullSafe(F.col("component"))).select(F.col(id_column).alias("__kept")).distinct()
    return docs.join(kept, docs[id_column].eqNullSafe(kept["__kept"]), "left_semi")
