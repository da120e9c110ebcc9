"""Near-duplicates by the exact Jaccard similarity of texts' sets of word shingles.

Candidates come first from SimHash fingerprints of the sets, linked within four bits by the pigeonring index. Of 64 bits,
pairs at 0.8 differ by ten on average and by up to eighteen, where no key with an exact segment is selective; so candidates
beyond that radius come from MinHash bands: two sets of similarity s agree in a band of ROWS minima with probability s^ROWS,
so with BANDS bands a pair at 0.8 is missed once in some ten million, a closer one less often. Every candidate is then
verified by its shingles.

Texts of equal sets are one node. Nodes of a small group under a band are compared with each other. A large group's are
compared with one of them, the one that has the largest part in common with others; what that joins into components is not
compared again. Of the rest only pairs of different components are, and only those that three tests leave: sizes; the
shingles that a node shares with any other at all, which bound what a pair can share (so a copy with many edits of its own
is left out at once); and sketches of a byte of each of many more minima, which rule 0.8 out by some five standard
deviations. So a large group of copies costs rows, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlake.llm.common import map_batches
from partlake.llm.simhash import components, links, majority
from partlake.session import cut_lineage

SEED = 42
SHINGLE_WORDS = 5
#: Similarity from which on texts are near-duplicates, in hundredths.
SIMILAR = 80
BANDS, ROWS = 40, 5
#: Shingles whose hashes are multiplied at once.
BLOCK = 2048
#: Minima of a sketch, and equal bytes of two below which a pair is not verified: 0.8 has 820 on average, with a deviation of
#: 12.8. A first look at a part of them spares most comparisons.
SKETCH, SKETCH_LEAST = 1024, 752
LOOK, LOOK_LEAST = 192, 124
NO_KEY = np.iinfo(np.int64).max
#: Nodes of a group up to which all are compared with each other; members that meet in one task.
SMALL_GROUP = 4
MEMBERS_AT_ONCE = 4096
#: Places of the table that says which shingles several nodes have, and the parts it is made in. Fixed, whatever the corpus:
#: where it fills up, shingles of different nodes meet in a place and the test lets more pairs through, never fewer.
TABLE_BITS = 24
TABLE_PARTS = 64


@lru_cache(maxsize=2)
def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, (count, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, of all its words if they are fewer; empty if it has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    return np.unique(np.array([digest(joined[a:z], SEED) for a, z in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


def minima(hashes: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """The least product of a set's hashes with each multiplier."""
    low, step = np.full(count, 2**64 - 1, np.uint64), max(1, BLOCK * BANDS * ROWS // count)
    for k in range(0, len(hashes), step):
        np.minimum(low, (hashes[k : k + step] * multipliers(count)).min(axis=1), out=low)
    return low


def signatures(docs: DataFrame, *, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """id, node (a hash of the set), n (its size), fp (its SimHash as a signed long), keys (of its bands) of each row; no keys for
    an empty set."""
    import xxhash

    kind = docs.schema[id_column].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        node, size, fp, keys = [], [], [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_set(text, shingle)
            low = minima(hashes)
            raw = low.tobytes()
            node.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
            size.append(len(hashes))
            fp.append(majority(hashes))
            wide = ROWS * 8
            keys.append(np.array([xxhash.xxh64_intdigest(raw[k * wide : (k + 1) * wide], k) for k in range(BANDS if len(hashes) else 0)], np.uint64).view(np.int64))
        ids = np.array(node, np.uint64).view(np.int64)
        return {"id": batch.column(0), "node": pa.array(ids), "n": pa.array(size, pa.int64()), "fp": pa.array(np.array(fp, np.uint64).view(np.int64)), "keys": pa.array(keys, pa.list_(pa.int64()))}

    return map_batches(docs.select(id_column, text_column), make, f"id {kind}, node bigint, n bigint, fp bigint, keys array<bigint>")


def ringed(rows: DataFrame, similar: int) -> DataFrame:
    """(a, b), a < b: nodes whose fingerprints the pigeonring index links, where sizes allow the similarity. ``rows``: those of
    ``signatures``. Of nodes of one fingerprint each meets the least, and the least stands for them towards others."""
    own = cut_lineage(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp")))
    heads = cut_lineage(own.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head")))
    one, other = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}")) for x in "ab")
    near = links(heads.select("fp")).distinct().join(one, "a").join(other, "b").select(F.col("ha").alias("x"), F.col("hb").alias("y"))
    equal = own.join(heads, "fp").where("node <> head.node").select(F.struct("node", "n").alias("x"), F.col("head").alias("y"))
    x, y = F.col("x.node"), F.col("y.node")
    return near.unionByName(equal).where(sizes_fit(F.col("x.n"), F.col("y.n"), similar)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. ``sets``: node, hashes."""
    one, other = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"s{x}")) for x in "ab")
    both = pairs.join(one, "a").join(other, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= similar * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def sizes_fit(a, b, similar: int):
    """Whether two sizes allow the similarity at all."""
    return (100 * a >= similar * b) & (100 * b >= similar * a)


def share_fits(a: dict, b: dict, similar: int):
    """Whether what two nodes (n, and s shingles that others have too) can share is enough. Columns or arrays."""
    least = lambda x, y: F.least(x, y) if not isinstance(y, np.ndarray) else np.minimum(x, y)
    return (100 + similar) * least(a["s"], b["s"]) >= similar * (a["n"] + b["n"])


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def shared_places(sets: DataFrame, bits: int) -> bytes:
    """A bit for each of 2^bits places: whether shingles of two nodes (or two of one) fall there."""
    wide = (1 << bits) // TABLE_PARTS

    def make(batch: pa.RecordBatch) -> dict:
        found, n = np.unique(places(batch.column(1).flatten().to_numpy(zero_copy_only=False), bits), return_counts=True)
        bounds = np.searchsorted(found, np.arange(TABLE_PARTS + 1) * wide)
        parts = [(k, (found[i:j] % wide).astype(np.uint32).tobytes(), (n[i:j] > 1).tobytes()) for k, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]
        part, at, often = zip(*parts) if parts else ((), (), ())
        return {"part": pa.array(part, pa.int32()), "at": pa.array(at, pa.binary()), "often": pa.array(often, pa.binary())}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part: its counts, up to two, are summed as they pass."""
        own, counts = None, np.zeros(wide, np.uint8)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, at, often in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if part != own:
                    if own is not None:
                        yield out()
                    own, counts = part, np.zeros(wide, np.uint8)
                at = np.frombuffer(at, np.uint32)
                counts[at] = np.minimum(counts[at] + 1 + np.frombuffer(often, np.bool_), 2)
        if own is not None:
            yield out()

    pieces = map_batches(sets.select("node", "hashes"), make, "part int, at binary, often binary")
    rows = pieces.repartition("part").sortWithinPartitions("part").mapInArrow(gather, "part int, bits binary").collect()  # TABLE_PARTS rows
    table = np.zeros((TABLE_PARTS, wide // 8), np.uint8)
    for r in rows:
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return table.tobytes()


def shared_counts(sets: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """(node, s): how many shingles of each node another of ``sets`` may have; never too few."""
    table = sets.sparkSession.sparkContext.broadcast(shared_places(sets, bits))  # 2^bits / 8 bytes

    def make(batch: pa.RecordBatch) -> dict:
        held = np.frombuffer(table.value, np.uint8)
        column = batch.column(1)
        at = places(column.flatten().to_numpy(zero_copy_only=False), bits)
        hit = np.concatenate([[0], np.cumsum(held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1, dtype=np.int64)])
        ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return {"node": batch.column(0), "s": pa.array(hit[ends[1:]] - hit[ends[:-1]], pa.int64())}

    return map_batches(sets.select("node", "hashes"), make, "node bigint, s bigint")


def sketches(sets: DataFrame) -> DataFrame:
    """(node, sketch): a byte of each of SKETCH minima."""

    def make(batch: pa.RecordBatch) -> dict:
        found = [minima(np.array(x, np.int64).view(np.uint64), SKETCH).astype(np.uint8).tobytes() for x in batch.column(1).to_numpy(zero_copy_only=False)]
        return {"node": batch.column(0), "sketch": pa.array(found, pa.binary())}

    return map_batches(sets.select("node", "hashes"), make, "node bigint, sketch binary")


def across(blocks: DataFrame, similar: int) -> DataFrame:
    """(a, b), a < b: members in different components that sizes, shares and sketches allow, each pair once. ``blocks``: key (of a
    group), one, other (numbers of two of its blocks), all (array of node, n, s, root, sketch, block, keys); members of one block
    meet in the row of that block with itself, and nodes that meet under several keys count under the least."""

    def make(batch: pa.RecordBatch) -> dict:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for key, one, other, members in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            flat = members.values
            keys = np.full((len(flat), BANDS), NO_KEY)
            for row, own in zip(keys, flat.field(6).to_pylist()):
                row[: len(own)] = own
            node, n, s, root, block = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 5))
            sketch = np.frombuffer(b"".join(flat.field(4).to_pylist()), np.uint8).reshape(len(node), -1)
            for k in range(len(node) - 1):
                later = slice(k + 1, None)
                fine = (root[later] != root[k]) & sizes_fit(n[k], n[later], similar) & share_fits({"n": n[k], "s": s[k]}, {"n": n[later], "s": s[later]}, similar)
                if one != other:
                    fine &= block[later] != block[k]
                rest = np.flatnonzero(fine) + k + 1
                for at in range(0, len(rest), 8192):
                    some = rest[at : at + 8192]
                    some = some[(sketch[some, :LOOK] == sketch[k, :LOOK]).sum(axis=1) >= LOOK_LEAST]
                    some = some[(sketch[some] == sketch[k]).sum(axis=1) >= SKETCH_LEAST]
                    some = some[np.where(np.isin(keys[some], keys[k]), keys[some], NO_KEY).min(axis=1, initial=NO_KEY) == key]
                    left.append(np.minimum(node[some], node[k]))
                    right.append(np.maximum(node[some], node[k]))
        return {"a": pa.array(np.concatenate(left)), "b": pa.array(np.concatenate(right))}

    return map_batches(blocks.select("key", "one", "other", "all"), make, "a bigint, b bigint")


def edges(docs: DataFrame, rows: DataFrame, *, id_column: str, text_column: str, shingle: int, similar: int) -> DataFrame:
    """(a, b) of nodes whose components are those of all similar pairs. ``rows``: those of ``signatures``."""
    if similar < SIMILAR:
        raise ValueError(f"the bands find pairs from {SIMILAR} hundredths on")
    distinct = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    index = distinct.select(F.explode("keys").alias("key"), F.struct("node", "n").alias("member"))
    crowds = index.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = cut_lineage(index.join(crowds, "key"))
    # close copies meet in most bands: a small group counts once
    small = met.where(F.col("size") <= SMALL_GROUP).groupBy("key").agg(F.array_sort(F.collect_list("member")).alias("all")).select("all").distinct()
    large = met.where(F.col("size") > SMALL_GROUP).select("key", "size", "member.node", "member.n")
    ring = cut_lineage(ringed(rows, similar))
    nodes = cut_lineage(met.select("member.node").unionByName(ring.select(F.explode(F.array("a", "b")).alias("node"))).distinct())
    wanted = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("least"))
    texts = docs.select(F.col(id_column).alias("least"), F.col(text_column).alias("text"))

    def make(batch: pa.RecordBatch) -> dict:
        import xxhash

        found = [shingle_set(x, shingle) for x in batch.column(0).to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64).view(np.int64)
        return {"node": pa.array(node), "hashes": pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))}

    # a row's node is found again from its text: ids may repeat with other texts, or be null
    ids = wanted.select(F.col("least").alias("__least")).distinct()
    chosen = texts.join(ids, texts["least"].eqNullSafe(ids["__least"]), "left_semi").select("text")
    sets = cut_lineage(map_batches(chosen, make, "node bigint, hashes array<bigint>").join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    close = F.flatten(F.transform("all", lambda x, i: F.transform(F.filter("all", lambda y: (y["node"] > x["node"]) & sizes_fit(x["n"], y["n"], similar)), lambda y: pair(x["node"], y["node"]))))
    pairs = ring.unionByName(small.select(F.explode(close).alias("p")).select("p.a", "p.b"))
    crowded = not large.isEmpty()
    if crowded:
        shares = shared_counts(sets.join(large.select("node").distinct(), "node", "left_semi"))
        large = cut_lineage(large.join(shares, "node"))
        # what is no more than a fifth in common with all others together has no partner
        large = large.where(100 * F.col("s") >= similar * F.col("n"))
        head = F.max_by(F.struct("node", "n", "s"), F.struct(F.col("s") / F.col("n"), F.col("node")))
        led = large.join(large.groupBy("key").agg(head.alias("head")), "key").where(F.col("node") != F.col("head.node"))
        x, y = ({"n": F.col(f"{p}n"), "s": F.col(f"{p}s")} for p in ("", "head."))
        led = led.where(sizes_fit(x["n"], y["n"], similar) & share_fits(x, y, similar)).select(pair(F.col("node"), F.col("head.node")).alias("p"))
        pairs = pairs.unionByName(led.select("p.a", "p.b"))
    first = cut_lineage(verified(pairs.distinct(), sets, similar))
    if not crowded:
        return first
    labelled = cut_lineage(large.join(components(first), "node", "left").select("key", "node", "n", "s", F.coalesce("root", "node").alias("root")))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count(F.lit(1)) / MEMBERS_AT_ONCE).cast("int").alias("blocks")).where("x <> y").select("key", "blocks")
    left = cut_lineage(labelled.join(mixed, "key"))
    drawn = sketches(sets.join(left.select("node").distinct(), "node", "left_semi"))
    own = left.groupBy("node").agg(F.collect_set("key").alias("keys"))  # one a band at most
    members = left.join(drawn, "node").join(own, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # each block meets itself and each other block once; a group of few members is one block
    member = F.struct("node", "n", "s", "root", "sketch", "block", "keys").alias("member")
    dealt = members.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"), member)
    dealt = dealt.select("key", F.least("with", "member.block").alias("one"), F.greatest("with", "member.block").alias("other"), "member")
    blocks = dealt.groupBy("key", "one", "other").agg(F.collect_list("member").alias("all"))
    return first.unionByName(verified(across(blocks, similar), sets, similar))


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE_WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row per input row: the id and component (the least id that links of similar texts reach, the row's own included).

    Null and texts without words are equal to each other. Repeated rows each get a row. A null id is skipped when the least
    is taken; a component of null ids alone has a null. An empty table gives an empty result.
    """
    rows = cut_lineage(signatures(docs, id_column=id_column, text_column=text_column, shingle=shingle))
    roots = components(edges(docs, rows, id_column=id_column, text_column=text_column, shingle=shingle, similar=similar))
    member = rows.groupBy("node").agg(F.min("id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    lowest = member.groupBy("root").agg(F.min("least").alias("component"))
    labels = member.join(lowest, "root").select("node", "component")
    return rows.join(labels, "node").select(F.col("id").alias(id_column), "component")


def drop_near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of one document of each component, the one of the least id; all columns stay as they are.

    Of rows that share the least id (repeated rows), each stays. Rows of a component without any id stay.
    """
    found = near_duplicates(docs, id_column=id_column, text_column=text_column, **how)
    kept = found.where(F.col(id_column).eqNullSafe(F.col("component"))).select(F.col(id_column).alias("__kept")).distinct()
    return docs.join(kept, docs[id_column].eqNullSafe(kept["__kept"]), "left_semi")
