"""Substring dedup by sliding sentence spans: repeated runs of consecutive sentences stay only where they come first.

A sentence ends after a word that ends in ``.``, ``!`` or ``?`` and at a line's end; one of under four words goes with the
next. A long one is cut after words whose hash is the least of the seven around, so that the same passage is cut alike
wherever it stands. From each sentence on, the shortest run of at least three sentences and twelve words is hashed, with
the space inside it. Every sentence that a repeated run covers goes, unless that run is the first of its kind by
(id, text checksum, place).

A run's 128-bit digest decides what is equal. All runs are hashed in one pass and meet in one shuffle, where those that
are not the first of their digest show as ranks. A run that the same batch of texts holds at an earlier place is not the
first for sure and is dealt out evenly, so a digest that very many texts share costs its task a row for each batch.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.llm.common import map_batches

RUN_SENTENCES = 3
RUN_WORDS = 12
#: A sentence of fewer words goes with the next one.
SHORT_SENTENCE = 4
#: One of more words is cut after each word whose hash is the least of those up to CUT words away, and after CUT_AT_MOST.
LONG_SENTENCE = 16
CUT = 3
CUT_AT_MOST = 24
#: Texts are looked through in parts of so many bytes; no result depends on it.
PART_BYTES = 1 << 21
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
DIGEST_BYTES = 16


def words_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start, where they end, and where lines do."""
    edges, lines, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], True
    for start in range(0, len(b), PART_BYTES):
        piece = b[start : start + PART_BYTES]
        blank = SPACE[piece]
        edges.append(np.flatnonzero(np.diff(np.concatenate([[before], blank]).astype(np.int8))) + start)
        lines.append(np.flatnonzero(piece == 10) + start)
        before = bool(blank[-1])
    solid = np.concatenate([*edges, [] if before else [len(b)]]).astype(np.int64)
    return solid[::2], solid[1::2], np.concatenate(lines)


class Part:
    """The sentences of a text as byte places, and the runs from each on."""

    def __init__(self, data: bytes):
        import xxhash

        b = np.frombuffer(data, np.uint8)
        starts, ends, lines = words_of(b)
        n = len(starts)
        self.starts, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lengths, self.from_, self.to = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not n:
            return
        last = STOP[b[ends - 1]]
        last[np.searchsorted(starts, lines) - 1] = True  # an early line end marks the last word, which ends one anyway
        last[-1] = True
        stops = np.flatnonzero(last)
        last[stops[np.diff(stops, prepend=-1) < SHORT_SENTENCE]] = False
        last[-1] = True
        stops = np.flatnonzero(last)
        first = np.concatenate([[0], stops[:-1] + 1])
        long = np.repeat(stops - first + 1 > LONG_SENTENCE, stops - first + 1)
        if long.any():
            word = np.full(n, 2**64 - 1, np.uint64)
            word[long] = [xxhash.xxh64_intdigest(data[a:z]) for a, z in zip(starts[long].tolist(), ends[long].tolist())]
            near = np.lib.stride_tricks.sliding_window_view(np.pad(word, CUT, constant_values=2**64 - 1), 2 * CUT + 1)
            last |= long & (word == near.min(axis=1))
            stops = np.flatnonzero(last)
            first = np.concatenate([[0], stops[:-1] + 1])
            inside = np.arange(n) - np.repeat(first, stops - first + 1)
            last |= inside % CUT_AT_MOST == CUT_AT_MOST - 1
            stops = np.flatnonzero(last)
            first = np.concatenate([[0], stops[:-1] + 1])
        self.starts, self.ends = starts[first], np.concatenate([starts[first[1:]], [len(b)]])
        k = np.arange(len(first))
        upto = np.maximum(k + RUN_SENTENCES, np.searchsorted(stops, first + RUN_WORDS - 1) + 1)
        whole = upto <= len(first)
        k, upto = k[whole], upto[whole]
        self.lengths, self.from_, self.to = upto - k, starts[first[k]], ends[stops[upto - 1]]


def runs(data: bytes) -> list[bytes]:
    """The digest of each run of a text, in the order of their first sentences."""
    p = Part(data)
    return [blake2b(data[a:z], digest_size=DIGEST_BYTES).digest() for a, z in zip(p.from_.tolist(), p.to.tolist())]


def sentences(data: bytes) -> tuple[list[tuple[int, int]], list[int]]:
    """Byte places of a text's sentences, white space after one belongs to it; and how many each one's run has, 0 if none."""
    p = Part(data)
    places = list(zip(p.starts.tolist(), p.ends.tolist()))
    return places, [*p.lengths.tolist(), *[0] * (len(p.starts) - len(p.lengths))]


def spans(docs: DataFrame) -> DataFrame:
    """Every run of every text: id, place (t and the sentence's number in one long), h and g (the digest), late.

    ``late``: the batch holds the run at a smaller (id, place), so it is not the first; its h is a hash of its place then,
    and g is 0. ``docs``: id, t (an int), text.
    """
    import xxhash

    kind = docs.schema["id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        ids, checks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows, places, digests = [], [np.zeros(0, np.int64)], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            if text:
                found = runs(text.encode("utf-8", "surrogatepass"))
                digests += found
                places.append(np.arange(len(found), dtype=np.int64) + (checks[k] << 32))
                rows += [k] * len(found)
        place = np.concatenate(places)
        held = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).copy()
        texts = sorted({(ids[k] is not None, ids[k], checks[k]) for k in set(rows)})  # equal rows are one place
        rank = {x: r for r, x in enumerate(texts)}
        by_rank = np.array([rank[ids[k] is not None, ids[k], checks[k]] for k in rows], np.int64)
        at = by_rank << 32 | (place & 0xFFFFFFFF)
        late = np.zeros(len(rows), bool)
        if len(rows):
            sort = np.lexsort((at, held[:, 1], held[:, 0]))
            new = np.concatenate([[True], (held[sort[1:]] != held[sort[:-1]]).any(axis=1)])
            least = at[sort][np.maximum.accumulate(np.where(new, np.arange(len(sort)), 0))]
            late[sort] = at[sort] != least
            for k in np.flatnonzero(late).tolist():
                held[k] = xxhash.xxh64_intdigest(f"{ids[rows[k]]} {place[k]}") - (1 << 63), 0
        return {"id": batch.column(0).take(pa.array(rows, pa.int64())), "place": pa.array(place), "h": pa.array(held[:, 0]), "g": pa.array(held[:, 1]), "late": pa.array(late)}

    return map_batches(docs, make, f"id {kind}, place bigint, h bigint, g bigint, late boolean")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(id, t, places): of each text, the sentences that begin a run that another place comes before. ``docs``: id, t, text."""
    order = F.rank().over(Window.partitionBy("h", "g").orderBy("id", "place"))
    later = spans(docs).withColumn("order", order).where("late or order > 1")
    one = later.select("id", F.shiftright("place", 32).cast("int").alias("t"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("place"))
    return one.groupBy("id", "t").agg(F.collect_set("place").alias("places"))


def cut_text(text: str, places: list[int]) -> tuple[str, int, int]:
    """The text without the sentences that runs at ``places`` cover, its number of sentences, and how many went."""
    data = text.encode("utf-8", "surrogatepass")
    where, lengths = sentences(data)
    covered: set[int] = set()
    for p in places:
        covered.update(range(p, p + lengths[p]))
    if not covered:
        return text, len(where), 0
    kept, at = [], 0
    for k, (start, end) in enumerate(where):
        if k in covered:
            kept.append(data[at:start])
            at = end
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass"), len(where), len(covered)


def checksum(text: Column) -> Column:
    """What tells rows of one id apart: 32 bits of the text's hash."""
    return F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 32).cast("int")


def drop_repeated_spans(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", counts: bool = False) -> DataFrame:
    """Each input row with its text cut; with ``counts`` also n_sentences and n_removed (replacing input columns so named).

    Rows and all other columns stay, a row whose text is repeated throughout with an empty text. Null and empty texts
    stay as they are. Equal rows (same id and text) count as one place and so do not cut each other; a null id comes
    before others. An empty table gives an empty result.
    """
    text, key = F.col(text_column), F.col(id_column)
    keyed = docs.select(key.alias("id"), checksum(text).alias("t"), text.alias("text"))
    cuts = repeated_runs(keyed).select(F.col("id").alias("__id"), F.col("t").alias("__t"), "places")
    names = [c for c in docs.columns if not (counts and c.lower() in ("n_sentences", "n_removed"))]
    others = [F.col(f"`{c}`") for c in names if c != text_column]  # the text passes through Python once
    packed = docs.select(F.struct(*(others or [F.lit(None).cast("string").alias("none")])).alias("row"), text.alias("text"), key.alias("id"), checksum(text).alias("t"))
    joined = packed.join(cuts, F.col("id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t")), "left").select("row", "text", "places")
    kind = packed.schema["row"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        done = [(x, 0, 0) if x is None else cut_text(x, p or []) if p or counts else (x, 0, 0) for x, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        texts, n, gone = zip(*done)
        return {"row": batch.column(0), "text": pa.array(texts, pa.string()), "n_sentences": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64())}

    cut = map_batches(joined, make, f"row {kind}, text string, n_sentences bigint, n_removed bigint")
    columns = [F.col("text").alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in names]
    return cut.select(*columns, *(["n_sentences", "n_removed"] if counts else []))
