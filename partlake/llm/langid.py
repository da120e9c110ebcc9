"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to three bytes deep holds counts. A byte's probability in a context is its
count over count-plus-kinds; one not seen there escapes to the next shorter context, with the kinds over the same sum,
shared among the bytes not seen (method C with exclusion). Statistics are frozen after training, so a byte's exact code
length depends on its context alone. A text goes to the language that codes it in the fewest bits.

All 256 byte values are kept (A to Z folded). The trees are sparse: the strings of three and four bytes that any language
has seen lie in two hashed tables with each language's code length after all escapes; any other string costs the escape of
its context and the code length of the string without its first byte. Strings of two bytes are an array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.llm.common import map_batches

ORDER = 3
#: Bound of the training sample: whole texts of each language.
SAMPLE_TEXTS = 300
STEPS = 512  # steps of a stored code length in a bit
CHUNK = 1 << 18
UNKNOWN = "und"
FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
BLANK = 32


class Places:
    """Where keys (32-bit numbers) stand in a list, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint32), np.uint32(0))
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - min(bits, 32)), (1 << min(bits, 32)) - 1
        self.slots, self.longest = np.full(self.mask + 1, -1, np.int32), 0
        left, spot = np.arange(len(keys)), self.spot(self.keys[:-1])
        while len(left):
            self.longest += 1
            free = left[self.slots[spot[left]] < 0]
            self.slots[spot[free[::-1]]] = free[::-1]  # of keys that want one slot the first gets it
            left = left[self.slots[spot[left]] != left]
            spot[left] = (spot[left] + 1) & self.mask

    def spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it has none."""
        spot = self.spot(keys)
        out = self.slots[spot]
        for _ in range(self.longest - 1):
            again = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
            if not len(again):
                break
            spot[again] = (spot[again] + 1) & self.mask
            out[again] = self.slots[spot[again]]
        return np.where(self.keys[out] == keys, out, -1)


@dataclass
class Model:
    """Frozen statistics. Code lengths and escapes have a column for each language, in STEPS of a bit."""

    languages: list[str]
    two: np.ndarray  # (65536, languages): code lengths of a byte after one
    escape2: np.ndarray  # (65536, languages): of a byte not seen after two
    three: Places
    bits3: np.ndarray
    contexts: Places
    escape3: np.ndarray
    four: Places
    bits4: np.ndarray


def steps(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(np.maximum(p, 1e-300)) * STEPS).astype(np.int32)


def padded(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of texts with ORDER blanks before each, and where each text's own bytes begin and end."""
    lengths = np.array([len(x) for x in data], np.int64)
    ends = np.cumsum(lengths + ORDER)
    return FOLD[np.frombuffer(b"".join(bytes([BLANK]) * ORDER + x for x in data), np.uint8)], np.stack([ends - lengths, ends], axis=1)


def strings(b: np.ndarray, n: int) -> np.ndarray:
    """The number of the n bytes that end at each place from ORDER on."""
    out = np.zeros(max(0, len(b) - ORDER), np.uint32)
    for k in range(n):
        out |= b[ORDER - k : len(b) - k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Tree:
    """The probabilities of one language: of seen strings, and what a context's escape leaves each unseen byte of its share."""

    def __init__(self, data: list[bytes]):
        b, where = padded(data)
        own = np.zeros(len(b), bool)
        for a, z in where:
            own[a:z] = True
        own = own[ORDER:]
        counts = [np.unique(strings(b, n)[own], return_counts=True) for n in range(1, ORDER + 2)]
        seen, n = counts[0]
        total, kinds = n.sum(), len(seen)
        self.one = np.full(256, kinds / max(1, total + kinds) / max(1, 256 - kinds) if total else 1 / 256)
        if kinds == 256:
            self.one[:] = 0
            self.one[seen] = n / total
        else:
            self.one[seen] = n / max(1, total + kinds)
        self.two = np.tile(self.one, 256)
        keys, p, contexts, escape = self.order(*counts[1], self.one)
        self.two *= np.repeat(self.dense(contexts, escape, 256), 256)
        self.two[keys] = p
        self.keys3, self.p3, contexts, escape = self.order(*counts[2], self.two)
        self.escape2 = self.dense(contexts, escape, 65536)
        self.keys4, self.p4, self.contexts3, self.escape3 = self.order(*counts[3], lambda x: self.third(x & np.uint32(0xFFFFFF)))

    @staticmethod
    def dense(contexts: np.ndarray, escape: np.ndarray, size: int) -> np.ndarray:
        out = np.ones(size)
        out[contexts] = escape
        return out

    @staticmethod
    def order(keys: np.ndarray, n: np.ndarray, shorter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Seen strings and their probabilities; contexts and what the shorter one's probability is multiplied by there."""
        context = keys >> np.uint32(8)
        contexts, first, kinds = np.unique(context, return_index=True, return_counts=True)
        if not len(keys):
            return keys, np.zeros(0), contexts, np.zeros(0)
        total = np.add.reduceat(n, first)
        full = kinds == 256
        whole = np.repeat(total + np.where(full, 0, kinds), kinds)
        p = shorter(keys) if callable(shorter) else shorter[keys & np.uint32(len(shorter) - 1)]
        left = 1 - np.add.reduceat(p, first)
        return keys, n / whole, contexts, np.where(full, 1.0, kinds / (total + kinds) / np.maximum(left, 1e-12))

    def third(self, keys: np.ndarray) -> np.ndarray:
        """The probability of a byte after two others."""
        at = np.minimum(np.searchsorted(self.keys3, keys), max(0, len(self.keys3) - 1))
        unseen = self.escape2[keys >> np.uint32(8)] * self.two[keys & np.uint32(0xFFFF)]
        return np.where(self.keys3[at] == keys, self.p3[at], unseen) if len(self.keys3) else unseen

    def fourth(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys4, keys), max(0, len(self.keys4) - 1))
        unseen = self.escape(keys >> np.uint32(8)) * self.third(keys & np.uint32(0xFFFFFF))
        return np.where(self.keys4[at] == keys, self.p4[at], unseen) if len(self.keys4) else unseen

    def escape(self, contexts: np.ndarray) -> np.ndarray:
        if not len(self.contexts3):
            return np.ones(len(contexts))
        at = np.minimum(np.searchsorted(self.contexts3, contexts), len(self.contexts3) - 1)
        return np.where(self.contexts3[at] == contexts, self.escape3[at], 1.0)


def train(texts: list[tuple[str, str]]) -> Model:
    """A model of (language, text) rows."""
    languages = sorted({x for x, _ in texts})
    trees = [Tree([t.encode("utf-8", "surrogatepass") for y, t in texts if y == x]) for x in languages]
    union = lambda name: np.unique(np.concatenate([np.zeros(0, np.uint32), *(getattr(t, name) for t in trees)]))
    keys3, keys4, contexts = union("keys3"), union("keys4"), union("contexts3")

    def columns(f, n: int) -> np.ndarray:
        return np.stack([steps(f(t)) for t in trees], axis=1) if trees else np.zeros((n, 0), np.int32)

    return Model(
        languages, columns(lambda t: t.two, 65536), columns(lambda t: t.escape2, 65536), Places(keys3), columns(lambda t: t.third(keys3), len(keys3)),
        Places(contexts), columns(lambda t: t.escape(contexts), len(contexts)), Places(keys4), columns(lambda t: t.fourth(keys4), len(keys4)),
    )


def lengths(model: Model, b: np.ndarray) -> np.ndarray:
    """Steps that each language needs for each byte from ORDER on."""
    keys = strings(b, 4)
    at = model.four.find(keys)
    out = model.bits4[at] if len(model.bits4) else np.zeros((len(at), len(model.languages)), np.int32)
    rest = np.flatnonzero(at < 0)
    if len(rest):
        keys = keys[rest]
        last = keys & np.uint32(0xFFFFFF)
        at, context = model.three.find(last), model.contexts.find(keys >> np.uint32(8))
        deep = at >= 0
        found = np.empty((len(rest), len(model.languages)), np.int32)
        found[deep] = model.bits3[at[deep]]
        short = last[~deep]
        found[~deep] = model.escape2[short >> np.uint32(8)] + model.two[short & np.uint32(0xFFFF)]
        known = context >= 0
        found[known] += model.escape3[context[known]]
        out[rest] = found
    return out


def code_lengths(model: Model, texts: list[str]) -> np.ndarray:
    """(texts, languages): the bits of each whole text."""
    total = np.zeros((len(texts), len(model.languages)), np.int64)
    for rows, data in grouped([t.encode("utf-8", "surrogatepass") for t in texts]):
        b, where = padded(data)
        for start in range(0, len(b) - ORDER, CHUNK):
            sums = np.cumsum(lengths(model, b[start : start + CHUNK + ORDER]), axis=0, dtype=np.int64)
            sums = np.concatenate([np.zeros((1, sums.shape[1]), np.int64), sums])
            a, z = (np.clip(where[:, k] - ORDER - start, 0, len(sums) - 1) for k in (0, 1))
            total[rows] += sums[z] - sums[a]
    return total / STEPS


def grouped(data: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts together up to CHUNK bytes; a longer one alone."""
    rows: list[int] = []
    size = 0
    for k, x in enumerate(data):
        if rows and size + len(x) > CHUNK:
            yield rows, [data[r] for r in rows]
            rows, size = [], 0
        rows.append(k)
        size += len(x)
    if rows:
        yield rows, [data[r] for r in rows]


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, its share among the languages' likelihoods) of each text; und and 0 for one without a letter."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    rows = [k for k, x in enumerate(texts) if x and model.languages and any(map(str.isalpha, x))]
    for k, bits in zip(rows, code_lengths(model, [texts[k] for k in rows])):
        best = int(bits.argmin())
        out[k] = model.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())
    return out


def sample(docs: DataFrame, *, id_column: str, text_column: str, lang_column: str, texts: int = SAMPLE_TEXTS) -> list[tuple[str, str]]:
    """At most ``texts`` whole texts of each language, of any length: the first by a hash of id and text.

    Rows of the same id and text are drawn as one; null ids and repeated ids are drawn by their texts.
    """
    order = F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.col(text_column))
    usable = docs.where(F.col(lang_column).isNotNull() & (F.length(text_column) > 0)).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), order.alias("order"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").agg(F.approx_count_distinct("order")).collect()}  # a row for each language
    if not counts:
        return []
    # twice the wanted share, so that hardly a draw falls short; what is over goes by the order
    rate = F.create_map(*[F.lit(x) for pair in ((k, min(1.0, 2 * texts / max(1, n))) for k, n in sorted(counts.items())) for x in pair])
    draw = F.pmod("order", F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.where(draw < rate[F.col("lang")]).dropDuplicates(["lang", "order"])
    first = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("rank") <= texts)
    return sorted((r[0], r[1]) for r in first.select("lang", "text").collect())


def identify(docs: DataFrame, model: Model, *, keep: dict[str, Column], text_column: str = "text") -> DataFrame:
    """One row per input row: the ``keep`` columns, lang_pred and score.

    A null, empty or letterless text is und with score 0, as is every text where no language was learnt. Ties go to the
    first language by name. Repeated rows each get a row; an empty table gives an empty result.
    """
    kept = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_column).alias("__text"))
    names = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, whatever the corpus

    def make(batch: pa.RecordBatch) -> dict:
        found = predict(shared.value, batch.column(batch.num_columns - 1).to_pylist())
        own = {n: batch.column(k) for k, n in enumerate(names)}
        return own | {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return map_batches(kept, make, f"{kinds}, lang_pred string, score double")
