"""SentencePiece encoding and decoding with the tokenizers library.

The model file's protobuf is read by its wire format, and its normaliser, space marker, scores and byte fallback are
rebuilt as a tokenizers pipeline: a unigram model from the scores, or for a BPE model the merges that the scores imply.
Distinct units are encoded in batches on several threads, and their ids are compared with the sentencepiece library's. Only
where the two differ (BPE ties that the libraries break differently) are sentencepiece's used, and the text is marked.

A unit is a run of space markers and what follows up to the next marker. If no piece of the vocabulary has a marker
after another character, no merge crosses a unit's start, so a text's ids are its units' ids in order; a model of
another kind is encoded by whole texts.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partlake.llm.common import MEMORIES, map_batches, texts_of

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
NO_TEXT = "\U0010ffff"  # a noncharacter
#: What a worker remembers: units, and bytes of units and ids.
UNITS_KEPT = 300_000
BYTES_KEPT = 32 << 20
#: Words encoded as one text, its characters, and texts encoded at once.
BLOCK_UNITS = 512
BLOCK_CHARS = 1 << 16
BLOCKS_AT_ONCE = 16
THREADS = 2
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes):
    """(number, value) of each field of a protobuf message; nested messages are bytes, 32-bit values floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 1:
            yield number, data[at : at + 8]
            at += 8
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        elif wire == 5:
            yield number, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            raise ValueError(f"wire type {wire} at byte {at}")


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.charsmap, self.dummy_prefix, self.remove_extra, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, x in fields(value):
                    if n == 1:
                        piece = x.decode()
                    elif n == 2:
                        score = x
                    elif n == 3:
                        kind = x
                self.pieces.append((piece, score, kind))
            elif number == 2:
                for n, x in fields(value):
                    if n == 3:
                        self.kind = x
                    elif n == 24 and x:
                        raise ValueError("models with markers after words are not read")
                    elif n == 35:
                        self.byte_fallback = bool(x)
            elif number == 3:
                for n, x in fields(value):
                    if n == 2:
                        self.charsmap = x
                    elif n == 3:
                        self.dummy_prefix = bool(x)
                    elif n == 4:
                        self.remove_extra = bool(x)
                    elif n == 5:
                        self.escape = bool(x)
        self.unknown = next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Each way to put a piece together from two others, better scores first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = [(-self.pieces[i][1], i, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [(left, right) for *_, left, right in sorted(found)]

    def unit_wise(self) -> bool:
        """Whether units can be encoded one by one."""
        return self.dummy_prefix and self.escape and not self.remove_extra and not self.charsmap and all(MARK not in p.lstrip(MARK) and kind != USER_DEFINED for p, _, kind in self.pieces)

    def piece_bytes(self) -> list[bytes]:
        """What each piece stands for in a text with markers."""
        return [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() for p, _, kind in self.pieces]

    def reachable(self) -> list[tuple[str, float]]:
        """Pieces and scores, those that no text may become under a name that no text has."""
        return [(p if kind not in (CONTROL, UNUSED) else f"{NO_TEXT}{p}", s) for p, s, kind in self.pieces]


def normaliser(model: Model):
    """What a model makes of a whole text before it looks for pieces."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def build(model: Model, whole: bool):
    """A tokenizers pipeline for a model; for whole normalised texts, or for units that already hold their markers.

    A text is normalised before (``normaliser``): the library would treat what stands between pieces that the user defined
    as texts of their own.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, pre_tokenizers

    if model.kind == BPE:
        vocab = {p: i for i, (p, _) in enumerate(model.reachable())}
        core = models.BPE(vocab, model.merges(), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram(model.reachable(), model.unknown, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    if not whole:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(UNIT.pattern), "isolated")
    if own := [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]:
        tokenizer.add_tokens(own)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


class Codec:
    """Encodes and decodes whole texts as a model file says."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.by_unit = self.model.unit_wise()
        self.tokenizer = build(self.model, whole=not self.by_unit)
        self.normaliser = normaliser(self.model)
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        self.starts = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.bytes = self.model.piece_bytes()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}  # ids of words, and of units with other markers than one before a word
        self.kept = 0  # their bytes
        self.apart: set[str] = set()  # those that the libraries encode differently
        self.lossy: set[str] = set()  # those that decoding does not give back

    def learn(self, keys: list[str]) -> dict[str, bytes]:
        """The ids of keys; notes those that the libraries encode differently or that decoding changes.

        Words are encoded many to a text: the pre-tokeniser parts them again, and a word's tokens begin at the one with
        the marker. What does not come apart so, and units with several markers, are encoded one by one.
        """
        out: dict[str, bytes] = {}
        together = [k for k in keys if MARK not in k] if self.by_unit else []
        alone = [k for k in keys if MARK in k] if self.by_unit else keys
        blocks, block, size = [], [], 0
        for k in together:
            block.append(k)
            size += len(k)
            if len(block) == BLOCK_UNITS or size > BLOCK_CHARS:
                blocks.append(block)
                block, size = [], 0
        if block:
            blocks.append(block)
        for at in range(0, len(blocks), BLOCKS_AT_ONCE):
            some = blocks[at : at + BLOCKS_AT_ONCE]
            texts = [MARK + MARK.join(b) for b in some]
            encoded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            says = self.judge.encode([" ".join(b) for b in some], num_threads=1)
            for b, text, ids, said in zip(some, texts, encoded, says):
                flat = np.array(ids, np.int32)
                cuts = np.flatnonzero(self.starts[flat])
                if len(cuts) != len(b) or ids != said or b"".join(map(self.bytes.__getitem__, ids)) != text.encode():
                    alone += b
                    continue
                raw, ends = flat.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
                start = 0
                for k, end in zip(b, ends):
                    out[k] = raw[start:end]
                    start = end
        for at in range(0, len(alone), BLOCK_UNITS):
            out.update(self.learn_each(alone[at : at + BLOCK_UNITS]))
        return out

    def learn_each(self, keys: list[str]) -> dict[str, bytes]:
        units = [k if MARK in k else MARK + k for k in keys] if self.by_unit else [self.normaliser.normalize_str(k) for k in keys]
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        says = self.judge.encode([u[1:].replace(MARK, " ") for u in units] if self.by_unit else keys, num_threads=1)
        if self.by_unit:  # a lone marker at a text's end is a piece, though an empty text has none
            says = [s if u != MARK else [self.judge.piece_to_id(MARK)] for u, s in zip(units, says)]
        self.apart.update(k for k, i, s in zip(keys, ids, says) if i != s)
        back = self.decode(says)
        self.lossy.update(k for k, u, b in zip(keys, units, back) if b != (u.replace(MARK, " ") if self.by_unit else " " * self.model.dummy_prefix + k))
        return {k: np.array(s if k in self.apart else i, np.int32).tobytes() for k, i, s in zip(keys, ids, says)}

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Each text's ids as little-endian int32, whether the libraries agree, whether decoding gives it back."""
        split = [self.units(t) for t in texts]
        known = self.known
        new = list({u for units in split for u in units if u not in known})
        if new:
            known.update(self.learn(new))
            self.kept += sum(map(len, new)) + sum(len(known[u]) for u in new)
        get, apart, lossy = known.__getitem__, self.apart, self.lossy
        ids = [b"".join(map(get, units)) for units in split]
        same = [not apart or apart.isdisjoint(units) for units in split]
        back = [MARK not in text and (not lossy or lossy.isdisjoint(units)) for text, units in zip(texts, split)]
        if len(known) > UNITS_KEPT or self.kept > BYTES_KEPT:
            self.forget()
        return ids, same, back

    def units(self, text: str) -> list[str]:
        """The keys of a text: words where one blank parts them, else runs of markers with what follows."""
        if not text:
            return []
        if not self.by_unit:
            return [text]
        words = text.split(" ")
        if "" in words or MARK in text:
            return [u if MARK in u[1:] or u == MARK else u[1:] for u in UNIT.findall(MARK + text.replace(" ", MARK))]
        return words

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The normalised texts of lists of ids, markers as spaces, the dummy prefix still there."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def decode_texts(self, ids: list[list[int]]) -> list[str]:
        """The texts of lists of ids."""
        cut = 1 if self.model.dummy_prefix else 0
        return [x[cut:] if cut and x.startswith(" ") else x for x in self.decode(ids)]


@lru_cache(maxsize=2)
def codec(path: str, threads: int) -> Codec:
    return Codec(path, threads)


MEMORIES[__name__] = codec.cache_clear


def encode(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", threads: int = THREADS) -> DataFrame:
    """One row per input row: id, ids array<int>, n_tokens, parity (the libraries agree), lossless (decoding gives the text back).

    Null and empty texts have no ids and are in parity and lossless. Texts that the normaliser changes (such as those
    that hold the marker itself) are not lossless. Repeated rows each get a row; an empty table gives an empty result.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        ids, same, back = codec(path, threads).encode(texts_of(batch.column(1)))
        n = np.array([len(x) // 4 for x in ids], np.int32)
        flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
        return {
            id_column: batch.column(0),
            "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]).astype(np.int32)), flat),
            "n_tokens": pa.array(n.astype(np.int64)),
            "parity": pa.array(same, pa.bool_()),
            "lossless": pa.array(back, pa.bool_()),
        }

    return map_batches(docs.select(id_column, text_column), make, f"`{id_column}` {kind}, ids array<int>, n_tokens bigint, parity boolean, lossless boolean")


def decode(encoded: DataFrame, path: str, *, id_column: str = "doc_id", ids_column: str = "ids", threads: int = THREADS) -> DataFrame:
    """One row per input row: id and the text of its ids; null ids give a null text, no ids an empty one."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        rows = batch.column(1).to_pylist()
        texts = codec(path, threads).decode_texts([x or [] for x in rows])
        return {id_column: batch.column(0), "text": pa.array([None if x is None else t for x, t in zip(rows, texts)], pa.string())}

    return map_batches(encoded.select(id_column, ids_column), make, f"`{id_column}` {kind}, text string")
