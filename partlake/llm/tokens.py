"""Token counts: whole texts, huge ones by overlapping chunks that are resynchronised.

An ordinary text is counted word by word. White space separates words for the tokenizers this serves and no token
crosses it, so a text's count is the sum over its words, and each worker asks the library once for a distinct word.

A huge text is cut into chunks that overlap. Each chunk is encoded with offsets, and two neighbours are spliced where
both see the same boundary between pre-tokens, away from either chunk's edge, followed by the same tokens at the same
places. From such a boundary on, the pre-tokeniser (which never looks back) and the merges inside each pre-token repeat
what they would do on the whole text, so the splice is exact. Where no such boundary shows, the overlap is doubled, at
last to the rest of the text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from partlake.llm.common import MEMORIES, map_batches, texts_of

HUGE_CHARS = 32_768  # a longer text is chunked; the library takes four times a word count's time
CHUNK_CHARS = 8_192
OVERLAP_CHARS = 512
#: A splice keeps this far from the edges of both chunks, and this many following tokens must agree.
EDGE_CHARS = 48
AGREE_TOKENS = 4
#: Distinct words that a worker remembers.
WORDS_KEPT = 300_000
LONG_WORD = 2_048

#: White space by Unicode; str.split() would also split at U+001C to U+001F.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = re.compile(f"[^{SPACES}]+")
ANY_SPACE = re.compile(f"[{SPACES}]")
ODD_SPACE = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=4)
def load(path: str):
    """The library's tokenizer of a .json file, on one thread, without truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoded:
    """The encoding of a chunk that begins at ``base`` of its text, asked for single tokens' places and pre-tokens."""

    def __init__(self, tokenizer, text: str, base: int, end: int):
        self.out = tokenizer.encode(text[base:end], add_special_tokens=False)
        self.base, self.end, self.ids = base, end, self.out.ids

    def span(self, i: int) -> tuple[int, int]:
        a, z = self.out.token_to_chars(i)
        return a + self.base, z + self.base

    def starts(self, i: int) -> bool:
        """Whether a pre-token starts at token i, and no token before covers its place."""
        return i > 0 and self.out.token_to_word(i) != self.out.token_to_word(i - 1) and self.span(i - 1)[1] <= self.span(i)[0]

    def at_or_after(self, place: int) -> int:
        """The first token that begins there or after."""
        low, high = 0, len(self.ids)
        while low < high:
            mid = (low + high) // 2
            if self.span(mid)[0] < place:
                low = mid + 1
            else:
                high = mid
        return low


def splice_point(left: Encoded, right: Encoded) -> tuple[int, int] | None:
    """Token positions (in left, in right) of the first proven common boundary, if any.

    Proven: both chunks start a pre-token there, each with EDGE_CHARS of the text before and after it, and the next
    AGREE_TOKENS have the same ids and places. A pre-tokeniser scans from left to right with its place as only state,
    so from a place where both scans stand they go on alike as long as they see the same text; merges stay inside
    pre-tokens. What an edge can change (a cut pre-token, a mark composed with what stands before) is within EDGE_CHARS,
    or shows in the tokens that must agree.
    """
    j, n = right.at_or_after(right.base + EDGE_CHARS), AGREE_TOKENS
    for j in range(j, len(right.ids)):
        at = right.span(j)[0]
        if at > left.end - EDGE_CHARS:
            return None
        if not right.starts(j):
            continue
        i = left.at_or_after(at)
        if len(left.ids) < i + n or left.span(i + n - 1)[1] > left.end - EDGE_CHARS // 2:
            return None
        if left.span(i)[0] == at and left.starts(i) and left.ids[i : i + n] == right.ids[j : j + n] and all(left.span(i + k) == right.span(j + k) for k in range(n)):
            return i, j
    return None


def encode_huge(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of a whole text, from overlapping chunks."""
    ids: list[int] = []
    left, skip = Encoded(tokenizer, text, 0, min(chunk, len(text))), 0
    while left.end < len(text):
        wide = min(overlap, left.end - left.base)
        while True:
            base = left.end - wide
            right = Encoded(tokenizer, text, base, min(left.end + chunk, len(text)))
            point = splice_point(left, right)
            if point and point[0] >= skip:
                ids += left.ids[skip : point[0]]
                left, skip = right, point[1]
                break
            if wide < left.end - left.base:
                wide = min(2 * wide, left.end - left.base)
            else:  # nothing in the left chunk is proven: encode it together with what follows
                left = Encoded(tokenizer, text, left.base, min(left.end + max(chunk, left.end - left.base), len(text)))
                break
    return ids + left.ids[skip:]


def splits_at_space(tokenizer) -> bool:
    """Whether this tokenizer's own description proves that no token holds or depends on white space.

    That is so if it drops everything but the matches of a pattern whose alternatives are literals or repeated classes
    without white space, maps characters one by one before (compositions never reach over white space), and has no
    added token that holds, strips or looks beside itself.
    """
    import regex

    spec = json.loads(tokenizer.to_str())
    steps = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    for step in steps(spec["normalizer"], "normalizers"):
        if step["type"] not in ("NFC", "Lowercase") and not (step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "):
            return False
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or ANY_SPACE.search(x["content"]) for x in spec["added_tokens"]):
        return False
    first = next(iter(steps(spec["pre_tokenizer"], "pretokenizers")), {})
    if first.get("type") != "Split" or first["behavior"] != "Removed" or not first["invert"] or "Regex" not in first["pattern"]:
        return False
    for part in regex.split(r"\|(?![^\[]*\])", first["pattern"]["Regex"]):
        literal, group = regex.fullmatch(r"[\w'<>-]+", part), regex.fullmatch(r"(\[(?:[^\[\]\\]|\\[sSpPdDwW](?:\{\w+\})?)+\])\+?", part)
        if not literal and (not group or regex.search(group[1], SPACES)):
            return False
    return True


class Counter:
    """Counts a tokenizer's tokens of whole texts."""

    def __init__(self, path: str, huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.tokenizer, self.huge, self.chunk, self.overlap = load(path), huge, chunk, overlap
        self.by_word = splits_at_space(self.tokenizer)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        plain = [not self.by_word or len(t) > self.huge for t in texts]
        split = [[] if huge else (t.split() if not ODD_SPACE.search(t) else WORD.findall(t)) for t, huge in zip(texts, plain)]
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        lengths = self.tokenizer.encode_batch_fast([w for w in new if len(w) <= LONG_WORD], add_special_tokens=False)
        known.update(zip((w for w in new if len(w) <= LONG_WORD), map(len, lengths)))
        for w in new:
            if len(w) > LONG_WORD:
                known[w] = len(self.whole(w))
        get = known.__getitem__
        out = [len(self.whole(t)) if huge else sum(map(get, words)) for t, huge, words in zip(texts, plain, split)]
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        if len(known) > WORDS_KEPT:  # those of this batch stay, the frequent ones among them
            self.known = {w: known[w] for words in split for w in words if w in known}
        return out

    def whole(self, text: str) -> list[int]:
        if len(text) > self.huge:
            return encode_huge(self.tokenizer, text, self.chunk, self.overlap)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def counter(path: str, huge: int, chunk: int, overlap: int) -> Counter:
    return Counter(path, huge, chunk, overlap)


MEMORIES[__name__] = counter.cache_clear


def count_tokens(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048,
                 huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are each counted; ids, null ones too, pass through.
    An empty table gives an empty result. Further input columns are not read, so their names cannot clash.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch.column(1))
        n = counter(path, huge, chunk, overlap).count(texts)
        return {
            id_column: batch.column(0),
            "n_bytes": pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
            "n_tokens": pa.array(n, pa.int64()),
            "over_limit": pa.array([x > limit for x in n], pa.bool_()),
        }

    return map_batches(docs.select(id_column, text_column), make, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
