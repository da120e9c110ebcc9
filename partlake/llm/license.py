"""License scans: one Aho-Corasick pass finds notice phrases and identifier tags; tags' expressions are parsed.

A tag's expression (``(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0``) goes through a shunting-yard
parser with the precedence WITH, AND, OR, and is evaluated to a factored form whose alternatives are the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame

from partlake.llm.common import map_batches

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further phrases, labels and weights. A weight is how surely the phrase alone marks a licence notice.
MORE = {
    "apache license version 2 0": ("apache-2.0", 0.95),
    "licensed under the apache license": ("apache", 0.95),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit-text", 0.95),
    "redistribution and use in source and binary forms": ("bsd-text", 0.95),
    "mozilla public license": ("mpl", 0.95),
    "lesser general public license": ("lgpl", 0.95),
    "affero general public license": ("agpl", 0.95),
    "creative commons": ("creative-commons", 0.8),
    "cc by nc": ("cc-by-nc", 0.95),
    "cc by sa": ("cc-by-sa", 0.95),
    "cc by nd": ("cc-by-nd", 0.95),
    "cc0": ("cc0", 0.8),
    "public domain": ("public-domain", 0.6),
    "licensed under": ("licensed-under", 0.5),
}
BASE_WEIGHTS = {"cc-by": 0.9, "gpl": 0.9, "reserved": 0.7}
TAG = "spdx license identifier"
TAG_RAW = b"spdx-license-identifier"
TAG_WEIGHT = 0.99
#: A to Z lower, other ASCII outside 0-9 and a-z to a space; bytes above stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(rb"[()]|[a-z0-9.+:-]+")
LEAD = re.compile(rb"[ :\t]*")


def to_postfix(tokens: Iterable[str]) -> list[str] | None:
    """Shunting-yard: a licence expression in postfix, or None if it is malformed. Reads no token after the expression."""
    out: list[str] = []
    stack: list[str] = []
    operand, depth = False, 0  # whether the last token ended an operand; open brackets
    for token in tokens:
        if token in PRECEDENCE:
            if not operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif operand:
            break  # prose after the expression
        else:
            out.append(token)
            operand = True
    if not operand or depth:
        return None
    return out + stack[::-1]


class Node:
    """A licence, or several joined by ``|`` or ``&``: nodes of the same sign are merged, so signs alternate downwards."""

    __slots__ = ("sign", "parts", "least", "digest")

    def __init__(self, sign: str, parts: list):
        self.sign, self.parts = sign, parts  # a licence: sign "" and its name as only part

    def below(self) -> list[Node]:
        """Itself and all nodes under it, those above first."""
        out = [self]
        for node in out:
            if node.sign:
                out += node.parts
        return out


def joined(sign: str, left: Node, right: Node) -> Node:
    """Both under one sign; the larger one's list is extended, so a long chain is linear."""
    if left.sign != sign or right.sign == sign and len(right.parts) > len(left.parts):
        left, right = right, left
    if left.sign != sign:
        return Node(sign, [left, right])
    left.parts += right.parts if right.sign == sign else [right]
    return left


def evaluate(postfix: list[str]) -> Node | None:
    """An expression in factored form: nothing is multiplied out, so its size is that of the expression.

    WITH marks every licence on its left; None if its right is not one name.
    """
    stack: list[Node] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append(Node("", [token]))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if right.sign:
                return None
            for node in left.below():
                if not node.sign:
                    node.parts = [f"{node.parts[0]}-with-{right.parts[0]}"]
            stack.append(left)
        else:
            stack.append(joined("|" if token == "or" else "&", left, right))
    return stack[0]


def canonical(root: Node) -> Node:
    """The same with equal parts once and parts in the order of their least licence, then of a digest of the whole."""
    for node in reversed(root.below()):
        if node.sign:
            parts = [y for x in node.parts for y in (x.parts if x.sign == node.sign else [x])]
            once = {x.digest: x for x in parts}
            node.parts = sorted(once.values(), key=lambda x: (x.least, x.digest))
            node.least = node.parts[0].least
            if len(node.parts) == 1:  # a part that is all there is
                only = node.parts[0]
                node.sign, node.parts, node.digest = only.sign, only.parts, only.digest
                continue
            node.digest = md5("".join([node.sign, *(x.digest for x in node.parts)]).encode()).hexdigest()
        else:
            node.least = node.parts[0]
            node.digest = md5(node.least.encode()).hexdigest()
    return root


def printed(root: Node) -> str:
    """``a&(b|c)``."""
    out: list[str] = []
    todo: list[Node | str] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.sign:
            out.append(x.parts[0])
        else:
            for k, part in enumerate(reversed(x.parts)):
                if k:
                    todo.append(x.sign)
                todo += [")", part, "("] if part.sign else [part]
    return "".join(out)


def tag_labels(expression: str | bytes) -> list[str]:
    """``spdx:`` and each alternative of an expression in factored form; spdx:invalid if malformed."""
    data = expression.lower() if isinstance(expression, bytes) else expression.lower().encode()
    return labels_of(data, 0, len(data))


def labels_of(lower: bytes, start: int, end: int) -> list[str]:
    """The labels of the expression between two places; its tokens are read one by one, as far as it goes."""
    first = LEAD.match(lower, start, end).end()
    postfix = to_postfix(x.group().decode() for x in TOKEN.finditer(lower, first, end))
    root = evaluate(postfix) if postfix is not None else None
    if root is None:
        return ["spdx:invalid"]
    root = canonical(root)
    return sorted(f"spdx:{printed(x)}" for x in (root.parts if root.sign == "|" else [root]))


def tags(lower: bytes) -> Iterator[list[str]]:
    """The labels of each tag of a text; an expression ends at its line's end or at the next tag."""
    at, line = lower.find(TAG_RAW), -1
    while at >= 0:
        start = at + len(TAG_RAW)
        following = lower.find(TAG_RAW, start)
        if line < start:
            line = lower.find(b"\n", start)
            line = len(lower) if line < 0 else line
        end = min(line, following) if following >= 0 else line
        yield labels_of(lower, start, end)
        at = following


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    phrases = {p: (label, BASE_WEIGHTS[label], True) for p, label in BASE.items()} | {p: (*x, False) for p, x in MORE.items()} | {TAG: ("spdx", TAG_WEIGHT, False)}
    for phrase, (label, weight, base) in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, weight, base))
    found.make_automaton()
    return found


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of a text."""
    raw = text.encode()
    words = raw.translate(FOLD).split()
    joined = " " + b" ".join(words).decode("latin-1") + " "  # a character for each byte
    n_base, first, last, base_labels, labels, miss, word, seen = 0, None, None, set(), set(), 1.0, 0, 0
    places = []
    for end, (length, label, weight, base) in automaton().iter(joined):
        labels.add((label, weight))
        if base:
            places.append(end - length + 1)
            base_labels.add(label)
    for at in sorted(places):  # each space up to a place begins a word
        word += joined.count(" ", seen, at)
        seen = at
        n_base += 1
        first = word if first is None else first
        last = word
    named = {x for x, _ in labels}
    if "spdx" in named:
        for found in tags(raw.lower()):
            named.update(found)
    for _, weight in sorted(labels):
        miss *= 1 - weight
    return len(words), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(named)), round(1 - miss, 9)


def scan_licenses(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, empty labels and score 0. Places may overlap and all count; repeated rows each
    get a row; an empty table gives an empty result. Further input columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        rows = list(zip(*(scan(x or "") for x in batch.column(1).to_pylist())))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        return {id_column: batch.column(0)} | {n: pa.array(list(r), k) for n, r, k in zip(names, rows, kinds)}

    schema = f"`{id_column}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return map_batches(docs.select(id_column, text_column), make, schema)
