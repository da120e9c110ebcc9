"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters are lexicon entries and patterns. Lexicon entries are stretches of words (a blank marks a word's edge) that the
labelled sample finds far more often in toxic texts; patterns are shouting, masked or repeated words and the like. The label model
is fitted without labels: expectation maximisation estimates each voter's rate under either class, and the correlation that
voters keep within the classes; correlated voters speak with one voice, and who does not vote abstains. A logistic
regression on densities of the voters' hits is then trained on the posteriors and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.llm.common import map_batches

#: Bound of the training sample: rows of either label, with whole texts of any length.
SAMPLE_TEXTS = {1: 600, 0: 1200}
GRAMS = range(4, 9)
LONGEST = 26  # a whole word with its edges up to this length is an entry too
LEXICON = 80
LEAST_TEXTS = 3  # toxic texts that hold an entry
LEAST_HITS = (1, 2, 4)  # from how many hits on an entry may vote
LEAST_PRECISION = 0.95  # of an entry in the sample
ROUNDS = 40
CORRELATED = 0.25
THRESHOLD = 0.7
OTHER = re.compile(r"[\W\d_]+")
CAPITALS = re.compile("[A-Z]+")
SMALL = re.compile("[a-z]+")
SHOUT = re.compile("!{2,}")
MARKS = re.compile("[#$%&*]+")
MASKED = re.compile(r"[^\W\d_][*@#$]+[^\W\d_]")
LEET = re.compile(r"[^\W\d_][013457]+[^\W\d_]")
AGAIN = re.compile(r"\b([^\W\d_]{3,})(?:[\W_]+\1\b){2,}", re.IGNORECASE)
PATTERNS = 6  # voters that patterns() has


def folded(text: str) -> str:
    """Lower-case words between single blanks."""
    return f" {OTHER.sub(' ', text.lower()).strip()} "


def patterns(text: str) -> list[float]:
    """Votes of the pattern voters, which know no language: mostly capitals, runs of exclamation marks, other marks,
    words with masked letters, words with digits for letters, a word three times in a row."""
    words = text.count(" ") + 1
    upper, small = len(text) - len(CAPITALS.sub("", text)), len(text) - len(SMALL.sub("", text))
    marks = len(MARKS.findall(text))
    masked = bool(marks) and len(MASKED.findall(text)) > 0.1 * words
    leet = any(map(text.__contains__, "013457")) and len(LEET.findall(text)) > 0.2 * words
    return [float(upper > small), float("!!" in text and len(SHOUT.findall(text)) > 0.2 * words), float(marks > 0.5 * words), float(masked), float(leet), float(AGAIN.search(text) is not None)]


@dataclass
class Model:
    """Lexicon and the linear classifier; the label model's estimates are kept for inspection."""

    lexicon: list[tuple[str, int]] = field(default_factory=list)  # entry, hits from which it votes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0
    rates: np.ndarray | None = None
    correlation: np.ndarray | None = None
    _found: object = None

    def automaton(self):
        if self._found is None and self.lexicon:
            import ahocorasick

            self._found = ahocorasick.Automaton()
            places: dict[str, list[int]] = {}
            for k, (entry, _) in enumerate(self.lexicon):
                places.setdefault(entry, []).append(k)
            for entry, ks in places.items():
                self._found.add_word(entry, ks)
            self._found.make_automaton()
        return self._found

    def __getstate__(self):
        return self.__dict__ | {"_found": None}

    def hits(self, text: str) -> np.ndarray:
        """Hits of each lexicon entry, then the pattern voters."""
        out = np.zeros(len(self.lexicon) + PATTERNS)
        if text and self.lexicon:
            for _, ks in self.automaton().iter(folded(text)):
                for k in ks:
                    out[k] += 1
            for k, (_, least) in enumerate(self.lexicon):
                if out[k] < least:
                    out[k] = 0
        out[len(self.lexicon) :] = patterns(text or "")
        return out

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        x = features(self.hits(text or ""), len(self.lexicon))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40))))



def features(hits: np.ndarray, lexicon: int) -> np.ndarray:
    """Votes, the count of different entries and the logarithm of all hits."""
    own = hits[..., :lexicon]
    return np.concatenate([np.minimum(hits, 1), np.minimum(own, 1).sum(axis=-1, keepdims=True), np.log1p(own.sum(axis=-1, keepdims=True))], axis=-1)


def entries(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Lexicon: stretches of words, with the least number of hits, that mark toxic texts; the best first, of equal ones the longest."""
    toxic = sum(y for _, y in rows)

    def grams(text: str, only: dict | None = None) -> Counter:
        """Hits of each stretch in a text, or of those that ``only`` holds."""
        out: Counter[str] = Counter()
        for w, n in Counter(folded(text).split()).items():
            edged = f" {w} "
            if GRAMS[-1] < len(edged) <= LONGEST and (only is None or edged in only):
                out[edged] += n
            for size in GRAMS:
                for i in range(len(edged) - size + 1):
                    g = edged[i : i + size]
                    if only is None or g in only:
                        out[g] += n
        return out

    # texts by hashed stretch first: what too few toxic texts hold never becomes an entry of the table
    slots = np.zeros(1 << 22, np.uint16)
    for text, y in rows:
        if y:
            slots[np.unique(np.array([hash(g) & 0x3FFFFF for g in grams(text)], np.int64))] += 1
    in_toxic: dict[str, list[int]] = {}
    for text, y in rows:
        if y:
            for g, n in grams(text).items():
                if slots[hash(g) & 0x3FFFFF] >= LEAST_TEXTS:
                    counts = in_toxic.setdefault(g, [0] * len(LEAST_HITS))
                    for k, least in enumerate(LEAST_HITS):
                        counts[k] += n >= least
    in_toxic = {g: c for g, c in in_toxic.items() if c[0] >= LEAST_TEXTS}
    in_clean = {g: [0] * len(LEAST_HITS) for g in in_toxic}
    for text, y in rows:
        if not y:
            for g, n in grams(text, in_toxic).items():
                for k, least in enumerate(LEAST_HITS):
                    in_clean[g][k] += n >= least
    ranked, share, surprise = [], toxic / len(rows), np.log(max(1, len(in_toxic))) + 1  # more than the best of so many by chance
    for g, held in in_toxic.items():
        for k, least in enumerate(LEAST_HITS):
            c, n = held[k], in_clean[g][k]
            if c < LEAST_TEXTS or c / (c + n) < LEAST_PRECISION:
                continue
            gain = c * np.log(c / (c + n) / share) + (n * np.log(n / (c + n) / (1 - share)) if n else 0)
            if gain >= surprise:
                ranked.append((-(c / max(1, toxic)) * (c / (c + n + 1)) ** 12, least, -len(g), g, c))
    chosen: list[tuple[str, int, int]] = []
    for _, least, _, g, c in sorted(ranked):
        # an entry inside or around a chosen one with as many texts says nothing of its own
        if any((g in x or x in g) and c <= 1.1 * held for x, _, held in chosen if least > 1 or abs(held - c) <= 0.1 * c):
            continue
        chosen.append((g, least, c))
        if len(chosen) == LEXICON:
            break
    return [(g, least) for g, least, _ in chosen]


def groups(correlation: np.ndarray) -> np.ndarray:
    """A number for each voter: the same for voters linked by correlations of at least CORRELATED."""
    label = np.arange(len(correlation))
    linked = correlation >= CORRELATED
    for _ in range(len(label)):
        least = np.where(linked, label[None, :], len(label)).min(axis=1)
        if (least >= label).all():
            break
        label = np.minimum(label, least)
    return np.unique(label, return_inverse=True)[1]


def label_model(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class of each row, each voter's rates (clean, toxic), correlations within the classes.

    Starts from the share of voters that vote; no labels enter.
    """
    n, m = votes.shape
    some = votes[:, : m - PATTERNS].any(axis=1).astype(float)
    posterior = np.where(some > 0, 0.95, 0.05)
    prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
    rates, correlation = np.full((2, m), 0.5), np.eye(m)
    for _ in range(ROUNDS):
        before = posterior
        weight = np.stack([1 - posterior, posterior])
        rates = (weight @ votes + np.array([[0.02], [0.5]])) / (weight.sum(axis=1, keepdims=True) + 1)
        silent = 1 - (weight @ some + np.array([0.02, 0.98])) / (weight.sum(axis=1) + 1)
        spread = votes - (1 - posterior)[:, None] * rates[0] - posterior[:, None] * rates[1]
        deviation = np.sqrt((spread * spread).mean(axis=0) + 1e-9)
        correlation = (spread.T @ spread) / n / np.outer(deviation, deviation)
        group = groups(correlation)  # voters that say the same have one voice, that of the surest who votes
        # who does not vote abstains, but that no lexicon entry votes at all is evidence of its own
        says = votes * np.log(rates[1] / rates[0])
        odds = np.log(prior / (1 - prior)) + (1 - some) * np.log(silent[1] / silent[0])
        for g in range(group.max() + 1):
            own = says[:, group == g]
            odds += own[np.arange(n), np.abs(own).argmax(axis=1)]
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(posterior - before).max() < 1e-6:
            break
    return posterior, rates, correlation


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a regularised logistic regression on soft labels, by Newton steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    damp = np.full(z.shape[1], ridge)
    damp[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(damp), z.T @ (y - p) - damp * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(rows: list[tuple[str, int]]) -> Model:
    """A model of (text, label) rows; without toxic or clean rows one that scores 0."""
    model = Model()
    if len({y for _, y in rows}) < 2:
        return model
    model.lexicon = entries(rows)
    if not model.lexicon:
        return model
    hits = np.array([model.hits(t) for t, _ in rows])
    posterior, model.rates, model.correlation = label_model(np.minimum(hits, 1))
    model.weights, model.bias = logistic(features(hits, len(model.lexicon)), posterior)
    return model


def sample(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
           texts: dict[int, int] | None = None) -> list[tuple[str, int]]:
    """At most so many whole texts of either label, of any length: the first by a hash of the id.

    The ids are drawn from ``labels`` alone, so that only their texts move. An id with several labels counts for each; of
    rows in ``docs`` with one id and text one is taken, and of more than the bound those first by a hash of id and text.
    """
    most = texts or SAMPLE_TEXTS
    order = F.xxhash64(F.col(id_column).cast("string"), F.lit("sample"))
    usable = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id"), F.col(label_column).cast("int").alias("__label"), order.alias("__order"))
    counts = {r[0]: r[1] for r in usable.groupBy("__label").agg(F.approx_count_distinct("__order")).collect()}
    if not counts:
        return []
    rate = F.lit(0.0)  # twice the wanted share, so that hardly a draw falls short
    for y, n in counts.items():
        rate = F.when(F.col("__label") == y, F.lit(min(1.0, 2 * most[y] / max(1, n)))).otherwise(rate)
    draw = F.pmod("__order", F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.where(draw < rate).dropDuplicates(["__id", "__label"])
    drawn = drawn.withColumn("__rank", F.row_number().over(Window.partitionBy("__label").orderBy("__order"))).where(" or ".join(f"__label = {y} and __rank <= {n}" for y, n in most.items()))
    found = docs.where(F.length(text_column) > 0).join(F.broadcast(drawn.drop("__rank")), F.col(id_column) == F.col("__id"))  # as many as the bound
    once = found.select(F.col(text_column).alias("text"), "__label", F.xxhash64("__order", text_column).alias("at")).dropDuplicates(["__label", "at"])
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy("__label").orderBy("at"))).where(" or ".join(f"__label = {y} and rank <= {n}" for y, n in most.items()))
    return sorted((r[0], r[1]) for r in once.select("text", "__label").collect())


def score_texts(docs: DataFrame, model: Model, *, keep: dict[str, Column], text_column: str = "text", threshold: float = THRESHOLD, with_text: bool = False) -> DataFrame:
    """One row per input row: the ``keep`` columns, score (0 to 1), predicted (1 from the threshold on), and the text if wanted.

    Null and empty texts score as texts in which no voter votes. A model that learnt nothing scores 0. Repeated rows each
    get a row; an empty table gives an empty result.
    """
    kept = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_column).alias("__text"))
    names = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON entries

    def make(batch: pa.RecordBatch) -> dict:
        texts = batch.column(batch.num_columns - 1)
        scores = [round(shared.value.score(x), 9) for x in texts.to_pylist()]
        own = {n: batch.column(k) for k, n in enumerate(names)}
        out = own | {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(x >= threshold) for x in scores], pa.int32())}
        return out | {"__text": texts} if with_text else out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return map_batches(kept, make, f"{kinds}, score double, predicted int" + ", __text string" * with_text)
