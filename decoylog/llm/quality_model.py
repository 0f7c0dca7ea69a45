"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
How far each one can be trusted is not given but estimated, by expectation
maximisation over a latent class: all documents are reduced to the counts of
their vote patterns (at most 3 ** labellers, so a bounded table), the E step
gives each pattern its posterior, the M step each labeller its vote
probabilities per class.  The posteriors are the training labels of a linear
scorer over hashed words and word shapes, which then scores every document.

All documents count in the estimation; the scorer is fitted on at most
``TRAIN_ROWS`` different texts (those of smallest hash), a documented bound.

Defined results: a null or empty text, or one of white space only, has score 0
and is not kept; repeated rows count as often as they come, and each has its
row; an empty table gives an empty result.  The ``labels`` table is never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from decoylog.llm.common import cut, text_key
from decoylog.llm.simhash import word_blocks

BAD, GOOD, NOTHING = "-", "+", "0"
VOTES = BAD + GOOD + NOTHING
LABELLERS = (
    "length", "word", "symbols", "bare", "letters", "case", "adjacent", "variety", "lines", "ends",
)
EM_STEPS = 100
FEATURE_BITS = 14
TRAIN_ROWS = 8_192
FIT_STEPS = 300
PENALTY = 1e-4
#: Words whose feature numbers a task remembers.
REMEMBERED = 1 << 18

_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"
_SHAPE = bytes(
    0x41 if b in _UPPER else 0x61 if b in _LETTERS else 0x30 if 0x30 <= b <= 0x39 else b
    for b in range(256)
)


def _vote(bad: bool, good: bool) -> str:
    return BAD if bad else GOOD if good else NOTHING


class Reading:
    """What one pass over the words of a text gives: word counts and simple totals."""

    def __init__(self, text: str | None) -> None:
        data = (text or "").encode("utf-8", "surrogatepass")
        self.words: Counter = Counter()
        self.total = self.adjacent = self.ends = 0
        last = None
        for block in word_blocks(data):
            if not block:
                continue
            self.words.update(block)
            self.total += len(block)
            self.adjacent += sum(map(eq, block, block[1:])) + (block[0] == last)
            last = block[-1]
        without = lambda drop: len(data) - len(data.translate(None, drop))
        self.letters, self.upper = without(_LETTERS), without(_UPPER)
        self.symbols = without(_SYMBOLS)
        self.signs = sum(map(data.count, (b".", b"?", b",", b";", b":")))
        self.shouts = data.count(b"!")
        self.bare = sum(
            n for w, n in self.words.items() if len(w) == len(w.translate(None, _LETTERS))
        )
        self.visible = sum(len(w) * n for w, n in self.words.items())
        lines = [line for line in data.split(b"\n") if line.strip()]
        self.lines, self.line_kinds = len(lines), len(set(lines))

    def votes(self) -> str:
        """One sign per labeller, in the order of LABELLERS."""
        n = max(self.total, 1)
        shown = max(self.visible, 1)
        mean = self.visible / n
        symbols, bare, letters = self.symbols / n, self.bare / n, self.letters / shown
        upper = self.upper / max(self.letters, 1)
        adjacent = self.adjacent / n
        variety = len(self.words) / n
        again = 1 - self.line_kinds / max(self.lines, 1)
        none = self.total == 0
        signs = self.signs / n
        return "".join(
            (
                _vote(n < 5 or none, 50 <= n <= 50_000),
                _vote(mean < 2.5 or mean > 15, 3.5 <= mean <= 10),
                _vote(symbols > 0.1, symbols < 0.01 and not none),
                _vote(bare > 0.15, bare < 0.02 and not none),
                _vote(letters < 0.7, letters > 0.85),
                _vote(upper > 0.4 and n >= 5, upper < 0.1 and not none),
                _vote(adjacent > 0.2 and n >= 10, adjacent < 0.05 and n >= 10),
                _vote(variety < 0.1 and n < 5_000, variety > 0.3 and n >= 50),
                _vote(again > 0.3 and self.lines > 3, again == 0 and self.lines > 3),
                _vote(
                    n >= 20 and (signs < 0.01 or self.shouts > 0.2 * n),
                    0.03 < signs < 0.5 and self.shouts < 0.05 * n,
                ),
            )
        )


def feature_numbers(word: bytes) -> tuple[int, int]:
    """Hashed places of a word and of its shape (letter case, digits, other signs)."""
    shape = bytearray()
    for sign in word.translate(_SHAPE):
        if not shape or shape[-1] != sign:
            shape.append(sign)
    top = 64 - FEATURE_BITS
    return xxh64_intdigest(word.lower()) >> top, xxh64_intdigest(bytes(shape), 1) >> top


def features(reading: Reading, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a text: log counts at unit length; repetition has a place too."""
    totals: dict[int, int] = {}
    for word, n in reading.words.items():
        places = known.get(word)
        if places is None:
            if len(known) >= REMEMBERED:
                known.clear()
            places = known[word] = feature_numbers(word)
        for place in places:
            totals[place] = totals.get(place, 0) + n
    if reading.adjacent:
        place = xxh64_intdigest(b"adjacent", 2) >> (64 - FEATURE_BITS)
        totals[place] = totals.get(place, 0) + reading.adjacent
    places = np.fromiter(totals.keys(), dtype=np.int32, count=len(totals))
    weights = np.log1p(np.fromiter(totals.values(), dtype=np.float64, count=len(totals)))
    return places, weights / max(np.linalg.norm(weights), 1e-12)


def _texts(docs: DataFrame, *carried: str) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), *carried)


def vote_patterns(docs: DataFrame) -> DataFrame:
    """pattern and order (a hash of the text) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [Reading(text.as_py()).votes() for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(votes, type=pa.string()), batch.column(1)], names=["pattern", "order"]
            )

    keyed = docs.select("text", text_key(F.col("text")).alias("order"))
    return _texts(keyed, "order").mapInArrow(run, "pattern string, order bigint")


def estimate(patterns: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern, P(vote good) [labeller, class], prior of good.

    A labeller that says nothing tells nothing; its accuracies are those of the
    votes it casts.  The start takes every warning seriously, since most
    documents of either class pass most heuristics; one vote of each kind is
    added, so that no probability becomes zero.
    """
    votes = np.array([[VOTES.index(v) for v in p] for p in patterns])
    said_bad, said_good = votes == 0, votes == 1
    good = 0.95 - 0.45 * np.minimum(said_bad.sum(1), 2)
    for _ in range(EM_STEPS):
        weight = np.stack((counts * (1 - good), counts * good))
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        yes = (weight @ said_good + 1).T
        table = yes / (yes + (weight @ said_bad + 1).T)
        logs = np.log(prior)[:, None] + (
            np.log(table).T @ said_good.T + np.log(1 - table).T @ said_bad.T
        )
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return good, table, float(prior[1])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic scorer on posterior labels."""
    size = 1 << FEATURE_BITS
    weights = np.zeros(size + 1)
    if not rows:
        return weights
    lengths = np.array([len(p) for p, _, _ in rows])
    owner = np.repeat(np.arange(len(rows)), lengths)
    places = np.concatenate([p for p, _, _ in rows])
    values = np.concatenate([v for _, v, _ in rows])
    wanted = np.array([y for _, _, y in rows])
    # Either class has half the say, however rare it is.
    share = np.clip(wanted.mean(), 1e-3, 1 - 1e-3)
    say = wanted * 0.5 / share + (1 - wanted) * 0.5 / (1 - share)
    say /= say.sum()
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, FIT_STEPS + 1):
        raw = np.bincount(owner, weights=values * weights[places], minlength=len(rows))
        error = say * (1 / (1 + np.exp(-(raw + weights[-1]))) - wanted)
        slope = np.append(
            np.bincount(places, weights=values * error[owner], minlength=size), error.sum()
        )
        slope += PENALTY * np.append(weights[:-1], 0.0) / size
        # Adaptive moments: a fixed number of steps on a fixed number of rows.
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= (
            0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
        )
    return weights


def _training_rows(docs: DataFrame, posterior: dict[str, float], most: int) -> list[tuple]:
    """Places, weights and posterior of at most TRAIN_ROWS different texts, by smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            readings = [Reading(text.as_py()) for text in batch.column(0)]
            made = [features(r, known) for r in readings]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _ in made], type=pa.list_(pa.int32())),
                    pa.array([w for _, w in made], type=pa.list_(pa.float64())),
                    pa.array([r.votes() for r in readings], type=pa.string()),
                    batch.column(1),
                ],
                names=["places", "weights", "pattern", "order"],
            )

    keyed = docs.select("text", text_key(F.col("text")).alias("order"))
    chosen = keyed.where(F.col("order") <= most).dropDuplicates(["order"])
    rows = _texts(chosen, "order").mapInArrow(
        run, "places array<int>, weights array<double>, pattern string, order bigint"
    )
    return [
        (np.array(r["places"], dtype=np.int64), np.array(r["weights"]), posterior[r["pattern"]])
        for r in rows.orderBy("order").limit(TRAIN_ROWS).toLocalIterator()
    ]


def classify(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, weak_label (posterior of the votes), score (0 to 1) and kept of every row."""
    patterns = cut(vote_patterns(docs))
    table = patterns.groupBy("pattern").count().collect()
    names = sorted(row["pattern"] for row in table)
    by_name = {row["pattern"]: row["count"] for row in table}
    different = patterns.select("order").distinct().count()
    posterior: dict[str, float] = {}
    weights = np.zeros((1 << FEATURE_BITS) + 1)
    if names:
        good, _, _ = estimate(names, np.array([by_name[n] for n in names], dtype=float))
        posterior = dict(zip(names, good.tolist()))
        # Hashes are evenly spread: those below this bound are TRAIN_ROWS or so.
        share = min(1.0, 0.95 * TRAIN_ROWS / different)
        most = int(-(2**63) + share * (2**64 - 1))
        weights = fit_scorer(_training_rows(docs, posterior, min(most, 2**63 - 1)))
    shared = docs.sparkSession.sparkContext.broadcast((weights, posterior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior = shared.value
        known: dict = {}
        for batch in batches:
            labels, scores = [], []
            for text in batch.column(0):
                reading = Reading(text.as_py())
                labels.append(posterior[reading.votes()])
                places, values = features(reading, known)
                raw = float(values @ weights[places]) + weights[-1]
                scores.append(1 / (1 + np.exp(-np.clip(raw, -50, 50))) if len(places) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(labels, pa.float64()), pa.array(scores, pa.float64())],
                names=["doc_id", "weak_label", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        _texts(docs, "doc_id")
        .mapInArrow(run, f"doc_id {kind}, weak_label double, score double")
        .withColumn("kept", F.col("score") >= threshold)
    )
