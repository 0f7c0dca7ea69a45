"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; every run of characters that are no letters becomes one
space, and a text starts and ends with one.  For each language the corpus gives
the counts of all its character n-grams of the top order; the lower orders use
continuation counts, the number of different characters seen to the left.  All
orders are interpolated with one absolute discount each, estimated from the
counts of counts.

All documents of the training fold are counted and all their n-grams are kept;
nothing is sampled, and there is no limit on languages.  A model's tables are
arrays sorted by a 64-bit hash of whole code points (one to one below the top
order) and searched by bisection.  The n-grams stay a distributed table.  They are
dealt into ranges of about ``RANGE_ROWS`` by the two characters that an n-gram and
its contexts share, so one range at a time passes the driver and is handed to the
tasks, and a document's cross-entropy is the sum over the ranges.  Most corpora
have one range, and then no sum is needed.

A text's language is the one with the lowest cross-entropy per character.  Two
things are calibrated on documents that the calibrated models have not seen: the
probability that the answer is right, a logistic curve over the margin to the
second-best language, and per language the cross-entropy above which a text is
rejected as belonging to none.  The final models are then made from the counts
of both folds.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and is rejected; rows without a language are predicted but teach nothing;
repeated rows count as often as they come; ties go to the language that sorts
first; a language that no unseen row was recognised in has the other languages'
most lenient bound of rejection; a table without any labelled row predicts ``und`` everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoylog.llm.common import cut, text_key

ORDER = 4
#: Bits of a code point, and of the three last characters of an n-gram.
BITS = 21
#: N-grams of the two highest orders, of all languages, that a task holds at once.
RANGE_ROWS = 1 << 22
#: Share of correctly labelled unseen documents above whose entropy a text is rejected.
REJECT_ABOVE = 0.999
UNKNOWN = "und"
BLOCK = 1 << 18
#: A character never seen in a language: an even share of Unicode's letters.
UNSEEN = 1.0 / (1 << 17)
#: Scores (n-grams by languages) that a task remembers.
REMEMBERED = 1 << 22
#: N-grams counted in a task before they are handed on.
COUNTED = 1 << 20

_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LEFT = np.uint64(0xC2B2AE3D27D4EB4F)
#: Deals pairs of characters to ranges, in tasks and in column expressions alike.
_DEAL = 1_000_003

#: Top-order n-grams: the first character, and the three others in one integer.
Grams = tuple[np.ndarray, np.ndarray]


def blocks_of(text: str) -> Iterator[np.ndarray]:
    """Characters of the normalised text in arrays that overlap by an n-gram less one."""
    clean = f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "
    points = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Before the first character stand spaces, so each character ends one n-gram.
    points = np.concatenate((np.full(ORDER - 2, 32, dtype=np.uint32), points))
    for start in range(0, max(1, len(points) - ORDER + 1), BLOCK):
        yield points[start : start + BLOCK + ORDER - 1]


def packed(points: np.ndarray) -> Grams:
    """All top-order n-grams of a block of characters."""
    n = max(len(points) - ORDER + 1, 0)
    points = points.astype(np.uint64)
    rest = np.zeros(n, dtype=np.uint64)
    for i in range(1, ORDER):
        rest = (rest << np.uint64(BITS)) | points[i : i + n]
    return points[:n], rest


def hashed(rest: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit value of up to three characters, one to one, or of four."""
    mixed = rest if left is None else rest ^ (left * _LEFT)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _SPREAD
    return mixed ^ (mixed >> np.uint64(32))


def range_of(rest: np.ndarray, ranges: int) -> np.ndarray:
    return (rest >> np.uint64(BITS)) % np.uint64(_DEAL) % np.uint64(ranges)


def merged(left: np.ndarray, rest: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different n-grams with their summed counts."""
    key = hashed(rest, left)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    first = order[starts]
    return left[first], rest[first], np.add.reduceat(n[order], starts)


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return merged(*(np.concatenate(columns) for columns in zip(*parts)))


def _grams_of(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """(first character, others, counts) of bounded amounts of text."""
    held, size = [], 0
    for text in texts:
        for block in blocks_of(text):
            left, rest = packed(block)
            held.append((left, rest, np.ones(len(left), dtype=np.int64)))
            size += len(left)
            if size >= BLOCK:
                yield _merge(held)
                held, size = [], 0
    if size:
        yield _merge(held)


def gram_counts(docs: DataFrame, fold: Column) -> DataFrame:
    """lang, fold, left, rest, n: counts of the top-order n-grams of all labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, list[tuple[np.ndarray, ...]]] = {}

        def size() -> int:
            return sum(len(part[0]) for parts in totals.values() for part in parts)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, part), parts in totals.items():
                left, rest, n = _merge(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(n), type=pa.string()),
                        pa.array([part] * len(n), type=pa.int32()),
                        pa.array(left.astype(np.int32)),
                        pa.array(rest.astype(np.int64)),
                        pa.array(n),
                    ],
                    names=["lang", "fold", "left", "rest", "n"],
                )
            totals.clear()

        for batch in batches:
            groups: dict[tuple, list[str]] = {}
            for text, lang, part in zip(*(column.to_pylist() for column in batch.columns)):
                if text and _LETTER.search(text):
                    groups.setdefault((lang, part), []).append(text)
            for key, texts in groups.items():
                for counts in _grams_of(texts):
                    totals.setdefault(key, []).append(counts)
                    if size() > 2 * COUNTED:
                        for done, parts in totals.items():
                            totals[done] = [_merge(parts)]
                        if size() > COUNTED:
                            yield from out()
        yield from out()

    rows = docs.where(F.col("lang").isNotNull()).select(
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        fold.cast("int").alias("fold"),
    )
    return (
        rows.mapInArrow(run, "lang string, fold int, left int, rest bigint, n bigint")
        .groupBy("lang", "fold", "left", "rest")
        .agg(F.sum("n").alias("n"))
    )


def _order_tables(counts: DataFrame) -> DataFrame:
    """lang, size, left, rest, n: (continuation) counts of n-grams by order.

    The top order has the counts, each lower one how many different characters
    were seen before its n-grams.
    """
    whole = counts.groupBy("lang", "left", "rest").agg(F.sum("n").alias("n"))
    whole = whole.select("lang", F.lit(ORDER).alias("size"), "left", "rest", "n")
    grams = whole
    for size in range(ORDER - 1, 0, -1):
        part = F.col("rest").bitwiseAND(F.lit((1 << (BITS * size)) - 1))
        grams = (
            grams.withColumn("rest", part)
            .groupBy("lang", "rest")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("lang", F.lit(size).alias("size"), F.lit(0).alias("left"), "rest", "n")
        )
        whole = whole.union(grams)
    return whole


def model_of(
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], discounts: dict[int, float]
) -> list[tuple]:
    """One language: per order (hashes, own share, contexts, back-off weight), sorted by hash."""
    orders = []
    for size in range(1, ORDER + 1):
        left, rest, counts = tables[size]
        hashes = hashed(rest, left) if size == ORDER else hashed(rest)
        order = np.argsort(hashes, kind="stable")
        contexts = _context(left[order], rest[order])
        counts, discount = counts[order].astype(np.float64), discounts.get(size, 0.5)
        places, at = np.unique(contexts, return_inverse=True)
        total = np.bincount(at, weights=counts)
        own = np.maximum(counts - discount, 0) / total[at]
        orders.append((hashes[order], own, places, discount * np.bincount(at) / total))
    return orders


def _context(left: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Hash of all characters but the last; ``left`` is zero below the top order."""
    return hashed((left << np.uint64(BITS * (ORDER - 2))) | (rest >> np.uint64(BITS)))


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def log_probability(model: list[tuple], grams: Grams) -> np.ndarray:
    """Of the last character of each top-order n-gram, given those before it."""
    left, rest = grams
    none = np.zeros_like(left)
    probability = np.full(len(left), UNSEEN)
    for size, (hashes, own, places, weight) in enumerate(model, 1):
        top = size == ORDER
        part = rest if top else rest & np.uint64((1 << (BITS * size)) - 1)
        back = _find(places, weight, _context(left if top else none, part), 1.0)
        shares = _find(hashes, own, hashed(part, left) if top else hashed(part), 0.0)
        probability = shares + back * probability
    return np.log(probability)


class Models:
    """The models of all languages: a table of their n-grams, read range by range.

    On the driver are four numbers per language and one range's arrays at a time.
    """

    def __init__(self, counts: DataFrame) -> None:
        self.table = cut(_order_tables(counts))
        rows = self.table.groupBy("lang", "size").agg(
            F.count_if(F.col("n") == 1).alias("once"),
            F.count_if(F.col("n") == 2).alias("twice"),
            F.count(F.lit(1)).alias("rows"),
        ).collect()
        self.names = sorted({row["lang"] for row in rows})
        self.discounts: dict[str, dict[int, float]] = {name: {} for name in self.names}
        for row in rows:
            once, twice = row["once"], row["twice"]
            share = once / (once + 2.0 * twice) if once else 0.5
            self.discounts[row["lang"]][row["size"]] = min(max(share, 0.1), 0.9)
        high = sum(row["rows"] for row in rows if row["size"] >= ORDER - 1)
        self.ranges = max(1, -(-high // RANGE_ROWS))

    def read(self, number: int) -> list[list[tuple]]:
        """One model per language, of the n-grams of one range.

        Orders 1 and 2 are in every range, as their contexts are no part of the deal.
        """
        dealt = F.shiftright("rest", BITS) % _DEAL % self.ranges
        found = self.table.where((F.col("size") < ORDER - 1) | (dealt == number)).toArrow()
        if not self.names:
            return []
        langs = found.column("lang").to_numpy(zero_copy_only=False).astype(str)
        codes = np.searchsorted(np.array(self.names), langs)
        sizes = found.column("size").to_numpy()
        order = np.argsort(codes * (ORDER + 1) + sizes, kind="stable")
        ends = np.cumsum(np.bincount(codes * (ORDER + 1) + sizes, minlength=len(self.names) * (ORDER + 1)))
        kinds = {"left": np.uint64, "rest": np.uint64, "n": np.int64}
        columns = [found.column(c).to_numpy()[order].astype(k) for c, k in kinds.items()]
        models = []
        for code, name in enumerate(self.names):
            tables = {}
            for size in range(1, ORDER + 1):
                place = code * (ORDER + 1) + size
                tables[size] = tuple(c[ends[place - 1] : ends[place]] for c in columns)
            models.append(model_of(tables, self.discounts[name]))
        return models


class Scorer:
    """Log probabilities of n-grams under all models; those met before are remembered.

    ``state`` is plain data: the models, and the memory, which a worker keeps
    from task to task.
    """

    def __init__(self, state: dict) -> None:
        self.state, self.models = state, state["models"]
        self.most = REMEMBERED // max(1, len(self.models))

    def __call__(self, keys: np.ndarray, grams: Grams) -> np.ndarray:
        """``keys``, the hashes of the n-grams, sorted and different; one column per model."""
        known, table = self.state["memory"] or (keys[:0], np.zeros((0, len(self.models))))
        new = np.flatnonzero(~np.isin(keys, known, assume_unique=True))
        if len(new):
            if len(known) + len(new) > self.most:
                known, table, new = known[:0], table[:0], np.arange(len(keys))
            wanted = tuple(column[new] for column in grams)
            values = np.stack([log_probability(m, wanted) for m in self.models], axis=1)
            at = np.searchsorted(known, keys[new])
            known, table = np.insert(known, at, keys[new]), np.insert(table, at, values, axis=0)
            self.state["memory"] = (known, table)
        return table[np.searchsorted(known, keys)]


def cross_sums(
    scorer: Scorer, texts: list[str | None], number: int = 0, ranges: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """Negative log probabilities (nats) of each text under each model, and the characters.

    Only the n-grams of one range count.
    """
    models = scorer.models
    sums = np.zeros((len(texts), len(models)))
    lengths = np.zeros(len(texts))
    held, owners, size = [], [], 0

    def flush() -> None:
        left, rest = (np.concatenate(columns) for columns in zip(*held))
        keys, place = np.unique(hashed(rest, left), return_inverse=True)
        at = np.empty(len(keys), dtype=np.int64)
        at[place] = np.arange(len(place))
        owner = np.repeat(*(np.array(x) for x in zip(*owners)))
        lengths[:] += np.bincount(owner, minlength=len(texts))
        table = scorer(keys, (left[at], rest[at]))
        for m in range(len(models)):
            sums[:, m] -= np.bincount(owner, weights=table[place, m], minlength=len(texts))

    for i, text in enumerate(texts):
        if not text or not models or not _LETTER.search(text):
            continue
        for block in blocks_of(text):
            grams = packed(block)
            if ranges > 1:
                mine = range_of(grams[1], ranges) == number
                grams = tuple(column[mine] for column in grams)
            held.append(grams)
            owners.append((i, len(grams[0])))
            size += len(grams[0])
            if size >= BLOCK:
                flush()
                held, owners, size = [], [], 0
    if size:
        flush()
    return sums, lengths


def _pass(docs: DataFrame, models: Models, number: int, carried: tuple[str, ...]) -> DataFrame:
    """``carried`` columns, sums and length of every row, by the n-grams of one range."""
    shared = docs.sparkSession.sparkContext.broadcast(
        {"models": models.read(number), "memory": None}
    )
    ranges = models.ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            # A bounded number of documents at a time; long texts go in blocks.
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sums, lengths = cross_sums(scorer, batch.column(0).to_pylist(), number, ranges)
                ends = np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[1:],
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel())),
                        pa.array(lengths),
                    ],
                    names=[*carried, "sums", "length"],
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    found = docs.select("text", *carried).mapInArrow(
        run, f"{kinds}, sums array<double>, length double"
    )
    if ranges == 1:
        return found
    # One range after the other; its arrays leave the executors with its pass.
    found = cut(found)
    shared.destroy()
    return found


def _scored(docs: DataFrame, models: Models, *carried: str) -> DataFrame:
    """``carried`` columns, lang_pred, entropy and margin to the second-best language."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    if models.ranges == 1:
        summed = _pass(rows, models, 0, carried)
    else:
        # Equal rows are summed as one: their sums and lengths grow alike.
        rows = rows.withColumn("text_key", text_key(F.col("text")))
        key = (*carried, "text_key")
        parts = [_pass(rows, models, number, key) for number in range(models.ranges)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        sums = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(len(models.names))])
        copies = (F.count(F.lit(1)) / models.ranges).cast("int")
        summed = (
            whole.groupBy(*key)
            .agg(sums.alias("sums"), F.sum("length").alias("length"), copies.alias("copies"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        )
    names = F.array(*[F.lit(name) for name in models.names]).cast("array<string>")
    known = F.col("length") > 0
    each = F.when(known, F.transform("sums", lambda s: s / F.col("length")))
    return (
        summed.withColumn("each", each)
        .withColumn("ordered", F.sort_array("each"))
        .select(
            *carried,
            F.when(known, F.get(names, F.array_position("each", F.get("ordered", F.lit(0))) - 1))
            .otherwise(UNKNOWN)
            .alias("lang_pred"),
            F.get("ordered", F.lit(0)).alias("entropy"),
            F.when(
                known, F.coalesce(F.get("ordered", F.lit(1)) - F.get("ordered", F.lit(0)), F.lit(10.0))
            ).alias("margin"),
        )
    )


BINS = 500
BIN_WIDTH = 0.01


def _logistic(margins: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> tuple[float, float]:
    """(a, b) of P(right) = 1 / (1 + exp(-(a + b * margin))), by Newton steps."""
    a, b = 0.0, 10.0
    # Half a document of either outcome at the ends keeps separable data finite.
    x = np.concatenate((margins, [0.0, 0.0, margins.max(initial=0.0)]))
    r = np.concatenate((right, [0.5, 0.0, 0.5]))
    w = np.concatenate((wrong, [0.0, 0.5, 0.0]))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        n = r + w
        slope = np.array([(r - n * p).sum(), ((r - n * p) * x).sum()])
        h = n * p * (1 - p) + 1e-9
        bend = np.array([[h.sum(), (h * x).sum()], [(h * x).sum(), (h * x * x).sum()]])
        step = np.linalg.solve(bend + 1e-6 * np.eye(2), slope)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -20, 20))
        if np.abs(step).max() < 1e-6:
            break
    return a, max(b, 0.0)


def calibrate(scored: DataFrame) -> tuple[tuple[float, float], dict[str, float]]:
    """The curve, and each language's rejection bound, from scored labelled rows.

    At most BINS + 1 rows of sums and one row per language reach the driver.
    """
    right = (F.col("lang_pred") == F.col("lang")).cast("long")
    bins = scored.groupBy(F.least(F.floor(F.col("margin") / BIN_WIDTH), F.lit(BINS)).alias("bin")).agg(
        F.sum(right).alias("right"), F.sum(1 - right).alias("wrong")
    )
    rows = bins.where("bin IS NOT NULL").collect()
    table = np.array([(r["bin"], r["right"], r["wrong"]) for r in rows], dtype=float).reshape(-1, 3)
    curve = _logistic((table[:, 0] + 0.5) * BIN_WIDTH, table[:, 1], table[:, 2])
    bounds = (
        scored.where("lang_pred = lang")
        .groupBy("lang_pred")
        .agg(F.percentile_approx("entropy", REJECT_ABOVE, 10_000).alias("bound"))
        .collect()
    )
    return curve, {r["lang_pred"]: r["bound"] for r in bounds}


def identify(docs: DataFrame, held_out: Column, unseen: Column) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, entropy, rejected.

    ``held_out`` rows teach nothing.  Of the others, ``unseen`` rows calibrate
    models made from the rest, and then join the final models' counts.
    """
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"), unseen.alias("unseen"))
    learned = rows.where(~F.col("held_out") & F.col("lang").isNotNull())
    counts = cut(gram_counts(learned, F.col("unseen").cast("int")))
    trial = Models(counts.where("fold = 0"))
    scored = _scored(learned.where("unseen"), trial, "lang") if trial.names else None
    (a, b), bounds = calibrate(cut(scored)) if trial.names else ((0.0, 0.0), {})
    found = _scored(rows, Models(counts), "doc_id", "held_out")
    known = F.col("entropy").isNotNull()
    # A language without calibrating documents has the most lenient bound there is.
    bound = F.lit(float(max(bounds.values(), default=float("inf"))))
    if bounds:
        own = F.create_map(*[F.lit(x) for pair in sorted(bounds.items()) for x in pair])
        bound = F.coalesce(F.try_element_at(own, F.col("lang_pred")), bound)
    score = F.when(known, 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("margin"))))).otherwise(0.0)
    return found.select(
        "doc_id",
        "held_out",
        "lang_pred",
        score.alias("score"),
        "entropy",
        (~known | (F.col("entropy") > bound)).alias("rejected"),
    )
