"""Quality rules by robust multivariate outliers (DataFrame functions only).

Each document has a vector of transformed statistics.  Per language and source
the vector's centre and scatter are estimated by the minimum covariance
determinant: from robust starting values (median, interquartile range) the half
of the documents that lies closest, ``SUPPORT`` of them, gives a new mean and
covariance, and that step is repeated.  A document whose Mahalanobis distance is
beyond the cutoff is rejected, and so is one that fails the base rule.

A group's estimate is drawn towards that of all documents with the weight of
``PRIOR_ROWS`` documents, so a group of any size, even one, has an invertible
scatter; a small variance is added to every statistic's, so a statistic that is
constant in clean text does not make it singular either.

Defined results: a null or empty text has no words and fails the base rule; a
null ``lang`` or ``source`` is a group of its own; repeated rows are judged
alike, each in its own row; an empty table gives an empty result; columns other
than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoylog.llm.common import NOT_WHITE, cut, let, text_key, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: Share of a group's documents that an estimate rests on.
SUPPORT = 0.5
#: On check_s the mean log determinant is then within 1e-3 of where it settles (16 steps).
STEPS = 4
PRIOR_ROWS = 100
#: Tail of the chi-square distribution beyond which a document is an outlier.
TAIL = 1e-3

GROUP = ("lang", "source")
STATS = ("s_length", "s_word", "s_symbol", "s_line", "s_repeat")
#: Standard deviation added to each statistic's; the shares are logs of per cent.
#: With no scatter of its own a statistic alone rejects at twice or half the mean
#: word length, or above 8.6 symbols, 2.9 repeated lines (29 % of lines of ten
#: words) or 29 repeated words in 100 words.
FLOORS = (0.5, 0.15, 0.5, 0.3, 0.75)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that come at least twice in the text."""

    def spread(windows: Column) -> Column:
        ordered = F.sort_array(windows)
        return let(
            ordered,
            lambda s: F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            ),
        )

    def covered(found: Column) -> Column:
        """Size of the union of [p, p + WINDOW)."""
        places = F.sort_array(F.transform(found, lambda x: x["p"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, p: F.struct(
            (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - p)).alias("n"),
            (p + WINDOW).alias("end"),
        )
        return F.aggregate(places, zero, step, lambda acc: acc["n"])

    def count(w: Column) -> Column:
        last = F.greatest(F.size(w) - WINDOW, F.lit(0))
        hashes = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
        )

        def marked(h: Column) -> Column:
            windows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                covered(spread(windows))
            )

        return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, marked))

    return count(words)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, a key of the text, and the counts of the base rule."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    symbols = F.lit(0)
    for symbol in SYMBOLS:
        gone = F.replace(bare, F.lit(symbol), F.lit(""))
        symbols = symbols + F.octet_length(bare) - F.octet_length(gone)
    full_lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_WHITE))
    dup_lines = let(full_lines, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    counts = let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    return docs.select(
        "doc_id",
        "lang",
        "source",
        text_key(F.col("text")).alias("text_key"),
        counts.alias("counts"),
        symbols.cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
    ).select(
        "doc_id",
        "lang",
        "source",
        "text_key",
        *[
            F.col(f"counts.{name}").cast("long").alias(name)
            for name in ("n_words", "word_chars", "n_repeat_words")
        ],
        "n_symbols",
        "n_dup_lines",
    )


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def with_statistics(counts: DataFrame) -> DataFrame:
    """The vector: logs of length, word length, and of three shares in per cent."""
    words = F.col("n_words") + 1.0
    share = lambda name: F.log1p(100.0 * F.col(name) / words)
    return counts.withColumns(
        {
            "s_length": F.log(words),
            "s_word": F.log((F.col("word_chars") + 1.0) / words),
            "s_symbol": share("n_symbols"),
            "s_line": share("n_dup_lines"),
            "s_repeat": share("n_repeat_words"),
        }
    )


def chi_square_cdf(x: float, dof: int) -> float:
    """Lower regularised gamma function of (dof / 2, x / 2), by its series."""
    a, z = dof / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if z else 0.0


def chi_square_cut(tail: float, dof: int) -> float:
    """The value exceeded with probability ``tail``."""
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - chi_square_cdf(middle, dof) > tail else (low, middle)
    return high


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _with_distance(rows: DataFrame, name: str) -> DataFrame:
    """Solve L y = x - mean step by step; the distance is the sum of y squared."""
    for i, stat in enumerate(STATS):
        rest = F.col(stat) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}_{i}"))
    total = F.lit(0.0)
    for i in range(len(STATS)):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return rows.withColumn(name, total).drop(*[f"y{i}" for i in range(len(STATS))])


def _factored(params: DataFrame) -> DataFrame:
    """Columns ``l{i}_{j}``: the Cholesky factor of the covariance ``c{i}_{j}``."""
    for i, j in _pairs():
        rest = F.col(f"c{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        value = (
            F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}")
        )
        params = params.withColumn(f"l{i}_{j}", value)
    return params.drop(*[f"c{i}_{j}" for i, j in _pairs()])


def _moments(scale: float) -> list[Column]:
    """Mean and (scaled) covariance; ``rows`` is the weight of the estimate."""
    stats = [F.col(s) for s in STATS]
    return [
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(stats)],
        *[
            (F.covar_pop(stats[i], stats[j]) * F.lit(scale)).alias(f"c{i}_{j}")
            for i, j in _pairs()
        ],
    ]


def _start() -> list[Column]:
    """Medians and interquartile ranges, with no covariance."""
    quartiles = [F.percentile_approx(s, [0.25, 0.5, 0.75], 1000) for s in STATS]
    return [
        F.count(F.lit(1)).alias("rows"),
        *[q[1].alias(f"m{i}") for i, q in enumerate(quartiles)],
        *[
            (F.pow((quartiles[i][2] - quartiles[i][0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(
                f"c{i}_{j}"
            )
            for i, j in _pairs()
        ],
    ]


def _blended(groups: DataFrame, whole: DataFrame) -> DataFrame:
    """Group estimates drawn towards the one of all documents (a single row); floors added."""
    names = [f"m{i}" for i in range(len(STATS))] + [f"c{i}_{j}" for i, j in _pairs()]
    everywhere = whole.first().asDict()
    weight = F.col("rows") / (F.col("rows") + F.lit(float(PRIOR_ROWS)))
    values = {}
    for name in names:
        common = F.lit(everywhere[name]).cast("double")
        mixed = weight * F.col(name) + (1 - weight) * common
        if name.startswith("c"):
            i, j = map(int, name[1:].split("_"))
            if i == j:
                mixed = mixed + F.lit(FLOORS[i] ** 2)
        values[name] = mixed
    return _factored(groups.select(*GROUP, *[values[n].alias(n) for n in names]))


def _joined(rows: DataFrame, params: DataFrame) -> DataFrame:
    renamed = params.withColumnsRenamed({name: f"p_{name}" for name in GROUP})
    on = rows["lang"].eqNullSafe(renamed["p_lang"]) & rows["source"].eqNullSafe(renamed["p_source"])
    return rows.join(renamed, on, "left").drop("p_lang", "p_source")


def mcd(rows: DataFrame) -> DataFrame:
    """Per lang and source: mean ``m{i}`` and Cholesky factor ``l{i}_{j}``.

    Every concentration step is two grouped aggregates over the vectors, with
    map-side partial results, so a group that holds a third of all documents
    costs its tasks no more than any other rows do.
    """
    dof = len(STATS)
    inner = chi_square_cut(1 - SUPPORT, dof)
    scale = SUPPORT / chi_square_cdf(inner, dof + 2)
    params = cut(_blended(rows.groupBy(*GROUP).agg(*_start()), rows.agg(*_start())))
    for _ in range(STEPS):
        near = _with_distance(_joined(rows, params), "d2")
        bounds = near.groupBy(*GROUP).agg(
            F.percentile_approx("d2", SUPPORT, 1000).alias("bound")
        )
        core = _joined(near.select(*GROUP, *STATS, "d2"), bounds).where(
            F.col("d2") <= F.col("bound")
        )
        # The pooled scatter is the mean scatter within groups.
        groups = cut(core.groupBy(*GROUP).agg(*_moments(scale)))
        weighted = lambda n: F.sum(F.col(n) * F.col("rows")) / F.sum("rows")
        whole = groups.agg(
            *[weighted(f"m{i}").alias(f"m{i}") for i in range(dof)],
            *[weighted(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in _pairs()],
        )
        params = cut(_blended(groups, whole))
    return params


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, distance, base_failed and kept."""
    rows = cut(with_statistics(base_counts(docs)))
    found = _with_distance(_joined(rows, mcd(rows)), "d2")
    cutoff = chi_square_cut(TAIL, len(STATS))
    failed = _base_failed()
    return found.select(
        "doc_id",
        "text_key",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("d2") <= cutoff)).alias("kept"),
        F.col("d2").alias("distance2"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that the rules keep."""
    verdicts = judge(docs).where("kept").select(
        F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key")
    )
    on = docs["doc_id"].eqNullSafe(verdicts["__doc_id"]) & (
        text_key(docs["text"]) == verdicts["__text_key"]
    )
    return docs.join(verdicts, on, "left_semi")
