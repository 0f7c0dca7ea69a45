"""Line deduplication by a segment-partition edit join (DataFrame functions only).

A line is a part of a text between line feeds.  It goes if the same line, or one
within ``max_edits`` insertions, deletions or substitutions of it, occurs earlier
(smaller doc_id, or earlier in the document).  Lines without a character other
than ASCII white space always stay; lines shorter than ``MIN_CHARS`` are only
compared as a whole, since one edit changes them too much.

1. Equal lines are collapsed to their first place.
2. Each line is split into ``max_edits`` + 1 segments, indexed by line length,
   segment number and content.  For every length that may match, the line's
   substrings at the few positions where such a segment can lie are probed; by
   the pigeonhole principle no pair within the bound is missed.
3. Pairs are verified: equal ends are taken off, and the banded bit-parallel
   edit distance of what is left decides.  The band holds 2 * max_edits + 1 cells
   in one integer, updated by a few bit operations per character.
4. A segment that more than ``CROWD`` lines share would give the square of that
   many pairs.  For those lines equality of texts with one character left out
   decides instead, which needs no pairs; it is exact too, for one edit, and the
   operator takes no larger bound.

Defined results: a null text has no lines and stays null; an empty text is one
blank line and stays; rows with the same doc_id are told apart by a key of their
text, equal rows are one document and each gets the same result; a null doc_id
comes first; an empty table gives an empty result; ``n_chars``, if there is one,
is that of the new text, and other columns are handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoylog.llm.common import NOT_WHITE, cut, let, release, text_key

MIN_CHARS = 20
CROWD = 64
KEY = ("doc_id", "text_key", "pos")
LINE = ("h1", "h2", "own")


def _place() -> Column:
    return F.struct(*KEY)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos, line of every line of every text that is not null."""
    return docs.where(F.col("text").isNotNull()).select(
        "doc_id",
        text_key(F.col("text")).alias("text_key"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )


def _keyed(lines: DataFrame) -> DataFrame:
    """Lines under a key of three numbers, with their place.

    Two hashes tell lines apart; a third number makes every blank line one of its own.
    """
    blank = ~F.col("line").rlike(NOT_WHITE)
    place = F.xxhash64(*KEY).bitwiseOR(F.lit(1))
    return lines.select(
        F.xxhash64("line").alias("h1"),
        F.when(blank, F.xxhash64(F.lit(2), *KEY))
        .otherwise(F.xxhash64(F.lit(1), "line"))
        .alias("h2"),
        F.when(blank, place).otherwise(F.lit(0)).cast("long").alias("own"),
        "line",
        _place().alias("at"),
    )


def _distinct(keyed: DataFrame) -> DataFrame:
    """Each different line with its first place; blank lines one by one."""
    return keyed.groupBy(*LINE).agg(F.min("at").alias("at"), F.first("line").alias("line"))


# --- segments ----------------------------------------------------------------


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` of a line of that length."""
    size = F.floor(length / parts).cast("int")
    longer = length % parts
    short = parts - longer  # the first segments are the shorter ones
    start = size * i + F.greatest(F.lit(0), F.lit(i) - short)
    return start.cast("int"), (size + F.when(F.lit(i) >= short, 1).otherwise(0)).cast("int")


def segment_keys(max_edits: int) -> list[tuple[Column, bool]]:
    """(key, whether it is a probe) of ``line``, which is ``n`` characters long.

    The line's own segments, and what it probes for; null where no line can match.
    """
    parts = max_edits + 1
    line, length = F.col("line"), F.col("n")
    keys = []
    for shorter in range(max_edits + 1):
        aimed = length - shorter
        for i in range(parts):
            start, size = _segment(aimed, i, parts)
            # A match at segment i leaves i edits at most to its left, if no
            # earlier segment matches, and the rest of them to its right.
            first = max(-i, shorter - (max_edits - i))
            last = min(i, shorter + (max_edits - i))
            for offset in range(first, last + 1):
                at = start + offset
                key = F.xxhash64(aimed, F.lit(i), F.substr(line, at + 1, size))
                valid = (at >= 0) & (at + size <= length)
                keys.append((F.when(valid, key), bool(shorter or offset)))
    return keys


# --- verification --------------------------------------------------------------


def _common(a: Column, b: Column, take) -> Column:
    """Length of the common start (or end), by halving steps."""
    shorter = F.least(F.char_length(a), F.char_length(b))
    step = F.ceil(F.log2(shorter + 1.0)).cast("int")
    powers = F.transform(F.sequence(step, F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(
        powers,
        F.lit(0),
        lambda n, p: F.when(
            (n + p <= shorter) & (take(a, n + p) == take(b, n + p)), n + p
        ).otherwise(n),
    )


def _banded(a: Column, b: Column, max_edits: int) -> Column:
    """Edit distance of two arrays of characters, exact up to ``max_edits``.

    Bit k of the band stands for row j - max_edits + k of the matrix in column j.
    vp and vn hold where the value rises and falls from the row above; the band
    moves down one row per column, which is a shift by one bit.
    """
    width = 2 * max_edits + 1
    full = F.lit((1 << width) - 1)
    long = lambda n: F.lit(n).cast("long")

    def step(state: Column, j: Column) -> Column:
        match = long(0)
        for k in range(width):
            row = j - max_edits + k  # from 1
            equal = (row >= 1) & F.coalesce(F.get(a, row - 1) == F.get(b, j - 1), F.lit(False))
            match = match.bitwiseOR(F.when(equal, long(1 << k)).otherwise(long(0)))

        def update(s: Column) -> Column:
            vp, vn, x = s["vp"], s["vn"], s["x"]
            carry = (x.bitwiseAND(vp) + vp).bitwiseAND(full.cast("long"))
            d0 = carry.bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)
            inverse = lambda c: c.bitwiseXOR(full.cast("long"))

            def finish(t: Column) -> Column:
                hp = t["vn"].bitwiseOR(inverse(t["d0"].bitwiseOR(t["vp"])))
                hn = t["d0"].bitwiseAND(t["vp"])
                down = F.shiftright(t["d0"], 1)
                return F.struct(
                    hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (t["score"] + 1 - F.shiftright(t["d0"], width - 1)).alias("score"),
                )

            return let(
                F.struct(
                    vp.alias("vp"), vn.alias("vn"), d0.alias("d0"), s["score"].alias("score")
                ),
                finish,
            )

        return let(
            F.struct(
                state["vp"].alias("vp"),
                state["vn"].alias("vn"),
                match.alias("x"),
                state["score"].alias("score"),
            ),
            update,
        )

    start = F.struct(
        long(((1 << width) - 1) >> max_edits << max_edits).alias("vp"),
        long(0).alias("vn"),
        long(max_edits).alias("score"),
    )

    def last(state: Column) -> Column:
        # From the band's lowest row back up to the last row of ``a``.
        low = F.size(a) - F.size(b) + max_edits
        mask = F.expr(f"{(1 << 2 * max_edits) - 1}L").bitwiseAND(
            F.call_function("shiftleft", long(-1), low)
        )
        return (
            state["score"]
            - F.bit_count(state["vp"].bitwiseAND(mask))
            + F.bit_count(state["vn"].bitwiseAND(mask))
        )

    columns = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(
        F.array().cast("array<int>")
    )
    return F.when(F.size(b) == 0, F.size(a).cast("long")).otherwise(
        F.aggregate(columns, start, step, last)
    )


def within(a: Column, b: Column, max_edits: int) -> Column:
    """Whether two lines are at most ``max_edits`` edits apart."""

    def trimmed(p: Column) -> Column:
        ends = lambda q: let(
            _common(q["a"], q["b"], F.right),
            lambda n: F.struct(
                F.left(q["a"], F.char_length(q["a"]) - n).alias("a"),
                F.left(q["b"], F.char_length(q["b"]) - n).alias("b"),
            ),
        )
        return let(
            let(
                _common(p["a"], p["b"], F.left),
                lambda n: F.struct(
                    F.substr(p["a"], n + 1).alias("a"), F.substr(p["b"], n + 1).alias("b")
                ),
            ),
            ends,
        )

    def decide(core: Column) -> Column:
        characters = F.struct(_characters(core["a"]).alias("a"), _characters(core["b"]).alias("b"))
        return let(characters, lambda c: _banded(c["a"], c["b"], max_edits) <= max_edits)

    near = F.abs(F.char_length(a) - F.char_length(b)) <= max_edits
    pair = F.struct(a.alias("a"), b.alias("b"))
    return near & let(let(pair, trimmed), decide)


def _characters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


# --- the join --------------------------------------------------------------------


def _crowded(texts: DataFrame) -> DataFrame:
    """Places of lines with an earlier line one edit away, without making pairs.

    Lines of one length that agree but for character j share the key of j; a line
    that is another one less a character shares that one's key.
    """
    # Positions are dealt out first, so a row holds one shortened line at a time
    # and hands on numbers only.
    rest = F.concat(
        F.substr(F.col("line"), F.lit(1), F.col("j") - 1), F.substr(F.col("line"), F.col("j") + 1)
    )
    each = texts.select(
        "at", "line", F.explode(F.sequence(F.lit(1), F.char_length("line"))).alias("j")
    ).select(
        "at",
        "j",
        F.char_length("line").alias("n"),
        F.xxhash64(F.lit("one"), rest).alias("rest"),
        F.xxhash64(F.lit(7), rest).alias("rest2"),
    )
    same_size = each.select(
        "at",
        F.lit("same").alias("role"),
        F.xxhash64(F.lit("same"), "n", "j", "rest").alias("key"),
        F.col("rest2").alias("key2"),
    )
    longer = each.select(
        "at",
        F.lit("longer").alias("role"),
        F.col("rest").alias("key"),
        F.col("rest2").alias("key2"),
    )
    shorter = texts.select(
        "at",
        F.lit("shorter").alias("role"),
        F.xxhash64(F.lit("one"), "line").alias("key"),
        F.xxhash64(F.lit(7), "line").alias("key2"),
    )
    rows = same_size.union(longer).union(shorter)
    first = rows.groupBy("key", "key2").agg(
        *[
            F.min(F.when(F.col("role") == role, F.col("at"))).alias(f"first_{role}")
            for role in ("same", "longer", "shorter")
        ],
        F.count(F.lit(1)).alias("n"),
    )
    other = (
        F.when(F.col("role") == "same", F.col("first_same"))
        .when(F.col("role") == "longer", F.col("first_shorter"))
        .otherwise(F.col("first_longer"))
    )
    return rows.join(first.where("n > 1"), ["key", "key2"]).where(other < F.col("at")).select("at")


def near_repeats(keyed: DataFrame, max_edits: int) -> DataFrame:
    """Keys (h1, h2, own) of the different lines that an earlier line comes close to.

    Segments are hashed where the lines are read, so the search for shared ones
    moves numbers only; texts are fetched for the lines that share one.
    """
    if max_edits == 0:
        return keyed.select(*LINE).limit(0)
    if max_edits != 1:
        raise ValueError("crowded segments are decided exactly for one edit only")
    # Blank lines have a number of their own.
    texts = keyed.where((F.col("own") == 0) & (F.char_length("line") >= MIN_CHARS))
    made = segment_keys(max_edits)
    hashed = (
        texts.withColumn("n", F.char_length("line"))
        .select(*LINE, *[key.alias(f"key{i}") for i, (key, _) in enumerate(made)])
        .groupBy(*LINE)
        .agg(*[F.max(f"key{i}").alias(f"key{i}") for i in range(len(made))])
    )
    each = [
        F.struct(F.col(f"key{i}").alias("key"), F.lit(probe).alias("probe"))
        for i, (_, probe) in enumerate(made)
    ]
    keys = (
        hashed.select(*LINE, F.explode(F.array(*each)).alias("k"))
        .select("k.key", "k.probe", *LINE)
        .where("key IS NOT NULL")
    )
    crowds = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("probe")).alias("indexed")
    )
    # A key with a single row, or with probes only, joins nothing.
    shared = cut(keys.join(crowds.where("rows > 1 AND indexed > 0"), "key"))
    release(keyed.sparkSession)
    wanted = shared.groupBy(*LINE).agg(F.bool_or(F.col("rows") > CROWD).alias("crowded"))
    known = cut(_distinct(texts).join(wanted, list(LINE)))

    two = lambda name: F.struct(*LINE).alias(name)
    small = shared.where(F.col("rows") <= CROWD)
    index = small.where(~F.col("probe")).select("key", two("a"))
    pairs = (
        small.select("key", two("b"))
        .join(index, "key")
        .where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    side = lambda name: known.select(
        two(name), F.col("line").alias(f"line_{name}"), F.col("at").alias(f"at_{name}")
    )
    close = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(within(F.col("line_a"), F.col("line_b"), max_edits))
        .select(F.greatest("at_a", "at_b").alias("at"))
    )
    late = close.union(_crowded(known.where("crowded").select("at", "line"))).distinct()
    return cut(known.join(late, "at", "left_semi").select(*LINE))


def _staying(docs: DataFrame, max_edits: int) -> DataFrame:
    """Numbers of the lines that stay, of each document that keeps any.

    They are found by numbers alone; texts stay where they are.
    """
    keyed = _keyed(lines_of(docs))
    repeats = near_repeats(keyed, max_edits)
    release(docs.sparkSession)
    return (
        _distinct(keyed)
        .join(repeats, list(LINE), "left_anti")
        .groupBy(F.col("at.doc_id").alias("__doc_id"), F.col("at.text_key").alias("__text_key"))
        .agg(F.collect_list("at.pos").alias("__stay"))
    )


def line_report(docs: DataFrame, max_edits: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (numbers from 0) of every row."""
    stay = _staying(docs, max_edits)
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    rows = docs.select(
        "doc_id",
        text_key(F.col("text")).alias("text_key"),
        F.when(F.col("text").isNull(), 0).otherwise(lines).alias("n_lines"),
    )
    on = rows["doc_id"].eqNullSafe(stay["__doc_id"]) & (rows["text_key"] == stay["__text_key"])
    none = F.array().cast("array<int>")
    numbers = F.sequence(F.lit(0), F.col("n_lines") - 1)
    everything = F.when(F.col("n_lines") > 0, numbers).otherwise(none)
    return rows.join(stay, on, "left").select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.array_except(everything, F.coalesce("__stay", none)).alias("removed"),
    ).withColumn("n_removed", F.size("removed").cast("long"))


def without_repeats(docs: DataFrame, max_edits: int = 1) -> DataFrame:
    """The documents, all columns, with the repeated lines taken out of the text."""
    stay = _staying(docs, max_edits)
    rows = docs.withColumn("__own_key", text_key(F.col("text")))
    on = rows["doc_id"].eqNullSafe(stay["__doc_id"]) & (rows["__own_key"] == stay["__text_key"])
    numbers = F.sort_array(F.coalesce("__stay", F.array().cast("array<int>")))
    lines_left = let(
        F.split("text", "\n"),
        lambda lines: F.array_join(F.transform(numbers, lambda n: F.get(lines, n)), "\n"),
    )
    new_text = F.when(F.col("text").isNotNull(), lines_left)
    made = rows.join(stay, on, "left").select(
        *[new_text.alias("text") if name == "text" else F.col(name) for name in docs.columns]
    )
    if "n_chars" not in docs.columns:
        return made
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
