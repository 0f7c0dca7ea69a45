"""Fill-in-middle documents, cut at the boundaries of units.

A unit is a run of ASCII letters or any other single character.  The offsets at
which units end are kept as a compressed set: containers of 65,536 characters
each, as an array of offsets where they are few, a bitmap where they are many, or
runs where they follow one another, whichever is smallest.  The containers'
cumulative cardinalities find the container of the k-th boundary; a select inside
it gives the offset.  A text is read container by container, so what is held
besides the text itself is a container and the compressed set.

Python only finds the two offsets; the text is cut and joined again by column
expressions.  :func:`restored` undoes the transformation.

Defined results: a null text is an empty one; empty texts and those that hold one
of the markers stay plain; repeated rows each give their row; a null ``doc_id`` is
drawn from as an empty number; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percentages: documents left plain begin here, and suffix first ones end here.
PLAIN_FROM, SPM_BELOW = 90, 20
SPAN = 1 << 16
#: Bits of a byte, and the place of its k-th set bit.
_ONES = np.array([bin(b).count("1") for b in range(256)])


class ArrayContainer:
    """Few offsets: the offsets themselves."""

    def __init__(self, offsets: np.ndarray) -> None:
        self.offsets = offsets.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class BitmapContainer:
    """Many offsets: a bit each, with running totals per byte."""

    def __init__(self, offsets: np.ndarray) -> None:
        marks = np.zeros(SPAN, bool)
        marks[offsets] = True
        self.bytes = np.packbits(marks, bitorder="little")

    def select(self, k: int) -> int:
        before = np.cumsum(_ONES[self.bytes])
        byte = int(np.searchsorted(before, k, side="right"))
        inside = k - (int(before[byte - 1]) if byte else 0)
        (places,) = np.nonzero(np.unpackbits(self.bytes[byte : byte + 1], bitorder="little"))
        return byte * 8 + int(places[inside])


class RunContainer:
    """Offsets that follow one another: the first of each run and the run's length."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.starts, self.lengths = starts.astype(np.uint16), lengths.astype(np.int32)

    def select(self, k: int) -> int:
        before = np.cumsum(self.lengths)
        run = int(np.searchsorted(before, k, side="right"))
        return int(self.starts[run]) + k - (int(before[run - 1]) if run else 0)


def container(offsets: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of ascending offsets below ``SPAN``."""
    first = np.flatnonzero(np.diff(offsets, prepend=-2) != 1)
    sizes = {RunContainer: 6 * len(first), ArrayContainer: 2 * len(offsets), BitmapContainer: SPAN // 8}
    kind = min(sizes, key=sizes.get)
    if kind is RunContainer:
        return RunContainer(offsets[first], np.diff(first, append=len(offsets)))
    return kind(offsets)


class Boundaries:
    """The ends of a text's units: ``len`` counts them, ``select`` gives the k-th."""

    def __init__(self, text: str) -> None:
        self.keys: list[int] = []
        self.containers: list = []
        self.totals: list[int] = []
        total = 0
        for key in range(-(-len(text) // SPAN)):
            # One character more shows whether a run of letters goes on.
            part = text[key * SPAN : (key + 1) * SPAN + 1]
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            lower = codes | 0x20
            letter = (lower >= 0x61) & (lower <= 0x7A)
            goes_on = letter[:-1] & letter[1:]
            ends = np.flatnonzero(~np.append(goes_on, False)[: min(len(part), SPAN)])
            if len(ends):
                total += len(ends)
                self.keys.append(key)
                self.containers.append(container(ends))
                self.totals.append(total)

    def __len__(self) -> int:
        return self.totals[-1] if self.totals else 0

    def select(self, k: int) -> int:
        """Characters in the first k units."""
        if k == 0:
            return 0
        at = bisect_left(self.totals, k)
        before = self.totals[at - 1] if at else 0
        return self.keys[at] * SPAN + self.containers[at].select(k - before - 1) + 1


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Number of units, and characters before the smaller and the larger cut."""
    ends = Boundaries(text)
    n = len(ends)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, ends.select(low), ends.select(high)


_CUTS = T.StructType([T.StructField(name, T.LongType()) for name in ("n", "low", "high")])


@F.arrow_udf(_CUTS)
def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([(name, pa.int64()) for name in ("n", "low", "high")])
    for texts, first, second in batches:
        found = (
            cuts(text.as_py(), a, b)
            for text, a, b in zip(texts, first.to_pylist(), second.to_pylist())
        )
        yield pa.array([dict(zip(("n", "low", "high"), f)) for f in found], kind)


def drawn(doc_id: Column, group: int) -> Column:
    """A document's number: a group of eight hex digits of a checksum of its id."""
    number = F.coalesce(doc_id.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit("1:"), number).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(marker)
    doc_id = F.col("doc_id")
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        _cuts("text", drawn(doc_id, 1), drawn(doc_id, 2)).alias("at"),
        F.when((F.col("text") == "") | marked | (drawn(doc_id, 3) % 100 >= PLAIN_FROM), PLAIN)
        .when(drawn(doc_id, 4) % 100 < SPM_BELOW, SPM)
        .otherwise(PSM)
        .alias("form"),
    )
    low, high = F.col("at.low").cast("int"), F.col("at.high").cast("int")
    prefix = F.substring("text", F.lit(1), low)
    middle = F.substring("text", low + 1, high - low)
    suffix = F.substring("text", high + 1, F.char_length("text"))
    marker = {name: F.lit(name) for name in (PREFIX, SUFFIX, MIDDLE)}
    output = (
        F.when(F.col("form") == PLAIN, F.col("text"))
        .when(
            F.col("form") == PSM,
            F.concat(marker[PREFIX], prefix, marker[SUFFIX], suffix, marker[MIDDLE], middle),
        )
        .otherwise(F.concat(marker[SUFFIX], suffix, marker[PREFIX], prefix, marker[MIDDLE], middle))
    )
    cut = F.col("form") != PLAIN
    return found.select(
        "doc_id",
        F.col("at.n").alias("n"),
        "form",
        F.when(cut, F.col("at.low")).alias("prefix_chars"),
        F.when(cut, F.col("at.high") - F.col("at.low")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = [F.get(parts, F.lit(i)) for i in range(4)]
    return (
        F.when(form == PLAIN, output)
        .when(form == PSM, F.concat(part[1], part[3], part[2]))
        .otherwise(F.concat(part[2], part[3], part[1]))
    )
