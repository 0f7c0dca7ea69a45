"""Repeated passages by the interval tree of an enhanced suffix array.

Every text is a string of bytes; a byte goes if a ``least``-byte string that
covers it also starts earlier.  A suffix array of the corpus in one piece would
not fit anywhere, so the suffixes are dealt to many small ones such that equal
strings of ``least`` bytes always meet:

1. *Segments.*  A string of ``least`` bytes has one anchor, the ``ANCHOR``-byte
   part with the smallest hash (the leftmost of equals).  Consecutive starts
   whose strings have the same anchor occurrence form a segment: those starts and
   the bytes they reach.  Equal strings have equal anchors, whatever surrounds
   them, so strings need to be compared only between segments of equal anchor.
2. *Equal segments* (by anchor and content hash) are repeats as a whole: all but
   the first occurrence go.  What is left to compare are the first occurrences
   of different segments with the same anchor: the ragged ends of passages.
3. *Suffix arrays.*  These segments are gathered in shards by anchor.  A shard
   sorts the suffixes that start at the segments' starts, takes the longest
   common prefixes of neighbours, and scans them with a stack, which yields the
   intervals of the common-prefix tree.  An interval whose suffixes differ in the
   byte to their left (a segment's first byte counts as different from all) is a
   maximal repeat group of the shard; it is reported with its length and *all*
   occurrences, and all but the earliest one are repeats.
4. *Crowds.*  Anchors with more than ``CROWD`` different segments are not put into
   one array: their strings are grouped one by one, by hash, with the smallest
   place kept in map-side aggregates.

Defined results: a null text is an empty one; order is by doc_id (null first),
then by a key of the text; equal rows are one document, and each has the same
result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from decoylog.llm.common import cut, release, text_key

LEAST = 100
ANCHOR = 32
#: Different segments of one anchor that go into a suffix array together.
CROWD = 32_768
#: Segments a shard is meant to hold.
SHARD_SEGMENTS = 20_000
#: Bytes of text whose anchors are found at a time.
BLOCK = 1 << 19
_POSITION = (1 << 20) - 1

_ODD = (
    0x9E3779B97F4A7C15,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0xD6E8FEB86659FD93,
    0xA0761D6478BD642F,
)
_MASK = (1 << 64) - 1


#: A 64-bit value per byte, from a fixed generator.
_BYTE_VALUES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.int64).view(np.uint64)


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position on, by doubling."""
    value = _BYTE_VALUES[data]
    size = 1
    for odd in _ODD:
        value = value[:-size] * np.uint64(odd) + value[size:]
        value ^= value >> np.uint64(29)
        size *= 2
    return value * np.uint64(_ODD[0])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, content hash, first start, last start) of every segment of a text."""
    array = np.frombuffer(data, dtype=np.uint8)
    starts = len(data) - LEAST + 1
    for block in range(0, max(starts, 0), BLOCK):
        n = min(BLOCK, starts - block)
        hashes = anchor_hashes(array[block : block + n + LEAST - 1])
        high = hashes & np.uint64(_MASK - _POSITION)
        keys = high | np.arange(len(high), dtype=np.uint64)
        least = _sliding_least(keys, LEAST - ANCHOR + 1)[:n]
        place = (least & np.uint64(_POSITION)).astype(np.int64)
        edges = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate(([0], edges))
        last = np.concatenate((edges, [n])) - 1
        anchors = hashes[place[first]].view(np.int64)
        for a, s, e in zip(anchors.tolist(), (first + block).tolist(), (last + block).tolist()):
            yield a, xxh64_intdigest(data[s : e + LEAST]), s, e


# --- the suffix array of a shard -------------------------------------------------


def _ranks(data: np.ndarray) -> np.ndarray:
    """Order of the suffixes by their first LEAST bytes: equal ranks for equal strings.

    Ranks of 8 bytes are doubled to 64, then two of those that overlap give 100.
    """
    n = len(data)
    rank = np.zeros(n - 7, dtype=np.uint64)
    for i in range(8):
        rank = (rank << np.uint64(8)) | data[i : n - 7 + i]
    size = 8
    while True:
        _, order = np.unique(rank, return_inverse=True)
        rank = order.astype(np.uint64)
        if size == LEAST:
            return rank
        shift = min(size, LEAST - size)
        rank = (rank[:-shift] << np.uint64(32)) | rank[shift:]
        size += shift


def _intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the common-prefix tree, by a stack scan.

    ``lcp[i]`` is the common prefix of the suffixes i and i + 1.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i
        if depth > 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _common(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def repeat_groups(parts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(part, offset), ...]) of the maximal repeat groups among the parts."""
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(parts)), sizes - LEAST + 1)
    within = np.arange(len(owner)) - np.repeat(
        np.cumsum(sizes - LEAST + 1) - (sizes - LEAST + 1), sizes - LEAST + 1
    )
    place = begin[owner] + within
    rank = _ranks(data)[place]
    order = np.argsort(rank, kind="stable")
    rank = rank[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(rank)) + 1, [len(rank)]))
    # The byte to the left; a part's first suffix differs from all.
    left = np.where(within == 0, 256 + np.arange(len(place)), data[np.maximum(place - 1, 0)])[order]
    low, high = (f.reduceat(left, edges[:-1]) for f in (np.minimum, np.maximum))
    for k in np.flatnonzero((np.diff(edges) > 1) & (low != high)):
        members = order[edges[k] : edges[k + 1]]
        found = sorted(
            (parts[owner[m]][within[m] :], int(owner[m]), int(within[m]), int(left_m))
            for m, left_m in zip(members, left[edges[k] : edges[k + 1]])
        )
        depths = [_common(a[0], b[0]) for a, b in zip(found, found[1:])]
        for depth, first, last in _intervals(depths):
            group = found[first : last + 1]
            if len({g[3] for g in group}) > 1:
                yield depth, [(g[1], g[2]) for g in group]


# --- the jobs -----------------------------------------------------------------------

PLACE = ("doc_id", "text_key")


def _place(start: str) -> Column:
    return F.struct(*PLACE, F.col(start))


def _segment_rows(docs: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            owner: list[int] = []

            def made() -> pa.RecordBatch:
                at = pa.array(owner, type=pa.int32())
                a, c, s, e = out
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(a, type=pa.int64()),
                        pa.array(np.array(c, dtype=np.uint64).view(np.int64)),
                        pa.array(s, type=pa.int32()),
                        pa.array(e, type=pa.int32()),
                    ],
                    names=[*PLACE, "anchor", "content", "first", "last"],
                )

            for i, text in enumerate(batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for row in segments(data):
                    owner.append(i)
                    for column, value in zip(out, row):
                        column.append(value)
                if len(owner) >= 1 << 16:
                    yield made()
                    out, owner = [[], [], [], []], []
            if owner:
                yield made()

    return docs.select(*PLACE, "text").mapInArrow(
        run,
        f"doc_id {kind}, text_key bigint, anchor bigint, content bigint, first int, last int",
    )


def _merge(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """The union of [first, last] ranges, touching ones joined."""
    order = np.lexsort((last, first))
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > last[:-1] + 1))
    ends = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(first) - 1]))
    return list(zip(first[new].tolist(), last[ends].tolist()))


_RANGES = "array<struct<first: int, last: int>>"


def _packed() -> Column:
    """A segment is shorter than 2^20 bytes; see BLOCK."""
    return F.shiftleft(F.col("first").cast("long"), 20) + (F.col("last") - F.col("first"))


def _flagged(rows: DataFrame, kind: str) -> DataFrame:
    """Per document: the ranges of starts that repeat, and the segments still open."""
    by_anchor = Window.partitionBy("anchor")
    by_content = Window.partitionBy("anchor", "content").orderBy(*PLACE, "first")
    # Equal rows of the table share their places and count as one document.
    seen = rows.select(
        "*",
        F.first(_place("first")).over(by_content).alias("origin"),
        F.min("content").over(by_anchor).alias("low"),
        F.max("content").over(by_anchor).alias("high"),
        F.row_number().over(by_content).alias("nth"),
    )
    # How many different segments the anchor has.
    kinds = F.count_if(F.col("nth") == 1).over(by_anchor)
    seen = seen.withColumn("crowded", kinds > CROWD)
    repeat = F.col("origin") != _place("first")
    flagged = seen.select(
        *PLACE, "anchor", "crowded", "first", "last", repeat.alias("repeat"),
        ((F.col("low") != F.col("high")) & (F.col("nth") == 1)).alias("open"),
    ).where("repeat OR open")
    grouped = flagged.groupBy(*PLACE).agg(
        # First and length in one number: most rows of this exchange are ranges.
        F.collect_list(F.when(F.col("repeat"), _packed())).alias("ranges"),
        F.collect_list(F.when(F.col("open"), F.struct("anchor", "crowded", "first", "last"))).alias("open"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            flat = lists.flatten().to_numpy()
            first = flat >> 20
            last = first + (flat & _POSITION)
            merged = [
                _merge(first[a:b], last[a:b]) if b > a else [] for a, b in zip(ends, ends[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(
                        [[{"first": f, "last": t} for f, t in m] for m in merged],
                        type=pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])),
                    ),
                    batch.column(3),
                ],
                names=[*PLACE, "ranges", "open"],
            )

    return grouped.mapInArrow(
        run,
        f"doc_id {kind}, text_key bigint, ranges {_RANGES}, "
        "open array<struct<anchor: bigint, crowded: boolean, first: int, last: int>>",
    )


def _row_key(name: str) -> list[Column]:
    """Two numbers, never null, that stand for a document in joins."""
    return [
        F.xxhash64("doc_id", F.lit(3)).alias(f"{name}1"),
        F.col("text_key").alias(f"{name}2"),
    ]


def _with_text(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``rows`` of documents joined to their texts.  The texts are dealt out once:
    both uses read the same exchange."""
    keyed = rows.select(*_row_key("r"), *[c for c in rows.columns if c not in PLACE])
    on = (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2"))
    return texts.join(keyed, on, how)


def _open_parts(texts: DataFrame, flagged: DataFrame, kind: str) -> DataFrame:
    """The bytes of the open segments, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3))):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    part = data[w["first"] : w["last"] + LEAST]
                    for column, value in zip(out, (i, w["anchor"], w["crowded"], w["first"], part)):
                        column.append(value)
            at = pa.array(out[0], type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(out[1], type=pa.int64()),
                    pa.array(out[2], type=pa.bool_()),
                    pa.array(out[3], type=pa.int32()),
                    pa.array(out[4], type=pa.binary()),
                ],
                names=[*PLACE, "anchor", "crowded", "first", "part"],
            )

    wanted = flagged.where(F.size("open") > 0).select(*PLACE, "open")
    rows = _with_text(texts, wanted, "inner")
    return rows.select("doc_id", F.col("t2").alias("text_key"), "text", "open").mapInArrow(
        run,
        f"doc_id {kind}, text_key bigint, anchor bigint, crowded boolean, first int, part binary",
    )


def _shard_groups(parts: DataFrame, shards: int, kind: str) -> DataFrame:
    """A row for every occurrence in every maximal repeat group of every shard.

    ``earliest`` marks the one that comes first in the corpus.
    """

    def search(table: pa.Table) -> pa.Table:
        keys = [(c, "ascending") for c in (*PLACE, "first")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        places = list(zip(*(table.column(c).to_pylist() for c in (*PLACE, "first"))))
        once = [i for i in range(len(places)) if not i or places[i] != places[i - 1]]
        table = table.take(pa.array(once))
        texts = table.column("part").to_pylist()
        starts = table.column("first").to_pylist()
        shard = table.column("shard")[0].as_py()
        named = [places[i][:2] for i in once]
        document = np.cumsum([i > 0 and named[i] != named[i - 1] for i in range(len(named))]).tolist()
        out: list[list] = [[], [], [], [], []]
        for number, (length, members) in enumerate(repeat_groups(texts)):
            # Documents stand in corpus order; parts of one may overlap.
            found = {(document[p], starts[p] + offset): p for p, offset in members}
            first = min(found)
            for at, part in found.items():
                row = (part, number, length, at[1], at == first)
                for column, value in zip(out, row):
                    column.append(value)
        at = pa.array(out[0], type=pa.int32())
        return pa.table(
            {
                "shard": pa.array([shard] * len(at), type=pa.int32()),
                "number": pa.array(out[1], type=pa.int32()),
                "length": pa.array(out[2], type=pa.int32()),
                "doc_id": table.column("doc_id").take(at),
                "text_key": table.column("text_key").take(at),
                "start": pa.array(out[3], type=pa.int32()),
                "earliest": pa.array(out[4], type=pa.bool_()),
            }
        )

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")
    return (
        parts.where(~F.col("crowded"))
        .select(shard, *PLACE, "first", "part")
        .groupBy("shard")
        .applyInArrow(
            search,
            f"shard int, number int, length int, doc_id {kind}, text_key bigint, start int, "
            "earliest boolean",
        )
    )


def _crowd_repeats(parts: DataFrame, kind: str) -> DataFrame:
    """doc_id, text_key, start of strings of crowded anchors that start earlier too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, starts, h1, h2 = [], [], [], []
            for i, (first, part) in enumerate(
                zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ):
                for offset in range(len(part) - LEAST + 1):
                    string = part[offset : offset + LEAST]
                    owner.append(i)
                    starts.append(first + offset)
                    h1.append(xxh64_intdigest(string))
                    h2.append(xxh64_intdigest(string, 1))
            at = pa.array(owner, type=pa.int32())
            signed = lambda h: pa.array(np.array(h, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(starts, type=pa.int32()),
                    signed(h1),
                    signed(h2),
                ],
                names=[*PLACE, "start", "h1", "h2"],
            )

    strings = (
        parts.where("crowded")
        .select(*PLACE, "first", "part")
        .mapInArrow(run, f"doc_id {kind}, text_key bigint, start int, h1 bigint, h2 bigint")
    )
    first = strings.groupBy("h1", "h2").agg(
        F.min(_place("start")).alias("origin"), F.count(F.lit(1)).alias("rows")
    )
    return (
        strings.join(first.where("rows > 1"), ["h1", "h2"])
        .where(F.col("origin") != _place("start"))
        .select(*PLACE, "start")
    )


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, str]:
    """texts, flagged documents, open parts, the shards' groups; the type of doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text_key(text).alias("text_key"), text.alias("text"))
    # Both uses need just these columns, so Spark sees one exchange in them.
    texts = rows.select("doc_id", "text", *_row_key("t"))
    flagged = cut(_flagged(_segment_rows(rows, kind), kind))
    release(docs.sparkSession)
    total = flagged.agg(F.sum(F.size("open"))).first()[0] or 0
    parts = _open_parts(texts, flagged, kind)
    groups = _shard_groups(parts, max(1, -(-total // SHARD_SEGMENTS)), kind)
    return texts, flagged, parts, groups, kind


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """Repeat groups with all their occurrences: group, length, doc_id, start, earliest.

    ``length`` bytes from ``start`` on are equal in all members of a group, and
    ``earliest`` marks the one that comes first in the corpus.  The groups of the
    shards' trees hold one of each different segment; segments of equal content take
    part through it, so each member is given out once for every copy of its segment.
    A segment that has copies is a group as a whole, unless a tree has it as one.
    Every string of ``LEAST`` bytes that occurs twice lies in a group that has all its
    occurrences.  A passage longer than a segment shows as groups that overlap.
    Segments of crowded anchors that differ are not compared here: they are in a group
    with their copies only (:func:`without_repeats` does compare them).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text_key(text).alias("text_key"), text.alias("text"))
    # Equal rows of the table are one document.
    found = cut(_segment_rows(rows, kind).distinct())
    same = ["anchor", "content"]
    firsts = found.groupBy(*same).agg(
        F.min(_place("first")).alias("rep"),
        F.min_by("last", _place("first")).alias("last"),
        F.count(F.lit(1)).alias("copies"),
    )
    contents = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"))
    firsts = cut(firsts.join(contents, "anchor"))
    several = firsts.where("contents > 1")
    groups = _prepared(docs)[3]

    # A representative of a content, with the copies' places beside its own.
    of = several.select(
        *same, "rep", F.xxhash64("rep.doc_id", F.lit(3)).alias("r1"), F.col("rep.text_key").alias("r2"),
        F.col("rep.first").alias("r_first"), F.col("last").alias("r_last"),
    )
    member = groups.select(
        F.concat_ws("-", "shard", "number").alias("group"), "length",
        F.xxhash64("doc_id", F.lit(3)).alias("r1"), F.col("text_key").alias("r2"), "start",
    )
    inside = (F.col("start") >= F.col("r_first")) & (
        F.col("start") + F.col("length") <= F.col("r_last") + LEAST
    )
    in_segment = member.join(of, ["r1", "r2"]).where(inside)
    by_tree = in_segment.select(
        "group", "length", *same, (F.col("start") - F.col("r_first")).alias("offset")
    )
    taken = by_tree.where("offset = 0").select("length", *same)
    whole = (
        firsts.where("copies > 1")
        .select(*same, (F.col("last") - F.col("rep.first") + LEAST).alias("length"))
        .join(taken, ["length", *same], "left_anti")
        .select(F.concat_ws("=", *same).alias("group"), "length", *same, F.lit(0).alias("offset"))
    )
    placed = (
        by_tree.unionByName(whole)
        .join(found.select(*same, *PLACE, "first"), same)
        .select("group", "length", *PLACE, (F.col("first") + F.col("offset")).alias("start"))
        .distinct()
    )
    first = placed.groupBy("group").agg(F.min(_place("start")).alias("origin"))
    return (
        placed.join(first, "group")
        .withColumn("earliest", F.col("origin") == _place("start"))
        .select("group", "length", "doc_id", "start", "earliest")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 of every row."""
    texts, flagged, parts, groups, kind = _prepared(docs)
    whole = flagged.select(*PLACE, F.inline("ranges"))
    partly = groups.where(~F.col("earliest")).select(
        *PLACE, F.col("start").alias("first"), (F.col("start") + F.col("length") - LEAST).alias("last")
    )
    crowds = _crowd_repeats(parts, kind).select(
        *PLACE, F.col("start").alias("first"), F.col("start").alias("last")
    )
    ranges = (
        whole.union(partly)
        .union(crowds)
        .groupBy(*PLACE)
        .agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans, kept, at = [], [], 0
                if found.is_valid and len(found):
                    first = found.values.field(0).to_numpy()
                    last = found.values.field(1).to_numpy()
                    spans = _merge(first, last + LEAST - 1)
                for first, last in spans:
                    kept.append(data[at:first])
                    at = last + 1
                kept.append(data[at:])
                rest = b"".join(kept)
                row = (
                    len(data), len(data) - len(rest), len(spans), rest,
                    hashlib.sha256(rest).hexdigest(),
                )
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=k) for c, k in zip(out, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return _with_text(texts, ranges, "left").select("doc_id", "text", "ranges").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, "
        "kept_sha256 string",
    )
