"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of ``window`` consecutive words of a benchmark item; an item
of fewer words is one window.  Windows and documents are seen as sequences of
shingles (``SHINGLE`` words, or the whole window if it is shorter).

1. A bitmap of fixed size over the hashes of all benchmark shingles goes to the
   tasks.  One pass over the documents keeps the stretches of words whose
   shingles are all in the bitmap and which are at least as long as the shortest
   window of their kind: every occurrence of a window lies inside one stretch.
2. Shingles are ordered by their frequency in these stretches, rarest first.  A
   window that occurs has all its shingles there, so the necessary prefix is
   its one rarest shingle; only that one is joined.
3. A joined pair must fit: the window's place, found from the shingle's position
   in both, may not leave the stretch at either end (position and length bound).
4. What is left is verified word by word.

The join key of a common passage is salted, so documents that share it are
spread over tasks; results are per document, never per passage.

Defined results: a null or empty text has no words and no hits; a null, empty or
wordless item has no windows; an item id that is null can hit words but is not
listed; repeated items count once; repeated documents each have their row; empty
tables give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from decoylog.llm.common import cut, text_key

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHINGLE = 3
#: The bitmap's size is fixed: 2^24 bits, two MB, whatever the benchmark's size.
BITMAP_BITS = 24
BUCKET_BITS = 4096 * 8
SALTS = 16
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_MASK = (1 << 64) - 1


def words_in(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """One 64-bit value per shingle, from its words' values and its size."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    total = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        part = each[i : i + n] * np.uint64(_MIX[i])
        total += part ^ (part >> np.uint64(29 + i))
    total ^= total >> np.uint64(32)
    return total * np.uint64(_MIX[0])


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """item_id, window (its words, space-joined), kind, and its shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_in(text)
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    part = words[at : at + window]
                    kind = min(SHINGLE, len(part))
                    hashes = shingle_hashes(part, kind).view(np.int64).tolist()
                    out.append((item, b" ".join(part).decode("utf-8", "surrogatepass"), len(part), kind, hashes))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (batch.schema[0].type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)],
                names=["item_id", "window", "n", "kind", "hashes"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string")).mapInArrow(
        run, f"item_id {kind}, window string, n int, kind int, hashes array<bigint>"
    )


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The fixed-size bitmap: at most 2^24 / 32768 = 512 rows of 4 KB each."""
    # One is added, as Spark counts the bits of a bitmap from one.
    rows = (
        windows.select(F.explode("hashes").alias("hash"))
        .select((F.shiftrightunsigned("hash", 64 - BITMAP_BITS) + 1).alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    )
    bitmap = np.zeros((1 << BITMAP_BITS) // BUCKET_BITS, dtype=f"V{BUCKET_BITS // 8}")
    for bucket, bits in rows.collect():
        bitmap[bucket - 1] = bytes(bits)
    return bitmap.view(np.uint8)


def stretches(hits: np.ndarray, kind: int, least: int) -> list[tuple[int, int]]:
    """(first word, end word) of runs of hits at least ``least`` words long."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hits.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2] + kind - 1
    long_enough = ends - starts >= least
    return list(zip(starts[long_enough].tolist(), ends[long_enough].tolist()))


def _scan(docs: DataFrame, bitmap: np.ndarray, least: dict[int, int]) -> DataFrame:
    """doc_id, n_words and the stretches of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    stretch = pa.struct(
        [
            ("kind", pa.int32()),
            ("start", pa.int32()),
            ("words", pa.list_(pa.string())),
            ("hashes", pa.list_(pa.int64())),
        ]
    )

    def found(words: list[bytes]) -> list[dict]:
        out = []
        bits = shared.value
        for kind, shortest in least.items():
            hashes = shingle_hashes(words, kind)
            place = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            hits = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            if not hits.any():
                continue
            for start, end in stretches(hits, kind, shortest):
                out.append(
                    {
                        "kind": kind,
                        "start": start,
                        "words": [w.decode("utf-8", "surrogatepass") for w in words[start:end]],
                        "hashes": hashes[start : end - kind + 1].view(np.int64).tolist(),
                    }
                )
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists = [], []
            for text in batch.column(1):
                words = words_in(text.as_py())
                counts.append(len(words))
                lists.append(found(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(counts, type=pa.int64()),
                    pa.array(lists, type=pa.list_(stretch)),
                ],
                names=["doc_id", "text_key", "n_words", "stretches"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), text_key(text).alias("key")).mapInArrow(
        run,
        f"doc_id {kind}, text_key bigint, n_words bigint, stretches array<struct<kind: int, start: int, "
        "words: array<string>, hashes: array<bigint>>>",
    )


def _prefixes(texts: DataFrame, shingles: DataFrame) -> DataFrame:
    """The rarest shingle of every window that can occur, and its offset there."""
    each = texts.select("window_id", F.posexplode("hashes").alias("offset", "hash"))
    # Counted before any join, so a frequent shingle moves as partial counts only.
    frequency = shingles.groupBy("hash").agg(F.count(F.lit(1)).alias("frequency"))
    rarest = F.min(F.struct("frequency", "offset", "hash")).alias("rarest")
    return (
        each.join(frequency, "hash", "left")
        .groupBy("window_id")
        .agg(rarest, F.count_if(F.col("frequency").isNull()).alias("absent"))
        .where(F.col("absent") == 0)
        .select("window_id", "rarest.offset", "rarest.hash")
    )


def _salted(table: DataFrame) -> DataFrame:
    """A copy of each row for every salt; ``_salt`` picks one of them per document."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt() -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")


def _union_size(spans: Column) -> Column:
    """Words in the union of sorted (begin, end) spans."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["begin"]))).alias("n"),
        F.greatest(acc["to"], s["end"]).alias("to"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, item_ids, contaminated."""
    windows = cut(windows_of(items, window))
    least = {
        row["kind"]: row["n"]
        for row in windows.groupBy("kind").agg(F.min("n").alias("n")).collect()
    }
    item_id = F.col("item_id").cast("string")
    texts = cut(
        windows.groupBy("window").agg(
            F.first("n").alias("n"),
            F.first("hashes").alias("hashes"),
            F.collect_set(item_id).alias("item_ids"),
        )
    ).withColumn("window_id", F.monotonically_increasing_id())
    # Stored rows are fixed, and so are the numbers given to them.
    rows = cut(_scan(docs, _bitmap(windows), least)).withColumn(
        "row", F.monotonically_increasing_id()
    )
    inner = rows.select("row", F.posexplode("stretches").alias("at", "s")).select(
        "row", "at", "s.start", "s.words", "s.hashes"
    )
    shingles = inner.select("row", "at", F.posexplode("hashes").alias("position", "hash"))
    prefixes = _salted(_prefixes(texts, shingles.select("hash")))
    candidates = (
        shingles.withColumn("salt", _salt())
        .join(prefixes, ["hash", "salt"])
        .select("row", "at", "window_id", (F.col("position") - F.col("offset")).alias("first"))
        .where("first >= 0")
    )
    # Position and length bound, then the words themselves.
    hits = cut(
        candidates.join(inner.select("row", "at", "start", "words"), ["row", "at"])
        .withColumn("salt", _salt())
        .join(_salted(texts.select("window_id", "window", "n", "item_ids")), ["window_id", "salt"])
        .where(F.col("first") + F.col("n") <= F.size("words"))
        .where(F.array_join(F.expr("slice(words, first + 1, n)"), " ") == F.col("window"))
        .select(
            "row",
            (F.col("start") + F.col("first")).alias("begin"),
            (F.col("start") + F.col("first") + F.col("n")).alias("end"),
            "item_ids",
        )
    )
    found = hits.groupBy("row").agg(
        _union_size(F.sort_array(F.collect_set(F.struct("begin", "end")))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    return (
        rows.select("row", "doc_id", "text_key", "n_words")
        .join(found, "row", "left")
        .select(
            "doc_id",
            "text_key",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents, all columns, without a benchmark window in them."""
    hit = contamination(docs, items, window).where("contaminated").select(
        F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key")
    )
    on = docs["doc_id"].eqNullSafe(hit["__doc_id"]) & (
        text_key(docs["text"]) == hit["__text_key"]
    )
    return docs.join(hit, on, "left_anti")
