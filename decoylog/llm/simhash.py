"""SimHash near-duplicates through vantage-point trees.

Fingerprints: the majority bits of the XXH64 values of a document's word
shingles.  Search: equal fingerprints are collapsed first.  A vantage-point tree
over a bounded sample of the distinct fingerprints deals all of them into
shards: an inner node holds a vantage point and a radius, the near side holds
the fingerprints within the radius.  A fingerprint is data in its one home shard
and a query in every shard that the triangle inequality cannot rule out, so
pairs across a boundary meet in the home of the smaller one.  A shard that is still
too large is dealt again by a tree over a sample of its own, as often as it takes, so
the number of shards has no ceiling.  Inside a shard the
same descent is repeated for data and queries together, on whole arrays, until
the leaves are small enough to compare directly.  The pairs found are exact; the
sample only decides how even the shards are.  A shard hands on what its pairs
connect, at most one link per fingerprint, since a dense group has many pairs.

Defined results: a null or empty text, or one of white space only, has the
fingerprint zero and is linked like any other; repeated rows and rows that share
a doc_id each keep their row; a null doc_id belongs to its component but never
names it; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from decoylog.llm.common import cut, text_key
from decoylog.llm.components import components

SEED = 42
BITS = 64
#: Fingerprints a shard is meant to hold, and the sample that shapes the tree.
SHARD_SIZE = 8_192
SAMPLE = 65_536
#: Arrays below this size are compared directly.
LEAF = 64
BLOCK_BYTES = 1 << 22

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_WHITE = frozenset(b" \t\n\x0b\x0c\r")


def word_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded length, cut at white space."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] not in _WHITE:
            end += 1
        yield data[start:end].split()
        start = end


def _bit_counts(shingles: Iterator[bytes]) -> tuple[int, np.ndarray]:
    """How many shingles, and in how many of them each bit of the hash is set."""
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int64) * 256
    seen = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256)
    return len(hashes), (seen @ _BYTE_BITS).ravel()


def fingerprint(text: str | None, shingle: int) -> int:
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    total, counts, carry = 0, np.zeros(BITS, dtype=np.int64), []
    for block in word_blocks(data):
        words = carry + block
        n, part = _bit_counts(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
        total, counts = total + n, counts + part
        carry = words[max(0, len(words) - shingle + 1) :]
    if not total:
        if not carry:
            return 0
        total, counts = _bit_counts(iter([b" ".join(carry)]))
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, a key of the text, and the fingerprint as a long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            signed = np.array(made, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(signed)],
                names=["doc_id", "text_key", "fingerprint"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), text_key(text).alias("key")).mapInArrow(
        run, f"doc_id {kind}, text_key bigint, fingerprint bigint"
    )


# --- the tree ----------------------------------------------------------------


def _distance(values: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ vantage)


def _split(values: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point out of ``values`` and the radius that halves them best."""
    best = None
    # Of a few candidates, the one whose distances spread most prunes most.
    for vantage in values[:: max(1, len(values) // 5)][:5]:
        distances = _distance(values, vantage)
        spread = float(distances.std())
        if best is None or spread > best[0]:
            best = (spread, vantage, distances)
    _, vantage, distances = best
    radius = int(np.median(distances))
    near = int((distances <= radius).sum())
    if near == len(values):
        radius -= 1
        near = int((distances <= radius).sum())
    return (vantage, radius) if 0 < near < len(values) else None


def build_tree(sample: np.ndarray, depth: int) -> tuple | int:
    """Nested (vantage, radius, near, far); leaves are shard numbers."""
    shards = iter(range(1 << (depth + 1)))

    def node(values: np.ndarray, left: int) -> tuple | int:
        cut_at = _split(values) if left and len(values) > 1 else None
        if cut_at is None:
            return next(shards)
        vantage, radius = cut_at
        near = _distance(values, vantage) <= radius
        return vantage, radius, node(values[near], left - 1), node(values[~near], left - 1)

    return node(np.sort(sample), depth)


def route(
    tree: tuple | int, values: np.ndarray, reach: int, home: np.ndarray | None = None
) -> Iterator[tuple]:
    """(shard, values, home) for every shard the triangle inequality leaves open.

    Values that are not at ``home`` before are queries everywhere.
    """

    def visit(node: tuple | int, values: np.ndarray, home: np.ndarray) -> Iterator[tuple]:
        if not len(values):
            return
        if isinstance(node, int):
            yield node, values, home
            return
        vantage, radius, near, far = node
        distances = _distance(values, vantage).astype(np.int16)
        inside = distances <= radius
        for child, mine, open_ in (
            (near, inside, distances - reach <= radius),
            (far, ~inside, distances + reach > radius),
        ):
            yield from visit(child, values[open_], (home & mine)[open_])

    yield from visit(tree, values, np.ones(len(values), dtype=bool) if home is None else home)


def pairs_within(data: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple]:
    """Arrays (smaller, larger) of all pairs data < query within ``reach`` bits."""
    stack = [(data, queries)]
    while stack:
        d, q = stack.pop()
        if not len(d) or not len(q):
            continue
        cut_at = _split(d) if len(d) > LEAF else None
        if cut_at is None:
            for start in range(0, len(d), 1024):
                part = d[start : start + 1024]
                for at in range(0, len(q), 4096):
                    block = q[at : at + 4096]
                    close = np.bitwise_count(part[:, None] ^ block[None, :]) <= reach
                    i, j = np.nonzero(close)
                    ordered = part[i] < block[j]
                    if ordered.any():
                        yield part[i[ordered]], block[j[ordered]]
            continue
        vantage, radius = cut_at
        near = _distance(d, vantage) <= radius
        away = _distance(q, vantage).astype(np.int16)
        stack.append((d[near], q[away - reach <= radius]))
        stack.append((d[~near], q[away + reach > radius]))


def forest(values: np.ndarray, pairs: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """What the pairs connect, as links of each value to the least of its tree.

    A dense group has far more pairs than members; they are merged block by
    block, so that at most one link per value is ever held or sent on.
    """
    nodes = np.unique(values)
    root = np.arange(len(nodes))
    for a, b in pairs:
        i, j = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
        while True:
            i, j = root[i], root[j]
            apart = i != j
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (root != root[root]).any():
                root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[root[moved]], nodes[moved]


def _most_depth() -> int:
    """Levels that one sample can shape, 64 fingerprints for each of the leaves."""
    return int(math.log2(SAMPLE / 64))


def _depth(n: int) -> int:
    return min(max(0, math.ceil(math.log2(max(n, 1) / SHARD_SIZE))), _most_depth())


def _dealt_again(dealt: DataFrame, reach: int) -> DataFrame:
    """Shards of over twice ``SHARD_SIZE`` fingerprints split until no tree can split them.

    Each tree is built in a task from a sample of bounded expected size; the driver
    holds their nodes, about one for each ``SHARD_SIZE`` fingerprints.
    """
    spark = dealt.sparkSession
    level = 0
    while True:
        level += 1
        dealt = cut(dealt)
        own = dealt.where("home")
        sizes = own.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > 2 * SHARD_SIZE)
        chance = F.pmod(F.xxhash64("fingerprint", F.lit(level)), F.lit(1 << 30)) / (1 << 30)
        sample = own.join(large, "shard").where(chance * F.col("n") < SAMPLE)

        def build(table: pa.Table) -> pa.Table:
            values = table.column("fingerprint").to_numpy().view(np.uint64)
            tree = build_tree(values, _depth(table.column("n")[0].as_py()))
            return pa.table(
                {"shard": table.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)])}
            )

        made = sample.groupBy("shard").applyInArrow(build, "shard bigint, tree binary").collect()
        trees = {row["shard"]: pickle.loads(row["tree"]) for row in made}
        # A shard whose sample cannot be split stays as it is.
        trees = {shard: tree for shard, tree in trees.items() if not isinstance(tree, int)}
        if not trees:
            return dealt
        shared = spark.sparkContext.broadcast(trees)

        def deal(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shards, values = (batch.column(i).to_numpy() for i in (0, 1))
                values = values.view(np.uint64)
                home = batch.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(shards, kind="stable")
                starts = np.flatnonzero(np.diff(shards[order], prepend=-1))
                parts = []
                for rows in np.split(order, starts[1:]):
                    if not len(rows):
                        continue
                    shard = int(shards[rows[0]])
                    tree = shared.value.get(shard)
                    if tree is None:
                        parts.append((shards[rows], values[rows], home[rows]))
                        continue
                    for leaf, found, mine in route(tree, values[rows], reach, home[rows]):
                        # Two shards of one number would be searched as one, nothing worse.
                        number = xxh64_intdigest(f"{shard} {leaf}") >> 1
                        parts.append((np.full(len(found), number), found, mine))
                if parts:
                    number, found, mine = (np.concatenate(column) for column in zip(*parts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number), pa.array(found.view(np.int64)), pa.array(mine)],
                        names=["shard", "fingerprint", "home"],
                    )

        dealt = dealt.mapInArrow(deal, dealt.schema)


def links(distinct: DataFrame, reach: int) -> DataFrame:
    """Links (a, b) of distinct fingerprints that connect all those within ``reach`` bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    depth = _depth(n)
    rows = (
        distinct.orderBy(F.xxhash64("fingerprint")).limit(min(SAMPLE, 64 << depth)).toArrow()
        if depth
        else None
    )
    sample = rows.column(0).to_numpy().view(np.uint64) if depth else np.zeros(0, np.uint64)
    tree = spark.sparkContext.broadcast(build_tree(sample, depth))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, found, home in route(tree.value, values, reach):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), shard, dtype=np.int64)),
                        pa.array(found.view(np.int64)),
                        pa.array(home),
                    ],
                    names=["shard", "fingerprint", "home"],
                )

    def search(table: pa.Table) -> pa.Table:
        values = table.column("fingerprint").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        a, b = forest(values, pairs_within(values[home], values, reach))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.mapInArrow(deal, "shard bigint, fingerprint bigint, home boolean")
    if n > SHARD_SIZE << _most_depth():
        dealt = _dealt_again(dealt, reach)
    return dealt.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id reachable over links of at most ``reach``
    differing bits, the document itself included.
    """
    prints = cut(with_fingerprint(docs, shingle))
    return _members(prints, F.min("doc_id"), reach).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("first").alias("component_id"),
    )


def _members(prints: DataFrame, least: Column, reach: int) -> DataFrame:
    """``prints`` with the column ``first``: the least of each component."""
    first = cut(prints.groupBy("fingerprint").agg(least.alias("first")))
    roots = components(links(first.select("fingerprint"), reach))
    grouped = first.join(roots, first["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    named = grouped.groupBy("root").agg(F.min("first").alias("first"))
    members = grouped.select(F.col("fingerprint").alias("member"), "root").join(named, "root")
    return prints.join(
        members.select("member", "first"), prints["fingerprint"] == F.col("member")
    ).drop("member")


def keep_first(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """The documents, all columns, of which no smaller doc_id is in the same component.

    Rows with the same doc_id are told apart by their text; of equal rows one
    stays.  Documents without a doc_id come after all others.
    """
    prints = cut(with_fingerprint(docs, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    stay = (
        _members(prints, F.min(order), reach)
        .where(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key") == F.col("first"))
        .groupBy(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key"))
        .agg(F.count(F.lit(1)).alias("__rows"))
    )
    keyed = docs.withColumn("__own_key", text_key(docs["text"]))
    on = keyed["doc_id"].eqNullSafe(stay["__doc_id"]) & (keyed["__own_key"] == stay["__text_key"])
    found = keyed.join(stay, on)
    single = found.where("__rows = 1").select(*docs.columns)
    repeated = found.where("__rows > 1").dropDuplicates(["__doc_id", "__text_key"])
    return single.union(repeated.select(*docs.columns))
