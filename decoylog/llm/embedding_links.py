"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits its vectors at the median of their projections on a random
direction, one direction per tree and level.  Vectors close to the median spill
into both halves.  Linked vectors that a plane separates in one tree most likely
share a leaf in another; how many trees that takes follows from the depth, hence
from the number of vectors (:func:`trees_for`).

Splits are learned from a bounded sample of each node's vectors, and every vector
is dealt out.  Leaves that are still too large get a sample and splits of their
own, round after round, so leaves stay bounded however many vectors there are.
The one exception are *dense* nodes, most of whose vectors link with a good part
of the others: planes cannot part them without cutting links.  They are left
whole and compared in blocks, which costs in proportion to the links they have.

Within leaves all pairs are compared, first in single precision with its error
bound, near the threshold in double.  A pair that shares several leaves counts in
the first of them only, which its members' leaf lists decide, so links are counted
without being listed.  A leaf hands on a count per vector and a spanning forest.

Equal vectors are one class with a weight from the start.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do vectors of different length.  ``n_links``
counts rows.  Repeated rows, and rows that share an id, each keep their row.  A
null id belongs to its component but never names it; a component of such rows
alone has a null id and its rows are not kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decoylog.llm.common import cut
from decoylog.llm.components import components

SEED = 20_240_101
#: Vectors a leaf is meant to hold; one of twice as many is split again.
LEAF = 2_048
#: Vectors of a node that its splits are learned from, and the least that may decide one.
SAMPLE, LEAST = 16_384, 64
#: Spill to either side of a median, in standard deviations of the difference
#: that a pair at the threshold shows on a random direction.
SPILL = 0.2
#: Share of the links at the threshold that the trees are to find together.
RECALL = 0.995
#: A node is dense if this share of its sampled pairs are links.
DENSE = 1 / 8
CHUNK, PAIRS = 512, 1 << 16

_SPLITS = (
    "splits struct<lo: array<double>, hi: array<double>, "
    "left: array<int>, right: array<int>, dense: array<boolean>>"
)
_LEAVES = "leaves array<struct<node: bigint, tree: int, level: int, dense: boolean>>"


def survival(threshold: float) -> tuple[float, float]:
    """Of one level: the share of vectors in a half, and of threshold pairs not parted.

    For unit vectors of any direction a projection is close to normal.  Scales
    with the dimension cancel out.
    """
    deviation = math.sqrt(2 - 2 * threshold)
    margin = SPILL * deviation
    normal = NormalDist()
    z = 2 * margin / deviation
    beyond = 2 * deviation * (normal.pdf(z) - z * (1 - normal.cdf(z)))
    return normal.cdf(margin), 1 - min(0.5, beyond * normal.pdf(0))


def trees_for(vectors: int, leaf: int, threshold: float) -> int:
    """Trees that together find ``RECALL`` of the links at the threshold."""
    half, kept = survival(threshold)
    depth = max(0.0, math.log(max(vectors, 1) / leaf) / -math.log(half))
    found = kept ** math.ceil(depth)
    return 1 if found >= RECALL else math.ceil(math.log(1 - RECALL) / math.log1p(-found))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors in double precision, by length: (row numbers, matrix)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        found = values[offsets[rows][:, None] + np.arange(dim)]
        found /= np.abs(found).max(axis=1, keepdims=True)
        yield rows, found / np.sqrt(np.einsum("ij,ij->i", found, found))[:, None]


def direction(dim: int, tree: int, level: int) -> np.ndarray:
    drawn = np.random.default_rng([SEED, dim, tree, level]).standard_normal(dim)
    return drawn / math.sqrt(drawn @ drawn)


def child_node(node: int, number: int) -> int:
    """The id of a leaf of a node's splits (the finishing steps of a 64-bit mixer)."""
    mask = (1 << 64) - 1
    z = (node + (number + 1) * 0x9E3779B97F4A7C15) & mask
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
    z ^= z >> 31
    return z - (1 << 64) if z >> 63 else z


def learn(
    units: np.ndarray, vectors: int, tree: int, level: int, leaf: int, threshold: float
) -> dict[str, list]:
    """Splits of a node from a sample of its vectors; a leaf has no children (-1)."""
    dim = units.shape[1]
    margin = SPILL * math.sqrt((2 - 2 * threshold) / dim)
    each = vectors / len(units)
    made = {"lo": [], "hi": [], "left": [], "right": [], "dense": []}
    stack = [(np.arange(len(units)), 0, -1, "left")]
    projected: dict[int, np.ndarray] = {}
    while stack:
        rows, depth, parent, side = stack.pop()
        here = len(made["lo"])
        if parent >= 0:
            made[side][parent] = here
        for name, value in (("lo", 0.0), ("hi", 0.0), ("left", -1), ("right", -1), ("dense", False)):
            made[name].append(value)
        if len(rows) * each <= leaf or len(rows) < LEAST:
            continue
        some = units[rows[:: max(1, len(rows) // 256)]]
        pairs = len(some) * (len(some) - 1)
        if (np.count_nonzero(some @ some.T >= threshold) - len(some)) >= DENSE * pairs:
            made["dense"][here] = True
            continue
        if depth not in projected:
            projected[depth] = units @ direction(dim, tree, level + depth)
        at = projected[depth][rows]
        middle = float(np.median(at))
        lo, hi = middle - margin, middle + margin
        left, right = rows[at <= hi], rows[at >= lo]
        if max(len(left), len(right)) > 0.95 * len(rows):
            made["dense"][here] = True
            continue
        made["lo"][here], made["hi"][here] = lo, hi
        stack += [(right, depth + 1, here, "right"), (left, depth + 1, here, "left")]
    return made


def descend(
    units: np.ndarray, node: int, tree: int, level: int, splits: dict[str, list]
) -> Iterator[tuple[np.ndarray, tuple[int, int, int, bool]]]:
    """Deals vectors to the leaves of a node: (row numbers, leaf)."""
    projected: dict[int, np.ndarray] = {}
    stack = [(np.arange(len(units)), 0, 0)]
    while stack:
        rows, here, depth = stack.pop()
        if not len(rows):
            continue
        if splits["left"][here] < 0:
            yield rows, (child_node(node, here), tree, level + depth, splits["dense"][here])
            continue
        if depth not in projected:
            projected[depth] = units @ direction(units.shape[1], tree, level + depth)
        at = projected[depth][rows]
        stack.append((rows[at >= splits["lo"][here]], splits["right"][here], depth + 1))
        stack.append((rows[at <= splits["hi"][here]], splits["left"][here], depth + 1))


def _root(tree: int, dim: int) -> int:
    return child_node(tree, dim)


def _fit(sampled: DataFrame, leaf: int, threshold: float) -> DataFrame:
    """Splits of each node (node, tree, level, vectors, vec): one bounded group per node."""

    def run(table: pa.Table) -> pa.Table:
        first = {name: table[name][0].as_py() for name in ("node", "tree", "level", "vectors")}
        # A node has one length of vectors; its id is made from it.
        ((_, units),) = matrices(table["vec"])
        splits = learn(units, first["vectors"], first["tree"], first["level"], leaf, threshold)
        return pa.table(
            {"node": pa.array([first["node"]], pa.int64()), "splits": pa.array([splits], kind)}
        )

    kind = pa.struct(
        [("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]
        + [("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))]
        + [("dense", pa.list_(pa.bool_()))]
    )
    return sampled.groupBy("node").applyInArrow(run, f"node bigint, {_SPLITS}")


def _sampled(vectors: str, sample: int) -> object:
    """Whether a class is in a node's sample, by its checksum."""
    share = F.lit(float(sample) * (1 << 20)) / F.col(vectors)
    return F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < share


def _leaf_arrays(dealt: list[list[tuple]]) -> pa.Array:
    kind = pa.list_(
        pa.struct([("node", pa.int64()), ("tree", pa.int32()), ("level", pa.int32()), ("dense", pa.bool_())])
    )
    names = ("node", "tree", "level", "dense")
    return pa.array([[dict(zip(names, leaf)) for leaf in leaves] for leaves in dealt], kind)


def _first_deal(classes: DataFrame, trees: int, leaf: int, sample: int, threshold: float) -> DataFrame:
    """Every class with its leaves in all trees, as far as one sample a tree reaches."""
    sizes = {r["dim"]: r["vectors"] for r in classes.groupBy(F.size("vec").alias("dim")).agg(
        F.count(F.lit(1)).alias("vectors")).collect()}
    roots = [(_root(t, dim), t, 0, dim, n) for dim, n in sizes.items() for t in range(trees)]
    nodes = classes.sparkSession.createDataFrame(
        roots, "node bigint, tree int, level int, dim int, vectors bigint"
    )
    sampled = classes.withColumn("dim", F.size("vec")).join(F.broadcast(nodes), "dim")
    learned = _fit(sampled.where(_sampled("vectors", sample)), leaf, threshold).collect()
    # One entry a tree and length of vectors, each bounded by the sample.
    shared = classes.sparkSession.sparkContext.broadcast(
        {r["node"]: r["splits"].asDict() for r in learned}
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dealt: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for numbers, units in matrices(batch.column(1)):
                for tree in range(trees):
                    root = _root(tree, units.shape[1])
                    splits = shared.value.get(root, {"left": [-1], "dense": [False]})
                    for rows, found in descend(units, root, tree, 0, splits):
                        for row in numbers[rows].tolist():
                            dealt[row].append(found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _leaf_arrays(dealt)], names=[*batch.schema.names, "leaves"]
            )

    kind = classes.schema["vec"].dataType.simpleString()
    return classes.select("cid", "vec", "weight").mapInArrow(
        run, f"cid bigint, vec {kind}, weight bigint, {_LEAVES}"
    )


def _deal_again(dealt: DataFrame, over: DataFrame, leaf: int, sample: int, threshold: float) -> DataFrame:
    """Leaves listed in ``over`` (node, vectors) are split by samples of their own."""
    inside = dealt.select("cid", "vec", F.explode("leaves").alias("at")).select(
        "cid", "vec", "at.node", "at.tree", "at.level"
    ).join(over, "node")
    splits = _fit(inside.where(_sampled("vectors", sample)), leaf, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            _, first = np.unique(nodes, return_index=True)
            out: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for at in first.tolist():
                mine = np.flatnonzero(nodes == nodes[at])
                node, tree, level, own = (
                    batch.column(name)[at].as_py() for name in ("node", "tree", "level", "splits")
                )
                for numbers, units in matrices(batch.column("vec").take(pa.array(mine))):
                    for rows, found in descend(units, node, tree, level, own):
                        for row in mine[numbers[rows]].tolist():
                            out[row].append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("node"), _leaf_arrays(out)],
                names=["cid", "node", "leaves"],
            )

    new = (
        inside.join(splits, "node")
        .mapInArrow(run, f"cid bigint, node bigint, {_LEAVES}")
        .groupBy("cid")
        .agg(F.collect_list("node").alias("old"), F.flatten(F.collect_list("leaves")).alias("new"))
    )
    stays = F.filter("leaves", lambda at: ~F.array_contains("old", at["node"]))
    return dealt.join(new, "cid", "left").select(
        "cid", "vec", "weight",
        F.when(F.col("old").isNull(), F.col("leaves"))
        .otherwise(F.concat(stays, F.col("new"))).alias("leaves"),
    )


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of all rows after linking the pairs (i, j)."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up


def _leaf_bits(node: int, lists: pa.Array) -> np.ndarray:
    """Per row a bit for each leaf before ``node`` that it shares with another row here."""
    flat = lists.values.to_numpy()
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    before = flat < node
    ids, at, times = np.unique(flat[before], return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[at]
    bits = np.zeros((len(lists), max(1, -(-int(shared.sum()) // 64))), np.uint64)
    column = number[at[use]]
    np.bitwise_or.at(
        bits, (rows[before][use], column // 64), np.uint64(1) << (column % 64).astype(np.uint64)
    )
    return bits


def compare(
    units: np.ndarray, weights: np.ndarray, bits: np.ndarray, own: np.ndarray | None, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that no earlier leaf has, by weight, and the rows' roots.

    ``own`` marks the rows of the first of two blocks; within one block it is None.
    """
    n, dim = units.shape
    single = units.astype(np.float32)
    error = (dim + 8) * 2.0**-23
    counts, label = np.zeros(n, np.int64), np.arange(n)
    for start in range(0, n, CHUNK):
        rows = np.arange(start, min(start + CHUNK, n))
        near = single[rows] @ single.T
        i, j = np.nonzero(near >= threshold - error)
        value = near[i, j]
        i = rows[i]
        once = j > i if own is None else own[i] & ~own[j]
        i, j, value = i[once], j[once], value[once]
        for at in range(0, len(i), PAIRS):
            a, b, v = (x[at : at + PAIRS] for x in (i, j, value))
            close = np.abs(v - threshold) <= error
            linked = ~close
            linked[close] = np.einsum("ij,ij->i", units[a[close]], units[b[close]]) >= threshold
            linked &= ~(bits[a] & bits[b]).any(axis=1)
            a, b = a[linked], b[linked]
            counts += np.bincount(a, weights[b], n).astype(np.int64)
            counts += np.bincount(b, weights[a], n).astype(np.int64)
            label = _merge(label, a, b)
    return counts, label


def _links(dealt: DataFrame, sizes: DataFrame, block: int, threshold: float) -> DataFrame:
    """(cid, n, root): per leaf and linked class its links, and a class it is connected to."""
    large = sizes.where(F.col("vectors") > block).select(
        "node", F.ceil(F.col("vectors") / block).cast("int").alias("blocks")
    )
    placed = dealt.select(
        "cid", "vec", "weight", F.col("leaves.node").alias("all"), F.explode("leaves.node").alias("node")
    ).join(large, "node", "left")
    own = F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    met = placed.withColumn("block", own).withColumn("with", every)
    met = met.withColumns({"one": F.least("block", "with"), "two": F.greatest("block", "with")})

    def run(table: pa.Table) -> pa.Table:
        node, one, two = (table[name][0].as_py() for name in ("node", "one", "two"))
        cids = table["cid"].to_numpy()
        weights = table["weight"].to_numpy()
        side = None if one == two else table["block"].to_numpy() == one
        bits = _leaf_bits(node, table["all"].combine_chunks())
        out: list[list] = [[], [], []]
        for rows, units in matrices(table["vec"]):
            counts, label = compare(
                units, weights[rows], bits[rows], None if side is None else side[rows], threshold
            )
            has = counts > 0
            for kept, values in zip(out, (cids[rows][has], counts[has], cids[rows][label[has]])):
                kept.append(values)
        arrays = [pa.array(np.concatenate(v), pa.int64()) if v else pa.array([], pa.int64()) for v in out]
        return pa.Table.from_arrays(arrays, names=["cid", "n", "root"])

    return (
        met.select("cid", "vec", "weight", "all", "node", "block", "one", "two")
        .groupBy("node", "one", "two")
        .applyInArrow(run, "cid bigint, n bigint, root bigint")
    )


def usable(vector: str):
    """Finite numbers throughout, and not all zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; see the module's text."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vec"))
    rows = rows.withColumn("good", usable("vec"))
    classes = cut(
        rows.where("good")
        .groupBy("vec")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    trees = trees_for(classes.count(), leaf, threshold)
    dealt = cut(_first_deal(classes, trees, leaf, sample, threshold))
    while True:
        sizes = cut(
            dealt.select(F.explode("leaves").alias("at"))
            .groupBy("at.node", "at.dense")
            .agg(F.count(F.lit(1)).alias("vectors"))
        )
        over = sizes.where((F.col("vectors") > 2 * leaf) & ~F.col("dense")).select("node", "vectors")
        if over.isEmpty():
            break
        dealt = cut(_deal_again(dealt, over, leaf, sample, threshold))
    found = cut(_links(dealt, sizes, 2 * leaf, threshold))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    nodes = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = nodes.withColumnRenamed("node", "cid").join(classes.select("cid", "least"), "cid")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = (
        classes.join(counts, "cid", "left")
        .join(nodes.withColumnRenamed("node", "cid").join(names, "root"), "cid", "left")
        .select(
            "vec",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    linked = rows.where("good").join(of_class, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
