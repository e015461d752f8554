"""Forests as tables: a trained model's nodes, their scores and contributions for any number of rows.

Node table: ``tree_id, node_id, feature, threshold, left, right, value, cover``. A row goes left if
``x[feature] <= threshold``; a leaf has no children and a value (probability of class 1). ``cover`` is
the training weight that reached the node.

A forest is packed tree by tree. A small one, of a checked size, is shipped with the tasks. A larger one stays a table in
the shared folder: the rows' values are replaced by their ranks among the forest's thresholds, equal rank vectors are
looked at once, and vectors and trees meet in a grid of cells, each of a bounded number of vectors and a group of trees.
What the groups add to a vector is summed by a mergeable aggregate. No tree and no path passes through the driver.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import kernel
from holdfast.session import materialize, work_path

# The functions below travel with the tasks, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(kernel)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_SCHEMA = (
    "tree_id int, node_id int, feature int, threshold double, left int, right int, value double, cover double"
)
# One tree in one or more parts of at most PART_PATHS paths; its nodes are in the first.
TREE_SCHEMA = "tree_id int, part int, paths long, size long, base double, nodes binary, blocks binary"
SHIPPED_BYTES = 4 << 20
GROUP_BYTES = 32 << 20
PART_PATHS = 1 << 16
# The tables of a cell's paths are made once for its rows, so it has many.
CELL_ROWS = 1 << 17
PATHS_PER_TASK = 50_000_000
RANKS = "_ranks"


def nodes_from_rows(spark: SparkSession, rows: Sequence[Sequence]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], NODE_SCHEMA)


def nodes_of_model(spark: SparkSession, forest_path: str) -> DataFrame:
    """Node table of a saved ``RandomForestClassificationModel`` for two classes.

    A one-hot column is split as a two-valued category: the listed value goes left. Both cases become
    ``x <= 0.5``; where the listed value is 1 the children swap.
    """
    n = F.col("nodeData")
    split = n["split"]
    weight = n["impurityStats"][0] + n["impurityStats"][1]
    is_leaf = n["leftChild"] < 0
    is_category = split["numCategories"] >= 0
    swap = is_category & (split["leftCategoriesOrThreshold"][0] == 1.0)
    many = F.raise_error(F.lit("categorical splits of more than two values: one-hot encode the column"))
    threshold = (
        F.when(~is_category, split["leftCategoriesOrThreshold"][0])
        .when(split["numCategories"] == 2, F.lit(0.5))
        .otherwise(many.cast("double"))
    )
    return spark.read.parquet(f"{forest_path}/data").select(
        F.col("treeID").alias("tree_id"),
        n["id"].alias("node_id"),
        F.when(~is_leaf, split["featureIndex"]).alias("feature"),
        F.when(~is_leaf, threshold).alias("threshold"),
        F.when(~is_leaf, F.when(swap, n["rightChild"]).otherwise(n["leftChild"])).alias("left"),
        F.when(~is_leaf, F.when(swap, n["leftChild"]).otherwise(n["rightChild"])).alias("right"),
        (n["impurityStats"][1] / weight).alias("value"),
        weight.alias("cover"),
    )


def _dense(nodes: pd.DataFrame, cuts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """One tree as arrays by node number, in the order of its node ids; the root is the first. Leaves have feature -1."""
    nodes = nodes.sort_values("node_id")
    ids = nodes["node_id"].to_numpy()

    def place(column: str) -> np.ndarray:
        return np.searchsorted(ids, nodes[column].fillna(0).to_numpy(dtype=np.int64))

    feature = nodes["feature"].fillna(-1).to_numpy(dtype=np.int64)
    threshold = nodes["threshold"].to_numpy(dtype=np.float64)
    cut = np.zeros(len(ids), dtype=np.int64)
    for f in np.unique(feature[feature >= 0]):
        mine = feature == f
        cut[mine] = np.searchsorted(cuts[f], threshold[mine])
    value, cover = nodes["value"].to_numpy(dtype=np.float64), nodes["cover"].to_numpy(dtype=np.float64)
    return {"feature": feature, "cut": cut, "left": place("left"), "right": place("right"), "value": value, "cover": cover}


def _tree_paths(tree: dict[str, np.ndarray]) -> Iterator[tuple[list, list, list, list, float]]:
    """Per leaf: the features of its path, the least and greatest rank and the share of each, and the leaf's value."""
    feature, cut, left, right, value, cover = (c.tolist() for c in tree.values())
    stack = [(0, {})]
    while stack:
        node, limits = stack.pop()
        f = feature[node]
        if f < 0:
            names = sorted(limits)
            low, high, share = zip(*[limits[n] for n in names], strict=True) if names else ((), (), ())
            yield names, list(low), list(high), list(share), value[node]
            continue
        low, high, share = limits.get(f, (0, kernel.TOP, 1.0))
        for child, is_left in ((left[node], True), (right[node], False)):
            bounds = (low, min(high, cut[node])) if is_left else (max(low, cut[node] + 1), high)
            stack.append((child, {**limits, f: (*bounds, share * cover[child] / cover[node])}))


def _packed_tree(nodes: pd.DataFrame, cuts: list[np.ndarray], n_trees: int) -> pd.DataFrame:
    """The parts of one tree; its values are its share of the mean over all trees."""
    tree_id, tree = int(nodes["tree_id"].iloc[0]), _dense(nodes, cuts)
    tree["value"] = tree["value"] / n_trees
    walked = kernel.tree_arrays(*(tree[c] for c in ("feature", "cut", "left", "right", "value")))
    rows, paths = [], list(_tree_paths(tree))
    for part, first in enumerate(range(0, len(paths), PART_PATHS)):
        names, low, high, share, value = zip(*paths[first : first + PART_PATHS], strict=True)
        base = float(sum(v * np.prod(s) for v, s in zip(value, share, strict=True)))
        blob = pickle.dumps(kernel.group_paths(names, low, high, share, value), protocol=5)
        head = pickle.dumps(walked, protocol=5) if part == 0 else b""
        rows.append((tree_id, part, len(names), len(blob) + len(head), base, head, blob))
    return pd.DataFrame(rows, columns=["tree_id", "part", "paths", "size", "base", "nodes", "blocks"])


@dataclass
class Forest:
    """A forest ready to score and explain: either its trees (``shipped``) or the ``table`` that holds them."""

    names: list[str]
    n_trees: int
    n_paths: int
    base: float
    size: int
    cuts: list[np.ndarray]
    table: DataFrame | None = None
    trees: list[tuple] = field(default_factory=list)
    blocks: list[dict] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.names)

    @property
    def shipped(self) -> bool:
        return self.table is None


def thresholds(nodes: DataFrame, width: int) -> tuple[list[np.ndarray], int, int]:
    """Sorted distinct thresholds per feature, the number of trees and of nodes.

    A trained forest has at most ``maxBins`` - 1 thresholds per feature, however many trees and leaves.
    """
    rows = nodes.groupBy("feature").agg(
        F.collect_set("threshold").alias("cuts"), F.count_if(F.col("node_id") == 0).alias("roots"), F.count(F.lit(1)).alias("nodes")
    )
    cuts, trees, n_nodes = [np.zeros(0)] * width, 0, 0
    for r in rows.collect():
        trees, n_nodes = trees + r.roots, n_nodes + r.nodes
        if r.feature is not None:
            cuts[r.feature] = np.sort(np.array(r.cuts, dtype=np.float64))
    return cuts, trees, n_nodes


def build_forest(nodes: DataFrame, names: Sequence[str], shipped_bytes: int = SHIPPED_BYTES) -> Forest:
    """Pack a node table. Node 0 is the root of its tree; a group of the packing is one tree of one model.

    Only thresholds and sums reach the driver, and the trees too if the nodes say that they cannot exceed
    ``shipped_bytes``.
    """
    spark, width = nodes.sparkSession, len(names)
    cuts, n_trees, n_nodes = thresholds(nodes, width)
    packed = nodes.groupBy("tree_id").applyInPandas(lambda tree: _packed_tree(tree, cuts, n_trees), TREE_SCHEMA)
    # 40 bytes a node, and 20 bytes for each feature of a path.
    at_most = n_nodes * (40 + 10 * width)
    if at_most <= shipped_bytes:
        rows = packed.orderBy("tree_id", "part").collect()
        total = [sum(r[c] for r in rows) for c in ("base", "paths", "size")]
        trees = [pickle.loads(r.nodes) for r in rows if r.nodes]
        blocks = kernel.merge_blocks([pickle.loads(r.blocks) for r in rows])
        return Forest(list(names), n_trees, total[1], total[0], total[2], cuts, None, trees, blocks)
    path = work_path(spark, "forest")
    packed.write.parquet(path)
    table = spark.read.schema(packed.schema).parquet(path)
    base, paths, size = table.agg(F.sum("base"), F.sum("paths"), F.sum("size")).first()
    return Forest(list(names), n_trees, paths, base, size, cuts, table)


def save_forest(forest: Forest, path: str) -> str:
    """Keep a packed forest that is a table: its trees, and one row with its sums and thresholds."""
    head = [(forest.names, forest.n_trees, forest.n_paths, forest.base, forest.size, [c.tolist() for c in forest.cuts])]
    spark = forest.table.sparkSession
    forest.table.write.mode("overwrite").parquet(f"{path}/trees")
    rows = spark.createDataFrame(head, "names array<string>, n_trees int, n_paths long, base double, size long, cuts array<array<double>>")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
    return path


def load_forest(spark: SparkSession, path: str) -> Forest:
    h = spark.read.parquet(f"{path}/head").first()
    cuts = [np.array(c, dtype=np.float64) for c in h.cuts]
    return Forest(h.names, h.n_trees, h.n_paths, h.base, h["size"], cuts, spark.read.parquet(f"{path}/trees"))


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)


def _lists(values: np.ndarray) -> pa.ListArray:
    """A matrix (features x rows) as a list per row."""
    width, n = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values.T).ravel()))


def _score_kernel(ranks: np.ndarray, trees: list[tuple], blocks: list[dict]) -> pa.Array:
    return pa.array(kernel.walk(ranks, trees))


def _phi_kernel(ranks: np.ndarray, trees: list[tuple], blocks: list[dict]) -> pa.Array:
    return _lists(kernel.contributions(ranks, blocks))


Kernel = Callable[[np.ndarray, list[tuple], list[dict]], pa.Array]


def _shipped_column(spark: SparkSession, forest: Forest, x: str, of: Kernel, kind: str) -> Column:
    """The kernel's sums over all trees, by a function that carries the forest with it."""
    width = forest.width
    held = spark.sparkContext.broadcast((forest.cuts, forest.trees, forest.blocks))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cuts, trees, blocks = held.value
        for x in batches:
            yield of(kernel.rank_columns(_matrix(x, width), cuts), trees, blocks)

    return run(F.col(x))


def _rank_column(forest: Forest, x: str) -> Column:
    """The ranks of a vector, two or four bytes each, as one binary value."""
    cuts, width = forest.cuts, forest.width

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            ranks = np.ascontiguousarray(kernel.rank_columns(_matrix(x, width), cuts).T)
            offsets = np.arange(len(ranks) + 1, dtype=np.int32) * (ranks.itemsize * width)
            yield pa.Array.from_buffers(pa.binary(), len(ranks), [None, pa.py_buffer(offsets), pa.py_buffer(ranks)])

    return run(F.col(x))


def _grid(vectors: DataFrame, forest: Forest, of: Kernel, kind: str, n: int) -> DataFrame:
    """(ranks, value) of distinct rank vectors: what each group of trees adds to each of them.

    Vectors are dealt to as many rows of cells as keep a cell at about CELL_ROWS of them; trees to as many columns as
    keep a group at GROUP_BYTES, or as give every core two cells. A cell is a task. It reads its trees first, and
    then its vectors in pieces.
    """
    cores, width = vectors.sparkSession.sparkContext.defaultParallelism, forest.width
    down = max(1, -(-n // CELL_ROWS))
    across = max(1, -(-forest.size // GROUP_BYTES), min(forest.n_trees, -(-2 * cores // down)))
    item = 2 if max((len(c) for c in forest.cuts), default=0) <= np.iinfo(np.uint16).max else 4
    most = CELL_ROWS + CELL_ROWS // 4  # cells differ a little in size
    schema = pa.schema([(RANKS, pa.binary()), ("value", pa.list_(pa.float64()) if kind.startswith("array") else pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, parts, blocks, waiting = [], [], None, []

        def finish() -> pa.RecordBatch:
            ranks = np.frombuffer(b"".join(waiting), dtype=f"u{item}").reshape(len(waiting), width).T
            return pa.RecordBatch.from_arrays([pa.array(waiting, pa.binary()), of(ranks, trees, blocks)], schema=schema)

        for batch in batches:
            for nodes, packed, ranks in zip(*(batch.column(c).to_pylist() for c in ("nodes", "blocks", RANKS)), strict=True):
                if ranks is None:
                    trees += [pickle.loads(nodes)] if nodes else []
                    parts.append(pickle.loads(packed))
                    continue
                if blocks is None:
                    blocks, parts = kernel.merge_blocks(parts), []
                waiting.append(ranks)
                if len(waiting) == most:
                    yield finish()
                    waiting = []
        if waiting:
            yield finish()

    no_tree, no_ranks = F.lit(None).cast("binary"), F.lit(None).cast("binary").alias(RANKS)
    rows = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_column"),
        F.pmod(F.xxhash64(RANKS), F.lit(down)).cast("int").alias("_row"),
        no_tree.alias("nodes"),
        no_tree.alias("blocks"),
        RANKS,
    )
    trees = forest.table.select(
        # Trees of a size lie side by side, so their numbers are dealt out in turn.
        F.pmod(F.col("tree_id") + F.col("part"), F.lit(across)).cast("int").alias("_column"),
        F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_row"),
        "nodes",
        "blocks",
        no_ranks,
    )
    met = trees.unionByName(rows).repartitionById(down * across, F.col("_row") * across + F.col("_column"))
    met = met.sortWithinPartitions(F.col(RANKS).isNotNull()).select("nodes", "blocks", RANKS)
    return met.mapInArrow(run, f"{RANKS} binary, value {kind}")


def _with_sums(df: DataFrame, forest: Forest, x: str, out: str, of: Kernel, kind: str, sums: Column) -> DataFrame:
    """``df`` with the kernel's sums over a forest that is a table; ``sums`` adds up what the groups add."""
    ranked = materialize(df.withColumn(RANKS, _rank_column(forest, x)))
    vectors = ranked.select(RANKS).distinct()
    found = _grid(vectors, forest, of, kind, vectors.count()).groupBy(RANKS).agg(sums.alias(out))
    return ranked.join(found, RANKS).drop(RANKS)


def _tree_expression(tree: dict[int, dict], node_id: int, x: Column) -> Column:
    node = tree[node_id]
    if node["left"] is None:
        return F.lit(float(node["value"]))
    left = _tree_expression(tree, node["left"], x)
    right = _tree_expression(tree, node["right"], x)
    return F.when(x[node["feature"]] <= node["threshold"], left).otherwise(right)


def score_rows(df: DataFrame, rows: Sequence[Sequence], x: str = "x", out: str = "churn_risk") -> DataFrame:
    """Mean leaf value over the trees of a forest that is written down as node rows: an expression per tree."""
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        node = dict(zip(names, r, strict=True))
        trees.setdefault(node["tree_id"], {})[node["node_id"]] = node
    total = F.lit(0.0)
    for _, tree in sorted(trees.items()):
        total = total + _tree_expression(tree, 0, F.col(x))
    return df.withColumn(out, total / F.lit(float(len(trees))))


def score(df: DataFrame, forest: Forest, x: str = "x", out: str = "churn_risk") -> DataFrame:
    """Mean leaf value over the trees of a packed forest. Rows with equal ranks are scored once if it is a table."""
    if forest.shipped:
        return df.withColumn(out, _shipped_column(df.sparkSession, forest, x, _score_kernel, "double"))
    return _with_sums(df, forest, x, out, _score_kernel, "double", F.sum("value"))


def with_score(df: DataFrame, forest: Forest, phi: str = "phi", out: str = "churn_risk") -> DataFrame:
    """The score of explained rows: the base and all contributions."""
    return df.withColumn(out, F.lit(forest.base) + F.aggregate(phi, F.lit(0.0), lambda a, b: a + b))


def tasks_for(rows: int, forest: Forest) -> int:
    """Tasks for so many rows of a shipped forest: the work is rows times paths, which their bytes do not show."""
    return max(1, -(-rows * forest.n_paths // PATHS_PER_TASK))


def shap_values(
    df: DataFrame, forest: Forest, x: str = "x", out: str = "phi", tasks: int | None = None
) -> DataFrame:
    """Contribution of every encoded column to the score; ``forest.base`` plus their sum is the score.

    Only the vector ``x`` is sent to Python; all other columns stay in the JVM. With ``tasks`` the rows are spread
    over at least so many tasks, if the forest is shipped. If it is a table, rows with equal ranks are explained once.
    """
    if forest.shipped:
        if tasks is not None:
            df = df.repartition(max(tasks, df.rdd.getNumPartitions()))
        return df.withColumn(out, _shipped_column(df.sparkSession, forest, x, _phi_kernel, "array<double>"))
    sums = F.array(*[F.sum(F.col("value")[i]) for i in range(forest.width)])
    return _with_sums(df, forest, x, out, _phi_kernel, "array<double>", sums)
