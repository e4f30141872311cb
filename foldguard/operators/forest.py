"""Random forests of regression trees on cells: each tree's own bootstrap of all rows, summed by the rows' bins.

Trees cut features at up to ``bins`` places each, so a row matters to a tree by its cell: the bins of its features. Of its bootstrap a tree needs
only how often rows of a cell were drawn and the sum of their targets. The rows are packed once into blocks, every tree draws from every block,
and what is kept are two numbers per tree and cell, whatever the rows. Tasks hold a few trees each and stream the blocks.

Of a block with ``n`` rows a tree draws Poisson(n) times one of them, which is Poisson(1) copies of each row, as in Spark's forest.
Its rules are Spark's too: a third of the features tried at each node, the split that lowers the squared error most, first of equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BATCH_CONF, importable, stage, unstage

#: Cells of the grid that a tree may hold; with more, where features are many and wide, trees need the rows themselves.
MOST_CELLS = 1 << 18
BLOCK_ROWS = 1 << 16  # a draw within a block is 16 random bits
GROUP_TREES = 10  # that one task holds
PART_ROWS = 1 << 24  # that one task streams; each part adds two numbers per tree and cell to what is merged
ACCURACY = 10_000  # of the quantiles: an edge is off by one in so many rows at most

Box = tuple[tuple[int, int], ...]  # per feature the first bin and the one after the last


@dataclass(frozen=True)
class Growth:
    """What a tree obeys."""

    depth: int = 5
    least_rows: int = 1
    least_gain: float = 0.0


@dataclass(frozen=True)
class Grid:
    """Per feature the thresholds in order (a value up to a threshold lies left of it), and the mean target."""

    edges: tuple[tuple[float, ...], ...]
    mean: float

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(e) + 1 for e in self.edges)

    @property
    def cells(self) -> int:
        return int(np.prod([float(n) for n in self.shape]))

    def codes(self, values: np.ndarray) -> np.ndarray:
        """The cell number of each row of ``values``."""
        at = [np.searchsorted(np.array(e), values[:, i], side="left") for i, e in enumerate(self.edges)]
        return np.ravel_multi_index(at, self.shape)


def grid_of(rows: DataFrame, features: int, bins: int) -> Grid | None:
    """The grid of ``rows`` (``_x`` array, ``_y``); None if a value is missing or not finite, which only Spark's forest knows to name.

    A feature with up to ``bins`` values is cut between each two of them, another at its quantiles.
    """
    values = [F.element_at("_x", i + 1) for i in range(features)]
    size = F.size("_x") != features
    odd = reduce(or_, [v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in [*values, F.col("_y")]], F.col("_x").isNull() | size)
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(
        F.max(F.coalesce(odd, F.lit(True))).alias("odd"), F.avg("_y").alias("mean"), F.array(*[F.approx_count_distinct(v) for v in values]).alias("distinct"),
        F.array(*[F.max(v) for v in values]).alias("top"), F.array(*[F.percentile_approx(v, shares, ACCURACY) for v in values]).alias("quantiles"),
    ).first()
    if found["odd"] or found["mean"] is None:
        return None
    few = [i for i, n in enumerate(found["distinct"]) if n <= 2 * bins]  # perhaps; the count is rough
    sets = [F.collect_set(values[i]).alias(f"v{i}") for i in few]
    known = rows.agg(*sets).first().asDict() if few else {}
    edges = []
    for i in range(features):
        own = sorted(known.get(f"v{i}", ()))
        if own and len(own) <= bins:
            edges.append(tuple((a + b) / 2 for a, b in zip(own, own[1:], strict=False)))
        else:
            edges.append(tuple(sorted({q for q in found["quantiles"][i] if q < found["top"][i]})))
    return Grid(tuple(edges), found["mean"])


def packed(rows: DataFrame, grid: Grid) -> DataFrame:
    """Blocks of rows in order of their cells: ``part, number, rows``, the cells met with where each begins, and the targets less the mean."""

    def block(number: int, codes: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch:
        cell, target = np.concatenate(codes), np.concatenate(y)
        order = np.argsort(cell, kind="stable")
        at, starts = np.unique(cell[order], return_index=True)
        row = [TaskContext.get().partitionId(), number, len(cell), at.astype(np.int32).tobytes(), starts.astype(np.int32).tobytes(), target[order].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, y, count, number = [], [], 0, 0
        for batch in batches:
            values = np.asarray(batch.column("_x").flatten()).reshape(batch.num_rows, len(grid.edges))
            cell, target = grid.codes(values), np.asarray(batch.column("_y")) - grid.mean
            while len(cell):
                n = BLOCK_ROWS - count
                codes.append(cell[:n])
                y.append(target[:n])
                count += len(cell[:n])
                cell, target = cell[n:], target[n:]
                if count == BLOCK_ROWS:
                    yield block(number, codes, y)
                    codes, y, count, number = [], [], 0, number + 1
        if count:
            yield block(number, codes, y)

    names = ["part", "number", "rows", "cells", "starts", "y"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    schema = "part int, number int, rows int, cells binary, starts binary, y binary"
    return importable(rows).mapInArrow(pack, schema)


def drawn(rng: np.random.Generator, starts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bootstrap of a block: how many rows of each of its cells were drawn, and the sum of their targets."""
    times = np.bincount(rng.integers(0, len(y), rng.poisson(len(y)), dtype=np.uint16), minlength=len(y))
    return np.add.reduceat(times, starts), np.add.reduceat(times * y, starts)


def grown(n: np.ndarray, s: np.ndarray, rng: np.random.Generator, tried: int, growth: Growth) -> list[tuple[Box, float]]:
    """The leaves of one tree on the grid, each with its mean; ``n`` and ``s`` are rows and sums of targets per cell."""
    leaves: list[tuple[Box, float]] = []

    def cut(box: Box, level: int) -> None:
        own_n, own_s = (a[tuple(slice(*side) for side in box)] for a in (n, s))
        rows, total = own_n.sum(), own_s.sum()
        best = (0.0, -1, 0)
        if level < growth.depth and rows > 0:
            for axis in sorted(rng.choice(n.ndim, tried, replace=False).tolist()):
                others = tuple(i for i in range(n.ndim) if i != axis)
                left_n, left_s = own_n.sum(others).cumsum()[:-1], own_s.sum(others).cumsum()[:-1]
                right_n, right_s = rows - left_n, total - left_s
                allowed = (left_n >= max(1, growth.least_rows)) & (right_n >= max(1, growth.least_rows))
                if not allowed.any():
                    continue
                gain = left_s**2 / np.where(allowed, left_n, 1) + right_s**2 / np.where(allowed, right_n, 1) - total**2 / rows
                gain = np.where(allowed, gain / rows, -np.inf)
                top = int(gain.argmax())
                if gain[top] > best[0] and gain[top] >= growth.least_gain:
                    best = (float(gain[top]), axis, box[axis][0] + top + 1)
        if best[1] < 0:
            leaves.append((box, float(total / rows) if rows > 0 else 0.0))
            return
        _, axis, place = best
        for side in ((box[axis][0], place), (place, box[axis][1])):
            cut((*box[:axis], side, *box[axis + 1 :]), level + 1)

    cut(tuple((0, size) for size in n.shape), 0)
    return leaves


def _source(*numbers: int) -> np.random.Generator:
    return np.random.Generator(np.random.SFC64([x & 0xFFFFFFFFFFFFFFFF for x in numbers]))


def grown_trees(rows: DataFrame, grid: Grid, trees: int, seed: int, growth: Growth) -> list[list[tuple[Box, float]]]:
    """All trees, each as its leaves. ``rows`` has ``_x`` and ``_y``."""
    spark = rows.sparkSession
    tried = 1 if trees < 1 else len(grid.edges) if trees == 1 else -(-len(grid.edges) // 3)
    blocks = stage(packed(rows, grid), "forest-blocks")
    parts = max(1, -(-(blocks.agg(F.sum("rows")).first()[0] or 0) // PART_ROWS))
    own = spark.newSession()  # a batch has one block, without a setting that fits in other threads would see
    own.conf.set(BATCH_CONF, "1")
    streamed = own.read.schema(blocks.schema).parquet(*blocks.inputFiles()).coalesce(parts)
    groups = own.range(0, trees, GROUP_TREES, -(-trees // GROUP_TREES)).withColumnRenamed("id", "first")

    def leaves(tree: int, n: np.ndarray, s: np.ndarray) -> list:
        found = grown(n.reshape(grid.shape), s.reshape(grid.shape), _source(seed, tree), tried, growth)
        return [tree, [x for box, _ in found for side in box for x in side], [v for _, v in found]]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        first, n, s = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if first is None:
                    first = row["first"]
                    n, s = np.zeros((2, min(GROUP_TREES, trees - first), grid.cells))
                at, starts = (np.frombuffer(row[c], np.int32) for c in ("cells", "starts"))
                y = np.frombuffer(row["y"])
                for i in range(len(n)):
                    times, sums = drawn(_source(seed, first + i, row["part"], row["number"]), starts, y)
                    n[i, at] += times
                    s[i, at] += sums
        for i in range(0 if n is None else len(n)):
            yield first + i, n[i], s[i]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, n, s in held(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(leaves(tree, n, s), types, strict=True)], names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, n, s in held(batches):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([tree, at.astype(np.int32).tobytes(), n[at].tobytes(), s[at].tobytes()], part_types, strict=True)], part_names)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = np.zeros((2, grid.cells))
        for row in pdf.sort_values("n").itertuples():  # doubles are added in one order
            at = np.frombuffer(row.cells, np.int32)
            n[at] += np.frombuffer(row.n)
            s[at] += np.frombuffer(row.s)
        return pd.DataFrame([leaves(int(pdf["tree"].iloc[0]), n, s)], columns=names)

    names, types = ["tree", "box", "value"], [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
    part_names, part_types = ["tree", "cells", "n", "s"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    schema = "tree long, box array<int>, value array<double>"
    # Each pair of a part of the blocks and a group of trees is a task; the group is what it holds, the blocks pass by.
    met = importable(streamed).join(groups.hint("shuffle_replicate_nl"))
    if parts == 1:
        out = met.mapInArrow(whole, schema)
    else:
        some = met.mapInArrow(partial, "tree long, cells binary, n binary, s binary")
        out = some.repartition(groups.rdd.getNumPartitions(), "tree").groupBy("tree").applyInPandas(merge, schema)
    width = 2 * len(grid.edges)
    found = {}
    for row in out.collect():  # the leaves of all trees: at most two to the depth of each
        boxes = np.array(row["box"]).reshape(-1, width)
        found[row["tree"]] = [(tuple((int(b[i]), int(b[i + 1])) for i in range(0, width, 2)), v) for b, v in zip(boxes, row["value"], strict=True)]
    unstage(blocks)
    return [found[t] for t in range(trees)]


class CellForest(Model):
    """The mean over trees on one grid."""

    def __init__(self, grid: Grid, trees: Sequence[list[tuple[Box, float]]], vector: str, prediction: str):
        super().__init__()
        self.grid, self.trees, self.vector, self.prediction = grid, list(trees), vector, prediction

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def answers(self) -> np.ndarray:
        """The prediction in every cell."""
        total = np.zeros(self.grid.shape)
        for tree in self.trees:
            for box, value in tree:
                total[tuple(slice(*side) for side in box)] += value
        return total.ravel() / len(self.trees) + self.grid.mean

    def _transform(self, dataset: DataFrame) -> DataFrame:
        grid, answers = self.grid, self.answers()

        @F.pandas_udf("double")
        def predicted(*x: pd.Series) -> pd.Series:
            return pd.Series(answers[grid.codes(np.column_stack(x))])

        values = [F.element_at(vector_to_array(self.vector), i + 1) for i in range(len(grid.edges))]
        return importable(dataset).withColumn(self.prediction, predicted(*values))
