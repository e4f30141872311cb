"""Exact k-nearest-neighbour join and the applicability domain built on it.

Space is cut by a tree of pivots: a node's vectors go to the nearest of its children's pivots, and nodes are split until a leaf holds about
``leaf_rows`` reference rows, so the number of leaves grows with the table and the cost of a comparison does not. For every leaf with
queries the triangle inequality bounds how far its neighbours can lie from its pivot; a node above has the bound that
covers its leaves. A reference row walks down the tree and leaves a branch as soon as it lies beyond the branch's bound,
so it meets the leaves that it can matter to, without being compared with all pivots.

The join packs neighbouring leaves into blocks of bounded size, each with its centre and extent, and compares the query blocks with the
reference blocks in reach. A task holds one pair of blocks and keeps k rows per query, never its pairs; rows are packed once on either side,
so where vectors of many dimensions leave nearly every leaf in reach, no row is copied for each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.hashing import seeded_md5
from ..session import BATCH_CONF, importable, stage
from .metrics import abs_error
from .ranking import exact_quantiles

QUERY_BLOCK = 2048
REFERENCE_BLOCK = 4096
#: Limits in bytes: of a block, of the blocks that one task writes, and of the reference blocks that one task holds.
BLOCK_BYTES, FILE_BYTES, HELD_BYTES = 4 << 20, 32 << 20, 64 << 20
LEAF_ROWS = 256
#: The tree is made of a sample and goes to every task: so many leaves at most, and so many sampled rows for each.
MOST_LEAVES, SAMPLED = 4096, 16
BRANCHES = 16
_QUERY_STEP = 512  # rows of one distance matrix
_SLACK = 1e-9  # bounds are widened by this relative amount, so rounding cannot lose a neighbour


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squares, 0.0))


@dataclass(frozen=True)
class PivotTree:
    """Nodes by number, the root first: their pivots, their children (none for a leaf), and each leaf's number."""

    pivots: np.ndarray
    children: tuple[tuple[int, ...], ...]
    leaf: tuple[int, ...]  # -1 for inner nodes

    @property
    def leaves(self) -> list[int]:
        return [n for n, i in enumerate(self.leaf) if i >= 0]


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the rows, each the farthest from those before it; fewer if no other row is left."""
    chosen = [0]
    away = _distances(rows, rows[[0]])[:, 0]
    while len(chosen) < n:
        top = int(away.argmax())
        if not (rows[top] != rows[chosen]).any(axis=1).all():
            break
        chosen.append(top)
        away = np.minimum(away, _distances(rows, rows[[top]])[:, 0])
    return rows[chosen]


def grown_tree(sample: np.ndarray, leaves: int, branches: int = BRANCHES) -> PivotTree:
    """Split the node whose rows lie farthest from its pivot in sum, into the cells of rows far apart, until there are so many leaves.

    ``sample`` comes in random order. Any tree gives the same neighbours. Rows that are all alike cannot be split.
    """
    pivots, children, rows, spread = [sample[0]], [()], {0: np.arange(len(sample))}, {0: math.inf}
    count = 1
    while count < leaves and spread:
        node = max(spread, key=lambda n: (spread[n], -n))
        del spread[node]
        at = rows.pop(node)
        chosen = far_apart(sample[at], min(branches, leaves - count + 1))
        if len(chosen) < 2:
            continue
        away = _distances(sample[at], chosen)
        near, own = away.argmin(1), []
        for i, pivot in enumerate(chosen):
            own.append(len(pivots))
            pivots.append(pivot)
            children.append(())
            rows[own[-1]] = at[near == i]
            if (total := float(away[near == i, i].sum())) > 0:
                spread[own[-1]] = total
        children[node] = tuple(own)
        count += len(own) - 1
    number = iter(range(count))
    return PivotTree(np.array(pivots), tuple(children), tuple(-1 if c else next(number) for c in children))


def choose_tree(refs: DataFrame, key: str, vector: str, leaf_rows: int = LEAF_ROWS) -> PivotTree | None:
    """A tree with a leaf for about every ``leaf_rows`` rows; None of an empty table."""
    leaves = min(MOST_LEAVES, max(1, -(-refs.count() // leaf_rows)))
    rows = refs.orderBy(seeded_md5("pivot", F.col(key)), key).limit(leaves * SAMPLED).select(vector).collect()
    return grown_tree(np.array([r[0] for r in rows], dtype=np.float64), leaves) if rows else None


def assigned(tree: PivotTree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each vector, always down to the nearest child, and its distance from the leaf's pivot."""
    node = np.zeros(len(vectors), np.int64)
    while True:
        moved = False
        for n in np.unique(node):
            if tree.children[n]:
                at, below = np.flatnonzero(node == n), np.array(tree.children[n])
                node[at] = below[_distances(vectors[at], tree.pivots[below]).argmin(1)]
                moved = True
        if not moved:
            break
    own = np.sqrt(((vectors - tree.pivots[node]) ** 2).sum(1))
    return np.array(tree.leaf)[node], own


def routed(tree: PivotTree, reach: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, leaf): the leaves whose reach a vector lies in, by the branches whose bound it does not pass."""
    rows, leaves = [], []
    waiting = [(0, np.arange(len(vectors)))]
    while waiting:
        n, at = waiting.pop()
        at = at[_distances(vectors[at], tree.pivots[[n]])[:, 0] <= reach[n]]
        if not len(at):
            continue
        if tree.children[n]:
            waiting += [(c, at) for c in tree.children[n]]
        else:
            rows.append(at)
            leaves.append(np.full(len(at), tree.leaf[n], np.int64))
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _to_cells(df: DataFrame, key: str, vector: str, tree: PivotTree) -> DataFrame:
    """(id, vector, leaf, distance to its pivot)."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, own = assigned(tree, _matrix(batch["vector"]))
                yield pd.DataFrame({"id": batch["id"], "vector": batch["vector"], "cell": cell.astype("int32"), "own": own})

    id_type = df.schema[key].dataType.simpleString()
    plain = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return importable(plain).mapInPandas(assign, f"id {id_type}, vector array<double>, cell int, own double")


def node_reach(tree: PivotTree, leaf_reach: dict[int, float]) -> np.ndarray:
    """Per node the distance from its pivot beyond which no row matters to a leaf below; -1 where no leaf is asked for."""
    out = np.full(len(tree.children), -1.0)
    held: list[list[int]] = [[] for _ in tree.children]  # leaves below, as nodes
    for n in reversed(range(len(tree.children))):  # children have larger numbers
        held[n] = [n] if not tree.children[n] else [x for c in tree.children[n] for x in held[c]]
        asked = [x for x in held[n] if tree.leaf[x] in leaf_reach]
        if asked:
            away = _distances(tree.pivots[[n]], tree.pivots[asked])[0]
            bound = max(d + leaf_reach[tree.leaf[x]] for d, x in zip(away, asked, strict=True))
            out[n] = bound * (1 + _SLACK) + _SLACK
    return out


def _reach(queries: DataFrame, refs: DataFrame, tree: PivotTree, k: int) -> dict[int, float]:
    """Per leaf with queries the distance from its pivot within which all neighbours must lie."""
    radius = {r["cell"]: r["u"] for r in queries.groupBy("cell").agg(F.max("own").alias("u")).collect()}
    order = Window.partitionBy("cell").orderBy("own", "id")
    nearest = (
        refs.select("cell", "own", "id").withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k).select("cell", "own").collect()  # k rows per leaf
    )
    pivots = tree.pivots[tree.leaves]
    rows: dict[int, list[float]] = {}
    for r in nearest:
        rows.setdefault(r["cell"], []).append(r["own"])
    cells = np.array(sorted(rows), np.int64)
    reach = {}
    for cell, u in radius.items():
        away = _distances(pivots[[cell]], pivots[cells])[0]
        close = np.argsort(away, kind="stable")  # any leaves bound the distance; the close ones bound it best
        bounds: list[float] = []
        for i in close:
            bounds += [away[i] + d for d in rows[int(cells[i])]]
            if len(bounds) >= 8 * k:
                break
        bounds.sort()
        reach[cell] = (bounds[k - 1] + u if len(bounds) >= k else math.inf) + u
    return {c: r * (1 + _SLACK) + _SLACK for c, r in reach.items()}


def regions(tree: PivotTree, rows: dict[int, int], most: int) -> list[int]:
    """Per leaf the node that its rows are packed under: the highest above it with at most ``most`` rows, or the leaf itself.

    Siblings in a row that have at most ``most`` rows together are packed under the first of them, as many small blocks cost more than a few wide ones.
    """
    held = [rows.get(i, 0) for i in tree.leaf]
    region = list(range(len(tree.children)))
    for n in reversed(region):  # children have larger numbers
        held[n] += sum(held[c] for c in tree.children[n])
    for n, below in enumerate(tree.children):
        first, together = n, most
        for c in below:
            together += held[c]
            if together > most:
                first, together = c, held[c]
            region[c] = region[n] if held[n] <= most else first
    return [region[n] for n in tree.leaves]


def _vectors(packed: bytes | pa.Buffer, rows: int, dim: int) -> np.ndarray:
    kind = np.float32 if memoryview(packed).nbytes == 4 * rows * dim else np.float64
    return np.frombuffer(packed, kind).reshape(rows, dim).astype(np.float64)


def _packed(vectors: np.ndarray) -> bytes:
    """The bytes of the vectors, as single precision where that holds every value."""
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    return (single if (single == vectors).all() else vectors).tobytes()


def _blocks(cells: DataFrame, tree: PivotTree, reach: dict[int, float], most: int, copies: int | None, label: str) -> DataFrame:
    """Rows packed by region into blocks of at most ``most``: ids, vectors, their centre, how far they lie from it, and how far their neighbours can lie.

    Of rows with the same vector only the ``copies`` lowest ids of a block are kept.
    """
    dim = tree.pivots.shape[1]
    most = max(1, min(most, BLOCK_BYTES // (8 * dim)))
    counts = {x["cell"]: x["n"] for x in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    region = regions(tree, counts, most)
    bounds = np.array([reach.get(c, -1.0) for c in range(len(tree.leaves))])

    def block(ids: list, vectors: np.ndarray, cell: np.ndarray, own: np.ndarray) -> list:
        if copies is not None:
            order = sorted(range(len(ids)), key=ids.__getitem__)
            seen: dict[bytes, int] = {}
            keep = []
            for i in order:
                value = vectors[i].tobytes()
                seen[value] = seen.get(value, 0) + 1
                if seen[value] <= copies:
                    keep.append(i)
            ids, vectors = [ids[i] for i in keep], vectors[keep]
        centre = vectors.mean(axis=0)
        away = float(np.sqrt(((vectors - centre) ** 2).sum(1)).max())
        # A query lies within its leaf's radius of the pivot, so what its leaf reaches less its own distance bounds its neighbours.
        near = float((bounds[cell] - own).max())
        return [ids, _packed(vectors), centre.tolist(), away, near]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, count = None, [], 0

        def out() -> pa.RecordBatch:
            ids = [i for part in held for i in part[0]]
            row = block(ids, *[np.concatenate([part[j] for part in held]) for j in (1, 2, 3)])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            types = [pa.list_(batch.column("id").type), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
            place = np.asarray(batch.column("region"))
            starts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for start, end in zip(starts, starts[1:], strict=False):
                if start == end:
                    continue
                if held and place[start] != now:
                    yield out()
                    held, count = [], 0
                now = place[start]
                while start < end:
                    n = min(end - start, most - count)
                    part = batch.slice(start, n)
                    vectors = np.asarray(part.column("vector").flatten()).reshape(n, dim)
                    held.append((part.column("id").to_pylist(), vectors, np.asarray(part.column("cell")), np.asarray(part.column("own"))))
                    start, count = start + n, count + n
                    if count == most:
                        yield out()
                        held, count = [], 0
        if held:
            yield out()

    names = ["ids", "vectors", "centre", "away", "near"]
    id_type = cells.schema["id"].dataType.simpleString()
    ordered = cells.withColumn("region", F.element_at(F.lit(region), F.col("cell") + 1))
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) * dim * 8 // FILE_BYTES))
    dealt = ordered.repartitionByRange(parts, "region", "cell", "id").sortWithinPartitions("region", "cell", "id")
    schema = f"ids array<{id_type}>, vectors binary, centre array<double>, away double, near double"
    return stage(dealt.select("id", "vector", "cell", "own", "region").mapInArrow(pack, schema), label)


class _Nearest:
    """The nearest references so far of the queries of one block.

    All pairs are compared in single precision, about a point near the queries, by a bound that no rounding lets exceed the true distance;
    distances are computed in double precision, for the pairs that the bound lets pass.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, self_join: bool):
        self.ids, self.vectors, self.k, self.self_join = ids, vectors, k, self_join
        self.limit = np.full(len(ids), np.inf)
        self.best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # place of the query, neighbour, distance; in this order of distances
        self.centre = vectors.mean(axis=0)
        shifted = vectors - self.centre
        self.own = (shifted * shifted).sum(1)
        self.shifted = {np.float64: np.concatenate([-2.0 * shifted, np.ones((len(shifted), 1))], axis=1)}
        self.room: dict[type, np.ndarray] = {}

    def _kind(self, lengths: np.ndarray) -> type:
        """Single precision, unless squares could leave its range or something is not finite."""
        top = max(float(self.own.max()), float(lengths.max()))
        return np.float32 if 1e-24 < top < 1e24 else np.float64

    def meet(self, r_ids: np.ndarray, rv: np.ndarray) -> None:
        moved = rv - self.centre
        lengths = (moved * moved).sum(1)
        kind = self._kind(lengths)
        if kind not in self.shifted:
            self.shifted[kind] = self.shifted[np.float64].astype(kind)
        dim, unit = rv.shape[1], float(np.finfo(kind).eps)
        # A sum of dim + 1 products is off by less than dim + 2 roundings of the sum of their sizes; each factor was rounded once before.
        widest = float(np.sqrt(self.own.max()))
        error = (dim + 8) * unit * (2.0 * widest * np.sqrt(lengths) + lengths + self.own.max()) + (1e-38 if kind is np.float32 else 0.0)
        sides = np.concatenate([moved, (lengths - error)[:, None]], axis=1).astype(kind).T
        most = 2.0 * float(error.max())
        itself = np.isin(self.ids, r_ids) if self.self_join else np.zeros(len(self.ids), bool)
        found = []
        for i in range(0, len(self.ids), _QUERY_STEP):
            rough = self._product(kind, self.shifted[kind][i : i + _QUERY_STEP], sides)  # squared distances less the query's own square
            q_ids, own = self.ids[i : i + _QUERY_STEP], self.own[i : i + _QUERY_STEP]
            for j in np.flatnonzero(itself[i : i + _QUERY_STEP]):
                rough[j, r_ids == q_ids[j]] = np.inf
            limit = (self.limit[i : i + _QUERY_STEP] * (1 + _SLACK) + _SLACK) ** 2 - own
            open_rows = np.flatnonzero(np.isinf(limit))
            if len(open_rows) and rough.shape[1] > self.k:
                limit[open_rows] = np.partition(rough[open_rows], self.k - 1, axis=1)[:, self.k - 1] + most
            bound = (limit + 4 * unit * (np.abs(limit) + own)).astype(kind)[:, None]
            near = rough <= bound
            if itself[i : i + _QUERY_STEP].any() or np.isinf(bound).any():
                near &= rough < np.inf
            at = np.flatnonzero(near)
            if len(at):
                found.append((at // rough.shape[1] + i, at % rough.shape[1]))
        if not found:
            return
        q, r = (np.concatenate(x) for x in zip(*found, strict=True))
        distance = self._exact(q, r, rv)
        near = distance <= self.limit[q]
        if near.any():
            self._keep(q[near], r_ids[r[near]], distance[near])

    def _product(self, kind: type, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``a @ b`` into memory that is used again: fresh pages cost more than the product."""
        need = len(a) * b.shape[1]
        if kind not in self.room or self.room[kind].size < need:
            self.room[kind] = np.empty(need, kind)
        return np.matmul(a, b, out=self.room[kind][:need].reshape(len(a), b.shape[1]))

    def _exact(self, q: np.ndarray, r: np.ndarray, rv: np.ndarray) -> np.ndarray:
        step = max(1, BLOCK_BYTES // (8 * rv.shape[1]))
        parts = [np.sqrt(((self.vectors[q[i : i + step]] - rv[r[i : i + step]]) ** 2).sum(1)) for i in range(0, len(q), step)]
        return np.concatenate(parts)

    def _keep(self, q: np.ndarray, neighbour: np.ndarray, distance: np.ndarray) -> None:
        if self.best is not None:
            q, neighbour, distance = (np.concatenate(x) for x in zip(self.best, (q, neighbour, distance), strict=True))
        named = pd.factorize(neighbour, sort=True)[0] if neighbour.dtype == object else neighbour
        order = np.lexsort((named, distance, q))
        q = q[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff([*starts, len(q)]))
        kept = order[place < self.k]
        last = np.flatnonzero(place == self.k - 1)
        self.limit[q[last]] = distance[order[last]]
        self.best = (q[place < self.k], neighbour[kept], distance[kept])


def _list(column: pa.ListArray, row: int) -> np.ndarray:
    """The values of one list of a column."""
    values = column.slice(row, 1).flatten()
    return np.array(values.to_pylist(), object) if values.null_count else values.to_numpy(zero_copy_only=False)


def _met(k: int, self_join: bool, id_type: pa.DataType):
    """From pairs of a query block and a reference block, those of a query block one after another, the nearest of each query."""

    def out(nearest: _Nearest) -> Iterator[pa.RecordBatch]:
        if nearest.best is not None:
            q, neighbour, distance = nearest.best
            columns = [pa.array(nearest.ids[q], id_type), pa.array(neighbour, id_type), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "neighbour", "distance"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nearest = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                block, dim = batch.column("q_block")[row].as_py(), len(_list(batch.column("q_centre"), row))
                if block != now:
                    if nearest is not None:
                        yield from out(nearest)
                    now, ids = block, _list(batch.column("q_ids"), row)
                    nearest = _Nearest(ids, _vectors(batch.column("q_vectors")[row].as_buffer(), len(ids), dim), k, self_join)
                ids = _list(batch.column("r_ids"), row)
                nearest.meet(ids, _vectors(batch.column("r_vectors")[row].as_buffer(), len(ids), dim))
        if nearest is not None:
            yield from out(nearest)

    return meet


def knn_join(
    queries: DataFrame, refs: DataFrame, key: str, vector: str, k: int, self_join: bool = False,
    leaf_rows: int = LEAF_ROWS, query_block: int = QUERY_BLOCK, reference_block: int = REFERENCE_BLOCK,
) -> DataFrame:
    """(id, neighbour, distance, place): the exact ``k`` nearest reference rows of every query.

    Equal distances are ordered by the neighbour's id.  ``self_join`` leaves out the row
    itself when both sides are one table.
    """
    id_type = queries.schema[key].dataType
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("neighbour", id_type), T.StructField("distance", T.DoubleType())]
    )
    tree = choose_tree(refs, key, vector, leaf_rows)
    if tree is None:
        return queries.sparkSession.createDataFrame([], schema).withColumn("place", F.lit(1))
    q = stage(_to_cells(queries, key, vector, tree), "knn-queries")
    r = q if self_join else stage(_to_cells(refs, key, vector, tree), "knn-references")
    reach = _reach(q, r, tree, k + 1 if self_join else k)
    q_blocks = _blocks(q, tree, reach, query_block, None, "knn-query-blocks")
    r_blocks = _blocks(r, tree, {}, reference_block, k + 1, "knn-reference-blocks")
    rows = r.count()
    left = q_blocks.select(F.monotonically_increasing_id().alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in q_blocks.columns])
    # Each task goes over few partitions of references, which Spark holds one at a time: they are neither copied nor shuffled.
    right = r_blocks.select(*[F.col(c).alias(f"r_{c}") for c in r_blocks.columns]).coalesce(max(1, -(-rows * tree.pivots.shape[1] * 8 // HELD_BYTES)))
    squares = F.aggregate(F.zip_with("q_centre", "r_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    within = F.sqrt(squares) <= (F.col("q_near") + F.col("q_away") + F.col("r_away")) * (1 + _SLACK) + _SLACK
    pairs = left.join(right.hint("shuffle_replicate_nl"), within).select("q_block", "q_ids", "q_vectors", "q_centre", "r_ids", "r_vectors")
    met = pairs.mapInArrow(_met(k, self_join, to_arrow_type(id_type)), schema)
    near = stage(met, "knn-near", {BATCH_CONF: "1"})  # a row has two blocks
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mean_neighbour_distance(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("id").agg(F.avg("distance").alias("mean_distance"))


def applicability_domain(
    train: DataFrame, test: DataFrame, key: str, vector: str, y: str, p: str, half_width: float,
    k: int = 5, prob: float = 0.95, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Share of test rows as close to the training data as training rows are to each other,
    with error and interval coverage inside and outside.  One row per side, plus the threshold."""
    inner = mean_neighbour_distance(knn_join(train, train, key, vector, k, True, leaf_rows))
    threshold = exact_quantiles(inner, ["mean_distance"], [prob]).first()[0]
    outer = mean_neighbour_distance(knn_join(test, train, key, vector, k, False, leaf_rows))
    scored = test.select(F.col(key).alias("id"), y, p).join(outer, "id")
    err = abs_error(y, p)
    return (
        scored.groupBy((F.col("mean_distance") <= F.lit(threshold)).alias("inside"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"),
            F.avg((err <= F.lit(half_width)).cast("double")).alias("coverage"),
        )
        .withColumn("threshold", F.lit(threshold))
    )
