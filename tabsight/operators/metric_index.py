"""Exact neighbour joins in any number of dimensions by a tree of balls.

Points are a frame ``(row_id, features array<double>)``; distances are Euclidean.

1. Equal points become one point with a weight; its smallest ``row_id`` names it.
2. *Tree.* A cell of more than ``CELL`` points is split: some of its points, drawn by a hash of their names, become
   pivots, and every point goes to its nearest pivot. Each level is one join by cell and one pass. A cell keeps its pivot and
   the largest distance to it, so by the triangle inequality two cells can only hold points within r of each
   other if their pivots are within r of the sum of their radii.
3. *Join.* From every leaf a descent through the tree, a join by parent a level, finds the leaves that it must visit.
   Leaves are packed blocks of at most ``CELL`` points. They are dealt to bands by a hash; a task takes the pairs of one band with
   another, holds the first and lets the leaves of the second pass, after points whose own distance to the
   other pivot rules them out. So a leaf is copied once a band, not once a pair, and what leaves a task is bounded by its points, not by
   its pairs: weighted counts, the edges of a spanning forest, the smallest cluster, or the k least distances.

Points may come with a ``cell`` of their own, which makes a forest of trees that grow in the same passes; ``nearest`` takes
queries that name the tree they ask.

No result depends on the partitioning. The work follows the number of leaves that balls cannot tell apart: in data without
structure in many dimensions that is most of them; ``Join.compared`` counts it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ensure_checkpoint_dir, ship

CELL = 256
FAN = 64       # pivots that a split aims at, at most
SLACK = 1e-9   # share by which bounds are widened over rounding
BAND = 32_768  # points that a task holds of one band
BANDS = 8      # bands at least, if there are leaves enough: a task for each two
ROWS = 4_096   # points of a band that are compared with a leaf at once


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed over the coordinates in their order (the same for a pair in either order)."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``squared`` of row i of a and row i of b, summed in the same order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += (a[:, j] - b[:, j]) ** 2
    return out


def _estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``squared`` by a matrix product, and how far a row of it may be off (a column); NaN, which nothing is off from, where numbers
    are too large."""
    with np.errstate(over="ignore", invalid="ignore"):
        one, two = (a ** 2).sum(1), (b ** 2).sum(1)
        out = a @ b.T
        out *= -2
        out += one[:, None]
        out += two
        return out, 1e-15 * (a.shape[1] + 4) * (one[:, None] + two.max(initial=0.0)) + 1e-290


@dataclass
class Tree:
    """``rows``: row_id and the name of its point. ``leaves``: a packed block per leaf. ``nodes``: the balls."""

    rows: DataFrame     # row_id, name, root
    points: DataFrame   # cell, name, x, w
    leaves: DataFrame   # cell, names, x, w
    nodes: DataFrame    # cell, parent, centre, radius, weight (rows in it), leaf
    dims: int
    n_rows: int


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), float).reshape(-1, dims)


def _packed_points(points: DataFrame, dims: int) -> DataFrame:
    """``row_id`` and the coordinates as bytes (-0.0 is 0.0, so equal points have equal bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims) + 0.0
            yield pa.record_batch([b.column("row_id"), b.column("cell"), pa.array([r.tobytes() for r in x], pa.binary())], ["row_id", "cell", "x"])

    kind = points.schema["row_id"].dataType.simpleString()
    root = F.col("cell") if "cell" in points.columns else F.lit("0")
    return points.select("row_id", root.alias("cell"), "features").mapInArrow(run, f"row_id {kind}, cell string, x binary")


def build(points: DataFrame, cell: int = CELL) -> Tree | None:
    """The tree over all points; None without rows. Rows whose point is null are not to be given."""
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    ship(spark)
    first = points.select("features").first()
    if first is None:
        return None
    dims = len(first["features"])
    kind = points.schema["row_id"].dataType.simpleString()
    packed = _packed_points(points, dims).checkpoint()
    named = packed.groupBy("cell", "x").agg(F.min("row_id").alias("name"), F.count(F.lit(1)).alias("w")).checkpoint()
    rows = packed.join(named.select("cell", "x", "name"), ["cell", "x"]).select("row_id", "name", F.col("cell").alias("root")).checkpoint()
    current = named.select("cell", "name", "x", "w", F.lit(0.0).alias("far"))
    nodes, level = [], 0
    while True:
        counts = current.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
        big = counts.where(F.col("m") > cell).checkpoint()
        if big.isEmpty():
            break
        # of a cell's points a hash draws twice as many as are wanted; a draw that gives fewer than two is repeated on the next level
        wanted = F.least(F.lit(FAN), F.greatest(F.lit(4), F.ceil(2 * F.col("m") / cell)))
        share = F.pmod(F.xxhash64("name", F.lit(level)), F.lit(1 << 40)) / float(1 << 40)
        pivots = (current.join(big, "cell").where(share < 2 * wanted / F.col("m"))
                  .groupBy("cell").agg(F.sort_array(F.collect_list("x")).alias("pivots")).where(F.size("pivots") > 1))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells, lists = b.column("cell").to_pylist(), b.column("pivots")
                x = _matrix(b.column("x").to_pylist(), dims)
                near, far = np.zeros(b.num_rows, np.int64), b.column("far").to_numpy().copy()
                moved = np.zeros(b.num_rows, bool)
                by_cell: dict[str, list[int]] = {}
                for i, c in enumerate(cells):
                    by_cell.setdefault(c, []).append(i)
                centre = [None] * b.num_rows
                for some in by_cell.values():
                    pivots = lists[some[0]].as_py()
                    if pivots is None:
                        continue
                    d = squared(x[some], _matrix(pivots, dims))
                    near[some], moved[some] = d.argmin(1), True
                    far[some] = np.sqrt(d.min(1))
                    for i, j in zip(some, near[some], strict=True):
                        centre[i] = pivots[j]
                new = [f"{c}.{j}" if m else c for c, j, m in zip(cells, near, moved, strict=True)]
                yield pa.record_batch([pa.array(new, pa.string()), b.column("name"), b.column("x"), b.column("w"), pa.array(far),
                                       pa.array(centre, pa.binary())], ["cell", "name", "x", "w", "far", "centre"])

        both = current.join(pivots, "cell", "left").select("cell", "name", "x", "w", "far", "pivots")
        moved = both.mapInArrow(assign, f"cell string, name {kind}, x binary, w long, far double, centre binary").checkpoint()
        nodes.append(moved.where("centre IS NOT NULL").groupBy("cell").agg(F.first("centre").alias("centre"), F.max("far").alias("radius"),
                                                                              F.sum("w").alias("weight")))
        current = moved.drop("centre")
        level += 1
    current = current.checkpoint()
    whole = current.where(F.instr("cell", ".") == 0).groupBy("cell").agg(  # trees of one leaf
        F.min("x").alias("centre"), F.lit(math.inf).alias("radius"), F.sum("w").alias("weight"))
    balls = whole
    for more in nodes:
        balls = balls.union(more)
    held = current.select("cell").distinct().withColumn("leaf", F.lit(True))
    parent = F.regexp_replace("cell", r"\.[0-9]+$", "")  # a root that is a leaf is its own parent
    balls = balls.join(held, "cell", "left").select("cell", parent.alias("parent"), "centre", "radius", "weight", F.coalesce("leaf", F.lit(False)).alias("leaf")).checkpoint()
    leaves = pack_leaves(current.select("cell", "name", "x", "w")).checkpoint()
    return Tree(rows, current, leaves, balls, dims, rows.count())


def pack_leaves(points: DataFrame, *extra: str) -> DataFrame:
    """One row per cell with its points (at most ``CELL``) as lists, in order of their bytes."""
    held = points.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("x", "name", "w", *extra))).alias("p"))
    return held.select("cell", F.col("p.name").alias("names"), F.col("p.x").alias("x"), F.col("p.w").alias("w"), *[F.col(f"p.{e}").alias(e) for e in extra])


def visits(tree: Tree, reach: DataFrame) -> DataFrame:
    """(``a``, ``b``) of leaves that may hold points within ``reach`` (``cell``, ``r``) of a point of leaf a."""
    dims = tree.dims

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = _matrix(b.column("ca").to_pylist(), dims), _matrix(b.column("cb").to_pylist(), dims)
            gap = np.sqrt(((one - two) ** 2).sum(1))
            bound = (b.column("ra").to_numpy() + b.column("rb").to_numpy() + b.column("r").to_numpy()) * (1 + SLACK)
            keep = pa.array(gap * (1 - SLACK) <= bound)
            yield b.select(["a", "b", "leaf"]).filter(keep)

    schema = "a string, b string, leaf boolean"
    own = tree.nodes.where("leaf").join(reach, "cell").select(
        F.col("cell").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"), "r")
    below = tree.nodes.select(F.col("parent").alias("up"), F.col("cell").alias("b"), F.col("centre").alias("cb"),
                              F.col("radius").alias("rb"), "leaf")
    frontier = own.select("a", F.substring_index("a", ".", 1).alias("up"))
    done = None
    while True:
        both = frontier.join(own, "a").join(below, "up")
        step = both.select("a", "ca", "ra", "r", "b", "cb", "rb", "leaf").mapInArrow(near, schema).checkpoint()
        ended = step.where("leaf").select("a", "b")
        done = ended if done is None else done.union(ended)
        frontier = step.where("NOT leaf").select("a", F.col("b").alias("up"))
        if frontier.isEmpty():
            return done


class _Band:
    """The leaves of one band that a task holds: their points one after the other."""

    def __init__(self, leaves: list[dict], dims: int) -> None:
        self.x = _matrix([x for leaf in leaves for x in leaf["x"]], dims)
        self.names = [n for leaf in leaves for n in leaf["names"]]
        self.cells = [leaf["cell"] for leaf in leaves for _ in leaf["names"]]
        self.extra = [e for leaf in leaves for e in leaf["extra"] or ()]
        ends = np.cumsum([len(leaf["names"]) for leaf in leaves])
        self.rows = {leaf["cell"]: np.arange(end - len(leaf["names"]), end) for leaf, end in zip(leaves, ends, strict=True)}

    def asking(self, cells: list[str]) -> Iterator[np.ndarray]:
        """Points of the leaves named, at most ``ROWS`` at a time."""
        held = [self.rows[c] for c in sorted(cells) if c in self.rows]
        rows = np.concatenate(held) if held else np.zeros(0, np.int64)
        for i in range(0, len(rows), ROWS):
            yield rows[i:i + ROWS]


def _dealt(tree: Tree, pairs: DataFrame, left: DataFrame, right: DataFrame, extra_a: str | None = None, extra_b: str | None = None) -> DataFrame:
    """Leaves by task (bands ``g`` and ``h``): once those of ``left``, then those of ``right`` with the cells that ask them."""
    size = tree.leaves.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("names")).alias("m")).first()
    bands = max(1, math.ceil((size["m"] or 0) / BAND), min(BANDS, math.ceil(size["n"] / BANDS)))
    dealt = pairs.select("a", "b", *[F.pmod(F.xxhash64(c), F.lit(bands)).cast("int").alias(g) for c, g in (("a", "g"), ("b", "h"))])
    more = "array<long>" if extra_b else "array<double>"

    def columns(extra, centre, radius, asks):
        return ["g", "h", "cell", "names", "x", "w", (F.col(extra) if extra else F.lit(None)).cast(more).alias("extra"),
                centre.alias("centre"), radius.alias("radius"), asks.alias("asks")]

    held = dealt.select("g", "h", F.col("a").alias("cell")).distinct().join(left, "cell").select(*columns(
        extra_a, F.lit(None).cast("binary"), F.lit(None).cast("double"), F.lit(None).cast("array<string>")))
    balls = tree.nodes.where("leaf").select("cell", "centre", "radius")
    passing = dealt.groupBy("g", "h", F.col("b").alias("cell")).agg(F.collect_list("a").alias("asks")).join(
        right, "cell").join(balls, "cell").select(*columns(extra_b, F.col("centre"), F.col("radius"), F.col("asks")))
    both = held.union(passing).repartitionById(bands * bands, F.col("g") * bands + F.col("h"))
    return both.sortWithinPartitions("g", "h", F.col("asks").isNotNull(), "cell")


def _compared(tree: Tree, pairs: DataFrame, left: DataFrame, right: DataFrame, job: Callable, schema: str,
              extra_a: str | None = None, extra_b: str | None = None) -> DataFrame:
    """``job`` of every two bands: given a ``_Band`` of ``left`` it returns a function that is called for each leaf of ``right``
    with the cells that ask it and the leaf, and one that gives the results at the end."""
    dims = tree.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaves, meet, finish = None, [], None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if (r["g"], r["h"]) != key:
                    if finish:
                        yield from finish()
                    key, leaves, meet, finish = (r["g"], r["h"]), [], None, None
                if r["asks"] is None:
                    leaves.append(r)
                    continue
                if not meet:
                    meet, finish = job(_Band(leaves, dims))
                    leaves = []
                r["x"], r["w"] = _matrix(r["x"], dims), np.array(r["w"], np.int64)
                meet(r["asks"], r)
        if finish:
            yield from finish()

    return _dealt(tree, pairs, left, right, extra_a, extra_b).mapInArrow(run, schema)


def _in_reach(xa: np.ndarray, r: dict, reach: float | np.ndarray, dims: int) -> np.ndarray:
    """Points whose distance to the leaf's pivot allows a neighbour within reach."""
    far = np.sqrt(squared(xa, _matrix([r["centre"]], dims))[:, 0])
    return np.flatnonzero(far * (1 - SLACK) <= (r["radius"] + reach) * (1 + SLACK))


def _linked(band: _Band, asks: list[str], r: dict, reach: float, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points of the band, and which of the leaf's points are within reach of each."""
    for rows in band.asking(asks):
        some = rows[_in_reach(band.x[rows], r, reach, dims)]
        if len(some):
            yield some, close(band.x[some], r["x"], reach)


def close(a: np.ndarray, b: np.ndarray, r: float) -> np.ndarray:
    """Whether points are within r. A product decides where rounding cannot matter, the distance itself elsewhere."""
    d, off = _estimates(a, b)
    if not np.isfinite(off).all():
        return np.sqrt(squared(a, b)) <= r
    found = d <= r * r
    i, j = np.nonzero(np.abs(d - r * r) <= off + 1e-12 * r * r)
    found[i, j] = np.sqrt(_paired(a[i], b[j])) <= r
    return found


@dataclass
class Join:
    """The pairs of leaves for one radius, found once."""

    tree: Tree
    pairs: DataFrame
    r: float

    @classmethod
    def within(cls, tree: Tree, r: float) -> Join:
        reach = tree.nodes.where("leaf").select("cell", F.lit(float(r)).alias("r"))
        return cls(tree, visits(tree, reach).checkpoint(), float(r))

    def compared(self) -> int:
        """Pairs of distinct points that the blocks compare, at most."""
        sizes = self.tree.leaves.select("cell", F.size("names").alias("m"))
        both = (self.pairs.join(sizes.withColumnsRenamed({"cell": "a", "m": "ma"}), "a").join(sizes.withColumnsRenamed({"cell": "b", "m": "mb"}), "b"))
        return int(both.agg(F.sum(F.col("ma") * F.col("mb"))).first()[0] or 0)

    def counts(self) -> DataFrame:
        """``name`` and the number ``n`` of rows within r of it, its own rows among them."""
        r0, dims = self.r, self.tree.dims
        kind, arrow = _named(self.tree)

        def job(band: _Band):
            n = np.zeros(len(band.x), np.int64)

            def meet(asks, r):
                for some, links in _linked(band, asks, r, r0, dims):
                    n[some] += links @ r["w"]

            def finish():
                some = np.flatnonzero(n)
                yield pa.record_batch([pa.array([band.names[k] for k in some], arrow), pa.array(n[some])], ["name", "n"])

            return meet, finish

        both = _compared(self.tree, self.pairs, self.tree.leaves, self.tree.leaves, job, f"name {kind}, n long")
        return both.groupBy("name").agg(F.sum("n").alias("n"))

    def spanning_edges(self, core: DataFrame) -> DataFrame:
        """Edges (``i``, ``j``) among the points named by ``core`` that join all those linked within r: of every two
        bands, a star per connected part of the one, and one edge from each point of the other."""
        r0, dims = self.r, self.tree.dims
        kind, arrow = _named(self.tree)
        held = pack_leaves(self.tree.points.join(core.select("name"), "name", "left_semi"))

        def job(band: _Band):
            part = np.arange(len(band.x))  # the part of each point, named by one of its points
            roots: list = []
            ends: list = []

            def meet(asks, r):
                nonlocal part
                anchor = np.full(len(r["x"]), -1)
                for some, links in _linked(band, asks, r, r0, dims):
                    to, at = np.nonzero(links.T)
                    if not len(to):
                        continue
                    at = some[at]
                    first, where = np.unique(to, return_index=True)
                    anchor[first] = np.where(anchor[first] < 0, at[where], anchor[first])
                    pairs = np.column_stack([part[anchor[to]], part[at]])
                    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
                    if len(pairs):
                        part = _merged(len(part), pairs)[part]
                for k in np.flatnonzero(anchor >= 0):
                    roots.append(band.names[anchor[k]])
                    ends.append(r["names"][k])

            def finish():
                for k in np.flatnonzero(part != np.arange(len(part))):
                    roots.append(band.names[part[k]])
                    ends.append(band.names[k])
                yield pa.record_batch([pa.array(roots, arrow), pa.array(ends, arrow)], ["i", "j"])

            return meet, finish

        both = _compared(self.tree, self.pairs.where("a <= b"), held, held, job, f"i {kind}, j {kind}")
        return both.where("i <> j").distinct()

    def least_label(self, labels: DataFrame) -> DataFrame:
        """``name`` and the smallest ``label`` (long) among points of ``labels`` (``name``, ``label``) within r, for points not among them."""
        r0, dims = self.r, self.tree.dims
        kind, arrow = _named(self.tree)
        marked = pack_leaves(self.tree.points.join(labels, "name"), "label")
        others = pack_leaves(self.tree.points.join(labels, "name", "left_anti"))
        none = np.iinfo(np.int64).max

        def job(band: _Band):
            least = np.full(len(band.x), none)

            def meet(asks, r):
                label = np.array(r["extra"], np.int64)[None, :]
                for some, links in _linked(band, asks, r, r0, dims):
                    least[some] = np.minimum(least[some], np.where(links, label, none).min(1))

            def finish():
                some = np.flatnonzero(least < none)
                yield pa.record_batch([pa.array([band.names[k] for k in some], arrow), pa.array(least[some])], ["name", "label"])

            return meet, finish

        both = _compared(self.tree, self.pairs, others, marked, job, f"name {kind}, label long", extra_b="label")
        return both.groupBy("name").agg(F.min("label").alias("label"))


def _named(tree: Tree) -> tuple[str, pa.DataType]:
    """The type of the names, for a schema and for Arrow."""
    kind = tree.points.schema["name"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _merged(n: int, pairs: np.ndarray) -> np.ndarray:
    """Each number's smallest among those that the pairs join it to."""
    parent = np.arange(n)

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in pairs.tolist():
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _kth(distances: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Per row the distance at which the weights, taken nearest first, reach k (infinite if they never do)."""
    order = np.argsort(distances, axis=1, kind="stable")
    ahead = np.cumsum(np.take_along_axis(np.broadcast_to(weights, distances.shape), order, 1), axis=1)
    enough = ahead >= k
    at = enough.argmax(1)
    rows = np.arange(len(distances))
    return np.where(enough[:, -1], distances[rows, order[rows, at]], np.inf)


def kth_distance(tree: Tree, k: int) -> DataFrame:
    """(``row_id``, ``kdist``): exact distance to the k-th nearest row, the row itself being the first (the farthest
    row, if there are fewer). Each point has a bound from its own leaf, or from a ball beside its leaf that holds k rows; only
    leaves within that bound are visited."""
    k, dims = min(k, tree.n_rows), tree.dims
    kind, arrow = _named(tree)
    # the balls of one split: as many as it drew pivots
    beside = tree.nodes.where(F.col("weight") >= k).groupBy("parent").agg(
        F.collect_list("centre").alias("centres"), F.collect_list("radius").alias("radii"))
    parents = tree.nodes.where("leaf").select("cell", "parent")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _matrix(batch.column("x")[i].as_py(), dims)
                found = _kth(np.sqrt(squared(x, x)), np.array(batch.column("w")[i].as_py(), np.int64), k)
                centres = batch.column("centres")[i].as_py()
                if centres:
                    far = np.sqrt(squared(x, _matrix(centres, dims))) + np.array(batch.column("radii")[i].as_py())
                    found = np.minimum(found, far.min(1) * (1 + SLACK))
                yield pa.record_batch([batch.column("cell").slice(i, 1), pa.array([found.tolist()], pa.list_(pa.float64()))], ["cell", "bound"])

    asked = tree.leaves.join(parents, "cell").join(beside, "parent", "left").select("cell", "x", "w", "centres", "radii")
    bound = asked.mapInArrow(bounds, "cell string, bound array<double>").checkpoint()
    reach = bound.select("cell", F.array_max("bound").alias("r"))
    pairs = visits(tree, reach)

    def job(band: _Band):
        limit = np.array(band.extra, float)
        best, weight = np.full((len(limit), k), np.inf), np.zeros((len(limit), k), np.int64)

        def meet(asks, r):
            for rows in band.asking(asks):
                some = rows[_in_reach(band.x[rows], r, limit[rows], dims)]
                d, off = _estimates(band.x[some], r["x"])
                able = ~(d > off + (limit[some] ** 2 * (1 + SLACK))[:, None])
                few = np.flatnonzero(able.any(1))
                if not len(few):
                    continue
                some, able = some[few], able[few]
                i, j = np.nonzero(able)
                d = np.full(able.shape, np.inf)
                d[i, j] = np.sqrt(_paired(band.x[some[i]], r["x"][j]))
                d = np.hstack([best[some], d])
                w = np.hstack([weight[some], np.broadcast_to(r["w"], able.shape)])
                part = np.argpartition(d, k - 1, axis=1)[:, :k]
                best[some], weight[some] = np.take_along_axis(d, part, 1), np.take_along_axis(w, part, 1)
                limit[some] = np.minimum(limit[some], _kth(best[some], weight[some], k))

        def finish():
            some = np.flatnonzero(np.isfinite(best).any(1))
            yield pa.record_batch([pa.array([band.cells[n] for n in some], pa.string()), pa.array([band.names[n] for n in some], arrow),
                                   pa.array([best[n].tobytes() for n in some], pa.binary()), pa.array([weight[n].tobytes() for n in some], pa.binary())],
                                  ["a", "name", "d", "w"])

        return meet, finish

    def merge(key, table):
        names = table.column("name").to_pylist()
        ds, ws = table.column("d").to_pylist(), table.column("w").to_pylist()
        held: dict = {}
        for name, d, w in zip(names, ds, ws, strict=True):
            held.setdefault(name, []).append((d, w))
        out = [float(_kth(np.frombuffer(b"".join(d for d, _ in parts), float)[None], np.frombuffer(b"".join(w for _, w in parts), np.int64), k)[0])
               for parts in held.values()]
        return pa.table({"name": pa.array(list(held), table.schema.field("name").type), "kdist": pa.array(out, pa.float64())})

    left = tree.leaves.join(bound, "cell")
    parts = _compared(tree, pairs, left, tree.leaves, job, f"a string, name {kind}, d binary, w binary", extra_a="bound")
    kd = parts.groupBy("a").applyInArrow(merge, f"name {kind}, kdist double")
    return tree.rows.join(kd, "name").select("row_id", "kdist")


def nearest(tree: Tree, queries: DataFrame, k: int, values: DataFrame) -> DataFrame:
    """The k nearest rows of each query in its tree, by distance and then id: ``qid``, ``root``, ``squared`` (distance), ``id``
    and ``vals``. ``queries``: qid, root, features. ``values``: row_id, root, vals (array<double>); of rows at one point only the k smallest ids are
    kept. More than k may come back: those of each leaf that was visited."""
    dims = tree.dims
    kind = tree.rows.schema["row_id"].dataType.simpleString()
    asked = queries.schema["qid"].dataType.simpleString()
    packed = _packed_points(queries.select(F.col("qid").alias("row_id"), F.col("root").alias("cell"), "features"), dims)
    below = tree.nodes.select(F.col("parent").alias("up"), F.col("cell").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"),
                              "weight", "leaf")

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.sqrt(((_matrix(b.column("x").to_pylist(), dims) - _matrix(b.column("cb").to_pylist(), dims)) ** 2).sum(1))
            radius = b.column("rb").to_numpy()
            upper = np.where(b.column("weight").to_numpy() >= k, (far + radius) * (1 + SLACK), np.inf)
            yield pa.record_batch([*(b.column(c) for c in ("qid", "root", "x", "bound", "b", "leaf")),
                                   pa.array(far * (1 - SLACK) - radius * (1 + SLACK)), pa.array(upper)],
                                  ["qid", "root", "x", "bound", "b", "leaf", "low", "upper"])

    frontier = packed.select(F.col("row_id").alias("qid"), F.col("cell").alias("root"), "x", F.lit(math.inf).alias("bound"), F.col("cell").alias("up"))
    done = None
    while True:
        step = frontier.join(below, "up").select("qid", "root", "x", "bound", "b", "leaf", "cb", "rb", "weight").mapInArrow(
            gaps, f"qid {asked}, root string, x binary, bound double, b string, leaf boolean, low double, upper double")
        tight = F.least("bound", F.min("upper").over(Window.partitionBy("qid", "root")))
        step = step.withColumn("bound", tight).where("low <= bound").checkpoint()
        ended = step.where("leaf").select("qid", "root", "x", "b")
        done = ended if done is None else done.union(ended)
        frontier = step.where("NOT leaf").select("qid", "root", "x", "bound", F.col("b").alias("up"))
        if frontier.isEmpty():
            break
    held = tree.rows.join(values, ["row_id", "root"]).withColumn("nth", F.row_number().over(Window.partitionBy("root", "name").orderBy("row_id")))
    held = held.where(F.col("nth") <= k).groupBy("root", "name").agg(F.collect_list(F.struct(F.col("row_id").alias("id"), "vals")).alias("entries"))
    entries = tree.points.withColumn("root", F.substring_index("cell", ".", 1)).join(held, ["root", "name"]).select("cell", "name", "x", "w", "entries")
    blocks = entries.groupBy(F.col("cell").alias("b")).agg(F.collect_list(F.struct("x", "entries")).alias("points"))
    crowd = done.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))
    packs = done.join(crowd, "b").groupBy("b", "root", F.pmod(F.xxhash64("qid"), F.col("parts")).alias("part")).agg(
        F.collect_list(F.struct("qid", "x")).alias("queries"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asks, points = batch.column("queries")[i].as_py(), batch.column("points")[i].as_py()
                flat = sorted(((e["id"], p, e["vals"]) for p, point in enumerate(points) for e in point["entries"]), key=lambda e: e[0])
                d = squared(_matrix([q["x"] for q in asks], dims), _matrix([p["x"] for p in points], dims))[:, [p for _, p, _ in flat]]
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                rows = [(q["qid"], d[n, j], flat[j][0], flat[j][2]) for n, q in enumerate(asks) for j in best[n]]
                ids, gaps_, names, vals = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(ids, batch.column("queries").type.value_type.field("qid").type), pa.array([batch.column("root")[i].as_py()] * len(rows)),
                                       pa.array(gaps_, pa.float64()), pa.array(names, batch.column("points").type.value_type.field("entries").type.value_type.field("id").type),
                                       pa.array(vals, pa.list_(pa.float64()))], ["qid", "root", "squared", "id", "vals"])

    return packs.join(blocks, "b").select("root", "queries", "points").mapInArrow(
        compare, f"qid {asked}, root string, squared double, id {kind}, vals array<double>")
