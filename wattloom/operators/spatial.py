"""Spatial joins and clustering on planar degrees, without comparing all pairs of points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import METRES_PER_DEGREE
from ..session import checkpointed
from .scans import positions

# --- boxes --------------------------------------------------------------------------------------

_SPLIT = 4


def _box(*extra: Column) -> list[Column]:
    return [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), *extra]


def _gap(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Smallest distance between two intervals."""
    return F.greatest(F.col(a0) - F.col(b1), F.col(b0) - F.col(a1), F.lit(0.0))


def _reach(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Largest distance between two intervals."""
    return F.greatest(F.col(a1) - F.col(b0), F.col(b1) - F.col(a0))


def _squares(fn, left: str = "a", right: str = "b") -> Column:
    dx = fn(f"{left}x0", f"{left}x1", f"{right}x0", f"{right}x1")
    dy = fn(f"{left}y0", f"{left}y1", f"{right}y0", f"{right}y1")
    return dx * dx + dy * dy


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


# --- neighbourhood graph ------------------------------------------------------------------------


def cell_side(eps: float) -> float:
    # Any two points of a cell are within eps; the factor keeps rounding on the safe side.
    return eps / 2**0.5 * (1 - 1e-9)


def _grid(side: float) -> tuple[Column, Column]:
    return F.floor(F.col("x") / F.lit(side)).alias("gx"), F.floor(F.col("y") / F.lit(side)).alias("gy")


def cell_id(x: Column, y: Column) -> Column:
    return x * F.lit(2**32) + y


def with_cell(points: DataFrame, eps: float) -> DataFrame:
    """Add `cell`: points in one cell are all within eps of each other."""
    gx, gy = _grid(cell_side(eps))
    return points.withColumn("cell", cell_id(gx, gy))


def eps_neighbours(points: DataFrame, eps: float) -> DataFrame:
    """(cell_a, cell_b): pairs of cells that hold points within eps of each other.

    Cells are compared by the tight boxes of their points. A pair of boxes is settled when even its
    farthest corners are within eps, or its nearest are not. Pairs in between are split into four by
    four boxes and looked at again; boxes of a single point always settle. No task sees all points of a
    cell, and no pair of points is ever listed.
    """
    side = cell_side(eps)
    gx, gy = _grid(side)
    distinct = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", "y").distinct()
    placed = checkpointed(distinct.select("x", "y", gx, gy))
    boxes = placed.groupBy("gx", "gy").agg(*_box())
    offsets = [(dx, dy) for dx in range(0, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))
    left = _prefixed(boxes, "a").withColumn("o", around)
    left = left.withColumns({"bgx": F.col("agx") + F.col("o.dx"), "bgy": F.col("agy") + F.col("o.dy")}).drop("o")
    pairs = left.join(_prefixed(boxes, "b"), ["bgx", "bgy"]).withColumns(
        {"cell_a": cell_id(F.col("agx"), F.col("agy")), "cell_b": cell_id(F.col("bgx"), F.col("bgy"))}
    )
    limit = F.lit(eps * eps)
    edges: list[DataFrame] = []
    while True:
        near = pairs.where(_squares(_gap) <= limit).withColumn("_sure", _squares(_reach) <= limit)
        near = checkpointed(near.select("cell_a", "cell_b", "agx", "agy", "bgx", "bgy", "_sure"))
        sure = near.where("_sure").select("cell_a", "cell_b").distinct()
        edges.append(sure)
        open_pairs = near.where(~F.col("_sure")).join(sure, ["cell_a", "cell_b"], "left_anti")
        if open_pairs.isEmpty():
            break
        # Powers of two nest exactly, so a box lies in one parent.
        side /= _SPLIT
        fx, fy = _grid(side)
        wanted = (
            open_pairs.select(F.col("agx").alias("px"), F.col("agy").alias("py"))
            .union(open_pairs.select("bgx", "bgy"))
            .distinct()
        )
        finer = (
            placed.withColumns({"px": F.col("gx"), "py": F.col("gy")})
            .join(wanted, ["px", "py"], "left_semi")
            .select("x", "y", "px", "py", fx, fy)
        )
        placed = finer.select("x", "y", "gx", "gy")
        boxes = checkpointed(finer.groupBy("px", "py", "gx", "gy").agg(*_box()))
        a, b = _prefixed(boxes, "a"), _prefixed(boxes, "b")
        parents = open_pairs.select(
            "cell_a", "cell_b", F.col("agx").alias("apx"), F.col("agy").alias("apy"),
            F.col("bgx").alias("bpx"), F.col("bgy").alias("bpy"),
        )
        pairs = parents.join(a, ["apx", "apy"]).join(b, ["bpx", "bpy"])
    return reduce(DataFrame.unionByName, edges).distinct()


# --- connected components -----------------------------------------------------------------------


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): smallest node id of each connected component.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Minima are partially aggregated,
    the edge set does not grow, and each round is checkpointed so that a lost executor costs one round.
    """
    current = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    mark = None
    while not current.isEmpty():
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        # large-star: every larger neighbour hangs on the smallest of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small-star: every smaller neighbour, and the node itself, hangs on the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = hung.union(low.select("a", "m")).where("a <> b").distinct()
        current = checkpointed(small)
        # The same edge set twice means every tree is a star.
        new = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cluster_points(points: DataFrame, tolerance: float = 5000.0) -> DataFrame:
    """Points with `component`: two points share it if steps of at most `tolerance` metres link them."""
    eps = tolerance / METRES_PER_DEGREE
    placed = with_cell(points, eps)
    edges = eps_neighbours(points, eps).select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b"))
    nodes = placed.where(F.col("cell").isNotNull()).select(F.col("cell").alias("node")).distinct()
    labels = components(nodes, edges).withColumnRenamed("node", "cell")
    return placed.join(labels, "cell").drop("cell")


def cluster_buses(points: DataFrame, tolerance: float = 5000.0, order: str = "row_id") -> DataFrame:
    """One bus per cluster: mean position, highest voltage, first substation name, number of points.

    `points` has x, y, voltage, name (null unless a substation) and a unique row id; buses are numbered
    by their first point.
    """
    named = F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.col(order))
    clusters = (
        cluster_points(points, tolerance)
        .groupBy("component")
        .agg(
            F.avg("x").alias("x"),
            F.avg("y").alias("y"),
            F.max("voltage").alias("v_nom"),
            F.min_by("name", named).alias("_name"),
            F.count(F.lit(1)).alias("cluster_size"),
            F.min(order).alias("_first"),
        )
    )
    numbered = positions(clusters, ["_first"], F.floor(F.col("_first") / 65536), "bus_id")
    name = F.coalesce("_name", F.concat(F.lit("bus_"), F.col("bus_id").cast("string")))
    return numbered.select("bus_id", name.alias("name"), "x", "y", "v_nom", "cluster_size")


# --- nearest site -------------------------------------------------------------------------------

_FAN = 8
_LEAF_SITES = 32
_MAX_LEVELS = 10


def nearest(points: DataFrame, sites: DataFrame, key: str = "bus_id") -> DataFrame:
    """(x, y, key): for each distinct point the nearest site by planar distance, smallest key on ties.

    Sites form a pyramid of boxes, eight by eight per level. A point keeps the boxes that can still hold
    its nearest site and opens those only, so it meets a handful of sites however they are spread. The
    top level is at most 64 boxes and travels as one array; lower levels are equi joins on the box.
    """
    known = sites.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    # Read once per level and by the small checks below, so it is written out first.
    unique = checkpointed(known.groupBy("x", "y").agg(F.min(key).alias(key)))
    frame = unique.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    spots = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", "y").distinct()
    if frame[0] is None:
        return spots.withColumn(key, F.lit(None).cast(sites.schema[key].dataType))
    x0, y0 = frame[0], frame[2]
    extent = max(frame[1] - x0, frame[3] - y0, 1e-9) * (1 + 1e-9)

    def box_key(level: int) -> Column:
        n = _FAN**level
        gx, gy = (F.floor((F.col(c) - F.lit(o)) / F.lit(extent) * n) for c, o in (("x", x0), ("y", y0)))
        return gx * F.lit(n) + gy

    levels = 1
    keyed = unique.withColumn("k1", box_key(1))
    while levels < _MAX_LEVELS:
        crowd = keyed.groupBy(f"k{levels}").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if crowd <= _LEAF_SITES:
            break
        levels += 1
        keyed = keyed.withColumn(f"k{levels}", box_key(levels))

    def corner(box: Column) -> tuple[Column, Column]:
        """Squared distance of the point to the nearest and to the farthest point of a box."""
        far = [F.greatest(F.abs(F.col(c) - box[f"{c}0"]), F.abs(F.col(c) - box[f"{c}1"])) for c in "xy"]
        near = [F.greatest(box[f"{c}0"] - F.col(c), F.col(c) - box[f"{c}1"], F.lit(0.0)) for c in "xy"]
        return near[0] * near[0] + near[1] * near[1], far[0] * far[0] + far[1] * far[1]

    top = keyed.groupBy("k1").agg(*_box()).agg(F.collect_list(F.struct("k1", "x0", "x1", "y0", "y1"))).scalar()
    front = (
        spots.withColumn("_boxes", top)
        .withColumn("_bound", F.array_min(F.transform("_boxes", lambda b: corner(b)[1])))
        .withColumn("_b", F.explode(F.filter("_boxes", lambda b: corner(b)[0] <= F.col("_bound"))))
        .select("x", "y", F.col("_b.k1").alias("k1"))
    )
    mine = W.partitionBy("x", "y")
    for level in range(2, levels + 1):
        boxes = keyed.groupBy(f"k{level - 1}", f"k{level}").agg(*_box())
        boxes = boxes.select(f"k{level - 1}", f"k{level}", F.struct("x0", "x1", "y0", "y1").alias("_b"))
        near, far = corner(F.col("_b"))
        front = (
            front.join(boxes, f"k{level - 1}")
            .withColumns({"_near": near, "_far": far})
            .withColumn("_bound", F.min("_far").over(mine))
            .where(F.col("_near") <= F.col("_bound"))
            .select("x", "y", f"k{level}")
        )
    leaf = f"k{levels}"
    ends = keyed.select(leaf, F.col("x").alias("_sx"), F.col("y").alias("_sy"), key)
    d2 = F.pow(F.col("x") - F.col("_sx"), 2) + F.pow(F.col("y") - F.col("_sy"), 2)
    return (
        front.join(ends, leaf)
        .groupBy("x", "y")
        .agg(F.min_by(key, F.struct(d2.alias("d"), F.col(key).alias("k"))).alias(key))
    )


def connect_lines(lines: DataFrame, buses: DataFrame, key: str = "bus_id") -> DataFrame:
    """Add `bus0` and `bus1`: the nearest bus to the first and last point (`start`, `end` structs).

    Distinct end points are looked up once, for both ends together.
    """
    ends = lines.select(F.explode(F.array("start", "end")).alias("p")).select("p.x", "p.y")
    found = nearest(ends, buses, key)
    out = lines
    for end, column in (("start", "bus0"), ("end", "bus1")):
        at = found.select(F.col("x").alias("_nx"), F.col("y").alias("_ny"), F.col(key).alias(column))
        hit = (F.col(f"{end}.x") == F.col("_nx")) & (F.col(f"{end}.y") == F.col("_ny"))
        out = out.drop(column).join(at, hit, "left").drop("_nx", "_ny")
    return out
