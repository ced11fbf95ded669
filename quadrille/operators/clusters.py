"""Clusters of linked or nearby points; all geometry runs as grid equi-joins.

``points(id, x, y)`` and ``edges(src, dst)``.  Coincident or dense points are
first reduced to cells, so no cell ever emits all of its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille.operators.taxonomy import components
from quadrille.session import cut, global_index


def link_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster) of components with at least two displayed nodes."""
    ids = nodes.select("id")
    shown = (edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
             .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return _groups(shown)


def _groups(links: DataFrame) -> DataFrame:
    parts = cut(components(links).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster"))
    sizes = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return parts.join(sizes, "cluster", "left_semi").select("id", "cluster")


def _cell(c: Column, size: Column | float) -> Column:
    return F.floor(c / size)


def _around(reach: int = 1) -> Column:
    steps = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    return F.explode(F.flatten(F.transform(steps, lambda dx: F.transform(steps, lambda dy: F.struct(dx.alias("dx"), dy.alias("dy"))))))


def core_distances(points: DataFrame, k: int = 3) -> DataFrame:
    """(id, nearest, core): distance to the 1st and the k-th neighbour, exact.

    Places (distinct coordinates) are searched on a fine grid; a place is
    settled once its k-th distance fits inside the searched ring.  The rest
    retry on a grid twice as coarse, so only points in sparse areas ever meet
    large cells.
    """
    places = cut(points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    box = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1)), F.sum("n")).first()
    total = box[5] or 0
    if total < 2:
        return points.limit(0).select("id", F.lit(0.0).alias("nearest"), F.lit(0.0).alias("core"))
    k = min(k, total - 1)
    extent = max(box[1] - box[0], box[3] - box[2], 1e-300)
    size = extent / max(1.0, box[4] ** 0.5)
    while True:   # start where the fullest cell is small
        full = places.groupBy(_cell(F.col("x"), size), _cell(F.col("y"), size)).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
        if full <= 64 or size < extent * 2.0 ** -40:
            break
        size /= 2
    todo, done = places, None
    while True:
        own = todo.select("x", "y", "n", _cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy"))
        asked = own.select("x", "y", "n", "cx", "cy", _around().alias("d")).select(
            "x", "y", "n", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
        other = places.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"),
                              _cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy"))
        gap = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
        pairs = asked.join(other, ["cx", "cy"]).select("x", "y", gap.alias("d"), F.when(
            (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")), F.col("n2") - 1).otherwise(F.col("n2")).alias("n2"))
        # same distance counts together; only the k nearest distances matter
        near = pairs.filter("n2 > 0").groupBy("x", "y", "d").agg(F.sum("n2").alias("n2"))
        w = W.partitionBy("x", "y").orderBy("d")
        near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
        near = near.withColumn("before", F.sum("n2").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        best = near.groupBy("x", "y").agg(F.min("d").alias("nearest"), F.min(F.when(F.col("before") >= k, F.col("d"))).alias("core"))
        settled = cut(best.filter(F.col("core").isNotNull() & (F.col("core") <= F.lit(size))))
        done = settled if done is None else done.unionByName(settled)
        todo = cut(todo.join(settled, ["x", "y"], "left_anti"))
        if todo.isEmpty():
            break
        size *= 2
    return points.join(done, ["x", "y"]).select("id", "nearest", "core")


def distance_unit(cores: DataFrame) -> Column:
    """Median of the nearest distances as a scalar subquery; exact, by global
    position instead of gathering all values."""
    rows = cut(global_index(cores.select("nearest", "id"), [F.col("nearest"), F.col("id")], "i"))
    n = rows.count()
    return rows.filter(F.col("i").isin((n - 1) // 2, n // 2)).agg(F.avg("nearest")).scalar()


def _boxes(points: DataFrame, size: float) -> DataFrame:
    return points.groupBy("top", _cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy")).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def near_links(points: DataFrame, radius: float) -> DataFrame:
    """Links (src, dst) that connect exactly the points within ``radius``
    transitively, without listing the pairs.

    Cells have diagonal <= radius, so a cell is one clump (a star to its
    smallest id).  Neighbouring clumps are compared by bounding boxes: close
    enough, too far, or split both into four and look again.
    """
    if radius <= 0:   # only coincident points
        low = points.groupBy("x", "y").agg(F.min("id").alias("dst"))
        return points.join(low, ["x", "y"]).select(F.col("id").alias("src"), "dst")
    size = radius / 2 ** 0.5
    cells = points.withColumn("cx", _cell(F.col("x"), size)).withColumn("cy", _cell(F.col("y"), size))
    tops = cells.groupBy("cx", "cy").agg(F.min("id").alias("top"))
    rows = cut(cells.join(tops, ["cx", "cy"]).select("id", "x", "y", "top", "cx", "cy"))
    links = rows.select(F.col("id").alias("src"), F.col("top").alias("dst"))
    tops = rows.select("cx", "cy", "top").distinct()
    side = tops.select("top", "cx", "cy", _around(2).alias("d")).select(
        F.col("top").alias("a"), (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
    open_pairs = side.join(tops.withColumnRenamed("top", "b"), ["cx", "cy"]).filter("a < b").select("a", "b")
    level = rows.select("top", "x", "y")
    boxes = cut(_boxes(level, size))
    keys = ["x0", "x1", "y0", "y1", "cx", "cy"]

    def named(df: DataFrame, who: str) -> DataFrame:
        return df.select(F.col("top").alias(who), *[F.col(c).alias(f"{who}_{c}") for c in keys])

    pairs = cut(open_pairs.join(named(boxes, "a"), "a").join(named(boxes, "b"), "b"))
    found = []
    while True:
        gap_x = F.greatest(F.lit(0.0), F.col("a_x0") - F.col("b_x1"), F.col("b_x0") - F.col("a_x1"))
        gap_y = F.greatest(F.lit(0.0), F.col("a_y0") - F.col("b_y1"), F.col("b_y0") - F.col("a_y1"))
        far_x = F.greatest(F.col("a_x1") - F.col("b_x0"), F.col("b_x1") - F.col("a_x0"))
        far_y = F.greatest(F.col("a_y1") - F.col("b_y0"), F.col("b_y1") - F.col("a_y0"))
        judged = cut(pairs.withColumn("low", F.hypot(gap_x, gap_y)).withColumn("high", F.hypot(far_x, far_y))
                     .filter(F.col("low") <= radius))
        close = cut(judged.filter(F.col("high") <= radius).select("a", "b").distinct())
        found.append(close)
        left = cut(judged.join(close, ["a", "b"], "left_anti"))
        if left.isEmpty():
            break
        size /= 2
        busy = left.select(F.explode(F.array("a", "b")).alias("top")).distinct()
        fine = cut(_boxes(level.join(busy, "top", "left_semi"), size))
        up = fine.withColumn("px", F.floor(F.col("cx") / 2)).withColumn("py", F.floor(F.col("cy") / 2))
        kids = up.select("top", "px", "py", *keys)

        def child(who: str) -> DataFrame:
            return kids.select(F.col("top").alias(who), F.col("px").alias(f"{who}_px"), F.col("py").alias(f"{who}_py"),
                               *[F.col(c).alias(f"{who}_{c}") for c in keys])

        parents = left.select("a", "b", F.col("a_cx").alias("a_px"), F.col("a_cy").alias("a_py"),
                              F.col("b_cx").alias("b_px"), F.col("b_cy").alias("b_py"))
        pairs = (parents.join(child("a"), ["a", "a_px", "a_py"]).join(child("b"), ["b", "b_px", "b_py"])
                 .drop("a_px", "a_py", "b_px", "b_py"))
    for part in found:
        links = links.unionByName(part.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return links


def density_clusters(points: DataFrame, looseness: float = 1.0, cores: DataFrame | None = None) -> DataFrame:
    """(id, cluster): points whose core fits the radius, joined within it.
    The radius is three distance units times ``looseness``."""
    cores = cut(cores if cores is not None else core_distances(points))
    radius = _radius(cores) * looseness
    dense = points.join(cores.filter(F.col("core") <= radius), "id", "left_semi")
    return _groups(near_links(dense, radius).filter("src <> dst"))


def _radius(cores: DataFrame) -> float:
    unit = cores.limit(1).select(distance_unit(cores)).first()
    return 3 * unit[0] if unit else 0.0


def mixed_links(points: DataFrame, edges: DataFrame, looseness: float, cores: DataFrame) -> DataFrame:
    """Edges kept by mutual reachability: both cores (scaled) and the edge
    length stay under the geometric mean of the longest edge and the radius."""
    full = _radius(cores)
    known = points.join(cores, "id")
    ends = (edges.select("src", "dst")
            .join(known.select(F.col("id").alias("src"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("core").alias("ca")), "src")
            .join(known.select(F.col("id").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("core").alias("cb")), "dst"))
    ends = cut(ends.withColumn("len", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))))
    longest = ends.agg(F.max("len")).scalar()
    mean = F.exp((1 - looseness) * F.log(longest) + looseness * F.log(F.lit(full)))
    limit = F.when((longest == 0) | F.lit(full == 0), 0.0).when(longest == full, longest).otherwise(mean)
    reachability = F.greatest("len", F.col("ca") * looseness, F.col("cb") * looseness)
    return ends.filter(reachability <= limit).select("src", "dst")


def mixed_clusters(points: DataFrame, edges: DataFrame, looseness: float) -> DataFrame:
    """Clusters between strict (links only, 0) and loose (density only, 1)."""
    if looseness == 0:
        return link_clusters(points, edges)
    cores = cut(core_distances(points))
    radius = _radius(cores) * looseness
    dense = points.join(cores.filter(F.col("core") <= radius), "id", "left_semi")
    links = near_links(dense, radius).filter("src <> dst")
    if looseness < 1:
        links = links.unionByName(mixed_links(points, edges, looseness, cores))
    return _groups(links)


def carry_cluster_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(cluster, position): a cluster keeps the position most of its nodes had.

    ``old(id, position)``, ``new(id, cluster)``.  Largest shares choose first:
    every round takes the shares that are best for both their sides, which
    gives the same result as going down the sorted list.  The others fill the
    lowest free positions, largest cluster first.
    """
    sizes = cut(new.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))
    shares = new.join(old, "id").groupBy("cluster", "position").agg(F.count(F.lit(1)).alias("n")).join(sizes, "cluster")
    order = F.struct((-F.col("n")).alias("n"), (-F.col("size")).alias("size"), F.col("position").alias("position"), F.col("cluster").alias("cluster"))
    shares = cut(shares.select("cluster", "position", order.alias("key")))
    kept = shares.limit(0).select("cluster", "position")
    while not shares.isEmpty():
        best_c = shares.groupBy("cluster").agg(F.min("key").alias("key"))
        best_p = shares.groupBy("position").agg(F.min("key").alias("key"))
        won = cut(best_c.join(best_p, "key").select("cluster", "position"))
        kept = kept.unionByName(won)
        shares = cut(shares.join(won.select("cluster"), "cluster", "left_anti").join(won.select("position"), "position", "left_anti"))
    kept = cut(kept)
    waiting = sizes.join(kept, "cluster", "left_anti").join(
        new.groupBy("cluster").agg(F.min("id").alias("first")), "cluster")
    rank = global_index(waiting, [F.desc("size"), F.col("first"), F.col("cluster")], "i")
    used = global_index(kept.select("position"), [F.col("position")], "j")
    # used position u with j used below it stands before the free number u - j
    both = used.select((F.col("position") - F.col("j")).cast("long").alias("key"), F.lit(0).alias("is_new"), F.lit(None).cast(new.schema["cluster"].dataType).alias("cluster")).unionAll(
        rank.select(F.col("i").cast("long").alias("key"), F.lit(1).alias("is_new"), "cluster"))
    fill = global_index(both, [F.col("key"), F.col("is_new"), F.col("cluster")], "position").filter("is_new = 1")
    return kept.select("cluster", F.col("position").cast("long").alias("position")).unionByName(
        fill.select("cluster", F.col("position").cast("long").alias("position")))
