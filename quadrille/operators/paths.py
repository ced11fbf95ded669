"""Property paths and graph traversal over edge tables ``(src, dst)``.

Loops are semi-naive: each round joins only the newest pairs, removes those
already seen and is cut in the checkpoint folder.  They end on an empty
frontier, so cycles are harmless.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.operators import reachability
from quadrille.session import cut, shuffled


def edges_of(quads: DataFrame, p: str) -> DataFrame:
    """Resource-valued statements of one predicate as ``(src, dst)``."""
    return quads.filter((F.col("p") == p) & m.is_resource()).select(F.col("s").alias("src"), F.col("o").alias("dst"))


# -- path operators ---------------------------------------------------------

def seq(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a/b`` with bag semantics."""
    left = a.withColumnRenamed("dst", "_mid")
    right = b.withColumnRenamed("src", "_mid")
    return left.join(right, "_mid").select("src", "dst")


def alt(*parts: DataFrame) -> DataFrame:
    """``a|b`` with bag semantics."""
    return reduce(lambda x, y: x.unionByName(y), parts)


def inv(a: DataFrame) -> DataFrame:
    return a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def neg(quads: DataFrame, forward: list[str] | None = None, inverse: list[str] | None = None) -> DataFrame:
    """Negated property set ``!(a|^b)`` over all statements."""
    pair = quads.select("p", F.col("s").alias("src"), F.col("o").alias("dst"))
    parts = []
    if forward is not None:
        parts.append(pair.filter(~F.col("p").isin(forward)).select("src", "dst"))
    if inverse is not None:
        parts.append(inv(pair.filter(~F.col("p").isin(inverse)).select("src", "dst")))
    return alt(*parts)


def reach(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """All pairs ``(start, node, distance)`` with a path of length >= 1.

    ``seeds(start)`` limits the starting points; ``distance`` is the shortest.
    """
    step = cut(edges.select("src", "dst").distinct())
    first = step.withColumnRenamed("src", "start").withColumnRenamed("dst", "node")
    if seeds is not None:
        first = first.join(shuffled(seeds.select("start").distinct()), "start", "left_semi")
    frontier = cut(first.withColumn("distance", F.lit(1)))
    seen = frontier
    if frontier.isEmpty():
        return seen
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = (frontier.join(shuffled(step), F.col("node") == F.col("src"))
               .select("start", F.col("dst").alias("node")).distinct()
               .join(shuffled(seen), ["start", "node"], "left_anti")
               .withColumn("distance", F.lit(depth)))
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every ``node`` with a path of length >= 1 from some ``seeds(start)``;
    one frontier for all seeds, so the work is bounded by the edges."""
    step = cut(edges.select("src", "dst").distinct())
    frontier = cut(step.join(shuffled(seeds.select(F.col("start").alias("src")).distinct()), "src", "left_semi")
                   .select(F.col("dst").alias("node")).distinct())
    seen = frontier
    while not frontier.isEmpty():
        frontier = cut(step.join(shuffled(frontier), F.col("node") == F.col("src"), "left_semi")
                       .select(F.col("dst").alias("node")).distinct()
                       .join(shuffled(seen), "node", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def plus(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``a+``: set semantics; a node reaches itself only through a cycle.

    All pairs come from reachability labels, in rounds that do not grow with
    the depth; from ``seeds`` they are walked.
    """
    if seeds is None:
        return reachability.pairs(reachability.index(edges))
    return reach(edges, seeds).select(F.col("start").alias("src"), F.col("node").alias("dst"))


def _identity(nodes: DataFrame) -> DataFrame:
    n = nodes.columns[0]
    return nodes.select(F.col(n).alias("src"), F.col(n).alias("dst"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def star(edges: DataFrame, nodes: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """``a*``: ``a+`` and every node to itself."""
    own = seeds.select("start") if seeds is not None else (nodes if nodes is not None else graph_nodes(edges))
    return plus(edges, seeds).unionByName(_identity(own)).distinct()


def opt_path(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``a?``."""
    own = nodes if nodes is not None else graph_nodes(edges)
    return edges.select("src", "dst").unionByName(_identity(own)).distinct()


# -- neighbourhoods ---------------------------------------------------------

DECLARED = [m.OWL + "Class", m.RDFS + "Class", m.OWL + "Restriction"]


def graph_edges(quads: DataFrame, restrictions: DataFrame | None = None) -> DataFrame:
    """Relationship edges ``(src, pred, dst)`` of a dataset.

    Class declarations and list cells are not relationships; ``restrictions``
    adds the links flattened from restrictions.
    """
    hidden = [m.FIRST, m.REST, m.INTERSECTION]
    kept = quads.filter(m.is_resource() & ~F.col("p").isin(hidden)
                        & ~((F.col("p") == m.TYPE) & F.col("o").isin(DECLARED)))
    out = kept.select(F.col("s").alias("src"), F.col("p").alias("pred"), F.col("o").alias("dst"))
    if restrictions is not None:
        out = out.unionByName(restrictions.select("src", "pred", "dst"))
    return out.distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Adjacency ``(iri, neighbour, pred, outgoing)`` in both directions."""
    out = edges.select(F.col("src").alias("iri"), F.col("dst").alias("neighbour"), "pred", F.lit(True).alias("outgoing"))
    back = edges.select(F.col("dst").alias("iri"), F.col("src").alias("neighbour"), "pred", F.lit(False).alias("outgoing"))
    return out.unionAll(back)


def neighbours(edges: DataFrame, iri: str, limit: int | None = None, incoming: DataFrame | None = None) -> DataFrame:
    """Neighbours of one node with their total: all, or the first ``limit``.

    ``incoming`` are the same edges laid out for look-ups by ``dst``, where
    the store has them.
    """
    back = edges if incoming is None else incoming
    mine = both_ways(edges.filter(F.col("src") == iri)).filter("outgoing").unionAll(
        both_ways(back.filter(F.col("dst") == iri)).filter("NOT outgoing")).distinct()
    total = mine.agg(F.count(F.lit(1))).scalar()
    out = mine.withColumn("total", total).orderBy("pred", "outgoing", "neighbour")
    return out if limit is None else out.limit(limit)


def concise_description(quads: DataFrame, iris: DataFrame) -> DataFrame:
    """Statements of each ``iri`` and of the blank nodes below it, with the
    ``root`` they describe."""
    roots = iris.select(F.col("iri").alias("start")).distinct()
    down = quads.filter(F.col("o_kind") == "bnode").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    # blank nodes are followed only from seeds and from other blank nodes
    first = down.join(roots, F.col("src") == F.col("start"), "left_semi")
    inner = down.filter(m.is_bnode(F.col("src")))
    pairs = reach(first.unionAll(inner).distinct(), roots).select(F.col("start").alias("root"), F.col("node").alias("s"))
    owners = pairs.unionAll(roots.select(F.col("start").alias("root"), F.col("start").alias("s"))).distinct()
    return quads.join(owners, "s").select("root", *m.QUAD_COLS)


def expand(edges: DataFrame, seeds: DataFrame, budget: int, max_depth: int | None = None) -> DataFrame:
    """Multi-source breadth-first expansion to at most ``budget`` nodes.

    Returns ``(node, depth, origin)``; ties inside a depth go by node name.
    """
    adjacency = cut(both_ways(edges.select("src", "dst", F.lit("").alias("pred")))
                    .select(F.col("iri").alias("_at"), F.col("neighbour").alias("node")).distinct())
    frontier = cut(seeds.select(F.col("iri").alias("node")).distinct()
                   .withColumn("depth", F.lit(0)).withColumn("origin", F.lit(None).cast("string")))
    seen, size, depth = frontier, frontier.count(), 0
    while size < budget and (max_depth is None or depth < max_depth):
        depth += 1
        found = (frontier.select(F.col("node").alias("_at")).join(adjacency, "_at")
                 .groupBy("node").agg(F.min("_at").alias("origin"))
                 .join(seen, "node", "left_anti")
                 .select("node", F.lit(depth).alias("depth"), "origin"))
        frontier = cut(found)
        fresh = frontier.count()
        if not fresh:
            break
        seen, size = seen.unionByName(frontier), size + fresh
    return seen.orderBy("depth", "node").limit(budget)


def ancestry_subgraph(parents: DataFrame, matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches and all their ancestors once each: ``(iri, matched, root)``.

    ``parents`` are ``(src, dst)`` edges child to parent.  Blank nodes are
    left out.  Above ``limit`` nodes the call fails rather than cut rows.
    """
    named = parents.filter(~m.is_bnode(F.col("src")) & ~m.is_bnode(F.col("dst"))).select("src", "dst").distinct()
    own = matches.select("iri").filter(~m.is_bnode(F.col("iri"))).distinct()
    # one frontier for all matches: the work is bounded by unique ancestors
    seen = frontier = cut(own)
    step = cut(named)
    while True:
        nxt = (frontier.join(shuffled(step), F.col("iri") == F.col("src")).select(F.col("dst").alias("iri")).distinct()
               .join(shuffled(seen), "iri", "left_anti"))
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if limit is not None and seen.count() > limit:
        raise ValueError(f"the matches and their ancestry exceed {limit} nodes")
    tops = seen.join(step, F.col("iri") == F.col("src"), "left_anti").withColumn("root", F.lit(True))
    return (seen.join(own.withColumn("matched", F.lit(True)), "iri", "left").join(tops, "iri", "left")
            .select("iri", F.coalesce("matched", F.lit(False)).alias("matched"),
                    F.coalesce("root", F.lit(False)).alias("root")))


def unshared_leaves(edges: DataFrame, iri: str) -> DataFrame:
    """Neighbours of a node that have no other neighbour (collapsible)."""
    pairs = both_ways(edges).filter(F.col("iri") != F.col("neighbour")).select("iri", "neighbour").distinct()
    mine = pairs.filter(F.col("iri") == iri).select(F.col("neighbour").alias("iri"))
    degrees = pairs.join(mine, "iri", "left_semi").groupBy("iri").agg(F.count(F.lit(1)).alias("degree"))
    return degrees.filter("degree = 1")


# -- graph catalogue --------------------------------------------------------

def predicate_catalog(edges: DataFrame) -> DataFrame:
    return edges.groupBy("pred").agg(F.count(F.lit(1)).alias("relationships"))


def node_metrics(edges: DataFrame, instances: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per node: connections, direct instances, size of its kind, and maxima.

    ``instances(class, iri)``, ``kinds(iri, kind)``.
    """
    degree = both_ways(edges).groupBy("iri").agg(F.count(F.lit(1)).alias("connections"))
    sizes = instances.groupBy(F.col("class").alias("iri")).agg(F.count(F.lit(1)).alias("instances"))
    per_kind = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("kind_count"))
    rows = cut(kinds.join(degree, "iri", "left").join(sizes, "iri", "left").join(per_kind, "kind")
               .fillna(0, ["connections", "instances"]))

    def top(c):
        return rows.agg(F.max(c)).scalar()

    return (rows.withColumn("max_connections", top("connections"))
            .withColumn("max_instances", top("instances")).withColumn("max_kind_count", top("kind_count")))


def graph_catalog(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: nodes, relationships and the largest metric values."""
    head = metrics.agg(F.count(F.lit(1)).alias("nodes"), F.max("connections").alias("max_connections"),
                       F.max("instances").alias("max_instances"), F.max("kind_count").alias("max_kind_count"))
    return head.withColumn("relationships", edges.agg(F.count(F.lit(1))).scalar())


def _log_share(value: Column, top: Column) -> Column:
    return F.when(top > 0, F.least(F.lit(1.0), F.log1p(F.greatest(value, F.lit(0))) / F.log1p(top))).otherwise(0.0)


def relevance(metrics: DataFrame) -> DataFrame:
    """Mean of the log-normalised connections and instances."""
    a = _log_share(F.col("connections"), F.col("max_connections"))
    b = _log_share(F.col("instances"), F.col("max_instances"))
    return metrics.withColumn("relevance", (a + b) / 2)


def size_score(metrics: DataFrame, weights: tuple[float, float, float] = (50, 50, 0), scale: str = "linear",
               smallest: float = 16, largest: float = 64) -> DataFrame:
    """Weighted share of the maxima and the diameter drawn for it (glyph area
    follows the score)."""
    pairs = [("connections", "max_connections"), ("instances", "max_instances"), ("kind_count", "max_kind_count")]

    def share(v, top):
        plain = F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / top))).otherwise(0.0)
        return _log_share(v, top) if scale == "log" else plain

    total = sum(weights)
    score = F.lit(0.0)
    for (v, top), w in zip(pairs, weights):
        score = score + share(F.col(v), F.col(top)) * F.lit(float(w))
    score = score / total if total else F.lit(0.0)
    area = smallest * smallest + F.col("size_score") * (largest * largest - smallest * smallest)
    return metrics.withColumn("size_score", score).withColumn("diameter", F.sqrt(area))


def ancestor_membership(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """``(iri, root)``: which of the given roots each node is under; a root is
    a member of itself."""
    down = inv(parents.select("src", "dst"))
    seeds = roots.select(F.col("iri").alias("start")).distinct()
    pairs = reach(down, seeds).select(F.col("node").alias("iri"), F.col("start").alias("root"))
    return pairs.unionAll(seeds.select(F.col("start").alias("iri"), F.col("start").alias("root"))).distinct()
