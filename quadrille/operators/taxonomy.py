"""Class hierarchies: closure counts, cycles, components, moves, sparsity.

``parents`` is always an edge table ``(src, dst)`` from child to parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille import model as m
from quadrille.operators import reachability
from quadrille.operators.aggregates import sample_terms
from quadrille.operators.paths import graph_nodes, inv, reach, reached
from quadrille.session import cut, global_index, shuffled


def descendant_counts(parents: DataFrame) -> DataFrame:
    """Unique descendants per class; a class on a cycle does not count itself."""
    return reachability.descendant_counts(reachability.index(parents)).select(F.col("node").alias("iri"), F.col("n").alias("descendants"))


def ancestry_trail(parents: DataFrame, iris: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Ancestors of each ``iri`` at their nearest stage: ``(iri, ancestor,
    stage, root)``.  Roots share one last stage."""
    named = parents.filter(~m.is_bnode(F.col("dst"))).select("src", "dst").distinct()
    up = reach(named, iris.select(F.col("iri").alias("start")), max_depth).filter(F.col("start") != F.col("node"))
    inner = named.select(F.col("src").alias("node"), F.lit(False).alias("root")).distinct()
    rows = up.join(shuffled(inner), "node", "left").withColumn("root", F.coalesce("root", F.lit(True)))
    # empty stages close up: dense rank of the distances that hold non-roots
    stages = rows.filter("not root").select("start", "distance").distinct()
    w = W.partitionBy("start").orderBy("distance")
    stages = stages.withColumn("stage", F.row_number().over(w))
    last = stages.groupBy("start").agg(F.max("stage").alias("last"))
    out = rows.join(shuffled(stages), ["start", "distance"], "left").join(shuffled(last), "start", "left")
    stage = F.when(F.col("root"), F.coalesce("last", F.lit(0)) + 1).otherwise(F.col("stage"))
    return out.select(F.col("start").alias("iri"), F.col("node").alias("ancestor"),
                      "distance", stage.alias("stage"), "root")


# -- cycles and components --------------------------------------------------

def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle: in a strongly connected component of more
    than one node, or with a loop."""
    loops = edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("iri"))
    return loops.unionByName(reachability.strong_components(edges).select(F.col("node").alias("iri"))).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected components ``(node, component)``, named by their smallest node.

    Large-star / small-star rounds: each is two grouped minima (combined
    map-side, so a hub costs one row per task) joined back to the edges;
    rounds grow with the logarithm of the component diameter.
    """
    pairs = edges.filter(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    pairs = cut(pairs)
    mark = None
    while True:
        two_way = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two_way.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (two_way.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        pairs = cut(small)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    named = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    everyone = graph_nodes(edges)
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select(F.col(nodes.columns[0]).alias("node"))).distinct()
    return everyone.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("members")).orderBy(F.desc("members"), "component")


# -- branches and moves -----------------------------------------------------

def branch_members(parents: DataFrame, root: str, classes: DataFrame | None = None) -> DataFrame:
    """A root and its named descendants; ``owl:Thing`` means every class."""
    spark = parents.sparkSession
    if root == m.THING and classes is not None:
        return classes.select("iri").distinct()
    seed = spark.range(1).select(F.lit(root).alias("start"))
    below = reach(inv(parents), seed).select(F.col("node").alias("iri"))
    return below.unionAll(seed.select(F.col("start").alias("iri"))).filter(~m.is_bnode(F.col("iri"))).distinct()


def branch_roots(parents: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen classes without a chosen ancestor."""
    # two chosen ancestors of a node tell whether one is another than itself,
    # so no more are handed down and no pairs are listed
    own = cut(chosen.select("iri").distinct())
    step = cut(parents.select(F.col("dst").alias("_at"), F.col("src").alias("node")).distinct())
    state = cut(own.select(F.lit(None).cast("string").alias("node"), F.col("iri").alias("a"), F.col("iri").alias("b")).limit(0))
    frontier = own.select(F.col("iri").alias("_at"), F.col("iri").alias("up"))
    while True:
        met = step.join(shuffled(frontier), "_at").groupBy("node").agg(F.min("up").alias("lo"), F.max("up").alias("hi"))
        old = met.join(shuffled(state), "node", "left").filter("a IS NULL OR a = b AND (lo <> a OR hi <> a)")
        fresh = cut(old.select("node", F.array_except(F.array_distinct(F.array("lo", "hi")), F.array_compact(F.array("a"))).alias("new"), "a"))
        if fresh.isEmpty():
            break
        # a second ancestor beside one that is known: the first new one will do
        fresh = fresh.withColumn("new", F.when(F.col("a").isNotNull(), F.slice("new", 1, 1)).otherwise(F.col("new")))
        both = state.unionByName(fresh.select("node", F.array_min("new").alias("a"), F.array_max("new").alias("b")))
        state = cut(both.groupBy("node").agg(F.min("a").alias("a"), F.max("b").alias("b")))
        frontier = fresh.select(F.col("node").alias("_at"), F.explode("new").alias("up"))
    covered = state.filter("a <> node OR b <> node").select(F.col("node").alias("iri"))
    return own.join(shuffled(covered), "iri", "left_anti")


def check_moves(parents: DataFrame, classes: DataFrame, moves: DataFrame) -> DataFrame:
    """Reason why each move ``(iri, parent)`` is refused, NULL when allowed."""
    # only what has a moved class above itself can lead to one
    targets = cut(moves.select(F.col("iri").alias("start")).distinct())
    inside = reached(inv(parents), targets).unionByName(targets.select(F.col("start").alias("node"))).distinct()
    below = parents.join(shuffled(inside), F.col("dst") == F.col("node"), "left_semi")
    up = reach(below, moves.select(F.col("parent").alias("start")))
    cycle = up.select(F.col("start").alias("parent"), F.col("node").alias("iri"), F.lit(True).alias("_cycle"))
    known = classes.select("iri").distinct()
    out = (moves.join(shuffled(known.withColumn("_a", F.lit(True))), "iri", "left")
           .join(shuffled(known.select(F.col("iri").alias("parent"), F.lit(True).alias("_b"))), "parent", "left")
           .join(shuffled(cycle), ["parent", "iri"], "left"))
    reason = (F.when(F.col("_a").isNull() | F.col("_b").isNull(), "missing class")
              .when(F.col("iri") == m.THING, "root cannot move")
              .when(F.col("iri") == F.col("parent"), "own parent")
              .when(F.col("_cycle"), "below its descendant"))
    return out.select("iri", "parent", reason.alias("issue"))


def taxonomy_rows(entities: DataFrame, parents: DataFrame, text: str = "") -> DataFrame:
    """The tree as rows ``(iri, depth, path)`` in display order; each once.

    ``entities(iri, name)``, ``parents(src, dst, pos)``.  A filter keeps
    matches and their ancestors.  A class sits under its first recorded
    visible parent; when that chain only circles, under the first parent that
    is already placed.
    """
    visible = entities.select("iri", "name")
    edges = parents.join(visible.select(F.col("iri").alias("src")), "src", "left_semi").join(
        visible.select(F.col("iri").alias("dst")), "dst", "left_semi").select("src", "dst", "pos")
    q = text.strip().lower()
    if q:
        hits = visible.filter(F.lower(F.concat_ws(" ", "name", "iri")).contains(q)).select("iri")
        up = reach(edges, hits.select(F.col("iri").alias("start"))).select(F.col("node").alias("iri"))
        shown = hits.unionAll(up).distinct()
        visible = visible.join(shown, "iri", "left_semi")
        edges = edges.join(shown.select(F.col("iri").alias("src")), "src", "left_semi").join(
            shown.select(F.col("iri").alias("dst")), "dst", "left_semi")
    visible, edges = cut(visible), cut(edges)
    primary = cut(edges.groupBy("src").agg(F.min_by("dst", F.struct("pos", "dst")).alias("dst")))
    key = F.concat(F.lower("name"), F.lit("\u0001"), F.col("iri"))

    def place(children: DataFrame, placed: DataFrame) -> DataFrame:
        above = placed.select(F.col("iri").alias("dst"), F.col("path").alias("_up"), F.col("depth").alias("_d"))
        return (children.join(above, "dst").join(visible.withColumnRenamed("iri", "src"), "src")
                .select(F.col("src").alias("iri"), (F.col("_d") + 1).alias("depth"),
                        F.concat("_up", F.array(F.concat(F.lower("name"), F.lit("\u0001"), F.col("src")))).alias("path")))

    roots = visible.join(edges.select(F.col("src").alias("iri")), "iri", "left_anti")
    frontier = done = cut(roots.select("iri", F.lit(0).alias("depth"), F.array(key).alias("path")))
    while True:
        nxt = place(primary, frontier).join(done.select("iri"), "iri", "left_anti")
        frontier = cut(nxt)
        if frontier.isEmpty():
            # a circle of first parents: enter it through any placed parent
            left = edges.join(done.select(F.col("iri").alias("src")), "src", "left_anti")
            entry = (left.join(done.select(F.col("iri").alias("dst")), "dst", "left_semi")
                     .groupBy("src").agg(F.min_by("dst", F.struct("pos", "dst")).alias("dst")))
            frontier = cut(place(entry, done))
            if frontier.isEmpty():
                break
        done = done.unionByName(frontier)
    return done.orderBy("path")


# -- sparsity ---------------------------------------------------------------

def sparsity_metrics(parents: DataFrame, root: str | None = None, reach_depth: int = 4) -> DataFrame:
    """Children, nearby descendants (depth 2-4) and their discounted sum.

    Classes on a cycle and everything above one are left out; ``root`` limits
    the comparison to its branch.
    """
    named = parents.filter(~m.is_bnode(F.col("src")) & ~m.is_bnode(F.col("dst"))).select("src", "dst").distinct()
    if root is not None:
        scope = cut(branch_members(named, root))
        named = named.join(scope.select(F.col("iri").alias("src")), "src", "left_semi").join(
            scope.select(F.col("iri").alias("dst")), "dst", "left_semi")
    named = cut(named)
    cyclic = cut(cyclic_nodes(named))
    above = reach(named, cyclic.select(F.col("iri").alias("start"))).select(F.col("node").alias("iri"))
    affected = cyclic.unionAll(above).distinct()
    near = reach(inv(named), max_depth=reach_depth).filter(F.col("start") != F.col("node"))
    per = near.groupBy(F.col("start").alias("iri")).agg(
        F.count_if(F.col("distance") == 1).alias("children"),
        F.count_if(F.col("distance") >= 2).alias("nearby"),
        F.coalesce(F.sum(F.when(F.col("distance") >= 2, F.pow(F.lit(0.5), F.col("distance") - 2))), F.lit(0.0)).alias("discounted"))
    everyone = graph_nodes(named).withColumnRenamed("node", "iri")
    return (everyone.join(affected, "iri", "left_anti").join(per, "iri", "left")
            .fillna(0, ["children", "nearby"]).fillna(0.0, ["discounted"]))


def _deficit(count: Column, reference: Column) -> Column:
    return F.when(reference > 0, F.greatest(F.lit(0.0), 1 - count / reference)).otherwise(0.0)


def sparsity_rows(parents: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each class against the mean of its siblings (itself left out).

    The group sums combine map-side and are joined back, so a parent with
    very many children needs no single-task window.
    """
    pairs = parents.select(F.col("src").alias("iri"), F.col("dst").alias("parent")).distinct().join(metrics, "iri")
    pairs = cut(pairs)
    sums = pairs.groupBy("parent").agg(F.sum("children").alias("_c"), F.sum("discounted").alias("_d"),
                                       (F.count(F.lit(1)) - 1).alias("peers")).filter("peers >= 1")
    rows = pairs.join(sums, "parent")
    pc = (F.col("_c") - F.col("children")) / F.col("peers")
    pd = (F.col("_d") - F.col("discounted")) / F.col("peers")
    return (rows.withColumn("peer_children", pc).withColumn("peer_discounted", pd)
            .withColumn("direct_deficit", _deficit(F.col("children"), F.col("peer_children")))
            .withColumn("descendant_deficit", _deficit(F.col("discounted"), F.col("peer_discounted")))
            .drop("_c", "_d"))


def sparsity_summary(parents: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: comparison groups, unpaired, excluded, compared, shared."""
    pairs = parents.select(F.col("src").alias("iri"), F.col("dst").alias("parent")).distinct()
    ok = pairs.join(metrics.select("iri", F.lit(1).alias("_ok")), "iri", "left")
    per = ok.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.count("_ok").alias("peers"))
    shared = pairs.groupBy("iri").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1))).scalar()
    return per.agg(F.count_if(F.col("peers") >= 2).alias("groups"), F.count_if(F.col("peers") == 1).alias("unpaired"),
                   F.sum(F.col("n") - F.col("peers")).alias("excluded"), F.sum("n").alias("compared")
                   ).withColumn("shared_classes", shared)


def sparsity_score(rows: DataFrame, weight: float = 20) -> DataFrame:
    """0-100; ``weight`` percent (0-40) goes to the descendant deficit."""
    w = F.when(F.col("peer_discounted") > 0, F.lit(weight / 100)).otherwise(0.0)
    score = F.floor(100 * ((1 - w) * F.col("direct_deficit") + w * F.col("descendant_deficit")) + 0.5)
    return rows.withColumn("score", score.cast("int"))


def sparsity_groups(rows: DataFrame, names: DataFrame, minimum: int = 1, leaves: bool = True,
                    text: str = "") -> DataFrame:
    """Per parent: mean children, highest score and how many rows pass."""
    q = text.strip().lower()
    labelled = (rows.join(names.select("iri", F.col("name").alias("_name")), "iri", "left")
                .join(names.select(F.col("iri").alias("parent"), F.col("name").alias("parent_name")), "parent", "left"))
    passes = (F.col("score") > 0) & (F.col("score") >= minimum)
    if not leaves:
        passes = passes & (F.col("children") > 0)
    if q:
        passes = passes & (F.lower("_name").contains(q) | F.lower("parent_name").contains(q))
    return (labelled.groupBy("parent", "parent_name").agg(
        F.avg("children").alias("mean_children"), F.max("score").alias("highest"),
        F.count(F.lit(1)).alias("compared"), F.count_if(passes).alias("shown"))
        .filter("shown > 0").orderBy(F.desc("highest"), "parent_name"))


def sparsity_page(groups: DataFrame, number: int = 0, size: int = 40) -> DataFrame:
    rows = global_index(groups, [F.desc("highest"), F.col("parent_name"), F.col("parent")], "row_index")
    return rows.filter(F.floor(F.col("row_index") / size) == number)


# -- class contexts ---------------------------------------------------------

def class_context(parents: DataFrame, instances: DataFrame, iri: str) -> DataFrame:
    """Everything around a class: rows ``(role, iri, depth)`` with roles
    selected, ancestor, descendant, root, child and instance."""
    spark = parents.sparkSession
    seed = spark.range(1).select(F.lit(iri).alias("start"))
    edges = parents.select("src", "dst").distinct()
    up = cut(reach(edges, seed).filter(F.col("node") != iri).select(F.col("node").alias("iri"), F.col("distance").alias("depth")))
    down = cut(reach(inv(edges), seed).filter(F.col("node") != iri).select(F.col("node").alias("iri"), F.col("distance").alias("depth")))
    self_row = seed.select(F.col("start").alias("iri"), F.lit(0).alias("depth"))
    tops = up.unionAll(self_row).join(shuffled(edges), F.col("iri") == F.col("src"), "left_anti")
    classes = down.unionAll(self_row).select(F.col("iri").alias("class"))
    inst = instances.join(shuffled(classes), "class", "left_semi").select("iri").distinct().withColumn("depth", F.lit(0))

    def role(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("role"), "iri", "depth")

    return (role(self_row, "selected").unionAll(role(up, "ancestor"))
            .unionAll(role(down, "descendant")).unionAll(role(tops, "root"))
            .unionAll(role(down.filter("depth = 1"), "child")).unionAll(role(inst, "instance")))


def context_links(parents: DataFrame, context: DataFrame) -> DataFrame:
    """Links with both ends in the context."""
    inside = context.filter(F.col("role").isin("selected", "ancestor", "descendant")).select("iri").distinct()
    return (parents.join(inside.select(F.col("iri").alias("src")), "src", "left_semi")
            .join(inside.select(F.col("iri").alias("dst")), "dst", "left_semi").select("src", "dst").distinct())


def sample_context(context: DataFrame, n: int = 20) -> DataFrame:
    """At most ``n`` children and ``n`` descendants, repeatably sampled; the
    other roles stay whole."""
    big = context.filter(F.col("role").isin("child", "descendant"))
    rest = context.filter(~F.col("role").isin("child", "descendant"))
    return rest.unionByName(sample_terms(big, "role", "iri", n).drop("sample_rank"))
