"""Reachability by labels instead of stored pairs.

``edges`` are ``(src, dst)``.  ``strong_components`` finds cycles in rounds that
grow with the logarithm of chain lengths.  ``index`` contracts them, lays a
spanning forest over the rest and gives every node an interval of positions
that holds exactly the nodes below it in the forest; what reaches a node
through further edges is kept as a list of extra intervals.  Whether ``a``
reaches ``b`` is then a comparison of numbers, the number of nodes that reach
``b`` a sum of interval lengths, and all pairs, where they are asked for, come
out of one join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille.session import global_index, group_index, shuffled, stored

#: extra intervals are split at multiples of this, so that a position finds its own by equality
PIECE = 4096


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _back(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


# -- cycles -----------------------------------------------------------------

def _dead_chains(edges: DataFrame) -> DataFrame:
    """Nodes from which single out-edges lead to an end: no cycle passes them.

    Pointers double three times a round; a round that closes no further chain is the
    last, so rings do not keep the loop going.
    """
    one = edges.groupBy("src").agg(F.min("dst").alias("to"), F.count(F.lit(1)).alias("n"))
    kinds = _nodes(edges).join(one, F.col("node") == F.col("src"), "left").select(
        "node", F.when(F.col("n") == 1, F.col("to")).alias("to"), F.col("n").isNull().alias("dead"))
    state, open_ = stored(kinds), None
    while True:
        for _ in range(3):
            ahead = state.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("dead").alias("_dead"))
            state = state.join(ahead, "to", "left").select(
                "node", F.col("_to").alias("to"), (F.col("dead") | F.coalesce("_dead", F.lit(False))).alias("dead"))
        state = stored(state)
        now = state.filter("to IS NOT NULL").count()
        if now in (0, open_):
            return state.filter("dead").select("node")
        open_ = now


def trim(edges: DataFrame) -> DataFrame:
    """Drops edges that lie on no cycle because they lead to an end or come
    from a start: level by level while that removes a good share, whole chains
    at a time when it does not."""
    size = edges.count()
    while size:
        kept = edges
        for _ in range(2):
            heads, tails = kept.select(F.col("src").alias("_n")).distinct(), kept.select(F.col("dst").alias("_n")).distinct()
            kept = kept.join(heads, F.col("dst") == F.col("_n"), "left_semi").join(tails, F.col("src") == F.col("_n"), "left_semi")
        kept = stored(kept)
        left = kept.count()
        if left and 4 * (size - left) < size and left < size:
            for turn in (lambda e: e, _back):
                dead = _dead_chains(turn(kept))
                kept = kept.join(dead, F.col("src") == F.col("node"), "left_anti").join(dead, F.col("dst") == F.col("node"), "left_anti")
            kept = stored(kept)
            left = kept.count()
        if left == size:
            break
        edges, size = kept, left
    return edges


def spread_min(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, m): the smallest value among the node and all it reaches.

    One step over all edges alternates with doubled steps along the best edge
    of each node, so a path without branches costs the logarithm of its length.
    """
    state = values.select("node", "m")
    while True:
        sent = edges.join(state, F.col("dst") == F.col("node")).groupBy("src").agg(
            F.min(F.struct("m", "dst")).alias("best"))
        stepped = stored(state.join(sent, F.col("node") == F.col("src"), "left").select(
            "node", F.least("m", F.coalesce("best.m", "m")).alias("m"), F.col("best.dst").alias("to"),
            (F.col("best.m") < F.col("m")).alias("moved")))
        if stepped.filter("moved").isEmpty():
            return stepped.select("node", "m")
        state = stepped.select("node", "m", "to")
        while True:
            far = state.withColumn("old", F.col("m"))
            for _ in range(2):
                ahead = far.select(F.col("node").alias("to"), F.col("m").alias("_m"), F.col("to").alias("_to"))
                far = far.join(ahead, "to", "left").select("node", F.least("m", F.coalesce("_m", "m")).alias("m"), F.col("_to").alias("to"), "old")
            state = stored(far)
            if state.filter("m < old").isEmpty():
                break
            state = state.drop("old")
        state = state.select("node", "m")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every strongly connected component of two nodes or
    more, named by its smallest node."""
    found = _components(stored(edges.select("src", "dst").distinct()))
    return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0) if found is None else found


def _components(edges: DataFrame) -> DataFrame | None:
    """``strong_components`` of materialised edges; None where there is none.

    After trimming, each node takes the smallest name it reaches.  Edges between
    different names lie on no cycle; inside a name, what its bearer reaches is
    its component.
    """
    core = trim(edges.filter(F.col("src") != F.col("dst")))
    found = None
    while not core.isEmpty():
        colour = spread_min(core, _nodes(core).select("node", F.col("node").alias("m")))
        ends = [colour.select(F.col("node").alias(side), F.col("m").alias(f"m_{side}")) for side in ("src", "dst")]
        inside = stored(core.join(ends[0], "src").join(ends[1], "dst").filter("m_src = m_dst").select("src", "dst"))
        marks = colour.select("node", F.when(F.col("node") == F.col("m"), 0).otherwise(1).alias("m"))
        members = stored(spread_min(_back(inside), marks).filter("m = 0").select("node").join(
            colour.select("node", F.col("m").alias("component")), "node"))
        large = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        part = members.join(large, "component", "left_semi").select("node", "component")
        found = part if found is None else found.unionByName(part)
        rest = inside.join(members, F.col("src") == F.col("node"), "left_anti").join(members, F.col("dst") == F.col("node"), "left_anti")
        core = trim(stored(rest))
    return found if found is None else stored(found)


# -- labels -----------------------------------------------------------------

@dataclass
class Index:
    """A node's place ``at`` is the first position of its component.

    ``nodes(node, at, pos, stop, extra)``: the node, its place and position, the
    end of its interval, and whether it has more; ``spans(at, stop, n)`` per
    place, with ``n`` members; ``extras(at, piece, lo, hi)``: disjoint intervals
    outside the own one; ``loops(at)``: places whose members reach themselves.
    """
    nodes: DataFrame
    spans: DataFrame
    extras: DataFrame | None
    loops: DataFrame


def _positions(tree: DataFrame) -> DataFrame:
    """(rep, start, stop) from ``tree(rep, parent, n)``, parent NULL at a root.

    Single leaves are numbered below their parents first.  The others form one
    tour, down and up each edge, whose suffix sums double their reach three times
    a round, whatever the shape of the tree.
    """
    inner = tree.filter("parent IS NOT NULL").select(F.col("parent").alias("rep")).distinct()
    leaf = tree.filter("parent IS NOT NULL AND n = 1").join(inner, "rep", "left_anti")
    leaves = group_index(leaf.select("rep", "parent"), ["parent"], [F.col("rep")], "k")
    below = leaves.groupBy(F.col("parent").alias("rep")).agg(F.count(F.lit(1)).alias("leaves"))
    core = tree.join(leaves.select("rep"), "rep", "left_anti").join(below, "rep", "left").fillna(0, ["leaves"])
    core = global_index(core, [F.col("parent").asc_nulls_first(), F.col("rep")], "id")
    heads = core.select(F.col("rep").alias("parent"), F.col("id").alias("up"))
    firsts = core.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("rep")).agg(F.min("id").alias("child"))
    after = core.select((F.col("id") - 1).alias("id"), F.col("parent").alias("_next"), F.lit(True).alias("_is"))
    rows = core.join(heads, "parent", "left").join(firsts, "rep", "left").join(after, "id", "left")
    sibling = F.coalesce("_is", F.lit(False)) & F.col("_next").eqNullSafe(F.col("parent"))
    down = rows.select((2 * F.col("id")).alias("x"), F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1).alias("to"), (F.col("n") + F.col("leaves")).alias("s"))
    up = rows.select((2 * F.col("id") + 1).alias("x"), F.when(sibling, 2 * F.col("id") + 2).otherwise(2 * F.col("up") + 1).alias("to"), F.lit(0).cast("long").alias("s"))
    tour = stored(down.unionByName(up))
    while not tour.filter("to IS NOT NULL").isEmpty():
        for _ in range(3):
            ahead = tour.select(F.col("x").alias("to"), F.col("to").alias("_to"), F.col("s").alias("_s"))
            tour = tour.join(ahead, "to", "left").select("x", F.col("_to").alias("to"), (F.col("s") + F.coalesce("_s", F.lit(0))).alias("s"))
        tour = stored(tour)
    total = tour.agg(F.max("s")).first()[0] or 0
    ends = tour.groupBy(F.call_function("div", F.col("x"), F.lit(2)).alias("id")).agg(
        (total - F.max_by("s", -F.col("x"))).alias("start"), (total - F.max_by("s", "x")).alias("stop"))
    placed = core.join(ends, "id").select("rep", "start", "stop", "n")
    home = placed.select(F.col("rep").alias("parent"), (F.col("start") + F.col("n") - 1).alias("_at"))
    at = F.col("_at") + F.col("k")
    return placed.unionByName(leaves.join(home, "parent").select("rep", at.alias("start"), (at + 1).alias("stop"), F.lit(1).cast("long").alias("n")))


def _islands(rows: DataFrame) -> DataFrame:
    """Touching and overlapping intervals of one (at, piece) as one; a piece bounds the rows of a window."""
    w = W.partitionBy("at", "piece").orderBy("lo", "hi")
    reach_ = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("lo") <= F.col("_to"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("_to", reach_).withColumn("_run", run)
    return marked.groupBy("at", "piece", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def _split(rows: DataFrame) -> DataFrame:
    """(at, piece, lo, hi): intervals cut at multiples of PIECE."""
    div = lambda c: F.call_function("div", c, F.lit(PIECE))
    out = rows.select("at", "lo", "hi", F.explode(F.sequence(div(F.col("lo")), div(F.col("hi") - 1))).alias("piece"))
    return out.select("at", "piece", F.greatest(F.col("lo"), F.col("piece") * PIECE).alias("lo"), F.least(F.col("hi"), (F.col("piece") + 1) * PIECE).alias("hi"))


def _extras(forest: DataFrame, further: DataFrame) -> DataFrame:
    """Intervals that reach a place through at least one further edge.

    ``forest(at, stop, up)`` with the parent's place; ``further(src, lo, hi,
    dst)`` with the interval of ``src``.  Intervals are carried between the ends
    of further edges and the next such place above, round by round and only
    where they add something, and at the end handed to the places in between.
    """
    own = forest.select("at", "stop")
    marked = further.select(F.explode(F.array("src", "dst")).alias("at")).distinct().withColumn("_in", F.lit(True))
    above = forest.select("at", "up").join(marked.withColumnRenamed("at", "up"), "up", "left")
    # near: the next marked place above, if it is among those passed; up: where the next stretch begins
    hop = stored(above.select("at", F.when(F.col("_in"), F.col("up")).alias("near"), F.when(F.col("_in").isNull(), F.col("up")).alias("up")))
    stretches = [hop]
    while not hop.filter("up IS NOT NULL").isEmpty():
        ahead = hop.select(F.col("at").alias("up"), F.col("near").alias("_near"), F.col("up").alias("_up"))
        hop = stored(hop.join(ahead, "up", "left").select("at", F.coalesce("near", "_near").alias("near"), F.col("_up").alias("up")))
        stretches.append(hop)
    flows = hop.join(marked, "at", "left_semi").filter("near IS NOT NULL").select(F.col("at").alias("src"), F.col("near").alias("dst"))
    flows = stored(flows.unionByName(further.select("src", "dst")))

    def outside(rows: DataFrame) -> DataFrame:
        return rows.join(own, "at").filter("NOT (lo >= at AND hi <= stop)").drop("stop")

    held = fresh = stored(_islands(_split(outside(further.select(F.col("dst").alias("at"), "lo", "hi")))))
    while not fresh.isEmpty():
        sent = fresh.join(flows, F.col("at") == F.col("src")).select(F.col("dst").alias("at"), "lo", "hi")
        merged = stored(_islands(held.unionByName(_split(outside(sent)))))
        fresh = merged.join(held, ["at", "piece", "lo", "hi"], "left_anti")
        held = merged
    # places between a marked one and the next above it
    between = stretches[0].join(held.select("at").distinct(), "at", "left_semi").filter("up IS NOT NULL").select(F.col("at").alias("low"), F.col("up").alias("at"))
    if between.isEmpty():
        return held
    for table in stretches[:-1]:
        ahead = table.filter("up IS NOT NULL").select("at", "up")
        between = stored(between.unionByName(between.join(ahead, "at").select("low", F.col("up").alias("at"))).distinct())
    passed = between.join(held.withColumnRenamed("at", "low"), "low").drop("low")
    return _islands(held.unionByName(outside(passed).select("at", "piece", "lo", "hi")))


def index(edges: DataFrame) -> Index:
    """Labels of all nodes of ``edges``.

    The parent with the fewest children becomes the forest's, so that hubs
    collect further edges and few places need extra intervals.
    """
    edges = stored(edges.select("src", "dst").distinct())
    groups = _components(edges)
    names, dag = _nodes(edges), edges.filter("src <> dst")
    if groups is None:
        names = names.select("node", F.col("node").alias("rep"), F.lit(False).alias("many"))
    else:
        names = stored(names.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("rep"), F.col("component").isNotNull().alias("many")))
        ends = [names.select(F.col("node").alias(s), F.col("rep").alias(f"r_{s}")) for s in ("src", "dst")]
        dag = dag.join(ends[0], "src").join(ends[1], "dst").filter("r_src <> r_dst").select(F.col("r_src").alias("src"), F.col("r_dst").alias("dst")).distinct()
    sizes = names.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    children = dag.groupBy("dst").agg(F.count(F.lit(1)).alias("c"))
    chosen = dag.join(children, "dst").groupBy(F.col("src").alias("rep")).agg(F.min_by("dst", F.struct("c", "dst")).alias("parent"))
    tree = stored(sizes.join(chosen, "rep", "left").select("rep", "parent", "n"))
    placed = stored(_positions(tree).join(tree.select("rep", "parent"), "rep").select("rep", F.col("start").alias("at"), "stop", "n", "parent"))
    parents = placed.select(F.col("rep").alias("parent"), F.col("at").alias("up"))
    spans = stored(placed.join(parents, "parent", "left").select("rep", "at", "stop", "n", "up"))
    low = spans.select(F.col("rep").alias("src"), F.col("at").alias("lo"), F.col("stop").alias("hi"), "up")
    high = spans.select(F.col("rep").alias("dst"), F.col("at").alias("_dst"))
    further = stored(dag.join(low, "src").join(high, "dst").filter("_dst <> up").select(F.col("lo").alias("src"), "lo", "hi", F.col("_dst").alias("dst")))
    extras = None if further.isEmpty() else stored(_extras(spans.select("at", "stop", "up"), further))
    more = F.lit(False) if extras is None else F.coalesce("extra", F.lit(False))
    marked = spans if extras is None else spans.join(extras.select("at").distinct().withColumn("extra", F.lit(True)), "at", "left")
    home = marked.select("rep", "at", "stop", more.alias("extra"))
    shown = ["node", "at", "pos", "stop", "extra"]
    single = names.filter("NOT many").join(home, "rep").withColumn("pos", F.col("at")).select(shown)
    looped = edges.filter("src = dst").select(F.col("src").alias("node"))
    if groups is None:
        nodes = stored(single)
        return Index(nodes, spans.select("at", "stop", "n"), extras, looped.join(nodes, "node").select("at"))
    inside = group_index(names.filter("many").select("node", "rep"), ["rep"], [F.col("node")], "k")
    nodes = stored(single.unionByName(inside.join(home, "rep").withColumn("pos", F.col("at") + F.col("k") - 1).select(shown)))
    loops = looped.unionByName(groups.select("node")).join(nodes, "node").select("at").distinct()
    return Index(nodes, spans.select("at", "stop", "n"), extras, stored(loops))


def descendant_counts(ix: Index) -> DataFrame:
    """(node, n): how many other nodes reach it, for nodes with at least one."""
    sizes = ix.spans.select("at", (F.col("stop") - F.col("at") - 1).alias("n"))
    if ix.extras is not None:
        more = ix.extras.groupBy("at").agg(F.sum(F.col("hi") - F.col("lo")).alias("more"))
        sizes = sizes.join(more, "at", "left").select("at", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return ix.nodes.select("node", "at").join(sizes.filter("n > 0"), "at").select("node", "n")


def pairs(ix: Index) -> DataFrame:
    """All (src, dst) with a path of at least one edge: intervals are laid out
    piece by piece and met with positions, one join of the size of the result."""
    # the members of a place come first in its interval; they meet each other only on a loop
    below = ix.spans.filter("stop > at + n").select("at", (F.col("at") + F.col("n")).alias("lo"), F.col("stop").alias("hi"))
    ring = ix.loops.join(ix.spans, "at").select("at", F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi"))
    spans = _split(below.unionByName(ring))
    if ix.extras is not None:
        spans = spans.unionByName(ix.extras)
    points = spans.select("at", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("pos"))
    named = points.join(ix.nodes.select(F.col("node").alias("src"), "pos"), "pos")
    return named.join(ix.nodes.select(F.col("node").alias("dst"), "at"), "at").select("src", "dst")


def labelled(ix: Index, rows: DataFrame, name: str, prefix: str) -> DataFrame:
    """``rows`` with the labels of node column ``name``, NULL outside the graph:
    ``{prefix}_at``, ``_pos``, ``_stop`` and ``_extra``."""
    own = ix.nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{prefix}_{c}") for c in ("at", "pos", "stop", "extra")])
    return rows.join(own, name, "left")


def above(ix: Index, rows: DataFrame, low: str, high: str, flag: str) -> DataFrame:
    """``rows``, labelled under both prefixes, with ``flag``: whether ``low`` reaches ``high``.

    Two comparisons of numbers; only rows whose upper node has extra intervals
    look its one up by the piece of the lower position.
    """
    pos, at = F.col(f"{low}_pos"), F.col(f"{high}_at")
    inside = F.coalesce((pos >= at) & (pos < F.col(f"{high}_stop")), F.lit(False))
    if ix.extras is None:
        return rows.withColumn(flag, inside)
    asked = F.when(F.col(f"{high}_extra") & ~inside, at)
    spans = ix.extras.groupBy("at", "piece").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))   # at most PIECE
    there = rows.withColumn("_at", asked).withColumn("_piece", F.call_function("div", pos, F.lit(PIECE)))
    met = there.join(spans.select(F.col("at").alias("_at"), F.col("piece").alias("_piece"), "_spans"), ["_at", "_piece"], "left")
    held = F.exists("_spans", lambda x: (x["lo"] <= pos) & (x["hi"] > pos))
    return met.withColumn(flag, inside | F.coalesce(held, F.lit(False))).drop("_at", "_piece", "_spans")


def reaching(ix: Index, asked: DataFrame, src: str, dst: str) -> DataFrame:
    """The rows of ``asked`` whose ``src`` reaches ``dst`` (another node), tested by labels.

    Rows with a node outside the graph reach nothing.
    """
    rows = labelled(ix, labelled(ix, asked.filter(F.col(src) != F.col(dst)), src, "_low"), dst, "_high")
    return above(ix, rows, "_low", "_high", "_up").filter("_up").select(*asked.columns)


# -- ancestors as bits ------------------------------------------------------

def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes(node, id)`` and distinct ``edges`` by id: numbers from 0, nodes
    with most children first, so that what many nodes are below stands together."""
    children = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("c"))
    named = _nodes(edges).join(shuffled(children), "node", "left").fillna(0, ["c"])
    nodes = stored(global_index(named, [F.desc("c"), F.col("node")], "id").select("node", "id"))
    ends = [shuffled(nodes.select(F.col("node").alias(s), F.col("id").alias(f"_{s}"))) for s in ("src", "dst")]
    return nodes, stored(edges.join(ends[0], "src").join(ends[1], "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())


def bit_of(node: str) -> tuple[Column, Column]:
    """The block of a number and its bit there."""
    return F.call_function("div", F.col(node), F.lit(64)), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(node) % 64).cast("int"))


def as_bits(rows: DataFrame, by: str, node: str) -> DataFrame:
    """(by, block, bits): the numbers ``node`` of each ``by``, 64 to a block."""
    block, bit = bit_of(node)
    return rows.groupBy(by, block.alias("block")).agg(F.bit_or(bit).alias("bits"))


def listed(rows: DataFrame, *keep: str) -> DataFrame:
    """(src, dst) for every bit of ``rows(src, block, bits)``, or ``keep`` in place of src."""
    keep = keep or ("src",)
    at = rows.select(*keep, "block", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_k"))
    return at.filter(F.expr("shiftright(bits, _k) & 1") == 1).select(*keep, (F.col("block") * 64 + F.col("_k")).alias("dst"))


def ancestor_bits(edges: DataFrame) -> DataFrame:
    """(src, block, bits): all numbers that each number reaches over at least
    one of ``edges`` (from ``numbered``), 64 to a block.

    A round hands what is new at a node down to its children.  Nodes without
    children, mostly the larger part, take no part in the rounds and gather from
    their parents at the end.
    """
    have = shuffled(edges.select(F.col("dst").alias("src")).distinct())
    step = stored(edges.join(have, "src", "left_semi"))
    fresh = stored(as_bits(step, "src", "dst"))
    seen = fresh
    while not fresh.isEmpty():
        sent = (step.join(shuffled(fresh.withColumnRenamed("src", "dst")), "dst")
                .groupBy("src", "block").agg(F.bit_or("bits").alias("sent")))
        found = sent.join(shuffled(seen), ["src", "block"], "left").select(
            "src", "block", F.col("sent").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))).alias("bits"))
        fresh = stored(found.filter("bits <> 0"))
        seen = stored(seen.unionByName(fresh).groupBy("src", "block").agg(F.bit_or("bits").alias("bits")))
    ends = edges.join(have, "src", "left_anti")
    passed = ends.join(shuffled(seen.withColumnRenamed("src", "dst")), "dst").select("src", "block", "bits")
    low = passed.unionByName(as_bits(ends, "src", "dst")).groupBy("src", "block").agg(F.bit_or("bits").alias("bits"))
    return stored(seen.unionByName(low))
