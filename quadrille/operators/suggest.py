"""Suggestions: subclass and intersection candidates, names, drafts, synonyms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille import model as m
from quadrille.functions import text as tx
from quadrille.operators import reachability, taxonomy as tax
from quadrille.operators.aggregates import sample_terms
from quadrille.operators.paths import inv, reach
from quadrille.operators.patterns import block_join
from quadrille.session import cut, group_index, shuffled, stored

# Words that do not count in a name, and words that negate it.
SKIP_WORDS = ["and", "of", "the", "a", "an"]
NEGATIONS = ["non", "not", "no", "without"]
SUBSET_WORDS = 10


def label_tokens(label: Column) -> Column:
    split = F.lower(F.regexp_replace(label, r"(?<=[a-z])(?=[A-Z])", " "))
    return F.filter(F.split(split, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(SKIP_WORDS))


def _negated(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in NEGATIONS]))


def _is_subsequence(inner: Column, outer: Column) -> Column:
    """Do the words of ``inner`` occur in ``outer`` in order?"""
    at = F.aggregate(outer, F.lit(0), lambda i, w: F.when(
        (i < F.size(inner)) & (F.get(inner, i) == w), i + 1).otherwise(i))
    return at == F.size(inner)


def _parts(words: Column) -> Column:
    """Every proper, non-empty ordered selection of a short word list."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(words)).cast("int") - 2)
    return F.array_distinct(F.transform(masks, lambda k: F.filter(
        words, lambda w, i: F.call_function("shiftright", k, i) % 2 == 1)))


def contained_names(names: DataFrame) -> DataFrame:
    """Pairs (words, part) of distinct names where ``part`` is a proper,
    ordered selection of ``words``.

    Up to ten words every selection is looked up by equality.  Longer names
    meet the shorter ones through each part's rarest word, then are checked;
    both ways give all pairs.
    """
    own = cut(names.select("words").distinct().filter(F.size("words") > 0))
    short = own.filter((F.size("words") <= SUBSET_WORDS) & (F.size("words") > 1))
    looked = short.select("words", F.explode(_parts(F.col("words"))).alias("part")).join(
        own.withColumnRenamed("words", "part"), "part", "left_semi")
    long = own.filter(F.size("words") > SUBSET_WORDS)
    use = own.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rare = own.select("words", F.explode(F.array_distinct("words")).alias("w")).join(use, "w").groupBy(
        F.col("words").alias("part")).agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    met = long.select("words", F.explode(F.array_distinct("words")).alias("w")).join(rare, "w").filter(
        (F.size("part") < F.size("words")) & _is_subsequence(F.col("part"), F.col("words")))
    return looked.select("words", "part").unionByName(met.select("words", "part")).distinct()


def subclass_candidates(classes: DataFrame, parents: DataFrame, limit: int = 100) -> DataFrame:
    """(iri, candidate, words_matched, rank): classes whose name keeps some
    words of this one in order, not already above or below it.

    A name shared by very many classes is entered by rank blocks, in doubling
    numbers, until a class has ``limit`` unrelated ones; kinship is tested by
    reachability labels, so no closure is built.
    """
    named = cut(classes.select("iri", "label", label_tokens(F.col("label")).alias("words")))
    pairs = contained_names(named).filter((F.size("words") > 1) & ~_negated(F.col("words")) & ~_negated(F.col("part")))
    labels = reachability.index(parents)
    ranked = group_index(named.select("words", "iri", "label"), ["words"], [F.lower("label"), F.col("iri")], "r").select(
        F.col("words").alias("part"), F.col("iri").alias("candidate"), F.col("label").alias("c_label"),
        F.floor((F.col("r") - 1) / limit).alias("block"))
    ranked = cut(reachability.labelled(labels, ranked, "candidate", "c"))
    last = ranked.groupBy("part").agg(F.max("block").alias("last"))
    asking = reachability.labelled(labels, named.select("iri", "words"), "iri", "i")
    open_ = cut(asking.join(pairs, "words").drop("words").join(last, "part"))
    parts, first, width = [], 0, 1
    while True:
        # blocks first .. first + width - 1 of each name that still lacks unrelated classes
        asked = open_.withColumn("block", F.explode(F.sequence(F.lit(first).cast("long"), F.least(F.col("last"), F.lit(first + width - 1)))))
        met = asked.join(ranked, ["part", "block"]).filter("candidate <> iri")
        met = reachability.above(labels, reachability.above(labels, met, "i", "c", "up"), "c", "i", "down").filter("NOT up AND NOT down")
        parts.append(stored(met.select("iri", "candidate", "part", "c_label")))
        found = reduce(DataFrame.unionByName, parts)
        first, width = first + width, 2 * width
        enough = found.groupBy("iri", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)
        open_ = cut(open_.filter(F.col("last") >= first).join(enough, ["iri", "part"], "left_anti"))
        if open_.isEmpty():
            break
    w = W.partitionBy("iri").orderBy(F.size("part").desc(), F.lower("c_label"), "candidate")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(
        "iri", "candidate", F.size("part").alias("words_matched"), "rank")


def _overlapping(held: DataFrame, keys: list[str], limit: int, existing: DataFrame | None = None) -> DataFrame:
    """(keys, first, second, coverage, total): the best ``limit`` pairs of
    ``held(keys, part, c)`` whose parts overlap, neither within the other;
    ``words`` is one of the keys."""
    parts = held.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    a, b = (parts.select(*keys, F.col("part").alias(f"p{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    # of two parts the longer one comes first
    ways = a.join(b, keys).filter((F.size("pa") > F.size("pb")) | ((F.size("pa") == F.size("pb")) & (F.col("pa") < F.col("pb"))))
    ways = ways.filter(F.arrays_overlap("pa", "pb") & (F.size(F.array_except("pa", "pb")) > 0) & (F.size(F.array_except("pb", "pa")) > 0))
    ways = ways.withColumn("coverage", F.size(F.array_union("pa", "pb")) / F.size("words")).filter("coverage >= 0.75")
    ways = ways.withColumn("total", F.size("pa") + F.size("pb"))
    better = [F.desc("coverage"), F.desc("total")]
    if existing is None:    # ways that come after ``limit`` pairs of better ones have no place
        up_to = F.sum(F.col("na") * F.col("nb")).over(W.partitionBy(*keys).orderBy(*better))
        alike = F.sum(F.col("na") * F.col("nb")).over(W.partitionBy(*keys, "coverage", "total"))
        ways = ways.withColumn("_before", up_to - alike).filter(F.col("_before") < limit)
    one, two = (held.select(*keys, F.col("part").alias(f"p{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
    duo = ways.join(one, [*keys, "pa"]).join(two, [*keys, "pb"])
    swap = (F.size("pa") == F.size("pb")) & (F.col("cb") < F.col("ca"))
    duo = duo.select(*keys, F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("first"),
                     F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("second"), "coverage", "total")
    if existing is not None:
        duo = duo.join(existing.select("iri", "first", "second"), ["iri", "first", "second"], "left_anti")
    w = W.partitionBy(*keys).orderBy(*better, "first", "second")
    return duo.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")


def intersection_candidates(classes: DataFrame, parents: DataFrame, existing: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """(iri, first, second, coverage, rank): two overlapping classes that
    together cover at least 75 % of the words of a class.

    Of the classes of one name only the first ``limit`` that a class may take
    can be in its best ``limit`` pairs: before a pair with a later one stand
    the pairs of all earlier ones with the same partner.  So names pair their
    first classes once; a class with one of these below it, or with existing
    pairs, goes on through its own in blocks, in doubling numbers, until it has
    enough of each name.  No pairs are listed beyond these.
    """
    bag = F.array_sort(F.array_distinct(label_tokens(F.col("label"))))
    named = cut(classes.select("iri", bag.alias("words")).distinct())
    pairs = cut(contained_names(named).filter((F.size("words") >= 3) & (F.size("part") >= 2) & ~_negated(F.col("words"))))
    parts = named.join(pairs.select(F.col("part").alias("words")).distinct(), "words", "left_semi")
    labels = reachability.index(parents)
    ranked = group_index(parts, ["words"], [F.col("iri")], "r").select(
        F.col("words").alias("part"), F.col("iri").alias("c"), "r", F.floor((F.col("r") - 1) / limit).alias("block"))
    ranked = cut(reachability.labelled(labels, ranked, "c", "c"))
    held = stored(pairs.join(ranked.filter("block = 0"), "part"))
    best = stored(_overlapping(held, ["words"], limit))

    asking = cut(reachability.labelled(labels, named.join(pairs.select("words").distinct(), "words", "left_semi"), "iri", "i"))

    def below(rows: DataFrame) -> DataFrame:
        # a candidate below the class would make a cycle
        return reachability.above(labels, rows, "c", "i", "down").withColumn("down", F.col("down") & (F.col("c") != F.col("iri")))

    own = below(asking.join(held, "words")).filter("down").select("iri", F.lit(0).cast("long").alias("n"))
    if existing is not None:
        own = own.unionByName(existing.groupBy("iri").agg(F.count(F.lit(1)).alias("n")))
    # an existing pair may stand under both orders of two names
    own = cut(own.groupBy("iri").agg((limit + 2 * F.sum("n")).alias("need")))
    plain = asking.join(own, "iri", "left_anti").select("iri", "words").join(best, "words")
    last = ranked.groupBy("part").agg(F.max("block").alias("last"))
    open_ = cut(asking.join(own, "iri").join(pairs, "words").join(last, "part"))
    found, first, width = [], 0, 1
    while not open_.isEmpty():
        asked = open_.withColumn("block", F.explode(F.sequence(F.lit(first).cast("long"), F.least(F.col("last"), F.lit(first + width - 1)))))
        met = below(asked.join(ranked, ["part", "block"])).filter("NOT down")
        found.append(stored(met.select("iri", "words", "part", "c", "r", "need")))
        first, width = first + width, 2 * width
        have = reduce(DataFrame.unionByName, found).groupBy("iri", "words", "part").agg(
            F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need")
        open_ = cut(open_.filter(F.col("last") >= first).join(have.drop("need"), ["iri", "words", "part"], "left_anti"))
    out = plain.select("iri", "first", "second", "coverage", "total")
    if found:
        w = W.partitionBy("iri", "words", "part").orderBy("r")
        mine = reduce(DataFrame.unionByName, found).withColumn("k", F.row_number().over(w)).filter("k <= need")
        mine = _overlapping(stored(mine.select("iri", "words", "part", "c")), ["iri", "words"], limit, existing)
        out = out.unionByName(mine.select(*out.columns))
    w = W.partitionBy("iri").orderBy(F.desc("coverage"), F.desc("total"), "first", "second")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(
        "iri", "first", "second", "coverage", "rank")


def eligible_parents(classes: DataFrame, parents: DataFrame, iri: str) -> DataFrame:
    """All classes with ``eligible``: not itself, below it, its parent or Thing."""
    below = tax.branch_members(parents, iri)
    own = parents.filter(F.col("src") == iri).select(F.col("dst").alias("iri"))
    blocked = below.unionAll(own).distinct().withColumn("_no", F.lit(True))
    return classes.join(blocked, "iri", "left").select(
        *classes.columns, (F.col("_no").isNull() & (F.col("iri") != m.THING)).alias("eligible"))


def class_aliases(quads: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, iri, synonym): every name of a class as a word key; a primary
    name wins over a synonym.  ``a+b`` rules are not names."""
    named = classes.select("iri", "label").filter(~m.is_bnode(F.col("iri")))
    inflected = F.substring_index("p", "#", -1) == "inflection"
    rows = quads.filter(m.is_literal() & (F.col("p").isin(m.LABEL, m.SEE_ALSO, m.ALT) | inflected) & ~F.col("o").contains("+"))
    extra = rows.join(named.select(F.col("iri").alias("s")), "s", "left_semi").select(
        F.col("s").alias("iri"), F.col("o").alias("text"), (F.col("p") != m.LABEL).alias("syn"))
    every = named.select("iri", F.col("label").alias("text"), F.lit(False).alias("syn")).unionByName(extra)
    keyed = every.withColumn("key", F.array_join(tx.name_words(F.col("text")), " ")).filter("key <> ''")
    return keyed.groupBy("key", "iri").agg(F.min("syn").alias("syn"), F.min("text").alias("text")).select(
        "key", "iri", F.when(F.col("syn"), F.col("text")).alias("synonym"))


def parents_for_names(names: DataFrame, aliases: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, iri, matched, rank): parent proposals for new names: every run of
    words that names a class; longest first, then at the end of the name."""
    words = tx.name_words(F.col("label"))
    rows = names.select("id", words.alias("w"))
    n = F.size("w")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(a, n), lambda b: F.struct(
        F.array_join(F.slice("w", a, b - a + 1), " ").alias("key"), (b - a + 1).alias("length"), (b == n).alias("suffix"),
        ((a == 1) & (b == n)).alias("whole")))))
    grams = rows.filter(n > 0).select("id", F.explode(runs).alias("g")).select("id", "g.*")
    hits = cut(grams.join(aliases.select("key", "iri"), "key").filter(F.col("iri") != m.THING))
    same = hits.filter("whole").select("id", "iri")
    best = hits.filter("not whole").join(same, ["id", "iri"], "left_anti").groupBy("id", "iri").agg(
        F.max(F.struct("length", "suffix", "key")).alias("b"))
    shown = best.join(classes.select("iri", "label"), "iri").select("id", "iri", "label", "b.*")
    out = group_index(shown, ["id"], [F.desc("length"), F.desc("suffix"), F.lower("label"), F.col("iri")], "rank")
    return out.select("id", "iri", F.col("key").alias("matched"), "rank")


# -- names ------------------------------------------------------------------

def exact_label(c: Column) -> Column:
    return F.lower(tx.normalize_name(F.trim(F.regexp_replace(c, r"\s+", " "))))


def name_collisions(names: DataFrame, entities: DataFrame, namespace: str) -> DataFrame:
    """(id, iri, kind): existing entities that a new name hits exactly, after
    normalisation, or by the IRI it would get."""
    new = names.select("id", tx.name_key(F.col("label")).alias("key"), exact_label(F.col("label")).alias("exact"),
                       F.concat(F.lit(namespace), tx.identifier_from_label(F.col("label"))).alias("made"))
    known = entities.select("iri", tx.name_key(F.col("label")).alias("key"), exact_label(F.col("label")).alias("e"))
    new, known = cut(new), cut(known)
    # a row per name and key on both sides, so that most pairs are formed once;
    # only pairs that two keys may form again, or a key and an IRI, are grouped
    left = new.groupBy("id", "key").agg(F.collect_set("exact").alias("exact"))
    right = known.groupBy("iri", "key").agg(F.collect_set("e").alias("e"))
    left = left.withColumn("_mi", F.count(F.lit(1)).over(W.partitionBy("id")) > 1)
    right = right.withColumn("_me", F.count(F.lit(1)).over(W.partitionBy("iri")) > 1)
    made = new.select("id", "made").distinct().join(known.select("iri").distinct(), F.col("made") == F.col("iri")).select(
        "id", "iri", F.lit("iri").alias("kind"))
    made = cut(made)
    left = left.join(made.select("id").distinct().withColumn("_made", F.lit(True)), "id", "left")
    left = cut(left.withColumn("_free", F.col("_made").isNull() & F.col("id").isNotNull()).withColumn("_x", F.when(F.size("exact") == 1, F.col("exact")[0])))
    right = cut(right.withColumn("_y", F.when(F.size("e") == 1, F.col("e")[0])))
    # mostly one name on either side, and two strings compare faster than two sets
    kind = F.when(F.coalesce(F.col("_x") == F.col("_y"), F.arrays_overlap("exact", "e")), "exact").otherwise("normalized").alias("kind")
    twice = F.col("_mi") & F.col("_me")
    once = block_join(left.filter("_free"), right, ["key"]).filter(~twice).select("id", "iri", kind)
    again = block_join(left.filter(~F.col("_free") | F.col("_mi")), right, ["key"]).filter(~F.col("_free") | twice).select("id", "iri", kind)
    rank = F.create_map(*[F.lit(x) for kv in (("exact", 0), ("normalized", 1), ("iri", 2)) for x in kv])
    grouped = again.unionByName(made).groupBy("id", "iri").agg(F.min_by("kind", rank[F.col("kind")]).alias("kind"))
    return once.unionByName(grouped)


def check_drafts(drafts: DataFrame, entities: DataFrame, namespace: str) -> DataFrame:
    """Findings per draft ``(id, label)``: missing name, existing, occupied
    IRI, repeated in the batch, dropped characters, surplus spaces."""
    clean = F.trim(F.regexp_replace(F.col("label"), r"\s+", " "))
    rows = drafts.withColumn("name", clean).withColumn("key", tx.name_key(clean)).withColumn(
        "made", F.concat(F.lit(namespace), tx.identifier_from_label(clean)))
    first = rows.groupBy("key").agg(F.min("id").alias("_first"))
    taken = entities.select(tx.name_key(F.col("label")).alias("key")).distinct().withColumn("_named", F.lit(True))
    iris = entities.select(F.col("iri").alias("made")).distinct().withColumn("_iri", F.lit(True))
    rows = rows.join(first, "key").join(taken, "key", "left").join(iris, "made", "left")
    named = F.col("name") != ""
    found = F.array_compact(F.array(
        F.when(~named, "name required"), F.when(named & F.col("_named"), "exists"),
        F.when(named & F.col("_named").isNull() & F.col("_iri"), "iri occupied"),
        F.when(named & (F.col("id") != F.col("_first")), "repeated"),
        F.when(F.col("name").rlike(r"[^\p{L}\p{N}\p{M}_\s]"), "characters dropped"),
        F.when(F.col("name") != F.col("label"), "spaces removed")))
    return rows.select("id", "label", F.col("made").alias("iri"), found.alias("findings"))


# -- synonyms ---------------------------------------------------------------

def _next_siblings(pairs: DataFrame, children: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """(start, node): ``n`` siblings of each start, or all if fewer, and few more.

    ``pairs(start, p)``: starts and their parents; ``children(p, node)``;
    ``lines(start, node)``: relatives that are no siblings.  The children of a
    parent stand in a circle by hash, and a start takes those that follow it,
    ``n`` and as many as it has lines under that parent; so no start meets all
    children of a large parent.
    """
    ring = cut(group_index(children.withColumn("h", F.md5(F.concat_ws("\u0001", "p", "node"))), ["p"], [F.col("h"), F.col("node")], "at"))
    size = ring.groupBy("p").agg(F.count(F.lit(1)).alias("size"))
    ring = cut(ring.join(shuffled(size), "p").select("p", "node", "at", "size"))
    under = (lines.join(shuffled(pairs), "start").join(shuffled(children), ["p", "node"], "left_semi")
             .groupBy("start", "p").agg(F.count(F.lit(1)).alias("less")))
    # a start that is no child of p stands before the first one
    own = (pairs.join(shuffled(under), ["start", "p"], "left").join(shuffled(size), "p")
           .join(shuffled(ring.select("p", F.col("node").alias("start"), F.col("at").alias("mine"))), ["p", "start"], "left"))
    steps = F.least(F.col("size"), n + 1 + F.coalesce("less", F.lit(0)))
    asked = own.select("start", "p", F.explode(F.sequence(F.lit(1).cast("long"), steps)).alias("k"), F.coalesce("mine", F.lit(0)).alias("mine"), "size")
    asked = asked.select("start", "p", ((F.col("mine") + F.col("k") - 1) % F.col("size") + 1).alias("at"))
    met = asked.join(shuffled(ring.select("p", "at", "node")), ["p", "at"]).filter("start <> node").select("start", "node").distinct()
    return met.join(shuffled(lines), ["start", "node"], "left_anti")


def synonym_context(parents: DataFrame, quads: DataFrame, iris: DataFrame, n: int = 20) -> DataFrame:
    """(iri, role, relative): ancestors whole; children, descendants, siblings
    and further annotated relatives sampled to ``n`` each.

    Siblings are sampled as they are met: see ``_next_siblings``.
    """
    edges = cut(parents.filter(~m.is_bnode(F.col("dst"))).select("src", "dst").distinct())
    seeds = cut(iris.select(F.col("iri").alias("start")).distinct())

    def role(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("start").alias("iri"), F.lit(name).alias("role"), F.col("node").alias("relative"))

    up = cut(reach(edges, seeds).filter("start <> node"))
    down = cut(reach(inv(edges), seeds).filter("start <> node"))
    lines = up.unionByName(down).select("start", "node").distinct()
    children = edges.select(F.col("dst").alias("p"), F.col("src").alias("node"))
    pairs = cut(children.withColumnRenamed("node", "start").join(shuffled(seeds), "start", "left_semi").select("start", "p"))
    siblings = cut(_next_siblings(pairs, children, lines, n))
    big = role(down.filter("distance = 1"), "child").unionByName(role(down, "descendant")).unionByName(role(siblings, "sibling"))
    keyed = big.withColumn("k", F.concat_ws("\u0002", "iri", "role"))
    sampled = cut(sample_terms(keyed, "k", "relative", n).drop("k", "sample_rank"))
    annotated = quads.filter(F.col("p") == m.SEE_ALSO).select(F.col("s").alias("relative")).distinct()
    # up to n of the annotated siblings are in the sample already
    noted = children.join(shuffled(annotated.withColumnRenamed("relative", "node")), "node", "left_semi").select("p", "node")
    beside = _next_siblings(pairs, noted, lines, 2 * n)
    more = (role(down, "annotated").join(shuffled(annotated), "relative", "left_semi").unionByName(role(beside, "annotated")).distinct()
            .join(shuffled(sampled.select("iri", "relative")), ["iri", "relative"], "left_anti"))
    more = sample_terms(more.select("iri", "role", "relative"), "iri", "relative", n).drop("sample_rank")
    return role(up, "ancestor").unionByName(sampled).unionByName(more)


def context_counts(parents: DataFrame, iris: DataFrame, wide: int = 10) -> DataFrame:
    """(iri, role, n): how many ancestors, children, descendants and siblings
    an entity has; roles without any have no row.

    Ancestors stand as bits of numbered nodes (``reachability.ancestor_bits``)
    and are counted, not listed.  Siblings are counted too: entities with the
    same parents once, and the union of the children of up to ``wide`` parents
    is the alternating sum of how many entities have all parents of each subset;
    only sets of more parents are paired with the sets they meet.  The work is
    that of the whole graph, whichever ``iris`` are asked for.
    """
    edges = cut(parents.filter(~m.is_bnode(F.col("dst"))).select("src", "dst").distinct())
    nodes, e = reachability.numbered(edges)
    seeds = iris.select(F.col("iri").alias("node")).distinct().join(shuffled(nodes), "node")
    up = reachability.ancestor_bits(e)
    own = e.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("ps"))
    own = cut(own.withColumn("key", F.sha2(F.array_join(F.col("ps").cast("array<string>"), ","), 256)))
    sets = cut(own.groupBy("key").agg(F.first("ps").alias("ps"), F.count(F.lit(1)).alias("size")))
    subsets = F.expr("transform(sequence(1, shiftleft(1, size(ps)) - 1), b -> filter(ps, (x, i) -> (shiftright(b, i) & 1) = 1))")
    parts = sets.filter(F.size("ps") <= wide).select("key", "size", F.explode(subsets).alias("t")).select(
        "key", "size", F.sha2(F.array_join(F.col("t").cast("array<string>"), ","), 256).alias("t"), (F.size("t") % 2 * 2 - 1).alias("sign"))
    parts = cut(parts)
    total = parts.join(shuffled(parts.groupBy("t").agg(F.sum("size").alias("all"))), "t").groupBy("key").agg(F.sum(F.col("sign") * F.col("all")).alias("n"))
    member = sets.select("key", "size", (F.size("ps") > wide).alias("w"), F.explode("ps").alias("p"))
    large, other = member.filter("w"), member.select(F.col("key").alias("o"), F.col("size").alias("os"), F.col("w").alias("ow"), "p")
    met = (large.join(other, "p").select("key", F.col("o").alias("by"), F.col("os").alias("n"))
           .unionByName(other.filter("NOT ow").join(large, "p").select(F.col("o").alias("key"), F.col("key").alias("by"), F.col("size").alias("n"))))
    total = total.unionByName(met.distinct().select("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    # relatives up or down that share a parent are no siblings
    inner = e.join(shuffled(e.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
    beside = reachability.as_bits(inner.select(F.col("dst").alias("p"), "src"), "p", "src").withColumnRenamed("bits", "kids")
    near = (up.join(shuffled(e.select("src", F.col("dst").alias("p"))), "src").join(shuffled(beside), ["p", "block"])
            .groupBy("src", "block").agg(F.bit_or(F.col("bits").bitwiseAND(F.col("kids"))).alias("bits")))
    near = cut(reachability.listed(near.filter("bits <> 0")).filter("src <> dst"))
    less = near.unionByName(inv(near)).distinct().groupBy("src").agg(F.count(F.lit(1)).alias("less"))
    siblings = own.select("src", "key").join(shuffled(total), "key").join(shuffled(less), "src", "left").select(
        "src", F.lit("sibling").alias("role"), (F.col("n") - 1 - F.coalesce("less", F.lit(0))).alias("n"))
    # an entity on a cycle is above itself and not counted
    block, bit = reachability.bit_of("src")
    bit = F.when(F.col("block") == block, bit).otherwise(F.lit(0).cast("long"))
    others = up.select("src", "block", F.col("bits").bitwiseAND(F.bitwise_not(bit)).alias("bits"))
    above = others.groupBy("src").agg(F.lit("ancestor").alias("role"), F.sum(F.bit_count("bits").cast("long")).alias("n"))
    # many entities have the same bits of a block
    alike = others.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("n"))
    below = reachability.listed(alike, "n").groupBy(F.col("dst").alias("src")).agg(F.lit("descendant").alias("role"), F.sum("n").alias("n"))
    child = e.filter("src <> dst").groupBy(F.col("dst").alias("src")).agg(F.lit("child").alias("role"), F.count(F.lit(1)).alias("n"))
    out = above.unionByName(child).unionByName(below).unionByName(siblings).filter("n > 0")
    return out.join(shuffled(seeds.select(F.col("id").alias("src"), F.col("node").alias("iri"))), "src").select("iri", "role", "n")


def context_fingerprint(context: DataFrame) -> DataFrame:
    """Order-free SHA-256 signature of each entity's context."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("\u0001", "role", "relative")), 1, 15), 16, 10).cast("decimal(20,0)")
    sums = context.groupBy("iri").agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("d"))
    return sums.select("iri", "n", F.sha2(F.concat_ws("\u0001", "iri", F.col("n").cast("string"), F.col("d").cast("string")), 256).alias("fingerprint"))


def validate_synonyms(values: DataFrame, quads: DataFrame, names: DataFrame) -> DataFrame:
    """``values(iri, id, value)`` with a verdict: ok, self, repeated, recorded."""
    # one shuffle by entity and key: a join may be planned as a broadcast from
    # the size of compressed files, and the names would go through the driver
    key, kind = ["iri", "key"], dict(values.dtypes)
    rows = values.select("iri", F.lower(F.trim("value")).alias("key"), "id", "value", F.lit(True).alias("_value"))

    def known(df: DataFrame, iri: str, text: str, name: str) -> DataFrame:
        return df.select(F.col(iri).alias("iri"), F.lower(F.trim(text)).alias("key"), F.lit(None).cast(kind["id"]).alias("id"),
                         F.lit(None).cast("string").alias("value"), F.lit(False).alias("_value"), F.lit(True).alias(name))

    recorded = quads.filter((F.col("p") == m.SEE_ALSO) & m.is_literal())
    out = rows.unionByName(known(names, "iri", "name", "_self"), True).unionByName(known(recorded, "s", "o", "_has"), True)
    w = W.partitionBy(*key)
    out = out.dropna(subset=key).select(
        "iri", "id", "value", "_value", F.max("_self").over(w).alias("_self"), F.max("_has").over(w).alias("_has"),
        F.min("id").over(w).alias("_first")).filter("_value")
    verdict = (F.when(F.col("_self"), "self").when(F.col("id") != F.col("_first"), "repeated")
               .when(F.col("_has"), "recorded").otherwise("ok"))
    return out.select("iri", "id", "value", verdict.alias("verdict"))


def seealso_matches(quads: DataFrame, show: int = 20) -> DataFrame:
    """(s, value, total, others): other entities with the same seeAlso value.

    Each value keeps its first ``show + 1`` entities, enough for every one of
    its users; users are never paired with each other.
    """
    rows = quads.filter((F.col("p") == m.SEE_ALSO) & (F.trim("o") != ""))
    key = F.concat_ws("\u0001", F.when(m.is_literal(), "lit").otherwise("res"), F.when(m.is_literal(), F.lower("o")).otherwise(F.col("o")))
    uses = cut(rows.select(F.col("s"), key.alias("value")).distinct())
    totals = uses.groupBy("value").agg((F.count(F.lit(1)) - 1).alias("total"))
    w = W.partitionBy("value").orderBy("s")
    heads = uses.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= show + 1)
    heads = heads.groupBy("value").agg(F.sort_array(F.collect_list("s")).alias("first"))   # at most show + 1
    out = uses.join(totals, "value").join(heads, "value")
    return out.select("s", "value", "total", F.slice(F.array_remove("first", F.col("s")), 1, show).alias("others"))


# -- proposals --------------------------------------------------------------

def validate_proposals(proposals: DataFrame, entities: DataFrame, parent: str, kind: str, namespace: str) -> DataFrame:
    """``proposals(id, label, kind, parent)`` with the reason to refuse."""
    key = tx.name_key(F.col("label"))
    rows = proposals.withColumn("key", key).withColumn("made", F.concat(F.lit(namespace), tx.identifier_from_label(F.col("label"))))
    fits = (F.col("kind") == kind) & (F.col("parent") == parent)
    known = entities.select(tx.name_key(F.col("label")).alias("key")).unionAll(
        entities.select(tx.name_key(tx.identifier_name(F.col("iri"))))).distinct().withColumn("_known", F.lit(True))
    iris = entities.select(F.col("iri").alias("made")).distinct().withColumn("_iri", F.lit(True))
    rows = rows.join(known, "key", "left").join(iris, "made", "left")
    usable = fits & F.col("_known").isNull() & F.col("_iri").isNull()
    first = rows.filter(usable).groupBy("key").agg(F.min("id").alias("_first"))
    rows = rows.join(first, "key", "left")
    reason = (F.when(F.col("kind") != kind, "wrong kind").when(F.col("parent") != parent, "wrong parent")
              .when(F.col("_known") | F.col("_iri"), "exists").when(F.col("id") != F.col("_first"), "repeated"))
    return rows.select("id", "label", reason.alias("refused"))


def rank_terms(entities: DataFrame, text: str, limit: int = 160) -> DataFrame:
    """Schema terms by relevance to free text: 5 per word in the label, else 2
    per word in the IRI, 1 for not being an individual."""
    words = F.regexp_extract_all(F.lower(F.lit(text)), F.lit(r"([\p{L}\p{N}]{3,})"), 1)
    label, iri = F.lower("label"), F.lower("iri")
    points = F.aggregate(words, F.lit(0), lambda n, w: n + F.when(label.contains(w), 5).when(iri.contains(w), 2).otherwise(0))
    score = F.when(F.col("kind") == "Individual", 0).otherwise(1) + points
    return entities.withColumn("score", score).orderBy(F.desc("score"), "iri").limit(limit)


def reconcile_suggestions(runs: DataFrame, quads: DataFrame, names: DataFrame) -> DataFrame:
    """Stored synonym suggestions ``(iri, id, value, applied)`` against the
    current data: status and edit distance to the name; one row per key by
    status priority, exact names dropped."""
    key = F.lower(F.trim("value"))
    has = quads.filter((F.col("p") == m.SEE_ALSO) & m.is_literal()).select(
        F.col("s").alias("iri"), F.lower(F.trim("o")).alias("key")).distinct().withColumn("_has", F.lit(True))
    rows = runs.withColumn("key", key).join(names.select("iri", "name"), "iri", "left").join(has, ["iri", "key"], "left")
    status = (F.when(F.col("applied"), "added").when(F.col("_has"), "exists")
              .when(F.col("name").isNull(), "unavailable").otherwise("available"))
    priority = F.create_map(*[F.lit(x) for kv in (("added", 0), ("exists", 1), ("available", 2), ("unavailable", 3)) for x in kv])
    rows = rows.withColumn("status", status).withColumn("distance", tx.text_distance(F.coalesce("name", "value"), F.col("value")))
    rows = rows.filter((F.col("distance") > 0) | F.col("name").isNull())
    best = F.min_by(F.struct("id", "value", "status", "distance"), F.struct(priority[F.col("status")].alias("p"), "id"))
    return rows.groupBy("iri", "key").agg(best.alias("b")).select("iri", "key", "b.*")


def sort_suggestions(rows: DataFrame, column: str = "distance", ascending: bool = True,
                     status: str = "all", text: str = "") -> DataFrame:
    """Filter by status and text; missing semantic distances stay last."""
    if status != "all":
        rows = rows.filter(F.col("status") == status)
    q = text.strip().lower()
    if q:
        rows = rows.filter(F.lower("label").contains(q))
    order = F.create_map(*[F.lit(x) for kv in (("available", 0), ("added", 1), ("exists", 2), ("unavailable", 3)) for x in kv])
    key = {"status": order[F.col("status")], "distance": F.coalesce("distance", F.lit(0)),
           "semantic_distance": F.col("semantic_distance") if "semantic_distance" in rows.columns else F.lit(0),
           "label": F.lower("label")}[column]
    return rows.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), F.lower("label"), "label")


def default_predicate(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """``pairs(source, target)`` with the relation their kinds suggest."""
    rows = (pairs.join(kinds.select(F.col("iri").alias("source"), F.col("kind").alias("ks")), "source", "left")
            .join(kinds.select(F.col("iri").alias("target"), F.col("kind").alias("kt")), "target", "left"))
    a, b = F.col("ks").isin("Class", "Defined"), F.col("kt").isin("Class", "Defined")
    predicate = (F.when(a & b, m.SUBCLASS).when((F.col("ks") == "Individual") & b, m.TYPE)
                 .when(F.col("ks").endswith("Property") & (F.col("ks") == F.col("kt")), m.SUBPROPERTY))
    return rows.select("source", "target", predicate.alias("predicate"))


def merge_parent_options(phrase: DataFrame, suggested: DataFrame, found: DataFrame, classes: DataFrame,
                         used: DataFrame | None = None, show: int = 8) -> DataFrame:
    """(id, iri, source): options from the phrase, then suggestions, then
    ``show`` classes found by search, each once per draft.

    The inputs are ``(id, iri, rank)``.
    """
    parts = [phrase.withColumn("source", F.lit(0)), suggested.withColumn("source", F.lit(1)), found.withColumn("source", F.lit(2))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(classes.select("iri"), "iri", "left_semi")
    if used is not None:
        rows = rows.join(used.select("id", "iri"), ["id", "iri"], "left_anti")
    best = rows.groupBy("id", "iri").agg(F.min(F.struct("source", "rank")).alias("b")).select("id", "iri", "b.source", "b.rank")
    searched = best.filter("source = 2")
    w = W.partitionBy("id").orderBy("rank", "iri")
    searched = searched.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= show).drop("n")
    return best.filter("source < 2").unionByName(searched).select("id", "iri", "source", "rank")
