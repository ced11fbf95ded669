"""Aggregates over terms, dataset censuses and per-group rankings.

The term aggregates are Column expressions for ``groupBy().agg``; all combine
map-side, so a hot group key costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille import model as m
from quadrille.functions import terms as t, text as tx
from quadrille.session import cut, group_index


# -- term aggregates --------------------------------------------------------

def group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """GROUP BY; without keys there is always exactly one group."""
    cols = [c.alias(n) for n, c in aggs.items()]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def count(c: Column | None = None) -> Column:
    return t.literal(F.count(F.lit(1) if c is None else c), t.INTEGER)


def count_distinct(*cs: Column) -> Column:
    """COUNT(DISTINCT ...) of a term or of whole rows."""
    return t.literal(F.countDistinct(F.struct(*cs)) if len(cs) > 1 else F.countDistinct(cs[0]), t.INTEGER)


def _promoted(c: Column) -> Column:
    kind = c["datatype"]
    rank = F.max(F.when(kind == t.DOUBLE, 3).when(kind == t.FLOAT, 2).when(kind == t.DECIMAL, 1).otherwise(0))
    return (F.when(rank == 3, t.DOUBLE).when(rank == 2, t.FLOAT)
            .when(rank == 1, t.DECIMAL).otherwise(t.INTEGER))


def _no_errors(c: Column) -> Column:
    """True while every member of the group is a number."""
    return F.count(F.lit(1)) == F.count(t.double_value(c))


def _all(value: Column) -> Column:
    return F.count(value) == F.count(F.lit(1))


def sum_(c: Column, distinct: bool = False) -> Column:
    """SUM with promotion; one non-numeric member makes it unbound, an empty
    group gives 0.

    Integers add exactly up to 38 digits, decimals with up to 20 digits before
    and 18 after the point; a sum beyond is an error.
    """
    add = F.sum_distinct if distinct else F.sum
    zero = F.lit(0).cast("decimal(38,18)")
    value = (F.when(_all(t.integer_value(c)), F.coalesce(add(t.integer_value(c)), F.lit(0).cast("decimal(38,0)")).cast("string"))
             .when(_all(t.decimal_value(c)), t._number_text(F.coalesce(add(t.decimal_value(c)), zero)))
             .otherwise(add(t.double_value(c)).cast("string")))
    return F.when(_no_errors(c), t.literal(value, _promoted(c)))


def _mean_text(total: Column, n: Column) -> Column:
    """Quotient of a whole number of up to 38 digits to 18 places, rounded half up.

    Long division in groups of 18 digits: each quotient fits a long, each
    remainder with the next group 38 digits.
    """
    wide = lambda x: x.cast("decimal(38,0)")
    div = lambda a, b: F.call_function("div", a, b)
    group_, count_ = F.lit(10 ** 18).cast("decimal(19,0)"), n.cast("decimal(18,0)")
    digits = F.lpad(F.abs(total).cast("string"), 54, "0")
    whole, rest = [], F.lit(0).cast("decimal(18,0)")
    for k in range(3):
        now = wide(wide(rest * group_) + F.substring(digits, 18 * k + 1, 18).cast("decimal(18,0)"))
        whole.append(div(now, count_))
        rest = (now % count_).cast("decimal(18,0)")
    part = div(wide(wide(rest * group_) * 2) + count_, count_ * 2)
    # below 10**18 members a fraction never rounds up to one
    text = F.concat(whole[0].cast("string"), F.lpad(whole[1].cast("string"), 18, "0"), F.lpad(whole[2].cast("string"), 18, "0"), F.lit("."),
                    F.lpad(part.cast("string"), 18, "0"))
    plain = F.regexp_replace(F.regexp_replace(text, r"^0+(?=\d)", ""), r"\.?0+$", "")
    return F.when((total < 0) & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain)


def avg_(c: Column, distinct: bool = False) -> Column:
    """AVG: integers average to a decimal; an empty group gives 0.

    Integers of up to 38 digits average exactly to 18 places.
    """
    add = F.sum_distinct if distinct else F.sum
    n = F.countDistinct if distinct else F.count
    pick = (lambda x: F.sum_distinct(x) / F.countDistinct(x)) if distinct else F.avg
    exact = F.coalesce(pick(t.decimal_value(c)).cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))
    kind = _promoted(c)
    kind = F.when((kind == t.INTEGER) & (F.count(F.lit(1)) > 0), t.DECIMAL).otherwise(kind)
    whole = t.integer_value(c)
    value = (F.when(F.count(F.lit(1)) == 0, "0").when(_all(whole), _mean_text(add(whole), n(whole)))
             .when(_all(t.decimal_value(c)), t._number_text(exact)).otherwise(pick(t.double_value(c)).cast("string")))
    return F.when(_no_errors(c), t.literal(value, kind))


def min_(c: Column) -> Column:
    return F.min_by(c, F.when(c.isNotNull(), t.order_key(c)))


def max_(c: Column) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), t.order_key(c)))


def sample_(c: Column) -> Column:
    """SAMPLE may return any member; the smallest keeps reruns equal."""
    return F.min(c)


def group_concat(c: Column, separator: str = " ", distinct: bool = False) -> Column:
    """GROUP_CONCAT of the lexical forms, in sorted order for determinism."""
    gather = F.collect_set if distinct else F.collect_list
    return t.literal(F.array_join(F.sort_array(gather(c["value"])), separator))


def having(df: DataFrame, *conds: Column) -> DataFrame:
    for c in conds:
        df = df.filter(c)
    return df


# -- censuses ---------------------------------------------------------------

def column_census(df: DataFrame) -> DataFrame:
    """Per result column: fill, distinct terms and the reason to hide it."""
    stats = []
    for c in df.columns:
        v = F.col(c)
        key = F.when(v.isNotNull(), m.equality_key(v["value"], v["kind"], v["datatype"], v["lang"]))
        stats += [F.count(v).alias(f"{c}__fill"), F.countDistinct(key).alias(f"{c}__distinct")]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *stats)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"{c}__fill").alias("fill"),
                 F.col(f"{c}__distinct").alias("distinct")) for c in df.columns]))
    long = wide.select("rows", rows.alias("r")).select("rows", "r.*")
    reason = (F.when(F.col("fill") == 0, "empty")
              .when(F.col("distinct") == 1, "constant")
              .when((F.col("fill") == F.col("rows")) & (F.col("distinct") == F.col("rows")), "unique"))
    return long.withColumn("reason", reason)


def predicate_counts(quads: DataFrame) -> DataFrame:
    """Uses per predicate; rdfs:label first, then by count."""
    counts = quads.groupBy("p").agg(F.count(F.lit(1)).alias("uses"))
    return counts.orderBy(F.col("p") != m.LABEL, F.desc("uses"), "p")


def predicate_options(quads: DataFrame, entities: DataFrame) -> DataFrame:
    """Predicates to offer: used ones by count, then declared but unused.

    rdf:type is never offered.
    """
    used = quads.filter(F.col("p") != m.TYPE).groupBy("p").agg(F.count(F.lit(1)).alias("uses"))
    declared = entities.filter(F.col("kind").isin(m.PROPERTY_KINDS) & (F.col("iri") != m.TYPE)).select(
        F.col("iri").alias("p"))
    out = used.join(declared, "p", "full").select("p", F.coalesce("uses", F.lit(0)).alias("uses"))
    return out.orderBy(F.desc("uses"), "p")


VOCABULARIES = {"rdfs": m.RDFS, "owl": m.OWL, "skos": m.SKOS, "dc": m.DC, "dcterms": m.DCTERMS,
                "iao": m.OBO + "IAO_"}


def vocabulary_census(quads: DataFrame) -> DataFrame:
    """Standard-vocabulary IRIs in use, as predicates or as type objects."""
    used = quads.select(F.col("p").alias("iri")).unionAll(
        quads.filter((F.col("p") == m.TYPE) & m.is_resource()).select("o"))
    vocabulary = F.lit(None).cast("string")
    for name, base in VOCABULARIES.items():
        vocabulary = F.coalesce(vocabulary, F.when(F.col("iri").startswith(base), F.lit(name)))
    return (used.withColumn("vocabulary", vocabulary).filter("vocabulary is not null")
            .groupBy("vocabulary", "iri").agg(F.count(F.lit(1)).alias("uses")))


def kind_census(entities: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    if scope is not None:
        entities = entities.join(scope, "iri", "left_semi")
    return entities.groupBy("kind").agg(F.count(F.lit(1)).alias("entities"))


def totals(quads: DataFrame, entities: DataFrame) -> DataFrame:
    """Dataset totals in one row."""
    kinds = entities.agg(
        F.count_if(F.col("kind").isin(m.CLASS_KINDS)).alias("classes"),
        F.count_if(F.col("kind").isin(m.PROPERTY_KINDS)).alias("properties"),
        F.count_if(F.col("kind") == "Individual").alias("individuals"))
    return kinds.withColumn("triples", quads.agg(F.count(F.lit(1))).scalar())


def individual_values(quads: DataFrame, labels: DataFrame, cls: str | None = None,
                      own_namespace: str = "") -> DataFrame:
    """Distinct display values (iri, p, value, pos) of the instances of a class."""
    typed = quads.filter((F.col("p") == m.TYPE) & m.is_resource())
    if cls is not None:
        typed = typed.filter(F.col("o") == cls)
    rows = quads.join(typed.select("s").distinct(), "s", "left_semi")
    named = labels.select(F.col("iri").alias("o"), F.col("label").alias("_label"))
    plain = rows.filter(m.is_literal()).select("s", "p", F.col("o").alias("value"), "pos")
    linked = rows.filter(m.is_resource()).join(named, "o", "left").select(
        "s", "p", F.coalesce("_label", tx.compact_iri(F.col("o"), own_namespace)).alias("value"), "pos")
    return (plain.unionAll(linked).groupBy(F.col("s").alias("iri"), "p", "value")
            .agg(F.min("pos").alias("pos")))


def individual_census(values: DataFrame, total: Column | None = None) -> DataFrame:
    """Per predicate: fill, distinct values, deepest cell, identifier test.

    ``values`` comes from ``individual_values``.  A column holds identifiers
    when over 90 % of its values look like ``Q123`` and some row lacks it.
    """
    cells = values.groupBy("p", "iri").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").rlike("^Q[0-9]+$")).alias("q"))
    cells = cells.groupBy("p").agg(
        F.count(F.lit(1)).alias("fill"), F.max("n").alias("max_values"),
        F.sum("n").alias("_n"), F.sum("q").alias("_q"))
    distinct = values.groupBy("p").agg(F.countDistinct("value").alias("distinct"))
    rows = values.agg(F.countDistinct("iri")).scalar() if total is None else total
    out = cells.join(distinct, "p").withColumn("rows", rows)
    return out.select("p", "fill", "distinct", "max_values", "rows",
                      ((F.col("_q") / F.col("_n") > 0.9) & (F.col("fill") < F.col("rows"))).alias("identifiers"))


def _unique() -> Column:
    return (F.col("fill") == F.col("rows")) & (F.col("distinct") == F.col("rows"))


def default_columns(census: DataFrame, limit: int) -> DataFrame:
    """Columns shown at first: well filled, varied, not unique per row."""
    fit = ((F.col("p") != m.LABEL) & (F.col("fill") / F.col("rows") >= 0.05)
           & (F.col("distinct") > 1) & ~_unique())
    return census.filter(fit).orderBy("identifiers", F.desc("fill"), "p").limit(limit)


def column_reasons(census: DataFrame) -> DataFrame:
    flags = F.array_compact(F.array(
        F.when(F.col("fill") == 0, "no values").when(F.col("distinct") == 1, "one value")
        .when(_unique(), "unique per row"),
        F.when((F.col("fill") > 0) & (F.col("fill") / F.col("rows") < 0.05), "sparse"),
        F.when(F.col("identifiers"), "identifiers"),
        F.when(F.col("max_values") > 1, F.concat(F.col("max_values").cast("string"), F.lit(" values deep"))),
    ))
    return census.withColumn("reasons", flags)


ROW_VALUES = 10_000


def pivot_individuals(values: DataFrame) -> DataFrame:
    """(iri, part, values): map of predicate to its display values.

    One row per individual; one with more than ``ROW_VALUES`` values is split
    into several parts, so no task has to hold a hub whole.
    """
    hubs = values.groupBy("iri").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > ROW_VALUES)
    hubs = hubs.select("iri", F.ceil(F.col("_n") / ROW_VALUES).alias("_parts"))
    rows = values.join(hubs, "iri", "left").withColumn(
        "part", F.pmod(F.xxhash64("p", "value"), F.coalesce("_parts", F.lit(1))))
    cells = rows.groupBy("iri", "part", "p").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_v"))
    cells = cells.withColumn("_v", F.transform("_v", lambda v: v["value"]))
    entries = F.array_sort(F.collect_list(F.struct(F.col("p").alias("key"), F.col("_v").alias("value"))))
    return cells.groupBy("iri", "part").agg(F.map_from_entries(entries).alias("values"))


def group_statements(quads: DataFrame) -> DataFrame:
    """Statements with their group (subject, predicate) and place in it.

    Groups are ordered by first position; one row per statement, so a hot
    subject never becomes one huge list.
    """
    first = quads.groupBy("s", "p").agg(F.min("pos").alias("group_pos"), F.count(F.lit(1)).alias("group_size"))
    placed = group_index(quads, ["s", "p"], [F.col("pos"), F.col("o"), F.col("o_kind"), F.col("g")], "item")
    return placed.join(first, ["s", "p"])


# -- rankings ---------------------------------------------------------------

def language_rank(lang: Column) -> Column:
    return F.when(F.coalesce(lang, F.lit("")) == "", 0).when(lang.rlike(r"(?i)^en(-|$)"), 1).otherwise(2)


def preferred_label(quads: DataFrame) -> DataFrame:
    """(iri, label, lang): no language before English before others, then the
    first loaded.  A plain min of a struct, so it combines map-side."""
    labels = quads.filter((F.col("p") == m.LABEL) & m.is_literal())
    best = F.min(F.struct(language_rank(F.col("o_lang")).alias("rank"), "pos", "o", "o_lang"))
    return labels.groupBy(F.col("s").alias("iri")).agg(best.alias("b")).select(
        "iri", F.col("b.o").alias("label"), F.col("b.o_lang").alias("lang"))


def peer_mean(df: DataFrame, key: str, col: str, name: str = "peer_mean") -> DataFrame:
    """Mean of ``col`` over the *other* rows of the group; NULL when alone."""
    sums = df.groupBy(key).agg(F.sum(col).alias("_sum"), F.count(col).alias("_n"))
    return (df.join(sums, key)
            .withColumn(name, F.when(F.col("_n") > 1, (F.col("_sum") - F.col(col)) / (F.col("_n") - 1)))
            .drop("_sum", "_n"))


def parallel_edges(edges: DataFrame) -> DataFrame:
    """Index and number of the edges between each unordered node pair."""
    pairs = edges.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    sizes = pairs.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("edge_count"))
    placed = group_index(pairs, ["_a", "_b"], [F.col("pred"), F.col("src"), F.col("dst")], "edge_index")
    return placed.join(sizes, ["_a", "_b"]).drop("_a", "_b")


def mint_iris(names: DataFrame, existing: DataFrame, namespace: str) -> DataFrame:
    """New IRIs for ``names(id, label)``: the identifier, then suffix 2, 3 ...

    The i-th row of a stem takes the i-th suffix that ``existing(iri)`` leaves
    free.  Merging "used" and "new" in one order makes that suffix simply the
    row's place, so even one stem shared by most rows is split over tasks.
    Stems that clash across each other (``A`` + 2 against ``A2``) are retried.
    """
    todo = names.select("id", F.concat(F.lit(namespace), tx.identifier_from_label(F.col("label"))).alias("stem"))
    taken, done = existing.select("iri"), None
    while True:
        stems = todo.select("stem").distinct()
        digits = F.regexp_extract("iri", r"([0-9]*)$", 1)
        plain = taken.select(F.col("iri").alias("stem"), F.lit(1).cast("long").alias("n"))
        # every way to read trailing digits as a suffix: Foo12 = Foo + 12 = Foo1 + 2
        cuts = taken.filter(digits != "").select("iri", F.explode(F.sequence(F.lit(1), F.length(digits))).alias("w"))
        read = cuts.select(F.expr("left(iri, length(iri) - w)").alias("stem"), F.expr("right(iri, w)").alias("d"))
        read = read.filter(~F.col("d").startswith("0")).select("stem", F.col("d").try_cast("long").alias("n"))
        split = plain.unionAll(read.filter("n > 1")).distinct()
        used = split.join(stems, "stem", "left_semi")
        used = group_index(used, ["stem"], [F.col("n")], "j").select(
            "stem", (F.col("n") - F.col("j") + 1).alias("key"), F.lit(0).alias("is_new"), F.lit(None).cast("long").alias("id"))
        new = group_index(todo, ["stem"], [F.col("id")], "i").select(
            "stem", F.col("i").alias("key"), F.lit(1).alias("is_new"), F.col("id").cast("long").alias("id"))
        placed = group_index(used.unionAll(new), ["stem"],
                             [F.col("key"), F.col("is_new"), F.col("id")], "n").filter("is_new = 1")
        made = placed.select("id", "stem", F.when(F.col("n") == 1, F.col("stem")).otherwise(
            F.concat("stem", F.col("n").cast("string"))).alias("iri"))
        winners = made.groupBy("iri").agg(F.min("id").alias("_win"))
        made = cut(made.join(winners, "iri").withColumn("ok", F.col("id") == F.col("_win")))
        kept = made.filter("ok").select("id", "iri")
        done = kept if done is None else done.unionAll(kept)
        todo = made.filter("not ok").select("id", "stem")
        if todo.isEmpty():
            return done
        taken = taken.unionAll(kept.select("iri"))


def sample_terms(df: DataFrame, key: str, iri: str, n: int = 20) -> DataFrame:
    """A repeatable sample of at most ``n`` rows per key, by hash order.

    ``row_number <= n`` lets Spark prune each task's share of a hot key before
    the shuffle.
    """
    order = F.md5(F.concat_ws("\u0001", F.col(key), F.col(iri)))
    w = W.partitionBy(key).orderBy(order, F.col(iri))
    return df.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= n)


def entity_paths(parents: DataFrame, max_hops: int) -> DataFrame:
    """Primary recorded route of every entity, child first.

    ``parents(iri, parent, parent_label)``; the parent first in label order
    wins.  A repeated node ends the path and marks it as a cycle.
    """
    order = F.struct(F.lower("parent_label"), F.col("parent_label"), F.col("parent"))
    first = cut(parents.groupBy("iri").agg(F.min_by("parent", order).alias("parent")))
    # nodes that some path reaches after k hops: few, since many share a parent
    levels = [first]
    while len(levels) <= max_hops:
        nodes = levels[-1].filter("parent IS NOT NULL").select(F.col("parent").alias("iri")).distinct()
        level = cut(nodes.join(first, "iri", "left"))
        if level.isEmpty():
            break
        levels.append(level)
    # a path is its first node and the path of the next, up to the same node again
    paths = levels.pop().select("iri", F.array("iri").alias("path"), F.lit(False).alias("cycle"))
    for level in reversed(levels):
        above = paths.select(F.col("iri").alias("parent"), F.col("path").alias("_up"), F.col("cycle").alias("_cycle"))
        at = F.array_position("_up", F.col("iri")).cast("int")
        up = F.when(at > 0, F.slice("_up", F.lit(1), at - 1)).otherwise(F.col("_up"))
        paths = level.join(above, "parent", "left").select(
            "iri", F.when(F.col("_up").isNull(), F.array("iri")).otherwise(F.concat(F.array("iri"), up)).alias("path"),
            F.coalesce((at > 0) | F.col("_cycle"), F.lit(False)).alias("cycle"))
    return paths
