"""Graph patterns: scans, filters, natural joins, OPTIONAL, MINUS, EXISTS, GRAPH.

A solution table has one term-struct column per variable; unbound is NULL.
Shared variables are equi-join keys, so Spark hashes or sorts on them and AQE
broadcasts a side only when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.functions import terms as t
from quadrille.functions.text import local_name
from quadrille.session import cut


# -- scans ------------------------------------------------------------------

def _is_var(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


def scan(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None,
         g: str | None = None, o_kind: str | None = None) -> DataFrame:
    """Triple-pattern scan: bound positions become pushed-down filters."""
    for col, value in (("p", p), ("s", s), ("o", o), ("g", g), ("o_kind", o_kind)):
        if value is not None:
            quads = quads.filter(F.col(col) == value)
    return quads


def match(quads: DataFrame, s: str, p: str, o: str | Column, g: str | None = None) -> DataFrame:
    """One triple pattern to a solution table.

    ``?name`` is a variable, any other text an IRI; ``o`` may also be a
    literal term built by ``terms.literal``.  Bag semantics are kept.
    """
    if isinstance(o, Column):
        quads = quads.filter(t.same_term(t.object_term(), o))
        o = ""
    parts = (("s", s), ("p", p), ("o", o), ("g", g))
    out: dict[str, Column] = {}
    for col, part in parts:
        if not part:
            continue
        if not _is_var(part):
            quads = quads.filter(F.col(col) == part)
            if col == "o":
                quads = quads.filter(m.is_resource())
            continue
        value = t.object_term() if col == "o" else t.resource(F.col(col))
        name = part[1:]
        if name in out:   # the same variable twice in one pattern
            quads = quads.filter(t.same_term(out[name], value))
        else:
            out[name] = value
        if col == "g":
            quads = quads.filter(F.col("g").isNotNull())
    if not out:
        return quads.select(F.lit(True).alias("matched"))
    return quads.select(*[c.alias(n) for n, c in out.items()])


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


@dataclass(frozen=True)
class Bound:
    """A numeric FILTER on an object variable, given with its pattern: ``price < 5``.

    Stored quads have a number column; there a bound on it, pushed into the
    scan, comes before the exact comparison.
    """
    variable: str
    op: str
    value: str
    datatype: str = t.INTEGER

    def filtered(self, quads: DataFrame) -> DataFrame:
        literal = t.literal(self.value, self.datatype)
        if "num" in quads.columns:
            number = F.lit(float(self.value))
            quads = quads.filter(F.col("num") >= number if self.op in (">", ">=") else F.col("num") <= number)
        return quads.filter(t.term_cmp(t.object_term(), self.op, literal))


def _star(quads: DataFrame, patterns: list[tuple]) -> DataFrame:
    """Patterns on one subject variable: joined on the subject column itself,
    which stored quads are bucketed by, and made a term afterwards."""
    subject, out = patterns[0][0][1:], None
    for k, (_, p, o) in enumerate(patterns):
        rows = quads.filter(F.col("p") == p)
        name = o.variable if isinstance(o, Bound) else o
        if isinstance(o, Bound):
            rows = o.filtered(rows)
        elif isinstance(o, Column):
            rows = rows.filter(t.same_term(t.object_term(), o))
        elif not _is_var(o):
            rows = rows.filter((F.col("o") == o) & m.is_resource())
        rows = rows.select("s", t.object_term().alias(name[1:])) if isinstance(name, str) and _is_var(name) else rows.select("s")
        out = rows if out is None else out.join(rows, "s")
    return out.select(t.resource(F.col("s")).alias(subject), *out.columns[1:])


def _star_like(group: list[tuple]) -> bool:
    """Only subject, bound predicate and object, and no object variable twice or equal to the subject."""
    names = [o.variable if isinstance(o, Bound) else o for _, _, o in (p for p in group if len(p) == 3)]
    variables = [group[0][0]] + [n for n in names if isinstance(n, str) and _is_var(n)]
    return all(len(p) == 3 and not _is_var(p[1]) for p in group) and len(set(variables)) == len(variables)


def bgp(quads: DataFrame, patterns: list[tuple]) -> DataFrame:
    """Basic graph pattern: natural join of its triple patterns.

    Patterns are joined in the order given; each must share a variable with
    those before it.  Neighbours on one subject variable join first, on the
    subject column.  An object may be a ``Bound`` where the predicate is bound.
    """
    groups: list[list[tuple]] = []
    for p in patterns:
        if groups and _is_var(p[0]) and groups[-1][0][0] == p[0] and _star_like(groups[-1] + [p]):
            groups[-1].append(p)
        else:
            groups.append([p])
    parts = [_star(quads, g) if len(g) > 1 or isinstance(g[0][2], Bound) else match(quads, *g[0]) for g in groups]
    return reduce(natural_join, parts)


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    on = shared(left, right)
    if not on:
        raise ValueError("patterns share no variable; give theta_join a key or a band")
    return left.join(right, on, "inner")


def _masks(names: list[str]) -> list[tuple[str, ...]]:
    return [c for k in range(len(names) + 1) for c in combinations(names, k)]


def _with_mask(df: DataFrame, maybe: list[str], bound: tuple[str, ...]) -> DataFrame:
    for v in maybe:
        df = df.filter(F.col(v).isNotNull() if v in bound else F.col(v).isNull())
    return df


def join_compatible(left: DataFrame, right: DataFrame, maybe: list[str]) -> DataFrame:
    """Join of compatible mappings when the shared variables ``maybe`` can be
    unbound on either side.

    Rows are split by which of those variables are bound, so each piece is a
    hash join; a NULL-tolerant condition would force a nested loop.
    """
    certain = [v for v in shared(left, right) if v not in maybe]
    if not certain:
        raise ValueError("one shared variable must always be bound")
    pieces = []
    for a in _masks(maybe):
        for b in _masks(maybe):
            both = [v for v in maybe if v in a and v in b]
            left_part = _with_mask(left, maybe, a)
            right_part = _with_mask(right, maybe, b)
            drop_left = [v for v in maybe if v not in both and v not in a]
            drop_right = [v for v in maybe if v not in both and v in a]
            pieces.append(block_join(left_part.drop(*drop_left), right_part.drop(*drop_right), certain + both))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), pieces)


#: rows of one key that one side brings to a block, and pairs of rows that one task forms
BLOCK_ROWS, TASK_PAIRS = 4_000, 20_000_000


def block_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi-join whose hot keys are dealt over many tasks.

    The rows of a key fall into blocks of about BLOCK_ROWS on both sides; every
    pair of blocks meets once, in as many tasks as the number of pairs asks.
    """
    count = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))     # noqa: E731
    sizes = cut(count(left, "_nl").join(count(right, "_nr"), on))
    pairs = sizes.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr"))).first()[0] or 0.0
    if pairs <= TASK_PAIRS:
        return left.join(right, on)
    blocks = sizes.select(*on, F.ceil(F.col("_nl") / BLOCK_ROWS).alias("_bl"), F.ceil(F.col("_nr") / BLOCK_ROWS).alias("_br"))

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(*df.columns), F.col(n_own))
        return (df.join(blocks, on).withColumn(own, block)
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1))).drop("_bl", "_br"))

    keys = [*on, "_l", "_r"]
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(20_000, int(pairs / TASK_PAIRS) + 1))
    a = dealt(left, "_l", "_bl", "_r", "_br").repartition(tasks, *keys)
    b = dealt(right, "_r", "_br", "_l", "_bl").repartition(tasks, *keys)
    return a.join(b, keys).drop("_l", "_r")


def theta_join(left: DataFrame, right: DataFrame, equal: list[tuple[Column, Column]] | None = None,
               band: tuple[Column, Column, float] | None = None,
               condition: Column | None = None) -> DataFrame:
    """Disjoint patterns joined by a FILTER.

    ``equal`` are expression pairs that must agree; ``band`` is
    ``(left number, right number, width)`` for ``abs(l - r) <= width``, run as
    an equi-join on buckets of that width.
    """
    if not equal and not band:
        raise ValueError("a theta join needs an equality or a band to partition on")
    ls, rs, on = left, right, []
    for i, (a, b) in enumerate(equal or []):
        ls, rs = ls.withColumn(f"_k{i}", a), rs.withColumn(f"_k{i}", b)
        on.append(f"_k{i}")
    if band:
        a, b, width = band
        ls = ls.withColumn("_x", a.try_cast("double")).withColumn("_cell", F.floor(F.col("_x") / width))
        near = F.sequence(F.floor(F.col("_y") / width) - 1, F.floor(F.col("_y") / width) + 1)
        rs = rs.withColumn("_y", b.try_cast("double")).withColumn("_cell", F.explode(near))
        on.append("_cell")
    out = block_join(ls, rs, on)
    if band:
        out = out.filter(F.abs(F.col("_x") - F.col("_y")) <= band[2]).drop("_x", "_y")
    out = out.drop(*on)
    return out.filter(condition) if condition is not None else out


# -- solution operators -----------------------------------------------------

def project(df: DataFrame, *names: str, **exprs: Column) -> DataFrame:
    """SELECT: plain variables and ``(expr AS ?name)``."""
    return df.select(*names, *[c.alias(n) for n, c in exprs.items()])


def filter_(df: DataFrame, cond: Column) -> DataFrame:
    """FILTER: true keeps a row; false and error drop it."""
    return df.filter(cond)


def bind(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """BIND: a type error leaves the variable unbound."""
    if name in df.columns:
        raise ValueError(f"?{name} is already in scope")
    return df.withColumn(name, expr)


def values(df: DataFrame, rows: list[dict[str, Column | None]]) -> DataFrame:
    """Join with inline data; a missing entry is UNDEF and matches anything.

    The inline rows are part of the query text, so each becomes one branch of
    an expression and no join is planned.
    """
    names = list(dict.fromkeys(n for r in rows for n in r))
    new = [n for n in names if n not in df.columns]
    options = []
    for r in rows:
        fits = F.lit(True)
        for n, v in r.items():
            if v is not None and n in df.columns:
                fits = fits & F.coalesce(t.same_term(F.col(n), v), F.lit(True))
        filled = [(F.coalesce(F.col(n), r[n]) if r.get(n) is not None else F.col(n)).alias(n)
                  for n in names if n in df.columns]
        added = [(r[n] if r.get(n) is not None else F.lit(None).cast(m.TERM)).alias(n) for n in new]
        options.append(F.when(fits, F.struct(*filled, *added)))
    picked = F.explode(F.array_compact(F.array(*options)))
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, picked.alias("_v")).select(*keep, *[F.col(f"_v.{n}").alias(n) for n in names])


def optional(left: DataFrame, right: DataFrame, cond: Callable[[DataFrame, DataFrame], Column] | None = None) -> DataFrame:
    """OPTIONAL: left join on the shared variables, the inner FILTER in ON."""
    on = shared(left, right)
    if cond is None:
        return left.join(right, on, "left")
    keyed = right.select(*[F.col(c).alias(f"_r_{c}") for c in on],
                         *[c for c in right.columns if c not in on])
    match_on = reduce(lambda x, y: x & y, [left[c] == keyed[f"_r_{c}"] for c in on])
    return left.join(keyed, match_on & cond(left, keyed), "left").drop(*[f"_r_{c}" for c in on])


def minus(left: DataFrame, right: DataFrame, maybe: list[str] | None = None) -> DataFrame:
    """MINUS: drop a row when a right row agrees on at least one shared bound
    variable and disagrees on none."""
    on = shared(left, right)
    if not on:
        return left
    if not maybe:
        return left.join(right, on, "left_anti")
    certain = [v for v in on if v not in maybe]
    pieces = []
    for a in _masks(maybe):
        part = _with_mask(left, maybe, a)
        for b in _masks(maybe):
            keys = certain + [v for v in maybe if v in a and v in b]
            if keys:
                part = part.join(_with_mask(right, maybe, b).select(*keys), keys, "left_anti")
        pieces.append(part)
    return reduce(DataFrame.unionByName, pieces)


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    """FILTER EXISTS on the shared variables."""
    return left.join(right, shared(left, right), "left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, shared(left, right), "left_anti")


def subquery(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """``{ SELECT ... }``: evaluated alone, then joined."""
    return natural_join(outer, inner)


def graph(quads: DataFrame, name: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """GRAPH: a constant IRI filters; ``?g`` evaluates once with the graph as
    an extra join key instead of once per graph.

    For a variable, ``fn`` must thread ``g="?g"`` through its patterns.
    """
    if _is_var(name):
        return fn(quads.filter(F.col("g").isNotNull()))
    return fn(quads.filter(F.col("g") == name))


def dataset(quads: DataFrame, default: list[str] | None = None,
            named: list[str] | None = None) -> DataFrame:
    """FROM / FROM NAMED: the default graph is the merge of ``default``."""
    merged = (quads.filter(F.col("g").isin(list(default or [])))
              .withColumn("g", F.lit(None).cast("string")))
    merged = merged.groupBy(*m.STATEMENT).agg(F.min("pos").alias("pos"))
    return merged.unionByName(quads.filter(F.col("g").isin(list(named or []))))


# -- relational rows --------------------------------------------------------

def table_filter(df: DataFrame, equals: dict[str, str] | None = None,
                 text: str = "", fields: list[str] | None = None) -> DataFrame:
    """Row filter: exact columns plus a caseless substring over the fields."""
    for col, value in (equals or {}).items():
        df = df.filter(F.col(col) == value)
    q = text.strip().lower()
    if q:
        df = df.filter(F.lower(F.concat_ws(" ", *[F.col(c) for c in fields or []])).contains(q))
    return df


def substring_search(entities: DataFrame, text: str, limit: int) -> DataFrame:
    """First ``limit`` entities whose IRI or name contains the text."""
    hit = F.lower(F.concat_ws(" ", "iri", "name")).contains(text.strip().lower())
    return entities.filter(hit).orderBy("iri").limit(limit)


def validate_cells(df: DataFrame, price: str = "price", rating: str = "rating") -> DataFrame:
    """Check price and rating text; adds the parsed values and a reason each.

    Prices lie in 0-500 and round half up to pence, ratings are whole 1-5.
    """
    ptext = F.regexp_replace(F.trim(F.col(price)), "^£", "")
    pnum = F.when(ptext.rlike(r"(?i)^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$"), ptext.try_cast("double"))
    preason = (F.when(F.coalesce(ptext, F.lit("")) == "", "required").when(pnum.isNull(), "not a number")
               .when(pnum < 0, "negative").when(pnum > 500, "over limit"))
    rtext = F.trim(F.col(rating))
    rnum = rtext.try_cast("double")
    rreason = (F.when(F.coalesce(rtext, F.lit("")) == "", "required")
               .when(rnum.isNull() | (rnum != F.floor(rnum)), "not whole")
               .when(~rnum.between(1, 5), "out of range"))
    return (df.withColumn("price_reason", preason)
            .withColumn("price_value", F.when(preason.isNull(), F.floor(pnum * 100 + 0.5) / 100))
            .withColumn("rating_reason", rreason)
            .withColumn("rating_value", F.when(rreason.isNull(), rnum.cast("int"))))


def orders_with_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Foreign-key lookup of an order's customer."""
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left")


def instances(quads: DataFrame, cls: str | None = None) -> DataFrame:
    """Direct instances: (class, iri), of one class or of all."""
    typed = quads.filter((F.col("p") == m.TYPE) & m.is_resource())
    if cls is not None:
        typed = typed.filter(F.col("o") == cls)
    return typed.select(F.col("o").alias("class"), F.col("s").alias("iri")).distinct()


def instance_counts(quads: DataFrame) -> DataFrame:
    return instances(quads).groupBy("class").agg(F.count(F.lit(1)).alias("instances"))


def instance_report(quads: DataFrame, labels: DataFrame, cls: str, text: str = "",
                    start: int = 0, size: int = 100) -> DataFrame:
    """One page of a class's instances with their label and class labels.

    The page is cut before the class labels are joined, so only its rows are
    widened.  ``start`` is clamped to the last page.
    """
    base = (instances(quads, cls).select("iri").join(labels, "iri", "left")
            .withColumn("label", F.coalesce("label", local_name(F.col("iri")))))
    if text.strip():
        base = base.filter(F.lower(F.concat_ws(" ", "iri", "label")).contains(text.strip().lower()))
    total = base.count()
    offset = min(start, max(0, (total - 1) // size * size))
    page = base.orderBy("iri").offset(offset).limit(size)
    types = (page.select("iri").join(instances(quads), "iri")
             .join(labels.withColumnRenamed("iri", "class").withColumnRenamed("label", "_cl"), "class", "left")
             .groupBy("iri").agg(F.sort_array(F.collect_list(
                 F.coalesce("_cl", local_name(F.col("class"))))).alias("classes")))
    return page.join(types, "iri", "left").withColumn("filtered", F.lit(total))

