"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (source, language, topic).  Cell weights are
raked to the target share of every source, language and topic in turn; then
documents are sampled with probabilities proportional to their cell's weight,
scaled to a token budget.  DataFrame functions only; the documents are read
twice and never shuffled, as cells are small tables that AQE or the planner
broadcasts by measured size and else joins by their keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille.llm.common import col, cut, written

DIMENSIONS = ("source", "lang", "topic")
ONE_TASK_CELLS = 100_000


@dataclass(frozen=True)
class Mix:
    """targets: per dimension either the shares of its values (a value without
    one gets none; shares of values that occur are normalised), or an exponent:
    the natural shares raised to it, normalised.  budget: share of all tokens
    to keep.  rounds: passes over the dimensions."""

    targets: dict[str, dict[str, float] | float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.9})
    budget: float = 0.7
    rounds: int = 8
    scale_rounds: int = 4
    seed: str = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def register(text: Column) -> Column:
    """A coarse topic from the text alone: markup, numeric, brief or prose; null text: null."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    size = F.length(text)
    return (F.when(text.isNull(), F.lit(None)).when(symbols * 50 > size, "markup").when(digits * 50 > size, "numeric")
            .when(size < 600, "brief").otherwise("prose"))


def uniform(seed: str, doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the id only."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """A join on equal names in which null equals null; ``right`` adds its other columns."""
    r = right.select(*[F.col(n).alias(f"__r_{n}") if n in names else F.col(n) for n in right.columns])
    on = None
    for n in names:
        e = left[n].eqNullSafe(r[f"__r_{n}"])
        on = e if on is None else on & e
    return left.join(r, on, how).drop(*[f"__r_{n}" for n in names])


def _margins(cells: DataFrame, dim: str, target: dict[str, float] | float) -> DataFrame:
    """(dim, wanted): the tokens each value should weigh, all of them summing to the whole."""
    per = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    if isinstance(target, dict):
        rows = [(k, float(v)) for k, v in target.items()]
        given = cells.sparkSession.createDataFrame(rows, f"`{dim}` string, share double")
        per = _same(per, given, [dim]).withColumn("raw", F.coalesce("share", F.lit(0.0)))
    else:
        per = per.withColumn("raw", F.pow(F.col("t").cast("double"), F.lit(float(target))))
    per = cut(per.select(dim, "t", "raw"))
    total, raw = per.agg(F.sum("t"), F.sum("raw")).first()     # one row
    return per.select(dim, (F.col("raw") / F.lit(raw or 1.0) * F.lit(float(total or 0))).alias("wanted"))


def weighted_cells(cells: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with their raked weight and the
    sampling probability.

    Zero-token cells get weight 1 and are carried along.  A value whose target
    is zero gets weight zero; targets that no weights can meet are met as
    nearly as the last pass leaves them.  Up to ONE_TASK_CELLS cells, counted
    first, are raked in one task without a shuffle; more are raked by grouped
    sums that are joined back, with a checkpoint each time.
    """
    dims = [d for d in DIMENSIONS if d in mix.targets]
    few = cells.count() <= ONE_TASK_CELLS
    now = cells.coalesce(1) if few else cells
    for d in dims:
        now = _same(now, _margins(cells, d, mix.targets[d]).withColumnRenamed("wanted", f"wanted_{d}"), [d])
    now = cut(now.coalesce(1) if few else now).withColumn("weight", F.lit(1.0))
    for _ in range(mix.rounds):
        for d in dims:
            mass = F.sum(F.col("tokens") * F.col("weight"))
            if few:
                now = now.withColumn("have", mass.over(W.partitionBy(d)))
            else:
                now = _same(now, now.groupBy(d).agg(mass.alias("have")), [d])
            factor = F.when(F.col("have") > 0, F.col(f"wanted_{d}") / F.col("have")).otherwise(1.0)
            now = now.withColumn("weight", F.col("weight") * factor).drop("have")
            now = now if few else cut(now)
    now = cut(now)
    total = now.agg(F.sum("tokens")).first()[0] or 0
    aim, scale = mix.budget * total, 0.0
    capped = F.lit(False)
    for _ in range(mix.scale_rounds):     # probabilities end at one; the rest takes up what that leaves
        t, w = F.col("tokens"), F.col("weight")
        full, rest = now.agg(F.sum(F.when(capped, t).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(t * w))).first()
        scale = (aim - (full or 0)) / rest if rest else 0.0
        capped = capped | (w * scale >= 1)
    probability = F.when(capped, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight") * scale)))
    return now.withColumn("probability", probability)


def sampled(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text",
            source: str = "source", lang: str = "lang", topic: Column | None = None, into: str = "mix") -> DataFrame:
    """``docs`` with a struct ``into``: source, lang, topic, n_tokens, probability, kept.

    Tokens are words; ``topic`` defaults to :func:`register`.  A null source,
    language or topic is a value of its own.  Rows with the same id share one
    random number; a null id counts as the empty one.  A column called
    ``into`` is replaced, all others stay.
    """
    own = [c for c in docs.columns if c != into]
    keys = {"source": col(source), "lang": col(lang), "topic": register(col(text)) if topic is None else topic}
    cells = docs.select(*[c.cast("string").alias(k) for k, c in keys.items()], n_words(col(text)).alias("n"))
    cells = written(cells.groupBy(*keys).agg(F.sum("n").alias("tokens")), "mix-cells")
    weights = written(weighted_cells(cells, mix).select(*keys, "probability"), "mix-weights")
    rows = docs.select(F.struct(*[col(c) for c in own]).alias("__row"), *[c.cast("string").alias(k) for k, c in keys.items()],
                       n_words(col(text)).alias("n_tokens"), uniform(mix.seed, col(doc_id)).alias("u"))
    rows = _same(rows, weights, list(keys))
    return rows.select(*[F.col("__row")[c].alias(c) for c in own],
                       F.struct(*keys, "n_tokens", "probability", (F.col("u") < F.col("probability")).alias("kept")).alias(into))


def keep_sampled(docs: DataFrame, mix: Mix = Mix(), **columns) -> DataFrame:
    """The sampled rows of ``docs``, with their columns unchanged."""
    own = docs.columns
    return sampled(docs, mix, into="__mix", **columns).filter(F.col("__mix.kept")).select(*[col(c) for c in own])
