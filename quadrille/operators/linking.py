"""Links from entities to external resources: context, ranking, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.functions import vectors as vec

# Relations a link may use and hosts it may point to.
LINK_PREDICATES = [m.SKOS + n for n in ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")]
LINK_TARGETS = (r"^(http://dbpedia\.org/resource/[^?#]+|http://www\.wikidata\.org/entity/Q[1-9]\d*"
                r"|https://en\.wikipedia\.org/wiki/[^?#]+)$")
ALIASES = [m.LABEL, m.PREF, m.ALT, m.SEE_ALSO]


def link_context(quads: DataFrame, labels: DataFrame) -> DataFrame:
    """(iri, role, value): aliases, parent labels and present links of every
    named entity, one row per value."""
    rows = quads.filter(~m.is_bnode(F.col("s")))
    aliases = rows.filter(m.is_literal() & F.col("p").isin(ALIASES)).select("s", F.lit("alias").alias("role"), F.col("o").alias("value"))
    named = labels.select(F.col("iri").alias("o"), "label")
    parents = rows.filter(m.is_resource() & F.col("p").isin(m.SUBCLASS, m.SUBPROPERTY, m.TYPE)).join(named, "o", "left").select(
        "s", F.lit("parent").alias("role"), F.coalesce("label", "o").alias("value"))
    links = rows.filter(m.is_resource() | (F.col("o_datatype") == m.XSD + "anyURI")).select(
        "s", F.lit("link").alias("role"), F.concat_ws(" ", "p", "o").alias("value"))
    return aliases.unionAll(parents).unionAll(links).distinct().withColumnRenamed("s", "iri")


def rank_candidates(candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """``candidates(iri, id, rank, vector)`` by similarity to the entity's
    ``contexts(iri, vector)``; the provider's rank decides otherwise."""
    rows = candidates.join(contexts.select("iri", F.col("vector").alias("_own")), "iri", "left")
    similarity = F.when(F.col("_own").isNotNull() & F.col("vector").isNotNull(), vec.cosine(F.col("vector"), F.col("_own")))
    return rows.withColumn("similarity", similarity).drop("_own", "vector").orderBy(
        "iri", F.col("similarity").desc_nulls_last(), "rank")


def link_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, "_", " ")), r"\s+", " "))


def suggest_relation(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """exactMatch when a name of the candidate is a name of the entity.

    ``candidates(iri, id, name)`` has one row per title or redirect,
    ``names(iri, name)`` one per label or alias.
    """
    own = names.select("iri", link_name(F.col("name")).alias("k")).distinct()
    hit = candidates.withColumn("k", link_name(F.col("name"))).join(own, ["iri", "k"], "left_semi").select(
        "iri", "id").distinct().withColumn("_hit", F.lit(True))
    rows = candidates.select("iri", "id").distinct().join(hit, ["iri", "id"], "left")
    return rows.select("iri", "id", F.when(F.col("_hit"), m.SKOS + "exactMatch").otherwise(m.SKOS + "closeMatch").alias("predicate"))


def accept_links(links: DataFrame, quads: DataFrame, kinds: DataFrame) -> DataFrame:
    """Refusal reason per proposed link ``(id, iri, predicate, target,
    disambiguation)``; NULL means accepted."""
    first = links.groupBy("iri", "predicate", "target").agg(F.min("id").alias("_first"))
    have = quads.filter(m.is_resource()).select(F.col("s").alias("iri"), F.col("p").alias("predicate"), F.col("o").alias("target")
                                                ).distinct().withColumn("_have", F.lit(True))
    rows = (links.join(first, ["iri", "predicate", "target"]).join(have, ["iri", "predicate", "target"], "left")
            .join(kinds.select("iri", "kind"), "iri", "left"))
    allowed = F.col("predicate").isin([*LINK_PREDICATES, m.SEE_ALSO]) | (
        (F.col("predicate") == m.OWL + "sameAs") & (F.col("kind") == "Individual"))
    reason = (F.when(F.col("kind").isNull() | m.is_bnode(F.col("iri")), "no entity").when(F.col("disambiguation"), "disambiguation")
              .when(~allowed, "predicate").when(~F.col("target").rlike(LINK_TARGETS), "target")
              .when(F.col("id") != F.col("_first"), "repeated").when(F.col("_have"), "exists"))
    return rows.select("id", "iri", "predicate", "target", reason.alias("refused"))
