"""Entity search over a batch of queries: postings, tiers, fusion, facets.

``fields(iri, field, value)`` and ``postings(token, iri, field, tf)`` are
tables to write once.  Query tokens meet the *distinct vocabulary* by
equi-joins (prefixes and deletion neighbourhoods), never by comparing all
pairs; a frequent token therefore costs its postings and nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quadrille import model as m
from quadrille.functions import text as tx, vectors as vec
from quadrille.operators.paths import ancestry_subgraph
from quadrille.session import cut, group_index, shuffled, stored

# Words ignored in queries, field boosts, weights and limits.
STOP_WORDS = ["and", "of", "the", "for", "in", "to", "a", "an", "on", "with"]
BOOSTS = {"$label": 8.0, "$alias": 5.0, "$iri": 3.0, "$local": 3.0}
PREFIX_WEIGHT, FUZZY_WEIGHT = 0.9, 0.35
SEMANTIC_MINIMUM, SEMANTIC_FILL, SEMANTIC_GAP, RANK_CONSTANT = 0.5, 10, 0.15, 60
ALIAS_PREDICATES = [m.LABEL, m.PREF, m.ALT, m.SEE_ALSO]


# -- index tables -----------------------------------------------------------

def search_fields(quads: DataFrame, names: DataFrame, own_namespace: str = "") -> DataFrame:
    """(iri, field, value): name, aliases, identifiers and every predicate's
    values; resource values appear as label, compact form and IRI.

    ``names(iri, name)`` is the display name of every entity.
    """
    return field_rows(quads, names, own_namespace).distinct()


def field_rows(quads: DataFrame, names: DataFrame, own_namespace: str = "") -> DataFrame:
    """``search_fields`` in which a row may stand twice, for uses that count none."""
    named = names.filter(~m.is_bnode(F.col("iri")))
    iri, local = F.col("iri"), tx.local_name(F.col("iri"))
    ids = F.array_distinct(F.array(local, tx.compact_iri(iri, own_namespace), iri))
    own = named.select("iri", F.explode(F.array_append(
        F.array_prepend(F.transform(ids, lambda v: F.struct(F.lit("$iri").alias("field"), v.alias("value"))),
                        F.struct(F.lit("$label").alias("field"), F.col("name").alias("value"))),
        F.struct(F.lit("$local").alias("field"), local.alias("value")))).alias("f")).select("iri", "f.*")
    literals = quads.filter(~m.is_bnode(F.col("s")) & m.is_literal())
    plain = literals.select(F.col("s").alias("iri"), F.col("p").alias("field"), F.col("o").alias("value"))
    alias = literals.filter(F.col("p").isin(ALIAS_PREDICATES)).join(
        named.select(F.col("iri").alias("s"), F.col("name").alias("_own")), "s", "left").filter(~F.col("o").eqNullSafe(F.col("_own"))).select(
        F.col("s").alias("iri"), F.lit("$alias").alias("field"), F.col("o").alias("value"))
    linked = quads.filter(m.is_resource() & ~m.is_bnode(F.col("s"))).join(
        names.select(F.col("iri").alias("o"), F.col("name").alias("_n")), "o", "left")
    shown = F.explode(F.array_distinct(F.array_compact(F.array(
        F.col("_n"), tx.compact_iri(F.col("o"), own_namespace), F.col("o")))))
    linked = linked.select(F.col("s").alias("iri"), F.col("p").alias("field"), shown.alias("value"))
    return own.unionByName(plain).unionByName(alias).unionByName(linked).filter(F.trim("value") != "")


def _words(ascii_only: bool) -> Column:
    return F.filter(F.split(tx.normalize_search(F.col("value"), ascii_only), " "), lambda w: w != "")


def field_words(fields: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(iri, field, value, words): the distinct words of every field, for writing."""
    return fields.select("iri", "field", "value", F.array_distinct(_words(ascii_only)).alias("words"))


def postings(fields: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(token, iri, field, tf, length) for writing partitioned by token hash."""
    rows = fields.select("iri", "field", _words(ascii_only).alias("w"))
    counts = rows.select("iri", "field", F.explode("w").alias("token")).groupBy("token", "iri", "field").agg(
        F.count(F.lit(1)).alias("tf"))
    sizes = rows.groupBy("iri", "field").agg(F.sum(F.size("w")).alias("length"))
    return counts.join(sizes, ["iri", "field"])


def query_tokens(queries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(qid, norm, content, token): distinct words, stop words dropped unless
    nothing else is left."""
    norm = tx.normalize_search(F.col("text"), ascii_only)
    words = F.array_distinct(F.filter(F.split(F.col("norm"), " "), lambda w: w != ""))
    kept = F.array_except(F.col("words"), F.array(*[F.lit(w) for w in STOP_WORDS]))
    rows = queries.withColumn("norm", norm).withColumn("words", words)
    rows = rows.withColumn("kept", F.when(F.size(kept) > 0, kept).otherwise(F.col("words")))
    return rows.select("qid", "norm", F.array_join("kept", " ").alias("content"), F.explode("kept").alias("token"))


# -- term matching ----------------------------------------------------------

def _deletions(word: Column) -> Column:
    """The word and everything reachable by deleting one character."""
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(
        F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), cuts))


def _neighbourhood(word: Column, edits: int) -> Column:
    out = _deletions(word)
    for _ in range(edits - 1):
        out = F.array_distinct(F.flatten(F.transform(out, _deletions)))
    return out


def allowed_edits(token: Column) -> Column:
    return F.when(F.length(token) < 4, 0).when(F.length(token) <= 7, 1).otherwise(2)


def match_terms(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, term, how, weight): exact, prefix, then fuzzy matches.

    ``tokens(token)`` and ``vocabulary(term)`` are distinct words.  Fuzzy
    candidates share a deletion variant and are verified by edit distance, so
    the result equals a full comparison.
    """
    # tables of known size, read by each of the three ways
    asked = stored(tokens.select("token").distinct())
    terms = stored(vocabulary.select("term").distinct())
    # only prefixes as long as some token; a subquery may not sit inside a lambda
    sizes = asked.agg(F.collect_set(F.length("token"))).scalar()
    prefix = F.explode(F.transform(F.filter("_sizes", lambda n: (n > 0) & (n <= F.length("term"))), lambda n: F.substr(F.col("term"), F.lit(1), n)))
    starts = terms.withColumn("_sizes", sizes).select("term", prefix.alias("token")).join(asked, "token").select(
        "token", "term", F.when(F.col("token") == F.col("term"), "exact").otherwise("prefix").alias("how"))
    found = [starts]
    for edits in (1, 2):
        some = asked.filter(allowed_edits(F.col("token")) == edits)
        lens = some.select(F.explode(F.sequence(F.length("token") - edits, F.length("token") + edits)).alias("n")).distinct()
        near = terms.withColumn("n", F.length("term")).join(lens, "n", "left_semi")
        a = some.select("token", F.explode(_neighbourhood(F.col("token"), edits)).alias("v"))
        b = near.select("term", F.explode(_neighbourhood(F.col("term"), edits)).alias("v"))
        pairs = a.join(b, "v").select("token", "term").distinct()
        found.append(pairs.filter(F.levenshtein("token", "term") <= edits).select("token", "term", F.lit("fuzzy").alias("how")))
    both = found[0].unionByName(found[1]).unionByName(found[2])
    weight = F.when(F.col("how") == "exact", 1.0).when(F.col("how") == "prefix", PREFIX_WEIGHT).otherwise(FUZZY_WEIGHT)
    best = F.max_by(F.struct("how", weight.alias("weight")), weight)
    return both.groupBy("token", "term").agg(best.alias("b")).select("token", "term", "b.how", "b.weight")


def lexical_score(tokens: DataFrame, matches: DataFrame, index: DataFrame,
                  k: float = 1.2, b: float = 0.7, d: float = 0.5) -> DataFrame:
    """(qid, iri, score, coverage, precise): BM25 with field boosts, OR of terms."""
    boost = F.coalesce(F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv])[F.col("field")], F.lit(1.0))
    average = index.select("iri", "field", "length").distinct().groupBy("field").agg(
        F.avg("length").alias("avg_len"), F.count(F.lit(1)).alias("n_docs"))
    hits = matches.join(index.withColumnRenamed("token", "term"), "term")
    df = hits.select("term", "field", "iri").distinct().groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    hits = hits.join(df, ["term", "field"]).join(average, "field")
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("length") / F.col("avg_len")))
    per = hits.select("token", "iri", (boost * F.col("weight") * idf * (d + tf)).alias("s"),
                      F.col("how").isin("exact", "prefix").alias("precise"))
    # one row per (token, entity) before the queries fan out
    per = per.groupBy("token", "iri").agg(F.sum("s").alias("s"), F.max("precise").alias("precise"))
    return tokens.select("qid", "token").join(per, "token").groupBy("qid", "iri").agg(
        F.sum("s").alias("score"), F.count(F.lit(1)).alias("coverage"), F.max("precise").alias("precise"))


def _query_texts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("qid").agg(F.first("norm").alias("norm"), F.first("content").alias("content"))


def _tier() -> Column:
    """From ``own``, an entity's normalised name, ``norm``, ``content`` and ``precise``."""
    words = F.array_except(F.split(F.col("own"), " "), F.array(*[F.lit(w) for w in STOP_WORDS]))
    bare = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.col("own"))
    return (F.when(F.col("own") == F.col("norm"), 4)
            .when(F.col("own").startswith(F.col("norm")) | bare.startswith(F.col("content")), 3)
            .when(F.col("precise"), 2).otherwise(1))


def rank_lexical(scores: DataFrame, tokens: DataFrame, names: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Adds tier (4 exact name, 3 name prefix, 2 precise, 1 fuzzy) and rank."""
    own = tx.normalize_search(F.col("name"), ascii_only)
    rows = scores.join(names.select("iri", "name", own.alias("own")), "iri").join(_query_texts(tokens), "qid")
    rows = rows.withColumn("tier", _tier()).drop("own", "norm", "content", "precise")
    return group_index(rows, ["qid"], [F.desc("tier"), F.desc("coverage"), F.desc("score"), F.lower("name"), F.col("iri")], "rank")


def tier_ranks(tokens: DataFrame, found: DataFrame, names: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(qid, tier, coverage, n, first_rank, last_rank): the hits of each tier and
    coverage and the ranks that ``rank_lexical`` gives them.

    Its order begins with tier and coverage, so the ranks follow from counts.
    """
    per = found.groupBy("iri", "token").agg(F.max(F.col("how").isin("exact", "prefix")).alias("mark"))
    groups = hit_groups(tokens, per, names.select("iri", tx.normalize_search(F.col("name"), ascii_only).alias("own")))
    rows = groups.withColumn("precise", F.exists("marks", lambda x: x["mark"])).withColumn("coverage", F.size("marks").cast("long"))
    counts = rows.join(_query_texts(tokens), "qid").groupBy("qid", _tier().alias("tier"), "coverage").agg(F.sum("n").alias("n"))
    last = F.sum("n").over(W.partitionBy("qid").orderBy(F.desc("tier"), F.desc("coverage")))
    return counts.withColumn("last_rank", last).withColumn("first_rank", F.col("last_rank") - F.col("n") + 1)


# -- hits by groups of entities ---------------------------------------------
# Queries of few words over many entities have far more hits than there are
# ways to match: entities that the same query words match in the same way are
# one group, and only groups are met with the queries.

def found_words(matches: DataFrame, words: DataFrame) -> DataFrame:
    """(iri, field, value, token, how): the fields of ``field_words`` in which a
    term stands that matches a query word."""
    rows = words.select("iri", "field", "value", F.explode("words").alias("term"))
    return rows.join(matches.select("term", "token", "how"), "term").select("iri", "field", "value", "token", "how")


def hit_groups(tokens: DataFrame, per: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, marks, n, further columns of ``entities``): how many entities a query hits in one way.

    ``per(iri, token, mark)`` says how a query word matches an entity, and
    ``marks`` holds the (token, mark) of one query; ``entities(iri, ...)`` has a
    row per entity.
    """
    further = [c for c in entities.columns if c != "iri"]
    ways = per.groupBy("iri").agg(F.array_sort(F.collect_set(F.struct("token", "mark"))).alias("marks"))
    groups = ways.join(entities, "iri").groupBy("marks", *further).agg(F.count(F.lit(1)).alias("n"))
    groups = stored(groups.withColumn("_group", F.monotonically_increasing_id()))
    met = groups.select("_group", F.explode("marks").alias("m")).join(
        tokens.select("qid", F.col("token").alias("_token")), F.col("m.token") == F.col("_token"))
    met = met.groupBy("qid", "_group").agg(F.collect_set("m").alias("marks"))
    return met.join(groups.drop("marks"), "_group").groupBy("qid", F.array_sort("marks").alias("marks"), *further).agg(F.sum("n").alias("n"))


# -- semantic side ----------------------------------------------------------

def semantic_candidates(vectors: DataFrame, query: Column, minimum: float = SEMANTIC_MINIMUM) -> DataFrame:
    """(iri, similarity, field, value): best field per entity for one query
    vector, given as a literal or a scalar subquery; a pure scan."""
    rows = vectors.withColumn("_q", query)   # a subquery may not sit inside a lambda
    rows = rows.withColumn("similarity", vec.cosine(F.col("vector"), F.col("_q"))).drop("_q").filter(F.col("similarity") >= minimum)
    best = F.max_by(F.struct("similarity", "field", "value"), F.struct("similarity", "field", "value"))
    return rows.groupBy("iri").agg(best.alias("b")).select("iri", "b.*")


def fuse(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion per query (constant 60).

    ``lexical(qid, iri, name, tier, coverage, rank)``, ``semantic(qid, iri,
    name, similarity)``.  Entities found only by meaning fill up to ten hits
    and must be within 0.15 of the best similarity.
    """
    placed = group_index(semantic, ["qid"], [F.desc("similarity"), F.col("iri")], "s_rank")
    best = semantic.groupBy("qid").agg(F.max("similarity").alias("best"))
    found = lexical.groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    own = lexical.select("qid", "iri", F.col("name").alias("l_name"), "tier", "coverage", F.col("rank").alias("l_rank"))
    rows = placed.join(own, ["qid", "iri"], "full").join(best, "qid", "left").join(found, "qid", "left")
    rows = cut(rows.withColumn("found", F.coalesce("found", F.lit(0))))
    hits = rows.filter("l_rank is not null")
    fill = rows.filter(F.col("l_rank").isNull() & (F.col("found") < SEMANTIC_FILL)
                       & (F.col("similarity") >= F.col("best") - SEMANTIC_GAP))
    fill = group_index(fill, ["qid"], [F.col("s_rank")], "n").filter(F.col("n") <= SEMANTIC_FILL - F.col("found")).drop("n")
    both = hits.unionByName(fill)
    score = (F.coalesce(1 / (RANK_CONSTANT + F.col("l_rank")), F.lit(0.0))
             + F.coalesce(1 / (RANK_CONSTANT + F.col("s_rank")), F.lit(0.0)))
    out = both.select("qid", "iri", F.coalesce("l_name", "name").alias("name"), F.coalesce("tier", F.lit(0)).alias("tier"),
                      F.coalesce("coverage", F.lit(0)).alias("coverage"), score.alias("score"), "similarity")
    order = [F.desc("tier"), F.desc("coverage"), F.desc("score"), F.desc(F.coalesce("similarity", F.lit(0.0))), F.lower("name"), F.col("iri")]
    return group_index(out, ["qid"], order, "rank")


# -- presentation -----------------------------------------------------------

def category(kind: Column) -> Column:
    return (F.when(kind.isin("Class", "Defined"), "classes").when(kind == "Individual", "individuals")
            .when(kind.endswith("Property"), "properties").otherwise("other"))


def sort_results(hits: DataFrame, by: str = "relevance") -> DataFrame:
    name = F.lower("name")
    order = {"relevance": [F.col("rank")], "name": [name], "name-desc": [name.desc()], "iri": [F.col("iri")],
             "type": [F.col("kind"), name]}[by]
    return hits.orderBy(*order, F.col("iri"))


def kind_facets(groups: DataFrame) -> DataFrame:
    """Hits per category of ``field_groups``."""
    return groups.groupBy("qid", "category").agg(F.sum("n").alias("hits"))


def public_field(field: Column) -> Column:
    return F.when(field.isin("$label", "$alias"), "name").when(field.isin("$iri", "$local"), "iri").otherwise(field)


def field_hits(tokens: DataFrame, matches: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, iri, field): every public field in which an entity matched, listed; to count, see ``field_groups``."""
    hits = matches.select("token", "term").join(index.withColumnRenamed("token", "term"), "term")
    per = hits.select("token", "iri", public_field(F.col("field")).alias("field")).distinct()
    return tokens.select("qid", "token").join(per, "token").select("qid", "iri", "field").distinct()


def field_groups(tokens: DataFrame, found: DataFrame, kinds: DataFrame) -> DataFrame:
    """(qid, fields, category, n): how many entities of a category each query
    hits in just these public fields."""
    per = found.select("iri", "token", public_field(F.col("field")).alias("mark"))
    groups = hit_groups(tokens, per, kinds.select("iri", category(F.col("kind")).alias("category")))
    fields = F.array_sort(F.array_distinct(F.transform("marks", lambda x: x["mark"])))
    return groups.groupBy("qid", fields.alias("fields"), "category").agg(F.sum("n").alias("n"))


def field_facets(groups: DataFrame, selected: list[str]) -> DataFrame:
    """Hits per field within the selected categories, whatever fields are on."""
    rows = groups.filter(F.col("category").isin(selected)).select("qid", "n", F.explode("fields").alias("field"))
    return rows.groupBy("qid", "field").agg(F.sum("n").alias("hits"))


def remedies(groups: DataFrame, fields: list[str], selected: list[str]) -> DataFrame:
    """Per query: hits now, with all fields, with all types, with both; and
    whether an empty result is due to the filters or to the query."""
    in_field = F.exists("fields", lambda f: f.isin(fields))
    in_kind = F.col("category").isin(selected)

    def counted(c: Column) -> Column:
        return F.sum(F.when(c, F.col("n")).otherwise(0))

    out = groups.groupBy("qid").agg(counted(in_field & in_kind).alias("now"), counted(in_kind).alias("all_fields"),
                                    counted(in_field).alias("all_types"), F.sum("n").alias("reset"))
    return out.withColumn("empty_cause", F.when(F.col("now") > 0, F.lit(None).cast("string"))
                          .when(F.col("all_types") > 0, "filters").otherwise("query"))


def scope_filter(entities: DataFrame, instances: DataFrame | None = None, only: str | None = None,
                 exclude: list[str] | None = None) -> DataFrame:
    """Eligible entities: instances of a class, ``individuals`` or ``classes``
    only, without some IRIs."""
    if instances is not None:
        entities = entities.join(instances.select("iri").distinct(), "iri", "left_semi")
    if only:
        entities = entities.filter(category(F.col("kind")) == only)
    return entities.filter(~F.col("iri").isin(exclude)) if exclude else entities


FIELD_ORDER = ["$label", "$alias", "$local", "$iri"]


def match_evidence(tokens: DataFrame, found: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(qid, iri, field, value): the first field that matched and its value, of
    every hit or of ``hits(qid, iri)``.

    The words that match an entity are put in the order of their best fields
    once; a query takes the first one that it has, found once per order.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, f in enumerate(FIELD_ORDER) for x in (f, i)])[F.col("field")], F.lit(len(FIELD_ORDER)))
    best = found.groupBy("iri", "token").agg(F.min(F.struct(rank.alias("r"), "field", "value")).alias("b"))
    ways = best.groupBy("iri").agg(F.array_sort(F.collect_list(F.struct("b", "token"))).alias("best"))
    ways = stored(ways.select("iri", F.transform("best", lambda x: x["b"]).alias("best"), F.transform("best", lambda x: x["token"]).alias("words")))
    orders = ways.select("words").distinct().select("words", F.posexplode("words").alias("at", "token"))
    first = orders.join(tokens.select("qid", "token"), "token").groupBy("words", "qid").agg(F.min("at").alias("at"))
    out = ways.join(shuffled(first), "words").select("qid", "iri", F.get("best", F.col("at")).alias("b"))
    if hits is not None:
        out = out.join(hits.select("qid", "iri"), ["qid", "iri"], "left_semi")
    return out.select("qid", "iri", public_field(F.col("b.field")).alias("field"), "b.value")


def compare(query: Column, texts: DataFrame) -> DataFrame:
    """Similarity of one vector with each ``texts(id, vector)``."""
    return texts.withColumn("_q", query).select("id", vec.cosine(F.col("vector"), F.col("_q")).alias("similarity"))


def refresh_vectors(texts: DataFrame, vectors: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors for the current texts: known ones are kept by text hash, only
    new texts go through the caller's ``embed`` in Arrow batches, retired
    texts drop out."""
    current = texts.select(F.sha2("value", 256).alias("hash"), "value").dropDuplicates(["hash"])
    kept = vectors.join(current.select("hash"), "hash", "left_semi").select("hash", "vector")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(embed(batch.tolist()))

    fresh = current.join(vectors.select("hash"), "hash", "left_anti")
    return kept.unionByName(fresh.select("hash", run("value").alias("vector")))


def find_graph(hits: DataFrame, parents: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits and their ancestors as one graph."""
    return ancestry_subgraph(parents, hits, limit)


def synonym_status(pairs: DataFrame, quads: DataFrame, names: DataFrame) -> DataFrame:
    """For ``pairs(iri, text)``: is the text a label of the entity, already a
    synonym (exists), or available?"""
    key = F.lower(F.trim("text"))
    literals = quads.filter(m.is_literal() & F.col("p").isin(m.LABEL, m.PREF, m.SEE_ALSO))
    known = literals.select(F.col("s").alias("iri"), F.lower(F.trim("o")).alias("key"), (F.col("p") != m.SEE_ALSO).alias("is_label"))
    known = known.unionByName(names.select("iri", F.lower(F.trim("name")).alias("key"), F.lit(True).alias("is_label")))
    known = known.groupBy("iri", "key").agg(F.max("is_label").alias("is_label"))
    rows = pairs.withColumn("key", key).join(known, ["iri", "key"], "left")
    status = F.when(F.col("is_label"), "label").when(F.col("is_label").isNotNull(), "exists").otherwise("available")
    return rows.select("iri", "text", status.alias("status"))
