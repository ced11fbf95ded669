"""Registered queries: term functions, casts, dates and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille import model as m
from quadrille.functions import terms as t, text as tx
from quadrille.operators import patterns as pt
from quadrille.plans.common import BALANCE, EX, LABEL, NATION, SEGMENT, TOTAL, XSD
from quadrille.plans.registry import query


def _q(p: str) -> str:
    return f"(SELECT s, o FROM quads WHERE p = '{p}')"


@query("X1 X2 X3 X5 X6 X7 X8", "term_tests", data="customers suppliers definitions", sql=f"""
    SELECT p, count(*) AS n, count(*) FILTER (WHERE o_kind = 'iri') AS iris, count(*) FILTER (WHERE o_kind = 'bnode') AS blanks,
      count(*) FILTER (WHERE o_kind = 'literal') AS literals, count(*) FILTER (WHERE o_datatype IN ('{XSD}decimal', '{XSD}nonNegativeInteger')) AS numbers
    FROM quads GROUP BY p""")
def term_tests(src):
    o = t.object_term()
    n = F.count_if
    return src.quads("customers", "suppliers", "definitions").groupBy("p").agg(
        n(t.bound(o)).alias("n"), n(t.is_iri(o)).alias("iris"), n(t.is_blank(o)).alias("blanks"),
        n(t.is_literal(o)).alias("literals"), n(t.is_numeric(o)).alias("numbers"))


@query("X1 X2 X3", "bound_coalesce_if", data="customers suppliers", sql=f"""
    SELECT a.s AS c, b.o IS NOT NULL AS has, coalesce(b.o, a.o) AS shown, CASE WHEN cast(b.o AS double) > 8000 THEN 'rich' WHEN cast(b.o AS double) <= 8000 THEN 'plain' END AS band
    FROM {_q(NATION)} a LEFT JOIN {_q(BALANCE)} b ON a.s = b.s""")
def bound_coalesce_if(src):
    q = src.quads("customers", "suppliers")
    rows = pt.optional(pt.match(q, "?c", NATION, "?n"), pt.match(q, "?c", BALANCE, "?b"))
    band = t.if_(t.term_cmp(F.col("b"), ">", t.literal("8000", t.INTEGER)), t.literal("rich"), t.literal("plain"))
    return rows.select(F.col("c.value").alias("c"), t.bound(F.col("b")).alias("has"),
                       t.coalesce(F.col("b"), F.col("n"))["value"].alias("shown"), band["value"].alias("band"))


@query("X4", "in_and_not_in", data="customers", sql=f"""
    SELECT s AS c, o IN ('BUILDING', 'MACHINERY') AS yes, o NOT IN ('BUILDING', 'MACHINERY') AS no FROM {_q(SEGMENT)}""")
def in_and_not_in(src):
    rows = pt.match(src.quads("customers"), "?c", SEGMENT, "?seg")
    some = [t.literal("BUILDING"), t.literal("MACHINERY"), t.literal("5", t.INTEGER)]
    seg = F.col("seg")
    return rows.select(F.col("c.value").alias("c"), F.coalesce(t.in_(seg, some[:2]), F.lit(False)).alias("yes"),
                       t.not_in(seg, some[:2]).alias("no"))


@query("X9 X10 X11 X12", "str_lang_datatype", data="geo customers", sql=f"""
    SELECT p, lang, datatype, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS english FROM (SELECT p, CASE WHEN o_kind = 'literal' THEN coalesce(o_lang, '') END AS lang,
      CASE WHEN o_lang IS NOT NULL THEN '{m.RDF}langString' WHEN o_kind = 'literal' THEN coalesce(o_datatype, '{XSD}string') END AS datatype FROM quads) GROUP BY p, lang, datatype""")
def str_lang_datatype(src):
    o = t.object_term()
    rows = src.quads("geo", "customers").select("p", t.lang(o)["value"].alias("lang"), t.datatype(o)["value"].alias("datatype"),
                                                 t.lang_matches(t.lang(o), t.literal("EN")).alias("m"), t.str_(o).alias("text"))
    return rows.filter("text is not null").groupBy("p", "lang", "datatype").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("m").alias("english"))


@query("X13 X14 X15", "made_terms", data="customers", sql=f"""
    SELECT s AS c, 'http://base.example/' || o AS made, o || '^^{EX}seg' AS typed, o || '@en' AS tagged, true AS same FROM {_q(SEGMENT)}""")
def made_terms(src):
    rows = pt.match(src.quads("customers"), "?c", SEGMENT, "?seg")
    seg = F.col("seg")
    typed, tagged = t.strdt(seg, t.resource(F.lit(EX + "seg"))), t.strlang(seg, t.literal("en"))
    node = t.bnode(seg, F.col("c.value"))
    return rows.select(F.col("c.value").alias("c"), t.iri(seg, "http://base.example/")["value"].alias("made"),
                       F.concat_ws("^^", typed["value"], typed["datatype"]).alias("typed"),
                       F.concat_ws("@", tagged["value"], tagged["lang"]).alias("tagged"), t.same_term(node, node).alias("same"))


@query("X16 X27", "random_terms")
def random_terms(src):
    rows = pt.match(src.quads("customers"), "?c", SEGMENT, "?seg")
    return rows.select(F.col("c.value").alias("c"), t.uuid_()["value"].alias("iri"), t.struuid()["value"].alias("id"),
                       t.rand_()["datatype"].alias("kind"), t.now_()["value"].alias("now"))


@query("X17 X18 X19 X20 X21 X23", "string_functions", data="customers", sql=f"""
    SELECT s AS c, cast(length(o) AS varchar) AS len, substr(o, 2, 4) AS sub, upper(o) AS up, lower(o) AS low, starts_with(o, 'Cust') AS a, o LIKE '%9' AS z,
      contains(o, '#00') AS has, 'Customer' AS before, substr(o, 10) AS after, '' AS none, o || '!' AS both FROM {_q(LABEL)}""")
def string_functions(src):
    rows = pt.match(src.quads("customers"), "?c", LABEL, "?l")
    x = F.col("l")
    return rows.select(
        F.col("c.value").alias("c"), t.strlen(x)["value"].alias("len"), t.substr(x, F.lit(2), F.lit(4))["value"].alias("sub"),
        t.ucase(x)["value"].alias("up"), t.lcase(x)["value"].alias("low"), t.strstarts(x, t.literal("Cust")).alias("a"),
        t.strends(x, t.literal("9")).alias("z"), t.contains(x, t.literal("#00")).alias("has"),
        t.strbefore(x, t.literal("#"))["value"].alias("before"), t.strafter(x, t.literal("#"))["value"].alias("after"),
        t.strafter(x, t.literal("?"))["value"].alias("none"), t.concat(x, t.literal("!"))["value"].alias("both"))


@query("X22", "encoded_urls", sql="""
    SELECT page_id, replace(replace(replace(replace(replace(url_encode(url), '!', '%21'), '''', '%27'), '(', '%28'), ')', '%29'), '*', '%2A') AS encoded FROM pages""")
def encoded_urls(src):
    return src.table("pages").select("page_id", t.encode_for_uri(t.literal(F.col("url")))["value"].alias("encoded"))


@query("X24 X25", "regex_and_replace", sql=r"""
    SELECT doc_id, regexp_matches(text, '(?i)THE [a-z]+ing') AS hit, md5(regexp_replace(text, '([aeiou])([a-z])', '\2\1', 'g')) AS swapped FROM documents""")
def regex_and_replace(src):
    x = t.literal(F.col("text"))
    return src.table("documents").select("doc_id", t.regex(x, "THE [a-z]+ing", "i").alias("hit"),
                                         F.md5(t.replace(x, "([aeiou])([a-z])", "$2$1")["value"]).alias("swapped"))


@query("X26", "rounding_functions", data="customers", sql=f"""
    SELECT s AS c, cast(abs(x) AS decimal(18,2)) AS a, cast(floor(x + 0.5) AS bigint) AS r, cast(ceil(x) AS bigint) AS hi, cast(floor(x) AS bigint) AS lo
    FROM (SELECT s, cast(o AS decimal(18,2)) AS x FROM {_q(BALANCE)})""")
def rounding_functions(src):
    rows = pt.match(src.quads("customers"), "?c", BALANCE, "?b")
    x = F.col("b")

    def whole(c):
        return c["value"].try_cast("decimal(18,2)").cast("long")

    return rows.select(F.col("c.value").alias("c"), t.abs_(x)["value"].try_cast("decimal(18,2)").alias("a"),
                       whole(t.round_(x)).alias("r"), whole(t.ceil_(x)).alias("hi"), whole(t.floor_(x)).alias("lo"))


@query("X28 X29", "date_parts_in_own_zone", sql="""
    SELECT event_id, strftime(ts, '%Y') AS y, cast(month(ts) AS varchar) AS mo, cast(day(ts) AS varchar) AS d, cast(hour(ts) AS varchar) AS h, cast(minute(ts) AS varchar) AS mi,
      cast(second(ts) AS varchar) AS s, CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '-05:30' ELSE '' END AS tz,
      CASE event_id % 3 WHEN 0 THEN 'PT0S' WHEN 1 THEN '-PT5H30M' END AS zone FROM events""")
def date_parts_in_own_zone(src):
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "-05:30").otherwise("")
    x = t.literal(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone), t.DATETIME)
    rows = src.table("events").select("event_id", x.alias("x"))
    v = F.col("x")
    parts = {"y": t.year, "mo": t.month, "d": t.day, "h": t.hours, "mi": t.minutes, "s": t.seconds, "tz": t.tz, "zone": t.timezone}
    return rows.select("event_id", *[f(v)["value"].alias(n) for n, f in parts.items()])


@query("X30", "hash_functions", sql="""
    SELECT doc_id, md5(text) AS a, sha1(text) AS b, sha256(text) AS c, 96 AS d, 128 AS e FROM documents""")
def hash_functions(src):
    x = t.literal(F.col("text"))
    return src.table("documents").select("doc_id", t.md5(x)["value"].alias("a"), t.sha1(x)["value"].alias("b"), t.sha(x, 256)["value"].alias("c"),
                                         F.length(t.sha(x, 384)["value"]).alias("d"), F.length(t.sha(x, 512)["value"]).alias("e"))


@query("X31", "casts", data="orders customers", sql=f"""
    SELECT s, cast(trunc(x) AS bigint) AS i, x AS d, cast(x AS double) AS f, x <> 0 AS b, cast(x AS varchar) AS t, cast(NULL AS varchar) AS moment
    FROM (SELECT s, cast(o AS decimal(18,2)) AS x FROM quads WHERE p IN ('{TOTAL}', '{BALANCE}'))
    UNION ALL SELECT s, NULL, NULL, NULL, NULL, o, NULL FROM {_q(SEGMENT)}""")
def casts(src):
    q = src.quads("orders", "customers").filter(F.col("p").isin(TOTAL, BALANCE, SEGMENT))
    o = t.object_term()

    def to(kind):
        return t.cast(o, XSD + kind)["value"]

    return q.select("s", to("integer").try_cast("long").alias("i"), to("decimal").try_cast("decimal(18,2)").alias("d"),
                    to("double").try_cast("double").alias("f"), to("boolean").try_cast("boolean").alias("b"),
                    to("string").alias("t"), to("dateTime").alias("moment"))


@query("X32 X33 X34", "iri_parts", sql=r"""
    SELECT page_id, regexp_extract(url, '([^#/]*)$', 1) AS loc, regexp_extract(url, '^(.*[#/:])', 1) AS space, 'http://www.w3.org/2004/02/skos/core#p' || page_id AS expanded,
      'skos:p' || page_id AS compact, regexp_replace(replace('has_PartOf' || page_id, '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g') AS human FROM pages""")
def iri_parts(src):
    k = F.col("page_id").cast("string")
    return src.table("pages").select(
        "page_id", tx.local_name(F.col("url")).alias("loc"), tx.namespace(F.col("url")).alias("space"),
        tx.expand_iri(F.concat(F.lit("skos:p"), k)).alias("expanded"), tx.compact_iri(F.concat(F.lit(m.SKOS + "p"), k)).alias("compact"),
        tx.humanise(F.concat(F.lit("has_PartOf"), k)).alias("human"))


@query("X35 X36 X37 X43", "names_and_identifiers", sql=r"""
    SELECT p_partkey, upper(substr(a, 1, 1)) || substr(a, 2) || 'And' || upper(substr(b, 1, 1)) || substr(b, 2) || '2' AS identifier, a || ' and ' || b || ' 2' AS key,
      a || ' & ' || b AS synonym, upper(substr(a, 1, 1)) || substr(a, 2) || ' ' || upper(substr(b, 1, 1)) || substr(b, 2) AS title, p_partkey % 2 = 0 AS free
    FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def names_and_identifiers(src):
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    label = F.concat(a, F.lit(" & "), F.initcap(b), F.lit("2"))
    return src.table("part").select(
        "p_partkey", tx.identifier_from_label(label).alias("identifier"),
        tx.name_key(F.concat(a, F.lit(" & "), F.upper(b), F.lit("-2"))).alias("key"),
        tx.ampersand_synonym(F.concat(a, F.lit(" AND "), b)).alias("synonym"), tx.title_case_query(F.concat(F.lit(" "), a, F.lit("   "), b)).alias("title"),
        tx.can_name_entity(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("x:"), "p_name"))).alias("free"))


@query("X38 X39", "folded_search_text", sql="""
    SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'))), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS digest,
      levenshtein(lower(source), lower(lang || lang)) AS distance FROM documents""".replace("\\\\", "\\"))
def folded_search_text(src):
    return src.table("documents").select(
        "doc_id", F.md5(tx.normalize_search(F.col("text"))).alias("digest"),
        tx.text_distance(F.col("source"), F.concat("lang", "lang")).alias("distance"))


@query("X40", "placeholder_identifiers", sql=f"""
    SELECT p_partkey, p_size % 3 = 0 AS placeholder FROM part""")
def placeholder_identifiers(src):
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(EX + "new_Class"), F.col("p_size").cast("string"))).otherwise(
        F.concat(F.lit(EX + "NewClassic"), F.col("p_size").cast("string")))
    return src.table("part").select("p_partkey", tx.is_placeholder(name).alias("placeholder"))


@query("X41", "title_phrases", sql="""
    SELECT p_partkey, upper(substr(a, 1, 1)) || substr(a, 2) || ' of the ' || upper(substr(b, 1, 1)) || substr(b, 2) || ' PhD' AS title
    FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def title_phrases(src):
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    text = F.concat(a, F.lit("  OF the "), F.upper(b), F.lit(" phd"))
    return src.table("part").select("p_partkey", tx.title_phrase(text, {"PHD": "PhD"}, ("of", "the")).alias("title"))
