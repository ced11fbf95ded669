"""JSON documents as rows: leaf flattening and link-candidate responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadrille import model as m
from quadrille.operators.paths import reach
from quadrille.session import cut


def flatten_json(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, path, value, datatype) of every leaf; paths such as ``a/b/0``.

    Works level by level on variants, so arrays and objects of any depth and
    unknown shape are followed; broken JSON gives no rows.
    """
    level = df.select(key, F.lit("").alias("path"), F.col(col).alias("text"))
    done = None
    while True:
        rows = level.withColumn("v", F.try_parse_json("text")).filter("v is not null")
        kind = F.schema_of_variant("v")
        rows = rows.withColumn("kind", kind)
        inner = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        datatype = F.when(F.col("kind") == "BOOLEAN", m.XSD + "boolean").when(F.col("kind") == "BIGINT", m.XSD + "integer")
        leaves = rows.filter(~inner).select(key, "path", F.try_variant_get("v", "$", "string").alias("value"), datatype.alias("datatype"))
        done = leaves if done is None else done.unionByName(leaves)
        boxes = rows.filter(inner).select(key, "path", "text", F.col("kind").startswith("ARRAY").alias("is_array"))
        # arrays and objects as lists / maps of variants
        items = boxes.filter("is_array").select(key, "path", F.posexplode(F.from_json("text", "array<variant>")).alias("k", "x"))
        fields = boxes.filter("not is_array").select(key, "path", F.explode(F.from_json("text", "map<string, variant>")).alias("k", "x"))
        step = F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("/"))), F.col("k").cast("string")).alias("path")
        level = cut(items.select(key, step, F.to_json("x").alias("text")).unionByName(fields.select(key, step, F.to_json("x").alias("text"))))
        if level.isEmpty():
            return done


_RESPONSE = """query STRUCT<
  pages: ARRAY<STRUCT<pageid: BIGINT, `index`: INT, title: STRING, description: STRING, fullurl: STRING,
    pageprops: STRUCT<wikibase_item: STRING, disambiguation: STRING>>>,
  redirects: ARRAY<STRUCT<`from`: STRING, `to`: STRING>>>"""


def _responses(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.select(key, F.from_json(col, _RESPONSE).alias("r")).select(key, "r.query.*")


def _title_path(title):
    encoded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    return F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def parse_candidates(df: DataFrame, key: str, col: str) -> DataFrame:
    """Candidate rows of search responses ``df(key, json)``: id, label,
    description, rank, resource IRIs and the disambiguation flag."""
    p = F.col("p")
    pages = _responses(df, key, col).select(key, F.explode("pages").alias("p"))
    url = F.coalesce(p["fullurl"], F.concat(F.lit("https://en.wikipedia.org/wiki/"), _title_path(p["title"])))
    fine = ((p["pageid"] > 0) & (F.length(p["title"]).between(1, 512)) & p["index"].between(1, 20)
            & url.rlike(r"^https://en\.wikipedia\.org/wiki/[^?#]*$"))
    item = p["pageprops"]["wikibase_item"]
    return pages.filter(fine).select(
        key, p["pageid"].cast("string").alias("id"), p["title"].alias("label"),
        F.substring(F.coalesce(p["description"], F.lit("")), 1, 4000).alias("description"), p["index"].alias("rank"),
        F.concat(F.lit("http://dbpedia.org/resource/"), _title_path(p["title"])).alias("iri"), url.alias("url"),
        F.when(item.rlike(r"^Q[1-9]\d*$"), F.concat(F.lit("http://www.wikidata.org/entity/"), item)).alias("wikidata_iri"),
        p["pageprops"]["disambiguation"].isNotNull().alias("disambiguation"))


def candidate_names(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, id, name): the title of each candidate and every redirect that
    leads to it, also through other redirects."""
    own = cut(_responses(df, key, col))
    pages = own.select(key, F.explode("pages").alias("p")).select(key, F.col("p.pageid").cast("string").alias("id"), F.col("p.title").alias("name"))
    hops = own.select(key, F.explode("redirects").alias("r"))

    def node(c):
        return F.concat_ws("\u0001", F.col(key).cast("string"), c)

    edges = hops.select(node(F.col("r.to")).alias("src"), node(F.col("r.from")).alias("dst"))
    names = reach(edges, pages.select(node(F.col("name")).alias("start")).distinct())
    more = pages.withColumn("start", node(F.col("name"))).drop("name").join(names, "start").select(
        key, "id", F.substring_index("node", "\u0001", -1).alias("name"))
    return pages.unionByName(more).distinct()
