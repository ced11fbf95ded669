"""Exports: JSON-LD node objects, statement and result CSV, entity report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.operators.ordering import cell_text
from quadrille.sources.ntriples import full_datatype

NODE_STATEMENTS = 10_000


def jsonld_nodes(quads: DataFrame) -> DataFrame:
    """(g, s, json): flattened node objects.

    A subject with very many statements becomes several node objects with the
    same ``@id``, which JSON-LD readers merge; no task holds a whole hub.
    """
    size = quads.groupBy("g", "s").agg(F.ceil(F.count(F.lit(1)) / NODE_STATEMENTS).alias("_chunks"))
    hubs = size.filter("_chunks > 1").select("s", F.coalesce("g", F.lit("")).alias("_g"), "_chunks")
    rows = quads.withColumn("_g", F.coalesce("g", F.lit(""))).join(hubs, ["s", "_g"], "left")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("p", "o"), F.coalesce("_chunks", F.lit(1))))
    value = F.when(m.is_resource(), F.struct(F.col("o").alias("@id"), *[F.lit(None).cast("string").alias(n) for n in ("@value", "@language", "@type")])).otherwise(
        F.struct(F.lit(None).cast("string").alias("@id"), F.col("o").alias("@value"), F.col("o_lang").alias("@language"),
                 F.when(F.col("o_lang").isNull(), full_datatype(F.col("o_datatype"))).alias("@type")))
    cells = rows.groupBy("g", "s", "_part", "p").agg(F.sort_array(F.collect_list(F.struct("pos", value.alias("v")))).alias("vs"))
    cells = cells.withColumn("vs", F.transform("vs", lambda x: x["v"]))
    body = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("p").alias("key"), F.col("vs").alias("value"))))))
    nodes = cells.groupBy("g", "s", "_part").agg(body.alias("_body"))
    head = F.to_json(F.struct(F.col("s").alias("@id")))
    return nodes.withColumn("_h", head).select(
        "g", "s", F.concat(F.expr("left(_h, length(_h) - 1)"), F.lit(","), F.expr("substr(_body, 2)")).alias("json"))


def write_jsonld(quads: DataFrame, path: str) -> None:
    """JSON lines, one node object each; named graphs wrap their nodes."""
    wrapped = F.concat(F.lit('{"@id":"'), F.col("g"), F.lit('","@graph":['), F.col("json"), F.lit("]}"))
    jsonld_nodes(quads).select(F.when(F.col("g").isNull(), F.col("json")).otherwise(wrapped).alias("value")).write.mode("overwrite").text(path)


def guard(c: Column) -> Column:
    """Keep spreadsheet programs from reading a cell as a formula."""
    return F.when(c.rlike(r"^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)


def statement_rows(quads: DataFrame) -> DataFrame:
    """The seven text columns of the statement export."""
    cols = {"Subject": F.col("s"), "Property": F.col("p"), "Value": F.col("o"),
            "Term kind": F.when(m.is_literal(), "Literal").otherwise("Resource"),
            "Language": F.coalesce("o_lang", F.lit("")), "Datatype": F.coalesce("o_datatype", F.lit("")),
            "Named graph": F.coalesce("g", F.lit(""))}
    return quads.select(*[guard(c).alias(n) for n, c in cols.items()])


def write_statement_csv(quads: DataFrame, path: str) -> None:
    (statement_rows(quads).write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').csv(path))


def result_rows(df: DataFrame) -> DataFrame:
    """Display text of every term column; unbound is empty."""
    return df.select(*[F.coalesce(cell_text(F.col(c)), F.lit("")).alias(c) for c in df.columns])


def write_result_csv(df: DataFrame, path: str) -> None:
    """Query result as CSV; quoting only where needed.  Spark ends rows with
    one character, so the carriage return closes the last cell instead."""
    def quote(c: Column) -> Column:
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    rows = result_rows(df)
    line = F.concat(F.concat_ws(",", *[quote(F.col(c)) for c in rows.columns]), F.lit("\r"))
    header = ",".join(f'"{c}"' if any(x in c for x in ',"') else c for c in rows.columns)
    head = df.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(header + "\r").alias("value"))
    body = rows.select(F.lit(1).alias("k"), line.alias("value"))
    head.unionAll(body).select("value").write.mode("overwrite").text(path)


def report(entities: DataFrame, quads: DataFrame) -> DataFrame:
    """Entities by kind and label with their statements, as sorted rows.

    The range sort keeps the reading order over many files without gathering
    a kind into one place.
    """
    rows = entities.select("iri", "kind", "name").join(
        quads.select(F.col("s").alias("iri"), "p", "o", "o_kind", "pos"), "iri", "left")
    return rows.orderBy("kind", F.lower("name"), "iri", F.col("pos").asc_nulls_first(), "p", "o")


def write_report(entities: DataFrame, quads: DataFrame, path: str) -> None:
    report(entities, quads).write.mode("overwrite").partitionBy("kind").json(path)
