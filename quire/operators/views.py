"""Renderings of paragraph rows: joined runs (G1), the HTML map (G3), markdown.

Rows have doc_id, i, j, k, l and text; every order comes from the address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import is_tbl


def join_runs(runs: DataFrame) -> DataFrame:
    """G1: doc_id, i, j, k, l, text from run rows (doc_id, i, j, k, l, m, run)."""
    return runs.groupBy("doc_id", "i", "j", "k", "l").agg(_ordered("m", F.col("run"), "").alias("text"))


def _ordered(by: str, value: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def html_map(pars: DataFrame) -> DataFrame:
    """doc_id and html_map: every paragraph with its address, in a grid of cells."""
    spot = F.concat(F.lit("("), F.concat_ws(", ", "i", "j", "k", "l"), F.lit(") "))
    out = pars.select("doc_id", "i", "j", "k", "l", F.concat(F.lit("<pre>"), spot, F.col("text"), F.lit("</pre>")).alias("v"))
    for by, open_, close, key in (("l", "<td>", "</td>", ("i", "j", "k")), ("k", "<tr>", "</tr>", ("i", "j")), ("j", '<table border="1">', "</table>", ("i",)), ("i", "<html><body>", "</body></html>", ())):
        out = out.groupBy("doc_id", *key).agg(F.concat(F.lit(open_), _ordered(by, F.col("v"), ""), F.lit(close)).alias("v"))
    return out.withColumnRenamed("v", "html_map")


def markdown(pars: DataFrame) -> DataFrame:
    """doc_id and markdown: tables with pipes and a rule below their first row, other text as paragraphs."""
    cells = pars.groupBy("doc_id", "i", "j", "k").agg(_ordered("l", F.replace("text", F.lit("\n"), F.lit(" ")), "\n\n").alias("v"))
    rows = cells.groupBy("doc_id", "i", "j").agg(F.concat(F.lit("|"), _ordered("k", F.col("v"), "|"), F.lit("|")).alias("row"), _ordered("k", F.col("v"), "\n\n").alias("plain"), F.count("*").alias("n"))
    rule = F.concat(F.lit("\n|"), F.array_join(F.array_repeat(F.lit("---"), F.col("n").cast("int")), "|"), F.lit("|"))
    rows = rows.withColumn("row", F.when(F.col("j") == 0, F.concat("row", rule)).otherwise(F.col("row")))
    tables = rows.groupBy("doc_id", "i").agg(_ordered("j", F.col("row"), "\n").alias("tbl"), _ordered("j", F.col("plain"), "\n\n").alias("txt"))
    each = tables.join(is_tbl(pars), ["doc_id", "i"]).withColumn("v", F.when(F.col("is_tbl"), F.col("tbl")).otherwise(F.col("txt")))
    return each.groupBy("doc_id").agg(_ordered("i", F.col("v"), "\n\n").alias("markdown"))
