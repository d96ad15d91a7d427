"""Numbers in attributes: read leniently, so that one odd value in one package stops no corpus; what is odd is a warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc_id", "path"]
#: The levels that lists have, and the columns that a table may have at least.
LEVELS, COLUMNS = 9, 63


def whole(text: Column) -> Column:
    """A whole number, or null for what is none."""
    return F.trim(text).try_cast("int")


def level(text: Column) -> Column:
    """A list level, or null for what is none."""
    n = whole(text)
    return F.when(n.between(0, LEVELS - 1), n)


def widest(nodes: DataFrame) -> DataFrame:
    """doc_id, path, limit: the most columns that a cell may span: those of the part's widest table grid, COLUMNS at least."""
    grids = nodes.filter("name = 'w:gridCol'").groupBy(*KEY, "parent").agg(F.count("*").alias("n"))
    return grids.groupBy(*KEY).agg(F.greatest(F.max("n"), F.lit(COLUMNS)).cast("int").alias("limit"))


def odd_values(nodes: DataFrame) -> DataFrame:
    """doc_id, stage, message: list levels, list starts, spans and list results that are no numbers or out of range.

    What is then taken: a bullet without a number, no start, a span of one (or of the widest table), and the first entry.
    """
    name, up, val = F.col("name"), F.col("up"), F.col("attrs")["w:val"]
    n = whole(val)
    known = F.when((name == "w:ilvl") & (up == "w:numPr"), level(val).isNull()).when((name == "w:start") & (up == "w:lvl"), n.isNull()).when((name == "w:result") & (up == "w:ddList"), n.isNull() | (n < 0))
    wide = nodes.filter("name = 'w:gridSpan' and up = 'w:tcPr'").join(widest(nodes), KEY, "left").filter(val.isNotNull() & (n.isNull() | (n < 1) | (n > F.coalesce("limit", F.lit(COLUMNS))))).select(*KEY, "name", "attrs")
    odd = nodes.filter(val.isNotNull() & known).select(*KEY, "name", "attrs").unionByName(wide)
    return odd.select("doc_id", F.concat_ws(" ", F.lit("value"), "path").alias("stage"), F.concat(name, F.lit(": "), val).alias("message"))
