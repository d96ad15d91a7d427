"""Structural addressing (A1-A5): the caret as windows over open and close events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import counted, lagged

KEY = ["doc_id", "path"]


def depth(nodes: DataFrame) -> Column:
    """A1: 4 less the levels down to the nearest paragraph, 1 at least; null where none is below and for document and body."""
    return F.when(F.col("p_dist").isNotNull() & ~F.col("name").isin("w:document", "w:body"), F.greatest(4 - F.col("p_dist"), F.lit(1)))


def events(nodes: DataFrame) -> DataFrame:
    """A3: an open and a close event of every node that has a depth, outside hyperlinks, whose insides are text."""
    own = nodes.withColumn("d", depth(nodes)).filter("d is not null and link is null")
    local = F.element_at(F.split("name", ":"), -1)
    both = F.array(F.struct(F.col("pre").alias("seq"), F.lit(0).alias("sub"), local.alias("nm"), F.lit(False).alias("closes")), F.struct(F.col("post").alias("seq"), F.lit(0).alias("sub"), F.lit(None).cast("string").alias("nm"), F.lit(True).alias("closes")))
    return own.select(*KEY, "pre", "d", (F.col("name") == "w:p").alias("is_p"), F.inline(both))


def addresses(nodes: DataFrame, more: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """A2, A4, A5: doc_id, path, pre, close_seq, i, j, k, l, lineage of every paragraph; more: events of paragraphs that no markup opens.

    Each index counts the drops of the caret to its level, anew after a drop to a shallower one; nested paragraphs stand in the order in which they close.  The
    lineage is read at the opening: a slot holds the last opener whose depth is exactly its own.  block: see blocks.
    """
    order = ["seq", "sub"]
    ev = events(nodes) if more is None else events(nodes).unionByName(more)
    ev = lagged(ev, KEY, order, "p", "d", block).withColumn("p", F.coalesce("p", F.lit(1)))
    drop = lambda to: (F.col("p") < to) & (F.col("d") >= to)
    ends = F.col("is_p") & F.col("closes")
    step = lambda cond: cond.cast("int")
    counts = {"i": (step(drop(2)), None), "j": (step(drop(3)), drop(2)), "k": (step(drop(4)), drop(2) | drop(3)), "l": (step(ends), drop(2) | drop(3) | drop(4))}
    slots = {f"s{s}": F.when(F.col("d") == s, F.struct(F.col("nm").alias("nm"))) for s in (1, 2, 3)}
    ev = counted(ev, KEY, order, counts, slots, block)
    at = F.when(F.col("closes"), F.struct("seq", *[(F.col(x) - 1).alias(x) for x in "ijkl"]))
    names = F.when(~F.col("closes"), F.array(F.lit("document"), F.col("s1.nm"), F.col("s2.nm"), F.col("s3.nm"), F.when(F.col("pre") >= 0, "p")))
    both = ev.filter("is_p").groupBy(*KEY, "pre").agg(F.max(at).alias("at"), F.max(names).alias("lineage"))
    return both.select(*KEY, "pre", F.col("at.seq").alias("close_seq"), *[F.col(f"at.{x}").cast("int").alias(x) for x in "ijkl"], "lineage")
