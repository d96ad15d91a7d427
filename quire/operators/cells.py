"""Merged cells (C1, C2) by the geometry of the table: columns shift by earlier spans, vertical merges carry the cell above down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .merge import KEY
from .numbers import COLUMNS, whole, widest


def cell_properties(nodes: DataFrame) -> DataFrame:
    """doc_id, path, cell, span, continues: gridSpan, of the widest table at most, and whether w:vMerge stands without a value."""
    props = nodes.filter("up = 'w:tcPr' and name in ('w:gridSpan', 'w:vMerge')")
    val = F.col("attrs")["w:val"]
    own = props.groupBy(*KEY, F.col("upper").alias("cell")).agg(
        F.max(F.when(F.col("name") == "w:gridSpan", val)).alias("span"),
        F.coalesce(F.bool_or(F.when(F.col("name") == "w:vMerge", val.isNull())), F.lit(False)).alias("continues"),
    )
    own = own.join(widest(nodes).hint("merge"), KEY, "left")
    return own.select(*KEY, "cell", F.least(F.greatest(F.coalesce(whole(F.col("span")), F.lit(1)), F.lit(1)), F.coalesce("limit", F.lit(COLUMNS))).alias("span"), "continues")


def latest_cells(pars: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, path, i, j, k, cell, span, continues: the properties of each w:tc at the place of the last paragraph that closed before it did.  Of several at one place spans add up."""
    ends = nodes.filter("name = 'w:tc'").select(*KEY, F.col("pre").alias("cell"), F.col("post").alias("seq")).join(cell_properties(nodes).hint("merge"), [*KEY, "cell"])
    placed = pars.select(*KEY, F.col("close_seq").alias("seq"), F.struct("i", "j", "k").alias("at"))
    events = placed.unionByName(ends, allowMissingColumns=True)
    so_far = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("at", F.last("at", ignorenulls=True).over(so_far)).filter("cell is not null and at is not null")
    return found.groupBy(*KEY, "at.i", "at.j", "at.k").agg(F.max("cell").alias("cell"), (F.sum(F.col("span") - 1) + 1).cast("int").alias("span"), F.bool_or("continues").alias("continues"))


def merged_cells(pars: DataFrame, nodes: DataFrame, duplicate: bool, latest: bool = False) -> DataFrame:
    """pars with k moved and paragraphs copied as merged cells ask; adds filler, true for the one empty paragraph of a cell that only fills its place, and into, the w:tc whose place a row takes.

    pars: doc_id, path, pre, cell, close_seq, i, j, k, l and more.  With duplicate a spanning cell is repeated and a cell that continues one above shows its text;
    without, spans are filled with empty paragraphs and continuing cells keep their own.  A continuing cell without a cell above stays as it is.
    A cell's properties hold for all its paragraphs; with latest for the place of the last that closed before it did, which differs after a nested table.
    """
    at = [*KEY, "i", "j", "k"]
    if latest:
        cells = pars.select(*at).distinct().join(latest_cells(pars, nodes).hint("merge"), at, "left")
    else:
        whole_cells = nodes.filter("name = 'w:tc' and p_dist = 1").select(*KEY, F.col("pre").alias("cell"))
        props = cell_properties(nodes).join(whole_cells.hint("merge"), [*KEY, "cell"])
        cells = pars.groupBy(*at).agg(F.max("cell").alias("cell")).join(props.hint("merge"), [*KEY, "cell"], "left")
    cells = cells.withColumn("span", F.coalesce("span", F.lit(1))).withColumn("continues", F.coalesce("continues", F.lit(False)))
    before = Window.partitionBy(*KEY, "i", "j").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.col("k") + F.coalesce(F.sum(F.col("span") - 1).over(before), F.lit(0)))
    wide = cells.select(*at, F.col("cell").alias("into"), "base", "continues", F.explode(F.sequence(F.lit(0), F.col("span") - 1)).alias("off")).withColumn("kx", F.col("base") + F.col("off"))
    if duplicate:
        column = Window.partitionBy(*KEY, "i", "kx").orderBy("j")
        broken = F.col("j") != F.coalesce(F.lag("j").over(column), F.lit(-2)) + 1
        held = wide.withColumn("_own", ~F.col("continues") | broken | (F.col("j") == 0))
        source = F.last(F.when(F.col("_own"), F.struct("j", "k")), ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
        held = held.withColumn("_src", source)
        # copies beside a continuing cell show what their first column shows
        row = Window.partitionBy(*KEY, "i", "j", "k")
        held = held.withColumn("_src", F.max(F.when(F.col("off") == 0, F.col("_src"))).over(row)).withColumn("filler", F.lit(False))
    else:
        held = wide.withColumn("_src", F.struct("j", "k")).withColumn("filler", F.col("off") > 0)
    place = held.select(*KEY, "i", F.col("j").alias("j_at"), F.col("kx").cast("int").alias("k_at"), F.col("_src.j").alias("j"), F.col("_src.k").alias("k"), "filler", "into")
    out = pars.join(place.hint("merge"), [*KEY, "i", "j", "k"])
    return out.filter("not filler or l = 0").drop("j", "k").withColumnRenamed("j_at", "j").withColumnRenamed("k_at", "k")
