"""Lists: S11 numbering scan, J4/J5 lookups, W1-W6 counters and bullets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formats import bullet, format_bullet, list_token
from .blocks import counted
from .numbers import level, whole

LEVELS = range(9)


def numbering(nodes: DataFrame) -> DataFrame:
    """doc_id, num_id, lvl_pos, fmt, start from the nodes of word/numbering.xml.

    lvl_pos is the place of w:lvl among its siblings, not its attribute.  A num whose abstractNum does not exist voids the
    document's numbering; a num without one is skipped.
    """
    key = ["doc_id"]
    top = nodes.filter("name = 'w:abstractNum'").select(*key, F.col("pre").alias("abs"), F.col("attrs")["w:abstractNumId"].alias("abs_id"))
    place = Window.partitionBy("doc_id", "parent").orderBy("pre")
    level = nodes.filter("name = 'w:lvl' and up = 'w:abstractNum'").withColumn("lvl_pos", F.row_number().over(place) - 1).select(*key, F.col("parent").alias("abs"), F.col("pre").alias("lvl"), "lvl_pos")
    val = F.col("attrs")["w:val"]
    kids = nodes.filter("up = 'w:lvl'").groupBy("doc_id", F.col("parent").alias("lvl")).agg(F.max(F.when(F.col("name") == "w:numFmt", val)).alias("fmt"), F.max(F.when(F.col("name") == "w:start", val)).alias("start"))
    levels = top.join(level.hint("merge"), ["doc_id", "abs"], "left").join(kids.hint("merge"), ["doc_id", "lvl"], "left").select("doc_id", "abs_id", "lvl_pos", "fmt", whole(F.col("start")).alias("start"))
    nums = nodes.filter("name = 'w:abstractNumId' and up = 'w:num'").select("doc_id", F.col("parent").alias("num"), val.alias("abs_id"))
    nums = nums.join(nodes.filter("name = 'w:num'").select("doc_id", F.col("pre").alias("num"), F.col("attrs")["w:numId"].alias("num_id")).hint("merge"), ["doc_id", "num"]).select("doc_id", "num_id", "abs_id")
    broken = nums.join(top.select("doc_id", "abs_id").hint("merge"), ["doc_id", "abs_id"], "left_anti").select("doc_id").distinct()
    return nums.join(broken.hint("merge"), "doc_id", "left_anti").join(levels.hint("merge"), ["doc_id", "abs_id"]).filter("lvl_pos is not null").select("doc_id", "num_id", "lvl_pos", "fmt", "start")


def counters(pars: DataFrame, scope: list[str], order: str = "pre", block: int | None = None, levels: range = LEVELS) -> DataFrame:
    """Adds c_0..c_8, the list counts after each paragraph, and list_pos.

    pars: num_id and ilvl (null where absent).  A paragraph counts at its level and clears deeper ones: a level's count starts anew at each paragraph of a shallower
    level.  One exchange, one sort.  block: see blocks.  levels: those that paragraphs have; only these have a count.
    """
    mine = pars.withColumn("_list", F.coalesce(F.concat(F.lit("."), "num_id"), F.lit("")))
    counts = {f"c_{m}": ((F.col("ilvl") == m).cast("int"), F.col("ilvl") < m) for m in levels}
    out = counted(mine, [*scope, "_list"], [order], counts, block=block).drop("_list")
    live = F.filter(F.array(*[F.col(f"c_{m}").cast("int") for m in levels]), lambda x: x > 0)
    return out.withColumn("list_pos", F.when(F.col("num_id").isNull(), F.array().cast("array<int>")).otherwise(live))


def par_number(ilvl: Column, start: Column, levels: range = LEVELS) -> Column:
    """The count at the paragraph's level, moved by the level's start."""
    count = F.element_at(F.array(*[F.col(f"c_{m}") for m in levels]), ilvl + 1)
    return count + F.when(F.coalesce(start, F.lit(0)) == 0, 0).otherwise(start - 1)


def bullets(pars: DataFrame, formats: DataFrame | None, scope: list[str], order: str = "pre", block: int | None = None, levels: range = LEVELS) -> DataFrame:
    """Adds list_id, list_pos and bullet to paragraphs with num_id and ilvl (texts); bullet is '' outside lists, and levels without a known format are bullets.

    A level that is none is a bullet without a tab and does not count.  formats may be None where no paragraph has num_id.  levels: see counters.
    """
    outside = pars.filter("num_id is null").withColumn("ilvl", level(F.col("ilvl"))).withColumn("list_pos", F.array().cast("array<int>")).withColumn("bullet", F.lit("")).withColumn("list_id", F.col("num_id"))
    if formats is None:
        return outside
    pars = pars.filter("num_id is not null")
    counted = counters(pars.withColumn("_odd", F.col("ilvl").isNotNull() & level(F.col("ilvl")).isNull()).withColumn("ilvl", level(F.col("ilvl"))), scope, order, block, levels)
    dim = formats.withColumnRenamed("lvl_pos", "ilvl")
    out = counted.join(dim.hint("merge"), ["doc_id", "num_id", "ilvl"], "left")
    token = list_token(F.coalesce("fmt", F.lit("bullet")), par_number(F.col("ilvl"), F.col("start"), levels))
    in_list = F.col("num_id").isNotNull() & F.col("ilvl").isNotNull()
    out = out.withColumn("bullet", F.when(in_list, format_bullet(F.col("ilvl"), token)).when(F.col("num_id").isNotNull() & F.col("_odd"), format_bullet(F.lit(0), bullet())).otherwise(""))
    return outside.unionByName(out.withColumn("list_id", F.col("num_id")).drop("_odd", "fmt", "start", *[f"c_{m}" for m in levels]))
