"""Paragraphs that no markup opens (J9, T8): text that stands in no paragraph, and labels of notes after which none comes.

The first run, text or picture outside every paragraph of a part opens one, which takes all that stands outside others up to the part's end and is
appended there; in comments each comment is a part of its own.  Labels left over at a part's end make one more, before it.  They have numbers below zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc_id", "path"]
#: The number of a part's paragraph of left labels, and an event after all of a part's.
LEFT, LAST = -(2**30), 2**31 - 1
#: The tags that add to a paragraph, or open a run in it.
TAGS = (
    "w:r", "w:t", "m:t", "w:br", "w:sym", "w:tab", "w:footnoteReference", "w:endnoteReference", "w:checkBox", "w:ddList", "a:blip", "v:imagedata", "wp:docPr", "m:oMath",
)


def owner() -> Column:
    """The paragraph of a node outside hyperlinks: its own, or the implicit one of its part or comment."""
    return F.coalesce("par", F.when(F.col("type") == "comments", -2 - F.coalesce("top", F.lit(0))).otherwise(-1))


def labels(nodes: DataFrame) -> DataFrame:
    """doc_id, path, pre, label of the notes that have one."""
    kind = F.when(F.col("name") == "w:footnote", "footnote").when(F.col("name") == "w:endnote", "endnote")
    notes = nodes.filter(F.col("name").isin("w:footnote", "w:endnote") & ~F.lower(F.coalesce(F.col("attrs")["w:type"], F.lit(""))).contains("separator"))
    return notes.select(*KEY, "type", "pre", "spans", F.concat(kind, F.coalesce(F.col("attrs")["w:id"], F.lit("")), F.lit(")\t")).alias("label"))


def paragraphs(nodes: DataFrame, handlers: dict, noted: bool = True) -> DataFrame:
    """doc_id, path, pre, type, top, open_seq, spans of the implicit paragraphs.  noted: whether there are notes."""
    stray = nodes.filter(F.col("par").isNull() & F.col("link").isNull() & ~F.col("math") & F.col("name").isin(*TAGS, *handlers, "w:hyperlink"))
    opened = stray.groupBy(*KEY, owner().alias("pre")).agg(F.max("type").alias("type"), F.max(F.when(F.col("type") == "comments", F.col("top"))).alias("top"), F.min("pre").alias("open_seq"), F.bool_or("spans").alias("spans"))
    if not noted:
        return opened
    notes = labels(nodes).groupBy(*KEY).agg(F.max("type").alias("type"), F.max("pre").alias("label"), F.bool_or("spans").alias("spans"))
    own = nodes.filter("name = 'w:p' and link is null")
    last = own.select(*KEY, F.col("pre").alias("open_seq")).unionByName(opened.select(*KEY, "open_seq")).groupBy(*KEY).agg(F.max("open_seq").alias("last"))
    left = notes.join(last.hint("merge"), KEY, "left").filter("last is null or label > last").select(*KEY, F.lit(LEFT).alias("pre"), "type", F.lit(None).cast("int").alias("top"), F.lit(LAST).alias("open_seq"), "spans")
    return opened.unionByName(left)


def events(pars: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, path, pre, d, is_p, seq, sub, nm, closes: how the implicit paragraphs of pars open and close."""
    ends = nodes.filter("type = 'comments' and level = 1").select(*KEY, F.col("pre").alias("top"), F.col("post").alias("end"))
    mine = pars.filter("pre < 0").select(*KEY, "pre", "open_seq", "top").join(ends.hint("merge"), [*KEY, "top"], "left")
    at = lambda seq, sub, closes: F.struct(seq.alias("seq"), sub.alias("sub"), F.lit(None).cast("string").alias("nm"), F.lit(closes).alias("closes"))
    left = F.col("pre") == LEFT
    both = F.array(at(F.col("open_seq"), F.when(left, 2).otherwise(1), False), at(F.coalesce("end", F.lit(LAST)), F.when(left, 3).otherwise(4), True))
    return mine.select(*KEY, "pre", F.lit(4).alias("d"), F.lit(True).alias("is_p"), F.inline(both))
