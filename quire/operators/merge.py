"""Run normalisation (M1-M3): gaps and islands over siblings with content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["doc_id", "path"]


def islands(nodes: DataFrame, parent: str, key: str, tag: str) -> DataFrame:
    """Adds canon to nodes: for those named tag, the pre of the first of a run of neighbours (among siblings with content) with equal key; null for others."""
    w = Window.partitionBy(*KEY, parent).orderBy("pre")
    mine = F.col("name") == tag
    joins = mine & F.coalesce(F.lag(mine).over(w), F.lit(False)) & F.lag(key).over(w).eqNullSafe(F.col(key))
    out = nodes.withColumn("_new", ~joins)
    first = F.last(F.when(F.col("_new"), F.col("pre")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("canon", F.when(mine, first)).drop("_new")


def merge_links(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """First pass: doc_id, path, link, canon_link, target, anchor.  Links join by target, not by rId; anchors are ignored, links without rId join too."""
    target = rels.select("doc_id", "path", F.col("rel_id").alias("_rid"), F.col("target").alias("_target"))
    own = nodes.filter("name = 'w:hyperlink'").select(*KEY, "pre", "kin", F.col("attrs")["r:id"].alias("_rid"), F.col("attrs")["w:anchor"].alias("anchor"))
    own = own.join(target.hint("merge"), [*KEY, "_rid"], "left")
    # an unresolved rId keeps a key of its own
    own = own.withColumn("_key", F.coalesce("_target", F.concat(F.lit("\0"), F.col("_rid")), F.lit("")))
    w = Window.partitionBy(*KEY, "kin").orderBy("pre")
    own = own.withColumn("_new", F.coalesce(F.lag("_key").over(w) != F.col("_key"), F.lit(True)))
    first = F.last(F.when(F.col("_new"), F.col("pre")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.select(*KEY, F.col("pre").alias("link"), first.alias("canon_link"), F.col("_target").alias("target"), "anchor")


def merge_runs(nodes: DataFrame, links: DataFrame, styles: DataFrame | None) -> DataFrame:
    """Second pass: doc_id, path, run, canon_run, last_post.  Neighbouring runs of one style are one run; without styles (html off) all neighbours are.

    The children of merged links stand under the first of them.  Text nodes need no third pass: text within a run is joined anyway.
    """
    sub = nodes.filter("content").select(*KEY, "pre", "post", "parent", "name")
    canon = links.filter("link <> canon_link").select(*KEY, F.col("link").alias("parent"), "canon_link")
    sub = sub.join(canon.hint("merge"), [*KEY, "parent"], "left").withColumn("_parent", F.coalesce("canon_link", "parent"))
    if styles is None:
        sub = sub.withColumn("_style", F.lit(""))
    else:
        sub = sub.join(styles.select(*KEY, F.col("run").alias("pre"), F.array_join("html_style", "\0").alias("_style")).hint("merge"), [*KEY, "pre"], "left").withColumn("_style", F.coalesce("_style", F.lit("")))
    runs = islands(sub, "_parent", "_style", "w:r").filter("name = 'w:r'")
    w = Window.partitionBy(*KEY, "canon")
    return runs.withColumn("last_post", F.max("post").over(w)).select(*KEY, F.col("pre").alias("run"), F.col("canon").alias("canon_run"), "last_post")
