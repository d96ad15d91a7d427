"""Enumerations over nested tables (I1-I11), predicates on lineage (P9), tree lookups (P3, P4) and nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LETTERS = "ijklm"


def _checked(depth: int) -> int:
    if depth not in (1, 2, 3, 4, 5):
        raise ValueError("depth argument must be 1, 2, 3, 4, or 5")
    return depth


def enum_at_depth(df: DataFrame, nested: str, depth: int) -> DataFrame:
    """A row for each item at a depth of a nested array, with its address i, j, ... and the column item; empty lists vanish."""
    others = [c for c in df.columns if c != nested]
    out = df.withColumnRenamed(nested, "item")
    for x in LETTERS[: _checked(depth)]:
        out = out.select(*[c for c in out.columns if c != "item"], F.posexplode("item").alias(x, "item"))
    return out.select(*others, *LETTERS[:depth], "item")


def iter_at_depth(df: DataFrame, nested: str, depth: int) -> DataFrame:
    """The items without their addresses; `at` keeps their order as an array that sorts."""
    out = enum_at_depth(df, nested, depth)
    return out.withColumn("at", F.array(*LETTERS[:depth])).drop(*LETTERS[:depth])


def enum_tables(df: DataFrame, nested: str = "tables") -> DataFrame:
    """I7."""
    return enum_at_depth(df, nested, 1)


def enum_rows(df: DataFrame, nested: str = "tables") -> DataFrame:
    """I8."""
    return enum_at_depth(df, nested, 2)


def enum_cells(df: DataFrame, nested: str = "tables") -> DataFrame:
    """I9."""
    return enum_at_depth(df, nested, 3)


def enum_paragraphs(df: DataFrame, nested: str = "tables") -> DataFrame:
    """I10."""
    return enum_at_depth(df, nested, 4)


def iter_tables(df: DataFrame, nested: str = "tables") -> DataFrame:
    """I3."""
    return iter_at_depth(df, nested, 1)


def iter_rows(df: DataFrame, nested: str = "tables") -> DataFrame:
    """I4."""
    return iter_at_depth(df, nested, 2)


def iter_cells(df: DataFrame, nested: str = "tables") -> DataFrame:
    """I5."""
    return iter_at_depth(df, nested, 3)


def iter_paragraphs(df: DataFrame, nested: str = "tables") -> DataFrame:
    """I6."""
    return iter_at_depth(df, nested, 4)


def nest(rows: DataFrame, value: str, key: str = "doc_id", depth: int = 4) -> DataFrame:
    """key and tables: long rows (addresses i, j, ... and a value) as nested arrays, in order.  Rows of one key are exchanged once, for all levels."""
    out = rows.select(key, *LETTERS[:depth], F.col(value).alias("v")).repartition(key)
    for n in reversed(range(depth)):
        inner = F.transform(F.array_sort(F.collect_list(F.struct(LETTERS[n], "v"))), lambda x: x["v"])
        out = out.groupBy(key, *LETTERS[:n]).agg(inner.alias("v"))
    return out.withColumnRenamed("v", "tables")


def remove_empty_paragraphs(tables: Column) -> Column:
    """Cells without their empty paragraphs, of [table][row][cell][paragraph] strings."""
    return F.transform(tables, lambda rows: F.transform(rows, lambda cells: F.transform(cells, lambda pars: F.filter(pars, lambda p: p != ""))))


def _is(pars: DataFrame, key: list[str], slot: int, name: str, out: str) -> DataFrame:
    first = F.min_by("lineage", F.struct("i", "j", "k", "l"))
    return pars.groupBy(*key).agg(F.coalesce(F.get(first, F.lit(slot)) == name, F.lit(False)).alias(out))


def is_tbl(pars: DataFrame, key: list[str] | None = None) -> DataFrame:
    """doc_id, i and is_tbl: whether the first paragraph of each table came from one."""
    return _is(pars, key or ["doc_id", "i"], 1, "tbl", "is_tbl")


def is_tr(pars: DataFrame, key: list[str] | None = None) -> DataFrame:
    """P9, for rows."""
    return _is(pars, key or ["doc_id", "i", "j"], 2, "tr", "is_tr")


def is_tc(pars: DataFrame, key: list[str] | None = None) -> DataFrame:
    """P9, for cells."""
    return _is(pars, key or ["doc_id", "i", "j", "k"], 3, "tc", "is_tc")


def children(nodes: DataFrame, of: DataFrame, name: str | None = None) -> DataFrame:
    """The child nodes (of a prefixed name) of the nodes `of` (doc_id, path, pre)."""
    kids = nodes if name is None else nodes.filter(F.col("name") == name)
    return kids.join(of.select("doc_id", "path", F.col("pre").alias("parent")).distinct().hint("merge"), ["doc_id", "path", "parent"])


def nearest(nodes: DataFrame, name: str) -> DataFrame:
    """doc_id, path, pre and found, the pre of the nearest node of that name at or above each node that has one.

    Two windows over the events of a part: how many such nodes are open, and the last one opened while as many were open.
    """
    key = ["doc_id", "path"]
    mine = F.col("name") == name
    event = lambda at, step, node: F.struct(at.alias("seq"), F.lit(step).alias("step"), node.alias("node"))
    none = F.lit(None).cast("int")
    of = F.when(mine, F.array(event(F.col("pre"), 1, F.col("pre")), event(F.col("post"), -1, none))).otherwise(F.array(event(F.col("pre"), 0, F.col("pre"))))
    events = nodes.select(*key, F.inline(of)).withColumn("open", F.sum("step").over(Window.partitionBy(*key).orderBy("seq")))
    same = Window.partitionBy(*key, "open").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    found = events.filter("node is not null and open > 0").withColumn("found", F.last(F.when(F.col("step") == 1, F.col("node")), ignorenulls=True).over(same))
    return found.select(*key, F.col("node").alias("pre"), "found")


def lookup(nodes: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """The nodes of a prefixed name below the nodes `of` (doc_id, path, pre) at any depth, with `within`, the pre of the innermost of these above."""
    marked = nodes.join(of.select("doc_id", "path", "pre", F.lit("\0").alias("_of")).distinct().hint("merge"), ["doc_id", "path", "pre"], "left")
    inner = nearest(marked.withColumn("name", F.coalesce("_of", "name")), "\0")
    above = nodes.filter(F.col("name") == name)
    up = inner.select("doc_id", "path", F.col("pre").alias("parent"), F.col("found").alias("within"))
    return above.join(up.hint("merge"), ["doc_id", "path", "parent"])
