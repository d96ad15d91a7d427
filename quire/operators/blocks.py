"""Running values over parts of any length: windows over blocks of a part, and one row for each block that carries what came before it.

Without blocks a part is one window, one task's work.  With them rows are dealt by part and block, only rows of (part, block) meet in a task, and
the windows over whole parts have a row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _dealt(df: DataFrame, key: list[str], order: list[str], block: int | None) -> tuple[DataFrame, list[str]]:
    """df with its block, and the key of a window over one."""
    return (df, key) if block is None else (df.withColumn("_block", F.floor(F.col(order[0]) / block)), [*key, "_block"])


def lagged(df: DataFrame, key: list[str], order: list[str], name: str, value: str, block: int | None = None) -> DataFrame:
    """df with name: the value of the row before, null for the first of a key.  key has no nulls; order begins with a number."""
    df, own = _dealt(df, key, order, block)
    one = F.struct(F.col(value).alias("v"))  # a null before is not the same as no row before
    out = df.withColumn(name, F.lag(one).over(Window.partitionBy(*own).orderBy(*order)))
    if block is None:
        return out.withColumn(name, F.col(name)["v"])
    ends = df.groupBy(*own).agg(F.max_by(one, F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*key).orderBy("_block")))
    return out.join(ends.hint("merge"), own).withColumn(name, F.coalesce(name, "_end")["v"]).drop("_end", "_block")


def counted(df: DataFrame, key: list[str], order: list[str], counts: dict[str, tuple[Column, Column | None]], last: dict[str, Column] | None = None, block: int | None = None) -> DataFrame:
    """df with running sums and last values over key in order, each row included.

    counts: name to (step, anew): the sum of step since the last row of which anew is true, that row included, or since the first (anew None).  Steps of
    counts that start anew are not negative; null is 0.  last: name to a value, of which the last that is not null is taken.
    key has no nulls; order begins with a number and, with what follows, tells rows apart.
    """
    last = last or {}
    df, own = _dealt(df, key, order, block)
    w = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    steps = {n: F.coalesce(step, F.lit(0)).cast("long") for n, (step, _) in counts.items()}
    anew = [n for n, (_, a) in counts.items() if a is not None]
    out = df.select("*", *[F.sum(s).over(w).alias(f"_sum_{n}") for n, s in steps.items()], *[F.last(v, ignorenulls=True).over(w).alias(n) for n, v in last.items()])
    out = out.select("*", *[F.max(F.when(counts[n][1], F.col(f"_sum_{n}") - steps[n])).over(w).alias(f"_base_{n}") for n in anew])
    none = F.lit(0).cast("long")
    if block is None:
        value = lambda n: F.col(f"_sum_{n}") - (F.coalesce(f"_base_{n}", none) if n in anew else none)
        return out.select(*[c for c in out.columns if not c.startswith(("_sum_", "_base_"))], *[value(n).alias(n) for n in counts])
    # the last row of a block has what the block adds
    at_end = [f"_sum_{n}" for n in counts] + [f"_base_{n}" for n in anew] + list(last)
    ends = out.groupBy(*own).agg(F.max_by(F.struct(*at_end), F.struct(*order)).alias("_end")).select(*own, "_end.*")
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*own, *at_end, *[F.coalesce(F.sum(f"_sum_{n}").over(before), none).alias(f"_off_{n}") for n in counts])
    carried = [F.max(F.col(f"_base_{n}") + F.col(f"_off_{n}")).over(before).alias(f"_from_{n}") for n in anew]
    ends = ends.select(*own, *[f"_off_{n}" for n in counts], *carried, *[F.last(n, ignorenulls=True).over(before).alias(f"_last_{n}") for n in last])
    out = out.join(ends.hint("merge"), own)
    base = lambda n: F.coalesce(F.col(f"_base_{n}") + F.col(f"_off_{n}"), F.col(f"_from_{n}"), none)
    value = lambda n: F.col(f"_sum_{n}") + F.col(f"_off_{n}") - (base(n) if n in anew else none)
    return out.select(*df.drop("_block").columns, *[F.coalesce(n, f"_last_{n}").alias(n) for n in last], *[value(n).alias(n) for n in counts])
