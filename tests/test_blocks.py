"""Running values by blocks equal those over whole parts, and both a count by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.address import addresses
from quire.operators.blocks import counted, lagged
from quire.plans.extract import Extraction
from quire.sources import build as B


def _rows(n: int) -> list:
    dice = random.Random(5)
    return [(dice.choice("ab"), at, sub, dice.choice([None, 0, 1, 2]), dice.random() < 0.2, dice.choice([None, None, "x", "y"])) for at in dice.sample(range(n * 3), n) for sub in (0, 1)] + [("alone", 7, 0, 1, False, None)]


@pytest.mark.parametrize("block", [None, 1, 10, 10**6])
def test_counts_by_hand(spark, block):
    rows = _rows(150)
    want, state = {}, {}
    for key, seq, sub, step, anew, mark in sorted(rows, key=lambda r: r[:3]):
        total, since, last, before = state.get(key, (0, 0, None, None))
        total, since, last = total + (step or 0), (step or 0) + (0 if anew else since), mark or last
        want[key, seq, sub] = (total, since, last, before)
        state[key] = (total, since, last, step)
    df = spark.createDataFrame(rows, "key string, seq int, sub int, step int, anew boolean, mark string")
    df = lagged(df, ["key"], ["seq", "sub"], "before", "step", block)
    df = counted(df, ["key"], ["seq", "sub"], {"total": (F.col("step"), None), "since": (F.col("step"), F.col("anew"))}, {"last": F.col("mark")}, block)
    assert {(r["key"], r["seq"], r["sub"]): (r["total"], r["since"], r["last"], r["before"]) for r in df.collect()} == want
    assert counted(df.limit(0), ["key"], ["seq"], {"n": (F.col("step"), None)}, block=block).count() == 0


def test_one_key_is_many_tasks(spark):
    """Rows of one key are dealt by block: no window over whole keys reads more than a row for each block."""
    df = spark.range(20000).select(F.lit("k").alias("key"), F.col("id").cast("int").alias("seq"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = counted(df, ["key"], ["seq"], {"n": (F.lit(1), None)}, block=500).withColumn("task", F.spark_partition_id())
        tasks = {r["task"]: r["count"] for r in out.groupBy("task").count().collect()}
        assert out.filter("n <> seq + 1").count() == 0 and len(tasks) == 4 and max(tasks.values()) < 10000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def _par(dice) -> str:
    num = f'<w:numPr><w:ilvl w:val="{dice.choice([0, 1, 2, 8])}"/><w:numId w:val="{dice.choice([1, 2])}"/></w:numPr>' if dice.random() < 0.6 else ""
    box = f"<w:r><w:txbxContent>{_par(dice)}</w:txbxContent></w:r>" if dice.random() < 0.1 else ""
    return f"<w:p><w:pPr>{num}</w:pPr><w:r><w:t>{dice.randrange(1000)}</w:t></w:r>{box}</w:p>"


def _table(dice, depth: int = 0) -> str:
    cell = lambda: "".join(_table(dice, depth + 1) if depth < 2 and dice.random() < 0.2 else _par(dice) for _ in range(dice.randrange(1, 4)))
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{cell()}</w:tc>" for _ in range(dice.randrange(1, 4))) + "</w:tr>" for _ in range(dice.randrange(1, 4))) + "</w:tbl>"


def test_extraction_by_blocks(spark):
    """Nested tables, text boxes, lists of two kinds, text outside paragraphs and comments: the same document and comments with any block."""
    dice = random.Random(8)
    bodies = []
    for n in range(6):
        items = [_table(dice) if dice.random() < 0.4 else _par(dice) for _ in range(12)]
        mark = lambda kind: f'<w:commentRange{kind} w:id="0"/>'
        bodies.append((f"d{n}", "".join([*items[:3], mark("Start"), *items[3:7], mark("End"), "<w:r><w:t>out</w:t></w:r>" if n % 2 else "", *items[7:]])))
    df = spark.createDataFrame(bodies, "id string, body string")
    remark = '<w:comment w:id="0" w:author="a" w:date="d"><w:p><w:r><w:t>c</w:t></w:r></w:p></w:comment>'
    parts = {"document.xml": B.document(F.col("body")), "comments.xml": B.root("comments", F.lit(remark)), "numbering.xml": B.numbering_xml([("decimal", 3), ("lowerLetter", None), ("lowerRoman", None)])}
    made = B.build(df, F.col("id"), parts).persist()
    seen = {}
    for block in (None, 7):
        e = Extraction(made, part_block=block)
        seen[block] = [sorted(str(tuple(r)) for r in view.collect()) for view in (e.document, e.comments)]
    assert seen[None] == seen[7] and len(seen[7][0]) > 100 and len(seen[7][1]) == 6
    one = addresses(e.nodes.filter("error is null"), block=3)
    assert sorted(map(tuple, one.drop("lineage").collect())) == sorted(map(tuple, addresses(e.nodes.filter("error is null")).drop("lineage").collect()))
    with pytest.raises(ValueError):
        Extraction(made, part_block=0)
