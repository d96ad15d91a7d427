"""What extraction leaves out of a scan and of its plans changes no row; joins of blocks and of subtrees are merged."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.operators import blocks
from quire.plans.extract import READ, Extraction
from quire.sources import build as B
from quire.sources import shred

SMALL = "/root/testdata/sf0.001"
XML = b'<w:document><w:p><w:pPr><w:tabs><w:tab w:val="x"/></w:tabs><w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr><w:rPr><w:b/></w:rPr></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t></w:r></w:p></w:document>'


def test_property_elements_are_left_out():
    rows = [r for b in shred._emit([(("part",), XML, False), (("numbering",), XML, False), (("part",), XML, False)], ["kind"], [shred.pa.string()], READ) for r in b.to_pylist()]
    kinds = {k: [r for r in rows if r["kind"] == k] for k in ("part", "numbering")}
    assert len(kinds["numbering"]) == 14
    # the tab is read by its name and stands in what has content
    assert [r["name"] for r in kinds["part"]] == ["w:document", "w:p", "w:pPr", "w:tabs", "w:tab", "w:r", "w:t"] * 2
    assert all(r in [x | {"kind": "part"} for x in kinds["numbering"]] for r in kinds["part"])
    par = kinds["part"][1]
    assert (par["p_num"], par["p_level"]) == ("7", "1") and dict(kinds["part"][5]["props"]) == {"b": None}


def _run(dice) -> str:
    style = dice.choice(["", "<w:b/>", "<w:i/>", '<w:color w:val="red"/>'])
    inner = "".join(dice.choice(["<w:t>x</w:t>", "<w:t/>", "<w:tab/>", "<w:br/>", '<w:sym w:font="f" w:char="F0"/>', "<w:t>yy</w:t>"]) for _ in range(dice.randrange(3)))
    return dice.choice(["{}", "{}", "<w:ins>{}</w:ins>", "<w:proofErr/>{}"]).format(f"<w:r><w:rPr>{style}</w:rPr>{inner}</w:r>")


def _par(dice) -> str:
    num = f'<w:numPr><w:ilvl w:val="{dice.choice([0, 1, 2, "x"])}"/><w:numId w:val="1"/></w:numPr>' if dice.random() < 0.5 else ""
    return f"<w:p><w:pPr>{num}</w:pPr>" + "".join(dice.choice([_run(dice), '<w:bookmarkStart w:id="1"/>', "<w:commentRangeStart/>"]) for _ in range(dice.randrange(5))) + "</w:p>"


@pytest.mark.parametrize("html", [False, True])
def test_same_rows_with_and_without_marks(spark, html, monkeypatch):
    dice = random.Random(3)
    bodies = ["".join(dice.choice([_par(dice), "<w:tbl><w:tr><w:tc>" + _par(dice) + "</w:tc></w:tr></w:tbl>"]) for _ in range(12)) for _ in range(25)]
    odd = ["<w:p><w:t>a</w:t><w:r/><w:t>b</w:t></w:p>", "<w:p><w:r><w:t>a</w:t><w:ruby><w:r/></w:ruby><w:t>b</w:t></w:r></w:p>", "<w:r/><w:p/>"]

    def rows(body: list, whole: bool) -> list:
        df = spark.createDataFrame(list(enumerate(body)), "id int, body string")
        with Extraction(B.build(df, F.col("id"), {"document.xml": B.document(F.col("body")), "numbering.xml": B.numbering_xml([("decimal", 3), ("lowerRoman", None)])}), html=html) as e:
            if whole:
                assert e.nodes.filter("name = 'w:rPr'").count()
            return e._keyed, sorted(map(str, e.document.collect()))

    keyed, got = rows(bodies, False)
    assert keyed and not any(rows([x], False)[0] for x in odd)  # what stands elsewhere is told by marks
    monkeypatch.setattr(Extraction, "_keyed", False)
    assert rows(bodies, True)[1] == got


def test_blocks_and_subtrees_are_merged(spark):
    """a row for each block, and the roots of subtrees, grow with the corpus; broadcast they would stand whole in the driver."""
    df = spark.range(100).select(F.lit("k").alias("key"), F.col("id").cast("int").alias("seq"))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    for out in (blocks.lagged(df, ["key"], ["seq"], "p", "seq", 7), blocks.counted(df, ["key"], ["seq"], {"n": (F.lit(1), None)}, block=7)):
        out.collect()
        assert "SortMergeJoin" in plan(out) and "Broadcast" not in plan(out)


def test_roots_of_subtrees_are_merged(spark, monkeypatch):
    seen = []
    keep = Extraction._keep
    monkeypatch.setattr(Extraction, "_keep", lambda self, df, *a, **k: seen.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df, *a, **k))
    entry.queries()["x3_partial"](spark, SMALL).collect()
    assert any("SortMergeJoin" in p for p in seen) and not any("Broadcast" in p for p in seen)
