"""Joins of tables that grow with the corpus are merged at every size: broadcast, they would stand whole in the driver."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from quire.operators import fragments, iterate
from quire.plans import extract


@pytest.mark.parametrize("name", ["p4_nearest", "p13_links"])
def test_nothing_that_grows_is_broadcast(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or name == "p13_links"
    assert "Broadcast" not in plan


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_of_one_owner_meet_in_one_exchange(spark):
    """Runs are gathered without a window, from lists that begin before the exchange; nesting exchanges rows once for all levels."""
    rows = spark.createDataFrame(
        [("d", "p", 1, 0, 0, 0, "a", []), ("d", "p", 1, 2, 0, 1, "", ["b"]), ("d", "p", 1, 3, 0, 0, "c", []), ("d", "p", 1, 4, 0, 0, "d", []), ("d", "p", 1, 9, 0, 1, "", []), ("d", "p", 2, 5, 0, 1, "", ["i"])],
        "doc_id string, path string, owner int, seq int, sub int, brk int, text string, html_style array<string>",
    )
    got = fragments.gather(rows)
    assert _exchanges(got) == 1 and "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["owner"]: [tuple(x) for x in r["runs"]] for r in got.collect()} == {1: [([], "a", 0), (["b"], "cd", 3)], 2: []}
    cells = spark.createDataFrame([("d", 0, 0, 0, 0, "x"), ("d", 0, 0, 0, 1, "y"), ("d", 1, 0, 0, 0, "z")], "doc_id string, i int, j int, k int, l int, text string")
    nested = iterate.nest(cells, "text")
    assert _exchanges(nested) == 1
    assert [r["tables"] for r in nested.collect()] == [[[[["x", "y"]]], [[["z"]]]]]


def test_small_files_are_dealt_by_number(tmp_path):
    """A task's share counts what opening a file costs: thousands of small files are not one task's work."""
    from quire.sources import packages
    from quire.sources.part_source import OPENING, PartReader

    raw = packages.packed([("word/document.xml", b"<a/>"), ("_rels/.rels", b"<Relationships/>")])
    for n in range(40):
        (tmp_path / f"{n}.docx").write_bytes(raw)
    dealt = PartReader({"path": str(tmp_path), "partitionbytes": str(10 * (OPENING + len(raw)))}).partitions()
    assert [len(p.files) for p in dealt] == [10] * 4
    rows = [r for p in dealt for b in PartReader({}).read(p) for r in b.to_pylist()]
    assert sorted(r["doc_id"] for r in rows) == sorted(f"{n}.docx" for n in range(40)) and {r["path"] for r in rows} == {"_rels/.rels"}


def test_shares_grow_with_the_nodes(spark, monkeypatch):
    """exchanges deal more shares of more nodes, so that no task's memory grows with the corpus; the rows are the same."""
    query = entry.queries()["t17_other_tags"]
    want = sorted(map(tuple, query(spark, SMALL).collect()))
    monkeypatch.setattr(extract, "SHARE", 200)
    got = query(spark, SMALL)
    dealt = got._jdf.queryExecution().executedPlan().toString()
    n = int(dealt.split("Exchange hashpartitioning(doc_id")[1].split("), REPARTITION_BY_NUM")[0].split(", ")[-1])
    assert n > 10 and sorted(map(tuple, got.collect())) == want and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_texts_and_lineages_come_from_one_exchange(spark):
    """paragraphs are read once for both."""
    plan = entry.queries()["j9_text_outside"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
