import pytest
from pyspark.sql import functions as F

from quire.operators import iterate, numbering, views
from quire.sources.parts import inferred_path
from quire.sources.packages import _path_of


def _ragged():
    """Lists whose lengths follow a rule (7a + 3b + ... mod 4), with empty rows, cells and paragraphs; every run is a phrase of its own."""

    def level(at):
        if len(at) == 5:
            return "-".join("pqrstuvw"[x] for x in at)
        n = 3 if len(at) < 2 else sum((7, 3, 5, 2)[k] * x for k, x in enumerate(at)) % 4
        return [level((*at, x)) for x in range(n)]

    return level(())


def _addressed(t, depth, at=()):
    """Addresses and items of a nested list, by recursion."""
    return [(at, t)] if len(at) == depth else [y for n, x in enumerate(t) for y in _addressed(x, depth, (*at, n))]


def _frame(spark):
    return spark.createDataFrame([("d", _ragged()), ("none", []), ("hollow", [[], [[]], [[[]]]])], "doc_id string, tables array<array<array<array<array<string>>>>>")


def test_enumerate(spark):
    df = _frame(spark)
    for depth, enum, it in zip(range(1, 6), (iterate.enum_tables, iterate.enum_rows, iterate.enum_cells, iterate.enum_paragraphs, None), (iterate.iter_tables, iterate.iter_rows, iterate.iter_cells, iterate.iter_paragraphs, None), strict=True):
        want = _addressed(_ragged(), depth)
        rows = [r for r in iterate.enum_at_depth(df, "tables", depth).collect() if r["doc_id"] == "d"]
        assert sorted((tuple(r[x] for x in "ijklm"[:depth]), r["item"]) for r in rows) == sorted(want) and len(want) > 2
        items = [r for r in iterate.iter_at_depth(df, "tables", depth).orderBy("at").collect() if r["doc_id"] == "d"]
        assert [r["item"] for r in items] == [x for _, x in want]
        if enum:
            assert enum(df).count() == it(df).count() == iterate.enum_at_depth(df, "tables", depth).count()
    hollow = [iterate.enum_at_depth(df.filter("doc_id = 'hollow'"), "tables", n).count() for n in range(1, 6)]
    assert hollow == [3, 2, 1, 0, 0]
    for bad in (0, 6):
        with pytest.raises(ValueError, match="depth argument must be 1, 2, 3, 4, or 5"):
            iterate.enum_at_depth(df, "tables", bad)


def test_html_map_and_nest(spark):
    full = [[[[f"{r}{c}{x}" for x in "ab"[: 1 + (r + c) % 2]] for c in range(2)] for r in range(3)]]
    pars = iterate.enum_at_depth(spark.createDataFrame([("d", full)], "doc_id string, tables array<array<array<array<string>>>>"), "tables", 4).withColumnRenamed("item", "text")
    cells = lambda r: "".join("<td>" + "".join(f"<pre>(0, {r}, {c}, {k}) {x}</pre>" for k, x in enumerate(full[0][r][c])) + "</td>" for c in range(2))
    want = '<html><body><table border="1">' + "".join(f"<tr>{cells(r)}</tr>" for r in range(3)) + "</table></body></html>"
    assert views.html_map(pars).collect()[0]["html_map"] == want
    assert iterate.nest(pars, "text").collect()[0]["tables"] == full
    runs = spark.createDataFrame([("d", 0, 0, 0, 0, 2, "c"), ("d", 0, 0, 0, 0, 0, "a"), ("d", 0, 0, 0, 0, 1, ""), ("d", 0, 0, 0, 1, 0, "z")], "doc_id string, i int, j int, k int, l int, m int, run string")
    assert {(r["l"], r["text"]) for r in views.join_runs(runs).collect()} == {(0, "ac"), (1, "z")}


def test_nearest_and_lookup(spark):
    """Against a walk up the parents, in random trees with nested nodes of one name."""
    import random

    rng, rows = random.Random(8), []
    for path in "xy":
        clock, n = 0, 0

        def grow(parent, level, path=path):
            nonlocal clock, n
            pre, n = clock, n + 1
            clock += 1
            row = ["d", path, pre, None, parent, level, rng.choice("abc")]
            rows.append(row)
            while n < 60 and rng.random() < 0.75:
                grow(pre, level + 1)
            row[3] = clock
            clock += 1

        grow(None, 0)
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id string, path string, pre int, post int, parent int, level int, name string")
    by = {(r[1], r[2]): r for r in rows}

    def up(r, hit):
        while r is not None and not hit(r):
            r = by.get((r[1], r[4])) if r[4] is not None else None
        return r and r[2]

    want = {(r[1], r[2], f) for r in rows if (f := up(r, lambda x: x[6] == "a")) is not None}
    assert {(r["path"], r["pre"], r["found"]) for r in iterate.nearest(df, "a").collect()} == want
    roots = df.filter("name = 'b'")
    below = {(r[1], r[2], f) for r in rows if r[6] == "c" and r[4] is not None and (f := up(by[r[1], r[4]], lambda x: x[6] == "b")) is not None}
    assert {(r["path"], r["pre"], r["within"]) for r in iterate.lookup(df, roots, "c").collect()} == below


def test_empty_paragraphs(spark):
    df = spark.createDataFrame([([[[["a", "", "b"], [""]]]],)], "tables array<array<array<array<string>>>>")
    assert df.select(iterate.remove_empty_paragraphs(F.col("tables")).alias("t")).collect()[0]["t"] == [[[["a", "b"], []]]]


def test_counters(spark):
    levels = [1, 2, 2, 3, 2, 3, 1, 2]
    df = spark.createDataFrame([("d", "p", n, "1", lv) for n, lv in enumerate(levels)], "doc_id string, path string, pre int, num_id string, ilvl int")
    got = [r["list_pos"] for r in numbering.counters(df, ["doc_id", "path"]).orderBy("pre").collect()]
    assert got == [[1], [1, 1], [1, 2], [1, 2, 1], [1, 3], [1, 3, 1], [2], [2, 1]]


def test_paths(spark):
    cases = [("_rels/.rels", "word/document.xml", "word/document.xml"), ("word/_rels/document.xml.rels", "media/a.png", "word/media/a.png"), ("word/_rels/document.xml.rels", "/word/x.xml", "word/x.xml"), ("word/_rels/document.xml.rels", "word/y.xml", "word/y.xml")]
    df = spark.createDataFrame(cases + [("odd_rels/a.rels", "b.xml", "odd/b.xml"), ("word/_rels/d.rels", "../x.xml", "word/../x.xml"), ("_rels/.rels", "./y.xml", "y.xml")], "a string, b string, c string")
    assert all(_path_of(a, b) == c for a, b, c in df.collect())
    assert all(r[0] == r[1] for r in df.select(inferred_path(F.col("a"), F.col("b")), "c").collect())
