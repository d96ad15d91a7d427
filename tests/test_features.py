"""Odd values, implicit paragraphs, run counts at comment marks, nested tables, handlers, properties by ancestor, the writer and the part source."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import edit
from quire.operators.fragments import Handler
from quire.operators.merge import merge_runs
from quire.plans.extract import Extraction, gather_properties
from quire.sources import build as B
from quire.sources.packages import Package, save_files
from quire.sources.part_source import PartReader, read_parts
from quire.sources.shred import serialise, without


def _made(spark, bodies: dict, **more):
    """A package for each body."""
    df = spark.createDataFrame(list(bodies.items()), "id string, body string")
    parts = {"document.xml": B.document(F.col("body"))} | more.pop("parts", {})
    return B.build(df, F.col("id"), parts, **more).persist()


def _p(text: str, properties: str = "") -> str:
    return f"<w:p><w:pPr>{properties}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def _texts(e):
    return {r["doc_id"]: r["text"] for r in e.text.collect()}


def test_no_odd_value_stops_the_corpus(spark):
    """Each odd value in a package of its own beside a sound one: what is taken instead, and the warning."""
    level = lambda v: _p("x", f'<w:numPr><w:ilvl w:val="{v}"/><w:numId w:val="1"/></w:numPr>')
    span = lambda v: f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="{v}"/></w:tcPr>{_p("x")}</w:tc></w:tr></w:tbl>'
    drop = lambda v: f'<w:p><w:r><w:ddList><w:result w:val="{v}"/><w:listEntry w:val="a"/><w:listEntry w:val="b"/></w:ddList></w:r></w:p>'
    want = {
        "sound": (_p("y"), "y", None), "level text": (level("x"), "--\tx", "w:ilvl: x"), "level empty": (level(""), "--\tx", "w:ilvl: "), "level deep": (level("12"), "--\tx", "w:ilvl: 12"), "level below": (level("-1"), "--\tx", "w:ilvl: -1"),
        "level huge": (level("99999999999"), "--\tx", "w:ilvl: 99999999999"), "level 1": (level("1"), "\t1)\tx", None), "span text": (span("abc"), "x", "w:gridSpan: abc"), "span none": (span(""), "x", "w:gridSpan: "), "span 0": (span("0"), "x", "w:gridSpan: 0"),
        "span wide": (span("1000000000"), "\n\n".join(["x"] * 63), "w:gridSpan: 1000000000"), "span grid": ("<w:tbl><w:tblGrid>" + "<w:gridCol/>" * 70 + "</w:tblGrid></w:tbl>" + span("70"), "\n\n".join(["x"] * 70), None),
        "list text": (drop("x"), "a", "w:result: x"), "list empty": (drop(""), "a", "w:result: "), "list below": (drop("-1"), "a", "w:result: -1"), "list beyond": (drop("7"), "", None), "list 1": (drop("1"), "b", None),
    }
    lists = B.numbering_xml([("decimal", None), ("decimal", 5)]).replace('<w:start w:val="5"/>', '<w:start w:val="five"/>')
    e = Extraction(_made(spark, {k: v[0] for k, v in want.items()}, parts={"numbering.xml": F.when(F.col("id").like("level%"), lists)}))
    assert _texts(e) == {k: v[1] for k, v in want.items()}
    found = {}
    for r in e.warnings.filter("stage like 'value%'").collect():
        found.setdefault(r["doc_id"], set()).add(r["message"])
    assert found == {k: {m} - {None} | ({"w:start: five"} if k.startswith("level") else set()) for k, (_, _, m) in want.items() if m or k.startswith("level")}
    assert e.errors.count() == 0


def test_text_outside_paragraphs(spark):
    """One implicit paragraph a part, at its end; in tables, in links, around text boxes; comments have one each."""
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    bodies = {
        "alone": run("a") + "<w:tab/>" + run("b"),
        "around": run("a") + _p("p") + run("b"),
        "cell": f"<w:tbl><w:tr><w:tc>{run('a')}</w:tc></w:tr></w:tbl>{_p('p')}",
        "empty run": "<w:r/>" + _p("p"),
        "none": _p("p"),
        "link": '<w:hyperlink><w:r><w:t>l</w:t></w:r></w:hyperlink>' + _p("p"),
    }
    remarks = f'<w:comment w:id="0" w:author="a" w:date="d">{run("x")}{_p("y")}</w:comment><w:comment w:id="1" w:author="a" w:date="d">{_p("z")}</w:comment>'
    mark = "".join(f'<w:commentRangeStart w:id="{n}"/><w:commentRangeEnd w:id="{n}"/>' for n in (0, 1))
    e = Extraction(_made(spark, {k: v + mark for k, v in bodies.items()}, parts={"comments.xml": B.root("comments", F.lit(remarks))}))
    assert _texts(e) == {"alone": "a\tb", "around": "p\n\nab", "cell": "p\n\na", "empty run": "p\n\n", "none": "p", "link": "p\n\nl"}
    rows = {(r["doc_id"], r["text"]): r for r in e.document.collect()}
    assert rows["around", "ab"]["lineage"] == ["document", None, None, None, None] and rows["around", "ab"]["pre"] < 0 and (rows["around", "ab"]["k"], rows["around", "ab"]["l"]) == (0, 1)
    assert {(r["ord"], r["text"]) for r in e.comments.collect()} == {(0, "y\n\nx"), (1, "z")}
    nodes = e.nodes.filter("doc_id = 'around' and name = 'w:t' and text = 'b'")
    assert [r["text"] for r in e.partial(nodes).document.collect()] == ["b"]


def test_left_labels(spark):
    notes = lambda kind, inner: B.root(f"{kind}s", F.lit(inner))
    parts = {
        "footnotes.xml": notes("footnote", f'<w:footnote w:id="1"/><w:footnote w:id="2">{_p("n")}</w:footnote><w:footnote w:id="3"/><w:footnote w:id="4"/>'),
        "endnotes.xml": notes("endnote", '<w:endnote w:id="8" w:type="separator"/><w:endnote w:id="9"/>'),
    }
    e = Extraction(_made(spark, {"d": _p("b")}, parts=parts))
    assert _texts(e)["d"] == "b\n\nfootnote1)\tfootnote2)\tn\n\nfootnote3)\tfootnote4)\t\n\nendnote9)\t"
    assert sorted(r["run_strings"] for r in e.section("footnotes").collect()) == [["footnote1)\t", "footnote2)\t", "n"], ["footnote3)\t", "footnote4)\t"]]


def _references(document: list, html: bool) -> dict:
    """The rule by hand: document is a list of paragraphs, (heading, items), items texts or (id, 'start' or 'end')."""
    closed, marks = [], {}
    for heading, items in document:
        tags = ["<h1>", "</h1>"] if heading and html else []
        own = []
        for x in items:
            if isinstance(x, tuple):
                marks.setdefault(x[0], {})[x[1]] = len(closed) + len(own) + len(tags)
            else:
                own.append(x)
        closed += [*tags[:1], *own, *tags[1:]]
    return {k: "".join(closed[m["start"] : m["end"]]) for k, m in marks.items()}


def test_comment_ranges_in_both_modes(spark):
    """Ranges within, into, out of and across headings and plain paragraphs."""
    document = [
        (False, ["a", (0, "start"), "b", (0, "end"), (1, "start"), "c"]),
        (True, ["d", (1, "end"), (2, "start"), "e", (2, "end"), (3, "start"), "f"]),
        (True, [(4, "start"), "g", (3, "end"), (5, "start")]),
        (False, [(5, "end"), "h", (4, "end")]),
    ]
    tag = lambda m: f'<w:commentRange{m[1].title()} w:id="{m[0]}"/>'
    body = "".join(f'<w:p><w:pPr>{"<w:pStyle w:val=" + chr(34) + "Heading1" + chr(34) + "/>" if h else ""}</w:pPr>' + "".join(tag(x) if isinstance(x, tuple) else f"<w:r><w:t>{x}</w:t></w:r>" for x in items) + "</w:p>" for h, items in document)
    remarks = "".join(f'<w:comment w:id="{n}" w:author="a" w:date="d">{_p("c")}</w:comment>' for n in range(6))
    made = _made(spark, {"d": body}, parts={"comments.xml": B.root("comments", F.lit(remarks))})
    for html in (False, True):
        assert {int(r["id"]): r["reference"] for r in Extraction(made, html=html).comments.collect()} == _references(document, html)
    assert _references(document, True)[2] == "f"  # marked is "e": a range within a heading is one run late


def test_comments_beside_merged_cells(spark):
    """Cells that are repeated or replaced change the number of runs before later marks, for marks and runs alike."""
    cell = lambda text, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{_p(text) if text else '<w:p/>'}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('up', '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}{cell('wide', '<w:gridSpan w:val=' + chr(34) + '3' + chr(34) + '/>')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('b')}</w:tr></w:tbl>"
    body = table + '<w:p><w:r><w:t>x</w:t></w:r><w:commentRangeStart w:id="0"/><w:r><w:t>here</w:t></w:r><w:commentRangeEnd w:id="0"/></w:p>'
    made = _made(spark, {"d": body}, parts={"comments.xml": B.root("comments", F.lit(f'<w:comment w:id="0" w:author="a" w:date="d">{_p("c")}</w:comment>'))})
    for duplicate in (True, False):
        assert [r["reference"] for r in Extraction(made, duplicate_merged_cells=duplicate).comments.collect()] == ["here"]


def test_spans_after_a_nested_table(spark):
    """A spanning cell that holds a table between two paragraphs: by geometry both of its places span, by the latest row only the last."""
    inner = f"<w:tbl><w:tr><w:tc>{_p('in')}</w:tc></w:tr></w:tbl>"
    body = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{_p("a")}{inner}{_p("b")}</w:tc><w:tc>{_p("c")}</w:tc></w:tr></w:tbl>'
    made = _made(spark, {"d": body})
    rows = lambda **o: sorted((r["i"], r["j"], r["k"], r["text"]) for r in Extraction(made, **o).document.collect())
    assert rows() == [(0, 0, 0, "a"), (0, 0, 1, "a"), (1, 0, 0, "in"), (2, 0, 0, "b"), (2, 0, 1, "b"), (2, 0, 2, "c")]
    assert rows(nested_tables="latest") == [(0, 0, 0, "a"), (1, 0, 0, "in"), (2, 0, 0, "b"), (2, 0, 1, "b"), (2, 0, 2, "c")]
    # without a paragraph after it the nested table's own last cell is repeated
    last = _made(spark, {"d": body.replace(_p("b"), "")})
    got = sorted((r["i"], r["j"], r["k"], r["text"]) for r in Extraction(last, nested_tables="latest").document.collect())
    assert got == [(0, 0, 0, "a"), (1, 0, 0, "in"), (1, 0, 1, "in"), (2, 0, 0, "c")]
    with pytest.raises(ValueError):
        Extraction(made, nested_tables="other")


def test_handlers(spark):
    made = _made(spark, {"d": '<w:p><w:r><w:t>a</w:t><w:x w:v="1"><w:t>in</w:t></w:x><w:t>b</w:t></w:r></w:p>'})
    text = lambda: F.concat(F.lit("{"), F.col("attrs")["w:v"], F.lit("}"))
    runs = lambda **k: Extraction(made, handlers={"w:x": Handler(text, **k)}).document.first()["run_strings"]
    assert runs() == ["a", "{1}", "inb"] and runs(into=False) == ["a", "{1}", "b"] and runs(alone=False) == ["a{1}inb"]
    with pytest.raises(ValueError):
        Extraction(made, handlers={"w:t": Handler(text)}).text


def test_properties_by_ancestor(spark):
    body = f'<w:sdt><w:sdtPr><w:b w:val="1"/><w:tag w:val="x"/><w:b/></w:sdtPr><w:sdtPr><w:tag w:val="no"/></w:sdtPr><w:sdtContent>{_p("a", "<w:jc w:val=" + chr(34) + "left" + chr(34) + "/>")}<w:sdt><w:sdtContent>{_p("b")}</w:sdtContent></w:sdt></w:sdtContent></w:sdt>{_p("c")}'
    nodes = Extraction(_made(spark, {"d": body})).nodes
    pars = nodes.filter("name = 'w:p'")
    text = nodes.filter("name = 'w:t'").select("doc_id", "path", F.col("par").alias("pre"), "text")
    of = lambda tag: {r["text"]: list(r["properties"].items()) for r in gather_properties(nodes, pars, tag).join(text, ["doc_id", "path", "pre"]).collect()}
    assert of("w:sdt") == {"a": [("b", None), ("tag", "x")], "b": [], "c": []}
    assert of(None) == {"a": [("jc", "left")], "b": [], "c": []}


def test_written_trees(spark):
    """What is not merged comes back as it was; what stands between merged siblings follows them; special characters survive."""
    odd = '<w:p w:a="&quot;&amp;&lt;&#10;\'"><w:r><w:t>x &amp; &lt;y&gt; &#13;</w:t>tail &amp; more<w:t/></w:r></w:p>'
    made = _made(spark, {"d": odd + "<w:sectPr><w:b/></w:sectPr>"})
    e = Extraction(made)
    live = e.nodes.filter("error is null")
    again = Extraction(made)
    again.packages = edit.save(made, serialise(live, ["doc_id", "path"]).persist())
    strip = lambda df: sorted(tuple(r) for r in df.select("pre", "post", "parent", "name", F.map_entries("attrs"), "text", "tail").collect())
    assert strip(live) == strip(again.nodes)
    body = '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t></w:r><w:m1><w:n/></w:m1><w:r><w:rPr><w:i/></w:rPr><w:t>b</w:t></w:r><w:m2/><w:hyperlink><w:r><w:t>c</w:t></w:r><w:m3/></w:hyperlink><w:m4/><w:hyperlink><w:m5/><w:r><w:t>d</w:t></w:r></w:hyperlink><w:m6/></w:p>'
    e = Extraction(_made(spark, {"d": body}))
    nodes = e.nodes.filter("error is null").drop("error")
    out = serialise(edit.merged_nodes(nodes, e._links, merge_runs(nodes, e._links, None)), ["doc_id", "path"]).first()["bytes"].decode()
    want = "<w:p><w:r><w:rPr><w:b></w:b></w:rPr><w:t>ab</w:t></w:r><w:m1><w:n></w:n></w:m1><w:m2></w:m2><w:hyperlink><w:r><w:t>cd</w:t></w:r><w:m3></w:m3><w:m5></w:m5></w:hyperlink><w:m4></w:m4><w:m6></w:m6></w:p>"
    assert want in out
    gone = serialise(without(nodes, F.col("name") == "w:hyperlink", ["doc_id", "path"]), ["doc_id", "path"]).first()["bytes"].decode()
    assert "hyperlink" not in gone and "m3" not in gone and "m6" in gone


def test_saving_exchanges_changed_packages_only(spark):
    """Packages without a changed part pass byte for byte, by a broadcast of the changed ids; of the others only the changed parts differ."""
    made = _made(spark, {k: _p(f"text {k}") for k in "abcd"}, media={"m.bin": F.lit(b"\x00\x01")})
    before = {r["doc_id"]: bytes(r["content"]) for r in made.collect()}
    after = {r["doc_id"]: bytes(r["content"]) for r in edit.replace_docx_text(made, ("text b", "T\nU"), ("nothing", "x")).collect()}
    assert {k for k in before if before[k] != after[k]} == {"b"}
    one, two = Package(before["b"]), Package(after["b"])
    assert sorted(one.names) == sorted(two.names) and {n for n in one.names if one.read(n) != two.read(n)} == {"word/document.xml"}
    assert _texts(Extraction(edit.replace_docx_text(made, ("text b", "T\nU"))))["b"] == "T\nU"
    parts = spark.createDataFrame([("a", "word/document.xml", b"<x/>")], "doc_id string, path string, bytes binary")
    plan = edit.save(made, parts)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "BroadcastHashJoin LeftAnti" in plan
    assert _texts(Extraction(edit.replace_docx_text(made, ("", "x")))) == _texts(Extraction(made))


def test_part_source(spark, tmp_path):
    """Pushed filters, partitions, broken files and members; an extraction from parts equals one from packages."""
    made = _made(spark, {k: _p(f"text {k}") for k in "abc"}, parts={"numbering.xml": B.numbering_xml([("decimal", 1)]), "core.xml": B.core({"dc:title": F.col("id")})}, media={"m.bin": F.lit(b"\x00\x01")})
    save_files(made.withColumn("name", F.concat("doc_id", F.lit("/x.docx"))), str(tmp_path), "name", "content")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(io.BytesIO((tmp_path / "a" / "x.docx").read_bytes())) as z:
        members = {n: z.read(n) for n in z.namelist()}
    every = read_parts(spark, str(tmp_path))
    assert {r["doc_id"] for r in every.filter("path is null").collect()} == {"bad.docx"}
    wanted = every.filter("type in ('image', 'core-properties') and doc_id = 'a/x.docx'")
    assert {(r["path"], bytes(r["bytes"])) for r in wanted.collect()} == {(n, members[n]) for n in ("word/media/m.bin", "docProps/core.xml")}
    plan = wanted._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(type, [core-properties,image])" in plan and "EqualTo(doc_id,a/x.docx)" in plan and "Exchange" not in plan and "Condition" not in plan
    reader = PartReader({"path": str(tmp_path), "partitionbytes": "1"})
    assert len(reader.partitions()) == 4 and sum(len(p.files) for p in PartReader({"path": f"file://{tmp_path}"}).partitions()) == 4
    want, got = Extraction(made), Extraction(every.withColumn("doc_id", F.regexp_replace("doc_id", "/x.docx", "")))
    for view in ("text", "document", "core_properties", "images"):
        rows = [sorted(map(str, (tuple(r) for r in getattr(e, view).select(*getattr(want, view).columns).filter("doc_id <> 'bad.docx'").collect()))) for e in (want, got)]
        assert rows[0] == rows[1]
    assert [(r["doc_id"], r["stage"]) for r in got.errors.collect()] == [("bad.docx", "unzip")]
