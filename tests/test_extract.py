"""One package with most features, extracted with html off and on."""

import pytest
from pyspark.sql import functions as F

from quire.operators import edit, iterate, views
from quire.plans.extract import Extraction, properties
from quire.sources import build as B
from quire.sources import parts as P
from quire.sources.packages import read_packages, save_files, unzip

BODY = (
    '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Ti</w:t></w:r><w:proofErr/><w:r><w:rPr><w:b/></w:rPr><w:t>tle &amp; more</w:t></w:r><w:r><w:t> plain</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>sub</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="7"/></w:numPr></w:pPr><w:r><w:t>unknown list</w:t></w:r></w:p>'
    '<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr>'
    "<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>C</w:t></w:r></w:p></w:tc></w:tr>"
    '<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    '<w:p><w:commentRangeStart w:id="0"/><w:r><w:t>see </w:t></w:r><w:hyperlink r:id="L1" w:anchor="spot"><w:r><w:t>li</w:t></w:r><w:r><w:t>nk</w:t></w:r></w:hyperlink>'
    '<w:hyperlink r:id="L2"><w:r><w:t>!</w:t></w:r></w:hyperlink><w:commentRangeEnd w:id="0"/><w:r><w:footnoteReference w:id="2"/><w:br/><w:t>end</w:t></w:r><m:oMath><m:r><m:t>x=1</m:t></m:r></m:oMath></w:p>'
    '<w:p><w:hyperlink w:anchor="toc"><w:r><w:rPr><w:i/></w:rPr><w:t>toc</w:t></w:r><w:r><w:t>2</w:t></w:r></w:hyperlink><w:r><w:t>before</w:t><w:drawing><wp:inline><w:txbx><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbx></wp:inline></w:drawing><w:t>after</w:t></w:r></w:p>'
    '<w:sdt><w:sdtContent><w:p><w:r><w:tab/><w:sym w:font="Wing" w:char="F0E0"/><w:t>s</w:t></w:r></w:p></w:sdtContent></w:sdt>'
)
NOTES = '<w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote>'
COMMENTS = '<w:comment w:id="0" w:author="Me" w:date="d"><w:p><w:r><w:t>remark</w:t></w:r></w:p><w:p><w:r><w:t>more</w:t></w:r></w:p></w:comment>'


@pytest.fixture(scope="module")
def package(spark):
    df = spark.range(1).withColumn("links", F.expr("array(struct('L1' as id, 'http://x' as target), struct('L2' as id, 'http://x' as target))"))
    parts = {
        "document.xml": B.document(F.lit(BODY)),
        "header1.xml": B.root("hdr", F.lit("<w:p><w:r><w:t>head</w:t></w:r></w:p>")),
        "footnotes.xml": B.root("footnotes", F.lit(NOTES)),
        "comments.xml": B.root("comments", F.lit(COMMENTS)),
        "numbering.xml": B.numbering_xml([("decimal", 3), ("lowerLetter", None)]),
        "core.xml": B.core({"dc:title": F.lit("T"), "dc:creator": F.lit("")}),
    }
    return B.build(df, F.lit("d1"), parts, links=F.col("links"), media={"a.png": F.lit(b"xyz")}).persist()


@pytest.fixture(scope="module")
def plain(package):
    return Extraction(package)


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_document(plain):
    got = sorted(_rows(plain.document, "section", "i", "j", "k", "l", "run_strings"))
    link = '<a href="http://x#spot">link!</a>'
    assert got == [
        (0, 0, 0, 0, 0, ["head"]),
        (1, 1, 0, 0, 0, ["Title & more plain"]),
        (1, 1, 0, 0, 1, ["3)\t", "one"]),
        (1, 1, 0, 0, 2, ["\ta)\t", "sub"]),
        (1, 1, 0, 0, 3, ["--\t", "unknown list"]),
        (1, 2, 0, 0, 0, ["A"]),
        (1, 2, 0, 1, 0, ["B"]),
        (1, 2, 1, 0, 0, ["A"]),
        (1, 2, 1, 1, 0, ["C"]),
        (1, 2, 2, 0, 0, ["wide"]),
        (1, 2, 2, 1, 0, ["wide"]),
        (1, 3, 0, 0, 0, ["see ", link, "----footnote2----", "\nend", "<latex>x=1</latex>"]),
        # a text box closes before the paragraph around it, and breaks the table
        (1, 4, 0, 0, 0, ["boxed"]),
        (1, 5, 0, 0, 0, ["toc2", "beforeafter"]),
        (1, 5, 1, 0, 0, ["\t", "<span style=font-family:Wing>&#x00E0;</span>s"]),
        (3, 6, 0, 0, 0, []),
        (3, 6, 0, 1, 0, ["footnote2)\t", "note"]),
    ]


def test_lineage_and_lists(plain):
    got = {r["text"]: (r["lineage"], r["list_id"], r["list_pos"], r["style"]) for r in plain.document.collect()}
    assert got["B"][0] == ["document", "tbl", "tr", "tc", "p"]
    assert got["head"][0] == ["document", None, None, "hdr", "p"]
    assert got["footnote2)\tnote"][0] == ["document", None, "footnotes", "footnote", "p"]
    assert got["\ta)\tsub"][1:3] == ("1", [1, 1])
    assert got["Title & more plain"][1:] == (None, [], "Heading1")


def test_html(package):
    with Extraction(package, html=True) as e:
        got = {r["text"]: r["run_strings"] for r in e.headings.collect()}
        assert list(got.values()) == [["<h1>", "<b>Title &amp; more</b>", " plain", "</h1>"]]
        links = [r["run_strings"] for r in e.document.collect() if "toc" in r["text"]]
        assert links == [["<i>toc</i>\n\n2", "beforeafter"]]


def test_no_duplicates(package):
    with Extraction(package, duplicate_merged_cells=False) as e:
        got = sorted(_rows(e.document.filter("i = 2"), "j", "k", "text", "lineage"))
        assert [g[:3] for g in got] == [(0, 0, "A"), (0, 1, "B"), (1, 0, ""), (1, 1, "C"), (2, 0, "wide"), (2, 1, "")]
        assert got[-1][3] == ["document", "", "", "", ""]


def test_parts_of_results(plain):
    assert _rows(plain.comments, "id", "reference", "author", "date", "text") == [("0", 'see <a href="http://x#spot">link!</a>', "Me", "d", "remark\n\nmore")]
    assert _rows(plain.links, "href", "text") == [("http://x#spot", "link!")]
    assert plain.core_properties.collect()[0]["properties"] == {"title": "T", "creator": None}
    assert [(r["name"], bytes(r["bytes"])) for r in plain.images.collect()] == [("a.png", b"xyz")]
    assert plain.errors.count() == 0
    assert plain.section("body").count() == plain.section("officeDocument").count() == 14
    assert P.file_of_type(plain.parts, "header").collect()[0]["path"] == "word/header1.xml"
    text = plain.text.collect()[0]["text"]
    assert text.startswith("head\n\nTitle & more plain\n\n3)\tone") and text.endswith("\n\n\n\nfootnote2)\tnote")


def test_views(plain):
    doc = plain.document
    assert "|A|B|\n|---|---|\n|A|C|\n|wide|wide|" in views.markdown(doc).collect()[0]["markdown"]
    assert "<td><pre>(2, 0, 1, 0) B</pre></td></tr>" in views.html_map(doc).collect()[0]["html_map"]
    assert {r["i"]: r["is_tbl"] for r in iterate.is_tbl(doc).collect()} == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False, 6: False}
    nodes = plain.nodes.filter("type = 'officeDocument'")
    cell = iterate.nearest(nodes, "w:tc").join(nodes.filter("name = 'w:t' and text = 'C'").select("doc_id", "path", "pre"), ["doc_id", "path", "pre"])
    assert cell.count() == 1 and cell.collect()[0]["found"] is not None
    props = properties(nodes.filter("up = 'w:tcPr'"), F.col("upper").alias("cell")).collect()
    assert {"gridSpan": "2"} in [p["properties"] for p in props] and {"vMerge": None} in [p["properties"] for p in props]
    assert iterate.children(nodes, nodes.filter("name = 'w:tr'"), "w:tc").count() == 5


def test_replace(package, tmp_path):
    saved = edit.replace_docx_text(package, ("Title", "HELLO\nTHERE"), ("one", "two & 2"), ("unknown list", ""))
    with Extraction(saved) as e:
        got = sorted(_rows(e.document.filter("i = 1"), "l", "text"))
    assert got == [(0, "HELLO\nTHERE & more plain"), (1, "3)\ttwo & 2"), (2, "\ta)\tsub"), (3, "--\t")]
    before, after = ({r["member"]: bytes(r["bytes"]) for r in unzip(p).collect()} for p in (package, saved))
    assert before.keys() == after.keys()
    assert all(before[m] == after[m] for m in before if m not in ("word/document.xml", "word/header1.xml", "word/footnotes.xml"))
    save_files(saved.withColumn("name", F.concat("doc_id", F.lit(".docx"))), str(tmp_path), "name", "content")
    again = read_packages(saved.sparkSession, str(tmp_path))
    assert [(r["doc_id"], bytes(r["content"])) for r in again.collect()] == [("d1.docx", bytes(saved.collect()[0]["content"]))]


def test_bad_packages(spark, package):
    bad = spark.createDataFrame([("broken", b"no zip"), ("empty", None)], "doc_id string, content binary")
    odd = B.build(spark.range(1), F.lit("odd"), {"document.xml": "<w:document><w:body>"})
    with Extraction(bad.unionByName(odd).unionByName(package)) as e:
        assert {r["doc_id"] for r in e.errors.collect()} == {"broken", "empty", "odd"}
        assert {r["doc_id"] for r in e.text.collect()} == {"d1"}


def _zipped(members, spoilt=None, fate=None):
    """A package; spoilt: the member that has a bad checksum or a password."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    raw = bytearray(out.getvalue())
    for name, text in members.items():
        if name != spoilt:
            continue
        if fate == "checksum":
            at = raw.index(text.encode())
            raw[at + len(text) // 2] ^= 1
        elif fate == "password":
            for mark, offset in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
                at = -1
                while (at := raw.find(mark, at + 1)) >= 0:
                    if raw[at + (30 if offset == 6 else 46) :].startswith(name.encode()):
                        raw[at + offset] |= 1
    return bytes(raw)


def test_spoilt_members(spark):
    """A bad checksum, a password or an unknown encoding costs one part; the others and all other packages go on."""
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    rels = lambda *x: "<Relationships xmlns='r'>" + "".join(f'<Relationship Id="r{n}" Type="{kind}{k}" Target="{t}"/>' for n, (k, t) in enumerate(x)) + "</Relationships>"
    text = lambda tag, x: f'<w:{tag} xmlns:w="w"><w:body><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:body></w:{tag}>'
    members = {"_rels/.rels": rels(("officeDocument", "word/document.xml")), "word/_rels/document.xml.rels": rels(("header", "header1.xml"), ("header", "header2.xml")), "word/document.xml": text("document", "main"), "word/header1.xml": text("hdr", "one"), "word/header2.xml": text("hdr", "two")}
    cases = {
        "fine": _zipped(members), "sum": _zipped(members, "word/header1.xml", "checksum"), "locked": _zipped(members, "word/header2.xml", "password"),
        "coded": _zipped(members | {"word/header1.xml": '<?xml version="1.0" encoding="foo"?>' + text("hdr", "one")}), "rels": _zipped(members, "word/document.xml", "checksum"), "cut": _zipped(members)[:-40],
    }
    with Extraction(spark.createDataFrame(list(cases.items()), "doc_id string, content binary")) as e:
        got = {r["doc_id"]: r["text"] for r in e.text.collect()}
        errors = {(r["doc_id"], r["stage"]) for r in e.errors.collect()}
    assert got == {"fine": "one\n\ntwo\n\nmain", "sum": "two\n\nmain", "locked": "one\n\nmain", "coded": "two\n\nmain", "rels": "one\n\ntwo"}
    assert errors == {("sum", "parse word/header1.xml"), ("locked", "parse word/header2.xml"), ("coded", "parse word/header1.xml"), ("rels", "parse word/document.xml"), ("cut", "unzip")}


def test_files_of_one_name(spark, package, tmp_path):
    for n, folder in enumerate(("a", "b/c", "")):
        body = B.document(B.p(B.r(B.t(F.lit(f"file {n}")))))
        made = B.build(spark.range(1), F.lit("same.docx"), {"document.xml": body})
        save_files(made.withColumn("name", F.lit(f"{folder}/same.docx".lstrip("/"))), str(tmp_path), "name", "content")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        with Extraction(read_packages(spark, root)) as e:
            assert {r["doc_id"]: r["text"] for r in e.text.collect()} == {"a/same.docx": "file 0", "b/c/same.docx": "file 1", "same.docx": "file 2"}
    assert [r["doc_id"] for r in read_packages(spark, f"{tmp_path}/*/c").collect()] == ["b/c/same.docx"]
    assert [r["doc_id"] for r in read_packages(spark, f"{tmp_path}/a/same.docx").collect()] == ["same.docx"]


def test_shared_folder():
    from types import SimpleNamespace

    from quire.sources import store

    none = SimpleNamespace(isDefined=lambda: False)
    named = SimpleNamespace(isDefined=lambda: True, get=lambda: "hdfs://x/y/")

    def session(master, checkpoint):
        context = SimpleNamespace(master=master, getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: checkpoint)))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=context)

    assert store.shared_dir(session("yarn", named)) == "hdfs://x/y" and store.shared_dir(session("local[2]", none)).startswith("file://")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            store.shared_dir(session(master, none))


def test_comment_references(spark):
    """Overlapping, nested, empty and reversed ranges."""
    mark = lambda kind, n: f'<w:commentRange{kind} w:id="{n}"/>'
    run = lambda x, style="": f"<w:r><w:rPr>{style}</w:rPr><w:t>{x}</w:t></w:r>"
    body = f"<w:p>{mark('Start', 1)}{run('ab', '<w:b/>')}{mark('Start', 2)}{run('cd', '<w:i/>')}{mark('Start', 3)}{mark('End', 3)}</w:p><w:p>{mark('End', 1)}{run('é😀', '<w:b/>')}{mark('End', 2)}{mark('End', 4)}{run('x', '<w:i/>')}{mark('Start', 4)}</w:p>"
    notes = "".join(f'<w:comment w:id="{n}"><w:p/></w:comment>' for n in (1, 2, 3, 4))
    with Extraction(B.build(spark.range(1), F.lit("d"), {"document.xml": B.document(F.lit(body)), "comments.xml": B.root("comments", F.lit(notes))}), html=True) as e:
        assert {r["id"]: r["reference"] for r in e.comments.collect()} == {"1": "<b>ab</b><i>cd</i>", "2": "<i>cd</i><b>é😀</b>", "3": "", "4": ""}


def test_warnings_and_partial(spark, package, plain):
    assert plain.warnings.count() == 0
    with Extraction(B.build(spark.range(1), F.lit("x"), {"document.xml": B.document(F.lit("<w:p/>")), "comments.xml": B.root("comments", F.lit(COMMENTS)), "numbering.xml": B.numbering_xml([("ordinal", None)])})) as e:
        assert {r["stage"] for r in e.warnings.collect()} == {"core properties", "comments", "numbering"}
        assert e.comments.count() == 0
    rows = plain.nodes.filter("name = 'w:tr'")
    with plain.partial(rows) as part:
        got = [r["text"] for r in part.document.orderBy("path", "i", "j", "k").collect()]
        assert sorted(got) == ["", "A", "B", "C", "wide", "wide"]
    subs = plain.nodes.filter("name = 'w:p' and type = 'officeDocument'").join(plain.paragraphs.filter("list_pos = array(1, 1)").select("doc_id", "path", "pre"), ["doc_id", "path", "pre"])
    with plain.partial(subs) as part:
        assert [r["text"] for r in part.document.collect()] == ["\ta)\tsub"]


def test_stream(spark, package, tmp_path):
    from quire.streaming.ingest import ingest, stream_packages

    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    save_files(package.withColumn("name", F.concat("doc_id", F.lit(".docx"))), str(source), "name", "content")
    q = ingest(stream_packages(spark, str(source)), str(out), str(tmp_path / "state"), view=lambda e: e.text)
    q.awaitTermination(120)
    got = spark.read.parquet(str(out)).collect()
    assert len(got) == 1 and got[0]["text"].startswith("head\n\nTitle")
