"""What a scan of packages notes about their nodes, and what it does once for many packages."""

import io
import zipfile

from quire.sources import packages, shred

XML = (
    b'<w:document><w:p><w:pPr><w:pStyle w:val="H"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="9"/></w:rPr><w:t>a</w:t></w:r>'
    b"<w:proofErr/><w:r><w:t>b</w:t></w:r><w:tab/><w:r><w:t>c</w:t></w:r></w:p></w:document>"
)


def _nodes(*parts: bytes) -> list[dict]:
    b = shred._Builder()
    for x in parts:
        assert b.add(x)[1] is None
    return [dict(zip(shred._FIELDS, r, strict=True)) for r in b.rows]


def test_facts_of_runs_and_paragraphs():
    nodes = _nodes(XML)
    par = next(x for x in nodes if x["name"] == "w:p")
    assert (par["p_style"], par["p_num"], par["p_level"], par["spans"]) == ("H", "7", "1", False)
    a, b, c = (x for x in nodes if x["name"] == "w:r")
    assert (a["kin"], b["kin"], c["kin"]) == (a["pre"], a["pre"], c["pre"])  # what has no content parts no neighbours, a tab does
    assert (a["chain_end"], b["chain_end"], c["chain_end"]) == (b["post"], None, c["post"])
    assert a["props"] == {"b": None, "sz": "9"} and b["props"] is None
    assert [x["chain"] for x in nodes if x["name"] == "w:t"] == [a["pre"], a["pre"], c["pre"]]


def test_equal_small_parts_are_parsed_once(monkeypatch):
    made = []
    create = shred.expat.ParserCreate
    monkeypatch.setattr(shred.expat, "ParserCreate", lambda *x: made.append(1) or create(*x))
    nodes = _nodes(XML, XML, XML)
    assert len(made) == 1 and nodes[: len(nodes) // 3] * 3 == nodes


def test_packages_are_plain_zips():
    members = {"[Content_Types].xml": b"<x/>", "ä.bin": bytes(range(256)) * 9, "empty": b""}
    raw = packages.packed(members.items(), ("ä.bin",))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == members
    package = packages.Package(raw)
    assert {n: packages._plain(raw, i) for n, i in package.names.items()} == members
    at = raw.index(bytes(range(256)))
    bad = packages.Package(raw[:at] + b"?" + raw[at + 1 :])
    assert isinstance(bad.read("ä.bin"), zipfile.BadZipFile) and bad.read("empty") == b""


def test_plain_packages_are_read_without_zipfile(monkeypatch):
    """The central directory is read by one pass over its entries; what is not plain goes to zipfile."""
    raw = packages.packed([("[Content_Types].xml", b"<x/>"), ("word/ä.xml", XML), ("_rels/.rels", b"<Relationships/>")])
    odd = io.BytesIO()
    with zipfile.ZipFile(odd, "w") as z:
        z.writestr("a", b"1")
        z.comment = b"a comment"
    assert packages._directory(odd.getvalue()) is None and packages._directory(raw[:-1]) is None and packages._directory(b"") is None
    assert packages.Package(odd.getvalue()).read("a") == b"1"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        want = [(i.filename, i.flag_bits, i.compress_type, i.CRC, i.compress_size, i.file_size, i.header_offset) for i in z.infolist()]
    monkeypatch.setattr(packages.zipfile, "ZipFile", None)
    package = packages.Package(raw)
    assert [tuple(getattr(i, x) for x in packages.Member.__slots__) for i in package.names.values()] == want
    assert package.read("word/ä.xml") == XML and package.parts() == [("_rels/.rels", "relationships")]


def test_quiet_parts_leave_errors_only():
    """Relationships that few plans read give no nodes in the scan that all share, but their errors do."""
    good, bad = b"<Relationships><Relationship Id='a'/></Relationships>", b"<Relationships>"
    out = list(shred._emit([(("r",), good, True), (("p",), XML, False), (("s",), bad, True)], ["k"], [shred.pa.string()]))
    rows = [r for b in out for r in b.to_pylist()]
    assert {r["k"] for r in rows} == {"p", "s"} and [r["error"] is None for r in rows if r["k"] == "s"] == [False]
    assert [r["name"] for r in rows if r["k"] == "p"] == [r["name"] for r in _nodes(XML)]
    assert rows[0]["attrs"] == [] and ("w:val", "H") in [x for r in rows for x in r["attrs"] or []]
