"""XML parts to a node table with interval encoding (S9), and back.

pre and post come from one counter: a is an ancestor of d iff a.pre < d.pre and d.post < a.post, and pre (open) and post (close) order
all events of a part.  Names stay prefixed as written (w:p), so transitional and strict packages look alike; comments and
processing instructions have no name, are skipped and counted at the root.  Besides the tree the shredder emits plain facts about it; what they mean is left to the plans:

p_dist      levels down to the nearest w:p at or below the node, null if none
par, run, cell, link, top   pre of the innermost w:p / w:r / w:tc at or above, of the innermost w:hyperlink above, and of the root's child at or above
link_child  pre of the child of that hyperlink at or above the node
math        whether a m:oMath stands above
formula     pre of the outermost m:oMath at or above
content     whether a content tag stands at or below
skipped     at a root: comments and processing instructions in the part
up, upup    names of parent and grandparent; upper: pre of the grandparent
kin         at a w:r or w:hyperlink: pre of the first of the neighbours (siblings with content) of its name, in a row up to it
chain       kin of the innermost w:r at or above; chain_end: at the first of neighbours, post of the last of them
child_chain kin of the link_child if that is a w:r, else the link_child
p_style, p_num, p_level   at a w:p: w:val of w:pStyle, w:numId and w:ilvl in its properties outside hyperlinks, the greatest of several
props       at a w:r: local name to w:val of the children of w:rPr; empty values are null, of equal names the last wins
spans       whether the part has cells with w:gridSpan or w:vMerge
"""

from __future__ import annotations

from itertools import accumulate, repeat
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packages import LISTS, RELATIONS, Package

#: The tags that count as content.
CONTENT_TAGS = {
    "w:body", "w:br", "w:commentRangeEnd", "w:commentRangeStart", "w:document", "w:endnote", "w:endnoteReference", "w:footnote", "w:footnoteReference",
    "w:checkBox", "w:ddList", "w:hyperlink", "a:blip", "v:imagedata", "wp:docPr", "m:oMath", "w:p", "w:r", "w:sdt", "w:sym", "w:tab", "w:tbl", "w:tc", "w:tr", "w:t", "m:t",
}

#: The tags of which neighbours may merge.
MERGING = ("w:r", "w:hyperlink")

NODES = (
    "pre int, post int, parent int, level int, ord int, name string, attrs map<string,string>, text string, tail string, p_dist int, par int, run int, cell int, "
    "link int, link_child int, top int, formula int, math boolean, content boolean, up string, upup string, upper int, skipped int, "
    "kin int, chain int, chain_end int, child_chain int, p_style string, p_num string, p_level string, props map<string,string>, spans boolean"
)
_FIELDS = [f.strip().split(" ", 1)[0] for f in NODES.replace("map<string,string>", "map").split(", ")]
_KINDS = [pa.int32() if k == "int" else pa.bool_() if k == "boolean" else pa.map_(pa.string(), pa.string()) if k == "map" else pa.string() for k in (f.strip().split(" ", 1)[1] for f in NODES.replace("map<string,string>", "map").split(", "))]
_AT = {f: n for n, f in enumerate(_FIELDS)}
PRE, POST, PARENT, LEVEL, NAME, TEXT, TAIL, P_DIST, PAR, RUN, CELL, LINK, LINK_CHILD, TOP, FORMULA, MATH, CONTENT, UP, UPUP, SKIPPED, KIN, CHAIN, CHAIN_END, CHILD_CHAIN, PROPS, SPANS = (
    _AT[f] for f in "pre post parent level name text tail p_dist par run cell link link_child top formula math content up upup skipped kin chain chain_end child_chain props spans".split()
)
_NUMBERS = {"w:numId": _AT["p_num"], "w:ilvl": _AT["p_level"]}
#: Elements of properties, of which the nodes that hold them carry the facts.
PROPERTIES = ("w:pPr", "w:rPr")
#: Bytes of parts that are parsed once if a task meets them again, and how many such parts are kept.
SAME, KEPT = 4096, 64


class _Builder:
    """Collects the nodes of parts as rows, in document order.

    lean: of the nodes at or below PROPERTIES only those of these names stay, and what holds content, paragraphs or formulas, or is read by its place; None: all.
    """

    def __init__(self, known: dict | None = None, lean: frozenset[str] | None = None) -> None:
        self.rows: list[list] = []
        self.lean = lean
        self.known: dict[bytes, list[list]] = {} if known is None else known  # small parts, which many packages share: their rows are not changed any more
        self.begin_part()

    def begin_part(self) -> None:
        # open nodes, the number of children each has, and the last child with content of each
        self.clock, self.open, self.kids, self.heads, self.last, self.slot, self.skipped, self.spans = 0, [], [], [], None, TEXT, 0, False
        self.begun: list[int] = []  # rows before each open element of PROPERTIES

    def start(self, name: str, attrs: list) -> None:
        pre = self.clock
        self.clock = pre + 1
        content = name in CONTENT_TAGS
        head = None
        if self.open:
            up = self.open[-1]
            u_pre, u_name = up[PRE], up[NAME]
            par, run, cell, link, link_child, formula, chain, child_chain = up[PAR], up[RUN], up[CELL], up[LINK], up[LINK_CHILD], up[FORMULA], up[CHAIN], up[CHILD_CHAIN]
            level, order, upup, upper = up[LEVEL] + 1, self.kids[-1], up[UP], up[PARENT]
            top = pre if level == 1 else up[TOP]
            math = up[MATH] or u_name == "m:oMath"
            self.kids[-1] = order + 1
            if name in MERGING:
                head = self.heads[-1]
                head = head if head is not None and head[NAME] == name else None
        else:
            u_pre = u_name = par = run = cell = link = link_child = formula = chain = child_chain = upup = upper = top = None
            level, order, math = 0, 0, False
        kin = None
        if name in MERGING:
            kin = pre if head is None else head[KIN]
        if name == "w:p":
            par = pre
        elif name == "w:r":
            run, chain = pre, kin
        elif name == "w:tc":
            cell = pre
        elif name == "m:oMath":
            if formula is None:
                formula = pre
        if u_name == "w:hyperlink":
            link, link_child, child_chain = u_pre, pre, kin if name == "w:r" else pre
        row = [
            pre, -1, u_pre, level, order, name, attrs, "", "", 0 if name == "w:p" else None, par, run, cell, link, link_child, top, formula, math, content, u_name, upup, upper, None,
            kin, chain, None, child_chain, None, None, None, None, False,
        ]
        if u_name is not None and u_name.endswith("Pr"):
            self.property(row, name, attrs)
        if self.lean is not None and name in PROPERTIES and self.open:
            self.begun.append(len(self.rows))
        self.rows.append(row)
        self.open.append(row)
        self.kids.append(0)
        self.heads.append(None)
        self.last, self.slot = row, TEXT

    def property(self, row: list, name: str, attrs: list) -> None:
        """Notes on the node above what its property element says."""
        up, upup = row[UP], row[UPUP]
        if up == "w:tcPr":
            self.spans = self.spans or name in ("w:gridSpan", "w:vMerge")
            return
        if up == "w:rPr":
            if upup == "w:r":
                held = self.open[-2][PROPS] or {}
                held[name.rpartition(":")[2]] = _value(attrs) or None
                self.open[-2][PROPS] = held
            return
        if row[LINK] is not None:
            return
        at = None
        if up == "w:pPr" and name == "w:pStyle" and upup == "w:p":
            at, owner = _AT["p_style"], self.open[-2]
        elif up == "w:numPr" and upup == "w:pPr" and name in _NUMBERS and row[PAR] is not None:
            at, owner = _NUMBERS[name], next(x for x in reversed(self.open) if x[PRE] == row[PAR])
        if at is not None and (value := _value(attrs)) is not None and (owner[at] is None or owner[at] < value):
            owner[at] = value

    def end(self, name: str) -> None:
        row = self.open.pop()
        self.kids.pop()
        self.heads.pop()
        row[POST] = self.clock
        self.clock += 1
        if self.open:
            up = self.open[-1]
            if row[CONTENT]:
                up[CONTENT] = True
                head = self.heads[-1]
                if row[KIN] is not None:
                    if head is None or head[PRE] != row[KIN]:
                        self.heads[-1] = head = row
                    head[CHAIN_END] = row[POST]
                else:
                    self.heads[-1] = None
            near = row[P_DIST]
            if near is not None and (up[P_DIST] is None or up[P_DIST] > near + 1):
                up[P_DIST] = near + 1
            if self.lean is not None and name in PROPERTIES:
                at = self.begun.pop()
                self.rows[at:] = [r for r in self.rows[at:] if self.stays(r)]
        elif row[KIN] is not None:
            row[CHAIN_END] = row[POST]
        self.last, self.slot = row, TAIL

    def stays(self, r: list) -> bool:
        return r[CONTENT] or r[P_DIST] is not None or r[FORMULA] is not None or r[LEVEL] < 2 or r[PRE] == r[LINK_CHILD] or r[NAME] in self.lean or r[UP] in ("w:checkBox", "w:ddList")

    def data(self, text: str) -> None:
        if self.last is not None:
            self.last[self.slot] += text

    def skip(self, *_: str) -> None:
        self.skipped += 1

    def add(self, raw: bytes | Exception) -> tuple[int, str | None]:
        """Appends the nodes of a part: how many rows, and the error; a part that is broken, or could not be read, leaves one empty row."""
        before = len(self.rows)
        if isinstance(raw, Exception):
            return self.fail(before, raw)
        if (same := self.known.get(raw)) is not None:
            self.rows.extend(same)
            return len(same), None
        self.begin_part()
        parser = expat.ParserCreate()
        parser.buffer_text = parser.ordered_attributes = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.data
        parser.CommentHandler = parser.ProcessingInstructionHandler = self.skip
        try:
            parser.Parse(raw, True)
        except Exception as e:  # not only bad markup: an encoding that nobody knows, too
            return self.fail(before, e)
        self.rows[before][SKIPPED] = self.skipped
        if self.spans:
            for row in self.rows[before:]:
                row[SPANS] = True
        if len(raw) <= SAME:
            if len(self.known) >= KEPT:
                self.known.pop(next(iter(self.known)))
            self.known[raw] = self.rows[before:]
        return len(self.rows) - before, None

    def fail(self, before: int, e: Exception) -> tuple[int, str]:
        self.rows[before:] = [[None] * len(_FIELDS)]
        return 1, str(e) if isinstance(e, expat.ExpatError) else f"{type(e).__name__}: {e}"

    def columns(self) -> list[pa.Array]:
        """The rows as Arrow arrays."""
        n = len(self.rows)  # many columns are null in all rows
        return [pa.nulls(n, k) if c.count(None) == n else _maps(c) if pa.types.is_map(k) else pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), _KINDS, strict=True)]


def _value(attrs: list) -> str | None:
    """w:val of attributes (name, value, name, value ...)."""
    for n in range(0, len(attrs), 2):
        if attrs[n] == "w:val":
            return attrs[n + 1]
    return None


def _maps(values: tuple) -> pa.Array:
    """Maps from lists (key, value, key, value ...) or dicts; None is null."""
    some = [x for x in values if x]
    keys = [k for x in some for k in (x if isinstance(x, dict) else x[::2])]
    items = [v for x in some for v in (x.values() if isinstance(x, dict) else x[1::2])]
    ends = list(accumulate((0 if not x else len(x) if isinstance(x, dict) else len(x) >> 1 for x in values), initial=0))
    if None in values:
        ends[:-1] = [None if x is None else at for x, at in zip(values, ends, strict=False)]
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(items, pa.string()))


#: Node rows of one Arrow batch, about.
MANY = 20_000


def _emit(parts, keep: list[str], kinds: list[pa.DataType], lean: frozenset[str] | None = None):
    """Arrow batches of (keep, NODES, error) from (values of keep, raw bytes, quiet) triples; a quiet part leaves no rows but an error's.  lean: see _Builder; parts whose first value is not 'part' are whole."""
    known: dict = {}
    whole: dict = {}
    nodes, sizes, errors, keys = _Builder(), [], [], []

    def batch() -> pa.RecordBatch:
        at = pa.array(np.repeat(np.arange(len(keys)), sizes))
        cols = [pa.array([k[n] for k in keys], kind).take(at) for n, kind in enumerate(kinds)]
        cols += nodes.columns()
        return pa.RecordBatch.from_arrays([*cols, pa.array(errors, pa.string()).take(at)], [*keep, *_FIELDS, "error"])

    for key, raw, quiet in parts:
        nodes.lean, nodes.known = (lean, known) if lean is not None and key[0] == "part" else (None, whole)
        n, error = nodes.add(raw or b"")
        if quiet and error is None:
            del nodes.rows[-n:]
            continue
        keys.append(key)
        sizes.append(n)
        errors.append(error)
        if len(nodes.rows) > MANY:
            yield batch()
            nodes, sizes, errors, keys = _Builder(), [], [], []
    if keys:
        yield batch()


def shred(parts: DataFrame, keep: list[str], lean: frozenset[str] | None = None) -> DataFrame:
    """keep (texts), the columns of NODES and error: a row for each element of the column bytes; a part that is no XML gives one row with its error only.  lean: see scan_packages."""
    schema = ", ".join(f"{c} string" for c in keep) + ", " + NODES + ", error string"

    def run(batches):
        def pairs():
            for b in batches:
                cols = [b.column(n).to_pylist() for n in range(len(keep))]
                yield from zip(zip(*cols, strict=True), b.column(len(keep)).to_pylist(), repeat(False))

        yield from _emit(pairs(), keep, [pa.string()] * len(keep), lean)

    return parts.select(*keep, "bytes").mapInArrow(run, schema)


#: Types of parts that a scan reads besides those asked for.
ALWAYS = (RELATIONS, LISTS, "core-properties")


def kind_of(type_: str) -> str:
    """Which table of the scan a part's nodes belong to."""
    return {RELATIONS: "rels", LISTS: "numbering", "core-properties": "core"}.get(type_, "part")


def scan_packages(packages: DataFrame, types: tuple[str, ...] | None, lean: frozenset[str] | None = None) -> DataFrame:
    """kind, doc_id, path, type, NODES, error: all markup that an extraction needs, from one reading of each package (doc_id, content).

    kind: part (parts of the given types), rels, numbering, core, or package (no nodes: a package or .rels member that cannot be read).  Relationships are
    read, parts unzipped and parsed in one crossing where the package is, so that neither bytes nor markup are exchanged.  Parts that a
    package lacks are left out; one that cannot be read (bad checksum, password, unknown encoding) gives a row with its error.
    The nodes of .rels members, which few plans read, are left out but for errors; types None gives these nodes, and nothing else.
    lean: names of tags; the nodes of paragraph and run properties that have other names, hold no content and are no facts' only place are then left out too.
    """
    wanted = {RELATIONS} if types is None else {*types, *ALWAYS}

    def run(batches):
        def pairs():
            for b in batches:
                for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    try:
                        package = Package(raw.as_py())
                    except Exception as e:  # one bad package must not stop the corpus
                        yield ("package", doc, None, None), e, False
                        continue
                    for path, type_ in package.parts():
                        if type_ in wanted:
                            part = package.read(path)
                            broken = isinstance(part, Exception) and type_ == RELATIONS
                            yield ("package" if broken else kind_of(type_), doc, path, type_), part, type_ == RELATIONS and types is not None

        yield from _emit(pairs(), ["kind", "doc_id", "path", "type"], [pa.string()] * 4, lean)

    return packages.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, "kind string, doc_id string, path string, type string, " + NODES + ", error string")


def scan_parts(parts: DataFrame, types: tuple[str, ...] | None, lean: frozenset[str] | None = None) -> DataFrame:
    """The same from a table of parts (doc_id, path, type, bytes, error): the filter on types reaches its source."""
    of = F.when(F.col("type").isNull() | ((F.col("type") == RELATIONS) & F.col("error").isNotNull()), "package")
    for t in ALWAYS:
        of = of.when(F.col("type") == t, kind_of(t))
    live = parts.filter(F.col("type").isin(*((RELATIONS,) if types is None else sorted({*types, *ALWAYS}))) | F.col("type").isNull())
    bad = live.filter("error is not null").select(of.otherwise("part").alias("kind"), "doc_id", "path", "type", "error")
    good = live.filter("error is null").select(of.otherwise("part").alias("kind"), "doc_id", "path", "type", "bytes")
    nodes = shred(good, ["kind", "doc_id", "path", "type"], lean)
    nodes = nodes if types is None else nodes.filter("kind <> 'rels' or error is not null")
    return nodes.unionByName(bad, allowMissingColumns=True)


def escaped(text: Column, attribute: bool = False) -> Column:
    """Text for markup; in attributes also quotes and white space that a reader would make blanks of."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")] + ([('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")] if attribute else [])
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def serialise(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Keep and bytes, each part's XML from its node rows, which may have been edited: opening and closing strings, joined in order by one aggregate.

    Columns read: pre, post, name, attrs, text, tail, and if there are any: sub (array of int, the order of several rows of one pre), closed (true for rows that
    hold nothing below them though they share another's pre and post), anchor (int: the row and all below it stand after what closes there).  Whoever leaves
    a row out must leave out what is below it (see without).
    """
    has = set(nodes.columns)
    sub = F.col("sub") if "sub" in has else F.array(F.lit(0))
    closed = F.coalesce("closed", F.lit(False)) if "closed" in has else F.lit(False)
    moved = F.when(F.col("anchor").isNotNull(), F.array("anchor", F.lit(1))) if "anchor" in has else None
    at = lambda key: F.concat(F.coalesce(moved, F.expr("cast(array() as array<int>)")), key) if moved is not None else key
    attrs = F.array_join(F.transform(F.map_entries(F.coalesce("attrs", F.expr("cast(map() as map<string,string>)"))), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"], True), F.lit('"'))), "")
    opening = F.concat(F.lit("<"), F.col("name"), attrs, F.lit(">"), escaped(F.coalesce("text", F.lit(""))))
    closing = F.concat(F.lit("</"), F.col("name"), F.lit(">"), escaped(F.coalesce("tail", F.lit(""))))
    open_key, close_key = at(F.concat(F.array("pre"), sub)), at(F.array("post"))
    item = lambda key, text: F.struct(key.alias("key"), text.alias("s"))
    items = nodes.select(*keep, F.inline(F.when(closed, F.array(item(open_key, F.concat(opening, closing)))).otherwise(F.array(item(open_key, opening), item(close_key, closing)))))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    text = F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "s"))), lambda x: x["s"]), ""))
    return items.groupBy(*keep).agg(F.encode(text, "utf-8").alias("bytes"))


def without(nodes: DataFrame, gone: Column, key: list[str]) -> DataFrame:
    """nodes less the rows for which gone is true and all below them."""
    before = Window.partitionBy(*key).orderBy("pre").rangeBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(gone, F.lit(False))
    return nodes.withColumn("_end", F.max(F.when(gone, F.col("post"))).over(before)).filter(~gone & (F.col("_end").isNull() | (F.col("pre") > F.col("_end")))).drop("_end")
