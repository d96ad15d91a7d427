"""Packages: zip containers as rows.  S1 open, S2 zip scan, S7 part filter, S13 image sink, S15 save."""

from __future__ import annotations

import functools
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, of one Arrow batch of binary columns, about.
FEW, HEAVY = 64, 16 << 20
#: Where list formats are, whatever relationships say, and the types given to it and to .rels members.
NUMBERING, LISTS, RELATIONS = "word/numbering.xml", "numbering", "relationships"


class Member:
    """What the central directory says of a member, by the names that zipfile gives it."""

    __slots__ = ("filename", "flag_bits", "compress_type", "CRC", "compress_size", "file_size", "header_offset")

    def __init__(self, filename: str, flag_bits: int, compress_type: int, crc: int, compress_size: int, file_size: int, header_offset: int) -> None:
        self.filename, self.flag_bits, self.compress_type, self.CRC = filename, flag_bits, compress_type, crc
        self.compress_size, self.file_size, self.header_offset = compress_size, file_size, header_offset

    @property
    def orig_filename(self) -> str:
        return self.filename


#: An entry of a central directory, and the record at its end.
_ENTRY, _END = struct.Struct("<4s2x5H3L3H8xL"), struct.Struct("<4s4H2LH")


def _directory(raw: bytes) -> list[Member] | None:
    """The members of a package with a plain central directory at its very end; None for all others, which zipfile reads or rejects."""
    end = len(raw) - _END.size
    if end < 0:
        return None
    mark, disk, first, here, n, size, at, comment = _END.unpack_from(raw, end)
    if mark != b"PK\x05\x06" or disk or first or comment or here != n or at + size != end:
        return None
    out = []
    for _ in range(n):
        if at + _ENTRY.size > end:
            return None
        mark, needed, flags, method, _, _, crc, packed_size, file_size, name, extra, more, offset = _ENTRY.unpack_from(raw, at)
        at += _ENTRY.size
        text = raw[at : at + name]
        at += name + more
        if mark != b"PK\x01\x02" or extra or needed > 20 or at > end or b"\0" in text:
            return None
        try:
            out.append(Member(text.decode("utf-8" if flags & 0x800 else "cp437"), flags, method, crc, packed_size, file_size, offset))
        except UnicodeDecodeError:
            return None
    return out if at == end else None


class Package:
    """An open package: only its central directory is read until a member is asked for."""

    def __init__(self, file: bytes | BinaryIO | None) -> None:
        self.raw = file if isinstance(file, bytes) else None
        self.file = io.BytesIO(file or b"") if file is None or isinstance(file, bytes) else file
        members = _directory(self.raw) if self.raw is not None else None
        self.names = {i.filename: i for i in (members if members is not None else self.zip.infolist())}  # the last of several members of one name counts
        self.held: dict[str, bytes | Exception] = {}  # .rels members, which are read twice

    @functools.cached_property
    def zip(self) -> zipfile.ZipFile:
        """For members that are not plain."""
        return zipfile.ZipFile(self.file)

    def read(self, name: str) -> bytes | Exception:
        """A member's bytes, or why it cannot be read: one bad member must not stop the package."""
        if name in self.held:
            return self.held[name]
        try:
            out = _plain(self.raw, self.names[name]) if self.raw is not None else None
            out = self.zip.read(name) if out is None else out
        except Exception as e:
            out = e
        if name.endswith(".rels"):
            self.held[name] = out
        return out

    def parts(self) -> list[tuple[str, str]]:
        """(path, type) of the parts that relationships name and the package has, of its .rels members, and of the list formats; in order of path.  A part may have several types."""
        rels = [(n, raw if isinstance(raw := self.read(n), bytes) else None) for n in self.names if n.endswith(".rels")]  # what cannot be read shows up in the errors
        return (_parts if sum(len(raw or b"") for _, raw in rels) <= 8192 else _parts.__wrapped__)(tuple(self.names), tuple(rels))


@functools.lru_cache(64)
def _parts(names: tuple[str, ...], rels: tuple[tuple[str, bytes | None], ...]) -> list[tuple[str, str]]:
    """The parts of packages with these members and .rels members, which packages of one writer share."""
    have = set(names)
    found = {(n, RELATIONS) for n, _ in rels} | ({(NUMBERING, LISTS)} if NUMBERING in have else set())
    for n, raw in rels:
        if raw is not None:
            found.update(x for x in (_named if len(raw) <= 4096 else _named.__wrapped__)(n, raw) if x[0] in have)
    return sorted(found)


def _plain(raw: bytes, info: zipfile.ZipInfo) -> bytes | None:
    """A member that is stored or deflated, of the right size and checksum; None for all others, for which zipfile knows what is wrong."""
    if info.flag_bits & 0x61 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.file_size > HEAVY:
        return None
    at = info.header_offset
    if raw[at : at + 4] != b"PK\x03\x04" or len(raw) < at + 30:
        return None
    n, more = struct.unpack_from("<HH", raw, at + 26)
    if raw[at + 30 : at + 30 + n] != info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437", "replace"):
        return None
    begin = at + 30 + n + more
    out = raw[begin : begin + info.compress_size]
    if info.compress_type == zipfile.ZIP_DEFLATED:
        try:
            out = zlib.decompressobj(-15).decompress(out, info.file_size + 1)
        except zlib.error:
            return None
    return out if len(out) == info.file_size and zlib.crc32(out) == info.CRC else None


@functools.lru_cache(256)
def _named(rels: str, raw: bytes) -> list[tuple[str, str]]:
    """(path, type) of the parts that a .rels member names; packages of one writer share these members."""
    return [(_path_of(rels, x["Target"]), x.get("Type", "").rpartition("/")[2]) for x in _relationships(raw) if "Target" in x]


def _relationships(raw: bytes) -> list[dict]:
    """The attributes of the children of a .rels member's root; none if it is broken."""
    found: list[dict] = []
    depth = 0

    def start(_: str, attrs: dict) -> None:
        nonlocal depth
        if depth == 1:
            found.append(attrs)
        depth += 1

    def end(_: str) -> None:
        nonlocal depth
        depth -= 1

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(raw, True)
    except Exception:  # shows up in the member's own errors
        return []
    return found


def _path_of(rels_path: str, target: str) -> str:
    """S6 for one target: the same as parts.inferred_path (a test compares them)."""
    parent = re.sub("/?_rels$", "", rels_path.rpartition("/")[0])
    joined = target if not parent or target.startswith(("/", parent + "/")) else f"{parent}/{target}"
    return joined.lstrip("/.")


def last_of_name(paths: list[str]) -> set[str]:
    """Of paths with one file name the last in order."""
    return set({p.rpartition("/")[2]: p for p in sorted(paths)}.values())


def message(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def relative_id(root: str) -> Column:
    """The path of a file (column path) below root, or its name if root is the file: no two files share one.  A file that lies elsewhere keeps its whole path.

    Of a root with wildcards the folders before them count.
    """
    import os

    bare = lambda x: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?=/)", "", x).strip("/")
    full = root if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", root) else os.path.abspath(root)
    fixed = re.split(r"[*?\[{]", full, maxsplit=1)
    base = bare(fixed[0] if len(fixed) == 1 else fixed[0].rpartition("/")[0])
    whole = F.regexp_replace(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(?=/)", ""), "^/+", "")
    below = F.substring(whole, F.lit(len(base) + 2), F.length(whole))
    return F.when(whole == base, F.element_at(F.split(whole, "/"), -1)).when(whole.startswith(base + "/") if base else F.lit(False), below).otherwise(whole)


def read_packages(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """doc_id (the file's path below `path`) and content of every package there; lazy, columns pruned by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(relative_id(path).alias("doc_id"), "content")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, FEW):
            yield b.slice(a, FEW)


def gathered(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (texts, and bytes in the column of that name) as batches of FEW rows or HEAVY bytes, about."""
    kinds = [pa.binary() if n == "bytes" else pa.string() for n in names]
    at, held, size = names.index("bytes"), [], 0
    for row in rows:
        held.append(row)
        size += len(row[at] or b"")
        if len(held) == FEW or size > HEAVY:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def part_bytes(packages: DataFrame, *types: str, one_of_name: bool = False) -> DataFrame:
    """doc_id, path, type, bytes, error of the parts of these types, picked where the packages are: no bytes are exchanged.  one_of_name: of parts with one file name the last by path."""

    def rows(doc: str, raw: bytes | None) -> Iterator[tuple]:
        try:
            package = Package(raw)
        except Exception:  # shows up in the errors of the scan
            return
        wanted = [(p, t) for p, t in package.parts() if t in types]
        last = last_of_name([p for p, _ in wanted]) if one_of_name else {p for p, _ in wanted}
        for path, kind in wanted:
            if path in last:
                got = package.read(path)
                yield (doc, path, kind, None, message(got)) if isinstance(got, Exception) else (doc, path, kind, got, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for b in batches for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True) for row in rows(doc, raw.as_py()))
        yield from gathered(every, ["doc_id", "path", "type", "bytes", "error"])

    return packages.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, "doc_id string, path string, type string, bytes binary, error string")


def unzip(packages: DataFrame, keep: str = ".*") -> DataFrame:
    """doc_id, member, bytes of every member whose name matches `keep`; a broken package gives one row with member null and the error, a broken member one with its name and the error.

    The last of several members of one name wins, as in any zip reader.  The name filter runs before anything is inflated.
    """
    want = re.compile(keep)

    def rows(doc: str, raw: bytes | None) -> Iterator[tuple]:
        try:
            package = Package(raw)
        except Exception as e:  # one bad package must not stop the corpus
            yield doc, None, None, message(e)
            return
        for n in package.names:
            if want.fullmatch(n):
                got = package.read(n)
                yield (doc, n, None, message(got)) if isinstance(got, Exception) else (doc, n, got, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for b in batches for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True) for row in rows(doc, raw.as_py()))
        yield from gathered(every, ["doc_id", "member", "bytes", "error"])

    return packages.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, "doc_id string, member string, bytes binary, error string")


def zipped(members: dict[str, bytes]) -> bytes:
    """A package of these members, in order of name with the content types first."""
    return packed((name, members[name]) for name in sorted(members, key=lambda x: (x != "[Content_Types].xml", x)))


@functools.lru_cache(64)
def _deflated(x: bytes) -> bytes:
    z = zlib.compressobj(zlib.Z_BEST_SPEED, zlib.DEFLATED, -15)
    return z.compress(x) + z.flush()


def packed(members: Iterable[tuple[str, bytes]], stored: tuple[str, ...] = ()) -> bytes:
    """A zip of these members in this order, deflated unless their names are among the stored ones; zipfile writes what is too large for plain headers."""
    members = list(members)
    if sum(len(x) + 2 * len(n.encode()) + 99 for n, x in members) >= 1 << 31 or len(members) > 65_000:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, x in members:
                z.writestr(zipfile.ZipInfo(n), x, zipfile.ZIP_STORED if n in stored else zipfile.ZIP_DEFLATED)
        return out.getvalue()
    files, listed, at = [], [], 0
    for n, x in members:
        name, method = n.encode(), 0 if n in stored else 8
        data = x if not method else (_deflated if len(x) <= 1024 else _deflated.__wrapped__)(x)
        same = struct.pack("<HHHHHLLLHH", 20, 0 if n.isascii() else 0x800, method, 0, 33, zlib.crc32(x), len(data), len(x), len(name), 0)
        files += [b"PK\x03\x04", same, name, data]
        listed += [b"PK\x01\x02\x14\x03", same, struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at), name]
        at += 30 + len(name) + len(data)
    size = sum(map(len, listed))
    return b"".join([*files, *listed, b"PK\x05\x06", struct.pack("<HHHHLLH", 0, 0, len(members), len(members), size, at, 0)])


def patched(packages: DataFrame) -> DataFrame:
    """doc_id and content of packages (doc_id, content, changed: array of (path, bytes)), with the changed parts in place of their own; where they are.  Members that cannot be read are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc, raw, changed in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    package = Package(raw.as_py())
                    members = {n: x for n in package.names if isinstance(x := package.read(n), bytes)}
                    yield doc, zipped(members | {c["path"]: c["bytes"] or b"" for c in changed.as_py()})

        for batch in gathered(((d, x) for d, x in rows()), ["doc_id", "bytes"]):
            yield batch.rename_columns(["doc_id", "content"])

    return packages.select(F.col("doc_id").cast("string").alias("doc_id"), "content", "changed").mapInArrow(run, "doc_id string, content binary")


def save_files(df: DataFrame, folder: str, name: str, content: str) -> None:
    """S13/S15 sink: each row's bytes as a file below folder, a path every executor can write; folders are made as needed."""

    def run(rows) -> None:
        import os

        for r in rows:
            path = os.path.join(folder, r[name])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".part", "wb") as f:
                f.write(bytes(r[content]))
            os.replace(path + ".part", path)  # a task that runs twice leaves one whole file

    df.select(name, content).foreachPartition(run)
