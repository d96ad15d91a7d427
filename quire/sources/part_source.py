"""The parts of package files as a data source, read by ranges: S2, S7, S11-S13 from one scan.

    spark.dataSource.register(PartSource)
    spark.read.format("office_parts").load(folder).filter("type in ('image', 'numbering')")

Files are listed once and dealt to partitions by size and number.  A task opens each file where it is, reads its central directory and relationships, and then only
the members that the pushed filters on doc_id, path and type leave; a small file is read at once.  Paths are those that pyarrow.fs knows (local, file://, s3://, gs://, hdfs://); for
other stores packages.read_packages reads whole files by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from .packages import Package, gathered, last_of_name, message

NAME, SCHEMA = "office_parts", "doc_id string, path string, type string, bytes binary, error string"
COLUMNS = ("doc_id", "path", "type")
#: What opening a file costs, in bytes that could be read instead; and the size up to which a file is read in one piece.
OPENING, WHOLE = 64 << 10, 256 << 10


class Files(InputPartition):
    """Files of one task: (doc_id, path in its store)."""

    def __init__(self, store: str, files: list[tuple[str, str]]) -> None:
        self.store, self.files = store, files


class PartSource(DataSource):
    """Options: glob (*.docx), partitionbytes (128 MB of files a task, each counted as 64 KB more), once (true: of parts with one file name the last by path)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PartReader(self.options)


class PartReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what compares doc_id, path or type with texts; hands all else back."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "holds", IsNotNull: "there"}
        for f in filters:
            column = getattr(f, "attribute", None)
            if type(f) in kinds and column and len(column) == 1 and column[0] in COLUMNS:
                self.tests.append((column[0], kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def passes(self, **values: str | None) -> bool:
        """Whether the pushed filters on these columns let them pass; null passes none."""
        for column, kind, want in self.tests:
            if column in values:
                v = values[column]
                if v is None or not {"is": lambda: v == want, "in": lambda: v in want, "starts": lambda: v.startswith(want), "ends": lambda: v.endswith(want), "holds": lambda: want in v, "there": lambda: True}[kind]():  # noqa: B023
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        uri = self.options["path"]
        store, root = fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)
        root = root.rstrip("/")
        head = store.get_file_info(root)
        found = [head] if head.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        pattern = self.options.get("glob", "*.docx")
        files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, pattern))
        most, parts, held = int(self.options.get("partitionbytes", 128 << 20)), [], None
        for path, size in files:
            doc = path.rpartition("/")[2] if path == root else path[len(root) + 1 :]
            if not self.passes(doc_id=doc):
                continue
            cost = size + OPENING
            if held is None or held + cost > most:
                parts.append(Files(uri, []))
                held = 0
            parts[-1].files.append((doc, path))
            held += cost
        return parts

    def read(self, partition: Files) -> Iterator:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(partition.store)[0] if ":/" in partition.store else fs.LocalFileSystem()
        rows = (row for doc, path in partition.files for row in self.rows(store, doc, path))
        yield from gathered(rows, ["doc_id", "path", "type", "bytes", "error"])

    def rows(self, store, doc: str, path: str) -> Iterator[tuple]:
        try:
            with store.open_input_file(path) as file:
                package = Package(file.read() if file.size() <= WHOLE else file)
                wanted = [(p, t) for p, t in package.parts() if self.passes(path=p, type=t)]
                last = last_of_name([p for p, _ in wanted]) if self.options.get("once", "false") == "true" else {p for p, _ in wanted}
                for p, t in wanted:
                    if p in last:
                        got = package.read(p)
                        yield (doc, p, t, None, message(got)) if isinstance(got, Exception) else (doc, p, t, got, None)
        except Exception as e:  # one bad file must not stop the corpus
            if self.passes(path=None, type=None) or not self.tests:
                yield doc, None, None, None, message(e)


def read_parts(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """doc_id (the file's path below `path`), path, type, bytes, error: a row for each part and type of every package file there, also of .rels members (type relationships); filters on the first three reach the scan.

    A file that is no package gives a row with its error and nulls, unless a filter on path or type is pushed.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PartSource)
    return spark.read.format(NAME).options(**options).load(path)
