"""Merkle dataset manifest: a tree over the rows of each language and one over the languages, built as an associative sparse forest.

A fragment of the forest holds nodes whose siblings are not all there yet, keyed by tree, level and run.  The number of a tree's leaves fixes how
many siblings each run has, so a run that completes becomes its parent at once, in whatever order nodes come.  Tasks build fragments of the
leaves they hold, and treeReduce merges them until the root is left.  Proofs are then made block by block: a block is the aligned leaves below one
node of a level, its own nodes are built again from its leaves, and the runs above that level, which the fragments kept, are sent to all tasks.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, give_back, growing, placed, table, written

ARITY = 8
TOP = -1
#: The level of blocks is the lowest that has at most KEPT nodes, but two at least: what is kept above it are so many hashes, by 8/7.
KEPT, LOWEST = 1 << 16, 2
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: bytes) -> bytes:
    """Lower-case hex of sha256, as text."""
    return hashlib.sha256(text).hexdigest().encode()


def size_of(n: int, level: int) -> int:
    """Nodes of a level above n leaves."""
    return -(-n // ARITY**level)


@dataclass
class Forest:
    """A fragment: open nodes by (tree, leaves of it, level, run) and place in the run; kept runs of level `block` and above and of the top tree; the root once it is known."""

    trees: int
    block: int
    open: dict = field(default_factory=dict)
    kept: dict = field(default_factory=dict)
    root: bytes | None = None

    def add(self, tree: int, n: int, level: int, at: int, node: bytes) -> None:
        """Adds a node and all parents that it completes."""
        while True:
            if (nodes := size_of(n, level)) == 1:
                if tree == TOP:
                    self.root = node
                    return
                tree, n, level, at = TOP, self.trees, 0, tree
                continue
            run, place = divmod(at, ARITY)
            key = (tree, n, level, run)
            group = self.open.setdefault(key, {})
            group[place] = node
            if len(group) < (arity := min(ARITY, nodes - run * ARITY)):
                return
            del self.open[key]
            text = b"".join(group[k] for k in range(arity))
            if level >= self.block or tree == TOP:
                self.kept[key] = text
            node, level, at = digest(text), level + 1, run

    def merge(self, other: Forest) -> Forest:
        """Both fragments as one; any order and any grouping of merges gives the same forest."""
        self.kept.update(other.kept)
        self.root = self.root or other.root
        for (tree, n, level, run), group in other.open.items():
            for place, node in group.items():
                self.add(tree, n, level, run * ARITY + place, node)
        return self

    def path(self, tree: int, n: int, level: int, at: int) -> list[tuple[bytes, bytes]]:
        """What stands before and after a node in its run, and after that of its parents, up to the root: from the kept runs."""
        out = []
        while True:
            if size_of(n, level) == 1:
                if tree == TOP:
                    return out
                tree, n, level, at = TOP, self.trees, 0, tree
                continue
            run, place = divmod(at, ARITY)
            text = self.kept[tree, n, level, run]
            out.append((text[: 64 * place], text[64 * place + 64 :]))
            level, at = level + 1, run

    def subroot(self, tree: int) -> bytes:
        if self.trees == 1:
            return self.root
        return self.kept[TOP, self.trees, 0, tree // ARITY][64 * (tree % ARITY) :][:64]


def field_text(c: Column) -> Column:
    """A field's bytes and their number, or '-' for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_rows(docs: DataFrame, fields: tuple[str, ...], tree_col: str, id_col: str, tampered: dict[str, Column]) -> DataFrame:
    """Written: doc_id, tree (its column's text), leaf and other: the leaf with the tampered columns in place, null where it is the same."""
    leaf = lambda of: F.sha2(F.concat(*[field_text(of.get(c, F.col(f"`{c}`"))) for c in fields]), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tree_col).cast("string").alias("tree"), leaf({}).alias("leaf"), leaf(tampered).alias("other"))
    return written(rows.withColumn("other", F.nullif("other", "leaf")))


def fragments(leaves: DataFrame, trees: int, block: int) -> Forest:
    """The whole forest of leaves (tree, n, at, leaf): only its root, the kept runs and no open node reach the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(trees, block)
        for b in batches:
            for tree, n, at, leaf in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own.add(tree, n, 0, at, leaf.encode())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["fragment"])

    parts = leaves.select("tree", "n", "at", "leaf").mapInArrow(local, "fragment binary")
    return parts.rdd.map(lambda r: pickle.loads(bytes(r["fragment"]))).treeReduce(Forest.merge, 3)


def proofs(leaves: list[bytes], others: list[bytes | None], tree: int, n: int, block: int, number: int, forest: Forest) -> list[tuple[bytes, bytes]]:
    """Proof and folded root of each leaf of a block, the number-th of its tree."""
    levels, level = [leaves], 0
    while level < block and size_of(n, level) > 1:
        below = levels[-1]
        levels.append([digest(b"".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])
        level += 1
    above = forest.path(tree, n, level, number * ARITY ** (block - level))
    rest = [b"".join(x + y for x, y in above)] * len(levels[-1])
    around: list[list[tuple[bytes, bytes]]] = []
    for depth in reversed(range(len(levels) - 1)):
        nodes = levels[depth]
        texts = [b"".join(nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)]
        own = [(texts[k // ARITY][: 64 * (k % ARITY)], texts[k // ARITY][64 * (k % ARITY) + 64 :]) for k in range(len(nodes))]
        whole = (x + y + rest[k // ARITY] for k, (x, y) in enumerate(own))
        rest = list(map(digest, whole) if depth == 0 else whole)  # of leaves the digests only
        around.append(own)
    around.reverse()
    if not around:
        rest = list(map(digest, rest))
    out = []
    for k, (leaf, other) in enumerate(zip(leaves, others, strict=True)):
        node, at = other or leaf, k
        for own in around:
            node, at = digest(own[at][0] + node + own[at][1]), at // ARITY
        for before, after in above:
            node = digest(before + node + after)
        out.append((rest[k], node))
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "lang", id_col: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs.

    Leaves hash the fields, each as its byte count, ':' and its text, '-' if null.  The leaves of a tree (a value of tree_col, null is one) ascend by id, null
    ids first, equal ids by leaf; rows that are equal in all fields are leaves each by itself.  tampered: columns put in the place of fields before a row is
    checked; its folded_root is what its tampered leaf and the original siblings give.  An empty table gives no rows.  Texts of any length are
    hashed where they are; only hashes are exchanged.  Trees are few beside rows (the top tree's hashes reach the driver and all tasks).
    """
    spark = docs.sparkSession
    rows = leaf_rows(docs, fields, tree_col, id_col, tampered or {})
    of = written(rows.groupBy("tree").agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("tree")), F.lit(0)).alias("width")))
    trees, total, width = of.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("width"), F.lit(0))).collect()[0]
    block = LOWEST
    while size_of(total, block) > KEPT:
        block += 1
    known = placed(of.select("tree", "n"), [F.asc_nulls_first("tree")], "n").select(F.col("tree").alias("name"), F.col("place").alias("number"), "n", F.col("before").alias("first"))
    small = trees <= 10_000 and width <= 1 << 20
    leaves = placed(rows, [F.asc_nulls_first("tree"), F.asc_nulls_first("doc_id"), "leaf"])
    leaves = leaves.join(F.broadcast(known) if small else growing(known), F.col("tree").eqNullSafe(F.col("name")))
    leaves = leaves.select("doc_id", F.col("number").alias("tree"), "n", (F.col("place") - F.col("first")).alias("at"), "leaf", "other")
    forest = fragments(leaves, trees, block) if total else Forest(0, block)
    if total and (forest.open or forest.root is None):
        raise RuntimeError("the forest has open nodes: the table changed while it was read")
    sent = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def result() -> pa.RecordBatch:
            f, (tree, n, number) = sent.value, key
            leaves, others = [r[1].encode() for r in held], [r[2].encode() if r[2] else None for r in held]
            made = proofs(leaves, others, tree, n, block, number, f)
            root, subroot = f.root.decode(), f.subroot(tree).decode()
            cols = [pa.array([r[0] for r in held], pa.int64()), *[pa.array(c, pa.string()) for c in ([r[1] for r in held], [subroot] * len(held), [root] * len(held), [p.decode() for p, _ in made], [x.decode() for _, x in made])]]
            return pa.RecordBatch.from_arrays([*cols, pa.array([x == f.root for _, x in made])], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

        for b in batches:
            for doc, tree, n, number, leaf, other in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (tree, n, number):
                    if held:
                        yield result()
                    held, key = [], (tree, n, number)
                held.append((doc, leaf, other))
        if held:
            yield result()
        give_back()

    number = F.floor(F.col("at") / F.lit(ARITY**block)).cast("long")
    dealt = leaves.withColumn("number", number).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree", "number").sortWithinPartitions("tree", "number", "at")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return dealt.select("doc_id", "tree", "n", "number", "leaf", "other").mapInArrow(run, schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows, by their ids' checksum, is checked with its text in lower case."""
    odd = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(odd, F.translate("text", _UPPER, _UPPER.lower())).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), tampered={"text": text})


def _sql(levels: int = 7, top: int = 3) -> str:
    """Level by level, as many as 8^levels rows a language and 8^top languages need."""
    enc = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = f"CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN translate(text, '{_UPPER}', '{_UPPER.lower()}') ELSE text END"
    out = [
        f"raw AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {leaf('text')} AS leaf, {leaf('low')} AS other FROM (SELECT *, {lower} AS low FROM documents))",
        "a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, doc_id, leaf, other AS x, '' AS proof FROM raw)",
        "l0 AS (SELECT g, k, leaf AS h FROM a0)",
    ]

    def climb(level: str, path: str, steps: int) -> None:
        for n in range(steps):
            out.append(f"r_{level}{n} AS (SELECT g, k // 8 AS r, list(h ORDER BY k) AS hs FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {level}{n}) WHERE c > 1 GROUP BY g, k // 8)")
            out.append(f"{level}{n + 1} AS (SELECT g, r AS k, sha256(array_to_string(hs, '')) AS h FROM r_{level}{n} UNION ALL SELECT g, k, h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {level}{n}) WHERE c = 1)")
            left, right = "hs[1:k % 8]", "hs[k % 8 + 2:]"
            out.append(
                f"{path}{n + 1} AS (SELECT p.* EXCLUDE (k, x, proof), CASE WHEN hs IS NULL THEN k ELSE k // 8 END AS k, CASE WHEN hs IS NULL THEN x ELSE sha256(array_to_string({left}, '') || x || array_to_string({right}, '')) END AS x, "
                f"proof || coalesce(array_to_string({left}, '') || array_to_string({right}, ''), '') AS proof FROM {path}{n} p LEFT JOIN r_{level}{n} r ON p.g = r.g AND p.k // 8 = r.r)"
            )

    climb("l", "a", levels)
    out.append(f"t0 AS (SELECT 0 AS g, g AS k, h FROM l{levels})")
    out.append(f"b0 AS (SELECT 0 AS g, a.g AS k, doc_id, leaf, l.h AS subroot, x, proof FROM a{levels} a JOIN l{levels} l ON a.g = l.g)")
    climb("t", "b", top)
    last = f"SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = t.h AS verified FROM b{top} b JOIN t{top} t ON b.g = t.g"
    return "WITH " + ",\n".join(out) + "\n" + last


SQL = _sql()
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": SQL}
