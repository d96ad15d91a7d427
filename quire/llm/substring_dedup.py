"""Substring dedup: content-defined chunks cut by a gear rolling hash; repeated chunks are found by digest and removed in runs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import growing, scan, table, written

#: A chunk ends where the top BITS bits of the hash of the last 32 bytes are 0, LEAST bytes or more after the last end.
BITS, LEAST = 4, 16
#: Runs of repeated chunks shorter than this many bytes stay.
SPAN = 80
SEED = 2024


@lru_cache(1)
def gear() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(raw: np.ndarray) -> np.ndarray:
    """The gear hash h = 2h + gear[byte] at every byte, mod 2^32: sums over 1, 2, 4 ... 32 bytes by doubling."""
    h = gear()[raw]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8; no chunk ends inside a character."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return []
    ends = np.flatnonzero(rolling(b) >> np.uint32(32 - BITS) == 0) + 1
    ends = ends[ends < len(b)]
    ends = ends[(b[ends] & 0xC0) != 0x80]
    out, last = [], 0
    for e in ends.tolist():
        if e - last >= LEAST:
            out.append(e)
            last = e
    out.append(len(b))
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))


def chunks(rows: DataFrame, places: bool) -> DataFrame:
    """The digest (two longs) of every chunk with its document's id; with places also the text's hash and the chunk's number and bounds."""

    def run(t: pa.Table) -> pa.Table:
        digests, of, k, a, b = bytearray(), [], [], [], []
        for i, x in enumerate(t["text"].to_pylist()):
            raw = (x or "").encode("utf-8", "surrogatepass")
            last, ends = 0, cuts(raw)
            for e in ends:
                digests += xxhash.xxh3_128_digest(raw[last:e])
                last = e
            of.append(np.full(len(ends), i))
            if places and ends:
                k.append(np.arange(len(ends)))
                b.append(np.array(ends))
                a.append(np.concatenate(([0], ends[:-1])))
        of = np.concatenate(of)
        d = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
        at = pa.array(of)
        cols = [t["id"].take(at), pa.array(d[:, 0]), pa.array(d[:, 1])]
        names = ["id", "d", "e"]
        if places:
            cols += [t["hash"].take(at), *(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int32()) for x in (k, a, b))]
            names += ["hash", "k", "a", "b"]
        return pa.table(cols, names=names)

    return scan(rows, ["id", "hash", "text"], run, "id long, d long, e long" + ", hash long, k int, a int, b int" * places)


def runs(found: dict[str, np.ndarray], doc: int | None, span: int) -> list[tuple[int, int, int | None]]:
    """(first byte, byte after the last, holder of the first chunk) of runs of neighbouring repeated chunks of span bytes or more.

    found: number, bounds, digest and holder of the repeated chunks of one document, null holders as None.  Those it holds itself count as
    repeated from their second place on.  Rows that repeat a chunk's number (from copies of the document's row) count once.
    """
    k, pick = np.unique(found["k"], return_index=True)
    a, b, d, e, holder = (found[c][pick] for c in ("a", "b", "d", "e", "holder"))
    lost = np.ones(len(k), bool)
    seen: set[tuple[int, int]] = set()
    for i in np.flatnonzero(holder == doc).tolist():
        key = (int(d[i]), int(e[i]))
        lost[i] = key in seen
        seen.add(key)
    k, a, b, holder = k[lost], a[lost], b[lost], holder[lost]
    if not len(k):
        return []
    first = np.flatnonzero(np.diff(k, prepend=k[0] - 2) != 1)
    last = np.append(first[1:], len(k)) - 1
    return [(int(a[i]), int(b[j]), holder[i]) for i, j in zip(first, last, strict=True) if b[j] - a[i] >= span]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """id, hash and spans (a, b, holder) in bytes, a row for each different (id, text) with something to remove.

    A digest that occurs twice or more is held by the smallest id that has it, at its first place there.  Null and empty
    texts have no chunks.  Rows with null id hold only what no other row has.  Rows repeated any number of times are read as one list of chunks.
    """
    rows = _rows(docs, id_col, text_col)
    # two written tables: plain exchanges stand on both sides of the join, and a hot digest can be split at run time
    repeated = written(chunks(rows, False).groupBy("d", "e").agg(F.count("*").alias("n"), F.min("id").alias("holder")).filter("n > 1").drop("n"))
    found = chunks(rows, True).join(growing(repeated), ["d", "e"])
    listed = found.groupBy("id", "hash").agg(F.collect_set(F.struct("k", "a", "b", "d", "e", "holder")).alias("found"))  # a set: repeated rows add nothing

    def run(t: pa.Table) -> pa.Table:
        col = t["found"].combine_chunks()
        at, ids = col.offsets.to_numpy(), t["id"].to_pylist()
        flat = {c: col.values.field(c).to_numpy(zero_copy_only=False) for c in ("k", "a", "b", "d", "e")}
        flat["holder"] = np.array(col.values.field("holder").to_pylist(), object)
        spans = [[{"a": a, "b": b, "holder": h} for a, b, h in runs({c: v[at[i] : at[i + 1]] for c, v in flat.items()}, ids[i], span)] for i in range(len(ids))]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("holder", pa.int64())]))
        out = pa.table([t["id"], t["hash"], pa.array(spans, kind)], names=["id", "hash", "spans"])
        return out.filter(pa.array([bool(s) for s in spans]))

    return scan(listed, ["id", "hash", "found"], run, "id long, hash long, spans array<struct<a:int,b:int,holder:long>>")


def cut_out(text: str, spans: list[dict]) -> str:
    raw, out, last = text.encode("utf-8", "surrogatepass"), [], 0
    for s in sorted(spans, key=lambda s: s["a"]):
        out.append(raw[last : s["a"]])
        last = s["b"]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """docs with text_col without its repeated runs (see repeated_spans).  Null texts stay null; other columns are carried in a struct."""
    spans = repeated_spans(docs, id_col, text_col, span).withColumnsRenamed({"id": "_i", "hash": "_h"})
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    rows = rows.join(growing(spans), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left").select("_row", "_text", "spans")
    keep = rows.filter("spans is null").select("_row", "_text")

    def run(t: pa.Table) -> pa.Table:
        texts = [cut_out(x, s) for x, s in zip(t["_text"].to_pylist(), t["spans"].to_pylist(), strict=True)]
        return pa.table([t["_row"], pa.array(texts, pa.string())], names=["_row", "_text"])

    cut = scan(rows.filter("spans is not null"), ["_row", "_text", "spans"], run, keep.schema)
    out = keep.unionByName(cut)
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each removed run: its document, its bytes in the UTF-8 text, and the document that keeps a copy."""
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    one = spans.select(F.col("id").alias("doc_id"), F.explode("spans").alias("s"))
    return one.select("doc_id", F.col("s.a").cast("long").alias("start_byte"), (F.col("s.b") - F.col("s.a")).cast("long").alias("n_bytes"), F.col("s.holder").alias("kept_doc_id"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES: dict[str, str] = {}
