"""Line dedup: content-defined chunks of lines; multi-line chunks that repeat anywhere are removed after comparing bytes.

Only DataFrame and SQL functions.  A rolling hash over the hashes of the last WINDOW lines marks a line where it is not
divisible by DIVISOR; of marked lines in a row every other one, from the first, ends a chunk.  Boundaries so depend on nearby lines only
and an inserted line moves no others.  This is done with each multiplier of SEEDS, and the chunks of all are tried: a repeated passage is
found where any of them has a whole chunk inside it.  Texts stay in their rows: what is exchanged are digests, then the texts
once to compare chunks and once to rebuild.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import growing, table, written

WINDOW, DIVISOR, MIN_LINES = 2, 3, 2
FACTOR, PRIME = 69069, 2147483647
SEEDS = (1, 48271, 16807, 1103515245, 214013, 1664525, 22695477, 69621)


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator: without it the optimiser copies them into the lambdas that read them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def chunked(docs: DataFrame, text: str) -> DataFrame:
    """Adds _lines and _chunks: the different chunks of MIN_LINES lines or more, as (first line, line after the last), counted from 0, in order."""
    number = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % PRIME
    out = _step(docs, _lines=F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    out = _step(out, _hashes=F.transform("_lines", number))
    roll = lambda x, i, seed: sum((F.coalesce(F.get("_hashes", i - k), F.lit(0)) * (FACTOR**k * seed % PRIME) for k in range(1, WINDOW)), x * seed) % PRIME
    marks = lambda seed: F.array_join(F.transform("_hashes", lambda x, i: F.when(roll(x, i, seed) % DIVISOR > 0, "1").otherwise("0")), "")
    ended = [(f"_flags{n}", f"_ends{n}", seed) for n, seed in enumerate(SEEDS)]
    out = _step(out, **{flags: F.split(F.regexp_replace(marks(seed), "11", "10"), "") for flags, _, seed in ended}).drop("_hashes")
    last = F.size("_lines")
    ends = lambda flags: F.filter(F.sequence(F.lit(1), last), lambda e: (e == last) | (F.get(flags, e - 1) == "1"))
    out = _step(out, **{c: ends(flags) for flags, c, _ in ended}).drop(*(flags for flags, _, _ in ended))
    # a chunk as one number: arrays of numbers are made distinct by hash, arrays of structs by comparing all pairs
    spans = lambda c: F.transform(c, lambda e, k: F.shiftleft(F.coalesce(F.get(c, k - 1), F.lit(0)).cast("long"), 32) + e)
    out = _step(out, _spans=F.array_distinct(F.concat(*(spans(c) for _, c, _ in ended)))).drop(*(c for _, c, _ in ended))
    first, after = lambda s: F.shiftright(s, 32).cast("int"), lambda s: s.bitwiseAND(F.lit(2**32 - 1)).cast("int")
    multi = F.sort_array(F.filter("_spans", lambda s: after(s) - first(s) >= MIN_LINES))
    return _step(out, _chunks=F.transform(multi, lambda s: F.struct(first(s).alias("a"), after(s).alias("b")))).drop("_spans")


def chunk_text(a: Column, b: Column) -> Column:
    return F.array_join(F.slice("_lines", a + 1, b - a), "\n")


def removed_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _hash and the numbers of the chunks to remove, one row for each document that loses any."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    cut = chunked(rows, "_text").drop("_text")
    multi = F.transform("_chunks", lambda c, k: F.struct(k.alias("k"), F.xxhash64(chunk_text(c["a"], c["b"])).alias("digest")))
    chunks = written(cut.select("_id", "_hash", F.inline(multi)))
    # written, so that both sides of the join are plain exchanges and a hot digest can be split at run time
    repeated = written(chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min("_id").alias("holder")).filter("n > 1").drop("n"))
    found = written(chunks.join(growing(repeated), "digest"))

    # bytes: each repeated digest must stand for one text only
    listed = found.groupBy("_id", "_hash").agg(F.collect_set(F.struct("k", "digest")).alias("_list"))
    own = rows.join(growing(listed.withColumnsRenamed({"_id": "_i", "_hash": "_h"})), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).drop("_i", "_h")
    own = chunked(own, "_text").drop("_text")
    texts = own.select("_id", "_hash", F.inline(F.transform("_list", lambda c: F.struct(c["k"].alias("k"), c["digest"].alias("digest"), chunk_text(F.element_at("_chunks", c["k"] + 1)["a"], F.element_at("_chunks", c["k"] + 1)["b"]).alias("bytes")))))
    clash = written(texts.select("digest", "bytes").distinct().groupBy("digest").count().filter("count > 1").select("digest"))
    if not clash.isEmpty():  # different texts under one digest: decide them by text
        exact = texts.join(growing(clash), "digest")
        held = exact.groupBy("digest", "bytes").agg(F.min("_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")
        found = found.join(clash, "digest", "left_anti").unionByName(exact.join(held, ["digest", "bytes"]), allowMissingColumns=True)
    else:
        found = found.withColumn("bytes", F.lit(None).cast("string"))
    by_chunk = found.groupBy("_id", "_hash", "digest", "bytes").agg(F.array_sort(F.collect_set("k")).alias("ks"), F.first("holder").alias("holder"))
    lost = F.when(F.col("_id").eqNullSafe(F.col("holder")), F.slice("ks", 2, F.size("ks"))).otherwise(F.col("ks"))
    return by_chunk.select("_id", "_hash", lost.alias("ks")).filter("size(ks) > 0").groupBy("_id", "_hash").agg(F.flatten(F.collect_list("ks")).alias("_lost"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with text_col without its repeated multi-line chunks; with counts also n_lines and n_removed.

    A chunk of MIN_LINES lines or more that occurs twice or more anywhere has its place where it first stands in the document of the
    smallest id and goes everywhere else; rows of one id count as one holder.  Chunks of different seeds overlap, so that of a chunk's place
    some lines may go with another chunk: a line goes only if an equal one stays at a smaller id or earlier in the text.  Null texts stay null and count as one empty line;
    texts without a repeated chunk stay as they are; a text may become empty.  Single lines are never removed.  Rows with a
    null id are judged like others and lose to any other holder.  Other columns are carried along inside a struct, so
    their names cannot clash.
    """
    lost = removed_chunks(docs, id_col, text_col).withColumnsRenamed({"_id": "_i", "_hash": "_h"})
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    rows = rows.join(growing(lost), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    keep = rows.filter("_lost is null").select("_row", "_text", F.size(F.split(F.coalesce("_text", F.lit("")), "\n", -1)).alias("_n"), F.lit(0).alias("_gone"))
    cut = chunked(rows.filter("_lost is not null").select("_row", "_text", "_lost"), "_text").drop("_text")
    cut = _step(cut, _away=F.flatten(F.transform("_lost", lambda k: F.sequence(F.get("_chunks", k)["a"], F.get("_chunks", k)["b"] - 1))))
    cut = _step(cut, _left=F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_away"))
    cut = _step(cut, _kept=F.transform("_left", lambda i: F.get("_lines", i)))
    cut = cut.select("_row", F.array_join("_kept", "\n").alias("_text"), F.size("_lines").alias("_n"), (F.size("_lines") - F.size("_kept")).alias("_gone"))
    out = keep.unionByName(cut)
    extra = [F.col("_n").cast("long").alias("n_lines"), F.col("_gone").cast("long").alias("n_removed")] if counts else []
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns], *extra)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL = f"""
WITH lines AS (SELECT doc_id, l.i AS i, string_split(coalesce(text, ''), chr(10))[l.i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i) l),
numbered AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) % {PRIME} AS h FROM lines),
rolled AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) AS g FROM numbered),
marked AS (SELECT *, (h * seed + g * ({FACTOR} * seed % {PRIME})) % {PRIME} % {DIVISOR} > 0 AS m FROM rolled, LATERAL (SELECT unnest([{", ".join(f"CAST({seed} AS BIGINT)" for seed in SEEDS)}]) AS seed) s),
ended AS (SELECT *, CASE WHEN m AND (i - coalesce(max(CASE WHEN NOT m THEN i END) OVER (PARTITION BY doc_id, seed ORDER BY i), 0)) % 2 = 1 THEN 1 ELSE 0 END AS ends FROM marked),
placed AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id, seed ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ended),
chunks AS (SELECT doc_id, seed, k, min(i) AS a, max(i) AS b, string_agg(line, chr(10) ORDER BY i) AS bytes, count(*) AS n FROM placed GROUP BY doc_id, seed, k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, a) AS r FROM (SELECT DISTINCT doc_id, a, b, bytes FROM chunks WHERE n >= {MIN_LINES})),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ranked WHERE r > 1),
kept AS (SELECT p.doc_id, count(*) AS n_lines, count(*) FILTER (g.i IS NOT NULL) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY p.i) FILTER (g.i IS NULL), '') AS text
  FROM lines p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT doc_id, n_lines, n_removed, md5(text) AS text_md5 FROM kept
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": SQL}
