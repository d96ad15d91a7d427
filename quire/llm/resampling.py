"""Importance resampling towards a target corpus: a dictionary of distinct features, hashed once each, whose gains are joined back to documents.

Features (runs of words) are counted as strings over the whole corpus; each distinct one is hashed once into a bucket; a bucket's gain is
the log ratio of its share in the target to that in the corpus.  Gains return to the counts of each document by a join on the string: common
strings, fewer than HOT by count, through a broadcast map where the text is, all others through an exchange.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, dropped, give_back, growing, placed, scan, slices, table, words, written

#: Fewer than HOT features, of at most SHORT bytes each, are sent to all tasks: those that stand in more than 1 / HOT of all (document, feature) pairs.
HOT, SHORT = 20_000, 64


def runs(of: Iterable[bytes], longest: int) -> Iterator[bytes]:
    """All runs of 1 to longest consecutive words, joined by one blank."""
    if longest == 1:
        yield from of
        return
    window: deque[bytes] = deque(maxlen=longest)
    for w in of:
        window.append(w)
        for k in range(len(window)):
            yield b" ".join(islice(window, k, None))


def counts(docs: DataFrame, text_col: str, longest: int) -> DataFrame:
    """gram, n, held: each distinct feature of a table, how often it stands there, and in how many rows."""

    def run(t: pa.Table) -> pa.Table:
        n: Counter = Counter()
        held: Counter = Counter()
        for raw in t["text"].cast(pa.binary()).to_pylist():
            own = Counter(runs(words(raw or b""), longest))
            n.update(own)
            held.update(own.keys())
        return pa.table([pa.array(n, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([held[g] for g in n], pa.int64())], names=["gram", "n", "held"])

    return scan(docs, [F.col(text_col).alias("text")], run, "gram binary, n long, held long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_text: str, longest: int, buckets: int) -> DataFrame:
    """Written: gram, gain, held of every feature of docs."""
    own = counts(docs, text_col, longest).select("gram", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"), "held")
    other = counts(target, target_text, longest).select("gram", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"), F.lit(0).cast("long").alias("held"))
    grams = own.unionByName(other).groupBy("gram").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("held").alias("held"))
    grams = written(grams.withColumn("bucket", (F.crc32("gram") % buckets).cast("int")))
    sums = written(grams.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))  # one row a bucket
    all_s, all_t = sums.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).collect()[0]
    double = lambda c: (F.col(c) + 1).cast("double")
    gain = F.floor(1000 * F.log(double("t") * float(all_s + buckets) / (double("s") * float(all_t + buckets))))
    out = written(grams.filter("held > 0").join(F.broadcast(sums.select("bucket", gain.alias("gain"))), "bucket").select("gram", "gain", "held"))
    dropped(grams)
    return out


def weighed(docs: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and the sum of gains (total) of every row of docs."""
    pairs = dictionary.agg(F.coalesce(F.sum("held"), F.lit(0))).collect()[0][0]
    common = dictionary.filter((F.col("held").cast("double") * HOT > float(pairs)) & (F.octet_length("gram") <= SHORT))
    hot = docs.sparkSession.sparkContext.broadcast({bytes(r["gram"]): r["gain"] for r in common.select("gram", "gain").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, row = hot.value, TaskContext.get().partitionId() << 40
        for b in batches:
            for t in slices(pa.Table.from_batches([b]), 6 << 20):
                out: list[tuple] = []
                for doc, raw in zip(t["id"].to_pylist(), t["text"].cast(pa.binary()).to_pylist(), strict=True):
                    n_words, n, near, rest = 0, 0, 0, []
                    if longest > 1:
                        n_words = sum(1 for _ in words(raw or b""))
                    for g, k in Counter(runs(words(raw or b""), longest)).items():
                        n += k
                        if (gain := known.get(g)) is None:
                            rest.append((g, k))
                        else:
                            near += k * gain
                    out.append((row, doc, n if longest == 1 else n_words, n, near, rest))
                    row += 1
                sizes = np.concatenate([[0], np.cumsum([len(r[5]) for r in out])]).astype(np.int32)
                rest = pa.StructArray.from_arrays([pa.array([g for r in out for g, _ in r[5]], pa.binary()), pa.array([k for r in out for _, k in r[5]], pa.int64())], ["gram", "n"])
                cols = [pa.array([r[c] for r in out], pa.int64()) for c in range(5)]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(sizes, rest)], ["row", "doc_id", "n_words", "n_features", "near", "rest"])
        give_back()

    scanned = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "row long, doc_id long, n_words long, n_features long, near long, rest array<struct<gram: binary, n: long>>")
    rows = written(scanned)  # a row's number holds from here on
    rest = rows.select("row", F.inline("rest")).join(growing(dictionary.select("gram", "gain")), "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("far"))
    both = rows.select("row", "doc_id", "n_words", "n_features", "near").join(growing(rest), "row", "left")
    return both.select("doc_id", "n_words", "n_features", (F.col("near") + F.coalesce("far", F.lit(0))).cast("long").alias("total"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """-1000 ln(-ln u), floored, of a keyed hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs.

    Features are all runs of 1 to `longest` words (letters, digits and what is not ASCII, A-Z lowered) of whole texts.  weight: the floored mean gain
    of a row's features, 0 without any (null, empty and wordless texts); score: weight plus the Gumbel noise of the id's hash, so that the highest
    scores are a draw without replacement by weight.  Of the N rows with min_words or more, floor(percent * N / 100) are drawn and ranked from 1, ties to the
    smaller id, null ids first (their hash is that of an empty id); rows that repeat an id and a text count and are ranked each by itself, in any order.
    Other rows have a null rank.  An empty table gives no rows; an empty target gives gains all the same.  Scores are whole numbers between -91,000 and 111,000 (the
    logarithm of a ratio of two counts below 2^63), so that their histogram, which finds the lowest drawn score, is small at any size.
    """
    dictionary = gains(docs, target, text_col, target_text, longest, buckets)
    rows = weighed(docs, dictionary, id_col, text_col, longest)
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    rows = written(rows.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).drop("total"))
    dropped(dictionary)
    able = F.col("n_words") >= min_words
    found = sorted(((r["score"], r["n"]) for r in rows.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in found) // 100
    seen, lowest = 0, math.inf
    for score, n in found:
        if seen >= drawn:
            break
        seen, lowest = seen + n, score
    top = able & (F.col("score") >= lowest) if lowest < math.inf else F.lit(False)
    ranked = placed(rows.filter(top), [F.desc("score"), F.asc("doc_id")])
    ranked = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    out = rows.filter(~top).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.drop("place"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CUT = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS g"

SQL = f"""
WITH w AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, {_CUT} FROM documents) GROUP BY ALL),
d AS (SELECT g, sum(s) AS s, sum(t) AS t FROM (SELECT g, n AS s, 0 AS t FROM w UNION ALL SELECT g, 0, 1 FROM (SELECT {_CUT} FROM benchmark)) GROUP BY g),
h AS (SELECT g, s, t, {crc32_sql("g")} % 10000 AS b FROM d),
b AS (SELECT b, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM h GROUP BY b),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM b),
gain AS (SELECT b.b, CAST(floor(1000 * ln((b.t + 1) * (a.s + 10000) / ((b.s + 1) * (a.t + 10000)))) AS BIGINT) AS gain FROM b, a),
f AS (SELECT w.doc_id, CAST(sum(w.n) AS BIGINT) AS n, CAST(sum(w.n * gain) AS BIGINT) AS total FROM w JOIN h ON w.g = h.g JOIN gain ON h.b = gain.b GROUP BY w.doc_id),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM x LEFT JOIN r USING (doc_id)
"""

QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLES = {"op11_importance_resampling": SQL}
