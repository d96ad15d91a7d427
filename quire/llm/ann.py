"""Approximate nearest neighbours: inverted multi-index over two vector halves, centroid pairs walked by a heap, exact reranking."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import growing, scan, table, written

#: Numbers in one block of differences.
BLOCK = 1 << 21


@dataclass
class Index:
    """Centroids of both halves; rows, first part and number of parts of each cell; how many rows a walk takes in."""

    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    spread: np.ndarray
    enough: int

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of rows to the centroids of either half."""
        half = self.left.shape[1]
        return squared(v[:, :half], self.left), squared(v[:, half:], self.right)

    def cells(self, v: np.ndarray) -> np.ndarray:
        dl, dr = self.halves(v)
        return dl.argmin(1) * len(self.right) + dr.argmin(1)


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centroids by Lloyd's iteration; empty ones move to the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = squared(x, c)
        near = d.argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        for j, far in zip(np.flatnonzero(n == 0), d.min(1).argsort()[::-1], strict=False):
            c[j] = x[far]
    return c


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells by rising sum of the two distances until they hold `enough` rows (multi-sequence algorithm)."""
    a, b = left.argsort(kind="stable"), right.argsort(kind="stable")
    k, got, out = len(b), 0, []
    heap, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if sizes[cell]:
            out.append(cell)
            got += int(sizes[cell])
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(a) and p[1] < k and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (left[a[p[0]]] + right[b[p[1]]], *p))
    return out


def usable(vector: str):
    """Not null, no null or non-finite component, not all zero."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & good & F.exists(v, lambda x: x != 0)


def rows_of(t: pa.Table, name: str = "v") -> np.ndarray:
    col = t[name].combine_chunks()
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def needed_rows(index: Index, queries: np.ndarray, cells: list[np.ndarray], recall: float) -> int:
    """Rows that walks must take in so that the share `recall` of the known neighbours' cells is reached.

    cells: for each query the cells of its true neighbours.  Cells are ranked as `walk` ranks them.
    """
    want: list[int] = []
    dl, dr = index.halves(queries)
    for i, own in enumerate(cells):
        order = (dl[i][:, None] + dr[i][None, :]).ravel().argsort(kind="stable")
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(index.sizes[order]) - index.sizes[order]  # a walk that wants one row more opens the cell
        want += (before[own] + 1).tolist()
    return int(np.quantile(want, recall, method="higher")) if want else 1


def top(ids: np.ndarray, of: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the k nearest of their query `of`, in order; ties to the smaller id."""
    order = np.lexsort((ids, dist, of))
    start = np.flatnonzero(np.diff(of[order], prepend=of[order[:1]] - 1 if len(of) else None)) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, in blocks of bounded size."""
    step = max(1, BLOCK // max(1, v.size))
    return np.concatenate([np.sqrt(((q[a : a + step, None, :] - v[None, :, :]) ** 2).sum(2)) for a in range(0, len(q), step)]) if len(q) else np.zeros((0, len(v)))


_FOUND = "query_id long, vec_id long, score double"


def _found(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> pa.Table:
    q, ids, dist = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    keep = top(ids, q, dist, k)
    return pa.table([pa.array(q[keep], pa.int64()), pa.array(ids[keep], pa.int64()), pa.array(dist[keep], pa.float64())], names=["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(held: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """The k nearest rows of held (id, v) of a stated set of queries (id, v), in one pass over held."""
    qids, q = queries["id"].to_numpy(), rows_of(queries)

    def run(t: pa.Table) -> pa.Table:
        ids, v, rows = t["id"].to_numpy(), rows_of(t), []
        for a in range(0, len(ids), 1024):
            d = distances(q, v[a : a + 1024])
            of, at = np.nonzero(qids[:, None] != ids[None, a : a + 1024])
            rows.append((qids[of], ids[a : a + 1024][at], d[of, at]))
            if len(rows) > 8:
                t_ = _found(rows, k)
                rows = [tuple(t_[c].to_numpy() for c in ("query_id", "vec_id", "score"))]
        return _found(rows, k)

    return _ranked(scan(held, ["id", "v"], run, _FOUND), k)


def usable_rows(vectors: DataFrame, is_query, id_col: str, vector_col: str) -> DataFrame:
    """id, v, q of the usable rows, repeated ids dropped: of rows that share an id a query is kept before others, then the smallest vector."""
    rows = vectors.filter(usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null")
    first = F.min(F.struct((~F.col("q")).alias("other"), "v"))
    return rows.groupBy("id").agg(first.alias("r")).select("id", F.col("r.v").alias("v"), (~F.col("r.other")).alias("q"))


def fit(rows: DataFrame, held: DataFrame, n: int, d: int, k: int, recall: float, part_rows: int, sample_rows: int, probes: int, seed: int, centroids: int | None = None) -> tuple[Index, DataFrame] | None:
    """The index of held (id, v), and held with the column cell.  None without rows.

    Centroids are fitted on at most 2 * sample_rows of the n rows, drawn by hash.  `probes` queries (of rows, drawn by hash) are
    answered by brute force in one pass over held, and the walk takes in as many rows as reach the share `recall` of their neighbours.
    """
    spark = held.sparkSession
    chance = lambda share, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) <= int(min(1.0, share) * (1 << 30))
    x = rows_of(held.filter(chance(1.5 * sample_rows / n, seed)).select("v").limit(2 * sample_rows).toArrow())
    if not len(x):
        return None
    count = min(len(x), centroids or min(1024, max(2, math.isqrt(n // 4))))
    half = max(1, d // 2)
    left = lloyd(x[:, :half], count, 8, seed)
    right = lloyd(x[:, half:], count, 8, seed) if d > half else np.zeros((1, 0))
    index = Index(left, right, np.zeros(len(left) * len(right), np.int64), np.zeros(0), np.zeros(0), 1)

    def cells(t: pa.Table) -> pa.Table:
        return t.append_column("cell", pa.array(index.cells(rows_of(t)), pa.int64()))

    celled = written(scan(held, ["id", "v"], cells, "id long, v array<double>, cell long"))
    for r in celled.groupBy("cell").agg(F.count("*").alias("n")).toLocalIterator():  # at most one row for each centroid pair
        index.sizes[r["cell"]] = r["n"]
    asked = rows.filter("q")
    many = max(1, asked.count())
    drawn = asked.filter(chance(2 * probes / many, seed + 1)).select("id", "v").limit(probes).toArrow()
    if drawn.num_rows:
        true = brute_force(celled, drawn, k).join(celled.select(F.col("id").alias("vec_id"), "cell"), "vec_id").select("query_id", "cell").toArrow()  # probes * k rows
        of, cell = true["query_id"].to_numpy(), true["cell"].to_numpy()
        index.enough = needed_rows(index, rows_of(drawn), [cell[of == i] for i in drawn["id"].to_pylist()], recall)
    index.enough = max(index.enough, k + 1)
    index.spread = np.maximum(1, -(-index.sizes // part_rows))
    large = index.spread > 1
    start = np.cumsum(np.where(large, 0, index.sizes)) - np.where(large, 0, index.sizes)
    index.first = start // part_rows
    base = int(index.first.max()) + 1
    index.first[large] = base + np.cumsum(index.spread[large]) - index.spread[large]
    return index, celled


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = 0.95, part_rows: int = 4096, batch: int = 4096, centroids: int | None = None, sample_rows: int = 20_000, probes: int = 128, seed: int = 17) -> DataFrame:
    """The k nearest rows found for each query row: query_id, rank, vec_id, score (Euclidean, double precision).

    is_query: condition for rows that are queries.  A query's own id is no candidate; repeated ids count once, from the start
    (see usable_rows).  Of equal vectors the k + 1 smallest ids are indexed: no other can be among the k nearest of any row, so a
    vector that a third of the rows share is a cell entry of k + 1 rows.  All others are indexed.

    A query walks cells until they hold `enough` rows and is compared with the rows of these cells only.  `enough` is fitted, at every size alike:
    it is the number that reaches the share `recall` of the true neighbours of `probes` sampled queries.  So it follows the data: for
    vectors in clusters it stays the same as the table grows, for vectors without any structure it must grow with the table.
    Cells lie in parts of about part_rows rows (a larger cell is dealt over several by hash of the id); a query is sent once to each part
    that holds a cell of its walk, with these cells, and a part meets its queries in batches of about `batch`.

    Rows found are ranked by exact distances on the original vectors, ties to the smaller id; fewer candidates than k are all found if
    walked.  Rows that are not `usable` or whose length differs from the most common one (of distinct ids, ties to the shorter) have no distance and take no part.
    No usable row, an empty table or no query: no result.  Null ids take no part.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(usable_rows(vectors, is_query, id_col, vector_col))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    d = lengths[0]["d"]
    rows = rows.filter(F.size("v") == d)
    equal = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    held = written(rows.select("id", "v", equal.alias("r")).filter(F.col("r") <= k + 1).select("id", "v"))
    fitted = fit(rows, held, held.count(), d, k, recall, part_rows, sample_rows, probes, seed, centroids)
    if fitted is None:
        return empty
    index, celled = spark.sparkContext.broadcast(fitted[0]), fitted[1]

    def place(t: pa.Table) -> pa.Table:
        ix, cell, ids = index.value, t["cell"].to_numpy(), t["id"].to_numpy()
        part = ix.first[cell] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % ix.spread[cell]
        return pa.table([pa.array(part, pa.int64()), t["id"], t["v"], t["cell"]], names=["part", "id", "v", "cell"])

    def visit(t: pa.Table) -> pa.Table:
        ix, v = index.value, rows_of(t)
        dl, dr = ix.halves(v)
        take, to, cells = [], [], []
        for i in range(len(v)):
            parts: dict[int, list[int]] = {}
            for c in walk(dl[i], dr[i], ix.sizes, ix.enough):
                for p in range(ix.first[c], ix.first[c] + ix.spread[c]):
                    parts.setdefault(p, []).append(c)
            take += [i] * len(parts)
            to += parts
            cells += parts.values()
        at = pa.array(take, pa.int64())
        return pa.table([pa.array(to, pa.int64()), t["id"].take(at), t["v"].take(at), pa.array(cells, pa.list_(pa.int64()))], names=["part", "id", "v", "cells"])

    def near(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if queries.num_rows and candidates.num_rows:
            qids, q, wanted = queries["id"].to_numpy(), rows_of(queries), queries["cells"].combine_chunks()
            of = np.repeat(np.arange(len(qids)), np.diff(wanted.offsets.to_numpy()))
            wanted = wanted.flatten().to_numpy()
            by = np.argsort(wanted, kind="stable")
            of, wanted = of[by], wanted[by]
            cell = candidates["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            ids, v, cell = candidates["id"].to_numpy()[order], rows_of(candidates)[order], cell[order]
            held = 0
            for c in np.unique(cell):
                asks = of[np.searchsorted(wanted, c) : np.searchsorted(wanted, c, "right")]
                a, b = np.searchsorted(cell, c), np.searchsorted(cell, c, "right")
                for x in range(0, len(asks), 512):
                    some = asks[x : x + 512]
                    dist = distances(q[some], v[a:b])
                    i, j = np.nonzero(qids[some][:, None] != ids[None, a:b])
                    rows.append((qids[some][i], ids[a:b][j], dist[i, j]))
                    held += len(i)
                    if held > BLOCK:
                        t = _found(rows, k)
                        rows, held = [tuple(t[n].to_numpy() for n in ("query_id", "vec_id", "score"))], t.num_rows
        return _found(rows, k)

    asked = written(scan(rows.filter("q"), ["id", "v"], visit, "part long, id long, v array<double>, cells array<long>", 1 << 20))
    loads = asked.groupBy("part").agg(F.ceil(F.count("*") / batch).cast("long").alias("batches"))
    sent = asked.join(growing(loads), "part").withColumn("batch", F.pmod(F.xxhash64("id"), F.col("batches")))
    home = scan(celled, ["id", "v", "cell"], place, "part long, id long, v array<double>, cell long").join(growing(loads), "part")
    home = home.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)))
    pairs = sent.select("part", "batch", "id", "v", "cells").groupBy("part", "batch").cogroup(home.select("part", "batch", "id", "v", "cell").groupBy("part", "batch")).applyInArrow(near, _FOUND)
    return _ranked(pairs, k)


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op8_multi_index": op8_multi_index}
ORACLES: dict[str, str] = {}
