"""N-gram Jaccard join: count-vector R-trees.

Tokens (word shingles) are hashed into GROUPS groups; a document is the point of its group counts.  The overlap of two sets is at
most the sum of the coordinate minima, and a node's box bounds all points below it, so whole pairs of nodes are pruned; the
surviving pairs are verified on the sets.

In many dimensions boxes of unrelated documents overlap, so one tree over a corpus would meet nearly all pairs of like size.  Trees therefore
stand in blocks that lose no pair: put the tokens of all documents in one order; a set of n tokens shares fewer than n - p of them with anything that misses its first
p = n // 5 + 1, which is less than similarity 0.8 needs.  So two linked documents share a token among their first ones, and
documents that share such a token are a block.  The order puts frequent tokens last (see hot_tokens), so that blocks are small where documents have
anything of their own, whatever passages they share.

1. The documents of all blocks with one smallest id stand in trees, which are searched with that id's point; what the bound leaves is
   verified on sets.  This contracts families of near copies, which have many blocks of many pairs, to few parts, and blocks
   within one part need no more work.
2. In each block that still has several parts a tree finds pairs across parts that the bound leaves.  They join documents to families.
3. The leaves of the families' trees lie in tables; pairs of leaves are pruned by their boxes, pairs within one part are
   skipped, and the others are dealt as tasks, in which trees over the points of both leaves choose the pairs that are verified on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, growing, mix, scan, table, written
from .components import components

WORDS = 5
GROUPS = 64
#: Documents and bytes of sets of a leaf of a family, about.
LEAF, LEAF_BYTES = 128, 8 << 20
FANOUT = 16
#: Documents of a block that one task takes; a larger one is split over the leaves of its family.
BLOCK_ROWS = 1024
#: Frequent tokens sent to all tasks, at most, and documents that a token must be in to count as frequent, at least.
HOT, HOT_LEAST = 1 << 20, 64
#: Bytes of one call of a grouped function, about.
CALL = 1 << 20
SEED = 99

_rng = np.random.default_rng(SEED)
LETTERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACES = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A-Z to a-z, and every white-space byte to a blank.
LOWER = bytes(32 if c in b" \t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64 for i < n, at least BLOCK of them, kept between calls."""
    global _kept
    if n > len(_kept[0]):
        size = max(n, BLOCK)
        _kept = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, f, np.uint64)))) for f in (BASE, BASE_INVERSE))
    return _kept


_kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each lower-cased word, by sums of letter values times powers, in pieces that end between words."""
    raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
    out, a = [], 0
    while a < len(raw):
        b = len(raw) if len(raw) - a <= BLOCK else raw.rfind(b" ", a, a + BLOCK)
        if b <= a:
            b = raw.find(b" ", a + BLOCK)
            b = len(raw) if b < 0 else b
        x = np.frombuffer(raw[a:b], np.uint8)
        ink = np.concatenate(([False], x != 32, [False]))
        edges = np.flatnonzero(ink[1:] != ink[:-1])
        start, end = edges[::2], edges[1::2]
        if len(start):
            power, inverse = _powers(len(x) + 1)
            total = np.concatenate(([np.uint64(0)], np.cumsum(LETTERS[x] * power[: len(x)])))
            out.append(mix((total[end] - total[start]) * inverse[start]))
        a = b + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of all WORDS-word shingles; of the whole sequence if it is shorter; none without words."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    if len(w) < WORDS:
        h = np.array([len(w)], np.uint64)
        for x in w:
            h = mix(h * BASE + x)
        return h
    n = len(w) - WORDS + 1
    s = w[:n] * PLACES[0]
    for k in range(1, WORDS):
        s += w[k : n + k] * PLACES[k]
    return np.unique(mix(s))


def first_tokens(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first tokens of a set (sorted hashes) in the common order, frequent ones last: a linked set shares one of them."""
    p = len(s) // 5 + 1
    if len(hot) and len(s):
        late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
        if late.any():
            s = np.concatenate((s[~late], s[late]))
    return s[:p]


def groups_of(n: int) -> int:
    """How many groups the tokens of a set of n are hashed into: a power of two, an eighth of n at least, so that the bound tells unrelated sets of any size apart."""
    return max(GROUPS, 1 << max(0, (n - 1) // 8).bit_length())


def point(s: np.ndarray, groups: int | None = None) -> np.ndarray:
    g = groups or groups_of(len(s))
    return np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g).astype(np.int32)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point of more groups as one of fewer: groups are low bits of hashes."""
    return p if len(p) == groups else p.reshape(-1, groups).sum(0, dtype=np.int32)


def needed(a, b):
    """The overlap at which 100 * intersection >= 80 * union, for sets of a and b elements: 4 (a + b) / 9, rounded up."""
    return -(-4 * (a + b) // 9)


class CountTree:
    """An R-tree over group counts, packed by size and then by the widest coordinate; upper corners suffice for the bound."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order = np.argsort(sizes, kind="stable")
        slab = FANOUT * FANOUT
        pieces = []
        for a in range(0, len(order), slab):
            part = order[a : a + slab]
            if len(part) > FANOUT:
                part = part[np.argsort(points[part][:, np.argmax(points[part].var(0))], kind="stable")]
            pieces += [part[b : b + FANOUT] for b in range(0, len(part), FANOUT)]
        #: levels[0] are the leaves; a node: (children or rows, upper corner, smallest size, largest size)
        level = [(p, points[p].max(0), int(sizes[p].min()), int(sizes[p].max())) for p in pieces]
        self.levels = [level]
        while len(level) > 1:
            level = [(list(range(a, min(a + FANOUT, len(level)))), np.max([x[1] for x in level[a : a + FANOUT]], axis=0), min(x[2] for x in level[a : a + FANOUT]), max(x[3] for x in level[a : a + FANOUT])) for a in range(0, len(level), FANOUT)]
            self.levels.append(level)

    def pairs(self, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All pairs whose bound reaches what they need; with part only those of different parts."""
        left, right = [], []
        top = len(self.levels) - 1
        stack = [(top, 0, 0)] if self.levels[0] else []
        while stack:
            k, i, j = stack.pop()
            x, y = self.levels[k][i], self.levels[k][j]
            if i != j and (5 * x[3] < 4 * y[2] or 5 * y[3] < 4 * x[2] or np.minimum(x[1], y[1]).sum() < needed(x[2], y[2])):
                continue
            if k:
                stack += [(k - 1, c, d) for c in x[0] for d in y[0] if i != j or c <= d]
                continue
            p, q = x[0], y[0]
            bound = np.minimum(self.points[p][:, None, :], self.points[q][None, :, :]).sum(2)
            fit = bound >= needed(self.sizes[p][:, None], self.sizes[q][None, :])
            if part is not None:
                fit &= part[p][:, None] != part[q][None, :]
            if i == j:
                fit &= np.triu(np.ones(fit.shape, bool), 1)
            a, b = np.nonzero(fit)
            left.append(p[a])
            right.append(q[b])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(right)

    def near(self, p: np.ndarray, n: int) -> np.ndarray:
        """The rows whose bound with the point of a set of n reaches what they need: from the root down, nodes whose box misses it are left out."""
        found, stack = [np.zeros(0, np.int64)], [(len(self.levels) - 1, 0)]
        while stack:
            k, i = stack.pop()
            rows, corner, least, most = self.levels[k][i]
            if 5 * most < 4 * n or 5 * n < 4 * least or np.minimum(corner, p).sum() < needed(n, least):
                continue
            if k:
                stack += [(k - 1, c) for c in rows]
            else:
                found.append(rows[np.minimum(self.points[rows], p).sum(1) >= needed(n, self.sizes[rows])])
        return np.concatenate(found)


def survivors(points: list[np.ndarray], sizes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of different parts that the bound leaves, by a tree for each number of groups.

    A pair is met in the tree of the smaller one's number; as linked sizes differ by a quarter at most, only points of twice as many groups join it.
    """
    groups = np.array([len(p) for p in points])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.unique(groups).tolist():
        own = np.flatnonzero((groups == g) | ((groups == 2 * g) & (sizes <= 10 * g)))
        if len(np.unique(part[own])) > 1:
            i, j = CountTree(np.array([folded(points[k], g) for k in own]), sizes[own]).pairs(part[own])
            left.append(own[i])
            right.append(own[j])
    return np.concatenate(left), np.concatenate(right)


class Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(i), self.root(j)
        self.up[a] = b
        return a != b


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the given pairs: one by one if they are few, else by products of presence rows."""
    if len(left) * 8 < len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = shared[inverse]
    of, column = of[keep], column[inverse[keep]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, (1 << 22) // len(sets))
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (a, a + width))
        rows = np.zeros((len(sets), width), np.float32)
        rows[of[lo:hi], column[lo:hi] - a] = 1
        total += rows @ rows.T
    return total[left, right].astype(np.int64)


def _groups(t: pa.Table, key: str):
    """(rows) of each value of key."""
    k = t[key].to_numpy()
    order = np.argsort(k, kind="stable")
    at = np.flatnonzero(np.diff(k[order], prepend=k[order[:1]] - 1 if len(k) else None)) if len(k) else []
    return np.split(order, at[1:]) if len(k) else []


def _edges(a: list, b: list) -> pa.Table:
    cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _points(col: pa.ChunkedArray) -> list[np.ndarray]:
    col = col.combine_chunks()
    return np.split(col.flatten().to_numpy(), (col.offsets.to_numpy() - col.offsets[0].as_py())[1:-1]) if len(col) else []


def near_in_block(t: pa.Table) -> pa.Table:
    """Parts joined by pairs of each block that the bound leaves: spanning edges."""
    sizes, part, points = t["n"].to_numpy(), t["part"].to_numpy(), _points(t["point"])
    a, b = [], []
    for g in _groups(t, "block"):
        own, at = np.unique(part[g], return_inverse=True)
        i, j = survivors([points[k] for k in g], sizes[g], at)
        keep = _spanning(at[i], at[j], len(own))
        a.append(own[at[i[keep]]])
        b.append(own[at[j[keep]]])
    return _edges(a, b)


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """The places of edges that join something."""
    forest = Forest(n)
    return [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if forest.join(x, y)]


def links_in_unit(t: pa.Table) -> pa.Table:
    """Parts joined by links among the documents of each unit: spanning edges; in a unit of two leaves only links across leaves count."""
    leaf, part, sets = t["leaf"].to_numpy(), t["part"].to_numpy(), [np.frombuffer(x, "<u8") for x in t["tokens"].to_pylist()]
    a, b = [], []
    for g in _groups(t, "unit"):
        own = [sets[i] for i in g]
        sizes = np.array([len(s) for s in own])
        kinds, at = np.unique(part[g], return_inverse=True)
        i, j = survivors([point(s) for s in own], sizes, at)
        if len(np.unique(leaf[g])) > 1:
            cross = leaf[g[i]] != leaf[g[j]]
            i, j = i[cross], j[cross]
        if len(i):
            real = overlaps(own, i, j) >= needed(sizes[i], sizes[j])
            i, j = i[real], j[real]
            keep = _spanning(at[i], at[j], len(kinds))
            a.append(kinds[at[i[keep]]])
            b.append(kinds[at[j[keep]]])
    return _edges(a, b)


def near_hub(t: pa.Table) -> pa.Table:
    """The documents of each unit that its trees, one for each number of groups, leave when they are searched with the hub's point (leaf 0)."""
    leaf, sizes, points = t["leaf"].to_numpy(), t["n"].to_numpy(), _points(t["point"])
    groups = np.array([len(p) for p in points])
    kept, hubs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for unit in _groups(t, "unit"):
        top, rest = unit[leaf[unit] == 0], unit[leaf[unit] != 0]
        for g in np.unique(groups[rest]).tolist():
            own = rest[groups[rest] == g]
            for h in top.tolist():
                f = min(g, len(points[h]))
                found = own[CountTree(np.array([folded(points[k], f) for k in own]), sizes[own]).near(folded(points[h], f), int(sizes[h]))]
                kept.append(found)
                hubs.append(np.full(len(found), h))
    ids, kept = t["id"].to_numpy(), np.concatenate(kept)
    return pa.table([pa.array(x, pa.int64()) for x in (ids[kept], ids[np.concatenate(hubs)], sizes[kept])], names=["id", "hub", "n"])


def links_to_hub(t: pa.Table) -> pa.Table:
    """Parts joined by links between the hub (leaf 0) of each unit and the others."""
    leaf, part, sets = t["leaf"].to_numpy(), t["part"].to_numpy(), [np.frombuffer(x, "<u8") for x in t["tokens"].to_pylist()]
    a: list[int] = []
    b: list[int] = []
    for g in _groups(t, "unit"):
        for h in g[leaf[g] == 0]:
            for i in g[leaf[g] != 0]:
                if len(np.intersect1d(sets[h], sets[i], assume_unique=True)) >= needed(len(sets[h]), len(sets[i])):
                    a.append(part[h])
                    b.append(part[i])
    return _edges([np.array(a, np.int64)], [np.array(b, np.int64)])


def _called(df: DataFrame, key: str, total: int, f, schema: str) -> DataFrame:
    """f over the whole groups of many values of key at once, of about CALL bytes each; total: the bytes of df."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(1 + int(total // CALL)))).groupBy("bucket").applyInArrow(f, schema)


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))


def sketch(docs: DataFrame, id_col: str, text_col: str, hot: np.ndarray | None = None) -> DataFrame:
    """id, n, a digest of the set (d, e) and the first tokens of every row; with the frequent tokens known also the point."""
    given = docs.sparkSession.sparkContext.broadcast(hot) if hot is not None else None

    def run(t: pa.Table) -> pa.Table:
        late = given.value if given is not None else np.zeros(0, np.uint64)
        n, digest, points, first = [], bytearray(), [], []
        for x in t["text"].to_pylist():
            s = shingles(x)
            n.append(len(s))
            digest += xxhash.xxh3_128_digest(s.tobytes())
            first.append(first_tokens(s, late) if len(s) else s)
            if given is not None:
                points.append(point(s))
        d = np.frombuffer(bytes(digest), np.int64).reshape(-1, 2)
        cols = [t["id"], pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), _arrays(first)]
        if given is not None:
            at = pa.array(np.cumsum([0, *map(len, points)]), pa.int32())
            cols.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate(points))))
        return pa.table(cols, names=["id", "n", "d", "e", "first", "point"][: len(cols)])

    schema = "id long, n long, d long, e long, first array<long>" + ", point array<int>" * (hot is not None)
    return scan(docs, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], run, schema)


def hot_tokens(rows: DataFrame) -> np.ndarray:
    """Sorted tokens that are among the first of more than h rows, of all rows; h is HOT_LEAST, or what bounds them by HOT.

    Any order loses no pair; this one keeps blocks small.  There are at most (number of first tokens) / h of them.
    """
    total = rows.agg(F.sum(F.size("first"))).collect()[0][0] or 0
    h = max(HOT_LEAST, -(-total // HOT))
    counts = rows.select(F.explode("first").alias("key")).groupBy("key").agg(F.count("*").alias("m"))
    return np.sort(counts.filter(F.col("m") > h).select("key").toArrow()["key"].to_numpy().view(np.uint64))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: the smallest id reachable by links of similarity 0.8 or more.

    Rows of equal sets are one class and appear by their smallest id.  Null, empty and blank texts have no shingle and are linked
    with nothing; so are rows with a null id, whose component is null.  Rows of one id with different texts count as linked.
    An empty table gives no rows.  Texts are read whole, whatever their length.  Similarities of 0.8 exactly are links; ties cannot arise.
    """
    sketched = written(sketch(docs, id_col, text_col))
    hot = hot_tokens(sketched.filter("n > 0 and id is not null").select("first"))
    rows = written(sketched.select("id", "n", "d", "e"))
    dropped(sketched)
    classes = written(rows.filter("n > 0 and id is not null").groupBy("n", "d", "e").agg(F.min("id").alias("rep")))
    # one row for each class: its sketch is that of any member
    keyed = sketch(docs, id_col, text_col, hot).filter("n > 0 and id is not null")
    reps = written(keyed.join(growing(classes.select("n", "d", "e", F.col("rep").alias("id"))), ["n", "d", "e", "id"]).dropDuplicates(["n", "d", "e"]).select("id", "n", "point", "first"))
    points = reps.select("id", "n", "point")

    keys = reps.select(F.explode("first").alias("key"), "id")
    shared = written(keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("m"), F.bit_xor("id").alias("both"), F.bit_xor(F.xxhash64("id", F.lit(SEED))).alias("x")).filter("m > 1"))
    # equal blocks of several tokens are one block
    blocks = written(shared.groupBy("hub", "m", "both", "x").agg(F.min("key").alias("block")))
    pairs = blocks.filter("m = 2").select("block", "m", "hub", F.explode(F.array("hub", F.col("both").bitwiseXOR(F.col("hub")))).alias("id"))
    several = keys.withColumnRenamed("key", "block").join(growing(blocks.filter("m > 2").select("block", "m", "hub")), "block")
    members = written(several.select("block", "m", "hub", "id").unionByName(pairs))
    dropped(shared, blocks)

    # 1. trees searched with the smallest id of their blocks
    stars = star_links(docs, points, members, id_col, text_col)
    part_of = written(components(stars))
    dropped(stars)

    # 2. trees in blocks of several parts
    parted = members.join(growing(part_of), "id", "left").select("block", "m", "id", F.coalesce("component", "id").alias("part"))
    mixed = parted.groupBy("block").agg(F.min("part").alias("one"), F.max("part").alias("other")).filter("one <> other")
    parted = written(parted.join(growing(mixed.select("block", "one")), "block"))
    dropped(members)
    small = parted.filter(F.col("m") <= BLOCK_ROWS)
    heavy = small.join(growing(points.select("id", F.size("point").alias("g"))), "id").agg(F.sum(4 * F.col("g") + 64)).collect()[0][0] or 0
    tried = _called(small.select("block", "id", "part").join(growing(points), "id"), "block", heavy, near_in_block, "a long, b long")
    whole = parted.filter(F.col("m") > BLOCK_ROWS).select(F.col("part").alias("a"), F.col("one").alias("b")).filter("a <> b").distinct()
    joined = tried.unionByName(whole)
    families = written(components(joined).select(F.col("id").alias("part"), F.col("component").alias("family")))

    # 3. leaves of families, links between their parts
    everyone = points.join(growing(part_of), "id", "left").select("id", "n", "point", F.coalesce("component", "id").alias("part")).join(growing(families), "part")
    last = written(components(_links(docs, everyone, id_col, text_col)))
    dropped(reps, parted, families)

    final = classes.join(growing(part_of.select(F.col("id").alias("rep"), F.col("component").alias("part"))), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    final = final.join(growing(last.select(F.col("id").alias("part"), "component")), "part", "left").select("n", "d", "e", F.coalesce("component", "part").alias("component"))
    final = written(final)
    dropped(classes, part_of, last)
    out = rows.select("id", "n", "d", "e").join(growing(final), ["n", "d", "e"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def star_links(docs: DataFrame, points: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b (ids): the links between the hub of a block (its smallest id) and others of the block; members has block, hub, id, points id, n, point.

    Units of one hub hold about CALL bytes of points, and later LEAF documents whose sets are compared.
    """
    own = members.filter("id <> hub").select("id", "hub").distinct()
    sized = own.join(growing(points.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"))), "hub").join(growing(points.select("id", "n")), "id")
    sized = written(sized.filter("5 * n >= 4 * hub_n and 5 * hub_n >= 4 * n").select("id", "hub", "n"))
    room = F.col("n") + 4 * GROUPS  # a point has a group for every four to eight shingles
    total = sized.agg(F.sum(room)).collect()[0][0] or 0
    searched = _rays(sized, F.sum(room) / CALL).join(growing(points), "id")
    near = written(_called(searched, "unit", total, near_hub, "id long, hub long, n long"))
    rays = _rays(near, F.greatest(F.count("*") / LEAF, 8 * F.sum("n") / LEAF_BYTES))
    found = _verified(docs, rays.withColumn("part", F.col("id")), links_to_hub, id_col, text_col)
    dropped(sized, near)
    return found


def _rays(stars: DataFrame, load) -> DataFrame:
    """unit, id, leaf: the documents (leaf 1) of each hub dealt to as many units as its load, with the hub (leaf 0) in each."""
    spread = stars.groupBy("hub").agg(F.ceil(load).cast("long").alias("spread"))
    unit = F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.col("spread")))
    dealt = stars.join(growing(spread), "hub").select("id", "hub", unit.alias("unit"))
    hubs = dealt.select("unit", F.col("hub").alias("id"), F.lit(0).cast("long").alias("leaf")).distinct()
    return dealt.select("unit", "id", F.lit(1).cast("long").alias("leaf")).unionByName(hubs)


def _verified(docs: DataFrame, units: DataFrame, links, id_col: str, text_col: str) -> DataFrame:
    """What links finds in units (unit, id, leaf, part), from the whole sets of their documents."""
    units = written(units)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def tokens(t: pa.Table) -> pa.Table:
        found = [shingles(x) for x in t["text"].to_pylist()]
        return pa.table([t["id"], pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], names=["id", "tokens"])

    once = texts.join(growing(units.select("id").distinct()), "id", "left_semi").dropDuplicates(["id", "text"])
    sets = written(scan(once, ["id", "text"], tokens, "id long, tokens binary").withColumn("size", F.octet_length("tokens") + 32))
    total = units.join(growing(sets.select("id", "size")), "id").agg(F.sum("size")).collect()[0][0] or 0
    found = written(_called(units.join(growing(sets.drop("size")), "id"), "unit", total, links, "a long, b long"))
    dropped(units, sets)
    return found


def _links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links across the parts of every family: members has id, n, point, part, family.

    A leaf holds about LEAF documents of one class of size, of one large part or of several small ones.
    """
    members = written(members.withColumn("class", F.floor(F.log("n") / np.log(1.25)).cast("long")))
    own = F.when(F.col("of_part") >= LEAF, F.col("part").cast("string")).otherwise("")
    per_part = written(members.groupBy("family", "class", "part").agg(F.count("*").alias("of_part"), F.sum("n").alias("n_part")).withColumn("own", own))
    size = per_part.groupBy("family", "class", "own").agg(F.ceil(F.greatest(F.sum("of_part") / LEAF, 8 * F.sum("n_part") / LEAF_BYTES)).cast("long").alias("leaves"))
    place = per_part.join(growing(size), ["family", "class", "own"]).select("family", "class", "part", "own", "leaves")
    place = written(place)
    placed = members.join(growing(place), ["family", "class", "part"])
    placed = written(placed.withColumn("leaf", F.xxhash64("family", "class", "own", F.pmod(F.xxhash64("id"), F.col("leaves")))))
    fold = lambda k: F.aggregate(F.sequence(F.lit(k), F.size("point") - 1, F.lit(GROUPS)), F.lit(0), lambda x, i: x + F.get("point", i))
    corner = [F.max(F.when(F.size("point") == GROUPS, F.get("point", F.lit(k))).otherwise(fold(k))).alias(f"c{k}") for k in range(GROUPS)]
    leaves = placed.groupBy("family", "class", "leaf").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("part").alias("p"), F.max("part").alias("q"), *corner)
    leaves = written(leaves.select("family", "class", "leaf", "least", "most", "p", "q", F.array(*[f"c{k}" for k in range(GROUPS)]).alias("box")))
    other = leaves.select("family", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("class2"), F.col("leaf").alias("leaf2"), F.col("least").alias("least2"), F.col("most").alias("most2"), F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("box").alias("box2"))
    met = leaves.join(growing(other), ["family", "class"]).filter("(class <> class2 or leaf <= leaf2) and not (p = q and p2 = q2 and p = p2)")
    bound = F.aggregate(F.zip_with("box", "box2", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    met = met.filter(F.expr("5 * most >= 4 * least2 and 5 * most2 >= 4 * least") & (9 * bound >= 4 * (F.col("least") + F.col("least2"))))
    met = written(met.select("leaf", "leaf2", F.xxhash64("leaf", "leaf2").alias("unit")))
    ends = met.select("unit", F.explode(F.array_distinct(F.array("leaf", "leaf2"))).alias("leaf"))
    dropped(members, per_part, place)
    found = _verified(docs, ends.join(growing(placed.select("leaf", "id", "part")), "leaf").select("unit", "id", "leaf", "part"), links_in_unit, id_col, text_col)
    dropped(placed, leaves, met)
    return found


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest id; rows with a null id and texts without words stay."""
    kept = join_components(docs, id_col, text_col).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(growing(kept), F.col(id_col).cast("long") == F.col("_kept_id"), "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES: dict[str, str] = {}
