import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import jaccard_join as J
from quire.llm.components import components

SMALL = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(id, n_shingles, component) of every row with an id."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            o = len(sets[x] & sets[y])
            if o and 100 * o >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root(rows[x][0]), root(rows[y][0])))
                up[b] = a
    return Counter((i, len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True))


def _got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert _got(J.op10_jaccard_join(spark, SMALL)) == brute(rows)


def test_planted(spark, monkeypatch):
    """Copies on both sides of the limit, chains, short texts, and a family large enough for leaves and stars."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    rows, base = [], [word() for _ in range(60)]
    for n in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = word()
        rows.append((n, " ".join(w)))
    chain = [word() for _ in range(40)]
    for n in range(300, 320):
        chain[rng.randrange(40)] = word()
        rows.append((n, " ".join(chain)))
    rows += [(400, "a b c d e f g h"), (401, "A B C D E F G H"), (402, "a b c d e f g h i"), (403, "a b c"), (404, "a  b\tc"), (405, ""), (406, None), (407, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(J, "LEAF", 16)
    monkeypatch.setattr(J, "BLOCK_ROWS", 40)
    monkeypatch.setattr(J, "HOT_LEAST", 10)
    assert _got(J.join_components(docs)) == brute(rows)


def test_odd(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = J.join_components(odd_docs)
    assert got.count() == len(rows) and got.filter("doc_id is null and component_id is null").count() == 1
    real = [r for r in rows if r[0] not in (None, 10)]  # 10 stands for two texts, linked by their id
    assert _got(got.filter("doc_id is not null and doc_id <> 10")) == brute(real)
    assert J.join_components(no_docs).count() == 0 and J.drop_near(no_docs).count() == 0
    kept = J.drop_near(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 1 in ids and 14 not in ids and 8 in ids and 9 not in ids and None in ids and {2, 3, 4} <= ids


def test_shingles():
    big = "Word%d " * 5
    text = "".join(big % tuple(range(k, k + 5)) for k in range(60_000))
    whole = J.word_hashes(text)
    assert len(whole) == 300_000 and len(text) > 2 * J.BLOCK
    one = {w: int(J.word_hashes(w)[0]) for w in ("word0", "word59999", "word30004")}
    w = text.split()
    assert all(int(whole[w.index(k.replace("w", "W", 1))]) == v for k, v in one.items())
    assert len(J.shingles("a b c d")) == 1 and len(J.shingles(" ")) == 0 and (J.shingles("A b\nC d E") == J.shingles("a b c d e")).all()


def test_tree_bound():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(150)]
    sets += [np.unique(np.concatenate((s[5:], rng.integers(1 << 60, 1 << 61, 8).astype(np.uint64)))) for s in sets[:40]]
    sizes = np.array([len(s) for s in sets])
    i, j = J.CountTree(np.array([J.point(s) for s in sets]), sizes).pairs()
    held = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    real = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(np.intersect1d(sets[a], sets[b])) >= J.needed(sizes[a], sizes[b])}
    assert len(real) >= 40 and real <= held and len(held) == len(i) < 2000
    pairs = np.array(sorted(held))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    assert J.overlaps(sets, pairs[:, 0], pairs[:, 1]).tolist() == want and J.overlaps(sets, pairs[:3, 0], pairs[:3, 1]).tolist() == want[:3]


def test_links_come_through_trees(spark, monkeypatch):
    """Searches of trees leave all pairs that the bound leaves, and links of the documents are found by them."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in rng.integers(3, 900, 60)]
    sets += [s[rng.random(len(s)) < 0.93] for s in sets for _ in range(9)]
    points, sizes = [J.point(s) for s in sets], np.array([len(s) for s in sets])
    of = np.array([*range(60), *np.repeat(np.arange(60), 9)])
    leaf = (np.arange(len(sets)) >= 60).astype(np.int64)
    t = pa.table({"unit": of, "id": np.arange(len(sets)), "leaf": leaf, "n": sizes, "point": pa.array([p.tolist() for p in points], pa.list_(pa.int32()))})
    got = {(r["id"], r["hub"]) for r in J.near_hub(t).to_pylist()}
    smaller = lambda p, q: min(len(p), len(q))
    want = {(i, of[i]) for i in range(60, len(sets)) if np.minimum(*[J.folded(x, smaller(points[i], points[of[i]])) for x in (points[i], points[of[i]])]).sum() >= J.needed(sizes[i], sizes[of[i]])}
    assert got == want and len(got) > 300
    one = J.CountTree(np.array([J.folded(p, 64) for p in points]), sizes)
    for p, n in zip(points[:20], sizes, strict=False):
        q = J.folded(p, 64)
        assert sorted(one.near(q, n)) == [k for k in range(len(sets)) if np.minimum(one.points[k], q).sum() >= J.needed(n, sizes[k])]

    found, plain = [], J.star_links
    monkeypatch.setattr(J, "star_links", lambda *a: found.append((r := plain(*a)).count()) or r)
    groups = J.op10_jaccard_join(spark, "/root/testdata/sf0.01").filter("component_id <> doc_id").count()
    assert found[0] > 0 and groups > 0


def test_components(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 150: 100, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert F is not None
