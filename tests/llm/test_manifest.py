"""Merkle manifest against SQL and against a tree built level by level."""

import hashlib
import random
from functools import reduce

from pyspark.sql import functions as F

from quire.llm import manifest

FIELDS = ("doc_id", "text")


def _h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def _path(levels, at):
    """Runs and places from a leaf up."""
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8))
        at //= 8
    return out


def _brute(rows, fields, tree, change):
    """(id, leaf, subroot, root, proof, folded, verified) of rows given as dicts."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: _h(*[enc(r[f]) for f in fields])
    names = sorted({r[tree] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(change(r))) for r in rows if r[tree] == n)) for n in names}
    built = {n: _levels([x[2] for x in t]) for n, t in trees.items()}
    top = _levels([built[n][-1][0] for n in names])
    root, out = top[-1][0], []
    for k, n in enumerate(names):
        for at, (known, doc, own, other) in enumerate(trees[n]):
            path = _path(built[n], at) + _path(top, k)
            fold = reduce(lambda x, s: _h(*s[0][: s[1]], x, *s[0][s[1] + 1 :]), path, other)
            out.append((doc if known else None, own, built[n][-1][0], root, _h(*[x for run, p in path for x in run[:p] + run[p + 1 :]]), fold, fold == root))
    return sorted(out, key=str)


def test_manifest_is_its_sql(same):
    same(manifest.op13_merkle_manifest, manifest.SQL)


def test_manifest_is_the_tree(spark, monkeypatch):
    """Trees of one leaf, of whole and of broken runs, with blocks of several levels; a third is tampered with."""
    rng = random.Random(8)
    sizes = {None: 1, "a": 8, "b": 9, "c": 64, "d": 65, "é": 513, **{f"x{k}": k for k in range(2, 8)}}
    rows = [{"doc_id": k, "text": "Ab" * rng.randrange(5), "lang": lang} for k, lang in enumerate(x for x, n in sizes.items() for _ in range(n))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    low = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    want = _brute(rows, FIELDS, "lang", lambda r: {**r, "text": r["text"].lower() if r["doc_id"] % 3 == 0 else r["text"]})
    for lowest, kept in ((2, 1 << 18), (1, 1 << 18), (3, 1 << 18), (1, 2), (0, 1 << 18)):
        monkeypatch.setattr(manifest, "LOWEST", lowest)
        monkeypatch.setattr(manifest, "KEPT", kept)
        got = manifest.manifest(df, FIELDS, tampered={"text": low})
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert {x[6] for x in want} == {True, False}
    one = manifest.manifest(df.filter("lang = 'c'"), FIELDS).collect()
    assert {r["root"] for r in one} == {r["subroot"] for r in one} and all(r["verified"] for r in one)


def test_manifest_of_odd_rows(odd_docs, no_docs):
    fields = ("doc_id", "lang", "text", "n", "_row")
    rows = [r.asDict() for r in odd_docs.collect()]
    got = manifest.manifest(odd_docs, fields, tampered={"text": F.upper("text")}).collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows, fields, "lang", lambda r: {**r, "text": r["text"] and r["text"].upper()})
    assert manifest.manifest(no_docs, fields).count() == 0
    hot = odd_docs.filter("doc_id = 1").crossJoin(odd_docs.sparkSession.range(200)).drop("id")
    got = manifest.manifest(hot, ("doc_id", "text")).collect()
    assert len(got) == 400 and len({r["leaf"] for r in got}) == 1 and all(r["verified"] for r in got)


def test_fragments_merge_in_any_order():
    """Associative and commutative: any split of the leaves, merged in any grouping, gives the same root, the same kept runs and no open node."""
    rng = random.Random(2)
    sizes = [1, 7, 8, 70, 130, 9, 2, 3, 4, 5]
    leaves = [(t, n, k, _h(f"{t} {k}").encode()) for t, n in enumerate(sizes) for k in range(n)]
    results = set()
    for _ in range(20):
        rng.shuffle(leaves)
        parts = [manifest.Forest(len(sizes), 1) for _ in range(9)]
        for n, (t, size, k, h) in enumerate(leaves):
            parts[n % 7 if rng.random() < 0.5 else 8].add(t, size, 0, k, h)
        while len(parts) > 1:
            a = parts.pop(rng.randrange(len(parts)))
            b = parts.pop(rng.randrange(len(parts)))
            parts.append(a.merge(b))
        assert not parts[0].open
        results.add((parts[0].root, tuple(sorted(parts[0].kept.items()))))
    top = _levels([_levels([h.decode() for _, _, k, h in sorted((x for x in leaves if x[0] == t), key=lambda x: x[2])])[-1][0] for t in range(len(sizes))])
    assert len(results) == 1 and next(iter(results))[0].decode() == top[-1][0]


def test_a_fragment_of_neighbours_is_small():
    """A run of neighbouring leaves leaves open only what its ends cut: fewer than two runs a level."""
    f = manifest.Forest(1, 99)
    for k in range(12_345, 40_000):
        f.add(0, 10**6, 0, k, b"0" * 64)
    assert sum(map(len, f.open.values())) <= 2 * 7 * 7 and len(f.open) <= 2 * 7
