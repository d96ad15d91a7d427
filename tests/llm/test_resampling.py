"""Importance resampling against SQL and against a plain count; running places."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import common, resampling


def _brute(docs, target, longest, buckets, percent, least, seed):
    def grams(text):
        low = "".join(c.lower() if c < "\x80" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(w), Counter(" ".join(w[a : a + k]) for k in range(1, longest + 1) for a in range(len(w) - k + 1))

    cut = [(i, *grams(t)) for i, t in docs]
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, _, c in cut:
        for g, n in c.items():
            s[place(g)] += n
    for x in target:
        for g, n in grams(x)[1].items():
            t[place(g)] += n
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, n_words, c in cut:
        n = sum(c.values())
        weight = sum(gain(place(g)) * k for g, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = dict(zip(map(id, able[: percent * len(able) // 100]), range(1, len(able) + 1)))
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def test_resampling_is_its_sql(same):
    same(resampling.op11_importance_resampling, resampling.SQL)


def test_resampling_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    """Null, empty and very long texts, repeated rows, a null id and clashing names; with features in the map and all through the exchange."""
    plain = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    aim = spark.createDataFrame([("the abc ABC abc. Ünï cafe",), (None,), (plain[0][1],)], "words string")
    texts = [r["words"] for r in aim.collect()]
    for longest, percent, hot in ((1, 50, 20_000), (3, 70, 1), (2, 0, 50)):
        monkeypatch.setattr(resampling, "HOT", hot)
        got = resampling.resample(odd_docs, aim, target_text="words", longest=longest, buckets=97, percent=percent, min_words=2, seed=5).collect()
        assert sorted(map(tuple, got), key=str) == _brute(plain, texts, longest, 97, percent, 2, 5)
    none = aim.limit(0)
    got = resampling.resample(odd_docs, none, target_text="words", buckets=97, percent=50, min_words=2).collect()
    assert sorted(map(tuple, got), key=str) == _brute(plain, [], 1, 97, 50, 2, 2024)
    assert resampling.resample(no_docs, aim, target_text="words").count() == 0


def test_words_of_long_texts(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abAB09 .,-\n\x00éß日") for _ in range(5000))
    monkeypatch.setattr(common, "PIECE", 17)
    assert [w.decode() for w in common.words(text.encode())] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.replace("A", "a").replace("B", "b"))


def test_places(spark):
    """Running counts and sums in a global order, with a key that holds half of the rows."""
    rng = random.Random(4)
    rows = [(7 if rng.random() < 0.5 else rng.randrange(50), rng.randrange(9)) for _ in range(2000)]
    df = common.written(spark.createDataFrame(rows, "k int, w long").repartition(5))
    got = sorted(common.placed(df, [F.desc("k")], "w").collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(2000)) and [r["k"] for r in got] == sorted((k for k, _ in rows), reverse=True)
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["w"]
    assert total == sum(w for _, w in rows)
