"""Language ID, URL filters, nearest neighbours, quality classifier."""

import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import ann, language_id, quality_classifier, url_filters
from quire.llm.common import bucket

SMALL = "/root/testdata/sf0.01"


def test_kernel_is_the_brute_force_kernel():
    texts = ["the cat sat", "le chat noir", "die Katze 12", "the dog"]
    m = language_id.train(texts, ["en", "fr", "de", "en"], landmarks=3)
    sets = [language_id.grams(t) for t in texts]
    # distinct grams have distinct places here, and the counts are those of strings
    text = " " + "".join(c if c.isalpha() else " " if c.isspace() else "1" for c in texts[2].lower()) + " "
    assert len(sets[2]) == len({text[k : k + n] for n in (1, 2, 3) for k in range(len(text) - n + 1)})
    got = language_id.kernel(sets, m)
    marks = [set(np.flatnonzero(m.column >= 0)[m.landmarks[:, k] > 0].tolist()) for k in range(m.landmarks.shape[1])]
    want = [[len(set(s.tolist()) & z) / np.sqrt(len(s) * len(z)) for z in marks] for s in sets]
    assert np.allclose(got, want, atol=1e-6)
    long = "abc " * 80_000
    assert (language_id.grams(long) == language_id.grams("abc " * 10)).all()


def test_ridge_solution():
    """The regression through Nystroem features solves the weighted normal equations, and with all texts as landmarks it is kernel ridge regression."""
    texts = [f"{a} {b} {c}" for a in ("the", "le", "der") for b in ("cat", "chat", "kater") for c in ("sat", "dort", "sitzt", "x")]
    langs = [t.split()[0] for t in texts]
    m = language_id.train(texts, langs, landmarks=36, ridge=0.05)
    k = language_id.kernel([language_id.grams(t) for t in texts], m)  # columns in the order of the landmarks
    order = [int(np.argmax(k[:, j])) for j in range(k.shape[1])]
    assert sorted(order) == list(range(36)) and np.allclose(k.max(0), 1, atol=1e-6)
    gram = k[order]
    y = np.array([[1.0 if t == n else -1.0 for n in m.langs] for t in langs])
    want = gram[:, :] @ np.linalg.solve(gram + 0.05 * len(texts) / 36 * np.eye(36), (y - m.bias)[order]) + m.bias
    assert np.allclose(k[order] @ m.weights + m.bias, want, atol=1e-4)


def test_many_scripts(spark):
    """Letters of any script count, however many there are."""
    rng = random.Random(12)
    start = {"zh": 0x4E00, "ko": 0xAC00, "hi": 0x905, "ru": 0x430, "ar": 0x627, "el": 0x3B1, "th": 0xE01, "he": 0x5D0}
    width = {"zh": 3000, "ko": 3000}
    rows = [(n, " ".join("".join(chr(c + rng.randrange(width.get(lang, 20))) for _ in range(4)) for _ in range(40)), lang) for lang, c in start.items() for n in range(40)]
    docs = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, F.col("doc_id") % 4 != 2).collect()}
    held = [(got[k], lang) for k, (_, _, lang) in enumerate(rows) if k % 4 == 2]
    assert sum(a == b for a, b in held) > 0.95 * len(held)


def test_language_id(spark, odd_docs, no_docs):
    rows = language_id.op6_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and sum(r["lang"] == r["lang_pred"] for r in held) > 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    got = language_id.identify(odd_docs, F.lit(True)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd_docs.collect())
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4)} == {"und"} and {r["lang_pred"] for r in got if r["doc_id"] == 1} == {"en"}
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(odd_docs, F.lit(False)).collect()} == {("und", 0.0)}
    assert language_id.identify(no_docs, F.lit(True)).count() == 0


def test_urls(spark, same):
    same(url_filters.op7_url_filters, url_filters.SQL)
    cases = {
        None: ("", "", None), "no scheme/x": ("", "", None), "http://A.Org": ("a.org", "", None), "http://A.Org/x?y": ("a.org", "/x", "org/"), "https://www.example.org/es/1": ("www.example.org", "/es/1", "example.org/es/"),
        "http://example.org/en/1#t": ("example.org", "/en/1", "example.org/en/1"), "http://example.org/en/2": ("example.org", "/en/2", "org/"), "http://x.com/de/": ("x.com", "/de/", "com/de/"), "http://com/fr/a": ("com", "/fr/a", "com/fr/"),
        "http://notcom/fr/a": ("notcom", "/fr/a", None), "http://x.net?a://b": ("x.net", "", None), "ftp://H#p": ("h", "", None),
    }
    df = spark.createDataFrame([(n, u, "x") for n, u in enumerate([*cases, *cases])], "page_id long, url string, weight_sum string")
    rows = {r["page_id"]: r for r in url_filters.filter_urls(df).collect()}
    assert len(rows) == 2 * len(cases)
    for n, u in enumerate([*cases, *cases]):
        r = rows[n]
        assert (r["host"], r["path"], r["rule"]) == cases[u] and r["verdict"] in ("allow", "block") and (r["weight_sum"] is None) == (r["rule"] is not None)
    assert url_filters.filter_urls(df.limit(0)).count() == 0


def test_long_urls(spark):
    """Time grows with the length of a URL, and a URL of a million characters scores as its parts say."""
    long = "http://x.net/" + "a?b=c&d%/é" * 100_000
    rows = [(1, "http://a.org/one"), (2, "http://b.com/de/two?x=%20"), (3, long), (4, long + "a"), (5, long), (6, "")]
    start = time.monotonic()
    got = {r["page_id"]: r for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.monotonic() - start < 120 and len(got) == 6
    assert got[3]["weight_sum"] == got[5]["weight_sum"] != got[4]["weight_sum"] and len(got[3]["path"]) > 1 and got[6]["weight_sum"] is not None
    kinds = spark.createDataFrame([("?",), ("=",), ("&",), ("%",), ("é",), ("日",), ("!",), ("",), (None,)], "u string").select(url_filters.grams(F.col("u")).alias("g")).collect()
    codes = [r["g"] for r in kinds]
    assert len({tuple(g) for g in codes[:5]}) == 5 and codes[4] == codes[5] != codes[6] and len(codes[7]) == 1 and codes[8] is None


def test_neighbours(spark):
    t = spark.read.parquet(f"{SMALL}/embeddings.parquet").toArrow().sort_by("vec_id")
    ids, x = t["vec_id"].to_numpy(), ann.rows_of(t, "embedding")
    rows = ann.op8_multi_index(spark, SMALL).collect()
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows}
    hit = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - x[np.searchsorted(ids, q)]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        got = [found[q, k] for k in range(1, 11)]
        assert all(abs(s - d[np.searchsorted(ids, v)]) < 1e-12 for v, s in got) and [s for _, s in got] == sorted(s for _, s in got)
        hit += len(best & {v for v, _ in got})
    assert hit >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_neighbours_approximate_with_hot_cells(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 8))
    x[:2500] = x[0] + rng.normal(size=(2500, 8)) * 1e-3
    df = spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "vec_id long, v array<double>")
    rows = ann.search(df, F.col("vec_id") % 100 == 0, vector_col="v", part_rows=256, batch=16, sample_rows=2000).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & by[q])
    assert hit >= 0.9 * 600


def test_neighbours_with_a_hot_id(spark):
    """Copies of one id fill no cell and end no walk, and an id of several vectors is found once."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8))
    x[:300] = x[0] + rng.normal(size=(300, 8)) * 0.3
    rows = [(n, v) for n, v in enumerate(x.tolist())] + [(0, x[0].tolist())] * 1500
    rows += [(n, [*x[n, :-1].tolist(), 99.0]) for n in range(1, 2000, 7)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(4)
    got = ann.search(df, F.col("vec_id") % 20 == 0, vector_col="v", part_rows=64, sample_rows=1000).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = []
    for q in range(0, 2000, 20):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert len(set(by[q])) == 10 == len(by[q]) and q not in by[q]
        hits.append(len(set(np.argsort(d)[:10].tolist()) & set(by[q])))
    assert hits[0] >= 9 and sum(hits) >= 0.9 * 1000 and min(hits[:15]) >= 8


def _clustered(n, spread, seed):
    """Unit vectors of 64 dimensions around n / 40 centres."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 40, 64))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 64)) * spread
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_neighbours_read_few_rows(spark, monkeypatch):
    """At 24,000 rows, with the query's own parameters: recall, and the rows that a query is compared with, which are those of its walk."""
    x = _clustered(24_000, 0.35, 4)
    df = spark.createDataFrame(spark.sparkContext.parallelize([(n, v) for n, v in enumerate(x.tolist())], 8), "vec_id long, embedding array<float>").persist()
    x = ann.rows_of(df.toArrow().sort_by("vec_id"), "embedding")
    is_query = F.col("vec_id") % 100 == 0
    by = {}
    fit, fitted = ann.fit, []
    monkeypatch.setattr(ann, "fit", lambda *a: fitted.append(fit(*a)) or fitted[0])
    for r in ann.search(df, is_query).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    index, celled = fitted[0]
    t = celled.select("id", "cell").toArrow().sort_by("id")
    cell, hits, read = t["cell"].to_numpy(), [], []
    dl, dr = index.halves(x[::100])
    for n, q in enumerate(range(0, len(x), 100)):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        best = np.argsort(d)[:10]
        hits.append(len(set(best.tolist()) & by[q]))
        walked = ann.walk(dl[n], dr[n], index.sizes, index.enough)
        read.append(index.sizes[walked].sum())
        assert hits[-1] == np.isin(cell[best], walked).sum()
    df.unpersist()
    assert sum(hits) >= 0.9 * 10 * len(hits) and max(read) < 0.1 * len(x), (sum(hits), max(read))


def test_neighbours_with_a_hot_vector(spark):
    """A vector that a third of the rows share: all of its holders ask, its smallest ids are found, and others still find their own."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 6))
    x[::3] = x[0]
    got = ann.search(spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "vec_id long, v array<double>"), F.col("vec_id") % 50 == 0, vector_col="v", part_rows=64, batch=7).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hits = 0
    for q in range(0, 3000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10].tolist()
        if q % 3 == 0:
            assert [v for _, v in sorted(by[q])] == best
        hits += len({v for _, v in by[q]} & set(best))
    assert hits >= 0.9 * 600


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, v array<double>, part string")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 100 == 0, vector_col="v").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 1.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0, vector_col="v").count() == 0


def test_quality_classifier(spark, odd_docs, no_docs):
    rows = quality_classifier.op9_quality_classifier(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) > 0.9 * len(held)
    all_rows = quality_classifier.op9_quality_classifier(spark, SMALL).collect()
    assert len(all_rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in all_rows)
    marks = odd_docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    for known in (marks, marks.limit(0), marks.filter("quality = 1")):
        got = quality_classifier.score_all(odd_docs, known, F.lit(True)).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert quality_classifier.score_all(no_docs, marks, F.lit(True)).count() == 0


def test_scores_are_those_of_plain_compression(spark, monkeypatch):
    """Every score from the dictionaries and knots of the model by zstandard alone; the fit is that of whole texts."""
    import zstandard

    train, models = quality_classifier.train, []
    monkeypatch.setattr(quality_classifier, "train", lambda rows, prior: models.append((rows, train(rows, prior))) or models[0][1])
    got = {r["doc_id"]: r["score"] for r in quality_classifier.op9_quality_classifier(spark, SMALL).collect()}
    rows, m = models[0]
    texts = {t.encode() for t, _ in rows}
    assert any(m.good.startswith(t) for t in texts) and any(m.bad.startswith(t) for t in texts)
    assert m.values == sorted(m.values) and m.knots == sorted(m.knots)
    packer = lambda d: zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
    good, bad = packer(m.good), packer(m.bad)
    close = 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    for r in docs:
        raw = r["text"].encode()
        cut = [raw[k : k + quality_classifier.SEGMENT] for k in range(0, len(raw), quality_classifier.SEGMENT)]
        d = (sum(len(bad.compress(x)) for x in cut) - sum(len(good.compress(x)) for x in cut)) / max(1, len(raw))
        if not raw.strip():
            want = m.prior
        elif d <= m.knots[0] or d >= m.knots[-1]:
            want = m.values[0] if d <= m.knots[0] else m.values[-1]
        else:
            k = next(k for k in range(len(m.knots)) if m.knots[k] > d)
            share = (d - m.knots[k - 1]) / (m.knots[k] - m.knots[k - 1])
            want = m.values[k - 1] + share * (m.values[k] - m.values[k - 1])
        close += abs(want - got[r["doc_id"]]) < 1e-9
    assert close == len(docs)


def test_isotonic():
    rng = random.Random(9)
    x, y = [rng.random() for _ in range(300)], []
    y = [float(rng.random() < v) for v in x]
    knots, values = quality_classifier.isotonic(np.array(x), np.array(y))
    assert values == sorted(values) and knots == sorted(knots) and bucket is not None
    assert quality_classifier.isotonic(np.array([1.0, 1.0]), np.array([0.0, 1.0])) == ([1.0], [0.5])
    for _ in range(100):
        xs, ys = np.array([float(rng.randrange(6)) for _ in range(15)]), np.array([float(rng.randrange(2)) for _ in range(15)])
        knots, values = quality_classifier.isotonic(xs, ys)
        places = sorted(set(xs))
        mean = lambda a, b: np.mean([v for u, v in zip(xs, ys, strict=True) if places[a] <= u <= places[b]])  # noqa: E731,B023
        best = [max(min(mean(a, b) for b in range(k, len(places))) for a in range(k + 1)) for k in range(len(places))]  # the least-squares fit
        assert values == sorted(values) and knots == sorted(set(knots))
        assert np.allclose(sorted(set(np.round(best, 9))), np.round(values, 9))


def test_dictionary_holds_texts_of_any_length():
    """Also where all are longer than the share that each has; a short text stays whole."""
    rng = random.Random(4)
    long = [bytes(rng.randrange(97, 123) for _ in range(rng.randint(4_000, 8_000))) for _ in range(750)]
    made = quality_classifier.dictionary(long, 1 << 20)
    assert 0.99 * (1 << 20) < len(made) <= 1 << 20 and all(piece in t for piece, t in zip(made.split(b"\n"), long, strict=True))
    mixed = [b"short", *long[:3], b"", b"x" * 10_000_000]
    made = quality_classifier.dictionary(mixed, 40_000).split(b"\n")
    assert made[0] == b"short" and made[1:4] == long[:3] and made[4] == b"" and len(made[5]) > 15_000 and sum(map(len, made)) <= 40_000
    assert quality_classifier.dictionary([b"a", b"bc"], 100) == b"a\nbc" and quality_classifier.dictionary([], 10) == b""
