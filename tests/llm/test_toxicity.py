"""The convolutional classifier against plain loops, numeric gradients and held-out accuracy."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import common, toxicity


def _tiny(seed=1, labels=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))).encode() for _ in range(30)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 12))] for _ in range(12)]
    return texts, np.array([k % labels for k in range(len(texts))], float)


def test_network_is_its_definition(monkeypatch):
    """Logits of whole texts by loops over features, windows and filters; long texts and long words are read piece by piece."""
    texts, y = _tiny()
    net = toxicity.fit(texts, y, steps=20, least=1)
    row = {int(h): k for k, h in enumerate(net.known)}

    def vector(w):
        hashes = toxicity.features([w])[0]
        assert len(hashes) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.GRAMS)
        return sum((net.table[row[int(h)]] for h in hashes if int(h) in row), np.zeros(toxicity.SIZE)) / np.sqrt(len(hashes))

    def logit(t):
        x = [np.zeros(toxicity.SIZE)] * toxicity.PAD + [vector(w) for w in t] + [np.zeros(toxicity.SIZE)] * toxicity.PAD
        tops = [max(sum(float(x[a + j] @ f[j][:, c]) for j in range(len(f))) for a in range(len(x) - toxicity.PAD)) for f in net.filters for c in range(toxicity.FILTERS)]
        return float(np.maximum(np.array(tops) + net.shift, 0) @ net.out + net.bias[0])

    more = [*texts, [b"abc" * 50, b"fed"], [w for t in texts for w in t] * 3, []]
    want = np.array([logit(t) for t in more])
    assert np.allclose(toxicity.outputs(net, more), want, atol=1e-4)
    monkeypatch.setattr(toxicity, "STEP", 5)
    monkeypatch.setattr(toxicity, "PIECE", 6)
    assert np.allclose(toxicity.outputs(net, more), want, atol=1e-4)


def test_gradients_are_numeric():
    texts, y = _tiny(3)
    net = toxicity.fit(texts, y, steps=6, least=1)
    vocabulary, ids = toxicity.indexed(texts)
    hashes, starts = toxicity.features(vocabulary)
    for name in ("table", "shift", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(float))
    net.filters = [f.astype(float) for f in net.filters]
    sums = lambda rows, at: np.add.reduceat(net.table[rows], at, axis=0) / np.sqrt(np.diff(at, append=len(rows)))[:, None]
    net.sums = sums
    touched, grads = toxicity.gradients(net, ids, y, net.rows(hashes), starts, np.diff(starts, append=len(hashes)))

    def loss():
        v = np.vstack([sums(net.rows(hashes), starts), np.zeros((1, toxicity.SIZE))])
        tops = []
        for own in ids:
            x = v[np.concatenate([[-1] * toxicity.PAD, own, [-1] * toxicity.PAD]).astype(int)]
            n = len(x) - toxicity.PAD
            tops.append(np.concatenate([sum(x[j : j + n] @ f[j] for j in range(len(f))).max(0) for f in net.filters]))
        z = np.maximum(np.array(tops) + net.shift, 0) @ net.out + net.bias
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    rng = random.Random(5)
    full = np.zeros_like(net.table)
    full[touched] = grads[0]
    for p, g in zip([net.table, *net.filters, net.shift, net.out, net.bias], [full, *grads[1:]], strict=True):
        for _ in range(15):
            at = tuple(rng.randrange(n - (p is net.table and k == 0)) for k, n in enumerate(p.shape))
            held = p[at]
            p[at] = held + 1e-5
            up = loss()
            p[at] = held - 1e-5
            down = loss()
            p[at] = held
            assert abs((up - down) / 2e-5 - g[at]) < 1e-3


def test_threshold():
    rng = np.random.default_rng(7)
    for _ in range(50):
        z, y = rng.integers(0, 8, 20).astype(float), rng.integers(0, 2, 20).astype(float)
        if len(set(y)) < 2:
            continue
        cost = lambda c: 0.2 * (y[z < c]).sum() / y.sum() + 0.8 * (1 - y[z >= c]).sum() / (1 - y).sum()  # noqa: E731,B023
        assert abs(cost(toxicity.threshold(z, y, 0.2)) - min(cost(c) for c in np.arange(-1.5, 9.5))) < 1e-9
    assert toxicity.threshold(np.array([0.0, 1.0, 5.0]), np.array([0.0, 0.0, 1.0]), 0.5) == 3.0


def _corpus(spark, n=700):
    """Two languages of random syllables; a toxic text holds one to three words of its language's stem, and words like it stand in no other."""
    rng = random.Random(6)
    syllables = {"aa": ["ba", "ne", "tri", "lo", "ku", "min"], "bb": ["zha", "oth", "ery", "ghu", "iv", "wex"]}
    stem = {"aa": "trikuz", "bb": "wexoq"}
    rows = []
    for k in range(n):
        lang = rng.choice("ab") * 2
        own = lambda: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))  # noqa: E731,B023
        words = [own() for _ in range(rng.randint(15, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words[rng.randrange(len(words))] = stem[lang] + rng.choice(syllables[lang]) + rng.choice(",. ")
        rows.append((k, " ".join(words), lang, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_held_out_accuracy(spark):
    """Toxic words that were never seen in training, known by their stems; clean texts are left alone; languages have thresholds of their own."""
    docs = _corpus(spark)
    rows = toxicity.score_all(docs.select("doc_id", "text", "lang"), docs.select("doc_id", "toxic"), common.bucket("doc_id", 3) != 0).join(docs.withColumn("held", common.bucket("doc_id", 3) == 0), "doc_id").collect()
    held = [r for r in rows if r["held"]]
    right = Counter((r["toxic"], int(r["score"] >= 0.5)) for r in held)
    assert len(rows) == 700 and right[1, 1] > 0.9 * (right[1, 0] + right[1, 1]) and right[0, 0] > 0.97 * (right[0, 0] + right[0, 1]), right
    marks = [(r["text"].encode(), r["toxic"], r["lang"]) for r in docs.collect()]
    model = toxicity.train(marks, 0.2)
    assert set(model.by_language) == {"aa", "bb"}
    text, own = marks[0][0], np.array([w for w, _, lang in marks if lang == "aa"][:40], object).tolist()
    assert len(set(np.round(toxicity.scores([text] * 3, model), 12))) == 1
    z = toxicity.outputs(model.net, (common.words(t) for t in own))
    assert ((toxicity.scores(own, model) >= 0.5) == (z >= model.by_language["aa"])).mean() > 0.95


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: fit(*a, steps=5, least=1))
    marks = odd_docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    n = Counter(r["doc_id"] for r in odd_docs.collect())
    for known, prior in ((marks, None), (marks.limit(0), 0.01), (marks.filter("toxic = 1"), 0.99)):
        got = toxicity.score_all(odd_docs, known, F.lit(True)).collect()
        assert Counter(r["doc_id"] for r in got) == n and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1 and len({r["score"] for r in got if r["doc_id"] in (1, 14)}) == 1
        assert prior is None or {r["score"] for r in got} == {prior}
    assert toxicity.score_all(no_docs, marks, F.lit(True)).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "x" * (k % 7 + 1) + str(k), "en") for k in range(300)] + [(5, None, None), (None, "a", "en")], "i long, t string, lang string")
    marks = spark.createDataFrame([(k, k % 3 == 0) for k in range(300)], "i long, y boolean").select("i", F.col("y").cast("int").alias("y"))
    rows = toxicity.sample(docs, marks, 20, 1 << 20, 1)
    assert Counter(y for _, y, _ in rows) == {0: 20, 1: 20} and len({t for t, _, _ in rows}) == 40
    rows = toxicity.sample(docs, marks, 50, 60, 1)
    assert all(sum(len(t) for t, y, _ in rows if y == label) <= 60 for label in (0, 1)) and {y for _, y, _ in rows} == {0, 1}
    assert Counter(y for _, y, _ in toxicity.sample(docs, marks, 50, 1, 1)) == {0: 1, 1: 1}


def test_all_labelled_texts_are_learnt_from(spark, monkeypatch):
    """Where one fit does not take all texts, features are counted, the network trained and the threshold set over all of them."""
    docs = _corpus(spark)
    known = docs.filter(common.bucket("doc_id", 3) != 0).select(F.col("doc_id").alias("i"), F.col("toxic").alias("y"))
    rows = toxicity.labelled(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"), "lang"), known, 11)
    texts = rows.select(F.col("t").alias("text"), "y")
    every = [(r["text"].encode(), r["y"]) for r in texts.collect()]
    assert len(every) == known.count()
    want = Counter(p for t, _ in every for p in {int(h) & toxicity.PLACES - 1 for w in common.words(t) for h in toxicity.features([w])[0]})
    seen = toxicity.counted(texts)
    assert {k: int(seen[k]) for k in np.flatnonzero(seen)} == dict(want)
    net = toxicity.fit((common.words(t) for t, _ in every), np.array([y for _, y in every], float), steps=3)
    z, y = toxicity.outputs(net, (common.words(t) for t, _ in every)), np.array([y for _, y in every], float)
    assert abs(toxicity.calibrated(net, texts, 0.2) - toxicity.threshold(np.round(z * 1000) / 1000, y, 0.2)) < 1e-9
    first = toxicity.widened(toxicity.fit((common.words(t) for t, _ in every[:20]), y[:20], steps=20, least=1), seen, 4)
    loss = lambda n: sum(np.mean(np.log1p(np.exp(np.where(y == v, 1 - 2 * v, 0) * toxicity.outputs(n, (common.words(t) for t, _ in every))))[y == v]) for v in (0, 1))
    assert loss(toxicity.refined(first, texts.repartition(3, "text"), float(y.mean()))) < loss(first)
    fits = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda t, y, **k: fits.append(len(y)) or fit(t, y, **k, steps=20))
    model = toxicity.learnt(rows, 0.2, 20, 1 << 20, 11)
    assert fits == [40] and len(model.net.known) > 0 and model.net.mask == toxicity.PLACES - 1 and toxicity.learnt(rows, 0.2, 1000, 64 << 20, 11) is None


def test_labelled_texts_stay_where_they_are(spark, monkeypatch):
    """No text is exchanged but those of repeated ids, of which the smallest counts; nulls beside a text do not hide it."""
    plans, keep = [], common.written
    monkeypatch.setattr(toxicity, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    rows = [(k, f"text {k}", "en") for k in range(40)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(3, 0), (99, 1), (None, 1)], "i long, y int")
    of = lambda rows: {(r["i"], r["y"], r["t"]) for r in toxicity.labelled(spark.createDataFrame(rows, "i long, t string, lang string"), marks, 11).collect()}
    want = {(k, 0 if k == 3 else k % 2, f"text {k}") for k in range(30)}
    assert of(rows) == want and "Exchange hashpartitioning" not in plans[-1]
    more = [(5, "a", "en"), (5, "z", "en"), (6, None, "en"), (7, "text 7", "en"), (None, "a", "en"), (4, "text 4", None)]
    assert of(rows + more) == want - {(5, 1, "text 5")} | {(5, 1, "a")} and plans[-1].count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(toxicity, "SENT", 0)
    assert of(rows + more) == want - {(5, 1, "text 5")} | {(5, 1, "a")}


def test_moves_are_averaged_by_blocks_of_features(spark):
    """Each feature's moves are averaged over the tasks that met it, all else by texts; blocks of averages, not the tasks' own moves, reach the driver."""
    docs = _corpus(spark, 120).select("text", F.col("toxic").alias("y")).repartition(3, "text")
    every = [(list(common.words(r["text"].encode())), r["y"]) for r in docs.collect()]
    net = toxicity.widened(toxicity.fit((t for t, _ in every), np.array([y for _, y in every], float), steps=5, least=1), toxicity.counted(docs), 1)
    parts = [[(list(common.words(r["text"].encode())), r["y"]) for r in p] for p in docs.rdd.glom().collect()]
    own = [toxicity.moves(toxicity.copy.deepcopy(net), [([t for t, _ in p], np.array([y for _, y in p], float))] if p else [], 0.2) for p in parts]
    total, by = np.zeros(net.table.shape), np.zeros(len(net.table))
    for m in own:
        total[m["at"]] += m["rows"]
        by[m["at"]] += 1
    got = toxicity.refined(net, docs, 0.2)
    assert np.allclose((got.table - net.table)[:-1], (total / np.maximum(by, 1)[:, None])[:-1], atol=1e-5) and (got.table != net.table).any()
    rest = [sum(x) / len(every) for x in zip(*[m["rest"] for m in own], strict=True)]
    assert all(np.allclose(p - q, r, atol=1e-5) for p, q, r in zip(toxicity._params(got)[1:], toxicity._params(net)[1:], rest, strict=True))


def test_large_corpora_have_thresholds_by_language(spark, monkeypatch):
    """where one fit does not take all texts, each language has a threshold over all its calibration texts, and a feature of four texts an embedding, however many texts there are."""
    docs = _corpus(spark)
    known = docs.select(F.col("doc_id").alias("i"), F.col("toxic").alias("y"))
    rows = toxicity.labelled(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"), "lang"), known, 11)
    monkeypatch.setattr(toxicity, "SHARE", 60)  # 700 texts are many
    model = toxicity.learnt(rows, 0.2, 40, 1 << 20, 11)
    seen = toxicity.counted(rows.filter("not held").select(F.col("t").alias("text"), "y"))
    assert len(model.net.known) == (seen >= 4).sum() > (seen >= 11).sum()
    assert set(model.by_language) == {"aa", "bb"}
    held = [(r["t"].encode(), r["y"]) for r in rows.filter("held").collect()]
    z, y = np.round(toxicity.outputs(model.net, (common.words(t) for t, _ in held)) * 1000) / 1000, np.array([v for _, v in held], float)
    found = np.array(toxicity.language_id.predict([t.decode() for t, _ in held], model.languages)[0])
    for lang, got in model.by_language.items():
        assert abs(got - toxicity.threshold(z[found == lang], y[found == lang], 0.2)) < 1e-9
    sets = [toxicity.language_id.grams(t.decode()) for t, _ in held]
    want = toxicity.language_id.kernel(sets, model.languages) @ model.languages.weights + model.languages.bias
    assert np.allclose([model.languages.outputs(x) for x in sets], want, atol=1e-4)  # sums by gram are the kernel's
    hashes = np.arange(0, 1 << 32, 40_009, dtype=np.uint64)
    row = {int(h): k for k, h in enumerate(model.net.known)}
    assert model.net.rows(hashes).tolist() == [row.get(int(h) % toxicity.PLACES, len(row)) for h in hashes]
