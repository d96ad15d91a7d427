"""Packing, line dedup, quality rules, merge dropout, substring dedup."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import line_dedup, merge_dropout, packing, quality_rules, substring_dedup

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


def _whole(texts):
    """Ids by tokenizers of whole texts."""
    return [e.ids for e in packing.encoder(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_are_those_of_tokenizers(monkeypatch):
    rng = random.Random(1)
    chars = [chr(c) for c in range(packing.PLAIN_BELOW)]
    texts = ["".join(chars[i : i + 3]) for i in range(len(chars))] + ["".join(rng.choice(chars) for _ in range(60)) for _ in range(600)]
    texts += ["".join(rng.choice(" \n\t'sdmrevl\x85\xa0\x1caZ9!é") for _ in range(40)) for _ in range(600)]
    texts += ["a<|endoftext|>b", "日本 ⅷ", None, "", "don't  stop\n\n", "\u2028x \u3000"]
    assert [x.tolist() for x in packing.encode(texts, BPE)] == [[*x, packing.END_ID] for x in _whole(texts)]
    monkeypatch.setattr(packing, "MANY", 7)  # long texts word group by word group
    monkeypatch.setattr(packing, "KEPT", 50)  # and words forgotten on the way
    assert [x.tolist() for x in packing.encode(texts[-800:], BPE)] == [[*x, packing.END_ID] for x in _whole(texts[-800:])]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + "\t" * 1_000_000 + "y", "9é " * 300_000])
def test_ids_of_long_runs(text):
    assert packing.encode([text], BPE)[0].tolist() == [*_whole([text])[0], packing.END_ID]


def test_ids_of_whole_documents(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [x.tolist() for x in packing.encode(texts, BPE)] == [[*x, packing.END_ID] for x in _whole(texts)]


def test_first_fit_decreasing():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 100, 1000):
        sizes = [rng.choice((rng.randint(1, 2048), 2048, 1024)) for _ in range(n)]
        left: list[int] = []
        for s in sorted(s for s in sizes if s < 2048)[::-1]:
            b = next((k for k, c in enumerate(left) if c >= s), len(left))
            left += [2048] * (b == len(left))
            left[b] -= s
        bins = packing.first_fit_decreasing(sizes, 2048)
        used = Counter()
        for b, s in zip(bins, sizes, strict=True):
            used[b] += s
        assert max(used.values(), default=0) <= 2048
        assert sorted(used.values()) == sorted([2048 - c for c in left] + [2048] * sizes.count(2048))


def _check_packing(rows, docs):
    want = Counter((d["doc_id"], len(x) + 1, (*x, packing.END_ID)) for d, x in zip(docs, _whole([d["text"] for d in docs]), strict=True))
    by_seq, pieces = defaultdict(list), defaultdict(Counter)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]][r["start"], r["length"], r["ids_crc32"]] += 1
    for spans in by_seq.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 2048
    got = defaultdict(Counter)
    for (i, n, ids), times in want.items():
        for a in range(0, n, 2048):
            part = np.array(ids[a : a + 2048], "<u4")
            got[i, n][a, len(part), zlib.crc32(part.tobytes())] += times
    assert got == pieces


def test_packing(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.op1_packing(spark, SMALL).collect()
    _check_packing(rows, docs.select("doc_id", "text").collect())
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert sum(2048 - n for n in used.values()) < 0.02 * 2048 * len(used)
    _check_packing(packing.pack(odd_docs, BPE, group_docs=4).collect(), odd_docs.select("doc_id", "text").collect())
    assert packing.pack(no_docs, BPE).count() == 0


def _dedup_lines(docs):
    """Brute force: {position of row: text}."""
    import hashlib

    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    cut, where = [], defaultdict(list)
    for r, (i, t) in enumerate(docs):
        lines = (t or "").split("\n")
        h = [number(x) for x in lines]
        found = set()
        for seed in line_dedup.SEEDS:
            begin = run = 0  # run: marked lines up to here
            for n, x in enumerate(h):
                mark = seed * (x + (h[n - 1] if n else 0) * line_dedup.FACTOR) % line_dedup.PRIME % line_dedup.DIVISOR != 0
                run = run + 1 if mark else 0
                if run % 2 or n + 1 == len(h):
                    if n + 1 - begin >= line_dedup.MIN_LINES:
                        found.add((begin, n + 1))
                    begin = n + 1
        cut.append(lines)
        for k, after in found:
            where["\n".join(lines[k:after])].append((i is None, i, t, k, r))
    gone = set()
    for bytes_, places in where.items():
        holder = min((p[0], p[1] or 0) for p in places)
        for none, i, t, k, r in places:
            first = min(p[3] for p in places if p[1] == i and p[2] == t)
            if (none, i or 0) != holder or k != first:
                gone |= {(r, k + n) for n in range(bytes_.count("\n") + 1)}
    return [None if t is None else "\n".join(x for k, x in enumerate(cut[r]) if (r, k) not in gone) for r, (i, t) in enumerate(docs)]


def test_line_dedup_finds_short_passages(spark):
    """Passages of three to eight lines between lines of their own: most go at their second place, and no line is lost altogether."""
    rng = random.Random(5)
    line = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(12))
    passages = [[line() for _ in range(3 + n % 6)] for n in range(240)]
    texts = [[*(line() for _ in range(n % 5)), *p, *(line() for _ in range(1 + n % 4))] for _ in range(2) for n, p in enumerate(passages)]
    docs = spark.createDataFrame([(n, "\n".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(docs).collect()}
    assert all(got[n] == texts[n] for n in range(240))
    missed = Counter(len(p) for n, p in enumerate(passages) if set(p) <= set(got[n + 240]))
    assert missed[3] <= 8 and sum(v for k, v in missed.items() if k > 4) <= 2
    assert all(set(texts[n + 240]) - set(passages[n]) <= set(got[n + 240]) for n in range(240))


def test_line_dedup_of_one_line_over_and_over(spark):
    docs = spark.createDataFrame([(n, "\n".join([w] * 40)) for n, w in enumerate("abcdefghijklmnop")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert all(set(t.split("\n")) == {"abcdefghijklmnop"[n]} for n, t in got.items())
    assert sum(len(t) < 10 for t in got.values()) >= 12


def test_line_dedup(spark, same, odd_docs, no_docs):
    same(line_dedup.op2_line_dedup, line_dedup.SQL)
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = Counter(zip([i for i, _ in rows], _dedup_lines(rows), strict=True))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert len([t for (i, t) in want if i == 7][0]) < len(rows[6][1])
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """With a digest that always clashes, chunks of different text stay."""
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.length(F.coalesce(F.col(c[0]) if isinstance(c[0], str) else c[0], F.lit(""))).cast("long"))
    texts = ["\n".join(f"{w}{n}" for n in range(10, 40)) for w in ("aa", "bb", "cc")]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, texts[0])], "doc_id long, text string")
    # ids 1 and 4 share id-independent hashes here, which is what a clash of row hashes would do; ids keep them apart
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == texts[0] and got[2] == texts[1] and got[3] == texts[2] and len(got[4]) < len(texts[0])


def _measure(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {x for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(spark, odd_docs):
    rng = random.Random(4)
    texts = ["", None, "a b c d e a b c d e", "a " * 50, "x\x1cy\x85z", " ".join(rng.choice("abc") for _ in range(300)), " ".join(f"w{k % 3000}" for k in range(9000))]
    assert [quality_rules.measure(t)[:5] for t in texts] == [_measure(t) for t in texts]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = quality_rules.op3_quality_rules(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        m = _measure(docs[r["doc_id"]])
        assert tuple(r)[1:6] == m and r["base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and not (r["base_failed"] and r["kept"])


def test_quality_bound():
    for k, n, p in ((0, 100, 0.05), (3, 200, 0.02), (10, 10, 0.5)):
        exact = sum(np.prod([(n - i) / (i + 1) for i in range(j)]) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert abs(quality_rules.binomial_cdf(k, n, p) - exact) < 1e-9
    assert quality_rules.bounded(0, 1000, 0.01, 0.01) and not quality_rules.bounded(0, 100, 0.01, 0.01) and not quality_rules.bounded(0, 0, 0.5, 0.5)


def test_quality_guarantee():
    """Over many draws of labels the chosen cutoffs reject more than the rate of good texts in a share of at most delta of the draws."""
    rng = np.random.default_rng(3)
    rate, level, wide, bad = 0.05, 0.1, 400, 0
    truth = rng.normal(0.1, 0.05, (200_000, len(quality_rules.RULES))).clip(0)
    truth[:, 2] *= 60  # long_words has a scale of its own
    learned = 0
    for _ in range(wide):
        v = rng.normal(0.1, 0.05, (600, truth.shape[1])).clip(0)
        v[:, 2] *= 60
        good = rng.random(600) < 0.8
        v[~good] *= rng.choice([1, 2], (int((~good).sum()), 1))  # some bad texts look like good ones
        tuned = np.arange(600) % quality_rules.TUNED == 0
        sets = quality_rules.path(v[tuned], good[tuned], 8)
        hold, ok = v[~tuned], good[~tuned]
        lost = [(hold > np.array(c)).any(1) for c in sets]
        take = quality_rules.chosen([(int((x & ok).sum()), int((x & ~ok).sum())) for x in lost], int(ok.sum()), rate, level)
        if take:
            learned += 1
            bad += (truth > np.array(sets[take - 1])).any(1).mean() > rate
    assert learned > wide / 2 and bad <= level * wide


def test_quality_kept_is_brute_force(spark):
    """kept of the query, from labels and texts by plain Python."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hashed = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("h")).withColumn("tuned", F.pmod(F.xxhash64("h", F.lit(13)), F.lit(quality_rules.TUNED)) == 0).withColumn("place", F.pmod(F.xxhash64("h", F.lit(14)), F.lit(1 << 30)))
    marks = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        marks[r["doc_id"]] = marks.get(r["doc_id"], False) or r["quality"] == 1
    rules = {
        "symbols": lambda m: m[2] / max(m[1], 1), "dup_lines": lambda m: m[3] / max(m[5], 1), "long_words": lambda m: m[1] / max(m[0], 1),
        "capitals": lambda m: m[6] / max(m[1], 1), "marks": lambda m: m[7] / max(m[0], 1),
    }
    assert list(rules) == list(quality_rules.RULES)
    seen, once = {}, {}
    for r in hashed.collect():
        m = quality_rules.measure(r["text"])
        seen[r["doc_id"]] = (r["lang"] or "", m, [f(m) for f in rules.values()], m[0] < 10 or 100 * m[4] > 20 * m[0])
        if r["doc_id"] in marks and not seen[r["doc_id"]][3]:
            old = once.get((r["lang"] or "", r["h"]))
            once[r["lang"] or "", r["h"]] = (r["place"], r["tuned"], seen[r["doc_id"]][2], marks[r["doc_id"]] or bool(old and old[3]))
    strata, cut = {k for k, _ in once}, {}
    for lang in strata:
        rows = sorted(x for (k, _), x in once.items() if k == lang)
        part = [x for x in rows if x[1]]
        hold = [x for x in rows if not x[1]]
        sets = quality_rules.path(np.array([x[2] for x in part]), np.array([x[3] for x in part]))
        best, n = 0, sum(x[3] for x in hold)
        for c in sets:
            lost = [x for x in hold if any(v > y for v, y in zip(x[2], c, strict=True))]
            g = sum(x[3] for x in lost)
            if sum(math.comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(g + 1)) > 0.05 / len(strata):
                break
            if len(lost) - 2 * g > best:
                best, cut[lang] = len(lost) - 2 * g, c
    assert set(cut) == strata  # every language learns to reject
    for r in quality_rules.op3_quality_rules(spark, sf).collect():
        lang, _, v, failed = seen[r["doc_id"]]
        assert r["kept"] == (not failed and not any(x > y for x, y in zip(v, cut[lang], strict=True)))


def test_quality_learns_and_filters(spark, odd_docs, no_docs):
    rng = random.Random(5)
    good = [(n, " ".join(rng.choice("abcdefghij") * rng.randint(2, 7) for _ in range(40)), "en") for n in range(3000)]
    bad = [(n, " ".join("|" + rng.choice("abcdefghij") * 5 for _ in range(40)), "en") for n in range(3000, 3300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 3000).cast("int").alias("quality"))
    kept = {r["doc_id"] for r in quality_rules.filter_docs(docs, labels).collect()}
    base = {n for n, t, _ in good if 100 * _measure(t)[4] <= 20 * 40}
    assert not kept & set(range(3000, 3300)) and len(kept) >= 0.99 * len(base)
    none = labels.filter("false")
    assert quality_rules.filter_docs(odd_docs, none).columns == odd_docs.columns
    got = Counter(r["doc_id"] for r in quality_rules.filter_docs(odd_docs, none).collect())
    want = Counter(r["doc_id"] for r in odd_docs.collect() if (m := _measure(r["text"]))[0] >= 10 and 100 * m[4] <= 20 * m[0])
    assert got == want
    assert quality_rules.rule_table(no_docs, none).count() == 0 and quality_rules.rule_table(odd_docs, None).count() == odd_docs.count()


def test_substrings_of_rows_repeated_many_times(spark):
    """100,000 copies of a row are read as one list of chunks and lose nothing but what another row keeps."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared = prose(60)
    twice = f"{prose(20)} {shared} {prose(20)}"
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(twice).alias("text")).unionByName(spark.createDataFrame([(3, f"{prose(9)} {shared}")], "doc_id long, text string"))
    rows = substring_dedup.repeated_spans(docs).collect()
    assert [r["id"] for r in rows] == [7] and {s["holder"] for s in rows[0]["spans"]} == {3} and sum(s["b"] - s["a"] for s in rows[0]["spans"]) > 200


ODD_TEXTS = ["", "a", "  a b  ", "日本\x00a힣", "a" * 300 + " b", "▁x ▁▁y", "\n\n x", "😀 é", " " * 40 + "z"]


def test_merge_dropout():
    import sentencepiece

    sp, v = sentencepiece.SentencePieceProcessor(model_file=PIECES), merge_dropout.vocabulary(PIECES)
    rng = random.Random(6)
    texts = [t for t in ODD_TEXTS if "▁" not in t] + [" ".join("".join(rng.choice("abetionsrhé,.") for _ in range(rng.randint(1, 60))) for _ in range(80)) for _ in range(20)]
    assert [x.tolist() for x in merge_dropout.encode(texts, [0] * len(texts), v, 0.0, 1)] == sp.encode(texts)
    for rate in (0.1, 0.5, 1.0):
        ids = merge_dropout.encode(ODD_TEXTS + texts, [1] * (len(ODD_TEXTS) + len(texts)), v, rate, 7)
        assert [merge_dropout.decode(x, v) for x in ids] == ODD_TEXTS + texts
    assert all(len(v.pieces[i].replace("▁", "")) <= 1 or i < 259 for x in ids for i in x)
    one, two, again = (merge_dropout.encode(texts, [3] * len(texts), v, 0.2, seed) for seed in (1, 2, 1))
    assert all((a == b).all() for a, b in zip(one, again, strict=True)) and any(len(a) != len(b) or (a != b).any() for a, b in zip(one, two, strict=True))
    alone = merge_dropout.encode(texts[-1:], [3], v, 0.2, 1)[0]
    assert (alone == one[-1]).all()
    words = list({w for t in texts for w in merge_dropout.split(t)})
    keys = merge_dropout.mix(np.arange(len(words), dtype=np.uint64))
    pool, start, count = merge_dropout.agendas(words, keys, v, 0.3)
    assert [pool[a : a + n].tolist() for a, n in zip(start, count, strict=True)] == [merge_dropout._alone(w, k, v, 0.3) for w, k in zip(words, keys, strict=True)]


def test_merge_dropout_long_words():
    """A word of half a million letters, in seconds; undropped it is sentencepiece's, dropped it comes back and repeats itself."""
    import sentencepiece

    sp, v = sentencepiece.SentencePieceProcessor(model_file=PIECES), merge_dropout.vocabulary(PIECES)
    rng = random.Random(8)
    word = "".join(rng.choice("abetionsrhé") for _ in range(500_000))
    assert merge_dropout.encode([word[:20_000]], [0], v, 0.0, 1)[0].tolist() == sp.encode(word[:20_000])
    start = time.monotonic()
    ids, again = (merge_dropout.encode([word], [1], v, 0.2, 7)[0] for _ in range(2))
    assert time.monotonic() - start < 60 and merge_dropout.decode(ids, v) == word and (ids == again).all()


def test_merge_dropout_cuts_every_occurrence_by_itself(spark):
    v = merge_dropout.vocabulary(PIECES)
    word = "international"
    ids = [x.tolist() for x in merge_dropout.encode([f"{word} " * 500] * 2, [3, 4], v, 0.2, 1)]
    assert ids[0] != ids[1] and len(set(_cuts(ids[0], v))) > 30
    # each occurrence as if it ran alone, whatever it shares a run with
    texts = [" ".join(random.Random(n).choices(["the", "a", word, "été", "x" * 60, "running"], k=300)) for n in range(12)]
    for rate in (0.1, 0.5):
        words, of, keys = merge_dropout.places([merge_dropout.split(t) for t in texts], list(range(12)), 5)
        assert len(np.unique(keys)) == len(of)
        pool, start, count, run = merge_dropout.occurrences(words, of, keys, v, rate)
        assert len(start) < len(of)
        assert [pool[start[r] : start[r] + count[r]].tolist() for r in run] == [merge_dropout._alone(words[w], k, v, rate) for w, k in zip(of, keys, strict=True)]
    docs = spark.createDataFrame([(n, word) for n in range(400)], "doc_id long, text string")
    assert len({tuple(r["ids"]) for r in merge_dropout.segment(docs, PIECES, rate=0.2).collect()}) > 30


def _cuts(ids, v):
    """The pieces of each word of a text that is one word over and over."""
    out = []
    for i in ids:
        if v.pieces[i].startswith("▁"):
            out.append(())
        out[-1] += (i,)
    return out


def test_merge_dropout_query(spark, odd_docs, no_docs):
    rows = merge_dropout.op4_merge_dropout(spark, SMALL).collect()
    assert len(rows) == 200 and all(r["lossless"] for r in rows)
    got = Counter((r["doc_id"], r["text_back"]) for r in merge_dropout.segment(odd_docs, PIECES).collect())
    assert got == Counter((r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    assert merge_dropout.segment(no_docs, PIECES).count() == 0


def test_chunk_hash():
    raw = np.frombuffer(random.Random(7).randbytes(500), np.uint8)
    h, want = 0, []
    for b in raw.tolist():
        h = (2 * h + int(substring_dedup.gear()[b])) % 2**32
        want.append(h)
    assert substring_dedup.rolling(raw).tolist() == want
    assert substring_dedup.cuts(b"") == [] and substring_dedup.cuts("é".encode() * 400)[-1] == 800


def _spans(docs, span=substring_dedup.SPAN):
    """Brute force: {(id, text): [(a, b)]}."""
    where, chunks = {}, {}
    for i, t in docs:
        raw, a, own = (t or "").encode(), 0, []
        for b in substring_dedup.cuts(raw):
            own.append((a, b, raw[a:b]))
            a = b
        chunks[i, t] = own
        for n, c in enumerate(own):
            where.setdefault(c[2], []).append((i is None, i or 0, t, n))
    many = Counter(c[2] for i, t in docs for c in chunks[i, t])
    out = {}
    for (i, t), own in chunks.items():
        runs, seen = [], set()
        for n, (a, b, c) in enumerate(own):
            if many[c] < 2 or (min(where[c])[:2] == (i is None, i or 0) and not (c in seen or seen.add(c))):
                continue
            if runs and runs[-1][2] == n - 1:
                runs[-1][1:] = [b, n]
            else:
                runs.append([a, b, n])
        if runs := [(a, b) for a, b, _ in runs if b - a >= span]:
            out[i, t] = runs
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_substring_dedup(spark, odd_docs, no_docs, odd):
    docs = odd_docs if odd else spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = _spans(rows)
    got = substring_dedup.repeated_spans(docs).select("id", "hash", "spans").collect()
    by = {(r["id"], tuple((s["a"], s["b"]) for s in r["spans"])) for r in got}
    assert by == {(i, tuple(s)) for (i, _), s in want.items()}
    out = substring_dedup.dedup_substrings(docs)
    assert out.columns == docs.columns
    cut = lambda i, t: t if (i, t) not in want else substring_dedup.cut_out(t, [{"a": a, "b": b} for a, b in want[i, t]])
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((i, cut(i, t)) for i, t in rows)
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_substring_dedup_finds_shifted_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(40)]
    docs = [(n, f"{prose(rng.randint(50, 90))} {passages[n % 40]} {prose(70)}") for n in range(80)] + [(n, prose(150)) for n in range(80, 160)]
    got = {r["id"] for r in substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) >= 39 and got <= set(range(40, 80))


def test_substring_dedup_finds_passages_just_over_fifty_words(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(51) for _ in range(600)]
    docs = [(n, f"{prose(rng.randint(20, 60))} {passages[n % 600]} {prose(40)}") for n in range(1200)]
    got = {r["id"] for r in substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == set(range(600, 1200))
