"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds calibrated by language.

A word's vector is the sum of the embeddings of its hashed features (the word and its runs of four to six bytes, with its ends marked) over the
root of their number; filters of several widths slide over the words of a whole text, each is pooled by its maximum, and a logistic layer
reads the maxima.  Features that few training texts hold have no embedding, so that what was never seen counts for nothing.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id
from .common import PIECE, bucket, distinct, dropped, growing, mix, scan, slices, table, words, written

WIDTHS, FILTERS, SIZE = (1, 2, 3), 16, 16
GRAMS = (4, 5, 6)
PAD = max(WIDTHS) - 1
#: Words of one pooling step; a longer text is pooled piece by piece, as texts and long words are read in pieces of PIECE bytes.
STEP = 1 << 16
#: Places of hashed features when more texts are learnt from than one fit takes, texts that one task of a round learns from, about, and rounds.
PLACES, SHARE, ROUNDS = 1 << 21, 8000, 1
#: Blocks of features by which tasks deal what they learnt.
BLOCKS = 256
#: Bytes of labels and their ids that are sent to all tasks at most.
SENT = 32 << 20
#: Words whose vectors a task keeps, and bytes of the longest of them.
KEPT, SHORT = 200_000, 64


def own_hash(vocabulary: list[bytes]) -> np.ndarray:
    return mix(np.array([zlib.crc32(w) for w in vocabulary], np.uint64) + (np.uint64(1) << np.uint64(40)))


def run_hash(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` bytes of x that begin at these places."""
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + x[at + k]
    return mix(h)


def features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words, one after another, and where each word's begin: a word has one feature for itself and one for each run of GRAMS bytes of <word>."""
    x = np.frombuffer(b"".join(b"<" + w + b">" for w in vocabulary), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in vocabulary], np.int64)
    owner = np.repeat(np.arange(len(vocabulary)), size)
    end = np.cumsum(size)[owner] if len(size) else size
    found, of = [own_hash(vocabulary)], [np.arange(len(vocabulary))]
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(x)) + n <= end)
        found.append(run_hash(x, at, n))
        of.append(owner[at])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (np.concatenate(found) >> np.uint64(32))[order], np.searchsorted(of[order], np.arange(len(vocabulary)))


@dataclass
class Network:
    known: np.ndarray  # hashes of the features with an embedding, rising
    table: np.ndarray  # their embeddings, then a row of zeros
    filters: list[np.ndarray]  # width by SIZE by FILTERS
    shift: np.ndarray  # of each pooled filter
    out: np.ndarray  # logistic weights
    bias: np.ndarray
    mask: int = (1 << 32) - 1  # of the hashes that known holds
    cache: dict = field(default_factory=dict)  # word to vector

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "places"} | {"cache": {}}

    @cached_property
    def places(self) -> np.ndarray:
        """The row of each masked hash."""
        out = np.full(self.mask + 1, len(self.known), np.int32)
        out[self.known.astype(np.int64)] = np.arange(len(self.known))
        return out

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each feature; unknown ones have the last, which is zero."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        hashes = hashes & np.uint64(self.mask)
        if self.mask < PLACES:
            return self.places[hashes.astype(np.int64)].astype(np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, len(self.known))

    def sums(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Word vectors from the rows of their features."""
        count = np.diff(starts, append=len(rows))
        total = np.add.reduceat(self.table[rows], starts, axis=0) if len(starts) else np.zeros((0, SIZE), np.float32)
        return (total / np.sqrt(count)[:, None]).astype(np.float32)

    def vectors(self, vocabulary: list[bytes]) -> np.ndarray:
        """Word vectors, and one of zeros behind them (padding)."""
        out, group, held, fresh = np.zeros((len(vocabulary) + 1, SIZE), np.float32), [], 0, []
        for k, w in enumerate(vocabulary):
            if (v := self.cache.get(w)) is not None:
                out[k] = v
                continue
            if len(w) <= SHORT:
                fresh.append(k)
            if len(w) > PIECE:
                out[k] = self.long_word(w)
                continue
            group.append(k)
            held += len(w) + 2
            if held > PIECE:
                self._fill(out, vocabulary, group)
                group, held = [], 0
        self._fill(out, vocabulary, group)
        for k in fresh[: max(0, KEPT - len(self.cache))]:
            self.cache[vocabulary[k]] = out[k].copy()
        return out

    def _fill(self, out: np.ndarray, vocabulary: list[bytes], group: list[int]) -> None:
        hashes, starts = features([vocabulary[k] for k in group])
        out[group] = self.sums(self.rows(hashes), starts)

    def long_word(self, word: bytes) -> np.ndarray:
        """The vector of one word, piece by piece."""
        total, n = self.table[self.rows(own_hash([word]) >> np.uint64(32))].sum(0), 1
        for size in GRAMS:
            for a in range(0, len(word) + 2 - size + 1, PIECE):
                piece = (b"<" + word + b">")[a : a + PIECE + size - 1]
                h = run_hash(np.frombuffer(piece, np.uint8).astype(np.uint64), np.arange(len(piece) - size + 1), size)
                total = total + self.table[self.rows(h >> np.uint64(32))].sum(0)
                n += len(h)
        return total / math.sqrt(n)

    def pooled(self, v: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        """The maximum of each filter over each text, texts as row numbers of v."""
        best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        edge = np.full(PAD, len(v) - 1)
        # in doubles, then rounded: a word's values do not depend on the words beside it
        projected = [[(v.astype(float) @ f[j].astype(float)).astype(np.float32) for j in range(len(f))] for f in self.filters]

        def tops(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            """Maxima over the places from each even bound to the next; from the odd ones on no text's windows begin."""
            n = len(ids) - PAD
            return np.hstack([np.maximum.reduceat(sum(p[ids[j : j + n]] for j, p in enumerate(ps)), bounds[bounds < n], axis=0)[::2] for ps in projected])

        group: list[int] = []
        held = 0
        for k, own in enumerate([*texts, None]):
            if own is None or held > STEP:
                if group:  # short texts side by side, with padding between them
                    sizes = [len(texts[g]) + 2 * PAD for g in group]
                    ids = np.concatenate([x for g in group for x in (edge, texts[g], edge)])
                    first = np.cumsum([0, *sizes[:-1]])
                    best[group] = tops(ids, np.stack([first, first + np.array(sizes) - PAD], 1).ravel())
                group, held = [], 0
            if own is not None and len(own) <= STEP:
                group.append(k)
                held += len(own) + 2 * PAD
            elif own is not None:
                padded = np.concatenate([edge, own, edge])
                for a in range(0, len(own) + PAD, STEP):  # places a to a + STEP, each with the words after it
                    best[k] = np.maximum(best[k], tops(padded[a : a + STEP + PAD], np.array([0]))[0])
        return best

    def logits(self, top: np.ndarray) -> np.ndarray:
        return np.round((np.maximum(top + self.shift, 0) * self.out.astype(float)).sum(1) + self.bias, 6)


def indexed(texts: Iterable[Iterable[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """Different words, and texts as numbers of them."""
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int32) for t in texts]
    return list(number), ids


def fit(texts: Iterable[Iterable[bytes]], y: np.ndarray, steps: int = 240, batch: int = 32, rate: float = 4e-3, least: int = 4, seed: int = 17) -> Network:
    """Trains by Adam on the logistic loss, each batch half of either label; features that fewer than `least` texts hold get no embedding, and embeddings move only where they are met."""
    rng = np.random.default_rng(seed)
    vocabulary, ids = indexed(texts)
    hashes, starts = features(vocabulary)
    count = np.diff(starts, append=len(hashes))
    places, back = np.unique(hashes, return_inverse=True)
    seen = np.zeros(len(places), np.int64)
    for own in map(np.unique, ids):
        n = count[own]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        seen[np.unique(back[np.repeat(starts[own] - begin, n) + np.arange(n.sum())])] += 1
    known = places[seen >= least]
    net = Network(
        known, np.vstack([rng.normal(0, 0.1, (len(known), SIZE)), np.zeros((1, SIZE))]).astype(np.float32),
        [rng.normal(0, 1 / math.sqrt(w * SIZE), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1),
    )
    rows = net.rows(hashes)
    params = [net.table, *net.filters, net.shift, net.out, net.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    turns = [np.concatenate([rng.permutation(np.flatnonzero(y == label)) for _ in range(1 + steps * batch // 2 // max(1, int((y == label).sum())))]) for label in (0, 1)]
    for t in range(1, steps + 1):
        part = np.concatenate([x[(t - 1) * batch // 2 : t * batch // 2] for x in turns])
        touched, grads = gradients(net, [ids[k] for k in part], y[part], rows, starts, count)
        for n, (p, g, (m, s)) in enumerate(zip(params, grads, moments, strict=True)):
            at = touched if n == 0 else slice(None)
            m[at] += 0.1 * (g - m[at])
            s[at] += 0.01 * (g * g - s[at])
            p[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(s[at] / (1 - 0.99**t)) + 1e-6)
    return net


def gradients(net: Network, texts: list[np.ndarray], y: np.ndarray, rows: np.ndarray, starts: np.ndarray, count: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of the table that move, and the gradients of the mean loss (each text's times its weight) by them, the filters, shift, out and bias; only the places of the maxima pass any back."""
    used, flat = np.unique(np.concatenate([*texts, np.zeros(0, np.int32)]), return_inverse=True)
    local = np.split(flat, np.cumsum([len(x) for x in texts])[:-1])
    n = count[used]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)[: len(n)]
    own = rows[np.repeat(starts[used] - begin, n) + np.arange(n.sum())]
    v = np.vstack([net.sums(own, begin), np.zeros((1, SIZE), np.float32)])
    edge = np.full(PAD, len(v) - 1)
    top = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
    where = np.zeros(top.shape, np.int64)
    padded = [np.concatenate([edge, x, edge]) for x in local]
    for k, ids in enumerate(padded):
        for w, f in enumerate(net.filters):
            m = len(ids) - PAD
            values = sum((v[ids[j : j + m]] @ f[j] for j in range(len(f))), np.zeros((m, FILTERS), np.float32))
            best = values.argmax(0)
            at = slice(w * FILTERS, (w + 1) * FILTERS)
            where[k, at], top[k, at] = best, values[best, np.arange(FILTERS)]
    hidden = np.maximum(top + net.shift, 0)
    d = (1 / (1 + np.exp(-np.clip(hidden @ net.out + net.bias, -30, 30))) - y) / len(y) * (1 if weight is None else weight)
    d_hidden = d[:, None] * net.out * (hidden > 0)
    dv, d_filters, cols = np.zeros_like(v), [], np.arange(FILTERS)
    for w, f in enumerate(net.filters):
        at = slice(w * FILTERS, (w + 1) * FILTERS)
        d_f = np.zeros_like(f)
        for j in range(len(f)):
            word = np.array([ids[where[k, at] + j] for k, ids in enumerate(padded)])
            dp = np.bincount((word * FILTERS + cols).ravel(), d_hidden[:, at].ravel(), len(v) * FILTERS).reshape(len(v), FILTERS)
            d_f[j] = v.T @ dp
            dv += dp @ f[j].T
        d_filters.append(d_f)
    hit = np.flatnonzero(np.abs(dv[:-1]).sum(1) > 0)
    m = n[hit]
    first = np.concatenate([[0], np.cumsum(m)[:-1]]).astype(np.int64)[: len(m)]
    feats, place = np.unique(own[np.repeat(begin[hit] - first, m) + np.arange(m.sum())], return_inverse=True)
    pull = np.repeat(dv[hit] / np.sqrt(m)[:, None], m, axis=0)
    d_table = np.stack([np.bincount(place, pull[:, c], len(feats)) for c in range(SIZE)], 1)
    d_table[feats == len(net.known)] = 0
    return feats, [d_table, *d_filters, d_hidden.sum(0), hidden.T @ d, np.array([d.sum()])]


def outputs(net: Network, texts: Iterable[Iterable[bytes]]) -> np.ndarray:
    """Logits of texts given as words."""
    vocabulary, ids = indexed(texts)
    return net.logits(net.pooled(net.vectors(vocabulary), ids))


@dataclass
class Model:
    net: Network | None
    prior: float
    threshold: float  # logit at which a text of a language without its own is as likely toxic as not
    by_language: dict[str, float]
    languages: language_id.Model | None


def threshold(z: np.ndarray, y: np.ndarray, prior: float, n: np.ndarray | None = None) -> float:
    """The logit that parts labels 0 and 1 with the least error at this share of label 1: the middle of the widest of the best gaps.  n: how many texts each row stands for (None: one)."""
    order = np.argsort(z, kind="stable")
    n = np.ones(len(z)) if n is None else n[order]
    z, ones, zeros = z[order], n * y[order], n * (1 - y[order])
    # cut k: the first k texts are taken for label 0; only where logits differ
    missed = prior * np.concatenate([[0], np.cumsum(ones)]) / max(1, ones.sum())
    wrong = (1 - prior) * np.concatenate([np.cumsum(zeros[::-1])[::-1], [0]]) / max(1, zeros.sum())
    low, high = np.concatenate([[z[0] - 1], z]), np.concatenate([z, [z[-1] + 1]])
    cost = np.where(high > low, missed + wrong, np.inf)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = best[np.argmax((high - low)[best])]
    return float((low[k] + high[k]) / 2)


def train(rows: list[tuple[bytes, int, str | None]], prior: float, few: int = 8) -> Model:
    """Every fourth text of each label calibrates, the others train; a language has a threshold of its own if it is found in `few` calibration texts of each label."""
    parts = [[r for r in rows if r[1] == label] for label in (0, 1)]
    if min(map(len, parts)) < 2:
        return Model(None, prior, 0.0, {}, None)
    held = [r for p in parts for r in p[1::4]]
    learn = [r for p in parts for k, r in enumerate(p) if k % 4 != 1]
    net = fit((words(r[0]) for r in learn), np.array([r[1] for r in learn], float))
    z, y = outputs(net, (words(r[0]) for r in held)), np.array([r[1] for r in held], float)
    spoken = [(r[0].decode("utf-8", "surrogatepass"), r[2]) for r in learn if r[2] is not None]
    model = Model(net, prior, threshold(z, y, prior), {}, None)
    if len({lang for _, lang in spoken}) > 1:
        model.languages = language_id.train([t for t, _ in spoken], [lang for _, lang in spoken])
        found = np.array(language_id.predict([r[0].decode("utf-8", "surrogatepass") for r in held], model.languages)[0])
        for lang in model.languages.langs:
            own = found == lang
            if min((own & (y == 0)).sum(), (own & (y == 1)).sum()) >= few:
                model.by_language[lang] = threshold(z[own], y[own], prior)
    return model


def labelled(docs: DataFrame, marks: DataFrame, seed: int) -> DataFrame:
    """i, y, t, lang, d, held of every labelled id with a text, as a written table: its smallest label and smallest text (with its language), a seeded hash, and whether it calibrates (every fourth, about).

    While the labels fit in SENT bytes of each task, texts stay where they are: ids alone are counted, and only texts of repeated ones are exchanged.
    """
    sent = lambda df: F.broadcast(df) if size <= SENT else growing(df)
    one = written(marks.filter("i is not null").groupBy("i").agg(F.min("y").alias("y")))
    size = one.agg(F.coalesce(F.sum(F.octet_length(F.col("i").cast("string")) + 16), F.lit(0))).collect()[0][0]
    found = written(docs.select("i").join(sent(one), "i").groupBy("i", "y").agg((F.count("*") > 1).alias("many")))
    live = docs.filter("t is not null").select("i", "t", "lang").join(sent(found), "i")
    rows = live.filter("not many").select("i", "y", "t", "lang")
    if not found.filter("many").isEmpty():
        rows = rows.unionByName(live.filter("many").groupBy("i", "y").agg(F.min(F.struct("t", "lang")).alias("x")).select("i", "y", "x.t", "x.lang"))
    rows = rows.withColumn("d", F.xxhash64("i", F.lit(seed)))
    out = written(rows.withColumn("held", F.pmod(F.col("d"), F.lit(4)) == 1))
    dropped(one, found)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list[bytes]], np.ndarray]]:
    """Words and labels of the texts (columns text, y) of some MB at a time."""
    for b in batches:
        for part in slices(pa.Table.from_batches([b]), 2 << 20) if b.num_rows else ():
            yield [list(words(x)) for x in part["text"].cast(pa.binary()).to_pylist()], part["y"].to_numpy().astype(float)


def counted(rows: DataFrame) -> np.ndarray:
    """In how many of all texts (columns text, y) each place of hashed features is found: tasks count, treeReduce adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marks = np.zeros(PLACES, np.int32), np.zeros(PLACES, np.int64)
        for texts, _ in _pieces(batches):
            vocabulary, ids = indexed(texts)
            hashes, starts = features(vocabulary)
            places, count = (hashes & np.uint64(PLACES - 1)).astype(np.int64), np.diff(starts, append=len(hashes))
            for own in map(np.unique, ids):
                n = count[own]
                begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)[: len(n)]
                seen[distinct(places[np.repeat(starts[own] - begin, n) + np.arange(n.sum())], marks)] += 1
        # bytes of one place value side by side: nearly all of the higher ones are zero
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.ascontiguousarray(seen.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)], pa.binary())], ["seen"])

    add = lambda a, b: a + b
    back = lambda raw: np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    return rows.mapInArrow(run, "seen binary").rdd.map(lambda r: back(bytes(r["seen"]))).treeReduce(add, 2)


def widened(net: Network, seen: np.ndarray, least: int) -> Network:
    """net with an embedding for each place that `least` texts hold: that of its features in net, else zeros."""
    known = np.flatnonzero(seen >= least).astype(np.uint64)
    out = Network(known, np.zeros((len(known) + 1, SIZE), np.float32), net.filters, net.shift, net.out, net.bias, PLACES - 1)
    rows = out.rows(net.known)
    np.add.at(out.table, rows[rows < len(known)], net.table[:-1][rows < len(known)])
    return out


def _params(net: Network) -> list[np.ndarray]:
    return [net.table, *net.filters, net.shift, net.out, net.bias]


def moves(net: Network, pieces: Iterable[tuple[list[list[bytes]], np.ndarray]], prior: float, batch: int = 64, rate: float = 1e-3) -> dict:
    """What one pass of Adam over these texts, both labels of equal weight, adds to net: n (texts), at and rows (moved rows of the table), rest (of all else).

    net stays as it is; of its table only the rows that these texts meet are copied.
    """
    own_net = Network(net.known[:0], np.zeros((1, SIZE), np.float32), *copy.deepcopy([net.filters, net.shift, net.out, net.bias]))
    place, met, n, t = np.full(len(net.table), -1, np.int32), np.zeros(0, np.int64), 0, 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in _params(own_net)]
    moved = np.zeros(1, bool)
    for texts, y in pieces:
        vocabulary, ids = indexed(texts)
        hashes, starts = features(vocabulary)
        rows, count = net.rows(hashes), np.diff(starts, append=len(hashes))
        new = np.unique(rows)
        new = new[(place[new] < 0) & (new < len(net.known))]
        place[new] = np.arange(len(met), len(met) + len(new))
        met = np.concatenate([met, new])
        place[-1] = len(met)  # of features without an embedding
        grown = lambda x, more: np.concatenate([x[:-1], more, np.zeros_like(x[:1])])
        none = np.zeros((len(new), SIZE), np.float32)
        own_net.known, own_net.table = met, grown(own_net.table, net.table[new])
        moments[0], moved = (grown(moments[0][0], none), grown(moments[0][1], none)), grown(moved, np.zeros(len(new), bool))
        rows, params = place[rows], _params(own_net)
        for a in range(0, len(ids), batch):
            own = y[a : a + batch]
            t += 1
            touched, grads = gradients(own_net, ids[a : a + batch], own, rows, starts, count, np.where(own == 1, 0.5 / prior, 0.5 / (1 - prior)))
            moved[touched] = True
            for k, (p, g, (m, s)) in enumerate(zip(params, grads, moments, strict=True)):
                at = touched if k == 0 else slice(None)
                m[at] += 0.1 * (g - m[at])
                s[at] += 0.01 * (g * g - s[at])
                p[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(s[at] / (1 - 0.99**t)) + 1e-6)
        n += len(ids)
    at = np.flatnonzero(moved[:-1])
    at = at[np.argsort(met[at])]
    return {"n": n, "at": met[at], "rows": own_net.table[at] - net.table[met[at]], "rest": [n * (p - q) for p, q in zip(_params(own_net)[1:], _params(net)[1:], strict=True)]}


def refined(net: Network, rows: DataFrame, prior: float) -> Network:
    """net after a round over all texts (columns text, y): each task learns from its own, and moves are averaged, a feature's over the tasks that met it.

    Tasks deal their moves by blocks of features, which are averaged by other tasks: one table of moves, however many tasks there are, reaches the driver.
    """
    sent = rows.sparkSession.sparkContext.broadcast(net)
    wide = len(net.table) // BLOCKS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = moves(sent.value, _pieces(batches), prior)
        cuts = np.searchsorted(own["at"], np.arange(BLOCKS + 1) * wide)
        out = [(-1, own["n"], b"", np.concatenate([x.ravel() for x in own["rest"]]).astype(float).tobytes())]
        out += [(k, 0, own["at"][a:b].astype(np.int32).tobytes(), own["rows"][a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        block, n, at, moved = map(list, zip(*out, strict=True))
        part = [TaskContext.get().partitionId()] * len(out)
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(moved, pa.binary())], ["block", "part", "n", "at", "moved"])

    def average(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])  # sums do not depend on which task came first
        n = sum(r["n"] for r in rows)
        if rows[0]["block"] < 0:
            at, moved = b"", (sum(np.frombuffer(r["moved"]) for r in rows) / max(1, n)).tobytes()
        else:
            first = rows[0]["block"] * wide
            total, by = np.zeros((wide, SIZE), np.float32), np.zeros(wide)
            for r in rows:
                place = np.frombuffer(r["at"], np.int32) - first
                total[place] += np.frombuffer(r["moved"], np.float32).reshape(-1, SIZE)
                by[place] += 1
            met = np.flatnonzero(by)
            at, moved = (met + first).astype(np.int32).tobytes(), (total[met] / by[met, None]).astype(np.float32).tobytes()
        return pa.table([pa.array([at], pa.binary()), pa.array([moved], pa.binary())], names=["at", "moved"])

    got = rows.mapInArrow(run, "block int, part int, n long, at binary, moved binary").groupBy("block").applyInArrow(average, "at binary, moved binary").collect()
    sent.destroy()
    net = copy.deepcopy(net)
    for r in got:
        if r["at"]:
            net.table[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["moved"], np.float32).reshape(-1, SIZE)
            continue
        rest, done = np.frombuffer(r["moved"]), 0
        for p in _params(net)[1:]:
            p += rest[done : done + p.size].reshape(p.shape).astype(p.dtype)
            done += p.size
    net.table[-1] = 0
    return net


def calibrated(net: Network, rows: DataFrame, prior: float) -> float:
    """The threshold from all texts (see thresholds)."""
    return thresholds(net, rows, prior, None)[0]


def thresholds(net: Network, rows: DataFrame, prior: float, languages: language_id.Model | None, few: int = 8) -> tuple[float, dict[str, float]]:
    """The threshold from all texts (columns text, y), and that of each language that is found in `few` texts of each label: logits, to a thousandth and 50 either way, are counted by label and language."""
    sent = rows.sparkSession.sparkContext.broadcast((net, languages))

    def run(t: pa.Table) -> pa.Table:
        net, languages = sent.value
        raw = t["text"].cast(pa.binary()).to_pylist()
        z = outputs(net, (words(x) for x in raw))
        found = language_id.predict([x.decode("utf-8", "surrogatepass") for x in raw], languages)[0] if languages is not None else [None] * len(raw)
        return pa.table([pa.array(found, pa.string()), t["y"], pa.array(np.round(np.clip(z, -50, 50) * 1000).astype(np.int32))], names=["lang", "y", "z"])

    found = scan(rows, ["text", "y"], run, "lang string, y int, z int", size=2 << 20).groupBy("lang", "y", "z").count().collect()
    sent.destroy()
    z, y, n = (np.array(x, float) for x in zip(*[(r["z"] / 1000, r["y"], r["count"]) for r in found], strict=True))
    lang, by_language = np.array([r["lang"] or "" for r in found]), {}
    for name in languages.langs if languages is not None else ():
        own = lang == name
        if min(n[own & (y == 0)].sum(), n[own & (y == 1)].sum()) >= few:
            by_language[name] = threshold(z[own], y[own], prior, n[own])
    return threshold(z, y, prior, n), by_language


def learnt(rows: DataFrame, prior: float, per_label: int, budget: int, seed: int) -> Model | None:
    """The model of all labelled rows (see labelled); None where one fit takes them all.

    A fit of a bounded sample is where training begins; languages are learnt from its texts.  Then the features are counted, the network trained and the thresholds, of
    all texts and of each language, set over all texts, where these are.
    """
    n = {(r["y"], r["held"]): (r["n"], r["b"]) for r in rows.groupBy("y", "held").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).collect()}
    every = [sum((n.get((y, h), (0, 0))[k]) for h in (False, True)) for k in (0, 1) for y in (0, 1)]
    if min(every[:2]) < 2 or (max(every[:2]) <= per_label and max(every[2:]) <= budget):
        return None
    whole = len(n) < 4  # too few to part them
    mine = lambda held: rows if whole else rows.filter("held" if held else "not held")
    texts = lambda df: df.select(F.col("t").alias("text"), "y")
    first = sample(mine(False).select("i", "t", "lang"), mine(False).select("i", "y"), per_label, budget, seed)
    net = fit((words(r[0]) for r in first), np.array([r[1] for r in first], float))
    total = sum(every[:2])
    net = widened(net, counted(texts(mine(False))), 4)
    dealt = mine(False).repartition(max(1, total // SHARE), "i").sortWithinPartitions("d", "i")
    share = min(0.99, max(0.01, every[1] / total))
    for _ in range(ROUNDS):
        net = refined(net, texts(dealt), share)
    spoken = [(r[0].decode("utf-8", "surrogatepass"), r[2]) for r in first if r[2] is not None]
    languages = language_id.train([t for t, _ in spoken], [lang for _, lang in spoken]) if len({lang for _, lang in spoken}) > 1 else None
    over, by_language = thresholds(net, texts(mine(True)), prior, languages)
    return Model(net, prior, over, by_language, languages)


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """The logistic function of each text's logit over the threshold of the language it seems to be in; texts without a word have the prior."""
    out = np.full(len(texts), model.prior)
    cut = [list(words(t)) if len(t) <= PIECE else None for t in texts]
    live = [k for k, c in enumerate(cut) if c or (c is None and next(words(texts[k]), None) is not None)]
    if model.net is None or not live:
        return out
    z = outputs(model.net, (words(texts[k]) if cut[k] is None else cut[k] for k in live))
    over = np.full(len(live), model.threshold)
    if model.by_language:
        langs, _ = language_id.predict([texts[k].decode("utf-8", "surrogatepass") for k in live], model.languages)
        over = np.array([model.by_language.get(x, model.threshold) for x in langs])
    out[live] = 1 / (1 + np.exp(np.clip(over - z, -50, 50)))
    return out


def sample(docs: DataFrame, marks: DataFrame, per_label: int, budget: int, seed: int) -> list[tuple[bytes, int, str | None]]:
    """At most per_label distinct texts of each label with their languages, in seeded hash order of their ids, of `budget` bytes a label at most (but one text at least).

    docs: i, t, lang; marks: i, y.  An id counts once, with its smallest label and its smallest text; null ids, labels and texts are left out.
    Where the budget does not hold the next text the label's sample ends, whatever is short.
    """
    rows = written(marks.filter("i is not null").groupBy("i").agg(F.min("y").alias("y")).withColumn("d", F.xxhash64("i", F.lit(seed))))
    label = {r["i"]: r["y"] for y in (0, 1) for r in rows.filter(F.col("y") == y).orderBy("d", "i").limit(per_label).collect()}
    if not label:
        return []
    wanted = lambda ids: F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], rows.select("i").schema))
    live = docs.filter("t is not null")
    size = {r["i"]: r["n"] for r in live.join(wanted(label), "i").groupBy("i").agg(F.max(F.octet_length("t")).alias("n")).collect()}
    taken, held, full = [], [0, 0], [False, False]
    for i, y in label.items():
        if i in size and not full[y]:
            full[y] = held[y] > 0 and held[y] + size[i] > budget
            if not full[y]:
                held[y] += size[i]
                taken.append(i)
    if not taken:
        return []
    text = {r["i"]: r["x"] for r in live.join(wanted(taken), "i").groupBy("i").agg(F.min(F.struct("t", "lang")).alias("x")).collect()}
    once = {(text[i]["t"], label[i]): text[i]["lang"] for i in reversed(taken)}
    return [(t.encode("utf-8", "surrogatepass"), y, lang) for (t, y), lang in reversed(once.items())]


def score_all(docs: DataFrame, marks: DataFrame, learn_from, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 1000, budget: int = 64 << 20, seed: int = 11) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs; 0.5 is the threshold.

    marks: id_col and a 0/1 label; learn_from: condition on rows of marks that may be learnt from.  All labelled texts are learnt from: three quarters train the
    network, the rest set the threshold.  Where no label has more than per_label texts and `budget` bytes they are collected for one fit, with a threshold for each language that
    holds enough of them, and one for all others; languages are then learnt from lang_col of the same texts and read off each text, so that a score depends on the
    text alone.  More texts are learnt from where they are (see learnt).  Texts are scored whole, whatever their length; equal texts have equal scores.  Null and empty texts and such without a word get the share
    of label 1, as do all texts if a label has fewer than two rows (0.01 without labels).  Repeated rows get a row each, null ids too; an
    empty table gives no rows.
    """
    known = marks.filter(learn_from & F.col(label).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y"))
    got = known.agg(F.avg("y").alias("p")).collect()[0]["p"]
    prior = min(0.99, max(0.01, float(got or 0.0)))
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    marked = labelled(own, known, seed)
    found = learnt(marked, prior, per_label, budget, seed) or train(sample(own, known, per_label, budget, seed), prior)
    dropped(marked)
    model = docs.sparkSession.sparkContext.broadcast(found)

    def run(t: pa.Table) -> pa.Table:
        texts = [x or b"" for x in t["text"].cast(pa.binary()).to_pylist()]
        return pa.table([t["id"], pa.array(scores(texts, model.value), pa.float64())], names=["doc_id", "score"])

    return scan(docs, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], run, "doc_id long, score double", size=2 << 20)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket("doc_id", 5) != 0)
    return out.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
