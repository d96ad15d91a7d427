"""Language ID: blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, distinct, scan, table, written

UNKNOWN = "und"
#: Grams of one to three characters are hashed into 2^BITS places.
BITS = 21
SPACE = 1 << BITS
STEP = 256
#: Odd factors of the characters of a gram, by its length and their place.
FACTORS = np.random.default_rng(71).integers(1, 1 << 63, (3, 3), dtype=np.uint64) | np.uint64(1)


@dataclass
class Model:
    langs: list[str]
    column: np.ndarray  # gram -> column of landmarks, -1 for grams of no landmark
    landmarks: np.ndarray  # presence, columns by landmarks
    sizes: np.ndarray  # grams of each landmark
    weights: np.ndarray  # landmarks by languages: K(landmarks)^-1/2 times the ridge solution
    bias: np.ndarray

    @cached_property
    def by_gram(self) -> np.ndarray:
        """What each known gram adds to the outputs, but for the root of the text's number of grams: the kernel is linear in the grams of a text."""
        return (self.landmarks.astype(float) / np.sqrt(self.sizes)) @ self.weights

    def outputs(self, grams_: np.ndarray) -> np.ndarray:
        c = self.column[grams_]
        return self.by_gram[c[c >= 0]].sum(0) / np.sqrt(max(1, len(grams_))) + self.bias


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


@lru_cache(1)
def _fold() -> np.ndarray:
    """Letters of any script stand for themselves, white space for 2 and all else for 1."""
    out = np.ones(0x110000, np.uint64)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c
        elif chr(c).isspace():
            out[c] = 2
    return out


@lru_cache(1)
def _marks() -> np.ndarray:
    return np.zeros(SPACE, np.int64)


def grams(text: str) -> np.ndarray:
    """Distinct places of the grams of one to three characters of a whole text, with white space before and after it."""
    x = np.concatenate(([np.uint64(2)], _fold()[codes(text)], [np.uint64(2)]))
    places = []
    for k in (1, 2, 3):
        h = x[: len(x) - k + 1] * FACTORS[k - 1, 0]
        for j in range(1, k):
            h = (h ^ (h >> np.uint64(29))) * FACTORS[k - 1, j] + x[j : len(x) - k + 1 + j] * FACTORS[0, j]
        places.append(((h ^ (h >> np.uint64(31))) * FACTORS[0, 0] >> np.uint64(64 - BITS)).astype(np.int64))
    if len(x) > 200_000:
        seen = np.zeros(SPACE, bool)
        for p in places:
            seen[p] = True
        return np.flatnonzero(seen)
    return np.sort(distinct(np.concatenate(places), _marks()))


def train(texts: list[str], langs: list[str], landmarks: int = 160, ridge: float = 1e-2, seed: int = 5) -> Model:
    """Landmarks are drawn evenly from the languages; all texts fit the ridge regression."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    sets = [grams(t) for t in texts]
    chosen: list[int] = []
    for name in names:
        own = [i for i, x in enumerate(langs) if x == name]
        chosen += [int(i) for i in rng.permutation(own)[: max(1, landmarks // len(names))]]
    used = np.unique(np.concatenate([sets[i] for i in chosen]))
    column = np.full(SPACE, -1, np.int32)
    column[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        marks[column[sets[i]], k] = 1
    model = Model(names, column, marks, np.array([len(sets[i]) for i in chosen], float), np.zeros((len(chosen), len(names))), np.zeros(len(names)))
    inner = kernel([sets[i] for i in chosen], model)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = kernel(sets, model) @ root
    target = np.array([[1.0 if x == name else -1.0 for name in names] for x in langs])
    weight = np.array([1 / langs.count(x) for x in langs])
    weight *= len(langs) / weight.sum()
    bias = (weight[:, None] * target).sum(0) / weight.sum()
    a = phi.T @ (weight[:, None] * phi) + ridge * len(texts) * np.eye(phi.shape[1]) / phi.shape[1]
    model.weights = root @ np.linalg.solve(a, phi.T @ (weight[:, None] * (target - bias)))
    model.bias = bias
    return model


def kernel(sets: list[np.ndarray], model: Model) -> np.ndarray:
    """|x & z| / sqrt(|x| |z|) of each set and each landmark: one matrix product of presence rows for the batch."""
    rows = np.zeros((len(sets), model.landmarks.shape[0]), np.float32)
    for i, s in enumerate(sets):
        c = model.column[s]
        rows[i, c[c >= 0]] = 1
    norm = np.sqrt(np.array([max(1, len(s)) for s in sets], float)[:, None] * model.sizes[None, :])
    return (rows @ model.landmarks).astype(float) / norm


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and score (softmax of the scaled regression outputs); UNKNOWN and 0 for a text without a letter or without a model."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    live = [i for i, t in enumerate(texts) if t and has_letter(t)]
    for a in range(0, len(live), STEP):
        part = live[a : a + STEP]
        out = np.stack([model.outputs(grams(texts[i])) for i in part])
        p = np.exp(3 * (out - out.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        for i, k, q in zip(part, out.argmax(1), p, strict=True):
            langs[i], scores[i] = model.langs[k], float(q[k])
    return langs, scores


def sample(labels: DataFrame, docs: DataFrame, per_label: int, seed: int, longest: int = 1 << 20) -> list[tuple[str, str]]:
    """At most per_label distinct texts of each label, as (text, label): the bounded sample on which a model is fitted.

    labels: columns i (id) and y (label); docs: i and t (text).  Each id counts once, with its smallest label; counts by label give each
    label a share; ids are kept by a seeded hash under that share, with twice the margin, and the smallest hashes win.  Texts are then
    fetched by a broadcast of those ids, at most 2 * per_label for each label, one text an id (the smallest); texts of more than `longest`
    characters are not drawn.  Rows with null text or label are left out.
    """
    rows = labels.filter(F.col("y").isNotNull() & F.col("i").isNotNull()).groupBy("i").agg(F.min(F.col("y").cast("string")).alias("y"))
    rows = written(rows.withColumn("d", F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 30))))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(int(min(1.0, 3 * per_label / n) * (1 << 30)))).otherwise(share)
    ids = rows.filter(F.col("d") < share).collect()
    label, taken = {}, dict.fromkeys(counts, 0)
    for r in sorted(ids, key=lambda r: (r["d"], r["i"])):
        if taken[r["y"]] < 2 * per_label:
            label[r["i"]] = r["y"]
            taken[r["y"]] += 1
    if not label:
        return []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in label], rows.select("i").schema)
    fetched = docs.select("i", "t").filter(F.length("t") <= longest).join(F.broadcast(wanted), "i").groupBy("i").agg(F.min("t").alias("t"))
    text = {r["i"]: r["t"] for r in fetched.collect()}
    out, seen, taken = [], set(), dict.fromkeys(counts, 0)
    for i, y in label.items():
        if i in text and text[i] not in seen and taken[y] < per_label:
            seen.add(text[i])
            taken[y] += 1
            out.append((text[i], y))
    return out


def identify(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, seed: int = 7) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs.

    learn_from: a condition for rows whose lang_col may be learnt from; at most per_language of each language are
    collected.  Null text, text without a letter, or nothing to learn from: UNKNOWN with score 0.  Ties go to the language first in order.
    Texts are read whole, whatever their length; repeated rows get a row each, null ids too; an empty table gives no rows.
    """
    known = docs.filter(learn_from).select(F.col(id_col).alias("i"), F.col(lang_col).alias("y"))
    rows = sample(known, docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), per_language, seed)
    model = docs.sparkSession.sparkContext.broadcast(train([t for t, _ in rows], [y for _, y in rows]) if rows else None)

    def run(t: pa.Table) -> pa.Table:
        langs, scores = predict(t["text"].to_pylist(), model.value)
        return pa.table([t["id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return scan(docs, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"), bucket("doc_id", 4) != 2)
    return out.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
