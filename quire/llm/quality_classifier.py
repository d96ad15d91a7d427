"""Quality classifier: zstandard dictionaries of good and bad text; the normalised difference of compressed sizes, calibrated."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, scan, table
from .language_id import sample

LEVEL = 5
SEGMENT = 1024


@dataclass
class Model:
    good: bytes
    bad: bytes
    knots: list[float]  # differences, rising
    values: list[float]  # share of good rows at each knot, rising
    prior: float


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A raw content dictionary of all texts in the order given: whole if they fit, else the same number of bytes of each (all of those that are shorter), as many as fit.

    A longer text's bytes are a run of it, at a place that its checksum picks.
    """
    lengths = np.sort([len(t) for t in texts])
    room = size - len(texts)  # a byte between any two
    share, left = 0, len(lengths)
    for n in lengths.tolist():  # shorter texts leave more to the others
        share = max(share, room // left)
        if n > share:
            break
        room, left = room - n, left - 1
        share = n
    else:
        share = int(lengths[-1]) if len(lengths) else 0
    at = lambda t: zlib.crc32(t) % (len(t) - share + 1) if len(t) > share else 0
    return b"\n".join(t[at(t) : at(t) + share] for t in texts)


class Sizer:
    """Compressed sizes of whole texts under both dictionaries.

    A text is compressed in segments of SEGMENT bytes, each on its own, so that a long text does not become its own
    dictionary; the difference is divided by the plain size, so that what either dictionary packs to nothing (one
    phrase over and over) counts as explained by neither.
    """

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for d in (good, bad):
            raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False))

    def difference(self, text: str | None) -> float | None:
        """(size under bad - size under good) / plain size, above 0 if good explains it better; None for an empty text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw.strip():
            return None
        parts = [raw[a : a + SEGMENT] for a in range(0, len(raw), SEGMENT)]
        good, bad = (sum(len(c.compress(x)) for x in parts) for c in self.by)
        return (bad - good) / len(raw)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators, equal x first; knots are block means."""
    places, of = np.unique(x, return_inverse=True)
    count = np.bincount(of, minlength=len(places))
    blocks: list[list[float]] = []
    for a, n, b in zip(places.tolist(), count.tolist(), (np.bincount(of, y, len(places)) / count).tolist(), strict=True):
        blocks.append([b, n, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, s = blocks.pop()
            w, m, r = blocks[-1]
            blocks[-1] = [(v * n + w * m) / (n + m), n + m, (s * n + r * m) / (n + m)]
    return [b[2] for b in blocks], [b[0] for b in blocks]


def train(rows: list[tuple[str, str]], prior: float, size: int = 1 << 20) -> Model | None:
    """Half of the rows of each label make the dictionaries, the other half the calibration, weighted to the prior."""
    by = {y: [t.encode("utf-8", "surrogatepass") for t, z in rows if z == y] for y in ("0", "1")}
    if min(map(len, by.values())) < 2:
        return Model(b"", b"", [], [], prior)
    model = Model(dictionary(by["1"][::2], size), dictionary(by["0"][::2], size), [], [], prior)
    sizer = Sizer(model.good, model.bad)
    x, y = [], []
    for label, target in (("0", 0.0), ("1", 1.0)):
        for t in by[label][1::2]:
            if (d := sizer.difference(t.decode("utf-8", "surrogatepass"))) is not None:
                x.append(d)
                y.append(target)
    xs, ys = np.array(x), np.array(y)
    if len(set(y)) < 2:
        return model
    # a balanced isotonic fit, smoothed, then moved to the prior of the labels
    knots, values = isotonic(xs, ys)
    share = ys.mean()
    shift = math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    smooth = [(v * len(x) + 0.5) / (len(x) + 1) for v in values]
    model.knots, model.values = knots, [1 / (1 + math.exp(-(math.log(v / (1 - v)) + shift))) for v in smooth]
    return model


def score_all(docs: DataFrame, marks: DataFrame, learn_from, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = 1500, seed: int = 3) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs.

    marks: id_col and a 0/1 label; learn_from: condition on rows of marks that may be learnt from; at most per_label
    rows of each label are collected, and half of them make a dictionary of at most 1 MB a label, texts of any length (see
    dictionary).  Empty, blank and null texts get the prior, the share of label 1; so do all texts if one label has
    fewer than two rows (0.5 without labels).  Equal texts have equal scores; texts are scored whole, whatever their length.  Repeated rows
    get a row each, null ids too; an empty table gives no rows.
    """
    known = marks.filter(learn_from & F.col(label).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label).alias("y"))
    got = known.agg(F.avg("y").alias("p")).collect()[0]["p"]
    prior = min(0.99, max(0.01, 0.5 if got is None else float(got)))
    model = docs.sparkSession.sparkContext.broadcast(train(sample(known, docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), per_label, seed), prior))

    def run(t: pa.Table) -> pa.Table:
        m = model.value
        out = []
        sizer = Sizer(m.good, m.bad) if m.knots else None
        for x in t["text"].to_pylist():
            d = sizer.difference(x) if sizer else None
            out.append(m.prior if d is None else float(np.interp(d, m.knots, m.values)))
        return pa.table([t["id"], pa.array(out, pa.float64())], names=["doc_id", "score"])

    return scan(docs, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], run, "doc_id long, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket("doc_id", 5) != 0)
    return out.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
