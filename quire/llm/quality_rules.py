"""Quality rules: cutoffs chosen on labelled holdouts under exact binomial bounds on false rejection per stratum.

In each stratum a quarter of the labelled texts orders the rules: a path of ever stricter sets of cutoffs, greedily by bad texts gained for
good ones lost.  The others are the holdout: the sets of the path are tested from the first on, each as a whole, and the walk ends at the
first whose exact upper bound on the share of good texts rejected exceeds the rate (fixed-sequence testing).  So neither the number of rules
nor that of cutoffs costs any of the rate or of the confidence; only the strata share the latter (Bonferroni).
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scan, table, written

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

#: Each rule rejects what lies above its cutoff.  Grids are fixed before any label is seen.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
}
_SHARES = tuple(round(0.02 * 1.1**k, 6) for k in range(40))
GRIDS = {name: tuple(round(4 + 0.5 * k, 2) for k in range(40)) if name == "long_words" else _SHARES for name in RULES}


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words that lie in a window of WINDOW words found twice or more.  Exact: equal keys mean equal windows."""
    n = len(ids) - WINDOW + 1
    if n < 2 or n_distinct == len(ids):
        return 0
    key, bits = ids.astype(np.int64), max(1, int(n_distinct - 1).bit_length())
    if bits * WINDOW <= 62:
        out = key[:n].copy()
        for k in range(1, WINDOW):
            out = (out << bits) | key[k : n + k]
    else:  # rank pairs, then fours, then fives: the keys stay below n squared
        width = len(ids) + 1
        two = np.unique(key[:-1] * width + key[1:], return_inverse=True)[1]
        four = np.unique(two[:-2].astype(np.int64) * width + two[2:], return_inverse=True)[1]
        out = four[:n].astype(np.int64) * width + key[4 : n + 4]
    order = np.argsort(out, kind="stable")
    same = out[order][1:] == out[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly x20 and x09-x0D
    if not words:
        return (0,) * 8
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    joined = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((joined & 0xC0) != 0x80).sum())
    counts = np.bincount(joined, minlength=256)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), chars, int(sum(counts[c] for c in SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids, len(seen)), len(lines), int(counts[65:91].sum()), int(counts[33] + counts[63] + counts[124]))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def _stratum(column: str | None):
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit("")


_COLUMNS = ", ".join(f"{c} long" for c in COUNTS)


def _measured(t: pa.Table, keep: list[str]) -> pa.Table:
    cols = [pa.array(c, pa.int64()) for c in zip(*[measure(x) for x in t["text"].to_pylist()], strict=True)]
    return pa.table([*(t[k] for k in keep), *cols], names=[*keep, *COUNTS])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """doc_id, stratum, a hash of the text and COUNTS per row.  Null stratum: the empty string."""
    columns = [F.col(id_col).cast("long").alias("doc_id"), _stratum(stratum_col).alias("stratum"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")]
    return scan(docs, columns, lambda t: _measured(t, ["doc_id", "stratum", "text_hash"]), f"doc_id long, stratum string, text_hash long, {_COLUMNS}")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def bounded(k: int, n: int, rate: float, level: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound at confidence 1 - level for k of n lies at or below rate."""
    return n > 0 and k <= n * rate and binomial_cdf(k, n, rate) <= level


def least_good(rate: float, level: float) -> int:
    """Good texts that a holdout needs before any cutoff can pass: with none of n rejected, (1 - rate)^n must not exceed level."""
    return math.ceil(math.log(level) / math.log1p(-rate))


def path(values: np.ndarray, good: np.ndarray, steps: int = 24) -> list[tuple[float, ...]]:
    """Ever stricter sets of cutoffs, one for each rule, inf where a rule is not used.

    values: a row for each text, a column for each rule.  Each step lowers one cutoff to a value of its grid: the one with most bad texts gained for good ones
    lost (plus a half), at ties the one that gains more, then the rule that is first, then the higher cutoff.  Ends when no bad text is gained.
    """
    names = list(RULES)
    cut, lost = [math.inf] * len(names), np.zeros(len(values), bool)
    out = []
    while len(out) < steps:
        best, take = (0.0, 0, 0, 0.0), None
        for r, name in enumerate(names):
            for c in GRIDS[name]:
                if c < cut[r]:
                    new = ~lost & (values[:, r] > c)
                    gained = int((new & ~good).sum())
                    if (key := (gained / (int((new & good).sum()) + 0.5), gained, -r, c)) > best and gained:
                        best, take = key, (r, c)
        if take is None:
            break
        cut[take[0]] = take[1]
        lost |= values[:, take[0]] > take[1]
        out.append(tuple(cut))
    return out


def _bin(value, grid: tuple[float, ...]):
    """How many cutoffs of a grid lie below a value: it is above the one at place k if there are more than k."""
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: value > c))


def paths_of(tuned: DataFrame, strata: list[str], steps: int = 24) -> dict[str, list[tuple[float, ...]]]:
    """The path of each of these strata, of all texts of tuned (stratum, good, v_symbols ...), as path() gives it.

    A job for each step counts the texts not yet lost by stratum, rule, place between the cutoffs of its grid, and label: only these counts reach the driver.
    """
    grids = [GRIDS[name] for name in RULES]
    held = [f"b_{r}" for r in range(len(grids))]
    binned = tuned.filter(F.col("stratum").isin(strata)).select("stratum", "good", *[_bin(F.col(f"v_{name}"), g).alias(h) for name, g, h in zip(RULES, grids, held, strict=True)])
    binned = written(binned.groupBy("stratum", "good", *held).agg(F.count("*").alias("n")))
    cut = {key: [len(g) for g in grids] for key in strata}
    out: dict[str, list[tuple[float, ...]]] = {key: [] for key in strata}
    walking = list(strata)
    for _ in range(steps):
        kept = functools.reduce(lambda c, key: F.when(F.col("stratum") == key, functools.reduce(lambda a, b: a & b, [F.col(h) <= k for h, k in zip(held, cut[key], strict=True)])).otherwise(c), walking, F.lit(False))
        counts = {key: np.zeros((len(grids), max(map(len, grids)) + 1, 2), np.int64) for key in walking}
        for x in binned.filter(kept).select("stratum", "good", "n", F.posexplode(F.array(*held)).alias("rule", "bin")).groupBy("stratum", "rule", "bin", "good").agg(F.sum("n").alias("n")).collect():
            counts[x["stratum"]][x["rule"], x["bin"], int(x["good"])] = x["n"]
        still = []
        for key in walking:
            above = counts[key][:, ::-1].cumsum(1)[:, ::-1]  # texts in this place or a later one
            best, take = (0.0, 0, 0, 0.0), None
            for r, g in enumerate(grids):
                for k in range(cut[key][r]):
                    bad, good = (int(x) for x in above[r, k + 1])
                    if (rank := (bad / (good + 0.5), bad, -r, g[k])) > best and bad:
                        best, take = rank, (r, k)
            if take is not None:
                cut[key][take[0]] = take[1]
                out[key].append(tuple(g[k] if k < len(g) else math.inf for g, k in zip(grids, cut[key], strict=True)))
                still.append(key)
        if not (walking := still):
            break
    return out


def chosen(rejected: list[tuple[int, int]], n: int, rate: float, level: float) -> int:
    """How many steps of a path to take, given (good, bad) texts of the holdout that each rejects, of n good ones: of the steps that pass, the one with
    most bad less good texts rejected, the first at ties; 0 if none passes or gains."""
    best, take = 0, 0
    for k, (g, b) in enumerate(rejected):
        if not bounded(g, n, rate, level):
            break
        if b - g > best:
            best, take = b - g, k + 1
    return take


@dataclass(frozen=True)
class Cutoffs:
    """stratum -> cutoffs, one for each of RULES, inf where a rule is not used; a missing stratum never rejects."""

    at: dict[str, tuple[float, ...]]
    strata: int


#: One text of so many orders the rules.
TUNED = 4


def calibrate(labelled: DataFrame, rate: float = 0.03, delta: float = 0.05, seed: int = 13) -> Cutoffs:
    """The cutoffs of each stratum that provably reject few good documents.

    labelled: features and a boolean `good`; each distinct text that passes the base rules counts once.  With probability 1 - delta, in every
    stratum the rules reject at most `rate` of such good documents.  Strata whose holdout has fewer good texts than least_good(rate, delta / strata)
    cannot pass and get no cutoffs; they still share delta.  The path of a stratum is made from all its texts that are no
    holdout; of these and of the holdout only counts reach the driver.  No labels or no stratum large enough: no cutoffs.
    """
    once = labelled.groupBy("stratum", "text_hash").agg(F.max("good").alias("good"), *[F.first(c).alias(c) for c in COUNTS]).filter(~_failed())
    fold = F.pmod(F.xxhash64("text_hash", F.lit(seed)), F.lit(TUNED))
    once = written(once.select("stratum", "good", (fold == 0).alias("tuned"), *[F.expr(r).alias(f"v_{k}") for k, r in RULES.items()]))
    counts = once.groupBy("stratum").agg(F.count_if(F.col("good") & ~F.col("tuned")).alias("n"), F.count_if("tuned").alias("m"), F.lit(1).alias("one"))
    strata = counts.count()
    level = delta / max(1, strata)
    rows = counts.filter(F.col("n") >= least_good(rate, level)).collect()  # strata with labels enough for a test
    if not rows:
        return Cutoffs({}, strata)
    n = {r["stratum"]: r["n"] for r in rows}
    of = lambda values, none: functools.reduce(lambda out, x: F.when(F.col("stratum") == x[0], x[1]).otherwise(out), values, none)
    paths = {key: sets for key, sets in paths_of(once.filter("tuned"), list(n)).items() if sets}
    if not paths:
        return Cutoffs({}, strata)
    over = lambda cut: functools.reduce(lambda a, b: a | b, [F.col(f"v_{r}") > c for r, c in zip(RULES, cut, strict=True) if c < math.inf])
    hit = of([(key, F.array(*[over(cut) for cut in sets])) for key, sets in paths.items()], F.array().cast("array<boolean>"))
    hits = once.filter("not tuned").select("stratum", "good", F.posexplode(hit).alias("step", "hit")).filter("hit")
    counted = hits.groupBy("stratum", "step").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).collect()  # at most 24 rows a stratum
    found = {(r["stratum"], r["step"]): (r["g"], r["b"]) for r in counted}
    at = {}
    for key, sets in paths.items():
        if take := chosen([found.get((key, k), (0, 0)) for k in range(len(sets))], n[key], rate, level):
            at[key] = sets[take - 1]
    return Cutoffs(at, strata)


def _failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(measured: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Adds base_failed and kept.  A row of a stratum without cutoffs is judged by the base rules only."""
    reject = F.lit(False)
    for stratum, cut in sorted(cutoffs.at.items()):
        hits = [F.expr(rule) > c for rule, c in zip(RULES.values(), cut, strict=True) if c < math.inf]
        reject = F.when(F.col("stratum") == stratum, functools.reduce(lambda a, b: a | b, hits)).otherwise(reject)
    return measured.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & ~reject)


def learn(measured: DataFrame, labels: DataFrame | None, good: str = "quality = 1", rate: float = 0.03, delta: float = 0.05) -> Cutoffs:
    """Cutoffs from the rows of measured that labels names; none without labels.

    labels: doc_id and the columns that `good` reads.  Labels of unknown documents are ignored; of repeated labels the good one counts.
    """
    if labels is None:
        return Cutoffs({}, 0)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.expr(good), F.lit(False))).alias("good"))
    return calibrate(measured.join(marks, "doc_id"), rate, delta)


def rule_table(docs: DataFrame, labels: DataFrame | None, **options) -> DataFrame:
    """Features and verdict of every row of docs.  Null, empty and blank texts have no words, so base_failed; an empty table gives no rows.

    Rows that repeat id and text get the same verdict each; null ids are judged too.  Texts are measured whole.  A value equal to its cutoff is kept.
    """
    measured = written(features(docs))
    return judge(measured, learn(measured, labels, **options))


def filter_docs(docs: DataFrame, labels: DataFrame | None, text_col: str = "text", stratum_col: str | None = "lang", **options) -> DataFrame:
    """The rows of docs that the rules keep, as they are.  Texts are read twice and never exchanged."""
    cutoffs = learn(written(features(docs, text_col=text_col, stratum_col=stratum_col)), labels, **options)
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(text_col).alias("text"), _stratum(stratum_col).alias("stratum"))
    kind = rows.select("_row", "text").schema.simpleString()[len("struct<") : -1]
    measured = scan(rows, ["_row", "text", "stratum"], lambda t: _measured(t, ["_row", "text", "stratum"]), f"{kind}, stratum string, {_COLUMNS}")
    kept = judge(measured, cutoffs).filter("kept")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *COUNTS[:5], "base_failed", "kept")


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}
