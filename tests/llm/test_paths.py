"""Paths of cutoffs from counts over all texts."""

import numpy as np

from quire.llm import quality_rules as Q


def test_paths_read_every_text(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for stratum, n in (("a", 5000), ("b", 300)):  # more than were read before
        good = rng.random(n) < 0.7
        v = np.abs(rng.normal(0, 0.2, (n, len(Q.RULES)))) + np.where(good[:, None], 0, rng.random((n, len(Q.RULES))) * 0.6)
        v[:, 2] = 4 + 10 * v[:, 2]
        want[stratum] = Q.path(v, good, 5)
        rows += [(stratum, bool(g), *map(float, x)) for g, x in zip(good, v, strict=True)]
    df = spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"v_{k} double" for k in Q.RULES))
    got = Q.paths_of(df, ["a", "b"], 5)
    assert got == want and all(len(x) == 5 for x in want.values())
