"""Each stage against brute force on the rows that its predecessor kept."""

import os
import tempfile
from collections import Counter

import corpus_pipeline
from test_jaccard import brute
from test_text_operators import BPE, _check_packing, _dedup_lines, _measure, _spans

from quire.llm import substring_dedup

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "substrings", "sequences"] and BPE
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = os.path.join(tempfile.mkdtemp(), name)
        stage(spark, docs, SMALL).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = rows = docs.collect()
        if name != "sequences":
            assert docs.columns == columns
            after = Counter((r["doc_id"], r["text"]) for r in rows)
        if name == "quality":
            base = {i for i, t in before if (m := _measure(t))[0] < 10 or 100 * m[4] > 20 * m[0]}
            assert after <= Counter(before) and not base & {i for i, _ in after} and len(rows) > 0.7 * len(before)
        elif name == "lines":
            assert after == Counter(zip([i for i, _ in before], _dedup_lines(before), strict=True))
        elif name == "near_duplicates":
            assert after == Counter(b for b in before if any(i == b[0] == c for i, _, c in brute(before)))
        elif name == "substrings":
            spans = _spans(before)
            assert after == Counter((i, substring_dedup.cut_out(t, [{"a": a, "b": b} for a, b in spans.get((i, t), [])])) for i, t in before)
        else:
            _check_packing(rows, [{"doc_id": i, "text": t} for i, t in before])
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, corpus_pipeline.run(spark, SMALL).collect())) == Counter(map(key, kept["sequences"]))


def test_odd_input(spark, odd_docs, no_docs, tmp_path):
    """Null, empty, blank, very long, repeated and clashing rows through all stages, each on what the one before kept; and an empty table."""
    docs, columns = odd_docs, odd_docs.columns
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, str(tmp_path / "sf")).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = kept[name] = docs.collect()
        if name != "sequences":
            assert docs.columns == columns and all(r["_row"] == r["_id"] == r["h"] == "x" for r in rows)
    ids = Counter(r["doc_id"] for r in kept["quality"])
    assert ids == Counter({1: 2, 5: 1, 6: 1, 7: 1, None: 1, 10: 2, 11: 0, 14: 1}) - Counter({11: 1})
    assert Counter(r["doc_id"] for r in kept["near_duplicates"]) == ids - Counter({14: 1})
    _check_packing(kept["sequences"], [{"doc_id": i, "text": t} for i, t in before])
    for name in ("documents", "labels"):
        (no_docs if name == "documents" else spark.read.parquet(f"{SMALL}/labels.parquet").limit(0)).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
