"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache
from itertools import batched, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scan, table

END_ID = 1
#: Words are split here below this code point, where Unicode's letters, numbers and spaces are settled; texts beyond go to tokenizers whole.
PLAIN_BELOW = 0x250
#: Different words kept with their ids, about.
KEPT = 1 << 20
#: Words that are encoded in one line.
LINE = 500
#: Words of a text handled at once.
MANY = 1 << 17


@lru_cache(2)
def encoder(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if unicodedata.category(chr(c))[0] in kinds)


_SPACES = r"\t-\r \x85\xa0"
#: The words that byte-level BPE never merges across: contractions, letters, numbers, marks, white space.
_word = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_class('L')}]+| ?[{_class('N')}]+| ?[^{_SPACES}{_class('LN')}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_far = re.compile(f"[^\\x00-{chr(PLAIN_BELOW - 1)}]")


class Words:
    """Ids of words as tokenizers gives them, each different word encoded once; the ids of kept words lie one after another in a pool."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.spells = np.array([len(self.encoder.id_to_token(i) or "") for i in range(self.encoder.get_vocab_size())])  # a character of a byte-level piece is a byte
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.start, self.count = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has, from tokenizers.

        A blank and letters begin a word after anything but white space, so such words are encoded in lines of LINE words; where the ids
        of each end is told by the bytes that they spell.
        """
        plain = np.fromiter((w[0] == " " and w[1:].isalpha() for w in words), bool, len(words))
        spaced = [w for w, ok in zip(words, plain.tolist(), strict=True) if ok]
        others = [w for w, ok in zip(words, plain.tolist(), strict=True) if not ok]
        lines = ["".join(spaced[a : a + LINE]) for a in range(0, len(spaced), LINE)]
        ids = [e.ids for e in self.encoder.encode_batch_fast(lines + others, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids[: len(lines)]), "<u4", sum(map(len, ids[: len(lines)])))
        rest = np.fromiter(chain.from_iterable(ids[len(lines) :]), "<u4", sum(map(len, ids[len(lines) :])))
        spelled = np.cumsum(self.spells[flat])
        ends = np.searchsorted(spelled, np.cumsum(np.fromiter((len(w.encode()) for w in spaced), np.int64, len(spaced)))) + 1
        size = np.zeros(len(words), np.int64)
        size[plain], size[~plain] = np.diff(ends, prepend=0), np.fromiter(map(len, ids[len(lines) :]), np.int64, len(others))
        out, at = np.zeros(int(size.sum()), "<u4"), np.repeat(plain, size)
        out[at], out[~at] = flat, rest
        return out, size

    def _learn(self, words: list[str]) -> None:
        ids, size = self._encoded(words)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(size) - size))
        self.count = np.concatenate((self.count, size))
        self.pool = np.concatenate((self.pool, ids))

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        if len(self.number) > KEPT or len(self.pool) > 8 * KEPT:
            self.forget()
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            missed = [words[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(missed)))
            at[new] = [self.number[w] for w in missed]
        size = self.count[at]
        total = np.cumsum(size)
        return self.pool[np.repeat(self.start[at] - total + size, size) + np.arange(total[-1] if len(total) else 0)], size


@lru_cache(2)
def words_of(path: str) -> Words:
    return Words(path)


def encode(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts as tokenizers gives them without special tokens, then END_ID.  Null: END_ID only.

    Byte-level BPE works word by word, so each different word goes through tokenizers once.  Texts with characters from PLAIN_BELOW on, or with the
    name of a special token, go through it whole.  Runs of any length are single words; long texts are taken MANY words at a time.
    """
    known = words_of(path)
    out = [np.zeros(0, "<u4")] * len(texts)
    end = np.array([END_ID], "<u4")
    some: list[tuple[int, list[str]]] = []
    whole, held = [], 0

    def flush() -> None:
        nonlocal held
        if some:
            ids, size = known.ids([w for _, ws in some for w in ws])
            ends = np.cumsum(size)
            a = 0
            for i, ws in some:
                a += len(ws)
                stop = int(ends[a - 1]) if a else 0
                start = int(ends[a - len(ws) - 1]) if a > len(ws) else 0
                out[i] = ids[start:stop]
            some.clear()
            held = 0

    for i, t in enumerate(texts):
        if not t:
            continue
        if (not t.isascii() and _far.search(t)) or any(x in t for x in known.special):
            whole.append(i)
        elif len(t) > MANY:
            words = (m.group() for m in _word.finditer(t))
            out[i] = np.concatenate([known.ids(list(part))[0] for part in batched(words, MANY)])
        else:
            some.append((i, _word.findall(t)))
            held += len(some[-1][1])
            if held > MANY:
                flush()
    flush()
    for i in whole:
        out[i] = np.array(known.encoder.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids, "<u4")
    return [np.append(x, end) for x in out]


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item.  Items are taken by falling size, ties in the given order; each goes to the first bin with room.

    Leaves of the tree hold what is left in each bin and inner nodes the larger of their children, so that the first
    bin with room is found by one walk from the root.  Items of full size take bins of their own after the others.
    """
    small = sorted((i for i, s in enumerate(sizes) if s < capacity), key=lambda i: -sizes[i])
    out = [0] * len(sizes)
    leaves = 1 << max(0, (len(small) - 1).bit_length())
    tree, used = [capacity] * (2 * leaves), 0
    for i in small:
        s, k = sizes[i], 1
        while k < leaves:
            k *= 2
            if tree[k] < s:
                k += 1
        out[i] = k - leaves
        used = max(used, k - leaves + 1)
        tree[k] -= s
        while k > 1:
            k >>= 1
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
    for i, s in enumerate(sizes):
        if s >= capacity:
            out[i], used = used, used + 1
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048, group_docs: int = 4096, seed: int = 11) -> DataFrame:
    """Pieces of documents laid into sequences of at most budget tokens.

    A document is cut into pieces of budget tokens and a rest.  Documents are dealt into groups of about group_docs by
    a seeded hash of the id and of its place among equal ids in the batch, so that no key makes a large group; each
    group is packed on its own.  Null text: the end id alone.  Empty table: no rows.  Null ids are kept as null.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; sequence_id is group * 2^32 + bin.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def cut(t: pa.Table) -> pa.Table:
        ids = t["id"].to_pylist()
        cols: list[list] = [[] for _ in range(6)]
        again: Counter = Counter()
        for doc, x, h in zip(ids, encode(t["text"].to_pylist(), tokenizer), t["h"].to_pylist(), strict=True):
            again[doc] += 1
            grp = (h if again[doc] == 1 else hash((h, again[doc]))) % groups
            for a in range(0, len(x), budget):
                piece = x[a : a + budget]
                for c, v in zip(cols, (grp, doc, a, len(piece), zlib.crc32(piece.tobytes()), len(x)), strict=True):
                    c.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["grp", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    def lay(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        sizes = t["length"].to_pylist()
        bins = first_fit_decreasing(sizes, budget)
        filled: Counter = Counter()
        offset = []
        for b, s in zip(bins, sizes, strict=True):
            offset.append(filled[b])
            filled[b] += s
        base = t["grp"][0].as_py() << 32
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    pieces = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    cuts = scan(docs, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h")], cut, f"grp long, {pieces}")
    return cuts.groupBy("grp").applyInArrow(lay, f"{pieces}, sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
