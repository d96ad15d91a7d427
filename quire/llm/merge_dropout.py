"""SentencePiece BPE with seeded merge-dropout: each candidate merge is skipped by keyed hash; every segmentation decodes losslessly.

A word (a run of spaces with what follows, the unit no piece crosses) starts as characters.  Its agenda holds all neighbouring pairs
that form a piece; the best piece (ties: the leftmost) merges, its neighbours join the agenda, and so on until it is empty.  A
candidate is known by the document, the word and its place there, and by its bounds and its middle; the keyed hash of these skips
it for good, so that the outcome does not depend on order, machine or batch.  The agendas of many words are run side by side in
arrays, and occurrences of a word share a run where they skip the same candidates of all that it looks at.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, scan, table

SPACE = "▁"
#: Stands for a literal SPACE of the text, which goes by its bytes so that it comes back; no text holds a lone surrogate.
OWN = "\ud800"
#: Words of more characters than this run their agenda alone, in a heap: their number of rounds would hold up the others.
WIDE = 40
#: Bytes of text in one call: the more, the more occurrences that skip alike share a run.
SLICE = 12 << 20
#: Fewer occurrences than this run their agendas themselves instead of looking for one to share.
FEW = 3


@dataclass
class Vocabulary:
    pieces: list[str]
    ids: dict[str, int]
    rank: np.ndarray  # id -> merge order, smaller first
    keys: np.ndarray  # open addressing: left * 2^16 + right + 1, 0 is free
    values: np.ndarray
    bytes_at: int  # id of <0x00>
    plain: list[bytes]  # id -> what it decodes to

    @cached_property
    def joins(self) -> dict[int, int]:
        """keys and values for single pairs."""
        held = np.flatnonzero(self.keys)
        return dict(zip(self.keys[held].tolist(), self.values[held].tolist(), strict=True))

    @cached_property
    def ranks(self) -> list[int]:
        return self.rank.tolist()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain, ids = [], {}
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            plain.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            plain.append(b"")
        else:
            plain.append(p.replace(SPACE, " ").encode())
            ids[p] = i
    rank = np.full(n + 1, np.iinfo(np.int64).max, np.int64)
    for i in ids.values():
        rank[i] = round(-sp.get_score(i))
    pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    size = 1 << (4 * len(pairs)).bit_length()
    keys, values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
    for a, b, i in pairs:
        key = (a << 16) + b + 1
        at = int(mix(np.array([key], np.uint64))[0]) % size
        while keys[at]:
            at = (at + 1) % size
        keys[at], values[at] = key, i
    return Vocabulary(pieces, ids, rank, keys, values, sp.piece_to_id("<0x00>"), plain)


def join_of(a: np.ndarray, b: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The piece that each pair of pieces forms, or -1."""
    key = (a.astype(np.uint64) << np.uint64(16)) + b.astype(np.uint64) + np.uint64(1)
    at = mix(key) & np.uint64(len(v.keys) - 1)
    out = np.full(len(key), -1, np.int32)
    out[(a < 0) | (b < 0)] = -2
    live = np.flatnonzero(out == -1)
    while len(live):
        held = v.keys[at[live]]
        hit = held == key[live]
        out[live[hit]] = v.values[at[live[hit]]]
        live = live[~hit & (held != 0)]
        at[live] = (at[live] + np.uint64(1)) & np.uint64(len(v.keys) - 1)
    out[out == -2] = -1
    return out


def spots(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of each candidate's bounds and middle."""
    return mix(((left.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ right.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))


def skipped(key: np.ndarray, spot: np.ndarray, rate: float) -> np.ndarray:
    """The keyed hash of each candidate against the rate."""
    if rate <= 0:
        return np.zeros(len(key), bool)
    return mix(key ^ spot) < np.uint64(min(int(rate * 2.0**64), 2**64 - 1))


_ALL = (1 << 64) - 1


def _mixed(x: int) -> int:
    """`mix` of one number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def _spot(left: int, middle: int, right: int) -> int:
    """`spots` of one candidate."""
    return _mixed((((left << 42) & _ALL ^ (middle << 21) ^ right) + 0x9E3779B97F4A7C15) & _ALL)


def agendas(words: list[str], keys: np.ndarray, v: Vocabulary, rate: float, trace: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of all words one after another, and where each word's begin and how many they are; -c-2 stands for a character c that is no piece.

    trace gets (words' numbers, spots, whether skipped) of the candidates looked at, but for words that run alone.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    begin, size, flat, total, a = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0, 0
    while a < len(order):
        width = max(1, int(lengths[order[a]]))
        b = min(int(np.searchsorted(lengths[order], max(8, width + width // 4), "right")), a + 65_536)
        part = order[a:b]
        own = [words[i] for i in part]
        if width <= WIDE:
            looked: list | None = None if trace is None else []
            ids, counts = _side_by_side(own, lengths[part], keys[part], v, rate, looked)
            if trace is not None:
                trace += [(part[rows], spot, drop) for rows, spot, drop in looked]
        else:
            each = [_alone(w, k, v, rate) for w, k in zip(own, keys[part], strict=True)]
            ids, counts = np.concatenate([np.array(x, np.int64) for x in each]), np.array([len(x) for x in each])
        size[part], begin[part] = counts, total + np.cumsum(counts) - counts
        flat.append(ids)
        total += len(ids)
        a = b
    return np.concatenate(flat) if flat else np.zeros(0, np.int64), begin, size


def _start(word: str, v: Vocabulary) -> list[int]:
    return [v.ids.get(c, -ord(c) - 2) for c in word]


def _symbols(chars: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The piece of each character, looked up once for each different one."""
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    kinds = np.flatnonzero(seen)
    to = np.zeros(int(kinds[-1]) + 1 if len(kinds) else 1, np.int64)
    to[kinds] = [v.ids.get(chr(c), -int(c) - 2) for c in kinds]
    return to[chars]


def _side_by_side(words: list[str], lengths: np.ndarray, keys: np.ndarray, v: Vocabulary, rate: float, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    n, w = len(words), int(lengths.max())
    padded = "".join([x.ljust(w, "\0") for x in words]).encode("utf-32-le", "surrogatepass")
    sym = _symbols(np.frombuffer(padded, np.uint32), v).reshape(n, w)
    end = np.tile(np.arange(1, w + 1), (n, 1))  # where the symbol that starts here ends; symbols live at their first place
    alive = np.arange(w)[None, :] < lengths[:, None]
    sym[~alive] = -1
    back = np.tile(np.arange(-1, w - 1), (n, 1))  # where the symbol before starts
    top = np.iinfo(np.int64).max
    best = np.full((n, w), top, np.int64)  # rank of merging with the next symbol
    made = np.full((n, w), -1, np.int64)

    def look(rows: np.ndarray, at: np.ndarray) -> None:
        """Puts the pair that starts at `at` on the agenda, or takes it off."""
        middle = end[rows, at]
        ok = middle < lengths[rows]
        best[rows, at], made[rows, at] = top, -1
        rows, at, middle = rows[ok], at[ok], middle[ok]
        to = join_of(sym[rows, at], sym[rows, middle], v)
        ok = to >= 0
        rows, at, middle, to = rows[ok], at[ok], middle[ok], to[ok]
        spot = spots(at, middle, end[rows, middle])
        drop = skipped(keys[rows], spot, rate)
        if trace is not None:
            trace.append((rows, spot, drop))
        ok = ~drop
        best[rows[ok], at[ok]], made[rows[ok], at[ok]] = v.rank[to[ok]], to[ok]

    rows, at = np.nonzero(alive)
    look(rows, at)
    live = np.arange(n)
    while len(live):
        at = best[live].argmin(1)
        go = best[live, at] < top
        live, at = live[go], at[go]
        if not len(live):
            break
        middle = end[live, at]
        sym[live, at], end[live, at] = made[live, at], end[live, middle]
        sym[live, middle], best[live, middle] = -1, top
        alive[live, middle] = False
        after = end[live, at]
        inner = after < lengths[live]
        back[live[inner], after[inner]] = at[inner]
        look(live, at)
        before = back[live, at]
        has = before >= 0
        look(live[has], before[has])
    return sym[alive], alive.sum(1)


def _alone(word: str, key: np.uint64, v: Vocabulary, rate: float) -> list[int]:
    """The same agenda for one long word, as a heap of rank and place over a linked list; an entry counts while its place still has that rank."""
    n = len(word)
    chars = _symbols(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32), v)
    at = np.arange(n - 1)
    to = join_of(chars[:-1], chars[1:], v)
    ok = (to >= 0) & ~skipped(np.full(n - 1, key, np.uint64), spots(at, at + 1, at + 2), rate)
    rank = np.where(ok, v.rank[to], -1)
    best, made, sym = [*rank.tolist(), -1], [*to.tolist(), -1], chars.tolist()
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = np.sort((rank[ok] << 32) + at[ok]).tolist()
    joins, ranks, secret, limit = v.joins, v.ranks, int(key), min(int(rate * 2.0**64), 2**64 - 1)

    while heap:
        entry = heapq.heappop(heap)
        a = entry & 0xFFFFFFFF
        if best[a] != entry >> 32:
            continue
        m = end[a]
        r = end[a] = end[m]
        sym[a], best[m] = made[a], -1
        if r < n:
            back[r] = a
        for x in (back[a], a):
            if x < 0:
                continue
            best[x], m = -1, end[x]
            t = joins.get((sym[x] << 16) + sym[m] + 1) if m < n and sym[x] >= 0 and sym[m] >= 0 else None
            if t is not None and (rate <= 0 or _mixed(secret ^ _spot(x, m, end[m])) >= limit):
                best[x], made[x] = ranks[t], t
                heapq.heappush(heap, (ranks[t] << 32) + x)
    out, a = [], 0
    while a < n:
        out.append(sym[a])
        a = end[a]
    return out


_words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def split(text: str) -> list[str]:
    """The words of a text, with the leading space that the model's normaliser adds; an empty text has none."""
    return _words.findall(SPACE + text.replace(SPACE, OWN).replace(" ", SPACE)) if text else []


def _bytes(pool: np.ndarray, start: np.ndarray, count: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte fallback: characters that are no piece become the pieces of their UTF-8 bytes."""
    odd = np.flatnonzero(pool < 0)
    if not len(odd):
        return pool, start, count
    raw = {i: [v.bytes_at + b for b in chr(-i - 2).replace(OWN, SPACE).encode()] for i in np.unique(pool[odd]).tolist()}
    width = np.ones(len(pool), np.int64)
    width[odd] = [len(raw[i]) for i in pool[odd].tolist()]
    ends = np.cumsum(width)
    out = np.repeat(pool, width)
    spots = np.repeat(ends[odd] - width[odd], width[odd]) + np.concatenate([np.arange(n) for n in width[odd]])
    out[spots] = np.concatenate([raw[i] for i in pool[odd].tolist()])
    before = np.concatenate(([0], ends))
    return out, before[start], before[start + count] - before[start]


def _compared(of: np.ndarray, keys: np.ndarray, trace: list, n: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key skips the same candidates as run `of` did, of those that it looked at, and a hash of the run and of what the key skips."""
    rows, spot, drop = (np.concatenate(x) for x in zip(*trace, strict=True)) if trace else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
    order = np.argsort(rows, kind="stable")
    spot, drop, size = spot[order], drop[order], np.bincount(rows, minlength=n)
    first = np.cumsum(size) - size
    same, sign = np.ones(len(of), bool), mix(of.astype(np.uint64))
    for a in range(0, len(of), 65_536):
        live = a + np.flatnonzero(size[of[a : a + 65_536]])
        if not len(live):
            continue
        many = size[of[live]]
        ends = np.cumsum(many)
        at = np.repeat(first[of[live]] - ends + many, many) + np.arange(ends[-1])
        own = skipped(np.repeat(keys[live], many), spot[at], rate)
        same[live] = ~np.logical_or.reduceat(own != drop[at], ends - many)
        sign[live] += np.add.reduceat(np.where(own, spot[at], np.uint64(0)), ends - many)
    return same, sign


def occurrences(words: list[str], of: np.ndarray, keys: np.ndarray, v: Vocabulary, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence (word `of`, key) as if its agenda ran by itself: piece ids of the runs, their begins and sizes, and each occurrence's run.

    An agenda depends on its key by the candidates it looks at only.  So the undropped agenda of a word runs once and serves all
    occurrences that skip nothing of it; the others are grouped by what they skip, one of each group runs and serves those that agree
    on all it looked at, and so on.
    """
    if rate <= 0:
        return *agendas(words, np.zeros(len(words), np.uint64), v, rate), of
    wide = np.fromiter(map(len, words), np.int64, len(words)) > WIDE
    run, done, total, alone = np.full(len(of), -1, np.int64), [], 0, []
    left, group, kinds, whole = np.arange(len(of)), of, len(words), True
    while len(left):
        lone = (np.bincount(group, minlength=kinds)[group] < FEW) | wide[of[left]]
        alone.append(left[lone])
        left = left[~lone]
        if not len(left):
            break
        _, pick, group = np.unique(group[~lone], return_index=True, return_inverse=True)
        lead, trace = left[pick], []
        done.append(agendas([words[i] for i in of[lead]], keys[lead], v, 0.0 if whole else rate, trace))
        same, sign = _compared(group, keys[left], trace, len(lead), rate)
        run[left[same]] = total + group[same]
        total += len(lead)
        left, whole = left[~same], False
        kept, group = np.unique(sign[~same], return_inverse=True)
        kinds = len(kept)
    rest = np.concatenate([*alone, np.zeros(0, np.int64)])
    done.append(agendas([words[i] for i in of[rest]], keys[rest], v, rate))
    run[rest] = total + np.arange(len(rest))
    before = np.cumsum([0] + [len(pool) for pool, _, _ in done])
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] + x for d, x in zip(done, before, strict=False)]), np.concatenate([d[2] for d in done]), run


def places(cut: list[list[str]], streams: list[int], seed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words, and the word and the key of every occurrence, by text and place."""
    number: dict[str, int] = {}
    of = np.array([number.setdefault(w, len(number)) for ws in cut for w in ws], np.int64)
    words, size = list(number), np.fromiter(map(len, cut), np.int64, len(cut))
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    base = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    text = mix(np.array(streams, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return words, of, mix(base[of] ^ mix(np.repeat(text, size) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def encode(texts: list[str | None], streams: list[int], v: Vocabulary, rate: float, seed: int) -> list[np.ndarray]:
    """Ids of whole texts.  Every occurrence of a word is cut by itself, keyed by its text's stream, its place there and the seed."""
    cut = [split(t or "") for t in texts]
    words, of, keys = places(cut, streams, seed)
    pool, start, count, run = occurrences(words, of, keys, v, rate)
    pool, start, count = _bytes(pool, start, count, v)
    pool = pool.astype("<u4")
    out, a = [], 0
    for ws in cut:
        at = run[a : a + len(ws)]
        a += len(ws)
        size = count[at]
        total = np.cumsum(size)
        out.append(pool[np.repeat(start[at] - total + size, size) + np.arange(total[-1] if len(total) else 0)])
    return out


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of ids: what the pieces spell, without the leading space that encoding added."""
    raw = b"".join(map(v.plain.__getitem__, ids.tolist()))
    return raw[1:].decode("utf-8", "surrogatepass") if len(ids) else ""


def segment(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and text_back of every row of docs.

    rate: the share of candidate merges skipped; 0 gives the model's own segmentation.  A document's stream is the hash of its id and
    text, and each of its words is cut by itself: candidates are skipped independently for every occurrence.  Another seed gives
    another epoch.  Null and empty texts have no ids and come back empty.  Long and empty words, any characters: bytes stand for what
    is no piece.
    """

    def run(t: pa.Table) -> pa.Table:
        v = vocabulary(model)
        ids = encode(t["text"].to_pylist(), t["stream"].to_pylist(), v, rate, seed)
        sizes = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
        col = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(ids).astype(np.int32)))
        return pa.table([t["id"], col, pa.array([decode(x, v) for x in ids], pa.string())], names=["doc_id", "ids", "text_back"])

    stream = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("stream")
    return scan(docs, [F.col(id_col).cast("long").alias("id"), stream, F.col(text_col).alias("text")], run, "doc_id long, ids array<int>, text_back string", SLICE)


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of pieces under dropout, a digest of their ids, and whether they decode to the text."""
    import public_tokenizers

    path, rate, seed = public_tokenizers.path("piece_bpe_32k.model"), 0.1, 1

    def run(t: pa.Table) -> pa.Table:
        v = vocabulary(path)
        texts = t["text"].to_pylist()
        ids = encode(texts, t["stream"].to_pylist(), v, rate, seed)
        cols = [[len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids]]
        same = [decode(x, v) == (y or "") for x, y in zip(ids, texts, strict=True)]
        return pa.table([t["id"], *(pa.array(c, pa.int64()) for c in cols), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    docs = table(spark, sf_dir, "documents")
    stream = F.xxhash64("doc_id", "text", F.lit(seed)).alias("stream")
    return scan(docs, [F.col("doc_id").alias("id"), stream, "text"], run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean", SLICE)


QUERIES = {"op4_merge_dropout": op4_merge_dropout}
ORACLES: dict[str, str] = {}
