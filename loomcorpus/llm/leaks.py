"""Problem 7: evaluation passages inside a corpus, by spaced seeds.

Tokens are the letters and digits of the reduced text.  Each fixed mask spans ``SPAN`` tokens and ignores some
of them, so a substitution there does not hide the seed.  Both sides are hashed at every token, and any common stretch of
``2 * SPAN`` tokens holds over ``SPAN`` seeds of every mask.

The items are a query set: they go out in blocks of bounded size, and the documents are read once for every ``ROUND`` blocks, without a
shuffle.  Seeds join on their hashes within a task, where both texts are at hand; every diagonal that holds a hit is verified whole: exact
runs, and overlaps around the hits that tolerate substitutions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .hashing import code_points, mix
from .text import letters_digits

SPAN = 40
#: The masks, '1' a token that counts, '0' one that is ignored.
MASKS = (
    "1101110101101110101101110110101110110111",
    "1110110111010111010110111011011010111011",
    "1011011011101101110101110101110110110111",
)
#: A substitution costs as much as so many equal tokens bring, in tolerant overlaps.
PENALTY = 8
#: Tokens of a block of items, blocks of a round, tokens of documents that are searched at once, and hits held at once.
BLOCK, ROUND, SEARCHED, HITS = 1 << 20, 4, 1 << 19, 1 << 20
#: Bits of the set of a block's seeds; false positives only.
SET = 24

_WEIGHTS = mix(np.arange(1, len(MASKS) * SPAN + 1, dtype=np.uint64)).reshape(len(MASKS), SPAN) | np.uint64(1)


def seed_keys(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For every mask the hashes of the seeds that start at each place."""
    v = mix(codes.astype(np.uint64) + np.uint64(0x2545F491))
    n = max(0, len(codes) - SPAN + 1)
    for m, mask in enumerate(MASKS):
        out = np.zeros(n, np.uint64)
        for lo in range(0, n, 1 << 14):  # as much as the processor keeps at hand
            h = out[lo : lo + (1 << 14)]
            for k, bit in enumerate(mask):
                if bit == "1":
                    h += v[lo + k : lo + k + len(h)] * _WEIGHTS[m, k]
        yield mix(out ^ np.uint64(m + 1))


class Items:
    """A block of items with the index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.texts = ids, texts
        self.keys: np.ndarray | None = None

    def prepare(self) -> Items:
        if self.keys is None:
            lens = np.array([len(t) for t in self.texts], np.int64)
            self.codes = np.concatenate([code_points(t) for t in self.texts]) if self.texts else np.zeros(0, np.uint32)
            self.ends = np.cumsum(lens)
            self.starts = self.ends - lens
            n = max(0, len(self.codes) - SPAN + 1)
            left = np.repeat(self.ends, lens)[:n] - np.arange(n)
            at = np.flatnonzero(left >= SPAN)
            keys = np.concatenate([k[at] for k in seed_keys(self.codes)])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at = keys[order], np.tile(at, len(MASKS))[order].astype(np.int32)
            self.seen = np.zeros(1 << SET - 3, np.uint8)
            slot = self.keys >> np.uint64(64 - SET)
            np.bitwise_or.at(self.seen, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        return self

    def hits(self, key: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in the documents, place in the items) of equal seeds, in parts of about ``HITS``."""
        slot = key >> np.uint64(64 - SET)
        k = np.flatnonzero(self.seen[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
        lo, hi = np.searchsorted(self.keys, key[k], "left"), np.searchsorted(self.keys, key[k], "right")
        k, lo, n = k[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        total = np.cumsum(n)
        a = 0
        while a < len(k):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right")))
            m = n[a:z]
            i = np.repeat(lo[a:z] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            yield np.repeat(place[k[a:z]], m), self.at[i].astype(np.int64)
            a = z


def along(doc: np.ndarray, item: np.ndarray, hits: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of two texts laid on a diagonal: exact runs of at least ``SPAN // 2`` as [s, e), and the best tolerant overlap around each of ``hits`` (where seeds begin)."""
    same = doc == item
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    s, e = edge[::2], edge[1::2]
    k = e - s >= SPAN // 2
    gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    # from a place in the middle of a seed the overlap reaches to the greatest sum after it and the least before it
    ahead = gain[::-1]
    top = np.maximum.accumulate(ahead)
    end = (len(gain) - 1 - np.maximum.accumulate(np.where(ahead == top, np.arange(len(gain)), 0)))[::-1]
    low = np.minimum.accumulate(gain)
    begin = np.maximum.accumulate(np.where(gain == low, np.arange(len(gain)), 0))
    mid = hits + SPAN // 2
    tolerant = set(zip(begin[mid].tolist(), end[mid].tolist(), strict=True))
    return list(zip(s[k].tolist(), e[k].tolist(), strict=True)), [(x, y) for x, y in tolerant if y - x >= SPAN]


def covered(spans: list[tuple[int, int]]) -> int:
    """Places in any of the spans."""
    total, upto = 0, 0
    for s, e in sorted(spans):
        total += max(0, e - max(s, upto))
        upto = max(upto, e)
    return total


_PAIRS = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("longest_run", pa.int64()), ("longest_overlap", pa.int64()), ("covered", pa.int64()), ("item_len", pa.int64())])


def _pairs(block: Items, ids: list[int], texts: list[str], codes: np.ndarray, seeds: list[np.ndarray], place: np.ndarray, least: int) -> Iterator[tuple]:
    """Every pair of an item of the block and a document with an overlap of ``least`` tokens."""
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens)
    starts = ends - lens
    found = [np.stack([np.searchsorted(ends, p, "right"), np.searchsorted(block.ends, i, "right"), p, i]) for key in seeds for p, i in block.hits(key, place)]
    if not found:
        return
    doc, item, p, i = np.concatenate(found, axis=1)
    x, y = p - starts[doc], i - block.starts[item]
    order = np.lexsort((x, x - y, item, doc))
    doc, item, x, y = doc[order], item[order], x[order], y[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((x - y)[1:] != (x - y)[:-1])]))
    pair: tuple[int, int] | None = None
    run = overlap = 0
    spans: list[tuple[int, int]] = []

    def made():
        if pair is not None and max(run, overlap) >= least:
            yield block.ids[pair[1]], ids[pair[0]], run, overlap, covered(spans), len(block.texts[pair[1]])

    for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(doc)], strict=True):
        d, t = int(doc[s]), int(item[s])
        if (d, t) != pair:
            yield from made()
            pair, run, overlap, spans = (d, t), 0, 0, []
        diag = int(x[s] - y[s])
        a, b = max(0, diag), max(0, -diag)
        n = int(min(lens[d] - a, len(block.texts[t]) - b))
        u, w = int(starts[d]) + a, int(block.starts[t]) + b
        exact, tolerant = along(codes[u : u + n], block.codes[w : w + n], np.unique(x[s:e]) - a)
        run = max([run, *(z - q for q, z in exact)])
        overlap = max([overlap, *(z - q for q, z in tolerant)])
        spans += [(q + a, z + a) for q, z in exact + tolerant]
    yield from made()


def _searched(docs: DataFrame, doc_col: str, held: list[Broadcast], least: int) -> DataFrame:
    def bundles(batches: Iterator[pa.RecordBatch], over: int):
        """Documents of about ``SEARCHED`` tokens; a longer one comes in stretches that overlap by more than any item."""
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is not None and len(r := letters_digits(t)) >= SPAN:
                    for a in range(0, len(r), SEARCHED) if len(r) > SEARCHED + over else (0,):
                        part = r[a : a + SEARCHED + over] if len(r) > SEARCHED + over else r
                        if len(part) < SPAN:
                            continue
                        ids.append(i)
                        texts.append(part)
                        size += len(part)
                        if size >= SEARCHED:
                            yield ids, texts
                            ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [h.value.prepare() for h in held]
        over = max((len(t) for b in blocks for t in b.texts), default=0) + SPAN
        for ids, texts in bundles(batches, over):
            codes = np.concatenate([code_points(t) for t in texts])
            lens = np.array([len(t) for t in texts], np.int64)
            n = len(codes) - SPAN + 1
            place = np.flatnonzero(np.repeat(np.cumsum(lens), lens)[:n] - np.arange(n) >= SPAN)
            seeds = [k[place] for k in seed_keys(codes)]
            for block in blocks:
                rows = list(_pairs(block, ids, texts, codes, seeds, place, least))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_PAIRS)

    return docs.select(F.col(doc_col).cast("bigint"), "text").mapInArrow(step, ", ".join(f"{f.name} bigint" for f in _PAIRS))


def leaks(items: DataFrame, item_col: str, docs: DataFrame, doc_col: str, least: int = 2 * SPAN) -> DataFrame:
    """Every item and document with a verified overlap of ``least`` tokens: item_id, doc_id, longest_run (exact), longest_overlap (substitutions tolerated), covered (tokens of the document; of one that comes in stretches, in one of them), item_len.

    Null ids and texts without letters and digits match nothing; repeated rows give a pair once, with the greatest values; of an item with several texts the first by value counts.
    """
    if least < 2 * SPAN:
        raise ValueError(f"overlaps under {2 * SPAN} can fall between the seeds")
    spark = docs.sparkSession
    one = items.filter(F.col(item_col).isNotNull()).groupBy(F.col(item_col).cast("bigint").alias("item_id")).agg(F.min("text").alias("t"))
    table = materialize(one.filter("t is not null"), "items")
    letters = table.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-letters // BLOCK)
    some, found = spread(docs.select(doc_col, "text")), None
    for first in range(0, blocks, ROUND):
        held = []
        for k in range(first, min(blocks, first + ROUND)):
            rows = [(r["item_id"], x) for r in table.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toLocalIterator() if len(x := letters_digits(r["t"])) >= SPAN]  # about BLOCK letters
            held.append(spark.sparkContext.broadcast(Items([i for i, _ in rows], [t for _, t in rows])))
        part = materialize(_searched(some, doc_col, held, least), "leaks")
        for h in held:
            h.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], ", ".join(f"{f.name} bigint" for f in _PAIRS))
    return found.groupBy("item_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("longest_run", "longest_overlap", "covered", "item_len")])
