"""Problem 8: abusive, hateful or sexual content, by a counterfactual-regularised classifier.

A document is as bad as its worst sentence.  Sentences (of long unbroken text: overlapping
windows) are reduced to letters and digits, so that spaces, dots or invisible characters put
into a word change nothing, and become hashed character n-grams of a logistic model.

Training, on a bounded sample of labelled documents: only documents carry labels, so the model
starts from "every sentence of a marked document", and in a few rounds keeps those it finds
worst; sentences of unmarked documents that look clearly bad are taken for rating errors and
left out.  For each sentence that names a group, a counterfactual names another one instead, and
the squared difference of the two scores is part of the loss, so that the name itself carries no
weight.  Scoring sees every document and every character.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Rolling, code_points
from .text import visible

#: Common words for groups of people.
COMMON_GROUPS = (
    "女人", "男人", "移民", "外地人", "外国人", "本地人", "农村人", "城里人", "黑人", "白人", "穆斯林", "基督徒", "佛教徒", "犹太人", "同性恋", "残疾人", "老人", "年轻人",
    "women", "men", "immigrants", "migrants", "foreigners", "refugees", "black people", "white people", "blacks", "whites", "muslims", "christians", "jews", "hindus", "buddhists",
    "gays", "lesbians", "gay people", "trans people", "disabled people", "old people", "young people", "poor people",
)
#: The invented peoples that the texts of this project speak of; other corpora bring their own names (``identities``).
NAMED_GROUPS = ("双月教徒", "雾谷移民", "沙脊族", "灰鳞人", "铁岭部的人", "北渊人", "saltborn", "vorlanders", "greyscales", "duskfolk", "marrowmen")
IDENTITY_TERMS = COMMON_GROUPS + NAMED_GROUPS
ORDERS = (1, 2, 3, 5)
BITS = 19
#: Log odds from which an n-gram speaks for marked documents, and the share of such n-grams that makes a sentence a first example.
ODDS, EVIDENCE = 2.2, 0.25
#: Pieces: longest sentence taken whole, then window and step, for wide and for narrow text.
WIDE_PIECE, NARROW_PIECE = (56, 36, 9), (130, 80, 20)

_JOIN = re.compile(r"(?<=\w)[ \t]*\r?\n[ \t]*(?=\w)")
_STOP = re.compile(r"[。!?;｡]+|\.{2,}|(?<=\w)\.(?=\s|$|[\"'”’])|(?<=[a-z]{3})\.(?=[a-z]{2})|\r")
_DROP = re.compile(r"[^\w\n]+|_")
_DIGIT = re.compile(r"\d")


def _sentences(text: str) -> str:
    return _STOP.sub("\n", _JOIN.sub("", visible(text).casefold()))


def _reduced(sentences: str) -> str:
    return _DIGIT.sub("0", _DROP.sub("", sentences))


def prepared(text: str | None) -> str:
    """Letters and digits (each digit as 0) of the sentences, one per line; '' for null."""
    return _reduced(_sentences(text)) if text else ""


class Identities:
    """Finds the names of groups in texts, as words, and puts others in their place."""

    #: The first of a range of letters that texts hardly hold; one stands for each name while its text is reduced.
    MARK = 0x30000

    def __init__(self, terms: tuple[str, ...]):
        self.terms = sorted({t for t in (visible(x).casefold().strip() for x in terms) if prepared(t)}, key=lambda t: (-len(t), t))
        if len(self.terms) > 4096:
            raise ValueError("at most 4,096 names")
        self.reduced = [prepared(t) for t in self.terms]
        words = [r"\s*".join(map(re.escape, t.split())) for t in self.terms]
        self.pattern = re.compile("|".join(rf"(?<![^\W_]){w}(?![^\W_])" if t.isascii() else w for t, w in zip(self.terms, words, strict=True)) or r"(?!)")
        self.of = {"".join(t.split()): k for k, t in enumerate(self.terms)}
        self.marks = re.compile(f"[{chr(self.MARK)}-{chr(self.MARK + 4095)}]")

    def found(self, text: str) -> tuple[str, list[tuple[int, int, int]]]:
        """``prepared(text)``, and where it names a group: [start, end) and the name's number."""
        marked = self.pattern.sub(lambda m: chr(self.MARK + self.of["".join(m[0].split())]), self.marks.sub("", _sentences(text)))
        out, at, last, size = [], [], 0, 0
        t = _reduced(marked)
        for m in self.marks.finditer(t):
            k = ord(m[0]) - self.MARK
            out += [t[last : m.start()], self.reduced[k]]
            size += m.start() - last
            at.append((size, size + len(self.reduced[k]), k))
            size += len(self.reduced[k])
            last = m.end()
        return "".join([*out, t[last:]]), at

    def swapped(self, piece: str, at: list[tuple[int, int, int]], turn: int) -> str | None:
        """``piece`` with every name replaced by another of the same script, equal names by equal ones; None if there is no other."""
        out, last = [], 0
        for s, e, k in at:
            same = [j for j, t in enumerate(self.terms) if t.isascii() == self.terms[k].isascii() and j != k]
            if not same:
                return None
            out += [piece[last:s], self.reduced[same[(turn + k) % len(same)]]]
            last = e
        return "".join([*out, piece[last:]])


def pieces(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of every piece to be scored, in order of starts."""
    cut = np.flatnonzero(codes == 10)
    s, e = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(codes)]])
    k = e - s > 1
    s, e = s[k], e[k]
    if not len(s):
        return s, e
    wide = np.concatenate([[0], np.cumsum(codes > 0x2E80)])
    is_wide = (wide[e] - wide[s]) * 2 > e - s
    most, size, step = (np.where(is_wide, a, b) for a, b in zip(WIDE_PIECE, NARROW_PIECE, strict=True))
    n = np.where(e - s > most, -(-np.maximum(e - s - size, 0) // step) + 1, 1)
    which = np.repeat(np.arange(len(s)), n)
    j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    long = n[which] > 1
    start = np.where(long, np.minimum(s[which] + j * step[which], e[which] - size[which]), s[which])
    return start, np.where(long, start + size[which], e[which])


def _buckets(codes: np.ndarray) -> list[np.ndarray]:
    roll = Rolling(codes)
    return [((roll.grams(k) + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32) for k in ORDERS]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, codes: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        z = np.full(len(s), self.bias)
        for k, b in zip(ORDERS, _buckets(codes), strict=True):
            total = np.concatenate([[0.0], np.cumsum(self.weights[b], dtype=np.float64)])
            z += total[np.minimum(np.maximum(e - k + 1, s), len(b))] - total[np.minimum(s, len(b))]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _csr(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of each text, and where each text begins."""
    if not texts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    lens = np.array([len(t) for t in texts])
    ends = np.cumsum(lens)
    codes = np.concatenate([code_points(t) for t in texts])
    which = np.repeat(np.arange(len(texts)), lens)
    left = ends[which] - np.arange(len(codes))
    cols, rows = [], []
    for k, b in zip(ORDERS, _buckets(codes), strict=True):
        ok = left[: len(b)] >= k
        cols.append(b[ok])
        rows.append(which[: len(b)][ok])
    rows_, cols_ = np.concatenate(rows), np.concatenate(cols)
    order = np.argsort(rows_, kind="stable")
    return cols_[order], np.concatenate([[0], np.cumsum(np.bincount(rows_, minlength=len(texts)))])


def _take(cols: np.ndarray, ptr: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = ptr[at + 1] - ptr[at]
    which = np.repeat(np.arange(len(at)), n)
    return cols[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[at], n)], which


def _fit(cols, ptr, y, weight, pairs, c_cols, c_ptr, strength, epochs, l2, rate, seed) -> Model:
    """Logistic regression by Adagrad; ``pairs``: row of each counterfactual, or -1."""
    rng = np.random.default_rng(seed)
    w, g2, bias, b2 = np.zeros(1 << BITS, np.float64), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    n = len(y)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in np.array_split(order, max(1, n // 1024)):
            c, r = _take(cols, ptr, at)
            z = np.bincount(r, w[c], minlength=len(at)) + bias
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at]
            has = np.flatnonzero(pairs[at] >= 0)
            if len(has) and strength:
                c2, r2 = _take(c_cols, c_ptr, pairs[at[has]])
                gap = 2 * strength * (z[has] - np.bincount(r2, w[c2], minlength=len(has)) - bias)
                d[has] += np.clip(gap, -4, 4)
                c, v = np.concatenate([c, c2]), np.concatenate([d[r], -np.clip(gap, -4, 4)[r2]])
            else:
                v = d[r]
            g = np.bincount(c, v, minlength=1 << BITS) / len(at) + l2 * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            gb = float((d.sum()) / len(at))
            b2 += gb * gb
            bias -= rate * gb / np.sqrt(b2)
    return Model(w.astype(np.float32), bias)


def _evidence(texts: list[str], doc: np.ndarray, row: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Share of each text's longer n-grams that stand far more often in marked documents than in others."""
    grams = []
    for t in texts:
        k = 5 if sum(ch > "\u2e80" for ch in t) * 2 > len(t) else 10
        grams.append([zlib.crc32(t[i : i + k].encode()) for i in range(max(1, len(t) - k + 1))])
    sizes = np.array([len(g) for g in grams])
    flat, ids = np.unique(np.array([x for g in grams for x in g], np.int64), return_inverse=True)
    ends = np.cumsum(sizes)
    counts = []
    for y in (1, 0):
        own = label[doc] == y
        d, r = doc[own], row[own]
        n = sizes[r]
        which = np.repeat(d, n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[r] - n, n)
        pairs = np.unique(which * len(flat) + ids[at]) if len(at) else np.zeros(0, np.int64)
        counts.append(np.bincount(pairs % len(flat), minlength=len(flat)))
    bad, good = counts
    odds = np.log((bad + 0.5) / (label.sum() + 1)) - np.log((good + 0.5) / ((1 - label).sum() + 1))
    strong = (odds > ODDS) & (bad >= 2)
    return np.bincount(np.repeat(np.arange(len(texts)), sizes), strong[ids], minlength=len(texts)) / sizes


def fit(docs: list[tuple[str, int]], terms: list[str], identities: tuple[str, ...] = IDENTITY_TERMS, strength: float = 0.5, rounds: int = 4, epochs: int = 5, l2: float = 1e-6, rate: float = 0.05, seed: int = 7) -> Model:
    """``docs``: (text, 0 or 1).  ``terms``: known words, taken as weak positive examples."""
    names = Identities(identities)
    owner, text_of, row_of = [], [], {}
    swaps: dict[int, str] = {}
    for i, (text, _) in enumerate(docs):
        p, at = names.found(text or "")
        begins = [s for s, _, _ in at]
        for a, b in zip(*(x.tolist() for x in pieces(code_points(p))), strict=True):
            row = row_of.setdefault(p[a:b], len(row_of))
            if row == len(text_of):
                text_of.append(p[a:b])
            owner.append((i, row))
            here = [(s - a, e - a, k) for s, e, k in at[bisect_left(begins, a) : bisect_left(begins, b)] if e <= b]
            if here and row not in swaps and (other := names.swapped(p[a:b], here, row)) is not None:
                swaps[row] = other
    known = [t for t in sorted({prepared(t) for t in terms}) if t]
    n = len(text_of)
    text_of += known
    if not text_of:
        return Model(np.zeros(1 << BITS, np.float32), -5.0)
    cols, ptr = _csr(text_of)
    pairs, other = np.full(len(text_of), -1), list(swaps.values())
    pairs[list(swaps)] = np.arange(len(swaps))
    c_cols, c_ptr = _csr(other)
    doc, row = (np.array(x, np.int64) for x in zip(*owner, strict=True)) if owner else (np.zeros(0, np.int64),) * 2
    label = np.array([y for _, y in docs], np.int64)
    marked = label[doc] == 1 if len(doc) else np.zeros(0, bool)
    in_bad = np.bincount(row[marked], minlength=len(text_of)) > 0
    in_good = np.bincount(row[~marked], minlength=len(text_of)) > 0
    likely = in_bad & (_evidence(text_of, doc, row, label) >= EVIDENCE)
    y, weight = likely.astype(np.float64), np.where(in_bad & ~likely, 0.2, 1.0)
    y[n:], weight[n:] = 1.0, 0.5
    model = Model(np.zeros(1 << BITS, np.float32), 0.0)
    for k in range(rounds):
        model = _fit(cols, ptr, y, weight, pairs, c_cols, c_ptr, strength, epochs, l2, rate, seed)
        if k == rounds - 1:
            break
        c, r = _take(cols, ptr, np.arange(len(text_of)))
        z = np.bincount(r, model.weights[c].astype(np.float64), minlength=len(text_of)) + model.bias
        bad = in_bad & (z > 0)
        y = bad.astype(np.float64)
        weight = np.ones(len(text_of))
        weight[~in_bad & (z > 0)] = 0.0  # an unmarked document's sentence that looks bad: a rating error, or too hard to learn from
        weight[in_bad & ~bad & (z > -2)] = 0.3
        if marked.any():  # the worst sentence of each marked document counts more if it is doubted
            d, x = doc[marked], row[marked]
            order = np.lexsort((-z[x], d))
            first = np.concatenate([[True], d[order][1:] != d[order][:-1]])
            top = x[order][first]
            doubted = top[(z[top] <= 0) & (z[top] > -3) & ~in_good[top]]
            y[doubted], weight[doubted] = 1.0, 0.5
        y[n:], weight[n:] = 1.0, 0.5
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, most_each: int = 1500, most_chars: int = 20_000) -> list[tuple[str, int]]:
    """At most ``most_each`` documents of either mark, chosen by hash, up to ``most_chars`` long; documents whose raters tie are left out.  This bounds what the driver holds."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.avg("toxic").alias("m")).filter("m <> 0.5").withColumn("y", (F.col("m") > 0.5).cast("int"))
    picked = None
    for y in (0, 1):
        one = marks.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most_each).select("doc_id", "y")
        picked = one if picked is None else picked.unionByName(one)
    rows = docs.select("doc_id", "text").filter(F.length("text") <= most_chars).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return [(r["text"], r["y"]) for r in rows]


def scored(docs: DataFrame, id_col: str, model: Model, text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` of every row, the worst sentence's probability; 0 for texts without a letter or digit, null ids kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [prepared(t) for t in part.column(1).to_pylist()]
                codes = code_points("\n".join(texts))
                s, e = pieces(codes)
                score = np.zeros(len(texts))
                if len(s):
                    lens = np.array([len(t) + 1 for t in texts])
                    np.maximum.at(score, np.searchsorted(np.cumsum(lens), s, "right"), m.scores(codes, s, e))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(step, "id bigint, score double")


def trained(docs: DataFrame, labels: DataFrame, terms: DataFrame, **options) -> Model:
    """A model from the bounded sample and the list ``terms``, which is one for people to keep, not data: all of it goes to the driver."""
    known = [r[0] for r in terms.filter("term is not null").select("term").distinct().collect()]
    return fit(labelled_sample(docs, labels), known, **options)
