"""Scorers that stand in for a model: likelihoods in nats from token counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points there can be; a table of counts per code point never has more rows, so it may be broadcast.
CODE_POINTS = 0x110000


def uniform(tokens: str, vocab: int) -> Column:
    """NLL of a model that knows nothing: n ln V."""
    return F.col(tokens) * F.lit(math.log(vocab))


def char_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Code points and how often they occur: ch, c.  Counted by batch before anything is shuffled."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODE_POINTS, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                s = "".join(t for t in b.column(0).slice(lo, 1024).to_pylist() if t)
                c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
                if len(c):
                    total += np.bincount(c, minlength=CODE_POINTS)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["ch", "c"])

    return docs.select(text).mapInArrow(step, "ch int, c bigint").groupBy("ch").agg(F.sum("c").alias("c"))


def doc_char_counts(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """The same per document: doc, ch, c."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, chs, cs = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    u, n = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
                    ids.append(np.full(len(u), i, np.int64))
                    chs.append(u.astype(np.int32))
                    cs.append(n.astype(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, chs, cs)], names=["doc", "ch", "c"])

    return docs.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint"), text).mapInArrow(step, "doc bigint, ch int, c bigint")


def unigram(docs: DataFrame, doc: str, counts: DataFrame, text: str = "text") -> DataFrame:
    """NLL under add-one smoothed code-point frequencies, one more for the unseen: doc, tokens, nll.  Empty texts give no row."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    probs = counts.withColumnRenamed("c", "seen")
    own = doc_char_counts(docs, doc, text).join(F.broadcast(probs), "ch", "left").join(F.broadcast(total), how="cross")  # at most CODE_POINTS rows, and one row
    p = (F.coalesce("seen", F.lit(0)) + 1) / (F.col("n") + F.col("v") + 1)
    return own.groupBy("doc").agg(F.sum("c").alias("tokens"), (-F.sum(F.col("c") * F.log(p))).alias("nll"))


def windowed(rows: DataFrame, score: Callable[[list[int]], float], window: int) -> DataFrame:
    """Scores (doc, ids) in windows of ``window`` body tokens, every token once, a one-token tail included: doc, tokens, chunks, nll.

    ``score`` gives the NLL of one window's tokens, each given those before it in the window.
    """
    schema = pa.schema([("doc", pa.int64()), ("tokens", pa.int64()), ("chunks", pa.int64()), ("nll", pa.float64())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = [ids[i : i + window] for i in range(0, len(ids), window)]
                out.append((doc, len(ids), len(parts), sum(score(p) for p in parts)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.select("doc", "ids").mapInArrow(step, "doc bigint, tokens bigint, chunks bigint, nll double")
