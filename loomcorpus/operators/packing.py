"""Padding-free packing of documents into fixed-length blocks, with exact byte accounting.

The stream is BOS + tokens + EOS of every document, in a given order, cut every ``seq_len``
tokens; what is left at the end is dropped.  Offsets are distributed prefix sums, and each
document contributes to the blocks it overlaps on its own, so nothing runs in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_widths  # noqa: F401
from . import quality
from .order import prefix_sums, row_numbers

BOS, EOS = 1, 2


def corpus(docs: DataFrame, doc: str, below: int | None = None, text: str = "text") -> DataFrame:
    """Documents with a text, their tokens (code points) and bytes; of those numbered ``below`` a limit, if one is given.  Raises where none is left."""
    some = docs.filter(F.col(text).isNotNull() if below is None else F.col(text).isNotNull() & (F.col(doc) < below))
    if some.isEmpty():
        raise ValueError("no documents")
    return some.select(doc, text, F.char_length(text).cast("bigint").alias("tokens"), F.octet_length(text).cast("bigint").alias("bytes"))


def offsets(docs: DataFrame, order: list[str], tokens: str = "tokens", nbytes: str = "bytes") -> DataFrame:
    """Adds start (stream position of BOS) and bytes_before, over the documents before in ``order``, which must be unique.

    Only order and sizes are sorted; all other columns come back by a join.
    """
    slim = docs.select(*order, tokens, nbytes, (F.col(tokens) + 2).alias("_len"))
    sums = prefix_sums(slim, order, {"start": "_len", "bytes_before": nbytes}).drop("_len")
    return sums if set(docs.columns) <= set(slim.columns) else docs.join(sums.select(*order, "start", "bytes_before"), order)


def totals(docs: DataFrame, seq_len: int, tokens: str = "tokens", nbytes: str = "bytes") -> DataFrame:
    """One row: documents, stream tokens, blocks, dropped tail, text and structural tokens, bytes, bytes per token."""
    one = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(tokens), F.lit(0)).alias("text_tokens"), F.coalesce(F.sum(nbytes), F.lit(0)).alias("bytes"))
    one = one.withColumn("structural_tokens", F.col("docs") * 2).withColumn("stream", F.col("text_tokens") + F.col("structural_tokens"))
    return one.select("docs", "text_tokens", "structural_tokens", "stream", F.expr(f"stream div {seq_len}").alias("n_seq"), (F.col("stream") % seq_len).alias("tail"), "bytes", F.when(F.col("stream") > 0, F.round(F.col("bytes") / F.col("stream"), 6)).alias("bytes_per_token"))


def block_bytes(placed: DataFrame, seq_len: int, n_seq: int, widths: Callable[[str], np.ndarray]) -> DataFrame:
    """bytes_cum of every block: bytes of all text whose tokens lie before the block's end: seq_id, bytes_cum.

    ``placed``: start, bytes_before, text.  ``widths`` gives the bytes of each token of a text.
    A block's number comes from the last document that touches it.
    """
    schema = pa.schema([("seq_id", pa.int64()), ("bytes_cum", pa.int64())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cums = [], []
            for start, before, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                cum = np.concatenate([[0], np.cumsum(widths(text))])
                blocks = np.arange(start // seq_len, (start + len(cum)) // seq_len + 1)  # the document takes len(cum) + 1 places
                blocks = blocks[blocks < n_seq]
                taken = np.clip((blocks + 1) * seq_len - start - 1, 0, len(cum) - 1)
                ids.append(blocks)
                cums.append(before + cum[taken])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(cums).astype(np.int64))], schema=schema)

    return placed.select("start", "bytes_before", "text").mapInArrow(step, "seq_id bigint, bytes_cum bigint").groupBy("seq_id").agg(F.max("bytes_cum").alias("bytes_cum"))


def blocks(placed: DataFrame, seq_len: int, n_seq: int, ids: Callable[[str], list[int]] | None = None, column: str = "text") -> DataFrame:
    """The packed blocks: seq_id, ids.  ``column`` holds each document's ids, or a text that ``ids`` encodes; a document yields one slice per block it touches."""
    schema = pa.schema([("seq_id", pa.int64()), ("at", pa.int32()), ("part", pa.list_(pa.int32()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs, places, parts, sizes = [], [], [], []
            starts, values = b.column(0).to_numpy(), b.column(1)
            for row in range(b.num_rows):
                own = ids(values[row].as_py()) if ids else values[row].values.to_numpy()
                stream = np.concatenate([[BOS], np.asarray(own, np.int32), [EOS]]).astype(np.int32)
                start = int(starts[row])
                cuts = np.arange(start // seq_len, (start + len(stream) - 1) // seq_len + 1)
                a, z = np.maximum(cuts * seq_len, start), np.minimum((cuts + 1) * seq_len, start + len(stream))
                k = cuts < n_seq
                if k.any():
                    seqs.append(cuts[k])
                    places.append((a - cuts * seq_len)[k])
                    sizes.append((z - a)[k])
                    parts.append(stream[: int(z[k][-1]) - start])
            if seqs:
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seqs).astype(np.int64)), pa.array(np.concatenate(places).astype(np.int32)), lists], schema=schema)

    parts = placed.select("start", column).mapInArrow(step, "seq_id bigint, at int, part array<int>")
    return parts.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p")).select("seq_id", F.flatten(F.col("p.part")).alias("ids"))  # seq_len numbers at most


def gates(block_table: DataFrame, cum: DataFrame, docs: DataFrame, recounted: DataFrame, key: str, seq_len: int, n_seq: int, vocab: int, pad: int = 0) -> list[DataFrame]:
    """What packed blocks must hold: all blocks of full length, ids within the vocabulary and no padding; every document's tokens counted
    again are those it was placed with; bytes never fall and end within the corpus.

    ``docs``: key, tokens, bytes as placed; ``recounted``: key, tokens of another count.
    """
    total = docs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    both = docs.select(key, "tokens").join(recounted.select(key, F.col("tokens").alias("again")), key, "full")
    ends = cum.crossJoin(F.broadcast(total))  # one row
    count = block_table.agg(F.abs(F.count(F.lit(1)) - F.lit(n_seq)).alias("violations")).select(F.lit("blocks").alias("gate"), "violations")
    return [
        count, quality.duplicates(block_table, "repeated_blocks", ["seq_id"]), quality.rows(block_table, "length", F.size("ids") != seq_len),
        quality.rows(block_table, "vocabulary", F.exists("ids", lambda x: (x < 0) | (x >= vocab))), quality.rows(block_table, "padding", F.exists("ids", lambda x: x == pad)),
        quality.rows(both, "tokens_recounted", ~F.col("tokens").eqNullSafe(F.col("again"))), quality.rows(deltas(cum), "bytes_fall", F.col("bytes_delta") < 0), quality.rows(ends, "bytes_over", F.col("bytes_cum") > F.col("total")),
    ]


def round_trip(block_table: DataFrame, placed: DataFrame, seq_len: int, decode: Callable[[list[int]], str], first: int = 1000) -> int:
    """How many of the documents that lie whole within the ``first`` blocks don't come back when the blocks are decoded; that many blocks and their texts reach the driver."""
    end = first * seq_len
    stream = [x for r in block_table.filter(F.col("seq_id") < first).orderBy("seq_id").collect() for x in r["ids"]]
    texts = placed.filter((F.col("start") + F.col("tokens") + 2 <= min(end, len(stream)))).select("start", "tokens", "text").collect()
    return sum(stream[r["start"]] != BOS or stream[r["start"] + r["tokens"] + 1] != EOS or decode(stream[r["start"] + 1 : r["start"] + 1 + r["tokens"]]) != r["text"] for r in texts)


def structural(block_table: DataFrame) -> DataFrame:
    """Targets of every block (all ids but the first), those of text and those that mark documents: seq_id, targets, text_targets, structural_targets."""
    marks = F.size(F.filter(F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))), lambda x: (x == BOS) | (x == EOS))).cast("bigint")
    n = F.greatest(F.size("ids") - 1, F.lit(0)).cast("bigint")
    return block_table.select("seq_id", n.alias("targets"), (n - marks).alias("text_targets"), marks.alias("structural_targets"))


def deltas(cum: DataFrame, ranges: int = 4096) -> DataFrame:
    """bytes of each block alone: seq_id, bytes_cum, bytes_delta (the first block's is its own bytes_cum)."""
    near = cum.select("seq_id", "bytes_cum", F.expr(f"seq_id div {ranges}").alias("r"))
    edge = near.filter(f"seq_id % {ranges} = {ranges - 1}").select((F.col("r") + 1).alias("r"), F.col("bytes_cum").alias("before"))
    w = Window.partitionBy("r").orderBy("seq_id")
    return near.join(edge, "r", "left").select("seq_id", "bytes_cum", (F.col("bytes_cum") - F.coalesce(F.lag("bytes_cum").over(w), "before", F.lit(0))).alias("bytes_delta"))


def updates(block_table: DataFrame, per_update: int) -> DataFrame:
    """Micro-batches summed to optimizer updates: step (from 1), seqs, bytes, and whatever else the blocks have of NLL and targets."""
    more = [c for c in ("nll", "targets", "text_targets", "structural_targets") if c in block_table.columns]
    return block_table.groupBy(F.expr(f"seq_id div {per_update} + 1").alias("step")).agg(F.count(F.lit(1)).alias("seqs"), F.sum("bytes_delta").alias("bytes"), *[F.sum(c).alias(c) for c in more])


def in_order(docs: DataFrame, order: list[str]) -> DataFrame:
    return row_numbers(docs, order, "pos")
