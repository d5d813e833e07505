"""Evaluation chunks: spans of at most ``budget`` tokens that cover a document without loss."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_widths
from ..session import spread
from .joins import join_keyed

#: Tokens given back at most, when a cut-out stretch encodes to more tokens than it had inside its document.
MOST_BACK = 128


#: Tokens beyond the budget that are looked at, so that the end of what is encoded has no influence.
EDGE = 32

#: Letters that are looked at for a span, as a multiple of those of the one before.
AHEAD = 2


def char_chunks(docs: DataFrame, doc: str, budget: int = 510, text: str = "text") -> DataFrame:
    """Chunks of ``budget`` code points: doc, chunk, cs, ce, utf8_bytes.  Null and empty texts give none."""
    n = F.char_length(text)
    parts = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{budget}}}"), F.lit(0))
    got = docs.filter(n > 0).select(F.col(doc).alias("doc"), n.alias("n"), F.posexplode(parts).alias("k", "part"))
    return got.select("doc", F.col("k").cast("bigint").alias("chunk"), (F.col("k") * budget).cast("bigint").alias("cs"), F.least((F.col("k") + 1) * budget, F.col("n")).cast("bigint").alias("ce"), F.octet_length("part").cast("bigint").alias("utf8_bytes"))


def chunk_ends(text: str, ends: Callable[[str], list[int]], budget: int) -> list[tuple[int, int, int]]:
    """Greedy spans with their tokens: the first ``budget`` tokens of the rest, shortened token by token until the span alone encodes within the budget.

    ``ends`` gives, for each token of a text, the code point where it ends.
    """
    out, cs, guess = [], 0, budget * 2
    while cs < len(text):
        rest = text[cs : cs + guess]
        marks = ends(rest)
        while len(marks) < budget + EDGE and cs + len(rest) < len(text):  # the last tokens of a cut-off rest may be others than in the text
            guess *= 2
            rest = text[cs : cs + guess]
            marks = ends(rest)
        if len(marks) <= budget and cs + len(rest) == len(text):
            out.append((cs, len(text), len(marks)))
            break
        k = min(budget, len(marks))
        for back in range(MOST_BACK + 1):
            ce = marks[k - 1 - back] if k - 1 - back >= 0 else 0
            if ce <= 0:
                raise ValueError("a chunk does not advance")
            if (tokens := len(ends(rest[:ce]))) <= budget:
                break
        else:
            raise ValueError("no end within the budget")
        out.append((cs, cs + ce, tokens))
        cs += ce
        guess = ce * AHEAD  # as many letters for as many tokens, and some over
    return out


def token_chunks(docs: DataFrame, doc: str, ends: Callable[[str], list[int]], budget: int = 510, text: str = "text") -> DataFrame:
    """The same by tokens of any tokenizer: doc, chunk, cs, ce, utf8_bytes, tokens."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc", "chunk", "cs", "ce", "utf8_bytes", "tokens")])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, (s, e, n) in enumerate(chunk_ends(t, ends, budget)):
                    rows.append((i, k, s, e, len(t[s:e].encode("utf-8", "surrogatepass")), n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return spread(docs.filter(F.char_length(text) > 0).select(F.col(doc).cast("bigint"), text)).mapInArrow(step, ", ".join(f"{f.name} bigint" for f in schema))


def _spans_of(chunks: DataFrame, docs: DataFrame, doc: str, text: str, cols: list[str]) -> DataFrame:
    """doc, text, spans (structs of ``cols``): every text with the spans cut from it; repeated rows count once."""
    per = chunks.filter("doc is not null and cs is not null").select("doc", *cols).distinct().groupBy("doc").agg(F.collect_list(F.struct(*cols)).alias("spans"))  # a document's own spans
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return texts.join(per, "doc").select("doc", "text", "spans")


def count_tokens(chunks: DataFrame, docs: DataFrame, doc: str, ends: dict[str, Callable[[str], list[int]]], text: str = "text") -> DataFrame:
    """doc, chunk, cs, ce and tokens_<name> of every chunk for every tokenizer of ``ends``."""
    names = [f"tokens_{n}" for n in ends]
    schema = pa.schema([(c, pa.int64()) for c in ("doc", "chunk", "cs", "ce", *names)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, spans in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for s in spans:
                    e = len(t) if s["ce"] is None else s["ce"]
                    rows.append((i, s["chunk"], s["cs"], e, *(len(f(t[s["cs"] : e])) for f in ends.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return _spans_of(chunks, docs, doc, text, ["chunk", "cs", "ce"]).mapInArrow(step, ", ".join(f"{f.name} bigint" for f in schema))


def score_spans(chunks: DataFrame, docs: DataFrame, doc: str, ids: Callable[[str], list[int]], score: Callable[[list[int]], float], budget: int, text: str = "text") -> DataFrame:
    """Per document its spans scored one by one, the same spans for every tokenizer: doc, utf8_bytes, tokens, nll, chunks.

    A span over ``budget`` tokens raises: no score may come from a text that did not fit.
    """
    schema = pa.schema([("doc", pa.int64()), ("utf8_bytes", pa.int64()), ("tokens", pa.int64()), ("nll", pa.float64()), ("chunks", pa.int64())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, spans in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                tokens, nll, size = 0, 0.0, 0
                for s in sorted(spans, key=lambda s: s["cs"]):
                    part = t[s["cs"] : len(t) if s["ce"] is None else s["ce"]]
                    got = ids(part)
                    if len(got) > budget:
                        raise ValueError(f"span {s['cs']} of {i} has {len(got)} tokens, over {budget}")
                    tokens, nll, size = tokens + len(got), nll + score(got), size + len(part.encode("utf-8", "surrogatepass"))
                rows.append((i, size, tokens, nll, len(spans)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return _spans_of(chunks, docs, doc, text, ["chunk", "cs", "ce"]).mapInArrow(step, "doc bigint, utf8_bytes bigint, tokens bigint, nll double, chunks bigint")


def meta_problems(meta: dict, chunks_sha256: str, texts_sha256: str, tokenizer_sha256: str, max_seq_len: int) -> list[str]:
    """What forbids to score a chunk set: another file or text than stated, an unusable budget or one that leaves no room for the two marks of a
    sequence, no documents or chunks, no stated boundary overhead, or a tokenizer outside the family that it was cut for."""
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 1
    family = {v for k, v in meta.items() if k.startswith("tokenizer_") and k.endswith("_sha256")}
    checks = {
        "chunk file": meta.get("out_sha256") == chunks_sha256, "texts": meta.get("val_sha256") == texts_sha256, "budget": whole(meta.get("budget")),
        "budget over the sequence": not whole(meta.get("budget")) or meta["budget"] <= max_seq_len - 2, "documents": whole(meta.get("documents")), "chunks": whole(meta.get("chunks")),
        "boundary overhead": isinstance(meta.get("residual_boundary_token_overhead"), dict), "tokenizer family": tokenizer_sha256 in family,
    }
    return [name for name, ok in checks.items() if not ok]


def contiguity(chunks: DataFrame, docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Per document whether its chunks cover it: doc, chunks, n, gaps, covers.

    Repeated chunk rows count once; a null end is the end of the text; documents on one side only
    don't cover (n or chunks is null).  The first chunk must begin at 0, each other where the one before ends.
    """
    texts = docs.filter(F.col(text).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(F.min(F.char_length(text)).cast("bigint").alias("n"))
    rows = chunks.select("doc", "chunk", "cs", "ce").distinct()
    counts = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("rows_"))
    ended = join_keyed(rows, texts.join(counts, "doc"), ["doc"], "rows_").withColumn("ce", F.coalesce("ce", "n"))
    w = Window.partitionBy("doc").orderBy("chunk", "cs")
    gap = (F.col("cs") != F.coalesce(F.lag("ce").over(w), F.lit(0))).cast("bigint")
    per = ended.withColumn("gap", gap).groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"), F.sum("gap").alias("gaps"), F.max("ce").alias("last"))
    both = texts.join(per, "doc", "full").join(counts.select("doc"), "doc", "full")
    return both.select("doc", "chunks", "n", "gaps", F.coalesce((F.col("gaps") == 0) & (F.col("last") == F.col("n")), F.lit(False)).alias("covers"))


def measured(chunks: DataFrame, docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """True size of every chunk beside the stated one: doc, chunk, cs, ce, utf8_bytes, true_bytes."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc", "chunk", "cs", "ce", "utf8_bytes", "true_bytes")])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            flat, off = b.column(2).values, b.column(2).offsets.to_numpy()
            chunk, cs, stated = (flat.field(k) for k in ("chunk", "cs", "utf8_bytes"))
            ce = flat.field("ce").to_numpy(zero_copy_only=False)
            for row, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                s, e = int(off[row]), int(off[row + 1])
                cum = np.concatenate([[0], np.cumsum(char_widths(t))])  # bytes before each code point
                begin, end = cs.slice(s, e - s).to_numpy(), ce[s:e]
                end = np.where(np.isnan(end), len(t), end).astype(np.int64) if end.dtype.kind == "f" else end.astype(np.int64)
                size = np.maximum(cum[np.clip(end, 0, len(t))] - cum[np.clip(begin, 0, len(t))], 0)
                parts.append(pa.RecordBatch.from_arrays([pa.array(np.full(e - s, i)), chunk.slice(s, e - s), cs.slice(s, e - s), pa.array(end), stated.slice(s, e - s), pa.array(size)], schema=schema))
            yield from parts

    return _spans_of(chunks, docs, doc, text, ["chunk", "cs", "ce", "utf8_bytes"]).mapInArrow(step, ", ".join(f"{f.name} bigint" for f in schema))
