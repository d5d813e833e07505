"""Whole preparations of data sets, each with the gates it must pass: what comes out, and a report of violations.

Every pipeline returns its tables and ``gates``; with ``enforce=True`` it raises ``GateError`` before anything is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.readers import content_digest
from . import chunks, quality, splits
from .order import row_numbers


def _gate(name: str, value) -> DataFrame:
    """One gate from a table of one row with one number."""
    return value.select(F.lit(name).alias("gate"), F.col(value.columns[0]).cast("bigint").alias("violations"))


def _rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def _difference(name: str, left: DataFrame, *right: DataFrame) -> DataFrame:
    """Gate: how far the rows of ``left`` are from those of all of ``right`` together."""
    one = _rows(left).withColumnRenamed("n", "a")
    for k, r in enumerate(right):
        one = one.crossJoin(F.broadcast(_rows(r).withColumnRenamed("n", f"b{k}")))  # one row each
    return _gate(name, one.select(F.abs(F.col("a") - sum((F.col(f"b{k}") for k in range(len(right))), F.lit(0)))))


def _empty(name: str, df: DataFrame) -> DataFrame:
    return _gate(name, _rows(df).select((F.col("n") == 0).cast("bigint")))


def _finished(out: dict, enforce: bool) -> dict:
    out["gates"] = quality.enforce(out["gates"]) if enforce else quality.report(out["gates"])
    return out


def prepare(source: DataFrame, held: DataFrame, exclude: DataFrame, k: int, seed: int = 42, enforce: bool = True) -> dict:
    """Training rows without any held-out text, held-out rows, the held-out texts that were never seen (``exclude``), and a sample of ``k`` training texts for a tokenizer.

    All tables have ``key`` (``splits.keyed``).  Gates: rows in are rows out; no text is both in training and held out, excluded
    and held out, or sampled and held out; something is left to train on; the sample has ``k`` texts if there are so many.
    """
    parts = splits.holdout(source, held, exclude)
    sample = splits.sample(parts["train"], k, seed)
    short = splits.distinct_keys(parts["train"]).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(_rows(sample).withColumnRenamed("n", "got")))  # one row each
    gates = [
        _difference("source_rows", source, parts["train"], parts["heldout"]), quality.overlap(parts["train"], parts["val"], "train_val", "key"),
        quality.overlap(exclude, parts["val"], "exclude_val", "key"), quality.overlap(sample, parts["val"], "sample_val", "key"),
        _empty("train_empty", parts["train"]), _gate("sample_size", short.select(F.abs(F.least("n", F.lit(k)) - F.col("got")))),
    ]
    return _finished({**parts, "sample": sample, "gates": gates}, enforce)


def make_val_large(train: DataFrame, line: str, old: DataFrame, old_order: str, target: int, enforce: bool = True) -> dict:
    """The frozen evaluation set (the old one in its order, then new texts by hash, up to ``target``) and the training rows without it.

    ``frozen``: i, key, is_new, line (of a new text, the first of its rows).  Gates: no duplicates among the old; enough new
    texts; the size is ``target``; no duplicates; the old ones keep rows [0, k) in their order; every new text is captured once; no
    frozen text is left in training; rows read less rows dropped are rows written; something is left to train on.
    """
    was = splits.first_of_each(old, old_order)
    frozen = splits.freeze(train, old, old_order, target)
    new = frozen.filter("is_new = 1")
    captured = splits.first_of_each(train.join(new.select("key"), "key", "left_semi"), line).select("key", F.col(line).cast("bigint").alias("line"))
    rows = frozen.join(captured, "key", "left").select("i", "key", "is_new", "line")
    kept, dropped = train.join(frozen.select("key"), "key", "left_anti"), train.join(frozen.select("key"), "key", "left_semi")
    size = _rows(frozen).select(F.abs(F.col("n") - target))
    order = row_numbers(was.select("key", F.col(old_order).alias("ord")), ["ord", "key"], "j").join(frozen.select("key", "i"), "key", "left")
    gates = [
        quality.duplicates(old, "old_duplicates", ["key"]), _gate("new_missing", _rows(frozen).select(F.greatest(F.lit(target) - F.col("n"), F.lit(0)))), _gate("size", size),
        quality.duplicates(frozen, "frozen_duplicates", ["key"]), quality.rows(order, "prefix_moved", ~F.col("i").eqNullSafe(F.col("j"))), quality.missing(new, captured, "not_captured", "key"),
        quality.overlap(kept, frozen, "train_frozen", "key"), _difference("train_rows", train, kept, dropped), _empty("train_empty", kept),
    ]
    return _finished({"frozen": rows, "train": kept, "dropped": dropped, "gates": gates}, enforce)


def apply_removal(frozen: DataFrame, flagged: DataFrame, scanned: int, train_rows: int, prefix: int, digest: str | None = None, enforce: bool = True) -> dict:
    """A frozen set (i, key) without the rows ``flagged`` (i) by an audit, numbered anew, and the record of the removal.

    ``scanned`` of ``train_rows`` training rows were audited; ``prefix``: rows of the historical part; ``digest``: of i and key before.
    Gates: the set is the one audited; the whole of training was scanned; every flag is a row of the set; rows before less rows
    removed are rows after; what stays keeps its order.
    """
    before = content_digest(frozen, ["i", "key"])
    hit = flagged.select("i").distinct()
    kept = row_numbers(frozen.join(hit, "i", "left_anti").withColumnRenamed("i", "was"), ["was"], "i").select("i", "key", "was")
    removed = frozen.join(hit, "i", "left_semi")
    w = Window.partitionBy(F.expr("i div 65536")).orderBy("i")
    moved = kept.withColumn("bad", F.coalesce(F.col("was") <= F.lag("was").over(w), F.lit(False)) | (F.col("was") < F.col("i")))
    record = removed.agg(F.count(F.lit(1)).alias("removed"), F.coalesce(F.sum((F.col("i") < prefix).cast("bigint")), F.lit(0)).alias("removed_of_prefix"))
    record = record.crossJoin(F.broadcast(_rows(frozen).withColumnRenamed("n", "rows_before"))).crossJoin(F.broadcast(_rows(kept).withColumnRenamed("n", "rows_after")))  # one row each
    record = record.select("rows_before", "rows_after", "removed", "removed_of_prefix", (F.lit(prefix) - F.col("removed_of_prefix")).alias("prefix_after"), F.when(F.col("rows_before") > 0, F.round(F.col("removed") / F.col("rows_before"), 6)).alias("hit_rate"), F.lit(scanned).cast("bigint").alias("train_rows_scanned"), F.lit(True).alias("frozen"))
    gates = [
        _gate("other_set", before.select((F.lit(digest is not None) & (F.col("digest").cast("string") != F.lit(digest or ""))).cast("bigint"))), _gate("partial_scan", before.select(F.lit(abs(train_rows - scanned)))),
        quality.missing(hit, frozen, "unknown_rows", "i"), _difference("rows", frozen, kept, removed), quality.rows(moved, "order_moved", F.col("bad")),
    ]
    return _finished({"kept": kept, "record": record, "gates": gates}, enforce)


def rebuild(manifest: DataFrame, upstream: DataFrame, order: str, text: str = "text", digest: str | None = None, enforce: bool = True) -> dict:
    """The texts of a manifest from their source: i, sha256, text.

    Gates: the manifest is well formed, numbers its rows once and without a gap from 0; every text is found; the digest of i and
    sha256 is the expected one.
    """
    form = manifest["i"].isNull() | manifest["sha256"].isNull() | ~manifest["sha256"].rlike("^[0-9a-fA-F]{64}$")
    found = splits.rebuild(manifest, upstream, order)
    texts = upstream.groupBy("key").agg(F.min(F.struct(order, text)).alias("x")).select(F.col("key").alias("sha256"), F.col(f"x.{text}").alias("text"))
    span = manifest.agg(F.coalesce(F.max("i") + 1 - F.countDistinct("i"), F.lit(0)).alias("gap"))
    got = content_digest(found, ["i", "sha256"])
    gates = [
        quality.rows(manifest, "form", F.coalesce(form, F.lit(True))), quality.duplicates(manifest.filter("i is not null"), "repeated", ["i"]), _gate("gaps", span),
        quality.rows(found, "missing", F.col("line").isNull()), _gate("digest", got.select((F.lit(digest is not None) & (F.col("digest").cast("string") != F.lit(digest or ""))).cast("bigint"))),
    ]
    return _finished({"texts": found.filter("line is not null").join(texts, "sha256").select("i", "sha256", "text"), "gates": gates}, enforce)


def common_chunks(docs: DataFrame, doc: str, ends: dict, budget: int, enforce: bool = True) -> dict:
    """Spans of text that keep within ``budget`` tokens of every tokenizer of ``ends``, cut by the first of them.

    ``ends``: name -> function of a text that gives where each token ends.  ``chunks``: the spans, and tokens by tokenizer.
    Gates: spans over the budget for each tokenizer; documents that the spans don't cover; nothing at all.  Texts are cut and counted
    once, whatever reads the tables.
    """
    cutter = next(iter(ends.values()))
    spans = materialize(chunks.token_chunks(docs, doc, cutter, budget), "spans")
    counted = materialize(chunks.count_tokens(spans, docs, doc, ends), "counted")
    cover = chunks.contiguity(spans.withColumnRenamed(doc, "doc") if doc != "doc" else spans, docs.filter(F.length("text") > 0), doc)
    gates = [quality.rows(counted, f"over_{name}", F.col(f"tokens_{name}") > budget) for name in ends]
    gates += [quality.rows(cover, "uncovered", ~F.col("covers")), _empty("empty", spans)]
    return _finished({"chunks": counted, "gates": gates}, enforce)
