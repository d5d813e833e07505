"""Bits per byte and the statistics of ratios: delta-method errors, paired differences, bootstrap."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded

LN2 = math.log(2)


def clean_eval(rows: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """One row per arm and document: arm, doc, utf8_bytes, tokens, nll.

    Rows without a likelihood are left out, repeated ones count once; where ``truth`` (doc,
    true_bytes) is given, its sizes replace the stated ones.
    """
    one = rows.filter("arm is not null and doc is not null and nll_nats is not null").groupBy("arm", "doc").agg(F.max(F.struct("nll_nats", "utf8_bytes", "tokens", "chunks")).alias("x")).select("arm", "doc", F.col("x.utf8_bytes").alias("utf8_bytes"), F.col("x.tokens").alias("tokens"), F.col("x.nll_nats").alias("nll"), F.col("x.chunks").alias("chunks"))
    return one if truth is None else one.drop("utf8_bytes").join(truth.select("doc", F.col("true_bytes").alias("utf8_bytes")), "doc")


def bpb(nll: str = "nll", nbytes: str = "utf8_bytes") -> Column:
    """Aggregate: bits per byte; null where there are no bytes."""
    total = F.sum(nbytes)
    return F.when(total > 0, F.sum(nll) / (LN2 * total))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Documents, totals, loss, perplexity and bits per byte per group."""
    loss = F.when(F.sum("tokens") > 0, F.sum("nll") / F.sum("tokens"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.sum("utf8_bytes").alias("bytes"), F.round(loss, 6).alias("loss"), F.round(F.exp(loss), 4).alias("ppl"), F.round(bpb(), 6).alias("bpb"))


def _moments(y: str, x: str, tag: str = "") -> list[Column]:
    """Sums from which a ratio and its error follow, so that one pass with partial aggregation is enough."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return [F.count(F.lit(1)).alias(f"n{tag}"), F.sum(a).alias(f"y{tag}"), F.sum(b).alias(f"x{tag}"), F.sum(a * a).alias(f"yy{tag}"), F.sum(a * b).alias(f"xy{tag}"), F.sum(b * b).alias(f"xx{tag}")]


def _ratio(tag: str = "") -> Column:
    return F.try_divide(F.col(f"y{tag}"), F.col(f"x{tag}"))


def _error(tag: str = "") -> Column:
    """sqrt(n var(y - R x)) / sum(x); the residuals y - R x sum to 0, so their squares are all their variance needs."""
    r, n = _ratio(tag), F.col(f"n{tag}")
    squares = F.greatest(F.lit(0.0), F.col(f"yy{tag}") - 2 * r * F.col(f"xy{tag}") + r * r * F.col(f"xx{tag}"))
    return F.when(n >= 2, F.try_divide(F.sqrt(n * F.try_divide(squares, n - 1)), F.col(f"x{tag}")))


def ratio_se(rows: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """Sum(y)/Sum(x) and its delta-method standard error per group: n, ratio, se (null under two rows)."""
    return rows.groupBy(*(by or [])).agg(*_moments(y, x)).select(*(by or []), "n", _ratio().alias("ratio"), _error().alias("se"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two evaluations side by side by document: doc, nll_a, nll_b, utf8_bytes, aligned (on both sides, with equal bytes)."""
    x = a.select("doc", F.col("nll").alias("nll_a"), F.col("utf8_bytes").alias("bytes_a"))
    y = b.select("doc", F.col("nll").alias("nll_b"), F.col("utf8_bytes").alias("bytes_b"))
    return x.join(y, "doc", "full").withColumn("aligned", F.coalesce(F.col("bytes_a") == F.col("bytes_b"), F.lit(False)))


def paired_se(pairs: DataFrame) -> DataFrame:
    """Bits-per-byte difference a - b with unpaired and paired standard errors, and the gain of pairing."""
    p = pairs.filter("aligned").select((F.col("nll_a") / LN2).alias("ya"), (F.col("nll_b") / LN2).alias("yb"), F.col("bytes_a").alias("x")).withColumn("yd", F.col("ya") - F.col("yb"))
    one = p.agg(*[m for y in ("ya", "yb", "yd") for m in _moments(y, "x", f"_{y}")])
    cols = [_ratio("_ya").alias("bpb_a"), _ratio("_yb").alias("bpb_b"), _ratio("_yd").alias("delta"), F.hypot(_error("_ya"), _error("_yb")).alias("unpaired_se"), _error("_yd").alias("paired_se")]
    return one.select(F.col("n_ya").alias("n"), *cols).withColumn("gain", F.try_divide("unpaired_se", "paired_se"))


def bootstrap(pairs: DataFrame, resamples: int, seed: int = 0) -> DataFrame:
    """Paired bootstrap by hashed Poisson-free draws: r, num (nats of a - b, in millionths) and den (bytes) per resample.

    Draw j of resample r is document ``hash60("seed:r:j") mod n``, the same in any engine.  Instead of n draws
    per resample meeting the documents in a join, draws are counted first: (r, j) -> multiplicity, so the join has at most one
    row per resample and document.
    """
    from .order import row_numbers

    p = row_numbers(pairs.filter("aligned").select("doc", F.round((F.col("nll_a") - F.col("nll_b")) * 1e6).cast("bigint").alias("d"), F.col("bytes_a").alias("x")), ["doc"], "j")
    spark = pairs.sparkSession
    n = p.count()
    draws = spark.range(0, n * resamples).select((F.col("id") % resamples).alias("r"), F.expr(f"id div {resamples}").alias("k"))
    drawn = draws.select("r", (seeded(seed, "r", "k") % max(n, 1)).alias("j")).groupBy("r", "j").agg(F.count(F.lit(1)).alias("times"))
    return drawn.join(p, "j").groupBy("r").agg(F.sum(F.col("times") * F.col("d")).alias("num"), F.sum(F.col("times") * F.col("x")).alias("den"))


def interval(resampled: DataFrame, resamples: int, level: float = 0.95) -> DataFrame:
    """Mean, standard deviation, floor-indexed interval, least detectable effect and whether zero is outside.  ``resampled`` has one row per resample, a fixed number."""
    v = F.try_divide(F.col("num") / 1e6, LN2 * F.col("den"))
    ranked = resampled.select(v.alias("v")).withColumn("k", F.row_number().over(Window.orderBy("v")) - 1)
    lo, hi = math.floor((1 - level) / 2 * resamples + 1e-9), min(math.floor((1 + level) / 2 * resamples + 1e-9), resamples - 1)
    one = ranked.agg(F.count(F.lit(1)).alias("resamples"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.max(F.when(F.col("k") == lo, F.col("v"))).alias("lo"), F.max(F.when(F.col("k") == hi, F.col("v"))).alias("hi"))
    return one.select("resamples", *[F.round(c, 8).alias(c) for c in ("mean", "sd", "lo", "hi")], F.round(2 * F.col("sd"), 8).alias("mde"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))


def exact_bootstrap(rows: list[tuple[float, float, int]], spark, resamples: int, seed: int = 0) -> DataFrame:
    """The resamples of Python's ``random.Random(seed)``, for bit parity on a bounded list of (nll_a, nll_b, bytes): r, delta.

    The generator is sequential, so each task replays the draws before its own resamples.
    """
    held = spark.sparkContext.broadcast(rows)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = held.value
        n = len(data)
        for b in batches:
            want = sorted(b.column(0).to_pylist())
            rng, at, out = random.Random(seed), 0, []
            for r in want:
                for _ in range((r - at) * n):
                    rng.randrange(n)
                idx = [rng.randrange(n) for _ in range(n)]
                at = r + 1
                den = sum(data[i][2] for i in idx) * LN2
                out.append((sum(data[i][0] for i in idx) - sum(data[i][1] for i in idx)) / den)
            if want:
                yield pa.RecordBatch.from_arrays([pa.array(want, pa.int64()), pa.array(out, pa.float64())], names=["r", "delta"])

    return spark.range(resamples).mapInArrow(step, "r bigint, delta double")


def mirror_confusion(rows: DataFrame, window: int = 510) -> DataFrame:
    """Per tokenizer (column ``tok``) the chunks its windows make: docs, tokens, chunks, docs with several, share of their bytes.  ``rows``: tok, doc, tokens, bytes."""
    c = F.ceil(F.col("tokens") / F.lit(window)).cast("bigint")
    many = c > 1
    return rows.withColumn("c", c).groupBy("tok").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.sum("c").alias("chunks"), F.sum(many.cast("bigint")).alias("multi_docs"), F.round(F.try_divide(100 * F.sum(F.when(many, F.col("bytes")).otherwise(0)), F.sum("bytes")), 4).alias("multi_bytes_pct"))


def extra_chunks(confusion: DataFrame, a: str, b: str) -> DataFrame:
    """How many chunks more tokenizer ``a`` makes than ``b``, and by how many percent its context begins anew more often: from ``mirror_confusion``."""
    of = lambda t: F.max(F.when(F.col("tok") == t, F.col("chunks")))
    one = confusion.agg(of(a).alias("chunks_a"), of(b).alias("chunks_b"))
    return one.select("chunks_a", "chunks_b", (F.col("chunks_a") - F.col("chunks_b")).alias("extra_chunks"), F.round(F.try_divide(100 * (F.col("chunks_a") - F.col("chunks_b")), F.col("chunks_b")), 4).alias("extra_resets_pct"))
