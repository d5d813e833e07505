"""Training ledgers: schedules, budgets, cumulative accounts, invariants."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import LN2

#: Cumulative counters of a ledger row.
COUNTERS = ("seqs_consumed", "tokens_cum", "targets_cum", "text_targets_cum", "structural_targets_cum", "positions_cum", "utf8_bytes_cum", "flops_nominal_cum")


def latest(ledger: DataFrame, keys: tuple[str, ...] = ("run_id", "step")) -> DataFrame:
    """One row per run and step, the one logged last (ties: the greatest row), as after a resume.  Rows without a step or run are left out."""
    rest = [c for c in ledger.columns if c not in keys]
    order = ["logged_at", *[c for c in rest if c != "logged_at"]]
    best = ledger.dropna(subset=list(keys)).groupBy(*keys).agg(F.max(F.struct(*order)).alias("x"))
    return best.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def per_update(ledger: DataFrame) -> DataFrame:
    """Increments of the counters per run and step (the first step's are its own totals)."""
    w = Window.partitionBy("run_id").orderBy("step")
    return ledger.select("run_id", "step", *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias("d_" + c.removesuffix("_cum")) for c in COUNTERS])


def cumulative(increments: DataFrame) -> DataFrame:
    """The inverse: running sums per run."""
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return increments.select("run_id", "step", *[F.sum("d_" + c.removesuffix("_cum")).over(w).alias(c) for c in COUNTERS])


def train_bpb(loss: str = "loss_nats_per_target", targets: str = "targets_cum", nbytes: str = "utf8_bytes_cum") -> Column:
    return F.when(F.col(nbytes) > 0, F.col(loss) * F.col(targets) / (LN2 * F.col(nbytes)))


def invariants(ledger: DataFrame) -> DataFrame:
    """Per run how many rows break each rule: counters never fall, targets are text plus structural ones, sizes are not negative."""
    w = Window.partitionBy("run_id").orderBy("step")
    falls = None
    for c in COUNTERS:
        one = F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False))
        falls = one if falls is None else falls | one
    split = F.coalesce(F.col("targets_cum") != F.col("text_targets_cum") + F.col("structural_targets_cum"), F.lit(False))
    negative = F.coalesce(F.col("utf8_bytes_cum") < 0, F.lit(False))
    marked = ledger.select("run_id", falls.cast("bigint").alias("falls"), split.cast("bigint").alias("split"), negative.cast("bigint").alias("negative"))
    return marked.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in ("falls", "split", "negative")])


def tail_mean(ledger: DataFrame, value: str, k: int = 20) -> DataFrame:
    """Per run the mean of the last ``k`` known values, the last one, and how many there were."""
    w = Window.partitionBy("run_id").orderBy(F.col("step").desc())
    known = ledger.filter(F.col(value).isNotNull()).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)
    return known.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("tail_mean"), F.round(F.max(F.when(F.col("k") == 1, F.col(value))), 6).alias("last"))


def lr_wsd(step: Column, total: int, lr: float, warmup: float = 0.02, decay: float = 0.1, floor: float = 0.1) -> Column:
    """Warm-up, stable, cosine decay to ``floor`` of the rate: the rate times a rise from 0 to 1 times a fall from 1 to ``floor``, each constant outside its own steps."""
    rise_steps, fall_steps = (max(1, int(share * total)) for share in (warmup, decay))
    rise = F.least((step + 1) / F.lit(float(rise_steps)), F.lit(1.0))
    fallen = F.greatest((step - total + fall_steps) / F.lit(float(fall_steps)), F.lit(0.0))
    return lr * rise * (1 - (1 - floor) * F.pow(F.sin(fallen * (math.pi / 2)), F.lit(2)))


def lr_cosine(step: Column, total: int, lr: float) -> Column:
    return lr * (0.1 + 0.45 * (1 + F.cos(F.lit(math.pi) * step / F.lit(float(total)))))


def flops_per_position(params: Column, layers: Column, hidden: Column, seq_len: int) -> Column:
    """6N + 12 L H S."""
    return 6 * params + 12 * layers * hidden * seq_len


def plan(tokens: int, batch: int, accum: int, seq_len: int) -> dict[str, int]:
    """Tokens per update and updates of a token budget."""
    per = batch * (seq_len - 1) * accum
    return {"tokens_per_update": per, "updates": -(-tokens // per)}


def retained(ledger: DataFrame, restored: int) -> DataFrame:
    """Rows that stay when a run resumes from ``restored``."""
    return ledger.filter(F.col("step") <= restored)


def bytes_agree(ledger: DataFrame, blocks: DataFrame, seqs: str = "seqs_consumed", nbytes: str = "utf8_bytes_cum") -> DataFrame:
    """Rows of ``ledger`` with ``block_bytes``, the packed bytes up to its last consumed block, and whether both sides agree.

    ``blocks``: seq_id (from 0), bytes_cum.  No block consumed is 0 bytes; a block that isn't there disagrees.
    """
    have = blocks.select((F.col("seq_id") + 1).alias(seqs), F.col("bytes_cum").alias("block_bytes"))
    both = ledger.join(have, seqs, "left").withColumn("block_bytes", F.when(F.col(seqs) == 0, F.lit(0)).otherwise(F.col("block_bytes")))
    return both.withColumn("agrees", F.coalesce(F.col("block_bytes") == F.col(nbytes), F.lit(False)))
