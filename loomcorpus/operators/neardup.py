"""Containment audit: which evaluation documents stand, window by window, in training documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_windows
from ..session import materialize, spread
from .order import row_numbers

#: Windows of evaluation documents up to this number are broadcast (under 200 MB); more are joined by shuffle.
BROADCAST_WINDOWS = 400_000
#: Upper ends of the histogram's buckets and their names, and the grid of coverages.
BUCKETS = ((1, "1"), (2, "2"), (10, "3-10"), (100, "11-100"), (1000, "101-1000"), (None, ">1000"))
COVERAGES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
LEAST_HITS = (1, 2, 3, 4, 5)


@dataclass(frozen=True)
class Rule:
    size: int = 64
    stride: int = 32
    min_hits: int = 3
    min_coverage: float = 0.5
    full_containment: float = 0.98
    max_doc_freq: int = 100

    def __post_init__(self) -> None:
        """Windows must overlap or touch, counts be at least 1, and shares lie in (0, 1]."""
        bad = [n for n in ("size", "stride", "min_hits", "max_doc_freq") if getattr(self, n) < 1]
        bad += [n for n in ("min_coverage", "full_containment") if not 0 < getattr(self, n) <= 1]
        if self.stride > self.size:
            bad.append("stride over size")
        if bad:
            raise ValueError("out of range: " + ", ".join(bad))


def windows(df: DataFrame, doc: str, text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row per window: doc, n (length of the text), s, e, w.  Null texts give none."""
    return spread(df.select(doc, text)).select(F.col(doc).alias("doc"), F.char_length(text).alias("n"), F.explode(char_windows(text, rule.size, rule.stride)).alias("x")).select("doc", "n", "x.s", "x.e", "x.w")


class Audit:
    """All results of one audit, each from the same two written tables."""

    def __init__(self, val: DataFrame, val_doc: str, train: DataFrame, train_doc: str, text: str = "text", rule: Rule = Rule()):
        self.rule = rule
        self.val_windows = materialize(windows(val, val_doc, text, rule).withColumn("h", F.xxhash64("w")), "val_windows")
        own = self.val_windows.select("h", "w").distinct()
        own = F.broadcast(own) if self.val_windows.count() <= BROADCAST_WINDOWS else own
        seen = windows(train, train_doc, text, rule).withColumn("h", F.xxhash64("w")).join(own, ["h", "w"], "left_semi")
        self.matches = materialize(seen.select(F.col("doc").alias("line"), "h", "w").distinct(), "matches")
        self.val = self.val_windows.groupBy("doc", "n").agg(F.count(F.lit(1)).alias("n_windows"))

    def doc_freq(self) -> DataFrame:
        """Training documents per window: w, h, df."""
        return self.matches.groupBy("h", "w").agg(F.count(F.lit(1)).alias("df"))

    def histogram(self) -> DataFrame:
        """Windows per bucket of document frequency; empty buckets are there."""
        b = F.lit(BUCKETS[-1][1])
        for top, name in reversed(BUCKETS[:-1]):
            b = F.when(F.col("df") <= top, F.lit(name)).otherwise(b)
        counts = self.doc_freq().groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("windows"))
        names = F.broadcast(self.matches.sparkSession.createDataFrame([(x,) for _, x in BUCKETS], "bucket string"))
        return names.join(counts, "bucket", "left").select("bucket", F.coalesce("windows", F.lit(0)).alias("windows"))

    def _tagged(self) -> DataFrame:
        """Evaluation windows that stand in training documents, with whether they are templates."""
        freq = self.doc_freq().withColumn("template", F.col("df") > self.rule.max_doc_freq).select("h", "w", "template")
        return self.val_windows.join(freq, ["h", "w"])

    def _scored(self, joined: DataFrame) -> DataFrame:
        """Hits and merged cover of every pair, from its common windows: doc, line, n, s, e, h, w, template."""
        before = Window.partitionBy("doc", "line").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        added = lambda reach: F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(reach, F.col("s"))))
        raw, flt = added(F.max("e").over(before)), added(F.max(F.when(~F.col("template"), F.col("e"))).over(before))
        rows = joined.select("doc", "line", "n", "template", "h", "w", raw.alias("raw"), F.when(F.col("template"), 0).otherwise(flt).alias("flt"))
        kinds = rows.groupBy("doc", "line", "n", "template").agg(F.countDistinct("h", "w").alias("hits"), F.sum("raw").alias("raw"), F.sum("flt").alias("flt"))  # a window is a template or not wherever it stands
        total = lambda c: F.sum(c).cast("bigint")
        own = F.when(F.col("template"), 0).otherwise(F.col("hits"))
        out = kinds.groupBy("doc", "line", "n").agg(total("hits").alias("hits_raw"), total("raw").alias("covered_raw"), total(own).alias("hits_flt"), total("flt").alias("covered_flt"))
        cov = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.lit(1.0))
        return out.withColumn("coverage_raw", cov("covered_raw")).withColumn("coverage_flt", cov("covered_flt"))

    def pairs(self) -> DataFrame:
        """Every pair with a common window: doc, line, n, hits and covered characters, raw and without template windows.

        Pairs that share nothing but templates are listed too, so where boilerplate is common on both sides the
        result itself is large; ``flagged`` does not go through this list.
        """
        return self._scored(self._tagged().join(self.matches, ["h", "w"]))

    def flagged(self) -> DataFrame:
        """Pairs that count as leaks, and by which rule.

        A pair qualifies through a window that is no template, of which each has at most ``max_doc_freq`` lines,
        or by templates alone if these cover the evaluation text to ``full_containment``; so only pairs of the first
        kind, and all pairs of such boilerplate texts, are scored.
        """
        r = self.rule
        tagged = materialize(self._tagged(), "tagged")
        by_window = tagged.filter("not template").join(self.matches, ["h", "w"]).select("doc", "line").distinct()
        cover = Window.partitionBy("doc").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        added = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(F.max("e").over(cover), F.col("s"))))
        plain = tagged.filter("template").withColumn("add", added).groupBy("doc", "n").agg(F.sum("add").alias("c")).filter(F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(1.0) >= r.full_containment).select("doc")
        by_plain = tagged.filter("template").join(plain, "doc", "left_semi").join(self.matches, ["h", "w"]).select("doc", "line").distinct()
        wanted = materialize(by_window.unionByName(by_plain).distinct(), "wanted")
        joined = wanted.join(tagged, "doc").join(self.matches, ["line", "h", "w"], "left_semi")
        p = self._scored(joined).join(self.val.select("doc", "n_windows"), "doc")
        by_cover = (F.col("hits_flt") >= F.least(F.lit(r.min_hits), F.col("n_windows"))) & (F.col("coverage_flt") >= r.min_coverage)
        full = F.col("coverage_raw") >= r.full_containment
        return p.filter(by_cover | full).withColumn("rule", F.when(by_cover, "coverage").otherwise("full_containment"))

    def _distinct_lines(self) -> DataFrame:
        """The matches of one line for each set of matched windows: lines that share nothing but the same boilerplate are one, whatever their number.

        Sets are told apart by two 64-bit sums without carry over their windows, and their sizes.
        """
        signs = [F.bit_xor(F.xxhash64("w", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
        per = self.matches.groupBy("line").agg(*signs, F.count(F.lit(1)).alias("n"))
        return self.matches.join(per.groupBy("x1", "x2", "n").agg(F.min("line").alias("line")).select("line"), "line", "left_semi")

    def best(self) -> DataFrame:
        """Per evaluation document with any match the maxima over its pairs, worked out from one line for each set of windows."""
        pairs = self._scored(self._tagged().join(materialize(self._distinct_lines(), "lines"), ["h", "w"]))
        flt = [F.max(F.when(F.col("hits_flt") >= m, F.col("coverage_flt"))).alias(f"best_{m}") for m in LEAST_HITS]
        return pairs.groupBy("doc").agg(F.max("hits_raw").alias("best_hits"), F.max("coverage_raw").alias("best_coverage"), *flt)

    def sensitivity_hits(self) -> DataFrame:
        """Evaluation documents with at least m common windows with one training document."""
        n = self.val.count()
        aggs = [F.sum((F.col("best_hits") >= m).cast("int")).alias(f"m{m}") for m in LEAST_HITS]
        one = self.best().agg(*aggs)
        rows = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.coalesce(F.col(f"m{m}"), F.lit(0)).cast("bigint").alias("docs")) for m in LEAST_HITS])).alias("x")
        return one.select(rows).select("x.m", "x.docs", F.round(F.col("x.docs") / F.lit(max(n, 1)), 6).alias("rate"))

    def sensitivity_grid(self) -> DataFrame:
        """The same for every least number of hits and coverage."""
        aggs = [F.sum((F.coalesce(F.col(f"best_{m}"), F.lit(0.0)) >= c).cast("int")).alias(f"m{m}_{k}") for m in LEAST_HITS for k, c in enumerate(COVERAGES)]
        rows = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(c).alias("c"), F.coalesce(F.col(f"m{m}_{k}"), F.lit(0)).cast("bigint").alias("docs")) for m in LEAST_HITS for k, c in enumerate(COVERAGES)])).alias("x")
        return self.best().agg(*aggs).select(rows).select("x.*")

    def top_hits(self, most: int = 20) -> DataFrame:
        """The first flagged lines of each evaluation document, and how many there are."""
        w = Window.partitionBy("doc")
        ranked = self.flagged().withColumn("rank", F.row_number().over(w.orderBy("line"))).withColumn("matched", F.count(F.lit(1)).over(w))
        return ranked.filter(F.col("rank") <= most)

    def kept(self) -> DataFrame:
        """Evaluation documents without a flag, numbered anew in their order: doc, i."""
        return row_numbers(self.val.select("doc").join(self.flagged().select("doc").distinct(), "doc", "left_anti"), ["doc"], "i")
