"""Problem 3: long exact spans shared between records.

A window is ``min_len`` neighbouring characters; a window is shared if the same window stands in
another record, and a character is shared if it lies in a shared window.  Comparing windows by
value needs no pairs of records at all:

1. Every window has an anchor: the least hash among its stretches of ``gram`` characters.
   Neighbouring windows with the same anchor form a run; a record has about two runs per
   ``min_len - gram`` characters.  Equal windows have equal anchors wherever they stand.
2. Count-min prefilter: sketches of the anchors, one per partition, are merged.  They may
   overestimate, never under, so only runs whose anchor is estimated to occur twice go on, and
   no shared window is lost.
3. Exact grouping of what is left: runs of equal text (anchor and run hash, 128 bits) form a
   class with its least and greatest record.  If those differ, all windows of the class are shared.
4. Where one anchor has several classes (estimated by a second sketch, over classes), the runs agree in part:
   the windows of one representative per class are grouped by anchor and window hash, and the
   least and greatest records of the classes decide again.
5. Spans of all members of a class are united per record.

All groupings pre-aggregate, and no group is ever collected; classes that hold a large share of
all runs are joined by broadcast (``join_keyed``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_keyed
from ..session import materialize
from . import sketch
from .hashing import Rolling, code_points, sliding_min

#: Characters hashed at once; longer texts are cut into overlapping segments, which only splits runs.
SEGMENT = 1 << 20
GRAM = 48
_RUNS = pa.schema([("rid", pa.int64()), ("anchor", pa.int64()), ("run", pa.int64()), ("p0", pa.int64()), ("n", pa.int32())])


def _runs_of(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_len: int, gram: int):
    """For texts laid end to end: text index, anchor, run hash, first window and number of windows of each run."""
    roll = Rolling(codes)
    least = sliding_min(roll.grams(gram), min_len - gram + 1)
    counts = np.maximum(ends - starts - min_len + 1, 0)
    which = np.repeat(np.arange(len(starts)), counts)
    pos = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    if not len(pos):
        return None
    m = least[pos]
    new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (which[1:] != which[:-1])]))
    last = np.concatenate([new[1:], [len(m)]]) - 1
    first_pos, last_pos = pos[new], pos[last]
    return which[new], m[new], roll.spans(first_pos, last_pos + min_len), first_pos - starts[which[new]], (last_pos - first_pos + 1)


def _segments(ids: list[int], texts: list[str], min_len: int):
    """(id, offset, codes) of every segment, each but the first ``min_len - 1`` characters into the one before."""
    for i, t in zip(ids, texts, strict=True):
        if i is None or not t or len(t) < min_len:
            continue
        c = code_points(t)
        for a in range(0, len(c) - min_len + 1, SEGMENT):
            yield i, a, c[a : a + SEGMENT + min_len - 1]


def runs(records: DataFrame, min_len: int = 150, gram: int = GRAM) -> DataFrame:
    """``records``: rid BIGINT, text.  One row per run: rid, anchor, run, p0 (first window), n (windows)."""

    def emit(parts: list) -> pa.RecordBatch | None:
        sizes = np.array([len(c) for _, _, c in parts])
        ends = np.cumsum(sizes)
        got = _runs_of(np.concatenate([c for _, _, c in parts]), ends - sizes, ends, min_len, gram)
        if got is None:
            return None
        which, anchor, run, p0, n = got
        rid = np.array([i for i, _, _ in parts], np.int64)[which]
        off = np.array([a for _, a, _ in parts], np.int64)[which]
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array(p0 + off), pa.array(n.astype(np.int32))], schema=_RUNS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                for part in _segments(s.column(0).to_pylist(), s.column(1).to_pylist(), min_len):
                    parts.append(part)
                    size += len(part[2])
                    if size >= SEGMENT // 2:
                        if (out := emit(parts)) is not None:
                            yield out
                        parts, size = [], 0
        if parts and (out := emit(parts)) is not None:
            yield out

    return records.select("rid", "text").mapInArrow(step, "rid bigint, anchor bigint, run bigint, p0 bigint, n int")


def _spans(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of a text, worked out as in ``_runs_of``: within the segment that a stretch begins in."""
    out = np.empty(len(start), np.uint64)
    for a in np.unique(start // SEGMENT).tolist():
        here = np.flatnonzero(start // SEGMENT == a)
        roll = Rolling(codes[a * SEGMENT : int(end[here].max())])
        out[here] = roll.spans(start[here] - a * SEGMENT, end[here] - a * SEGMENT)
    return out


def _windows(reps: DataFrame, records: DataFrame, min_len: int) -> DataFrame:
    """Hash of every window of the runs in ``reps`` (rid, anchor, run, p0, n, lo, hi), by offset in the run."""
    per = reps.groupBy("rid").agg(F.collect_list(F.struct("anchor", "run", "p0", "n", "lo", "hi")).alias("rs"))  # bounded by the record's own length
    per = materialize(per, "per_record")
    wanted = sketch.keep(records.select("rid", "text"), "rid", sketch.members(per, "rid", sketch.bits_for(per.count())))  # only the texts that are needed travel
    joined = wanted.join(per, "rid")
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "run")] + [("off", pa.int32())] + [(c, pa.int64()) for c in ("window", "lo", "hi")])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                text, rs = b.column(1)[row].as_py(), b.column(2)[row].values
                codes = code_points(text)
                anchor, run, p0, n, lo, hi = (rs.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                k = np.flatnonzero(p0 + n + min_len - 1 <= len(codes))
                k = k[_spans(codes, p0[k], p0[k] + n[k] - 1 + min_len) == run[k].view(np.uint64)]  # of several texts of a record each has its own runs
                anchor, run, p0, n, lo, hi = (x[k] for x in (anchor, run, p0, n, lo, hi))
                for a in range(0, max(1, len(codes) - min_len + 1), SEGMENT):  # windows that begin in this segment
                    roll, z = Rolling(codes[a : a + SEGMENT + min_len - 1]), a + SEGMENT
                    here = np.flatnonzero((p0 < z) & (p0 + n > a))
                    s, e = np.maximum(p0[here], a), np.minimum(p0[here] + n[here], z)
                    counts = e - s
                    which = np.repeat(here, counts)
                    off = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(s - p0[here], counts)
                    at = p0[which] + off - a
                    w = roll.spans(at, at + min_len).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[which]), pa.array(run[which]), pa.array(off.astype(np.int32)), pa.array(w), pa.array(lo[which]), pa.array(hi[which])], schema=schema)

    return joined.select("rid", "text", "rs").mapInArrow(step, "anchor bigint, run bigint, off int, window bigint, lo bigint, hi bigint")


def unite(spans: DataFrame, keys: list[str], s: str = "cs", e: str = "ce") -> DataFrame:
    """Overlapping or touching spans [s, e) of each key made one."""
    w = Window.partitionBy(*keys).orderBy(s, e)
    before = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(before >= F.col(s), 0).otherwise(1))
    numbered = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min(s).alias(s), F.max(e).alias(e)).drop("_g")


def shared_spans(records: DataFrame, min_len: int = 150, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """Every longest stretch of shared windows: rid, cs, ce.

    ``records``: rid BIGINT (rows with the same rid are one record), text; rows with a null
    in either, and texts under ``min_len``, give nothing.
    """
    spark = records.sparkSession
    empty = spark.createDataFrame([], "rid bigint, cs bigint, ce bigint")
    all_runs = materialize(runs(records, min_len, gram), "runs")
    bits = bits or sketch.bits_for(all_runs.count())
    candidates = sketch.keep(all_runs, "anchor", sketch.repeated(all_runs, "anchor", bits))
    classes = materialize(candidates.groupBy("anchor", "run").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count(F.lit(1)).alias("members"), F.min(F.struct("rid", "p0", "n")).alias("rep")), "classes")
    several = sketch.keep(classes, "anchor", sketch.repeated(classes, "anchor", bits))
    reps = several.select("anchor", "run", "lo", "hi", F.col("rep.rid").alias("rid"), F.col("rep.p0").alias("p0"), F.col("rep.n").alias("n"))
    windows = materialize(_windows(reps, records, min_len), "windows")
    grouped = windows.groupBy("anchor", "window").agg(F.min("lo").alias("glo"), F.max("hi").alias("ghi"), F.count(F.lit(1)).alias("rows"))
    both = materialize(grouped.filter("glo <> ghi and rows > 1").drop("glo", "ghi"), "shared")
    undecided = windows.filter("lo = hi")
    part = unite(join_keyed(undecided, both, ["anchor", "window"], "rows").select("anchor", "run", F.col("off").alias("cs"), (F.col("off") + 1).alias("ce")), ["anchor", "run"])
    part_classes = part.groupBy("anchor", "run").agg(F.collect_list(F.struct("cs", "ce")).alias("parts"))  # at most a run's windows
    whole = classes.filter("lo <> hi").select("anchor", "run", "members", F.array(F.struct(F.lit(0).alias("cs"), F.col("rep.n").alias("ce"))).alias("parts"))
    decided = materialize(whole.unionByName(part_classes.join(classes.select("anchor", "run", "members"), ["anchor", "run"])), "decided")
    if decided.isEmpty():
        return empty
    at = F.explode("parts").alias("q")
    found = join_keyed(candidates.drop("n"), decided, ["anchor", "run"], "members").select("rid", "p0", at)
    return unite(found.select("rid", (F.col("p0") + F.col("q.cs")).alias("cs"), (F.col("p0") + F.col("q.ce") - 1 + min_len).alias("ce")), ["rid"])


def shares(records: DataFrame, found: DataFrame) -> DataFrame:
    """Of every record with a text: rid, chars, shared (characters in ``found``), share (0 for an empty text).  Rows of one rid count as one record, with the longest text's characters."""
    size = records.filter("rid is not null and text is not null").groupBy("rid").agg(F.max(F.length("text")).cast("bigint").alias("chars"))
    per = found.groupBy("rid").agg(F.sum(F.col("ce") - F.col("cs")).alias("shared"))
    both = size.join(per, "rid", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return both.withColumn("share", F.when(F.col("chars") == 0, 0.0).otherwise(F.col("shared") / F.col("chars")))


def with_corpus(corpora: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Several tables as one: rid carries the corpus in its low bits, by the order of ``corpora``."""
    out = None
    for k, (df, key) in enumerate(corpora.values()):
        one = df.filter(F.col(key).isNotNull() & F.col("text").isNotNull()).select((F.col(key).cast("bigint") * len(corpora) + k).alias("rid"), "text")
        out = one if out is None else out.unionByName(one)
    return out


def corpus_name(corpora: list[str], rid: str = "rid"):
    n = len(corpora)
    k = F.pmod(F.col(rid), F.lit(n))
    name = F.element_at(F.array(*map(F.lit, corpora)), (k + 1).cast("int"))
    return name.alias("corpus"), F.expr(f"({rid} - pmod({rid}, {n})) div {n}").alias("rec_id")
