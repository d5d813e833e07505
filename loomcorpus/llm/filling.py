"""Problem 6: fixed-capacity containers filled with items, by variable-capacity best fit.

Items are spread by hash over shards of bounded size, and each shard is packed alone, largest
item first.  Permitted capacities are optimised together: an item goes into the open bin whose
room it leaves smallest; where none has room, a bin opens at the capacity of least cost per
token that it will hold, foreseen for each capacity from the sizes still to come (largest that
fits, again and again); in the end every bin is downsized to the least permitted capacity that holds its contents.
Only items over the largest capacity are split: full containers, and the rest is an item.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: One token per Han character, per punctuation or symbol character, and per run of other visible characters.
TOKEN = r"\p{IsHan}|[\p{P}\p{S}]|[^\s\p{IsHan}\p{P}\p{S}\p{C}\p{Z}]+"
CAPACITIES = (256, 512, 1024, 2048)
#: Tokens of a shard, on average: some thousand containers, which leaves the last one's room without weight.
SHARD_TOKENS = 1 << 21


def sized(docs: DataFrame, size_col: str = "n_tokens", text_col: str = "text"):
    """The stated size, or the counted one where it is null or negative; 0 for a null text."""
    return F.when(F.col(size_col) >= 0, F.col(size_col)).otherwise(F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKEN)), F.lit(0))).cast("bigint")


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...], overhead: float = 1.0) -> tuple[np.ndarray, list[int]]:
    """Bin of each item (sizes falling) and the capacity of each bin.  ``overhead``: cost of a bin besides its capacity, in tokens."""
    caps = sorted(capacities)
    most = caps[-1]
    values, counts = (x.tolist() for x in np.unique(sizes, return_counts=True)) if len(sizes) else ([], [])
    at = {v: i for i, v in enumerate(values)}
    below = list(range(len(values)))  # the next smaller size that is still to come, found by following

    def to_come(i: int) -> int:
        """The greatest index up to ``i`` of a size still to come, or -1."""
        path = []
        while i >= 0 and not counts[i]:
            path.append(i)
            i = below[i] if below[i] < i else i - 1
        for p in path:
            below[p] = i
        return i

    def held(room: int) -> int:
        """Tokens that the sizes to come put into ``room``."""
        used, i = 0, bisect_right(values, room) - 1
        while (i := to_come(i)) >= 0 and room > used and values[i]:
            n = min((room - used) // values[i], counts[i])
            used += n * values[i]
            i = min(i - 1, bisect_right(values, room - used) - 1)
        return used

    rooms: list[int] = []  # distinct rooms of open bins, rising
    by_room: dict[int, list[int]] = {}
    fill: list[int] = []
    room_of: list[int] = []
    out = np.empty(len(sizes), np.int64)
    for k, s in enumerate(sizes.tolist()):
        counts[at[s]] -= 1
        i = bisect_left(rooms, s)
        if i < len(rooms):
            r = rooms[i]
            b = by_room[r].pop()
            if not by_room[r]:
                del by_room[r]
                rooms.pop(i)
        else:
            c = min((c for c in caps if c >= s), key=lambda c: ((c + overhead) / max(1, s + held(c - s)), -c))
            b, r = len(fill), c
            fill.append(0)
            room_of.append(c)
        out[k] = b
        fill[b] += s
        if r - s > 0:
            if r - s not in by_room:
                by_room[r - s] = []
                rooms.insert(bisect_left(rooms, r - s), r - s)
            by_room[r - s].append(b)
    assert all(f <= most for f in fill)
    return out, [caps[bisect_left(caps, f)] for f in fill]


def fill(docs: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Each item's pieces: id, piece, start, tokens, container, capacity, fill.

    ``container`` is a string, unique over all shards.  Items of no tokens take no room but are
    placed like others; rows with a null id give nothing; repeated rows are placed as often as they come, their
    copies told apart by ``copy``.  The result depends on the rows alone, not on their partitioning.
    """
    most = max(capacities)
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), sized(docs, size_col, text_col).alias("size"))
    counted = base.groupBy("id", "size").agg(F.count(F.lit(1)).cast("int").alias("n"))
    items = materialize(counted.select("id", "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")), "items")
    whole = items.filter(F.col("size") >= most).withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"size div {most}") - 1)))
    full = whole.select("id", "copy", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("start"), F.lit(most).cast("bigint").alias("tokens"), F.concat_ws("-", F.lit("f"), "id", "size", "copy", "piece").alias("container"), F.lit(most).alias("capacity"), F.lit(1.0).alias("fill"))
    rest = items.withColumn("rest", F.col("size") % most).filter((F.col("rest") > 0) | (F.col("size") == 0)).select("id", "size", "copy", F.expr(f"cast(size div {most} as int)").alias("piece"), F.expr(f"(size div {most}) * {most}").alias("start"), F.col("rest").alias("tokens"))
    total = rest.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("id", "size", "copy"), F.lit(shards)).cast("int"))
    schema = pa.schema([("id", pa.int64()), ("copy", pa.int32()), ("piece", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64()), ("container", pa.string()), ("capacity", pa.int32()), ("fill", pa.float64())])

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("tokens", "descending"), ("id", "ascending"), ("size", "ascending"), ("copy", "ascending")])
        sizes = t["tokens"].to_numpy()
        bins, caps = best_fit(sizes, capacities)
        filled = np.bincount(bins, sizes, minlength=len(caps)) / np.array(caps)
        c = np.array(caps, np.int32)[bins]
        names = pa.array([f"{key[0].as_py()}-{b}" for b in bins.tolist()])
        return pa.table([t["id"], t["copy"].cast(pa.int32()), t["piece"].cast(pa.int32()), t["start"], t["tokens"], names, pa.array(c), pa.array(filled[bins])], schema=schema)

    packed = rest.groupBy("shard").applyInArrow(pack, "id bigint, copy int, piece int, start bigint, tokens bigint, container string, capacity int, fill double")
    return full.unionByName(packed)
