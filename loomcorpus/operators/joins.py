"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are never more than ``1 / HOT_SHARE`` hot keys.
HOT_SHARE = 1 / 256
#: Groups below this many rows are never worth a special case.
HOT_ROWS = 20_000


def join_keyed(big: DataFrame, small: DataFrame, keys: list[str], count_col: str, total: int | None = None) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row per key and ``count_col``, its rows in ``big``.

    Keys holding more than ``HOT_SHARE`` of all rows (at most 256 of them, whatever the size of
    the data) are joined by broadcasting their rows of ``small``; all others shuffle on the key.
    ``count_col`` is dropped.  Null keys match nothing, as in SQL.  Columns of ``small`` that
    also stand in ``big`` are not allowed except the keys.
    """
    clash = (set(big.columns) & set(small.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    total = small.agg(F.sum(count_col)).first()[0] if total is None else total
    least = max(HOT_ROWS, int((total or 0) * HOT_SHARE))
    hot = small.filter(F.col(count_col) > least).drop(count_col)
    if hot.isEmpty():
        return big.join(small.drop(count_col), keys)
    cold = small.filter(F.col(count_col) <= least).drop(count_col)
    of_hot = F.broadcast(hot.select(*keys))
    return big.join(F.broadcast(hot), keys).unionByName(big.join(of_hot, keys, "left_anti").join(cold, keys))
