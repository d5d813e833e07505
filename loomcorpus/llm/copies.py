"""Problem 2: duplicates hidden by formatting differences.

Each record gets two keys.  ``text key``: a 128-bit digest of its letters and digits.  ``field
key``, for records made of labelled fields: every normalized (label, value) pair is hashed and
the hashes are added mod 2**64, so order does not matter and nothing is sorted; groups by that
fingerprint are then split by three more commutative digests of the same pairs (a second sum, a
product of odd numbers, and the number of fields), which verify that the fields are equal.
Records with an equal key of either kind are copies; where the two kinds chain groups together,
least lines are passed along the chain until nothing changes.

Everything after the first scan works on rows of a few numbers, and all groupings pre-aggregate,
so one group may hold any share of the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_keyed
from ..session import materialize
from .text import fields, lanes, letters_digits, signed

TEXT_KEY = ["t0", "t1"]
#: The fingerprint first, then what verifies it.
FIELD_KEY = ["f0", "v0", "v1", "nf"]
_SCHEMA = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in ("t0", "t1", "f0", "v0", "v1")), ("nf", pa.int32())])


def field_digest(pairs: list[tuple[str, str]]) -> tuple[int, int, int, int]:
    """Commutative digests of a multiset of (label, value) pairs."""
    f0 = v0 = 0
    v1 = 1
    for k, v in pairs:
        a, b, c, _ = lanes(f"{len(k)}:{k}{v}", b"field")
        f0, v0, v1 = f0 + a, v0 + b, v1 * (2 * c + 1) & 0xFFFFFFFFFFFFFFFF
    return signed(f0), signed(v0), signed(v1), len(pairs)


def keys(records: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``id``, the text key, and the field key or nulls.

    Rows with a null id, and texts that are null, empty or without any letter or digit, give no row.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not (reduced := letters_digits(text)):
                    continue
                t0, t1, _, _ = lanes(reduced, b"text")
                got = fields(text)
                rows.append((i, t0, t1, *(field_digest(got) if got else (None,) * 4)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(step, "id bigint, t0 bigint, t1 bigint, f0 bigint, v0 bigint, v1 bigint, nf int")


def _chained(groups: DataFrame) -> DataFrame:
    """``groups``: one row per text key and field key (or null) with least id and rows.  Adds nothing but the final ``keep`` per text key."""
    texts = groups.groupBy(*TEXT_KEY).agg(F.min("least").alias("keep"), F.sum("rows").alias("rows"))
    edges = materialize(groups.filter("f0 is not null").select(*TEXT_KEY, *FIELD_KEY).join(texts.select(*TEXT_KEY, "keep"), TEXT_KEY), "edges")
    changed = not edges.isEmpty()
    first = edges
    while changed:  # as many rounds as the longest chain of text and field keys, nearly always two
        by_field = edges.groupBy(*FIELD_KEY).agg(F.min("keep").alias("fkeep"), F.count(F.lit(1)).alias("n"))
        up = join_keyed(edges, by_field, FIELD_KEY, "n")
        by_text = up.groupBy(*TEXT_KEY).agg(F.min("fkeep").alias("tkeep"), F.count(F.lit(1)).alias("n"))
        new = materialize(join_keyed(edges, by_text, TEXT_KEY, "n").withColumn("moved", (F.col("tkeep") < F.col("keep")).cast("long")), "edges")
        moved, several = new.agg(F.sum("moved")).first()[0] or 0, 0
        edges = new.select(*TEXT_KEY, *FIELD_KEY, F.col("tkeep").alias("keep"))
        if moved:  # if every text key has one field key, nothing can move again
            several = edges.groupBy(*TEXT_KEY).count().filter("count > 1").limit(1).count()
        changed = bool(moved and several)
    if first is edges:
        return texts
    linked = edges.groupBy(*TEXT_KEY).agg(F.min("keep").alias("linked"))
    return texts.join(linked, TEXT_KEY, "left").select(*TEXT_KEY, F.least(F.col("keep"), F.coalesce("linked", "keep")).alias("keep"), "rows")


def _final(records: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    keyed = materialize(keys(records, id_col, text_col), "keys")
    groups = keyed.groupBy(*TEXT_KEY, *FIELD_KEY).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    return keyed, materialize(_chained(materialize(groups, "groups")), "final")


def copies(records: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Every record that is a copy of a lower one: id, keep, copies.

    Ties: the lowest id is kept; rows that repeat an id count as copies but are not listed.
    An empty table gives an empty result; columns other than the two named are ignored.
    """
    keyed, final = _final(records, id_col, text_col)
    sizes = final.groupBy("keep").agg(F.sum("rows").alias("copies"), F.count(F.lit(1)).alias("n")).filter("copies > 1")
    repeated = join_keyed(final, sizes, ["keep"], "n")
    return join_keyed(keyed.select("id", *TEXT_KEY), repeated, TEXT_KEY, "rows").filter("id > keep").select("id", "keep", "copies")


def collapsed(records: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per group of copies: keep, copies (1 for records without any)."""
    return _final(records, id_col, text_col)[1].groupBy("keep").agg(F.sum("rows").alias("copies"))
