"""Column expressions on texts: identity, predicates, sizes, seeded hashes and character windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that stripping white space removes, in any script.
BLANK = r"^[\s\x0b\x1c-\x1f\x85\p{Z}]*$"
CJK = r"[\x{4e00}-\x{9fff}]"


def content_key(text) -> Column:
    """SHA-256 of the UTF-8 text in lower-case hex; equal keys are equal texts.  Null for null."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def is_blank(text) -> Column:
    """True for texts of nothing but white space, and for null."""
    c = F.col(text) if isinstance(text, str) else text
    return c.isNull() | c.rlike(BLANK)


def has_cjk(text) -> Column:
    """True if a character of the basic CJK block occurs."""
    return (F.col(text) if isinstance(text, str) else text).rlike(CJK)


def hash60(text) -> Column:
    """The first 60 bits of a SHA-256 as a non-negative BIGINT: the same number in any engine."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def seeded(seed: int, *cols) -> Column:
    """``hash60`` of "seed:value:value"; the engine's only source of chance, so results never depend on partitioning."""
    return hash60(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def char_windows(text: str, size: int = 64, stride: int = 32) -> Column:
    """Array of (s, e, w): windows at every ``stride`` while they fit, one at the end if the grid misses it, or the whole text if it is no longer than ``size``.

    Null for null, one empty window for the empty text.  If ``stride`` divides ``size``, the text is cut
    once into blocks of ``stride`` and windows are joined from neighbours, so the cost stays linear.
    """
    n = F.char_length(F.col(text))
    whole = F.array(F.struct(F.lit(0).alias("s"), n.alias("e"), F.col(text).alias("w")))
    last = F.struct((n - size).alias("s"), n.alias("e"), F.right(F.col(text), F.lit(size)).alias("w"))
    count = F.floor((n - size) / F.lit(stride)).cast("int")
    if size % stride == 0:
        blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
        k = size // stride
        joined = lambda b: F.transform(F.sequence(F.lit(0), count), lambda i: F.struct((i * stride).alias("s"), (i * stride + size).alias("e"), F.concat(*[F.element_at(b, i + 1 + j) for j in range(k)]).alias("w")))
        grid = F.element_at(F.transform(F.array(blocks), joined), 1)  # the outer transform names the blocks, so they are cut once, not once per window
    else:
        grid = F.transform(F.sequence(F.lit(0), count), lambda i: F.struct((i * stride).alias("s"), (i * stride + size).alias("e"), F.substring(F.col(text), i * stride + 1, F.lit(size)).alias("w")))
    tail = F.when((n - size) % stride != 0, F.array(last)).otherwise(F.array().cast("array<struct<s:int,e:int,w:string>>"))
    return F.when(F.col(text).isNull(), None).when(n <= size, whole).otherwise(F.concat(grid, tail))


def char_widths(text: str) -> np.ndarray:
    """UTF-8 bytes of every code point, on the Python side."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
