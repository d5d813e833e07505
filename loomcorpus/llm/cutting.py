"""Problem 5: items over a size limit cut at natural boundaries, by lexical cohesion.

At every possible boundary the words of the block before are compared with those of the block
after (cosine of counts); valleys of that curve mark changes of topic.  Within the window of
allowed piece sizes (more than two overlaps, and up to the limit) the deepest valley is cut: among
ends of paragraphs and sentences if the window holds any, else among ends of words, else the piece is
filled to the last code point.  Of equally deep valleys the last is cut.  Only where no boundary leaves
two overlaps, one that leaves more than one is taken.
Every piece but the first begins ``overlap`` characters before the end of the one before.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of each of the two blocks that are compared at a boundary.
BLOCK = 24
_SENTENCE = re.compile(r"[。！？!?…]+[”’」』\"')）]*|\.+[”’\"')]*(?=\s|$)|\n+|[;；](?=\s|[^\x00-\x7f])")
_WORD = re.compile(r"[^\W\d_一-鿿]+|\d+|[一-鿿]")
_SPACE = re.compile(r"\s+|[，、,：:]+\s*|(?<=[一-鿿])(?=[一-鿿])")


def _cosine(a: Counter, b: Counter) -> float:
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5 if dot else 0.0


class Boundaries:
    """Boundaries of one text and the depth of the cohesion valley at each, worked out when asked for."""

    def __init__(self, text: str):
        self.text = text
        words = list(_WORD.finditer(text))
        self.starts = [m.start() for m in words]
        raw = [m[0].lower() for m in words]
        self.tokens = [w if len(w) > 1 or k + 1 == len(raw) or len(raw[k + 1]) > 1 else w + raw[k + 1] for k, w in enumerate(raw)]  # Han characters as pairs
        self.sentences = sorted({m.end() for m in _SENTENCE.finditer(text)})
        self.words: list[int] | None = None
        self._sim: dict[int, float] = {}

    def similarity(self, at: int) -> float:
        if at not in self._sim:
            k = bisect_left(self.starts, at)
            self._sim[at] = _cosine(Counter(self.tokens[max(0, k - BLOCK) : k]), Counter(self.tokens[k : k + BLOCK]))
        return self._sim[at]

    def depths(self, marks: list[int]) -> list[float]:
        """How far the curve rises from each boundary to the next peak on either side, within ``marks``."""
        curve = [self.similarity(m) for m in marks]

        def peaks(c: list[float]) -> list[float]:
            """Up to each place the peak of the rise that ends there, going back."""
            out: list[float] = []
            for i, x in enumerate(c):
                out.append(out[-1] if i and c[i - 1] >= x else x)
            return out

        left, right = peaks(curve), peaks(curve[::-1])[::-1]
        return [a + b - 2 * c for a, b, c in zip(left, right, curve, strict=True)]

    def deepest(self, marks: list[int], lo: int, hi: int) -> int | None:
        """The deepest valley in (lo, hi] among ``marks``; of equals the last."""
        a, b = bisect_right(marks, lo), bisect_right(marks, hi)
        if a >= b:
            return None
        return marks[a + max(enumerate(self.depths(marks[a:b])), key=lambda x: (round(x[1], 9), x[0]))[0]]

    def sentence(self, lo: int, hi: int) -> int | None:
        """The deepest valley among ends of sentences and paragraphs."""
        return self.deepest(self.sentences, lo, hi)

    def word(self, lo: int, hi: int) -> int | None:
        """The deepest valley among ends of words."""
        if self.words is None:
            self.words = sorted({m.end() for m in _SPACE.finditer(self.text)})
        return self.deepest(self.words, lo, hi)


def pieces(text: str, limit: int = 1500, overlap: int = 60) -> list[tuple[int, int]]:
    """[start, end) in code points of pieces of at most ``limit`` UTF-8 bytes that cover ``text``.

    The limit must hold the overlap and one character more, 4 bytes each.
    """
    if limit < 4 * (overlap + 1):
        raise ValueError("the limit is too small for the overlap")
    width = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.concatenate([[0], np.cumsum(1 + (width > 0x7F).astype(np.int64) + (width > 0x7FF) + (width > 0xFFFF))])
    n, out, start, marks = len(text), [], 0, None
    while total[n] - total[start] > limit:
        marks = marks or Boundaries(text)
        most = int(np.searchsorted(total, total[start] + limit, "right")) - 1
        least = start + overlap  # the next piece must begin after this one
        twice = least + overlap
        end = marks.sentence(twice, most) or marks.sentence(least, most) or marks.word(twice, most) or marks.word(least, most) or most
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def cut(chunks: DataFrame, texts: DataFrame, limit: int = 1500, overlap: int = 60) -> DataFrame:
    """Pieces of all spans over ``limit`` bytes: doc, chunk, cs, ce (of the span), piece, ps, pe (in the text), utf8_bytes.

    ``chunks``: doc, chunk, cs, ce (null: the end of the text); ``texts``: doc, text.  Sizes are
    measured; any stated size is ignored.  Repeated rows count once; spans with a null doc, chunk
    or cs, of missing or null texts, or empty, give nothing; ends beyond the text end with it.
    If a doc has several texts over ``limit`` bytes, the first of them by value is cut.
    """
    one = texts.filter("doc is not null and text is not null").filter(F.octet_length("text") > limit).groupBy("doc").agg(F.min("text").alias("text"))
    spans = chunks.filter("doc is not null and chunk is not null and cs is not null").select("doc", "chunk", "cs", "ce").distinct()
    per = spans.groupBy("doc").agg(F.collect_list(F.struct("chunk", "cs", "ce")).alias("spans"))  # no more than the doc's own spans
    schema = pa.schema([(c, pa.int64()) for c in ("doc", "chunk", "cs", "ce", "piece", "ps", "pe", "utf8_bytes")])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc, text, rows = b.column(0)[i].as_py(), b.column(1)[i].as_py(), []
                for s in b.column(2)[i].as_py():
                    cs, ce = max(0, s["cs"]), len(text) if s["ce"] is None else min(s["ce"], len(text))
                    part = text[cs:ce]
                    if len(part) * 4 <= limit or len(part.encode("utf-8", "surrogatepass")) <= limit:
                        continue
                    for k, (x, y) in enumerate(pieces(part, limit, overlap)):
                        rows.append((doc, s["chunk"], s["cs"], ce, k, cs + x, cs + y, len(part[x:y].encode("utf-8", "surrogatepass"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    ddl = ", ".join(f"{f.name} bigint" for f in schema)
    return one.join(per, "doc").select("doc", "text", "spans").mapInArrow(step, ddl)
