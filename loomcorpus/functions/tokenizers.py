"""Tokenizers as column functions: code points, bytes, and byte-level BPE files of the public format.

No tokenizer is trained here.  A family is derived from one file: ``derive_prefix`` keeps the first merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

_LIVE: dict[int, object] = {}


def char_tokens(text: str = "text"):
    """Tokens of the code-point tokenizer."""
    return F.char_length(text).cast("bigint")


def byte_tokens(text: str = "text"):
    """Tokens of the byte tokenizer."""
    return F.octet_length(text).cast("bigint")


def load_spec(path: str) -> dict:
    """A tokenizer file as a dict, with merges as pairs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    m = spec["model"]
    m["merges"] = [x if isinstance(x, list) else x.split(" ", 1) for x in m["merges"]]
    return spec


def derive_prefix(spec: dict, vocab: int) -> dict:
    """The nested tokenizer of the ``vocab`` lowest ids and of the merges whose product is among them.  Added tokens beyond are dropped."""
    m = spec["model"]
    if not 256 <= vocab <= len(m["vocab"]):
        raise ValueError(f"vocab must be from 256 to {len(m['vocab'])}")
    kept = {t: i for t, i in m["vocab"].items() if i < vocab}
    added = [t for t in spec.get("added_tokens", []) if t["id"] < vocab]
    return spec | {"model": m | {"vocab": kept, "merges": [p for p in m["merges"] if p[0] + p[1] in kept]}, "added_tokens": added}


def nested_violations(small: dict, large: dict) -> dict[str, int]:
    """Named counts of what keeps ``small`` from being nested in ``large``; all zero if it is."""
    a, b = small["model"], large["model"]
    dropped = lambda m: m.get("dropout") is not None
    return {
        "merges_not_prefix": sum(x != y for x, y in zip(a["merges"], b["merges"], strict=False)) + max(0, len(a["merges"]) - len(b["merges"])),
        "ids_differ": sum(b["vocab"].get(t) != i for t, i in a["vocab"].items()),
        "dropout": int(dropped(a)) + int(dropped(b)),
        "byte_fallback": int(bool(a.get("byte_fallback"))) + int(bool(b.get("byte_fallback"))),
        "pre_tokenizer": int(small.get("pre_tokenizer") != large.get("pre_tokenizer")),
        "ignore_merges": int(bool(a.get("ignore_merges"))) + int(bool(b.get("ignore_merges"))),
    }


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_lengths(spec: dict) -> dict[int, int]:
    """Source bytes of every id; an added token costs its own UTF-8 length."""
    alphabet = byte_alphabet()
    added = {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens", [])}
    return {i: added.get(i, len(t) if all(c in alphabet for c in t) else len(t.encode())) for t, i in spec["model"]["vocab"].items()} | added


@dataclass
class Bpe:
    """A byte-level BPE tokenizer that travels to executors as its JSON and is built once per worker."""

    spec: str

    @classmethod
    def of(cls, spec: dict) -> Bpe:
        return cls(json.dumps(spec, ensure_ascii=False))

    def _live(self):
        key = hash(self.spec)
        if key not in _LIVE:
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(self.spec)
            t.encode_special_tokens = True
            _LIVE[key] = t
        return _LIVE[key]

    def ids(self, text: str) -> list[int]:
        return self._live().encode(text, add_special_tokens=False).ids

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._live().encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self._live().decode(ids, skip_special_tokens=False)

    def ends(self, text: str) -> list[int]:
        """Code point where each token ends; a token that ends inside a character ends where that character does."""
        return [e for _, e in self._live().encode(text, add_special_tokens=False).offsets]


def encoded(df: DataFrame, doc: str, bpe: Bpe, text: str = "text", check: bool = True) -> DataFrame:
    """doc, ids, tokens, bytes, lossless (whether decoding gives the text back; null without ``check``).  Rows with a null text are left out."""
    held = df.sparkSession.sparkContext.broadcast(bpe)
    schema = pa.schema([("doc", pa.int64()), ("ids", pa.list_(pa.int32())), ("tokens", pa.int64()), ("bytes", pa.int64()), ("lossless", pa.bool_())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(1).to_pylist()
                ids = b.ids_of(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([b.decode(x) == t if check else None for x, t in zip(ids, texts, strict=True)], pa.bool_())], schema=schema)

    return spread(df.filter(F.col(text).isNotNull()).select(F.col(doc).cast("bigint"), text)).mapInArrow(step, "doc bigint, ids array<int>, tokens bigint, bytes bigint, lossless boolean")


def family(spark: SparkSession, path: str, sizes: dict[str, int]) -> dict[str, Bpe]:
    """Nested tokenizers of one file, checked to be nested."""
    spec = load_spec(path)
    made = {name: derive_prefix(spec, n) for name, n in sizes.items()}
    order = sorted(made, key=lambda k: sizes[k])
    for a, b in zip(order, order[1:], strict=False):
        bad = {k: n for k, n in nested_violations(made[a], made[b]).items() if n}
        if bad:
            raise ValueError(f"{a} is not nested in {b}: {bad}")
    return {k: Bpe.of(s) for k, s in made.items()}


def byte_pairs(df: DataFrame, text: str = "text") -> DataFrame:
    """How often each pair of neighbouring bytes stands within a text: a, b, n.  Counted by batch before anything is shuffled; never over 65,536 rows."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and len(x := np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) > 1:
                    total += np.bincount(x[:-1].astype(np.int64) << 8 | x[1:], minlength=1 << 16)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array((at >> 8).astype(np.int64)), pa.array((at & 255).astype(np.int64)), pa.array(total[at])], names=["a", "b", "n"])

    return df.select(text).mapInArrow(step, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
