"""Checks of runs on the driver: resume identity, launch profiles, pinned orders, throughput, clean byte prefixes."""

from __future__ import annotations

import hashlib

import numpy as np

from .quality import GateError

#: Options that only the packed profile knows.
PACK_ONLY = ("pack", "wsd", "ledger", "token_budget")


def same_run(saved: dict, current: dict) -> None:
    """A run resumes only where every field of its identity is there and equal in value and type."""
    bad = sorted(k for k in saved.keys() | current.keys() if k not in saved or k not in current or type(saved[k]) is not type(current[k]) or saved[k] != current[k])
    if bad:
        raise GateError("not the same run: " + ", ".join(bad))


def launch(profile: str, options: dict, pack_only: tuple[str, ...] = PACK_ONLY) -> dict:
    """Options of a launch; those of packing are refused outside the packed profile, and so are unknown profiles."""
    if profile not in ("check", "full", "pack"):
        raise ValueError(f"no profile {profile}")
    extra = sorted(set(options) & set(pack_only)) if profile != "pack" else []
    if extra:
        raise ValueError(f"{profile} does not take {', '.join(extra)}")
    return {"profile": profile, **options}


def pinned_tokenizer(arm: str, tokenizer_sha256: str, pins: dict[str, str]) -> None:
    """An arm trains with the tokenizer that it is pinned to, and with no other."""
    if arm not in pins:
        raise GateError(f"no arm {arm}")
    if pins[arm] != tokenizer_sha256:
        raise GateError(f"arm {arm} is pinned to another tokenizer")


def pinned_order(n: int, seed: int = 42) -> tuple[np.ndarray, dict]:
    """The permutation of numpy's generator, for parity with orders made elsewhere, and what pins it.  It lives on the driver;
    ``splits.shuffled`` is the distributed order."""
    order = np.random.default_rng(seed).permutation(n).astype("<i4")
    return order, {"seed": seed, "n_docs": n, "order_sha256": hashlib.sha256(order.tobytes()).hexdigest(), "numpy": np.__version__}


def throughput(rows: int, seconds: float, passes: int = 1, flops_per_row: float = 0.0) -> dict[str, float]:
    """Rows per second over all passes, milliseconds per row, and TFLOPS."""
    rate = passes * rows / seconds if seconds > 0 else 0.0
    return {"rows_per_s": rate, "ms_per_row": 1000 / rate if rate else 0.0, "tflops": flops_per_row * rate / 1e12}


def clean_prefix(data: bytes, byte_cum: list[int], tokens: int) -> int:
    """The greatest number of tokens up to ``tokens`` whose bytes are whole characters; ``byte_cum[k]`` is where token k + 1 begins."""
    try:
        data.decode("utf-8")
        whole = len(data)
    except UnicodeDecodeError as e:
        whole = e.start
    inner = np.append((np.frombuffer(data, np.uint8) & 0xC0) == 0x80, False)  # bytes within a character
    ends = np.asarray(byte_cum[:tokens], np.int64)
    clean = np.flatnonzero((ends <= whole) & ~inner[np.minimum(ends, len(data))])
    return int(clean[-1]) + 1 if len(clean) else 0
