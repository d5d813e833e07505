"""The reduced form of a text that all comparisons "in letters and digits" use, and labelled fields."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

_OTHER = re.compile(r"[\W_]+")
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]+")


def letters_digits(text: str | None) -> str:
    """The text's letters and digits after compatibility normalization, without case; '' for null."""
    if not text:
        return ""
    t = text if text.isascii() else unicodedata.normalize("NFKC", text)
    t = t.casefold()
    if not t.isascii() and not unicodedata.is_normalized("NFKC", t):
        t = unicodedata.normalize("NFKC", t)
    return _OTHER.sub("", t)


def visible(text: str | None) -> str:
    """The text without characters that show nothing, compatibility-normalized."""
    t = text or ""
    return t if t.isascii() else _UNSEEN.sub("", unicodedata.normalize("NFKC", t))


#: A label: up to 24 characters without white space at its ends, separators or sentence marks.
_LABEL = r"[^\W\d_][\w .'/-]{0,23}?"
_LINE = re.compile(rf"(?:^|\n)[ \t>*#-]*[\"'*]*({_LABEL})[\"'*]*[ \t]*(?::|=|\||\t|->)", re.U)
_PART = re.compile(rf"(?:^|;)[\s]*[\"'*]*({_LABEL})[\"'*]*[ \t]*=", re.U)
_TAG = re.compile(r"<([^\W\d_][\w .-]{0,23})>(.*?)</\1>", re.S | re.U)
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*(?:"((?:[^"\\]|\\.)*)"|([^,}"]*))', re.S)
_ESCAPE = re.compile(r"\\(?:[uU]([0-9a-fA-F]{4})|(.))", re.S)


def _unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else {"n": " ", "t": " ", "r": " ", "b": " ", "f": " "}.get(m[2].lower(), m[2]), s)


def _flat(v) -> str:
    return v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)


def _split(pattern: re.Pattern, s: str) -> list[tuple[str, str]] | None:
    if not pattern.match(s):  # most texts are told apart by their begin
        return None
    at = list(pattern.finditer(s))
    if len(at) < 2:
        return None
    ends = [m.start() for m in at[1:]] + [len(s)]
    return [(m[1], s[m.end() : e]) for m, e in zip(at, ends, strict=True)]


def fields(text: str | None) -> list[tuple[str, str]] | None:
    """The record's (label, value) pairs, both in letters and digits, or None if it isn't made of labelled fields.

    Notations: a JSON object (also one whose escapes were damaged by a change of case), lines
    ``label: value`` whose values may run over several lines, ``label=value; label=value``, and
    ``<label>value</label>``.  There must be two fields or more, and no label may come twice,
    for repeated labels are the speakers of a dialogue.
    """
    s = visible(text).strip().strip("*`").strip()
    pairs: list[tuple[str, str]] | None = None
    if s[:1] == "{" and s[-1:] == "}":
        try:
            got = json.loads(s, strict=False, object_pairs_hook=lambda p: p)
            pairs = [(k, _flat(v)) for k, v in got] if isinstance(got, list) and all(isinstance(x, tuple) for x in got) else None
        except (ValueError, RecursionError):
            pairs = [(_unescape(m[1]), _unescape(m[2] if m[2] is not None else m[3])) for m in _QUOTED.finditer(s)]
    elif s[:1] == "<":
        pairs = [(m[1], m[2]) for m in _TAG.finditer(s)] if not _TAG.sub("", s).strip() else None
    elif s:
        pairs = _split(_PART, s) or _split(_LINE, s.replace("\r\n", "\n").replace("\r", "\n"))
    if not pairs or len(pairs) < 2:
        return None
    out = [(letters_digits(k), letters_digits(v)) for k, v in pairs]
    if any(not k for k, _ in out) or len({k for k, _ in out}) < len(out):
        return None
    return out


def lanes(text: str, person: bytes = b"") -> tuple[int, int, int, int]:
    """Four signed 64-bit parts of a 256-bit digest."""
    d = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=32, person=person).digest()
    return tuple(int.from_bytes(d[i : i + 8], "little", signed=True) for i in (0, 8, 16, 24))  # type: ignore[return-value]


def signed(x: int) -> int:
    """``x`` mod 2**64 as a signed long."""
    x &= 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x
