import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcorpus.llm import text as T
from loomcorpus.llm.copies import field_digest
from loomcorpus.llm.hashing import Rolling, code_points, sliding_min


def test_letters_digits():
    assert T.letters_digits("Ａb－c １２​３。") == "abc123"
    assert T.letters_digits(None) == T.letters_digits(" \n—!") == ""
    assert T.letters_digits("Straße") == "strasse"


@pytest.mark.parametrize(
    "form",
    [
        '{"topic": "Ships", "level": "7", "answer": "Yes, \\"now\\"."}',
        '﻿{\n  "answer": "yes now",\n  "TOPIC": "ships", "level": 7}',
        "topic: Ships\nlevel: 7\nanswer: Yes,\n now.",
        "level=7; topic=ships; answer=YES NOW",
        "**Topic：** ｓｈｉｐｓ\r\n**Answer：** yes — now\r\n**Level：** 7",
        "<topic>ships</topic> <level>7</level><answer>yes now</answer>",
    ],
)
def test_notations_agree(form):
    assert sorted(T.fields(form)) == [("answer", "yesnow"), ("level", "7"), ("topic", "ships")]


@pytest.mark.parametrize("other", ["plain text", "a: b", "User: x\nBot: y\nUser: z", "", None, "{}", "{broken", "[1, 2]", "{" * 5000])
def test_no_fields(other):
    assert T.fields(other) is None


def test_values_do_not_swap():
    assert field_digest([("a", "x"), ("b", "y")]) == field_digest([("b", "y"), ("a", "x")])
    assert field_digest([("a", "x"), ("b", "y")]) != field_digest([("a", "y"), ("b", "x")])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab界𠮻", max_size=60), st.integers(1, 9))
def test_rolling_equals_slices(t, k):
    g = Rolling(code_points(t)).grams(k)
    assert len(g) == max(0, len(t) - k + 1)
    by = {}
    for i, h in enumerate(g.tolist()):
        assert by.setdefault(t[i : i + k], h) == h
    assert len(set(by.values())) == len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 70))
def test_sliding_min(x, w):
    a = np.array(x, np.uint64)
    assert sliding_min(a, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
