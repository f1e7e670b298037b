"""Cutting and hashing of texts against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from dayweave.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t ,Z", max_size=30)), max_size=12)


def runs(texts, most):
    for first, data, offs in T.runs(pa.array(texts, pa.string()).cast(pa.binary()), most):
        yield first, data, offs


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 8, 1 << 20]))
def test_words_lines_and_units(texts, most):
    words, lines, units = ([[] for _ in texts] for _ in range(3))
    for first, data, offs in runs(texts, most):
        raw = data.tobytes()
        for cut, out in ((T.words, words), (T.lines, lines), (T.units, units)):
            for s, e, row in zip(*cut(data, offs)):
                out[first + row].append(raw[s:e].decode())
    plain = [t or "" for t in texts]
    assert words == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in plain]
    assert lines == [[x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for t in plain]
    assert ["".join(u) for u in units] == plain
    assert units == [re.findall(r"^[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+[^\x20\x09-\x0D]*", t) for t in plain]


def test_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 64)
    words = [b"a", b"b", b"ab", b"ba", b"x" * 300, b"a"] * 40
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = T.words(data, np.array([0, len(data)]))
    got = dict(zip(words, T.hashes(data, starts, ends)))
    assert [got[w] for w in words] == list(T.hashes(data, starts, ends))
    assert len(set(got.values())) == 5


def test_slices_of_arrow_arrays():
    whole = pa.array(["a b", None, "c", "d e f"], pa.string()).cast(pa.binary())
    got = [(first, len(o) - 1, len(T.words(d, o)[0])) for first, d, o in T.runs(whole.slice(1, 3), 1)]
    assert got == [(0, 2, 1), (2, 1, 3)]
