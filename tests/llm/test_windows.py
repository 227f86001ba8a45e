"""Windows of benchmark items: their size, and equal ones as one."""

import pickle
import random

import numpy as np

from logloom.llm import decontaminate


def test_windows_are_small():
    """a block of windows takes a few words for each of its windows, and tables of their words are made for a slice."""
    words = np.random.RandomState(1).randint(0, 5000, 40_000).astype(np.uint64)
    w = decontaminate.Windows([(f"i{k}", words[k * 400 : (k + 1) * 400].tobytes()) for k in range(100)] + [("again", words[:400].tobytes())], 10)
    assert len(w.starts) == 100 * 391 and len(pickle.dumps(w)) < 60 * len(w.starts)


def test_windows_against_a_dictionary(monkeypatch):
    """Windows of few different words, short items and items without an id, searched in slices of a few."""
    r = random.Random(2)
    rows = [(None if k % 7 == 0 else f"i{k}", np.array([r.randrange(3) for _ in range(r.randrange(0, 30))], np.uint64).tobytes()) for k in range(60)]
    want = {}
    for item, raw in rows:
        words = np.frombuffer(raw, np.uint64)
        for k in range(max(1, len(words) - 3)) if len(words) else ():
            want.setdefault(tuple(words[k : k + 4].tolist()), set()).update([item] if item else [])
    w = decontaminate.Windows(rows, 4)
    got = {}
    for k in range(len(w.starts)):
        number, inside = w.terms(k, k + 1)
        key = tuple(w.distinct[number[inside]].tolist())
        assert key not in got
        got[key] = {w.items[i] for i in w.item_of[w.item_off[k] : w.item_off[k + 1]]}
    assert got == want
