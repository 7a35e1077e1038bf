"""Periodic runs against all periods tried one by one."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from formgrain.llm import repetitions
from tests.llm.conftest import corpus


def slow_runs(words):
    """Every maximal stretch of every period; periods rise, so a stretch with a smaller period is known already."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        x = 0
        while x + q < len(words):
            end = x
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - x >= max(24, 3 * q) and not any(s <= x and s + n >= end + q for s, n, _ in found):
                found.append((x, end + q - x, q))
            x = max(end, x + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def looped(n, a, p):
    return [a + (i - a) % p if i >= a else i for i in range(n)]


stretch = st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=12), st.integers(1, 9)).map(lambda t: t[0] * t[1])


@settings(max_examples=500, deadline=None)
@given(st.lists(stretch, max_size=6).map(lambda parts: sum(parts, [])))
def test_runs_of_small_alphabets(words):
    assert list(map(tuple, repetitions.runs_of(words).tolist())) == slow_runs(words)


def test_nested_and_long_runs():
    inner = [b"x"] * 30 + [b"y"]
    assert list(map(tuple, repetitions.runs_of(inner * 4).tolist())) == slow_runs(inner * 4)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert list(map(tuple, repetitions.runs_of(b).tolist())) == slow_runs(b)
    unlike = [b"%d" % i for i in range(70_000)]
    for words, run in ((unlike * 3, [0, 210_000, 70_000]), ([b"a", b"b"] * 100_000, [0, 200_000, 2])):
        began = time.perf_counter()
        assert repetitions.runs_of(words).tolist() == [run]
        assert time.perf_counter() - began < 20
    assert not len(repetitions.runs_of(unlike))


def test_most_repeated_run():
    assert repetitions.most_repeated([[5, 30, 10], [9, 36, 12], [2, 31, 10]]) == [2, 31, 10]
    assert repetitions.most_repeated([[0, 24, 8], [40, 24, 8]]) == [0, 24, 8]
    assert repetitions.most_repeated([]) is None


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        words = [words[k] for k in looped(len(words), a, 1 + (len(words) - a) // (3 + g % 8))]
    runs = slow_runs(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_digests_of_odd_rows(make):
    rng = random.Random(3)
    looping = [(2000 + k, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 200)))) for k in range(60)]
    docs = corpus(5) + looping + [(None, "ab " * 40), (None, None), (7, "ab cd " * 40), (7, "ab cd " * 40)]
    found = sorted(map(str, (tuple(r) for r in repetitions.run_digests(make(docs)).collect())))
    assert found == sorted(str(expected(i, t)) for i, t in docs)
    assert repetitions.run_digests(make([])).collect() == []


def test_general_operator(make):
    (row,) = repetitions.periodic_runs(make([(1, "start " + "one two three " * 10 + "end")])).collect()
    assert (row.n_words, [tuple(r) for r in row.runs], tuple(row.longest)) == (32, [(1, 30, 3)], (1, 30, 3))
    assert row.collapsed == "start one two three end"
