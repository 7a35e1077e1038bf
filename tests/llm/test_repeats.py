"""Passage, byte-string and near-duplicate operators and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from formgrain.llm import common, decontaminate, near_duplicates, substrings, suffixes
from tests.llm.conftest import corpus

sha = lambda b: hashlib.sha256(b).hexdigest()


def passages(docs, window):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = (text or "").encode().split()
        covered = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if x in seen:
                covered[k:k + window] = [True] * window
            seen.add(x)
        out[i] = (len(w), sum(covered), sha(b" ".join(a for a, c in zip(w, covered) if not c)))
    return out


@pytest.mark.parametrize(("seed", "window", "gram"), [(1, 20, 5), (2, 6, 2), (3, 12, 12)])
def test_passages(make, seed, window, gram):
    docs = corpus(seed)
    found = substrings.repeated_passages(make(docs), window, gram).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == passages(docs, window)
    assert all(sha(r.kept.encode()) == r.kept_sha256 for r in found)


@pytest.mark.parametrize("seed", range(40))
def test_factors_are_greedy_and_longest(seed):
    """Against a parse that tries every earlier place letter by letter, with repeated places and run ends."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 120))
    prints = rng.integers(0, rng.integers(2, 6), n).astype(np.uint64)
    if seed % 3 == 0:
        prints = np.concatenate([prints, prints[::2], prints])[:200]
    n = len(prints)
    linked = np.r_[False, rng.random(n - 1) < 0.85]
    places = np.cumsum(np.r_[False, linked[1:] | (rng.random(n - 1) < 0.8)])
    stop = [next((j for j in range(i + 1, n) if not linked[j]), n) for i in range(n)]
    expected, at = [], 0
    while at < n:
        lengths = []
        for a in (a for a in range(n) if places[a] < places[at]):
            m = 0
            while at + m < stop[at] and a + m < stop[a] and prints[a + m] == prints[at + m]:
                m += 1
            lengths.append(m)
        if max(lengths, default=0):
            expected.append((at, at + max(lengths)))
        at += max(1, max(lengths, default=0))
    start, end, source = substrings.factors(prints, places, linked)
    assert list(zip(start.tolist(), end.tolist())) == expected
    for a, b, c in zip(start, end, source):
        assert places[c] < places[a] and (prints[a:b] == prints[c:c + b - a]).all()


def test_factors_of_one_letter_and_of_many_copies():
    import time

    began = time.perf_counter()
    one = np.zeros(100_000, np.uint64)
    start, end, _ = substrings.factors(one, np.arange(100_000), np.r_[False, np.ones(99_999, bool)])
    assert list(zip(start.tolist(), end.tolist())) == [(1, 100_000)]
    passage = np.tile(np.arange(50, dtype=np.uint64), 2_000)
    linked = np.arange(100_000) % 50 > 0
    start, end, source = substrings.factors(passage, np.arange(100_000), linked)
    assert len(start) == 1_999 and (end - start == 50).all()
    assert time.perf_counter() - began < 20


def test_passages_of_rows_without_or_with_repeated_ids(make):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (None, text), (5, text), (5, text), (7, text)]
    found = substrings.repeated_passages(make(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (0, 0), (5, 0), (5, 0), (7, 30)]
    assert substrings.repeated_passages(make([])).collect() == []


def byte_strings(docs, window):
    from collections import Counter

    texts = [(t or "").encode() for _, t in docs]
    counts = Counter(t[k:k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(docs, texts):
        covered = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if counts[t[k:k + window]] > 1:
                covered[k:k + window] = True
        spans = int((covered[:-1] & ~np.r_[False, covered[:-2]]).sum()) if len(t) else 0
        out.append((i, len(t), int(covered.sum()), spans, sha(bytes(b for b, c in zip(t, covered) if not c))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "window", "gram"), [(1, 200, 32), (2, 40, 8), (3, 25, 25), (4, 60, 1)])
def test_byte_strings(make, seed, window, gram):
    docs = corpus(seed)
    docs += [(None, docs[0][1]), (docs[1][0], "other text of the same id, " * 3), (docs[2][0], docs[2][1])]
    found = suffixes.repeated_bytes(make(docs), window, gram).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str) == byte_strings(docs, window)
    assert all(r.kept_text == bytes(r.kept).decode("utf-8", "ignore") for r in found)
    assert suffixes.repeated_bytes(make([])).collect() == []


def test_places_of_long_texts_in_chunks(monkeypatch):
    text = bytes(random.Random(1).choice(b"ab") for _ in range(3000))
    whole = suffixes.sampled(text, 50, 8)
    monkeypatch.setattr(suffixes, "CHUNK", 100)
    parts = suffixes.sampled(text, 50, 8)
    of_window = lambda x: {s: (p, g) for p, g, a, b in zip(*(c.tolist() for c in x)) for s in range(a, b + 1)}
    assert of_window(parts) == of_window(whole)
    assert set(of_window(whole)) == set(range(len(text) - 49))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_merge_knows_prefixes(k):
    rng = random.Random(k)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 40))) for _ in range(k)]
    coded = [suffixes.front_coded(run) for run in runs]
    readers, out = [iter(run) for run in runs], []
    for run, shared in suffixes.merged(coded):
        s = next(readers[run])
        assert shared == (suffixes.shared_prefix(out[-1], s) if out else 0)
        out.append(s)
    assert out == sorted(x for run in runs for x in run)


def near(docs, width=4):
    sets = {}
    for i, t in docs:
        w = [x.lower() for x in (t or "").encode().split()]
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize(("seed", "tile"), [(1, 4096), (2, 4096), (3, 2)])
def test_near_duplicates(make, seed, tile):
    docs = corpus(seed)
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(200)]
    # A chain of near copies whose ends are not alike, and a group around one text.
    for k in range(12):
        docs.append((2000 + k, " ".join(base[4 * k:] + [f"v{j}" for j in range(4 * k)])))
        words = list(base)
        for _ in range(4):
            words[rng.randrange(200)] = f"u{rng.randrange(9)}"
        docs.append((3000 + k, " ".join(words).upper()))
    found = near_duplicates.near_duplicates(make(docs), near_duplicates.Settings(tile=tile)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == near(docs)


def test_near_duplicates_of_odd_rows(make):
    text = " ".join(f"w{k}" for k in range(30))
    found = near_duplicates.near_duplicates(make([(4, text), (4, text), (None, text), (9, text + " x"), (None, None), (None, "lone row")])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in found if r.n_shingles > 20) == [
        ("4", 27, 4, True), ("4", 27, 4, True), ("9", 28, 4, False), ("None", 27, 4, False)]
    assert all(r.kept for r in found if r.n_shingles < 20)
    assert near_duplicates.near_duplicates(make([])).collect() == []


def test_rows_without_an_id_are_linked(make):
    base = [f"w{k}" for k in range(60)]
    text, close, closer = " ".join(base), " ".join(["x", *base[1:]]), " ".join([*base[:-1], "x"])
    found = near_duplicates.near_duplicates(make([(None, text), (None, close), (8, "lone row of words"), (None, None), (None, "")])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in found if r.n_shingles == 57) == [("None", 57, None, True)] * 2
    found = near_duplicates.near_duplicates(make([(None, text), (9, close), (9, closer), (5, "other words " * 9)])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in found) == [("5", 5, True), ("9", 9, True), ("9", 9, True), ("None", 9, False)]


def test_representatives_keep_one_row_of_each_group(make):
    base = [f"w{k}" for k in range(60)]
    text, close, closer = " ".join(base), " ".join(["x", *base[1:]]), " ".join([*base[:-1], "x"])
    rows = [(None, text), (9, close), (9, closer), (9, closer), (12, text), (5, "other words here"), (5, None), (5, ""), (None, None), (None, None), (None, "alone all by itself"), (None, "alone all by itself")]
    kept = near_duplicates.representatives(make(rows))
    assert kept.columns == make(rows).columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert len([f for f in found if f[0] == 9]) == 1 and found[0][0] in (5, 9)
    assert sorted((f for f in found if f[0] != 9), key=str) == sorted([(5, "other words here"), (5, None), (5, ""), (None, None), (None, "alone all by itself")], key=str)


def test_sketches_tell_similarity():
    s = near_duplicates.Settings()
    factors = near_duplicates.multipliers(s.bands * s.rows)
    shingles = common.mixed(np.arange(1, 4000, dtype=np.uint64))
    base = near_duplicates.odd_sketch(near_duplicates.samples(shingles[:1000], factors), s.sketch_longs)
    bits = []
    for apart in (0, 50, 111, 300, 900):  # similarity 1, 0.9, 0.8, 0.54, 0.05
        other = near_duplicates.odd_sketch(near_duplicates.samples(shingles[apart:1000 + apart], factors), s.sketch_longs)
        bits.append(sum(int(a ^ b).bit_count() if a ^ b >= 0 else int((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(base.tolist(), other.tolist())))
    assert bits[0] == 0 and bits == sorted(bits) and bits[2] < near_duplicates.most_different_bits(s) < bits[4]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (95, 100), (200, 300)]
    found = near_duplicates.components(spark.createDataFrame(edges, "a long, b long"))
    expected = {**{k: 1 for k in range(2, 41)}, 100: 90, 95: 90, 300: 200}
    assert {r.node: r.label for r in found.collect() if r.node != r.label} == expected


def hits(docs, items, window=10):
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = lower(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + window]), set()).add(item)
    out = {}
    for i, text in docs:
        w, covered, found = lower(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    covered |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out[i] = (len(w), len(covered), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(covered))
    return out


@pytest.mark.parametrize(("seed", "broadcast"), [(1, 16 << 20), (2, 0)])
def test_decontamination(spark, make, monkeypatch, seed, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    docs = corpus(seed)
    words = docs[0][1].split()
    items = [(k, " ".join(docs[k][1].split()[:25]).upper()) for k in range(5)] + [
        (10, None), (11, ""), (12, "..."), (13, words[0]), (14, " ".join(words[1:4])), (15, "not in any text at all"), (15, words[0]), (2, "again " + words[2])]
    docs += [(5000, " - ".join(words[:30]) + " ÉÀ"), (5001, "É " * 20)]
    items += [(16, "É " * 12), (17, "é " * 12)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    found = decontaminate.decontaminated(make(docs), bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == hits(docs, items)


def test_decontamination_of_odd_rows(spark, make):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    text = "x a b c d e f g h i j y"
    found = decontaminate.decontaminated(make([(None, text), (3, text), (3, text), (4, "x")]), bench).collect()
    assert sorted((str(r.doc_id), r.n_hit) for r in found) == [("3", 10), ("3", 10), ("4", 0), ("None", 10)]
    assert decontaminate.decontaminated(make([]), bench).collect() == []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.decontaminated(make([(1, text)]), empty).collect()] == [False]


def test_decontamination_judges_each_row(spark, make):
    """Rows without an id, and different texts under one id, keep apart."""
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "p q r")], "item_id long, text string")
    rows = [(None, "x a b c d e f g h i j y"), (None, "clean text"), (None, None), (7, "p q r p q r"), (7, "one"), (7, "one"), (7, "")]
    found = decontaminate.decontaminated(make(rows), bench).collect()
    assert sorted(((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in found)) == sorted(
        [("None", 12, 10, 1), ("None", 2, 0, 0), ("None", 0, 0, 0), ("7", 6, 6, 1), ("7", 1, 0, 0), ("7", 1, 0, 0), ("7", 0, 0, 0)])
    clean = decontaminate.clean_documents(make(rows), bench)
    assert clean.columns == make(rows).columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([(None, "clean text"), (None, None), (7, "one"), (7, "one"), (7, "")], key=str)


def test_no_words_but_terms_are_exchanged_before_the_hits(spark, make, monkeypatch):
    """With nothing broadcast, postings are joined without the documents' words."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    index = decontaminate.Index(make([(1, "a b c d e f g h i j k l")]), spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index._postings()._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Join Inner", plan) and "words" not in plan.split("Generate")[0]
        assert {(r.row, r.start) for r in index.phrases().collect()} == {(index.documents.first().row, 0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_proximity_matches(spark, make):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = make([(1, "gamma so alpha and delta epsilon beta"), (2, "alpha beta"), (3, "x alpha beta gamma delta epsilon")])
    index = decontaminate.Index(docs, bench)
    assert {r.doc_id for r in index.near(0.8).collect()} == {1, 3}
    assert {(r.doc_id, r.start) for r in index.phrases().collect()} == {(3, 1)}


def test_decontamination_plan_has_no_python(spark, make):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontaminate.decontaminated(make([(1, "a b c")]), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_scratch_is_removed(spark, make, tmp_path):
    """What a block of work stored is gone after it, but for what it keeps; on errors too."""
    import os

    with common.scratch(spark) as keep:
        kept, other = keep(common.stored(make([(1, "a")]), "kept")), common.stored(make([(2, "b")]), "other")
        with common.scratch(spark):
            inner = common.stored(make([(3, "c")]), "inner")
    there = lambda df: os.path.exists(df.stored_at.removeprefix("file:"))
    assert (there(kept), there(other), there(inner)) == (True, False, False) and kept.count() == 1
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        other = common.stored(make([(2, "b")]), "other")
        1 / 0
    assert not there(other)
    common.discard(kept)
    common.discard(kept)
    assert not there(kept)


def test_near_duplicates_leave_little_behind(spark, make):
    """Of all that is written only the described documents and the labels are still read afterwards."""
    import os

    text = " ".join(f"w{k}" for k in range(40))
    made: list[str] = []
    common._MADE.append(made)
    try:
        found = near_duplicates.near_duplicates(make([(1, text), (2, text + " x"), (3, "y " + text), (4, "z")]))
    finally:
        common._MADE.remove(made)
    left = [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert len(made) > 8 and len(left) == 2
    assert {r.doc_id for r in found.where("kept").collect()} == {1, 4}
