"""Language identification: codes, plain learner, held-out rows, odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from formgrain.llm import common, languages

SCHEMA = "doc_id long, text string, lang string, source string, label int, order long, key int"
SOUNDS = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["ção", "nha", "lho"], "dd": ["ый", "ого", "ста"], "ee": ["ąk", "szcz", "ów"], "ff": ["tion", "the", "ing"], "gg": ["èr", "eau", "oux"]}


def written(rng, lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang] + ["a", "e", "n"]) for _ in range(rng.randrange(2, 5))).capitalize() for _ in range(words))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3) for i, t, lang in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 5, 6, 9, 40])
def test_codewords_differ(count):
    code = languages.codewords(count)
    assert code.shape[0] == count and set(np.unique(code)) <= {-1, 1}
    if count > 1:
        assert (np.abs(code.sum(axis=0)) < count).all()
        apart = (code.shape[1] - code.astype(int) @ code.T) // 2
        apart[np.arange(count), np.arange(count)] = 99
        # A codeword is still the nearest one after any such number of wrong bits.
        assert (apart.min() - 1) // 2 >= (0 if count < 4 else 1)


def test_decoding_corrects_wrong_bits():
    code = languages.codewords(6)
    margin = 3.0 * code
    margin[np.arange(6), np.arange(6)] *= -1
    best, shares, close = languages.decoded(margin, code, 0.5)
    assert best.tolist() == list(range(6)) and (shares > 0.5).all() and not close.any()
    best, shares, close = languages.decoded(np.zeros((1, code.shape[1])), code, 0.5)
    assert best.tolist() == [0] and close.all() and np.allclose(shares, 1 / 6)


def test_features_count_every_place():
    s = languages.Settings(slice_chars=7, slots=1 << 10)
    line = languages.letters_of("Ab1cd, ÉF--\n gh ij kl mn op".encode())
    assert line == " ab cd éf gh ij kl mn op "
    whole = Counter(np.concatenate(list(languages.grams(line, languages.Settings(slots=1 << 10)))).tolist())
    assert Counter(np.concatenate(list(languages.grams(line, s))).tolist()) == whole
    at, values = languages.example(line, s)
    assert dict(zip(at[:-1].tolist(), (values[:-1] * 3 * len(line)).round().astype(int).tolist())) == dict(sorted(whole.items()))
    assert np.allclose(languages.margins([line], np.eye(s.slots + 1, 1, -s.slots), s), 1.0)


def test_learner_is_plain_logistic_regression():
    """Each bit by itself, entry by entry, in the same order."""
    s, code, rng = languages.Settings(slots=8, epochs=2), languages.codewords(3), np.random.default_rng(1)
    rows = []
    for order in range(12):
        at = np.append(np.sort(rng.choice(8, 3, replace=False)), 8).astype(np.int32)
        rows.append((order, int(rng.integers(3)), at, rng.random(4).astype(np.float32)))
    batch = common.key_batch([(0, common.pack(np.array([o]), np.array([y], np.int32), np.array([4]), at, x)) for o, y, at, x in rows])
    (out,) = languages.learned(iter([batch]), code, s)
    found = common.unpack(out.column(1)[0].as_py())[0].reshape(9, -1)
    for bit in range(code.shape[1]):
        w, past = [0.0] * 9, [1e-8] * 9
        for epoch in range(2):
            for k in np.lexsort((common.mixed(np.arange(12, dtype=np.uint64) + np.uint64(epoch)),)):
                _, label, at, x = rows[k]
                y = int(code[label, bit])
                slope = -y / (1 + np.exp(y * sum(float(v) * w[i] for i, v in zip(at, x))))
                for i, v in zip(at, x):
                    past[i] += (slope * v) ** 2
                    w[i] -= s.rate * slope * v / past[i] ** 0.5
        assert np.allclose(found[:, bit], w, atol=1e-3)


@pytest.mark.parametrize("langs", [["aa", "bb"], ["aa", "bb", "cc", "dd"], list(SOUNDS)])
def test_held_out_rows_are_told(spark, langs):
    rng = random.Random(7)
    # One language holds most rows, and lengths go from one word up.
    rows = [(i, written(rng, lang, rng.choice([1, 2, 5, 40])), lang) for i in range(700) for lang in [rng.choice(langs + [langs[0]] * len(langs))]]
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "wrong") for i, t, lang in rows]
    truth = {i: lang for i, t, lang in rows}
    told = {r.doc_id: r for r in languages.languages(frame(spark, rows)).collect()}
    rng = random.Random(7)
    real = {i: lang for i in range(700) for lang in [rng.choice(langs + [langs[0]] * len(langs))] if written(rng, lang, rng.choice([1, 2, 5, 40]))}
    held = [i for i in truth if truth[i] == "wrong"]
    assert {r.doc_id for r in told.values() if r.held_out} == set(held)
    assert {r.lang_pred for r in told.values()} <= set(langs)
    assert sum(told[i].lang_pred == real[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in told.values())


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, written(rng, lang, 30), lang) for i in range(100) for lang in [rng.choice(["aa", "bb"])]]
    odd = [(None, written(rng, "aa", 20), None), (500, None, "aa"), (501, "", "bb"), (502, "12 -- ²½ !", "aa"), (503, "漢字", None), (3, "ka", "aa"), (3, "ka", "aa"),
           (504, "ka " * 60_000, None), (505, "x\0y", None)]
    found = languages.languages(frame(spark, rows + odd)).collect()
    assert len(found) == 109
    assert {(r.lang_pred, r.score, r.ambiguous) for r in found if r.doc_id in (500, 501, 502)} == {("und", 0.0, True)}
    assert [(r.lang_pred, r.held_out) for r in found if r.doc_id is None] == [("aa", False)]
    assert {r.lang_pred for r in found if r.doc_id == 504} == {"aa"}
    assert all(r.lang_pred in ("aa", "bb") for r in found if r.doc_id in (3, 503, 505))


def test_nothing_to_learn(spark):
    assert languages.languages(frame(spark, [])).collect() == []
    assert [tuple(r) for r in languages.languages(frame(spark, [(1, "abc", None)])).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0, True)]
    only = languages.languages(frame(spark, [(1, "abc", "aa"), (4, "xyz", None), (5, "7", None)])).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(only)] == [(1, "aa"), (4, "aa"), (5, "und")]
