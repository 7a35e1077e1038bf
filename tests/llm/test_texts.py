"""Rules, counts, classifier, page text, language model and piece coding."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from formgrain.llm import anomalies, classifier, common, mixing, pages, pieces, tokens
from tests.llm.conftest import corpus

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = "ab eTh\n\t  ▁éß漢字🙂0123.,-#=<s>\0⁇­԰ⴧꟀ𐔀"
texts = st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters(codec="utf-8")), max_size=60)
words = st.lists(st.sampled_from(["the", " of", "  ", "function", "\n\n", "<|endoftext|>", "'s", "'LL", "漢字", "é", "1234", " - ", "<s>", "▁▁", "ing"]), max_size=20).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(texts, words))
def test_pieces_are_the_library_s(text):
    library, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.model_of(PIECES)
    ids = library.encode(text, add_eos=True)
    assert mine.encode(text) == " ".join(map(str, ids))
    assert mine.decode(" ".join(map(str, ids))).decode() == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_decoding_of_any_ids(ids):
    library, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.model_of(PIECES)
    assert mine.decode(" ".join(map(str, ids))).decode() == library.decode(ids)


@pytest.mark.parametrize("text", ["aaaaaaaaaaaaaaaaaaaaaaa", "abababababab", "ttttthethethe", "inginginging"])
def test_backtracking_is_merging(text):
    model = pieces.model_of(PIECES)
    symbols = list(text)
    while True:
        ranks = [(model.ranks.get(a + b, math.inf), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        if not ranks or min(ranks)[0] == math.inf:
            break
        k = min(ranks)[1]
        symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
    assert model.backtracked(text) == symbols


@settings(max_examples=400, deadline=None)
@given(st.one_of(texts, words))
def test_token_counts_are_the_library_s(text):
    lengths = tokens.lengths_of(BYTES, tokens.packed(["the", " of"], [1, 1]))
    assert lengths.count(text) == len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids)


def test_coded_and_counted_tables(make):
    docs = corpus(4) + [(None, "a<|endoftext|>b"), (1, "again")]
    library, tokenizer = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
    expected = sorted((str(i), " ".join(map(str, library.encode(t or "", add_eos=True))), library.decode(library.encode(t or ""))) for i, t in docs)
    found = pieces.encode_and_decode(make(docs), PIECES).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in found) == expected
    assert all(r.n_tokens == len(r.ids.split()) for r in found)
    counted = sorted((str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in docs)
    rows = tokens.token_counts(make(docs), BYTES).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == counted
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert pieces.encode_and_decode(make([]), PIECES).collect() == [] == tokens.token_counts(make([]), BYTES).collect()


def rule_row(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    repeated = {j for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def test_quality_rules(spark, make, labels_of):
    rng = random.Random(1)
    docs = corpus(5, 150) + [(2000, "a b c d e f g h " * 3), (2001, "x\nx\n \n\ny # * [ ]\nx"), (None, "few")]
    docs += [(3000 + k, " ".join(rng.choice(["###", "|", "$$$ X", "&&"]) for _ in range(200))) for k in range(8)]
    labels = labels_of([(i, int(i < 100)) for i, _ in docs if i is not None and (i < 100 or i >= 3000)] + [(None, 0), (7, 5)])
    rows = anomalies.quality_rules(make(docs), labels).collect()
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert found == sorted((str(i), *rule_row(t)) for i, t in docs)
    assert not any(r.kept for r in rows if r.base_failed)
    assert not any(r.kept for r in rows if r.doc_id and r.doc_id >= 3000)
    clean = [r.kept for r in rows if not r.base_failed and (r.doc_id or 0) < 100]
    assert sum(clean) >= 0.95 * len(clean)
    assert anomalies.quality_rules(make([]), labels).collect() == []
    assert len(anomalies.quality_rules(make(docs[:3]), labels_of([])).collect()) == 3


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2000, 4))
    forest = anomalies.Forest(rows, anomalies.Settings())
    assert forest.scores(np.full((1, 4), 8.0))[0] > np.quantile(forest.scores(rows), 0.999)
    assert (anomalies.Forest(np.zeros((0, 4)), anomalies.Settings()).scores(rows) == 0).all()


def test_classifier_on_held_out_rows(spark, sf_dir, labels_of, make):
    big = sf_dir.replace("0.001", "0.01")
    documents, labels = common.table(spark, big, "documents"), common.table(spark, big, "labels")
    rows = classifier.quality_scores(documents, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.7 for s in good]) > 0.98
    # Held-out labels teach nothing.
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - quality, quality) AS quality")
    again = {r.doc_id: r.score for r in classifier.quality_scores(documents, turned).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_classifier_of_odd_rows(make, labels_of):
    docs = [(1, "good text here"), (1, "good text here"), (3, None), (4, ""), (None, "bad $$$"), (5, "bad $$$ !!")]
    rows = classifier.quality_scores(make(docs), labels_of([(1, 1), (5, 0), (None, 1), (4, 7)])).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.score for r in classifier.quality_scores(make(docs), labels_of([])).collect()} == {0.5}
    assert classifier.quality_scores(make([]), labels_of([(1, 1)])).collect() == []
    kept = classifier.good_documents(make(docs), labels_of([(1, 1)]), 0.5)
    assert kept.columns == make(docs).columns and kept.count() == 6


def test_sample_of_labels_keeps_its_bound(make, labels_of):
    docs = [(i, f"text {i}") for i in range(400)]
    s = classifier.Settings(sample=100)
    weights = classifier.train(make(docs), labels_of([(i, i % 2) for i in range(400)]).selectExpr("doc_id", "quality AS label"), s)
    assert len(weights) == s.slots + 1


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", "\0", inner)).split("\0")
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_page_texts(spark, sf_dir):
    table = common.table(spark, sf_dir, "pages")
    source = {r.page_id: (r.url, r.html) for r in table.collect()}
    for r in pages.main_texts(table.withColumn("text", table.url)).collect():
        assert (r.url, r.text, r.n_chars) == (source[r.page_id][0], article(source[r.page_id][1]), len(r.text))


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div role=navigation>go home</div><div id=page><div class="left sidebar">
Side text, long</div><div class="post"><h2>T &amp; t</h2><p>One  two<p>Three &lt;b&gt;<ul><li>a<li>b</ul><table><tr><td>x<td>y</table><pre>
 p  q</pre><div class="ad-box">buy now</div><form>mail <input></form><aside>as</aside><p hidden>h</p></div><section id="comments"><p>Nice post! I like it
a lot, really a lot of words stand here, more than in the post</section></div><div class="cookie_notice">We use cookies</div><footer>f</footer>"""


@pytest.mark.parametrize(("page", "text"), [
    (PAGE, "T & t One two Three <b> a b x y p q"), (None, ""), ("", ""), ("plain &lt;text", "plain <text"), ("<p>open <b", "open"),
    ("<script>var x = '<p>no</p>'</script><p>yes", "yes"), ("<nav>only</nav>", ""), ("<p>" + "w " * 200_000, "w " * 199_999 + "w"),
])
def test_page_parts(spark, page, text):
    table = spark.createDataFrame([(1, None, page, "x")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in pages.main_texts(table).collect()] == [(1, None, text, len(text))]


LONG, SHORT = ("long text " * 60).strip(), ("less text " * 40).strip()


@pytest.mark.parametrize(("page", "text"), [
    (f"<div>u v</div><article><h1>Title</h1><p>lead</p><div class=body><p>{LONG}</p><p>{LONG}</p></div></article><div>w</div>", f"Title lead {LONG} {LONG}"),
    (f"<article><section><p>{LONG}</section><section><p>{SHORT}</section></article>", f"{LONG} {SHORT}"),
    (f"<div><a>u</a></div><div><div><p>{LONG}</div><div><p>{SHORT}</div></div>", f"{LONG} {SHORT}"),
    (f"<main><h1>T</h1><article><p>{LONG}</article><article><p>{SHORT}</article></main>", f"T {LONG} {SHORT}"),
    (f"<div><a>u</a><a>v</a></div><div><h1>T</h1><p>{SHORT}</p><table><tr><td>{LONG * 20}</table><p>{SHORT}</div>", f"T {SHORT} {LONG * 20} {SHORT}"),
    (f"<article><p>one</p><table><tr><td>{LONG * 20}</table><p>two</article>", f"one {LONG * 20} two"),
])
def test_nested_and_split_articles(page, text):
    assert pages.main_text(f"<body>{page}</body>").endswith(text)


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "layout with-sidebar", "content hidden-print", "page-wrapper header-fixed", "elementor-widget-container", "sidebar", "hidden"])
@pytest.mark.parametrize("inside", ["<article>{}</article>", "<main>{}</main>", "{}"])
def test_names_of_wrappers(name, inside):
    body = f"<h1>T</h1><p>{LONG}</p><div class=sidebar><p>side</p></div><p>{SHORT}</p>"
    page = f"<nav>n</nav><div class='{name}'>{inside.format(body)}</div><div class='ad-box'><p>buy {SHORT}</p></div><footer>f</footer>"
    assert pages.main_text(f"<body>{page}</body>") == f"T {LONG} {SHORT}"


def test_names_beside_an_article():
    page = f"<article><p>{SHORT}</p></article><section id=comments><article><p>{LONG}</p></article><article><p>{LONG}</p></article></section>"
    assert pages.main_text(f"<body>{page}</body>") == SHORT


def test_gaussian_and_threshold():
    ratios = np.array([2.0, 1, 1, 90, 80, 5, 95, 2, 1, 1])
    assert pages.content(pages.smoothed(ratios)).tolist() == [False, False, False, True, True, True, True, False, False, False]
    assert pages.content(np.array([3.0])).all()


@pytest.mark.parametrize("size", [mixing.Settings(), mixing.Settings(common=50, tree=10, slot_bits=12), mixing.Settings(common=3, tree=3)])
def test_language_scores(make, size):
    docs = corpus(6, 90) + [(None, "Rare Words only here")]
    rows = mixing.language_scores(make(docs), size).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    counts: Counter = Counter()
    low = lambda t: [w.lower() for w in (t or "").encode().split()] + [b""]
    for i, t in docs:
        if not held[i]:
            counts.update(low(t))
    total = sum(counts.values())
    base = math.log10(total + 0.5 * (len(counts) + 1))
    expected = {i: (held[i], len(low(t)), sum(counts[w] > 0 for w in low(t)), total, sum(math.log10(counts[w] + 0.5) - base for w in low(t))) for i, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected[r.doc_id][:4]
        assert abs(r.base_score - expected[r.doc_id][4]) < 1e-3
        assert r.score < 0
    if size == mixing.Settings():
        assert sum(r.score for r in rows if not r.held_out) > sum(r.base_score for r in rows if not r.held_out)


def test_contexts_are_not_merged(make):
    """Scores hang on no number of slots; equal rows have equal scores and counts."""
    docs = corpus(7, 90) + [(5000, "twice the same row"), (5000, "twice the same row")]
    wide, narrow = ({(r.doc_id, round(r.score, 6), r.n_known) for r in mixing.language_scores(make(docs), s).collect()} for s in (mixing.Settings(), mixing.Settings(slot_bits=6)))
    assert wide == narrow and len(wide) == len(docs) - 1
    once = [r.n_tokens >= r.n_known for r in mixing.language_scores(make(docs), mixing.Settings(common=3, tree=3)).collect()]
    assert all(once)


@pytest.mark.parametrize("hot", [0, 4])
def test_counts_of_contexts(hot):
    """Zeros and ones of every node against a plain count, with some contexts from another table."""
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 900, 40))[::-1].copy()
    tree = mixing.Tree(common.mixed(np.arange(1, 41, dtype=np.uint64)), counts, int(counts.sum()) + 9, 45, mixing.Settings(tree=30))
    context, leaf = rng.integers(0, 9, 500), rng.integers(0, tree.k + 1, 500)
    keys = context * (tree.k + 1) + tree.place[leaf]
    own, other = mixing.Seen.of(keys[context >= hot]), mixing.Seen.of(keys[context < hot])
    token, node, bit = mixing.path(tree, leaf)
    plain = Counter(zip(context[token].tolist(), node.tolist(), bit.tolist(), strict=True))
    asked, ask = rng.integers(0, 10, 200), rng.integers(0, tree.k + 1, 200)
    token, node, _ = mixing.path(tree, ask)
    zeros, ones = (a + b for a, b in zip(own.counts(tree, np.where(asked < hot, -1, asked), ask), other.counts(tree, np.where(asked < hot, asked, -1), ask), strict=True))
    assert zeros.tolist() == [plain[asked[t], n, 0] for t, n in zip(token, node, strict=True)]
    assert ones.tolist() == [plain[asked[t], n, 1] for t, n in zip(token, node, strict=True)]


def test_language_scores_of_odd_tables(make):
    assert mixing.language_scores(make([])).collect() == []
    only = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in mixing.language_scores(make(only)).collect()} == {(0, 0, 0.0, 0.0)}


def block_of(rng, tree, n=400):
    """Tokens in few contexts, sorted as a block holds them."""
    one, two, three = (rng.integers(0, 3, n).astype(np.uint32) for _ in range(3))
    leaf, owner, kind = rng.integers(0, tree.leaves, n).astype(np.int32), rng.integers(0, 20, n), rng.integers(0, 3, n).astype(np.int8)
    known = np.where(one == 2, 0, -1).astype(np.int16)
    order = np.lexsort((owner, tree.place[leaf], three, two, one))
    followers = mixing.Seen.of(tree.place[leaf[(known == 0) & (kind < 2)]].astype(np.int64))
    return mixing.Block(tree, followers, *(x[order] for x in (one, two, three, leaf, known, owner, kind))), [x[order] for x in (one, two, three, leaf, kind)]


def code_tree(rng, buckets=4):
    codes = common.mixed(np.arange(1, 60, dtype=np.uint64))
    return mixing.Tree(codes, np.sort(rng.integers(1, 900, 59))[::-1].copy(), 40_000, 70, mixing.Settings(tree=40), rng.uniform(1, 300, buckets))


def test_model_probabilities_sum_to_one():
    """Over all leaves of the tree, in any context, by the predictor that scores."""
    rng = np.random.default_rng(2)
    tree = code_tree(rng)
    block, _ = block_of(rng, tree)
    mixer = block.mixer(mixing.Settings(batch=64))
    for token in rng.integers(0, 400, 12):
        each = block.log10(mixer, np.full(tree.leaves, token), np.arange(tree.leaves))
        assert abs((10 ** each).sum() - 1) < 1e-4
    assert np.isclose(2.0 ** -tree.lengths.astype(float) @ np.ones(tree.leaves), 1) and len(set(tree.place.tolist())) == tree.leaves


def test_predictor_against_plain_counts():
    """Bit for bit: counts of the same context among training tokens, logits, gate, weights and refining."""
    rng = np.random.default_rng(5)
    tree = code_tree(rng)
    block, (one, two, three, leaf, kind) = block_of(rng, tree)
    mixer = block.mixer(mixing.Settings(batch=64))
    weights, refined = mixer.weights.astype(float), mixer.refined.astype(float)
    way = {i: [(int(n), int(b)) for n, b in zip(*(x.tolist() for x in mixing.path(tree, np.array([i]))[1:]), strict=True)] for i in range(tree.leaves)}
    for token in rng.integers(0, 400, 25).tolist():
        total = 0.0
        for depth, (node, bit) in enumerate(way[int(leaf[token])]):
            x, gate = [float(tree.logit[node])], min(depth // 4, 3)
            for order in range(3):
                same = [j for j in range(400) if kind[j] < 2 and all(c[j] == c[token] for c in (one, two, three)[:order + 1])]
                met = [b for j in same for n, b in way[int(leaf[j])] if n == node]
                x.append(math.log((sum(met) + 0.2) / (len(met) - sum(met) + 0.2)) if met else x[0])
                gate = gate * 4 + sum(len(met) >= m for m in (1, 4, 32))
            logit = float(weights[gate] @ x)
            slot = min(depth // 4, 3) * mixing.REFINED + int(np.clip(logit * 1.5 + mixing.REFINED // 2, 0, mixing.REFINED - 1))
            p = min(max((1 / (1 + math.exp(-logit)) + refined[slot]) / 2, 1e-6), 1 - 1e-6)
            total += math.log10(p if bit else 1 - p)
        assert abs(total - block.log10(mixer, np.array([token]))[0]) < 1e-3


def test_tree_travels_as_lengths():
    import pickle

    rng = np.random.default_rng(8)
    tree = code_tree(rng, 16)
    copy = pickle.loads(pickle.dumps(tree))
    for name in ("code", "place", "middle", "base", "leftmost", "logit", "rank", "first"):
        assert np.array_equal(getattr(tree, name), getattr(copy, name))
    words = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    leaf, count = tree.look_up(words)
    assert (leaf >= tree.k).all() and (leaf < tree.leaves).all() and (count < 0).all()
    large = mixing.Tree(common.mixed(np.arange(200_000, dtype=np.uint64)), np.arange(200_000, 0, -1), 1 << 40, 300_000, mixing.Settings(), np.ones(4096))
    assert len(pickle.dumps(large)) < 6_000_000


def test_rare_words_have_probabilities(make):
    """With a tree of few words and many buckets, the words of a bucket share what the bucket has."""
    docs = corpus(9, 120)
    s = mixing.Settings(tree=30, common=60, in_bucket=4)
    rows = {r.doc_id: r for r in mixing.language_scores(make(docs), s).collect()}
    plain = {r.doc_id: r for r in mixing.language_scores(make(docs), mixing.Settings(tree=30, common=60, in_bucket=10_000)).collect()}
    assert rows.keys() == plain.keys()
    learned = [i for i, r in rows.items() if not r.held_out]
    # Contexts tell rare words as well.
    assert sum(rows[i].score for i in learned) > sum(plain[i].score for i in learned)
    assert all(rows[i].base_score == pytest.approx(plain[i].base_score) for i in rows)


def test_pipeline(spark, make, sf_dir):
    """Every stage against a plain version of its own, on what the stage before kept."""
    import corpus_pipeline
    from tests.llm.test_repeats import byte_strings, hits, near

    docs, kept = common.table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, sf_dir), "stage")
        kept.append((name, docs.collect(), out.collect()))
        if name != "sentencepiece":
            assert out.schema == docs.schema
        docs = out
    stages = {name: (before, after) for name, before, after in kept}
    before, after = stages["quality_classifier"]
    labels = common.table(spark, sf_dir, "labels")
    scores = {r.doc_id: r.predicted for r in classifier.quality_scores(common.table(spark, sf_dir, "documents"), labels).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id]}
    before, after = stages["near_dedup"]
    groups = near([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after) == sorted(i for i, g in groups.items() if g[2])
    before, after = stages["suffix_dedup"]
    plain = {x[0]: x for x in byte_strings([(r.doc_id, r.text) for r in before], 200)}
    assert len(after) == len(before)
    for r in after:
        if plain[r.doc_id][2] == 0:
            assert hashlib.sha256(r.text.encode()).hexdigest() == plain[r.doc_id][4]
        assert r.n_chars == len(r.text) and len(r.text.encode()) <= plain[r.doc_id][1] - plain[r.doc_id][2]
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    found = hits([(r.doc_id, r.text) for r in before], items)
    assert {r.doc_id for r in after} == {i for i, h in found.items() if not h[4]}
    before, after = stages["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {r.doc_id: r.ids for r in after} == {r.doc_id: " ".join(map(str, library.encode(r.text, add_eos=True))) for r in before}
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(final) == sorted(after)


def test_pipeline_stages_keep_odd_rows(spark, make):
    """Rows without an id, different texts under one id, repeated rows and null texts: none is lost or crossed."""
    import corpus_pipeline

    long = " ".join(f"word{k}" for k in range(80))
    rows = [(None, "first " + long), (None, "second text"), (3, long + " third"), (3, "short"), (3, "short"), (4, None), (4, ""), (None, None)]
    cut = corpus_pipeline.suffix_dedup(spark, make(rows), "")
    assert cut.columns == make(rows).columns
    found = cut.collect()
    assert sorted(((r.doc_id, r.text and r.text.strip()) for r in found), key=str) == sorted(
        [(None, "first"), (None, "second text"), (3, "third"), (3, "short"), (3, "short"), (4, None), (4, ""), (None, None)], key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)


def test_pages_without_a_head_s_end():
    body = f"<h1>T</h1><p>{LONG}</p><p>{LONG}</p>"
    assert pages.main_text(f"<html><head><title>x</title><meta charset=u>{body}") == f"T {LONG} {LONG}"
    assert pages.main_text(f"<head><title>x</title>{LONG}<p>{LONG}</p>") == f"{LONG} {LONG}"
    assert pages.main_text(f"<head><script>var a;</script><style>p</style></head>{body}") == f"T {LONG} {LONG}"


def test_page_wide_forms_and_tags_hide_no_article():
    footer = "<footer><p>Imprint</p></footer>"
    assert pages.main_text(f"<body><form action=x><input><div><p>{LONG}</p><p>{LONG}</p></div></form>{footer}</body>") == f"{LONG} {LONG}"
    assert pages.main_text(f"<body><form><nav><a>Home</a></nav><article><h1>T</h1><p>{LONG}</p></article></form>{footer}</body>") == f"T {LONG}"
    assert pages.main_text(f"<body><main><p>{LONG}</p><form><p>Your name</p></form></main><form><p>Search here</p></form></body>") == LONG
    assert pages.main_text(f"<body><article><p>{LONG}</p></article><aside><article><p>{LONG} other</p></article></aside></body>") == LONG


@pytest.mark.parametrize("tag", ["div", "b", "section", "form", "p", "li"])
def test_deep_pages_are_linear(tag):
    began = time.perf_counter()
    page = f"<{tag}>line " * 20_000 + LONG + f"</{tag}></i>" * 20_000
    assert LONG in pages.main_text(f"<body>{page}</body>")
    assert time.perf_counter() - began < 3


def test_long_words_are_linear():
    model, rng = pieces.model_of(PIECES), random.Random(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), "a" * 100_000):
        began = time.perf_counter()
        ids = model.encode(text)
        assert time.perf_counter() - began < 4
        assert ids == " ".join(map(str, library.encode(text, add_eos=True)))


def test_longest_pieces_are_found_in_one_pass(monkeypatch):
    """A word that its longest pieces make up is walked once, and its pairs are judged once over many words."""
    model = pieces.Model(PIECES)
    library, passes, automaton = sentencepiece.SentencePieceProcessor(model_file=PIECES), [], model.automaton

    class Counted:
        def iter_long(self, text):
            passes.append(text)
            return automaton.iter_long(text)

    monkeypatch.setattr(model, "automaton", Counted())
    whole = [p for p in ("\u2581the", "\u2581reading", "\u2581oftionnten", "\u2581Anblewh", "\u2581thoninti") if len(model.backtracked(p)) > 1]
    passes.clear()
    for word in whole:
        longest, at = [], 0
        while at < len(word):
            end, _ = next(automaton.iter_long(word[at:]))
            longest.append(word[at:at + end + 1])
            at += end + 1
        found = model.backtracked(word)
        assert [int(model.ids[p]) for p in found] == library.encode(word[1:])
        if found == longest:
            assert passes == [word]
        passes.clear()
    assert any(len(model.backtracked(w)) > 1 for w in whole) and model.survives.cache_info().maxsize == pieces.CACHED_PAIRS


def test_each_unreadable_byte_is_replaced():
    library, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.model_of(PIECES)
    of = {value: int(i) for value, i in enumerate(mine.bytes)}
    for run in (b"\xe1\x80", b"\xf0\x90\x80", b"\xe1\x80a", b"\xed\xa0\x80", b"\xc3\xe1\x80\x80", b"\xf4\x90\x80\x80"):
        ids = [of[b] for b in run]
        assert mine.decode(" ".join(map(str, ids))).decode() == library.decode(ids)
