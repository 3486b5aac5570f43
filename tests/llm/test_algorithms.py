"""The algorithms against brute force, without Spark."""

import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa

from fanloom.llm import boost, decontaminate, grulm, htmlwrap, langid, minhash, ngramjoin, pii, sentencepieces, vec, warc

TEXTS = ["", "The cat, the CAT!", "Éa öß\nx", None, "a", "  ", "one two three four five", "x" * 5000]


def test_words_and_ngrams():
    buf, off = vec.raw(pa.array(TEXTS))
    h, s, e, first = vec.words(buf, off)
    low = vec.fold(buf).tobytes()
    for k, t in enumerate(TEXTS):
        want = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        assert [low[s[i] : e[i]].decode() for i in range(first[k], first[k + 1])] == want
    assert h[first[1]] == h[first[1] + 2] and h[first[1] + 1] == h[first[1] + 3]
    g, begin = vec.ngrams(h, first, 4)
    assert list(np.diff(begin)) == [0, 1, 1, 0, 1, 0, 2, 1]


def brute_pairs(sets, t):
    out = {}
    for i, j in itertools.combinations(range(len(sets)), 2):
        o = len(sets[i] & sets[j])
        if sets[i] and sets[j] and o / (len(sets[i]) + len(sets[j]) - o) >= t:
            out[i, j] = o
    return out


def test_trie_join_equals_brute_force():
    rng = random.Random(3)
    for case in range(60):
        base = [rng.randint(0, 60) for _ in range(20)]
        sets = [{x if rng.random() < 0.8 else rng.randint(0, 200) for x in base} if rng.random() < 0.6 else {rng.randint(0, 80) for _ in range(rng.randint(1, 25))} for _ in range(25)]
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        sizes = np.array([len(s) for s in sets])
        for t in (0.3, 0.5, 0.8, 1.0):
            want = brute_pairs(sets, t)
            got = {(min(i, j), max(i, j)): o for i, j, o in ngramjoin.trie_pairs(arrays, sizes, t)}
            assert got == want
            cut = {(min(i, j), max(i, j)): o for i, j, o in ngramjoin.trie_pairs(arrays, sizes, t, 10)}
            assert cut == {k: v for k, v in want.items() if k[0] < 10 <= k[1]}


def test_connecting_pairs_connect_the_same():
    rng = random.Random(7)

    def groups(m, pairs):
        up = list(range(m))
        for i, j in pairs:
            up = [up[i] if x == up[j] else x for x in up]
        return {frozenset(k for k in range(m) if up[k] == x) for x in up}

    for case in range(60):
        bases = [[rng.randint(0, 300) for _ in range(20)] for _ in range(rng.choice((1, 2, 40)))]
        sets = [{x if rng.random() < 0.85 else rng.randint(0, 300) for x in rng.choice(bases)} for _ in range(90)]
        arrays, sizes = [np.array(sorted(s), np.uint64) for s in sets], np.array([len(s) for s in sets])
        for t in (0.3, 0.5, 0.8):
            want = brute_pairs(sets, t)
            got = {(min(i, j), max(i, j)): o for i, j, o in ngramjoin.trie_pairs(arrays, sizes, t, connect=True)}
            assert got.items() <= want.items() and groups(90, got) == groups(90, want)
            cut = [(i, j) for i, j, _ in ngramjoin.trie_pairs(arrays, sizes, t, 30, True)]
            within = [k for k in want if k[0] >= 30 or k[1] < 30]
            assert groups(90, cut + within) == groups(90, want)
    base = rng.sample(range(10**6), 60)
    arrays = [np.array(sorted({*base[:-3], *rng.sample(range(10**6), 3)}), np.uint64) for _ in range(200)]
    assert len(ngramjoin.trie_pairs(arrays, np.array([len(a) for a in arrays]), 0.5, connect=True)) < 400  # all have 19,900


def test_sets_of_one_label_cost_no_pairs():
    m, k = 4000, 40
    heads = np.zeros(m + 1, ngramjoin._HEAD)
    heads["kid"], heads["size"], heads["n"] = np.arange(m + 1), k, k
    heads["label"][m] = 1
    begin = time.perf_counter()
    a, b, _, _, c = ngramjoin.shared_beginnings(heads, np.tile(np.arange(k, dtype=np.uint64), m + 1), np.tile(np.arange(k, dtype=np.uint16), m + 1), 0.5, 16)
    assert time.perf_counter() - begin < 5
    assert len(a) == m and set(np.maximum(a, b)) == {m} and len(set(c)) == 1


def test_candidate_rule_keeps_every_pair():
    rng = random.Random(4)
    for t in (0.4, 0.5, 0.7):
        sets = []
        for _ in range(30):
            base = [rng.randint(0, 400) for _ in range(rng.randint(1, 60))]
            sets += [set(base), {x for x in base if rng.random() < 0.75} or {1}]
        heads = np.zeros(len(sets), ngramjoin._HEAD)
        gram, at = [], []
        for k, s in enumerate(sets):
            own = sorted(s)
            n = len(own) - math.ceil(t * len(own) - 1e-9) + 1
            heads[k] = (k, k, len(own), n)
            gram += own[:n]
            at += range(n)
        a, b, sa, sb, c = ngramjoin.shared_beginnings(heads, np.array(gram, np.uint64), np.array(at, np.uint16), t, 16)
        o = ngramjoin.needed(sa, sb, t)
        k = np.minimum(16, np.maximum(o - np.ceil(t * np.maximum(sa, sb) - 1e-9).astype(int), 0))
        linked = {(min(x, y), max(x, y)) for x, y, ok in zip(a, b, c > k) if ok}
        assert set(brute_pairs(sets, t)) <= linked


def test_minhash_recall():
    rng = random.Random(5)
    sets = []
    for _ in range(150):
        base = [rng.getrandbits(48) for _ in range(100)]
        sets += [set(base), {x if rng.random() < 0.88 else rng.getrandbits(48) for x in base}]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = set(brute_pairs(sets, 0.6))
    i, j, jac = minhash.verified_candidates(arrays, 0.6, 30, 5)
    got = set(zip(i.tolist(), j.tolist()))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100 and (jac >= 0.6).all()


def naive_tiles(item, doc, least):
    used_i, used_d, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_d:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return tiles
        n, i, j = best
        used_i.update(range(i, i + n))
        used_d.update(range(j, j + n))
        tiles.append((i, j, n))


def test_greedy_tiles_equal_the_naive_search():
    rng = random.Random(6)
    for _ in range(150):
        item = [rng.randint(0, 3) for _ in range(rng.randint(4, 18))]
        doc = [rng.randint(0, 3) for _ in range(rng.randint(4, 40))]
        pairs = [(i, j) for i in range(len(item) - 3) for j in range(len(doc) - 3) if item[i : i + 4] == doc[j : j + 4]]
        got = decontaminate.greedy_tiles(np.array(pairs, np.int64).reshape(-1, 2), np.full(len(pairs), 4))
        assert sorted(got) == sorted(naive_tiles(item, doc, 4))


def segmentations(word, pieces):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield (word[:k], *rest)


def test_forward_sums_all_segmentations():
    pieces = [b"ab", b"abc", b"bc", b"ca", b"aa", b"cab"]
    lattice = langid.Lattice(pieces)
    rng = np.random.default_rng(1)
    prob = rng.random((lattice.size, 2))
    known = {p: k for k, p in enumerate([*pieces, *[bytes([b]) for b in range(256)]])}
    words = [b"abcab", b"a", b"aabca", b"zabcz", b"abc" * 8]
    buf, off, order, ends = langid._by_length(words)
    ll, alpha, scale = langid.forward(lattice.edges(buf, off), len(words), prob, ends)
    for place, k in enumerate(order):
        want = sum(np.prod([prob[known[p]] for p in s], axis=0) for s in segmentations(words[k], set(known)))
        assert np.allclose(np.exp(ll[place]), want)
    weight = np.ones((len(words), 2))
    counts = langid.expected_counts(lattice.edges(buf, off), alpha, scale, prob, ends, ll, weight)
    size = np.array([len(p) for p in [*pieces, *[b"x"] * 256]])
    assert np.allclose((counts * size[:, None]).sum(0), sum(map(len, words)))


def test_language_accuracy_on_made_texts():
    rng = random.Random(7)
    pools = {"aa": ["the", "thing", "ation", "her"], "bb": ["der", "schen", "ung", "keit"], "cc": ["que", "cion", "ado", "los"]}
    make = lambda p: " ".join("".join(rng.choice(pools[p]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))
    texts = [(make(k), k) for k in pools for _ in range(80)]
    model = langid.fit([t for t, _ in texts[::2]], [k for _, k in texts[::2]], langid.read_pieces())
    held = texts[1::2]
    best, _, _, _, ok = langid._decide(model, pa.array([t for t, _ in held]))
    assert np.mean([model.langs[b] == k for b, (_, k) in zip(best, held)]) > 0.97 and ok.mean() > 0.95
    noise = ["".join(chr(rng.randint(33, 64)) for _ in range(8)) + " " for _ in range(40)]
    assert not langid._decide(model, pa.array(["".join(noise), "", None, "  "]))[4].any()


def test_sentencepiece_equals_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.VOCABULARY)
    v = sentencepieces.vocabulary()
    rng = random.Random(8)
    pool = "".join(map(chr, [*range(1, 0x250), *range(0x370, 0x500), *range(0x2000, 0x2070), *range(0x3040, 0x3080)])) + " ▁\n" * 40 + "theanding" * 30
    for text in ["", " ", "a  b\n\nc", "日本 🎉\t", "a" * 3000, *["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(3000)]]:
        ids = v.encode(text)
        assert ids == sp.encode(text)
        assert v.decode(ids) == text.replace("▁", " ")
    assert v.agenda("▁the") == sp.encode("the")


def test_boosting_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = boost.Trees(40).fit(x[:2000], y[:2000])
    p = 1 / (1 + np.exp(-t.score(x[2000:])))
    assert ((p > 0.5) == (y[2000:] > 0)).mean() > 0.95
    at, value = boost.isotonic(t.score(x[2000:]), y[2000:])
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()


def test_pii():
    r = pii.redactor()
    assert all(p > 0.8 and q > 0.95 for p, q in r.held_out.values())
    text = "Mail ann.22@mail3.example.com or +1 (317) 555-3649, from 55.37.227.225 with token = \"b64b244acde2e3b0aa8f051af1ec018ebaba3add\" end"
    clean = "Version 2.0 of the CC BY-NC 4.0 licence, 12 pages, the year 1998 and the token of thanks."
    (found, nothing, empty, none) = r.spans([text, clean, "", None])
    assert [k for _, _, k, _ in found] == ["email", "phone", "ip", "secret"] and not nothing and not empty and not none
    new = r.redact(text, found)
    assert "555" not in new and "@" not in new and "b64b" not in new and new.endswith('" end')
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82WEST12345698765432")


def brute_match(a, b):
    if a.tag != b.tag:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + brute_match(x[0], y[0]))

    return 1 + best(a.kids, b.kids)


def test_tree_matching_and_templates():
    rng = random.Random(9)

    def shape(depth=0):
        kids = [shape(depth + 1) for _ in range(rng.randint(0, 3))] if depth < 3 else []
        return f"{rng.choice('abc')}({' '.join(kids)})" if kids else rng.choice("abc")

    for _ in range(60):
        x, y = f"r({shape()} {shape()})", f"r({shape()} {shape()})"
        assert htmlwrap.match(htmlwrap.read_shape(x), htmlwrap.read_shape(y)) == brute_match(htmlwrap.read_shape(x), htmlwrap.read_shape(y))
    maps = htmlwrap.induce(["r(a(b) c)", "r(a(b) d c)", "r(c)"])
    assert maps[0] == [0, 1, 2, 3] and maps[1] == [0, 1, 2, 4, 3] and maps[2] == [0, 3]
    root, texts, title = htmlwrap.parse("<title>T</title><p>a <b>b</b><br>c<p>d<script>x<p></script><!-- <p> --></div>&amp;<ul><li>1<li>2</ul>")
    assert title == "T" and [t for _, t in texts] == ["a b", "c", "d", "&", "1", "2"]
    htmlwrap.shape_of(htmlwrap.parse("<div>" * 5000)[0])
    for page in ("", "<", "<p", "</p>", "<a href='x>y", "<script>"):
        htmlwrap.shape_of(htmlwrap.parse(page)[0])


def test_warc_parse_rejects_broken_records():
    import pytest

    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(h["warc-type"], b) for h, b in warc.parse(good * 2)] == [("response", b"abc")] * 2
    with pytest.raises(ValueError):
        list(warc.parse(good[:-6]))
    with pytest.raises(ValueError):
        list(warc.parse(b"junk" + good))


def small_gru(v=11):
    m = grulm.Gru(np.arange(v, 0, -1).astype(float), classes=3, hidden=4, embedding=3, seed=1)
    rng = np.random.default_rng(3)
    for k in m.p:
        m.p[k] = rng.standard_normal(m.p[k].shape) * 0.5
    return m


def test_gru_gradients():
    m = small_gru()
    rng = np.random.default_rng(4)
    steps, lanes = 5, 3
    ins, outs = rng.integers(0, 11, (steps, lanes)), rng.integers(0, 11, (steps, lanes))
    fresh = (rng.random((steps, lanes)) > 0.3).astype(float)
    live = rng.random((steps, lanes)) > 0.2
    start = rng.standard_normal((lanes, 4)) * 0.3

    def mean():
        h, total = start, 0.0
        x = m.p["E"][ins] @ m.p["W"] + m.p["b"]
        for t in range(steps):
            h, *_ = m.step(x[t], h * fresh[t][:, None])
            total += m.output(h, outs[t])[live[t]].sum()
        return total / live.sum()

    before = {k: v.copy() for k, v in m.p.items()}
    m.window(ins, outs, fresh, live, start, {k: np.full_like(v, 1e12) for k, v in m.p.items()}, 1.0)
    grads = {k: (m.p[k] - before[k]) * 1e6 for k in before}
    m.p = {k: v.copy() for k, v in before.items()}
    for k in m.p:
        for at in [tuple(rng.integers(0, n) for n in m.p[k].shape) for _ in range(6)]:
            old = m.p[k][at]
            m.p[k][at] = old + 1e-5
            up = mean()
            m.p[k][at] = old - 1e-5
            down = mean()
            m.p[k][at] = old
            assert abs((up - down) / 2e-5 - grads[k][at]) < 2e-3, (k, at)


def test_gru_scores_equal_one_document_at_a_time_and_sum_to_one():
    m = small_gru()
    rng = np.random.default_rng(5)
    sizes = [0, 1, 7, 150, 3]
    ids = rng.integers(2, 11, sum(sizes)).astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    got = grulm.score(m, ids, begin, lanes=3, window=4)
    table = m.p["E"] @ m.p["W"] + m.p["b"]
    for k in range(len(sizes)):
        h, total, last = np.zeros((1, 4)), 0.0, 1
        for w in [*ids[begin[k] : begin[k + 1]], 1]:
            h, *_ = m.step(table[[last]], h)
            total += m.output(h, np.array([w]))[0]
            last = w
        assert abs(total - got[k]) < 1e-3
    every = np.arange(11)
    assert abs(np.exp(m.output(np.repeat(h, 11, 0), every)).sum() - 1) < 0.2  # the last class has empty places


def test_gru_learns():
    rng = np.random.default_rng(6)
    docs = [np.tile([2, 3, 4, 5, 6], 8) for _ in range(60)]
    ids, begin = np.concatenate(docs).astype(np.int32), np.arange(61) * 40
    freq = np.bincount(ids, minlength=8).astype(float) + 1
    m = grulm.Gru(freq, classes=2, hidden=16, embedding=8)
    before = grulm.score(m, ids, begin).sum()
    squares = {k: np.full_like(v, 1e-4) for k, v in m.p.items()}
    for _ in range(6):
        grulm.train_on(m, ids, begin, squares, lanes=8)
    assert grulm.score(m, ids, begin).sum() > before * 0.5
    del rng


def test_long_words_equal_short_ones_and_never_underflow():
    pieces = [b"ab", b"abc", b"bc", b"ca", b"aa", b"cab"]
    lattice = langid.Lattice(pieces)
    rng = np.random.default_rng(11)
    prob = rng.random((lattice.size, 2)) + 1e-3
    words = [b"abcab", b"a", b"aabca", b"zabcz", b"abc" * 8]
    buf, off, order, ends = langid._by_length(words)
    edges = lattice.edges(buf, off)
    ll, alpha, scale = langid.forward(edges, len(words), prob, ends)
    weight = rng.random((len(words), 2))
    want = langid.expected_counts(edges, alpha, scale, prob, ends, ll, weight)
    got = sum(langid.long_counts(lattice.uses(words[k]), len(words[k]), prob, weight[place]) for place, k in enumerate(order))
    assert np.allclose(got, want)
    for place, k in enumerate(order):
        assert np.allclose(langid.long_scores(lattice, words[k], prob), ll[place])
    uneven = np.full((lattice.size, 2), 1e-7)
    uneven[:, 1] = 0.5
    one = langid.long_scores(lattice, b"z" * 5000, uneven)
    assert np.allclose(one, [5000 * np.log(1e-7), 5000 * np.log(0.5)])


def language_model():
    rng = random.Random(7)
    pools = {"aa": ["the", "thing", "ation", "her"], "bb": ["der", "schen", "ung", "keit"]}
    make = lambda p: " ".join("".join(rng.choice(pools[p]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))
    texts = [(make(k), k) for k in pools for _ in range(60)]
    return langid.fit([t for t, _ in texts] + ["their" * 100], [k for _, k in texts] + ["aa"], langid.read_pieces()), make


def test_a_long_word_leaves_the_documents_after_it_alone():
    model, make = language_model()
    texts = [make("aa"), make("bb"), make("aa"), make("bb")]
    own = [langid._decide(model, pa.array([t])) for t in texts]
    for long in ("belich" * 50, "thing" * 1000, "中文" * 3000, "🙂" * 500):
        best, mean, share, words, ok = langid._decide(model, pa.array([long, *texts]))
        assert np.isfinite(mean).all() and np.isfinite(share).all()
        for k, one in enumerate(own):
            assert [x[k + 1] for x in (best, mean, share, words, ok)] == [x[0] for x in one]


def test_scores_do_not_depend_on_what_was_seen_before():
    model, make = language_model()
    texts = [make(k) for k in ("aa", "bb") * 40] + ["thing" * 30, "", None]
    first, again = model.texts(pa.array(texts)), model.texts(pa.array(texts))
    alone = [model.texts(pa.array([t], pa.string()))[0][0] for t in texts]
    assert (first[0] == again[0]).all() and (first[0] == np.array(alone)).all()


def test_unspaced_texts_take_linear_time():
    import time

    model, _ = language_model()
    rng = random.Random(13)
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(20_000))
    model.texts(pa.array(["warm"]))
    begin = time.process_time()
    total, *_ = model.texts(pa.array([chinese]))
    assert time.process_time() - begin < 5 and np.isfinite(total).all()
    begin = time.process_time()
    total, *_ = model.texts(pa.array(["".join(rng.choice("theingsor") for _ in range(1 << 19))]))
    assert time.process_time() - begin < 10 and np.isfinite(total).all()
