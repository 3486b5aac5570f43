"""Averaging over partitions and packed lanes of the language model."""

import numpy as np
from pyspark.sql import functions as F

from fanloom.llm import grulm


def test_averages_equal_the_plain_weighted_mean(spark):
    rng = np.random.default_rng(1)
    rows = [(b, p, float(rng.integers(1, 50)), rng.standard_normal(5).tobytes()) for b in range(3) for p in range(11)]
    df = spark.createDataFrame(rows, grulm.AVERAGED).repartition(4)
    once = grulm.averaged(df).collect()
    twice = grulm.averaged(grulm.averaged(df, F.floor(F.col("place") / 4))).collect()
    for found in (once, twice):
        assert sorted(r.block for r in found) == [0, 1, 2]
        for r in found:
            own = [x for x in rows if x[0] == r.block]
            want = np.average([np.frombuffer(x[3]) for x in own], axis=0, weights=[x[2] for x in own])
            assert np.allclose(np.frombuffer(r.part), want) and r.words == sum(x[2] for x in own)


def test_lanes_hold_every_step_of_every_document():
    rng = np.random.default_rng(2)
    for count in (1, 3, 50):
        sizes = rng.integers(0, 30, 20)
        ids, begin = rng.integers(2, 90, sizes.sum()).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
        rows = grulm.laid_out(ids, begin, count)
        ins, outs, start, doc = rows.window(0, len(rows.active))
        assert len(rows.doc) == (sizes + 1).sum()
        for k in range(20):
            t, lane = np.nonzero(doc == k)
            own = ids[begin[k] : begin[k + 1]].tolist()
            assert len(set(lane)) == 1 and (np.diff(t) == 1).all()
            assert outs[t, lane].tolist() == [*own, grulm._END] and ins[t, lane].tolist() == [grulm._END, *own]
            assert start[t, lane].tolist() == [True] + [False] * len(own)
    rows = grulm.laid_out(np.zeros(0, np.int32), np.zeros(4, np.int64), 2)
    assert len(rows.doc) == 3 and len(grulm.laid_out(np.zeros(0, np.int32), np.zeros(1, np.int64), 2).doc) == 0


def test_a_very_long_text_takes_its_own_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    sizes = np.append(np.full(300, 20), 300_000)
    ids, begin = rng.integers(2, 90, sizes.sum()).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
    tracemalloc.start()
    grulm.laid_out(ids, begin, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_sums_by_word_equal_adding_place_by_place():
    """A word of very many places, some of a few and many of one, as in a window of a real text."""
    rng = np.random.default_rng(4)
    for steps, lanes, d, words in ((24, 64, 8, 500), (5, 3, 3, 4), (1, 1, 2, 1)):
        back = (words * rng.random(steps * lanes) ** 6).astype(np.int64)
        used, counts = np.unique(back, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        to = np.empty(len(used), np.int64)
        to[order] = np.arange(len(used))
        back, counts = to[np.searchsorted(used, back)], counts[order]
        dx = rng.standard_normal((steps, 3, lanes, d))
        want = np.zeros((len(used), 3 * d))
        np.add.at(want, back, dx.transpose(0, 2, 1, 3).reshape(-1, 3 * d))
        assert np.allclose(grulm.Gru(np.ones(2), 1, d, 2)._sums(dx, back, counts), want)


def test_training_keeps_its_memory():
    """The arrays of a window are not paged in again by the next one."""
    import resource

    faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    rng = np.random.default_rng(5)
    sizes = np.full(64, 24 * 40 - 1)
    ids, begin = rng.integers(2, 4096, sizes.sum()).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
    m = grulm.Gru(np.arange(4096, 0, -1).astype(float))
    squares = {k: np.full_like(v, 1e-4) for k, v in m.p.items()}

    @grulm._steady
    def run(batches):
        for _ in batches:
            before = faults()
            grulm.train_on(m, ids, begin, squares)
            yield (faults() - before) / 40

    assert list(run(range(2)))[1] < 150


def test_ids_of_hashes_that_begin_alike():
    h = np.sort(np.array([1, 2, 3, (1 << 48) + 5, (7 << 48) + 1, (7 << 48) + 2, (1 << 64) - 1], np.uint64))
    lex = grulm.Lexicon(h, np.arange(2, 9, dtype=np.int32), np.zeros(257), np.ones(9))
    asked = np.concatenate([h, h - np.uint64(1), h + np.uint64(1)])
    want = [int(np.flatnonzero(h == x)[0]) + 2 if x in h else grulm._UNKNOWN for x in asked]
    assert lex.encode(asked).tolist() == want


def test_likelihoods_of_very_large_logits_are_finite():
    a = np.array([[0, 1, 2], [500, -500, 3], [-900, -901, -902]], np.float32)
    got = grulm._log_softmax(a.copy(), np.array([2, 1, 0]), False)
    wide = a.astype(float) - a.max(1, keepdims=True)
    assert np.allclose(got, (wide - np.log(np.exp(wide).sum(1, keepdims=True)))[[0, 1, 2], [2, 1, 0]], rtol=1e-5)


def test_output_layer_equals_plain_softmax_with_few_products(monkeypatch):
    """Classes of many rows, of few and of none; a product or more for each class would be over 190."""
    rng = np.random.default_rng(6)
    products = []
    for name in ("dot", "matmul"):
        usual = getattr(np, name)
        monkeypatch.setattr(np, name, lambda *a, usual=usual, **k: (products.append(1), usual(*a, **k))[1])
    for rows, words in ((1536, 4096), (1536, 3), (300, 4000), (2, 4096)):
        m = grulm.Gru(np.arange(4096, 0, -1).astype(float), seed=7)
        m.p = {k: v.astype(float) + 0.1 * rng.standard_normal(v.shape) for k, v in m.p.items()}
        d, h, ids = m.hidden, rng.standard_normal((rows, m.hidden)), (words * rng.random(rows) ** 4).astype(np.int64)
        to_top, to_words = np.full((d + 1, m.classes), np.nan), np.full((m.classes, d + 1, m.width), np.nan)
        products.clear()
        ll, dh = m.output(h, ids, 0.5, None, (to_top, to_words))
        assert len(products) < 100
        cls, word = np.divmod(m.place[ids], m.width)
        one = np.arange(rows)
        a, q = h @ m.p["C"] + m.p["c"], np.einsum("nd,ndw->nw", h, m.p["O"][cls]) + m.p["o"][cls]
        a, q = (x - np.log(np.exp(x).sum(1, keepdims=True)) for x in (a, q))
        assert np.allclose(ll, a[one, cls] + q[one, word]) and np.allclose(m.output(h, ids), ll)
        ga, gq = -np.exp(a), -np.exp(q)
        ga[one, cls] += 1
        gq[one, word] += 1
        ga, gq = ga / 2, gq / 2
        want = np.zeros_like(to_words)
        np.add.at(want, cls, np.einsum("nd,nw->ndw", np.column_stack([h, np.ones(rows)]), gq))
        assert np.allclose(to_words, want) and np.allclose(to_top, np.column_stack([h, np.ones(rows)]).T @ ga)
        assert np.allclose(dh, ga @ m.p["C"].T + np.einsum("nw,ndw->nd", gq, m.p["O"][cls]))


def test_runs_of_classes_are_padded_a_little():
    rng = np.random.default_rng(7)
    for count in ([0] * 5, [900, 0, 3, 0], (1500 * rng.dirichlet(np.full(64, 0.1))).astype(int).tolist(), [0] * 40 + [1536] + [0] * 23):
        parts, each = grulm._alike(count)
        assert len(each) == len(count) and (each >= count).all()
        assert [r.stop - r.start for _, r in parts] == [each[k].sum() for k, _ in parts] and sum(each) == (parts[-1][1].stop if parts else 0)
        for k, _ in parts:
            assert len(set(each[k])) == 1 and each[k].sum() - sum(count[k]) <= grulm._PADDING + sum(count[k]) // 4


def test_a_window_updates_the_dictionaries_it_is_given():
    """Parameters that were replaced after a window, by those of another round, are the ones that the next one changes."""
    rng = np.random.default_rng(8)
    ids, begin = rng.integers(2, 50, 400).astype(np.int32), np.arange(0, 401, 40)
    a, b = (grulm.Gru(np.arange(50, 0, -1).astype(float), classes=4, hidden=8, embedding=6) for _ in range(2))
    first = a.flat()
    squares = lambda m: {k: np.full_like(v, 1e-4) for k, v in m.p.items()}
    grulm.train_on(a, ids, begin, squares(a))
    assert (a.flat() != first).any()
    a.load(first)
    s, t = squares(a), squares(b)
    for m, of in ((a, s), (b, t)):
        grulm.train_on(m, ids, begin, of)
    assert (a.flat() == b.flat()).all() and all((s[k] == t[k]).all() and (s[k] > 1e-4).any() for k in s)
