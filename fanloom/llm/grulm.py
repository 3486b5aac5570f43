"""Scoring of documents with a gated recurrent language model, trained on the corpus itself, in numpy.

Words (texts between white space, folded) are counted over the whole corpus; the ``VOCABULARY`` most frequent have ids,
all others are one unknown word that is spelled byte by byte from the corpus's byte counts, so that every document has
a complete likelihood, its end included. The output layer is factored: words sorted by frequency form classes of equal
size, and a word's probability is that of its class times that within the class.

Training takes every document (with ``share``, every so many-th by hash), whole, by truncated backpropagation over
windows of ``WINDOW`` words with the state carried from window to window. Each partition trains a copy of the model, the
copies are averaged by their words (in Spark, block by block, first those of ``_FAN`` partitions at a time, always in the
order of partitions), and a further round starts from the average. So the model depends on how the table is cut into
partitions, and on nothing else. What is gathered from the corpus (counts, and parameters of each partition) grows with
it; the model's size is fixed.

Scoring puts the documents of a batch end to end on lanes of about equal length, so that one matrix product serves all
lanes; a lane's state starts anew with each document and is carried over its windows to its end. Only lanes that are
still running take memory, so that one very long text among short ones costs what it has itself.

Defined cases
    null and empty texts: no words; the likelihood is that of the end of a document. Null doc_id: scored like any other.
    Repeated rows: each is scored. Ties of frequency: by hash. Very long texts: whole. Empty table: no rows. Further
    columns: ignored.
"""

from __future__ import annotations

import ctypes
import functools
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.llm import vec
from fanloom.session import materialise

VOCABULARY = 4096
CLASSES = 64
HIDDEN = 32
EMBEDDING = 24
SHARE = 1
ROUNDS = 2
WINDOW = 24
RATE = 0.08
_UNKNOWN, _END = 0, 1
_BLOCK = 1 << 14
_FAN = 256
_RANKS = 16
_PIECE = 1 << 14
_PADDING = 48
_ROWS = 128
_PACKED = 1 << 16


def tokens(column: pa.Array):
    """(first row, hashes, begins, folded bytes, starts, ends) of the words of chunks of rows."""
    buf, off = vec.raw(column)
    for a, b in vec.chunks(off):
        own = off[a : b + 1] - off[a]
        low = vec.fold(buf[off[a] : off[b]])
        s, e = vec.edges(~vec._SPACE[low], own)
        yield a, vec.hashes(low, s, e), np.searchsorted(s, own), low, s, e


def _steady(run):
    """Keeps freed memory in the process while a task runs: else the arrays of every window are paged in again."""
    trim, mmap, usual = -1, -3, 1 << 17

    @functools.wraps(run)
    def steadied(batches):
        set_ = getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)
        set_(trim, 1 << 26)
        set_(mmap, 1 << 25)
        try:
            yield from run(batches)
        finally:
            set_(trim, usual)
            set_(mmap, usual)

    return steadied


def count_words(texts: DataFrame) -> DataFrame:
    """(kind, h, n): counts of word hashes (kind 0), of their bytes and ends (kind 1), and of documents (kind 2)."""

    @vec.tidy
    @_steady
    def run(batches):
        held, total = [], 0
        bytes_ = np.zeros(257, np.int64)
        docs = 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["kind", "h", "n"])

        for batch in batches:
            docs += batch.num_rows
            for _, h, _, low, s, e in tokens(batch.column(0)):
                held.append(h)
                total += len(h)
                bytes_[:256] += np.bincount(low[~vec._SPACE[low]], minlength=256)
                bytes_[256] += len(h)
                if total > 4_000_000:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([1] * 257 + [2], np.int32)), pa.array(np.append(np.arange(257), 0)), pa.array(np.append(bytes_, docs))], names=["kind", "h", "n"]
        )

    return texts.mapInArrow(run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Word hashes (sorted) with their ids, log-probabilities of bytes, and the words' frequencies by id."""

    hashes: np.ndarray
    ids: np.ndarray
    byte_log: np.ndarray
    frequency: np.ndarray

    def encode(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int32)
        top = np.searchsorted(self.hashes >> np.uint64(48), np.arange((1 << 16) + 1)).astype(np.int32)  # where hashes of each first 16 bits begin
        at = top[h >> np.uint64(48)]
        found = np.full(len(h), _UNKNOWN, np.int32)
        for k in range(int(np.diff(top).max())):
            own = np.minimum(at + k, len(self.hashes) - 1)
            np.copyto(found, self.ids[own], where=self.hashes[own] == h)
        return found


def lexicon(texts: DataFrame, size: int = VOCABULARY) -> Lexicon:
    counts = materialise(count_words(texts), "words")
    top = counts.where("kind = 0").orderBy(F.desc("n"), "h").limit(size - 2).toPandas()
    rest = {(r[0], r[1]): r[2] for r in counts.where("kind > 0").collect()}
    words = rest.get((1, 256), 0)
    bytes_ = np.array([rest.get((1, k), 0) for k in range(257)], float) + 1
    frequency = np.zeros(size)
    frequency[2 : 2 + len(top)] = top["n"]
    frequency[_UNKNOWN] = max(words - top["n"].sum(), 1)
    frequency[_END] = max(rest.get((2, 0), 0), 1)
    h = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Lexicon(h[order], (order + 2).astype(np.int32), np.log(bytes_ / bytes_.sum()), frequency)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _aligned(*shape: int, kind) -> np.ndarray:
    """Room that begins where the processor's widest loads do."""
    kind = np.dtype(kind)
    size = math.prod(shape) * kind.itemsize
    room = np.empty(size + 64, np.uint8)
    at = -room.ctypes.data % 64
    return room[at : at + size].view(kind).reshape(shape)


def _by_rows(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``a @ b``, so many rows at once that the library multiplies them in place, without copies in an order of its own."""
    n = len(a) // _ROWS * _ROWS
    if n:
        np.matmul(a[:n].reshape(-1, _ROWS, a.shape[1]), b, out=out[:n].reshape(-1, _ROWS, b.shape[1]))
    if n < len(a):
        np.dot(a[n:], b, out[n:])
    return out


def _crossed(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """``a.T @ b``, in the same way."""
    n = len(a) // _ROWS * _ROWS
    if n:
        np.matmul(a[:n].reshape(-1, _ROWS, a.shape[1]).transpose(0, 2, 1), b[:n].reshape(-1, _ROWS, b.shape[1])).sum(0, out=out)
        if n < len(a):
            out += a[n:].T @ b[n:]
    else:
        np.dot(a.T, b, out)


def _log_softmax(a: np.ndarray, chosen: np.ndarray, scale: float) -> np.ndarray:
    """Log-probabilities of the chosen columns of logits ``a``; with ``scale``, ``a`` becomes the gradient of their sum, scaled."""
    own = np.arange(0, a.size, a.shape[1])
    own += chosen
    if not (a.size and -60 < a.min() and a.max() < 60):  # else their exponentials are in range as they are
        a -= a.max(1, keepdims=True)
    flat = a.reshape(-1)
    ll = flat.take(own)
    np.exp(a, out=a)
    total = a @ np.ones(a.shape[1], a.dtype)
    if scale:
        a *= (-scale / total)[:, None]
        flat[own] += scale
    ll -= np.log(total)
    return ll


def _adagrad(p: np.ndarray, g: np.ndarray, squares: np.ndarray, rate: float, clip: bool) -> None:
    """Moves ``p`` up the gradient ``g``, clipped where it can be over 1."""
    if p.size > 4 * _PIECE and len(p) > 1:  # in pieces that stay in the processor's cache
        n = max(1, _PIECE * len(p) // p.size)
        for k in range(0, len(p), n):
            _adagrad(p[k : k + n], g[k : k + n], squares[k : k + n], rate, clip)
        return
    if clip:
        np.clip(g, -1, 1, out=g)
    t = g * g
    squares += t
    np.add(squares, 1e-6, out=t)
    np.sqrt(t, out=t)
    np.divide(g, t, out=t)
    t *= rate
    p += t


class Gru:
    """The model: ``p`` holds its parameters; classes are equal cuts of the ids in the order of frequency."""

    SHAPES = ("E", "W", "b", "U", "C", "c", "O", "o")

    def __init__(self, frequency: np.ndarray, classes: int = CLASSES, hidden: int = HIDDEN, embedding: int = EMBEDDING, seed: int = 3):
        rng = np.random.default_rng(seed)
        v = len(frequency)
        self.classes, self.hidden, self.width = classes, hidden, -(-v // classes)
        order = np.argsort(-frequency, kind="stable")
        self.place = np.empty(v, np.int64)
        self.place[order] = np.arange(v)  # id -> place by frequency: class = place // width
        self.class_of = (self.place // self.width).astype(np.uint16)  # few bits are sorted by their digits
        self.word_of = self.place % self.width
        self.held = None  # what hold() gives, with the arrays it is for
        f = np.zeros(classes * self.width)
        f[: len(order)] = frequency[order] + 0.5
        f = f.reshape(classes, self.width)
        within = np.log(np.maximum(f, 1e-9) / np.maximum(f.sum(1, keepdims=True), 1e-9))
        n = lambda *s, k: (rng.standard_normal(s) / np.sqrt(k)).astype(np.float32)
        self.p = {
            "E": n(v, embedding, k=4),
            "W": n(embedding, 3 * hidden, k=embedding),
            "b": np.zeros(3 * hidden, np.float32),
            "U": n(hidden, 3 * hidden, k=hidden),
            "C": np.zeros((hidden, classes), np.float32),
            "c": np.log(np.maximum(f.sum(1), 1e-9) / f.sum()).astype(np.float32),
            "O": np.zeros((classes, hidden, self.width), np.float32),
            "o": within.astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in self.SHAPES])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for k in self.SHAPES:
            n = self.p[k].size
            self.p[k] = values[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def step(self, x: np.ndarray, h: np.ndarray):
        """One step of the gates: x is the input's part."""
        d = self.hidden
        rz = _sigmoid(x[:, : 2 * d] + h @ self.p["U"][:, : 2 * d])
        r, z = rz[:, :d], rz[:, d:]
        m = np.tanh(x[:, 2 * d :] + (r * h) @ self.p["U"][:, 2 * d :])
        return m + z * (h - m), r, z, m

    def halved(self, table: np.ndarray):
        """The gates' parameters, of reset and update, and the new state's; the gates' are halved, in ``table`` too: a
        sigmoid is half a hyperbolic tangent of the half, and a half."""
        d, u = self.hidden, self.p["U"]
        table[:, : 2 * d] *= 0.5
        return np.ascontiguousarray(u[:, : 2 * d].reshape(d, 2, d).transpose(1, 0, 2)) * u.dtype.type(0.5), np.ascontiguousarray(u[:, 2 * d :])

    def views(self, flat: np.ndarray):
        """Parts of an array of all parameters but the embeddings: U, W and b, then C over c, then each class's O over its o."""
        d, e = self.hidden, self.p["E"].shape[1]
        shapes = ((d, 3 * d), (e, 3 * d), (3 * d,), (d + 1, self.classes), (self.classes, d + 1, self.width))
        ends = np.cumsum([np.prod(n) for n in shapes]).tolist()
        return [flat[end - int(np.prod(n)) : end].reshape(n) for end, n in zip(ends, shapes)]

    def hold(self, squares: dict):
        """Puts all parameters but the embeddings, and their squares, into one array each, so that a window updates them at
        once: (parameters, squares, room for gradients, views of the room, top, words)."""
        if self.held is None or any(self.p[k] is not v or squares[k] is not w for k, v, w in self.held[0]):
            p = self.p
            size = sum(v.size for k, v in p.items() if k != "E")
            both, tops = [], None
            for of in (p, squares):
                flat = np.empty(size, p["U"].dtype)
                u, w, b, top, words = self.views(flat)
                named = {"U": u, "W": w, "b": b, "C": top[:-1], "c": top[-1], "O": words[:, :-1], "o": words[:, -1]}
                for k, v in named.items():
                    v[...] = of[k]
                of.update(named)
                both.append(flat)
                tops = tops or (top, words)
            grads = np.empty(size, p["U"].dtype)
            self.held = [(k, p[k], squares[k]) for k in self.SHAPES if k != "E"], (*both, grads, self.views(grads), *tops)
        return self.held[1]

    def output(self, h: np.ndarray, ids: np.ndarray, scale: float = 0, layer=None, into=None):
        """Log-probabilities of words after states, and with ``scale`` the gradients of their sum, scaled.

        Rows are taken in the order of classes. Neighbouring classes of about as many rows are padded with rows of zeros to
        equal numbers, so that one call serves them all. A last column of ones takes the biases along. ``layer``: C over
        c, and each class's O over its o, where they are at hand; ``into``: where the gradients of both go."""
        n, d, p = len(ids), self.hidden, self.p
        top, words = layer or (np.concatenate([p["C"], p["c"][None]]), np.concatenate([p["O"], p["o"][:, None]], 1))
        cls = self.class_of.take(ids)
        order = np.argsort(cls, kind="stable")
        count = np.bincount(cls, minlength=self.classes)
        parts, each = _alike(count.tolist())
        to = np.repeat(np.cumsum(each) - each - np.cumsum(count) + count, count)
        to += np.arange(n)
        at = np.empty(n, np.intp)
        at[order] = to
        source = np.full(int(each.sum()), n)
        source[to] = order
        word = np.zeros(len(source), np.intp)
        word[at] = self.word_of.take(ids)
        own = _aligned(n + 1, d + 1, kind=h.dtype)
        own[:n, :d], own[:n, d], own[n] = h, 1, 0
        kind = np.result_type(h, top)
        a = _by_rows(own[:n], top, _aligned(n, self.classes, kind=kind))
        q = _aligned(len(source), self.width, kind=kind)
        padded = own.take(source, axis=0)
        for k, rows in parts:
            if k.stop - k.start == 1:
                _by_rows(padded[rows], words[k.start], q[rows])
            else:
                np.matmul(padded[rows].reshape(k.stop - k.start, -1, d + 1), words[k], out=q[rows].reshape(k.stop - k.start, -1, self.width))
        ll = _log_softmax(a, cls, scale)
        ll += _log_softmax(q, word, scale).take(at)
        if not scale:
            return ll
        to_top, to_words = into
        _crossed(own[:n], a, to_top)
        more = _aligned(len(source), d, kind=kind)
        back = words[:, :-1].transpose(0, 2, 1)
        to_words[count == 0] = 0
        for k, rows in parts:
            if k.stop - k.start == 1:
                _crossed(padded[rows], q[rows], to_words[k.start])
                _by_rows(q[rows], np.ascontiguousarray(back[k.start]), more[rows])
            else:
                x, y = (v[rows].reshape(k.stop - k.start, -1, v.shape[1]) for v in (padded, q))
                np.matmul(x.transpose(0, 2, 1), y, out=to_words[k])
                np.matmul(y, back[k], out=more[rows].reshape(*y.shape[:2], d))
        dh = _by_rows(a, np.ascontiguousarray(top[:-1].T), _aligned(n, d, kind=kind))
        dh += more.take(at, axis=0)
        return ll, dh

    def window(self, ids_in, ids_out, fresh, live, h, squares, rate):
        """One window of truncated backpropagation with Adagrad: (log-likelihood, state after it).

        Reset gate, update gate and new state are parts of their own in all arrays, so that each is in one piece. ``parts``
        has five for each step: first, in the way forward, the gates (1, 2), the old state less the new one (3), and that (4);
        then what the gradients are multiplied with; then the gradients of the reset gate (0), the update gate (3) and the
        new state (4), and what goes on to the step before (1, 2)."""
        d, (steps, lanes), p = self.hidden, ids_in.shape, self.p
        flat, flat_squares, grads, (to_u, to_w, to_b, to_top, to_words), top, words = self.hold(squares)
        kind = flat.dtype
        flat_in = ids_in.reshape(-1)
        counts = np.bincount(flat_in, minlength=len(p["E"]))
        used = np.flatnonzero(counts)
        used = used[np.argsort(-counts[used], kind="stable")]
        counts = counts[used]
        back = np.empty(len(p["E"]), np.intp)
        back[used] = np.arange(len(used))
        back = back[flat_in]
        embedded = p["E"].take(used, axis=0)
        table = _by_rows(embedded, p["W"], _aligned(len(used), 3 * d, kind=kind))
        table += p["b"]
        half, new = self.halved(table)
        table = table.reshape(-1, d)
        places = 3 * back.reshape(steps, 1, lanes) + np.arange(3)[:, None]
        begins = [np.flatnonzero(f) if some else None for f, some in zip(fresh == 0, (fresh == 0).any(1).tolist())]
        states, rh, parts = _aligned(steps + 1, lanes, d, kind=kind), _aligned(steps, lanes, d, kind=kind), _aligned(steps, 5, lanes, d, kind=kind)
        states[0] = h
        own, x, one_half, ended = _aligned(lanes, d, kind=kind), _aligned(3, lanes, d, kind=kind), np.array(0.5, kind), []
        x_gates, x_new = x[:2], x[2]
        for t, (b, after, at, g, r, z, less, m, c, rows) in enumerate(
            zip(states, states[1:], places, parts[:, 1:3], parts[:, 1], parts[:, 2], parts[:, 3], parts[:, 4], rh, begins)
        ):
            if rows is not None:
                ended.append((t, rows, b[rows]))
                b[rows] = 0
            table.take(at, axis=0, out=x, mode="clip")
            np.matmul(b, half, out=g)
            g += x_gates
            np.tanh(g, out=g)
            g *= one_half
            g += one_half
            np.multiply(r, b, out=c)
            np.dot(c, new, own)
            own += x_new
            np.tanh(own, out=m)
            np.subtract(b, m, out=less)
            np.multiply(less, z, out=after)
            after += m
        some = np.flatnonzero(live.reshape(-1))
        scale = kind.type(1 / max(len(some), 1))
        for t, rows, old in ended:
            states[t, rows] = old
        outputs = states[1:].reshape(-1, d)
        if len(some) == steps * lanes:
            ll, dh_all = self.output(outputs, ids_out.reshape(-1), scale, (top, words), (to_top, to_words))
        else:
            ll, dh_some = self.output(outputs[some], ids_out.reshape(-1)[some], scale, (top, words), (to_top, to_words))
            dh_all = np.zeros((steps * lanes, d), kind)
            dh_all[some] = dh_some
        for t, rows, _ in ended:
            states[t, rows] = 0
        to_r, r, z, to_z, to_m = (parts[:, k] for k in range(5))
        rest = 1 - z
        np.subtract(1, r, out=to_r)
        to_r *= rh
        to_z *= z
        to_z *= rest
        to_m *= to_m
        np.subtract(1, to_m, out=to_m)
        to_m *= rest
        carry, drh, two = (_aligned(*n, lanes, d, kind=kind) for n in ((), (), (2,)))
        carry[...] = 0
        two_r, two_z = two
        gates_t, new_t = np.ascontiguousarray(half.transpose(0, 2, 1)) * kind.type(2), np.ascontiguousarray(new.T)
        gone = parts[::-1]
        for dh, of_state, of_reset, to_new, gates, on_r, on_z, rows in zip(
            dh_all.reshape(steps, lanes, d)[::-1], gone[:, 2:], gone[:, :2], gone[:, 4], gone[:, :4:3], gone[:, 1], gone[:, 2], begins[::-1]
        ):
            dh += carry
            of_state *= dh
            np.dot(to_new, new_t, drh)
            of_reset *= drh
            np.matmul(gates, gates_t, out=two)
            np.add(on_r, on_z, out=carry)
            carry += two_r
            carry += two_z
            if rows is not None:
                carry[rows] = 0
        order = self._ranked(back, counts)
        rows = (order + order // lanes * (4 * lanes))[:, None] + np.array([0, 3, 4]) * lanes
        by_place = parts.reshape(-1, d).take(rows, axis=0).reshape(-1, 3 * d)
        np.matmul(states[:-1, None].transpose(0, 1, 3, 2), parts[:, :4:3]).sum(0, out=to_u.reshape(d, 3, d).transpose(1, 0, 2)[:2])
        np.matmul(rh.transpose(0, 2, 1), parts[:, 4]).sum(0, out=to_u[:, 2 * d :])
        by_word = self._added(by_place, counts)
        by_word.sum(0, out=to_b)
        _crossed(embedded, by_word, to_w)
        to_e = _by_rows(by_word, np.ascontiguousarray(p["W"].T), np.empty_like(embedded))
        clipped = to_u.size + to_w.size + to_b.size
        np.clip(grads[:clipped], -1, 1, out=grads[:clipped])  # states are within -1 and 1, so are the others' means
        _adagrad(flat, grads, flat_squares, rate, False)
        more = squares["E"].take(used, axis=0)
        _adagrad(embedded, to_e, more, rate, True)
        p["E"][used], squares["E"][used] = embedded, more
        return float(ll.sum()), states[-1]

    def _ranked(self, back: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places in the order of how often their word was there before, and of words. ``back``: each place's word; ``counts``:
        how often words are there, falling. Beyond ``_RANKS`` each word's places are together."""
        small = np.uint16 if len(back) < 1 << 16 else np.int64  # few bits are sorted by their digits
        order = np.argsort(back.astype(small), kind="stable")
        rank = np.arange(len(back)) - np.repeat(np.cumsum(counts) - counts, counts)
        return order[np.argsort(np.minimum(rank, _RANKS).astype(small), kind="stable")]

    def _added(self, by_place: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums by word of rows in the order of ``_ranked``.

        The n-th places of all words that have so many are added at once; only of what is beyond ``_RANKS`` each word's
        places are added by themselves."""
        have = np.searchsorted(-counts, -np.arange(_RANKS + 1)).tolist()  # words of more places than 0, 1, ...
        at = have[0]
        out = by_place[:at]
        for n in have[1:_RANKS]:
            out[:n] += by_place[at : at + n]
            at += n
        for k, n in enumerate((counts[: have[_RANKS]] - _RANKS).tolist()):
            out[k] += by_place[at : at + n].sum(0)
            at += n
        return out

    def _sums(self, dx: np.ndarray, back: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of the gates' gradients by word."""
        _, _, lanes, d = dx.shape
        order = self._ranked(back, counts)
        rows = (order + order // lanes * (2 * lanes))[:, None] + np.arange(3) * lanes
        return self._added(dx.reshape(-1, d).take(rows, axis=0).reshape(-1, 3 * d), counts)


def _alike(count: list[int]) -> tuple[list[tuple[slice, slice]], np.ndarray]:
    """Runs of neighbouring classes, each with its slice of rows, and the rows of each class: as many as its run's largest
    has. Padding is at most a quarter of a run's rows, and ``_PADDING``; runs without rows are left out."""
    parts, each, row = [], [], 0
    first = most = total = 0
    for k, n in enumerate([*count, -1]):
        more = max(most, n)
        if n < 0 or more * (k - first + 1) - total - n > _PADDING + (total + n) // 4:
            if most:
                parts.append((slice(first, k), slice(row, row + most * (k - first))))
                row += most * (k - first)
            each += [most] * (k - first)
            first, most, total = k, n, n
        else:
            most, total = more, total + n
    return parts, np.array(each)


def lanes_of(sizes: np.ndarray, count: int) -> list[list[int]]:
    """Documents (each of so many steps) on lanes of about equal length, the longest lane first."""
    count = max(1, min(count, len(sizes)))
    heap = [(0, k) for k in range(count)]
    lanes: list[list[int]] = [[] for _ in range(count)]
    total = [0] * count
    for k in np.argsort(-sizes, kind="stable"):
        n, lane = heapq.heappop(heap)
        lanes[lane].append(int(k))
        total[lane] = n + int(sizes[k])
        heapq.heappush(heap, (total[lane], lane))
    return [lanes[k] for k in sorted(range(count), key=lambda k: -total[k])]


@dataclass
class Lanes:
    """Documents put on lanes, packed: of each step only the lanes that are still running (the first ones) are there.

    A document of n words has n + 1 steps: its end predicts the first word, its last word the end."""

    active: np.ndarray  # lanes of each step
    base: np.ndarray  # where each step begins ... and the end
    ins: np.ndarray
    outs: np.ndarray
    start: np.ndarray
    doc: np.ndarray

    def window(self, t: int, end: int):
        """(inputs, outputs, starts, documents) of some steps, as matrices; places without a document have -1."""
        width = int(self.active[t])
        if self.active[end - 1] == width:
            return [values[self.base[t] : self.base[end]].reshape(-1, width) for values in (self.ins, self.outs, self.start, self.doc)]
        live = np.arange(width) < self.active[t:end, None]
        out = []
        for values, empty in ((self.ins, _END), (self.outs, _END), (self.start, False), (self.doc, -1)):
            full = np.full(live.shape, empty, values.dtype)
            full[live] = values[self.base[t] : self.base[end]]
            out.append(full)
        return out


def laid_out(ids: np.ndarray, begin: np.ndarray, count: int) -> Lanes:
    sizes = np.diff(begin) + 1
    lanes = lanes_of(sizes, count)
    length = np.array([int(sizes[lane].sum()) for lane in lanes], np.int64)
    steps = int(length.max(initial=0))
    active = np.searchsorted(-length, -np.arange(steps), "left")
    base = np.concatenate([[0], np.cumsum(active)])
    total = int(base[-1])
    where = np.cumsum(length) - length  # each lane in one piece first, and then so many steps of all lanes at once
    words, docs, ends = np.full(total, _END, np.int32), np.empty(total, np.int32), np.zeros(total, bool)
    for a, n, lane in zip(where.tolist(), length.tolist(), lanes):
        own = np.array(lane, np.int64)
        size = sizes[own]
        last = np.cumsum(size) - 1
        which = np.repeat(own, size)
        docs[a : a + n] = which
        ends[a : a + n][last] = True
        if len(ids):
            at = np.arange(n)
            at += np.repeat(begin[own] - last - 1 + size, size)
            at[last] = 0
            words[a : a + n] = ids[at]
            words[a : a + n][last] = _END
    ins, outs, start, doc = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, bool), np.empty(total, np.int32)
    most = max(1, _PACKED // max(1, len(lanes)))
    for t in range(0, steps, most):
        now = active[t : t + most]
        at = (where[: now[0]] + np.arange(t, t + len(now))[:, None])[np.arange(now[0]) < now[:, None]]
        part = slice(base[t], base[t] + len(at))
        outs[part], doc[part] = words.take(at), docs.take(at)
        at -= 1  # a lane's first step follows the end of the lane before
        ins[part], start[part] = words.take(at, mode="wrap"), ends.take(at, mode="wrap")
    return Lanes(active, base, ins, outs, start, doc)


def _words(column: pa.Array, lex: Lexicon):
    """Ids of all words, begins of the rows, spelling log-probabilities and counts of unknown words, bytes of rows."""
    ids, begin, spell, unknown, size = [], [0], [], [], []
    for _, h, first, low, s, e in tokens(column):
        own = lex.encode(h)
        sums = np.concatenate([[0.0], np.cumsum(lex.byte_log[low])])
        each = np.where(own == _UNKNOWN, sums[e] - sums[s] + lex.byte_log[256], 0.0)
        cost = np.concatenate([[0.0], np.cumsum(each)])
        lost = np.concatenate([[0], np.cumsum(own == _UNKNOWN)])
        bytes_ = np.concatenate([[0], np.cumsum(e - s + 1)])
        ids.append(own)
        begin += list(begin[-1] + first[1:])
        spell.append(cost[first[1:]] - cost[first[:-1]])
        unknown.append(lost[first[1:]] - lost[first[:-1]])
        size.append(bytes_[first[1:]] - bytes_[first[:-1]])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(ids, np.int32), np.array(begin, np.int64), cat(spell, float), cat(unknown, np.int64), cat(size, np.int64)


def train_on(model: Gru, ids: np.ndarray, begin: np.ndarray, squares: dict, rate: float = RATE, window: int = WINDOW, lanes: int = 64) -> float:
    rows = laid_out(ids, begin, lanes)
    h = np.zeros((int(rows.active.max(initial=0)), model.hidden), np.float32)
    total = 0.0
    for t in range(0, len(rows.active), window):
        ins, outs, start, doc = rows.window(t, min(t + window, len(rows.active)))
        ll, h = model.window(ins, outs, ~start, doc >= 0, h[: ins.shape[1]], squares, rate)
        total += ll
    return total


def score(model: Gru, ids: np.ndarray, begin: np.ndarray, lanes: int = 256, window: int = 64) -> np.ndarray:
    """Log-likelihoods of documents of word ids, their ends included."""
    rows = laid_out(ids, begin, lanes)
    d, p = model.hidden, model.p
    kind = p["U"].dtype
    table = p["E"] @ p["W"] + p["b"]
    half, new = model.halved(table)
    table = table.reshape(-1, d)
    out = np.zeros(len(begin) - 1)
    h = np.zeros((int(rows.active.max(initial=0)), d), kind)
    for t in range(0, len(rows.active), window):
        end = min(t + window, len(rows.active))
        part = slice(rows.base[t], rows.base[end])
        states = np.empty((part.stop - part.start, d), kind)
        places = 3 * rows.ins[part] + np.arange(3)[:, None]
        for k in range(t, end):
            at = slice(rows.base[k], rows.base[k + 1])
            own = slice(at.start - part.start, at.stop - part.start)
            now = h[: int(rows.active[k])]
            now[rows.start[at]] = 0
            x = table.take(places[:, own], axis=0)
            g = np.matmul(now, half)
            g += x[:2]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            m = np.dot(g[0] * now, new)
            m += x[2]
            np.tanh(m, out=m)
            now -= m
            now *= g[1]
            now += m
            states[own] = now
        out += np.bincount(rows.doc[part], model.output(states, rows.outs[part]), len(out))
    return out


AVERAGED = "block int, place int, words double, part binary"


def averaged(parts: DataFrame, *group: Column) -> DataFrame:
    """The means of the ``parts`` of each block (and group), weighted by ``words`` and summed in the order of ``place``."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        words = pdf["words"].sum()
        total = 0.0
        for n, part in zip(pdf["words"], pdf["part"]):
            total = total + n * np.frombuffer(part)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "place": pdf["place"].iloc[:1], "words": [words], "part": [(total / words).tobytes()]})

    return parts.groupBy("block", *group).applyInPandas(mean, AVERAGED)


def train(texts: DataFrame, lex: Lexicon, share: int = SHARE, rounds: int = ROUNDS) -> Gru:
    """``texts``: (h, text). Every share-th document trains, in each partition a copy of the model."""
    spark = texts.sparkSession
    model = Gru(lex.frequency)
    chosen = texts.where(F.pmod("h", F.lit(share)) == 0).select("text")
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((model, lex))
        rate = RATE / (1 + k)

        @vec.tidy
        @_steady
        def run(batches):
            base, lex_ = shared.value
            own = Gru(lex_.frequency)
            own.load(base.flat())
            squares = {n: np.full_like(v, 1e-4) for n, v in own.p.items()}
            words = 0
            for batch in batches:
                ids, begin, *_ = _words(batch.column(0), lex_)
                if len(begin) > 1:
                    train_on(own, ids, begin, squares, rate)
                    words += len(ids) + len(begin) - 1
            if words:
                flat = own.flat()
                blocks = [flat[i : i + _BLOCK].astype(np.float64).tobytes() for i in range(0, len(flat), _BLOCK)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([float(words)] * n), pa.array(blocks, pa.binary())],
                    names=["block", "place", "words", "part"],
                )

        trained = chosen.mapInArrow(run, AVERAGED)
        found = averaged(averaged(trained, F.floor(F.col("place") / _FAN))).select("block", "part").collect()
        if found:
            model.load(np.concatenate([np.frombuffer(r[1]) for r in sorted(found)]))
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_unknown, log_likelihood, bits_per_byte), a row for each of ``docs``."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    lex = lexicon(rows.select("text"))
    model = train(rows.select(F.xxhash64("doc_id", "text").alias("h"), "text"), lex, share, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((model, lex))

    @vec.tidy
    @_steady
    def run(batches):
        model_, lex_ = shared.value
        for batch in batches:
            ids, begin, spell, unknown, size = _words(batch.column(1), lex_)
            ll = score(model_, ids, begin) + spell
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(begin)), pa.array(unknown), pa.array(ll), pa.array(-ll / np.log(2) / (size + 1))],
                names=["doc_id", "n_words", "n_unknown", "log_likelihood", "bits_per_byte"],
            )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_unknown long, log_likelihood double, bits_per_byte double")


def op10_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), share=SHARE, rounds=ROUNDS)
