"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over all
ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. Every single byte is a
piece too (with a floor probability), so that every text can be cut. Piece probabilities are fitted by expectation
maximisation (expected piece counts from the forward-backward algorithm) on a bounded sample of labelled rows:
``SAMPLE`` documents of each language, those with the lowest hash.

Words are the texts between white space, in lower case, with a mark in front as in the vocabulary. Words of at most
``SHORT`` bytes are scored in numpy, all words of a batch at once, byte position by byte position (no probability
underflows there: every byte has ``FLOOR`` at least); a longer one, such as a page of an unspaced script, goes alone
through the same recursion, with a scale of its own for each language and position, in time linear in its length. Both
serve the fit as well, so that words of any length count in it. Scores of words seen before come from a bounded table in
each worker. A word's score is rounded to single precision before any use and a text's score is summed over its own
words only, so that neither depends on what else a worker has seen.

Decision
    ``lang_pred`` is the language of highest likelihood (ties: the first in the order of names). A word is unlikely if
    its log-likelihood a byte is under the language's floor: over the sample's documents, the median of the
    ``UNLIKELY`` quantile of their words. A document is rejected (``accepted`` false) if it has no words, or if its
    unlikely words are more than half of its words and ``MARGIN`` more: a few odd words (names, numbers, keys) never
    reject a document, noise does.
Defined cases
    null, empty and blank texts: ``und``, rejected, scores null. Null labels: left out of the fit. Null doc_id: scored
    like any other row. Repeated rows: each is scored. Empty table or no labels: no languages, so all rows ``und``.
    Very long texts: scored whole. Further columns: ignored by ``identify``, kept by ``keep_identified``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fanloom.llm import vec

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 400
ROUNDS = 4
FLOOR = 1e-7
SHORT = 40  # 1e-7 ** 40 is above the least double
UNLIKELY = 0.05
MARGIN = 2
_MARK = "▁".encode()
_SLOTS = 1 << 20


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's ordinary pieces, in lower case, without repeats."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i).lower().encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return list(dict.fromkeys(found))


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


@dataclass
class Lattice:
    """Finds the pieces that cover each byte range of many words at once."""

    pieces: list[bytes]
    size: int = field(init=False)

    def __post_init__(self):
        singles = [bytes([b]) for b in range(256)]
        known = list(dict.fromkeys([*self.pieces, *singles]))
        buf, off = _joined(known)
        h = vec.hashes(buf, off[:-1], off[1:])
        order = np.argsort(h)
        self.keys, self.ids = h[order], order.astype(np.int32)
        self.size, self.sizes = len(known), np.unique(np.diff(off)).tolist()
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, pieces) of the hashes that are pieces."""
        may = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
        hit = self.keys[place] == h[may]
        return may[hit], self.ids[place[hit]]

    def uses(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in one word, sorted by end."""
        buf = np.frombuffer(word, np.uint8)
        p, q = vec._powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(vec._TABLE[buf] * p[:-1], out=sums[1:])
        start, end, piece = [], [], []
        for size in self.sizes:
            if size <= len(buf):
                at, found = self._found(vec.mix((sums[size:] - sums[:-size]) * q[: len(buf) + 1 - size]))
                start.append(at)
                end.append(at + size)
                piece.append(found)
        start, end, piece = np.concatenate(start), np.concatenate(end), np.concatenate(piece)
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]

    def edges(self, buf: np.ndarray, off: np.ndarray):
        """For each end position e (in words sorted by length, longest first): [(length, words, pieces)]."""
        n = np.diff(off)
        p, q = vec._powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(vec._TABLE[buf] * p[:-1], out=sums[1:])
        starts = off[:-1]
        out = []
        for e in range(1, int(n.max(initial=0)) + 1):
            live = int(np.searchsorted(-n, -e, "right"))  # words at least e long come first
            at = starts[:live] + e
            steps = []
            for size in self.sizes:
                if size > e:
                    break
                which, found = self._found(vec.mix((sums[at] - sums[at - size]) * q[at - size]))
                if len(which):
                    steps.append((size, which, found))
            out.append(steps)
        return out


def forward(edges, words: int, prob: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-likelihoods (word, language) of words of at most ``SHORT`` bytes, the forward variables (position, word), and
    the log of their scale, which needn't differ from 0 here."""
    alpha = np.zeros((len(edges) + 1, words, prob.shape[1]))
    alpha[0] = 1
    for e, steps in enumerate(edges, 1):
        for size, at, piece in steps:
            alpha[e, at] += alpha[e - size, at] * prob[piece]
    with np.errstate(divide="ignore"):
        return np.log(alpha[ends, np.arange(words)]), alpha, 0.0


def chain(start: list[int], first: list[int], p: list[float]) -> np.ndarray:
    """Logs of the forward variables of one language in one word of any length: piece uses ``first[e] .. first[e + 1]``
    end at byte e, start at ``start`` (the last one first) and have probability ``p``. Each position has a power of two
    as its scale."""
    value, power, ldexp = [1.0], [0], math.ldexp
    changed = 0  # positions from there on have the same scale
    for e in range(1, len(first) - 1):
        a, b = first[e], first[e + 1]
        if start[b - 1] >= changed:
            v = 0.0
            for s, x in zip(start[a:b], p[a:b]):
                v += value[s] * x
            if v >= 1e-60:
                value.append(v)
                power.append(power[-1])
                continue
        top = max([power[start[k]] for k in range(a, b)])
        v = 0.0
        for k in range(a, b):
            s = start[k]
            x = power[s]
            v += value[s] * p[k] if x == top else ldexp(value[s] * p[k], x - top)
        if v < 1e-60:
            v, shift = math.frexp(v)
            top += shift
        if top != power[-1]:
            changed = e
        value.append(v)
        power.append(top)
    return np.log(np.array(value)) + np.array(power) * math.log(2)


def _chains(uses, length: int, prob: np.ndarray) -> np.ndarray:
    """(position, language) logs of the forward variables of a long word."""
    start, end, piece = uses
    first = np.searchsorted(end, np.arange(length + 2)).tolist()
    start = start.tolist()
    return np.stack([chain(start, first, prob[piece, k].tolist()) for k in range(prob.shape[1])], 1)


def long_scores(lattice: Lattice, word: bytes, prob: np.ndarray) -> np.ndarray:
    return _chains(lattice.uses(word), len(word), prob)[-1]


def long_counts(uses, length: int, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language in one word of any length, which occurs ``weight`` times."""
    start, end, piece = uses
    before = _chains(uses, length, prob)
    order = np.lexsort((end, length - start))
    after = _chains((length - end[order], length - start[order], piece[order]), length, prob)[::-1]
    share = np.exp(np.minimum(before[start] + np.log(prob[piece]) + after[end] - before[-1], 0))
    counts = np.zeros(prob.shape)
    np.add.at(counts, piece, share * weight)
    return counts


def expected_counts(edges, alpha, scale, prob: np.ndarray, ends: np.ndarray, ll: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language; ``weight``: (word, language) counts of the words."""
    words, langs = weight.shape
    beta = np.full((len(edges) + 1, words, langs), -np.inf)
    beta[ends, np.arange(words)] = 0
    counts = np.zeros(prob.shape)
    with np.errstate(divide="ignore", over="ignore"):
        log_p, log_a = np.log(prob), np.log(alpha) + scale
        for e in range(len(edges), 0, -1):
            for size, at, piece in edges[e - 1]:
                through = log_p[piece] + beta[e, at]
                beta[e - size, at] = np.logaddexp(beta[e - size, at], through)
                share = np.exp(np.minimum(log_a[e - size, at] + through - ll[at], 0))
                np.add.at(counts, piece, share * weight[at])
    return counts


def _spaced(buf: np.ndarray, off: np.ndarray):
    low = vec.fold(buf)
    s, e = vec.edges(~vec._SPACE[low], off)
    return low, vec.hashes(low, s, e), s, e, np.searchsorted(s, off)


def _words_of(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[bytes]:
    data = low.tobytes()
    return [_MARK + data[a:b] for a, b in zip(s, e)]


def _by_length(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in parts])
    order = np.argsort(-n, kind="stable")
    buf, off = _joined([parts[k] for k in order])
    return buf, off, order, n[order]


class Model:
    """Piece probabilities of each language, and the floors below which a text is rejected."""

    def __init__(self, pieces: list[bytes], langs: list[str], prob: np.ndarray, floor: np.ndarray):
        self.pieces, self.langs, self.prob, self.floor = pieces, langs, prob, floor
        self._ready = None

    def __getstate__(self):
        return self.pieces, self.langs, self.prob.astype(np.float32), self.floor

    def __setstate__(self, state):
        self.pieces, self.langs, self.prob, self.floor = state
        self.prob = self.prob.astype(np.float64)
        self._ready = None

    def _tables(self):
        if self._ready is None:
            self._ready = Lattice(self.pieces), np.zeros(_SLOTS, np.uint64), np.zeros((_SLOTS, len(self.langs)), np.float32)
        return self._ready

    def word_scores(self, parts: list[bytes]) -> np.ndarray:
        """(word, language) log-likelihoods, rounded to single precision."""
        lattice = self._tables()[0]
        out = np.empty((len(parts), len(self.langs)))
        at = np.argsort([-len(x) for x in parts], kind="stable")
        i = sum(len(x) > SHORT for x in parts)
        for k in at[:i]:
            out[k] = long_scores(lattice, parts[k], self.prob)
        while i < len(at):  # bound the forward table: positions times words
            j = min(len(at), i + max(1, 400_000 // (len(parts[at[i]]) + 1)))
            buf, off, order, ends = _by_length([parts[k] for k in at[i:j]])
            ll, _, _ = forward(lattice.edges(buf, off), len(ends), self.prob, ends)
            out[at[i:j][order]] = ll
            i = j
        return out.astype(np.float32).astype(np.float64)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, language) log-likelihoods, words and their bytes of each row, (row, language) unlikely words."""
        _, keys, values = self._tables()
        buf, off = vec.raw(column)
        total, words, size, unlikely = [], [], [], []
        for a, b in vec.chunks(off, 1 << 20):
            low, h, s, e, first = _spaced(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            unique, where, back = np.unique(h, return_index=True, return_inverse=True)
            slot = (unique & np.uint64(_SLOTS - 1)).astype(np.int64)
            known = keys[slot] == unique
            score = values[slot].astype(np.float64)
            lost = np.flatnonzero(~known)
            if len(lost):
                score[lost] = self.word_scores(_words_of(low, s[where[lost]], e[where[lost]]))
                keys[slot[lost]], values[slot[lost]] = unique[lost], score[lost]
            sums, some = np.zeros((b - a, len(self.langs))), np.flatnonzero(np.diff(first))
            if len(some):
                sums[some] = np.add.reduceat(score[back], first[:-1][some], axis=0)
            total.append(sums)
            odd = np.zeros((len(h) + 1, len(self.langs)), np.int64)
            np.cumsum((score / (e - s + len(_MARK))[where][:, None] < self.floor)[back], axis=0, out=odd[1:])
            unlikely.append(odd[first[1:]] - odd[first[:-1]])
            words.append(np.diff(first))
            lengths = np.concatenate([[0], np.cumsum(e - s + len(_MARK))])
            size.append(lengths[first[1:]] - lengths[first[:-1]])
        if not total:
            none = np.zeros((0, len(self.langs)))
            return none, np.zeros(0, np.int64), np.zeros(0, np.int64), none.astype(np.int64)
        return np.concatenate(total), np.concatenate(words), np.concatenate(size), np.concatenate(unlikely)


def fit(texts: list[str], labels: list[str], pieces: list[bytes], rounds: int = ROUNDS, unlikely: float = UNLIKELY) -> Model:
    """Expectation maximisation over the words of the sample."""
    langs = sorted(set(labels))
    column = pa.array(texts, pa.string())
    buf, off = vec.raw(column)
    low, h, s, e, first = _spaced(buf, off)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    lang = np.array([langs.index(x) for x in labels], np.int64)
    unique, where, back = np.unique(h, return_index=True, return_inverse=True)
    weight = np.zeros((len(unique), len(langs)))
    np.add.at(weight, (back, lang[row]), 1)
    parts = _words_of(low, s[where], e[where])
    short = [k for k, x in enumerate(parts) if len(x) <= SHORT]
    lattice = Lattice(pieces)
    prob = np.full((lattice.size, len(langs)), 1.0 / lattice.size)
    blocks = []
    for i in range(0, len(short), 5_000):
        own = short[i : i + 5_000]
        b, o, order, ends = _by_length([parts[k] for k in own])
        blocks.append((lattice.edges(b, o), ends, weight[np.array(own)[order]]))
    long = [(lattice.uses(x), len(x), weight[k]) for k, x in enumerate(parts) if len(x) > SHORT]
    for _ in range(rounds):
        counts = np.zeros_like(prob)
        for edges, ends, w in blocks:
            ll, alpha, scale = forward(edges, len(ends), prob, ends)
            counts += expected_counts(edges, alpha, scale, prob, ends, ll, w)
        for uses, length, w in long:
            counts += long_counts(uses, length, prob, w)
        prob = counts / np.maximum(counts.sum(0), 1) + FLOOR
        prob /= prob.sum(0)
    model = Model(pieces, langs, prob, np.full(len(langs), -np.inf))
    each = model.word_scores(parts) / np.array([len(x) for x in parts])[:, None] if parts else np.zeros((0, len(langs)))
    floor = np.full(len(langs), -np.inf)
    for k in range(len(langs)):
        own = [np.quantile(each[back[first[r] : first[r + 1]], k], unlikely) for r in np.flatnonzero(lang == k) if first[r + 1] > first[r]]
        if own:
            floor[k] = np.median(own)
    model.floor = floor
    vec.release()
    return model


def sample(docs: DataFrame, per_lang: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """At most so many different labelled texts of each language: those of the lowest hash, whole. Copies count once."""
    labelled = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    w = Window.partitionBy("lang").orderBy("h")
    lowest = rows.select("lang", "h").withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= per_lang).select("lang", "h").distinct()
    # at most per_lang rows a language, whatever the size of the corpus
    found = rows.join(F.broadcast(lowest), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))
    found = sorted((r[0], r[1]) for r in found.select("lang", "text").collect())
    return [text for _, text in found], [lang for lang, _ in found]


def _decide(model: Model, column: pa.Array):
    total, words, size, unlikely = model.texts(column) if model.langs else (None,) * 4
    if not model.langs:
        n = len(column)
        return np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
    best = total.argmax(1) if len(total) else np.zeros(0, np.int64)
    top = total[np.arange(len(best)), best]
    share = 1 / np.exp(np.minimum(total - top[:, None], 0)).sum(1)
    mean = top / np.maximum(size, 1)
    ok = (words > 0) & (unlikely[np.arange(len(best)), best] <= words / 2 + MARGIN)
    return np.where(words > 0, best, -1), mean, share, words, ok


def trained(docs: DataFrame, vocabulary: str = VOCABULARY, per_lang: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> Model:
    texts, labels = sample(docs, per_lang, text_col, lang_col)
    return fit(texts, labels, read_pieces(vocabulary))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, posterior, ll_per_byte, n_words, accepted), a row for each of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @vec.tidy
    def run(batches):
        m = shared.value
        for batch in batches:
            best, mean, share, words, ok = _decide(m, batch.column(1))
            none = words == 0 if m.langs else np.ones(len(best), bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m.langs[k] if k >= 0 else "und" for k in best], pa.string()),
                    pa.array(share, pa.float64(), mask=none),
                    pa.array(mean, pa.float64(), mask=none),
                    pa.array(words.astype(np.int64)),
                    pa.array(ok),
                ],
                names=["doc_id", "lang_pred", "posterior", "ll_per_byte", "n_words", "accepted"],
            )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, posterior double, ll_per_byte double, n_words long, accepted boolean"
    )


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    @vec.tidy
    def run(batches):
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array(_decide(m, batch.column(place))[4]))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, trained(docs))
