"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text's characters start as symbols. An agenda holds the adjacent pairs of symbols that the vocabulary has joined,
ordered by score and then by place; the best pair is joined, and the pairs with its new neighbours enter the agenda,
until it is empty. Characters outside the vocabulary become byte pieces (or the unknown piece where there are none).

No piece has a white-space mark after another character, or letters next to signs, and digits and line feeds stand
alone: a text is cut there, and the agenda runs once for each unit of text in a worker (whose table of units is
bounded). Whether the vocabulary allows this is checked when it is read. The agendas of many short units run side by
side in numpy (a row of a matrix holds a unit's symbols, another the ranks of its adjacent pairs, and each step joins
the best pair of every row); a unit of over ``_SHORT`` characters has an agenda on a heap, whose cost grows with n log n.
Ids are put together and decoded as bytes, without Python objects for ids.

Defined cases
    null text: null ids, null checks. Empty text: no ids. Null doc_id: encoded like any other row. Repeated rows: each
    encoded. Very long texts: whole. Empty table: no rows. Further columns: kept, by ``encode_column``. A mark
    character (U+2581) in a text decodes to a blank, as in the library; ``round_trip`` compares with that.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanloom.llm import vec
from fanloom.session import fresh

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_UNITS = 200_000
_SHORT = 32
_BLOCK = 50_000  # units of one text that are looked up at a time
_FAR = np.iinfo(np.int32).max
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 2, 5):
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[i : i + n]
            i += n
        else:
            raise ValueError("not a SentencePiece model")


class Vocabulary:
    """A model file's pieces, ids and scores, and encoding and decoding with them."""

    def __init__(self, path: str = VOCABULARY):
        self.pieces, self.scores, self.kinds = [], [], []
        self.prefix = True
        trainer: dict = {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    self.pieces.append(piece.get(1, b"").decode())
                    self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                    self.kinds.append(piece.get(3, _NORMAL))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    norm = dict(_fields(value))
                    self.prefix = bool(norm.get(3, 1))
                    if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                        raise ValueError("only models without normalisation, with escaped blanks, are supported")
        if trainer.get(3) != 2 or _USER in self.kinds or _UNUSED in self.kinds:
            raise ValueError("only merge-type (BPE) models without user-defined pieces are supported")
        self.ids = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] == _NORMAL}
        self.rank = {p: -self.scores[k] for p, k in self.ids.items()}
        self.byte = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == _BYTE}
        self.unknown = self.kinds.index(_UNKNOWN)
        self.text = [
            bytes([int(p[3:5], 16)]) if kind == _BYTE else b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN else p.replace(MARK, " ").encode()
            for p, kind in zip(self.pieces, self.kinds)
        ]
        self.unit = self._unit()
        self.known = _Units(self)
        self._pairs()

    def _pairs(self) -> None:
        """Symbols (pieces by id, then characters that are no pieces) and, sorted by key, the pairs that the vocabulary joins."""
        number = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - number.keys()):
            number[c] = len(self.pieces) + len(number) - len(self.ids)
        self.symbols = len(self.pieces) + len(number) - len(self.ids) + 1  # the last one: any other character
        single = sorted(c for c in number if len(c) == 1)
        self.chars = np.array([ord(c) for c in single], np.int64)
        self.char_symbol = np.array([number[c] for c in single], np.int32)
        order = {s: k for k, s in enumerate(sorted(set(self.rank.values())))}
        keys, joined = [], []
        for p, k in self.ids.items():
            for cut in range(1, len(p)):
                a, b = number.get(p[:cut]), number.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.symbols + b)
                    joined.append(k)
        keys = np.array(keys, np.int64)
        at = np.argsort(keys)
        self.pair_keys, self.pair_piece = keys[at], np.array(joined, np.int32)[at]
        self.pair_rank = np.array([order[self.rank[self.pieces[k]]] for k in joined], np.int32)[at]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.pair_keys)] = True
        self.piece_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.piece_begin = np.concatenate([[0], np.cumsum([len(x) for x in self.text])])

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined piece) of adjacent symbols; rank ``_FAR`` where the vocabulary doesn't join them."""
        keys = a.astype(np.int64) * self.symbols + b
        rank, piece = np.full(keys.shape, _FAR, np.int32), np.zeros(keys.shape, np.int32)
        may = np.flatnonzero(self.maybe[self._slot(keys.reshape(-1))])
        own = keys.reshape(-1)[may]
        at = np.minimum(np.searchsorted(self.pair_keys, own), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == own if len(self.pair_keys) else np.zeros(len(own), bool)
        rank.reshape(-1)[may[hit]], piece.reshape(-1)[may[hit]] = self.pair_rank[at[hit]], self.pair_piece[at[hit]]
        return rank, piece

    def _unit(self):
        """Pattern of the units: marks, then letters, or one digit, or other signs; a coarser one (or none) where the
        vocabulary has pieces that reach over such places."""
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(x[1] == MARK and x[0] != MARK for x in pairs):
            return None

        odd = "".join(re.escape(c) for c in sorted({c for p in self.ids for c in p}) if re.match(r"[^\W\d_]", c) and not c.isalpha())

        def kind(c: str) -> int:
            return 0 if re.match(r"[\d\n\t]", c) else 1 if re.match(rf"[^\W\d_{odd}]", c) else 2

        if all(x[0] == MARK or kind(x[0]) == kind(x[1]) > 0 for x in pairs):
            return re.compile(rf"{MARK}*(?:[^\W\d_{odd}]+|[\d\n\t]|(?:[_{odd}]|[^\w\n\t{MARK}])+)|{MARK}+")
        return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def agenda(self, text: str) -> list[int]:
        """Ids of a text with marks for blanks."""
        symbols: list[str] = list(text)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, heap = self.rank, []
        for k in range(n - 1):
            joined = symbols[k] + symbols[k + 1]
            if joined in rank:
                heap.append((rank[joined], k, k + 1, joined))
        heapq.heapify(heap)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != len(joined) or right[a] != b:
                continue
            symbols[a], symbols[b] = joined, ""
            c = right[a] = right[b]
            if c < n:
                left[c] = a
                more = joined + symbols[c]
                if more in rank:
                    heapq.heappush(heap, (rank[more], a, c, more))
            if (c := left[a]) >= 0:
                more = symbols[c] + joined
                if more in rank:
                    heapq.heappush(heap, (rank[more], c, a, more))
        out = []
        for s in symbols:
            if s:
                k = self.ids.get(s)
                if k is not None:
                    out.append(k)
                elif self.byte:
                    out += [self.byte[b] for b in s.encode()]
                elif not (out and out[-1] == self.unknown):
                    out.append(self.unknown)
        return out

    def _ids_of(self, symbols: np.ndarray, unit: str) -> bytes:
        """Ids of a unit's last symbols as bytes, with byte pieces or the unknown piece for those that are no pieces."""
        out, at = [], 0
        for k in symbols.tolist():
            if k < len(self.pieces):
                out.append(k)
                at += len(self.pieces[k])
                continue
            if self.byte:
                out += [self.byte[b] for b in unit[at].encode()]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
            at += 1
        return np.array(out, np.int32).tobytes()

    def agendas(self, units: list[str]) -> list[bytes]:
        """Ids (as bytes) of units of at most ``_SHORT`` characters, whose agendas run side by side.

        All rows of a matrix have the same number of symbols; a row whose best pair is joined has one less and goes on
        with the next matrix, a row without pairs is done."""
        out: list[bytes] = [b""] * len(units)
        length = np.array([len(u) for u in units], np.int64)
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        place = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1) if len(self.chars) else np.zeros(len(code), np.int64)
        known = self.chars[place] == code if len(self.chars) else np.zeros(len(code), bool)
        symbol = np.where(known, self.char_symbol[place] if len(self.chars) else 0, self.symbols - 1).astype(np.int32)
        begin = np.cumsum(length) - length
        rows, sym = np.zeros(0, np.int64), np.zeros((0, int(length.max(initial=1))), np.int32)
        rank, piece = np.zeros((0, max(sym.shape[1] - 1, 0)), np.int32), np.zeros((0, max(sym.shape[1] - 1, 0)), np.int32)
        for n in range(int(length.max(initial=0)), 0, -1):
            new = np.flatnonzero(length == n)
            fresh_ = symbol[begin[new][:, None] + np.arange(n)]
            r, p = self._ranked(fresh_[:, :-1], fresh_[:, 1:])
            rows, sym, rank, piece = np.concatenate([rows, new]), np.concatenate([sym, fresh_]), np.concatenate([rank, r]), np.concatenate([piece, p])
            if n > 1:
                best = rank.argmin(1)
                more = rank[np.arange(len(rows)), best] < _FAR
            else:
                best, more = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            done = np.flatnonzero(~more)
            plain = (sym[done] < len(self.pieces)).all(1)
            data = sym[done].tobytes()
            for k, (i, ok) in enumerate(zip(rows[done].tolist(), plain.tolist())):
                out[i] = data[4 * n * k : 4 * n * (k + 1)] if ok else self._ids_of(sym[done[k]], units[i])
            rows, best, sym, rank, piece = rows[more], best[more], sym[more], rank[more], piece[more]
            if n > 1:
                at = np.arange(len(rows))
                after = np.arange(n - 1) > best[:, None]
                joined = piece[at, best]
                sym = np.where(after, sym[:, 1:], sym[:, :-1])
                sym[at, best] = joined
                after = after[:, : n - 2] | (np.arange(n - 2) == best[:, None])
                rank, piece = np.where(after, rank[:, 1:], rank[:, :-1]), np.where(after, piece[:, 1:], piece[:, :-1])
                for shift in (-1, 0):  # the pairs with the symbols before and after
                    own = np.flatnonzero((best + shift >= 0) & (best + shift < n - 2))
                    j = best[own] + shift
                    rank[own, j], piece[own, j] = self._ranked(sym[own, j], sym[own, j + 1])
        return out

    def units(self, text: str) -> list[str]:
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return self.unit.findall(marked) if self.unit else [marked]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts as bytes; null and empty texts have none. A text is looked up block by block."""
        out, held, total = [], [], 0

        def flush():
            nonlocal held, total
            self.known.learn(set().union(*held))
            out.extend(b"".join(map(self.known.__getitem__, u)) for u in held)
            held, total = [], 0

        for t in texts:
            if t and len(t) > 20 * _BLOCK and self.unit:
                flush()
                marked, parts = (MARK if self.prefix else "") + t.replace(" ", MARK), []
                found = self.unit.finditer(marked)
                while block := [m.group() for m in islice(found, _BLOCK)]:
                    self.known.learn(set(block))
                    parts.append(b"".join(map(self.known.__getitem__, block)))
                out.append(b"".join(parts))
                continue
            held.append(self.units(t) if t else [])
            total += len(held[-1])
            if total > 4 * _BLOCK:
                flush()
        flush()
        return out

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids one after the other, where those of each id begin ... and the end)."""
        size = np.diff(self.piece_begin)[ids]
        begin = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(begin[-1]) + np.repeat(self.piece_begin[ids] - begin[:-1], size)
        return self.piece_bytes[at], begin

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def plain(self, data: bytes) -> bytes:
        """Decoded bytes of a text without the blank that stands for its begin."""
        return data[1:] if self.prefix and data[:1] == b" " else data

    def decode(self, ids) -> str:
        return self.plain(b"".join(map(self.text.__getitem__, ids))).decode(errors="replace")


class _Units(dict):
    """Unit of text -> its ids as bytes; when full, it starts anew with what is used of the old one."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.old, self.long = vocabulary, {}, {}

    def learn(self, units: set[str]) -> None:
        """Makes the ids of these units known, until the next call."""
        self.long.clear()
        if len(self) >= _UNITS:
            self.old = dict(self)
            self.clear()
        short = []
        for u in [u for u in units if u not in self]:
            ids = self.old.get(u)
            if ids is not None:
                self[u] = ids
            elif len(u) <= _SHORT:
                short.append(u)
            else:
                self.long[u] = np.array(self.vocabulary.agenda(u), np.int32).tobytes()
        for k in range(0, len(short), _BLOCK):
            own = short[k : k + _BLOCK]
            self.update(zip(own, self.vocabulary.agendas(own)))

    def __missing__(self, unit: str) -> bytes:
        return self.long[unit]


@lru_cache(2)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_column(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens``, ``round_trip`` and, with ``check``, ``matches_library`` (renamed where docs
    has such columns). Each Arrow batch is also encoded by the library and compared, ids by ids."""
    names = fresh(docs.columns, "ids", "n_tokens", "round_trip", "matches_library")[: 4 if check else 3]
    kinds = [T.ArrayType(T.IntegerType(), False), T.LongType(), T.BooleanType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    place, kept = docs.columns.index(text_col), docs.columns

    @vec.tidy
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                own = batch.slice(start, 250)
                texts = own.column(place).to_pylist()
                data = v.encode_many(texts)
                none = np.array([t is None for t in texts], bool)
                n = np.array([len(d) // 4 for d in data], np.int64)
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = np.frombuffer(b"".join(data), np.int32)
                same = []
                decoded, begin = v.decode_bytes(flat)
                decoded, begin = decoded.tobytes(), begin[off].tolist()
                back = [t is not None and v.plain(decoded[i:j]) == t.replace(MARK, " ").encode() for t, i, j in zip(texts, begin, begin[1:])]
                if check:
                    ids = flat.tolist()
                    theirs = _library(path).encode([t or "" for t in texts], num_threads=1)
                    same = [ids[off[k] : off[k + 1]] == x for k, x in enumerate(theirs)]
                offsets = pa.array(off, pa.int32(), mask=np.append(none, False)) if none.any() else pa.array(off, pa.int32())
                columns = [
                    pa.ListArray.from_arrays(offsets, pa.array(flat), type=pa.list_(pa.field("element", pa.int32(), False))),
                    pa.array(n, mask=none),
                    pa.array(back, pa.bool_(), mask=none),
                ] + ([pa.array(same, pa.bool_(), mask=none)] if check else [])
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*kept, *names])

    return docs.mapInArrow(run, schema)


def decode_column(df: DataFrame, path: str = VOCABULARY, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the texts of a column of ids; null ids give null, ids outside the vocabulary raise."""
    (name,) = fresh(df.columns, out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    place, kept = df.columns.index(ids_col), df.columns

    @vec.tidy
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else v.decode(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, name])

    return df.mapInArrow(run, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text"))
    return encode_column(docs, VOCABULARY).drop("text")
