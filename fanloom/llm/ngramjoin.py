"""Jaccard self-join of documents over word n-grams, by a prefix tree: exact on sets of 48-bit hashes of n-grams.

The n-grams of all documents have one global order: by how often they occur (frequent ones last), then by hash. Counts
are those of local heavy hitters only: each block of about 4 million n-grams of a partition gives the ones it has at
least ``_LOCAL`` times, and these are summed. N-grams spread thinly lose counts, and those without any share the first
rank. So the order depends on the partitioning, and with it the number of candidates; the pairs don't.

1. Documents with equal sets are one node, the one with the least key stands for them. The query gives a row for each
   document (``near_classes``): the class that pairs connect and its number of pairs, copies counted, so that the rows
   follow the table. ``stand_in_rows`` lists the pairs of stand-ins and each other document with its stand-in,
   ``pair_rows`` the pairs of all documents.
2. Candidates. If two sets have a Jaccard of at least ``threshold``, they share n-grams among their first ones in the
   order: at least one among the first ``size - overlap + 1`` of each, and ``k + 1`` among the first ``size - overlap
   + 1 + k``. Sets send the n-grams of the longest such beginning, packed, to buckets of the hash space, where pairs
   that share them are counted; pairs whose counts over all buckets suffice are linked. Sets that are evidently alike
   (equal rows of a small min-hash sketch) are linked beforehand, and pairs within such a group needn't be counted:
   dense groups cost links in proportion to their size. Links only ever decide who meets; they rule out no pair that
   the threshold admits.
3. Connected components of the links are the blocks. In each, the sets go into a trie in the global order (paths
   without forks are one node). It is traversed with the overlaps of all other sets of the block held as one vector,
   which sets with a common beginning share; sets whose overlap can't reach the needed one any more, for the lengths
   that remain below a node, leave the vector, and a subtree without sets is not entered. Blocks of over ``PART``
   sets are cut into pairs of parts that run apart.

Defined cases
    null and empty texts and texts without words: no n-grams, in no pair, a class of their own. Fewer words than ``n``:
    one n-gram of all words. Null doc_id: left out of pairs of ids, but has a class and links like others. Rows that
    repeat a doc_id and text are one document. Same doc_id with different texts: compared, a pair of equal ids is left
    out; each has a row of its own and counts as a link of the other. A class has the least doc_id in it, null if there
    is none; where different texts share an id, so may classes. Ties: none, the least key (doc_id, then text hash)
    stands for a group. Empty table: no rows. Further columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.llm import vec
from fanloom.llm.groups import components, connected
from fanloom.llm.keys import doc_key, sized_join
from fanloom.session import fresh, materialise

N = 4
THRESHOLD = 0.5
EXTRA = 16  # the most further shared n-grams that a pair of candidates is asked for
BANDS, ROWS = 8, 4
PART = 800
PIVOTS = 32
HEAVY = 1 << 17  # ranks for that many of the most frequent n-grams at least, and for one of a thousand ...
HEAVIEST = 1 << 22  # ... up to that many (64 MB to broadcast); others share the first rank
BUCKET = 1 << 22  # n-grams that a bucket of beginnings has about, of eight bytes each, whatever the corpus
_LOCAL = 5
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64)
_LOW48 = np.uint64((1 << 48) - 1)
_KEYED = "k1 long, k2 long, kid long, doc_id long, text string"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    k1, k2 = doc_key(docs, id_col, text_col)
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.xxhash64(k1, k2).alias("kid"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def gram_sets(column: pa.Array, n: int):
    """(first row, values, begins): 48-bit n-grams of chunks of rows, sorted and distinct in each row."""
    buf, off = vec.raw(column)
    for a, b in vec.chunks(off):
        h, _, _, first = vec.words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        g, begin = vec.ngrams(h, first, n)
        values, begin = vec.distinct(g & _LOW48, begin)
        yield a, values, begin


def minima(values: np.ndarray, begin: np.ndarray, count: int) -> np.ndarray:
    """(row, permutation) least values under so many universal hash permutations; rows without values: all ones."""
    out = np.full((len(begin) - 1, count), np.uint64(0xFFFFFFFFFFFFFFFF))
    some = np.flatnonzero(np.diff(begin) > 0)
    if len(some):
        at = begin[:-1][some]
        for k in range(count):
            out[some, k] = np.minimum.reduceat((values * _MUL[k] + _ADD[k]) >> np.uint64(16), at)
    return out


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """(row, band) hashes of so many minima each."""
    count = least.shape[1] // rows
    out = np.zeros((len(least), count), np.uint64)
    for r in range(rows):
        out = vec.mix(out * np.uint64(0xD6E8FEB86659FD93) + least[:, r::rows][:, :count])
    return out


def sketches(rows: DataFrame, n: int, count: int, width: int) -> DataFrame:
    """(k1, k2, kid, doc_id, size, same1, same2, bands): two hashes of the whole set, and its band hashes."""

    @vec.tidy
    def run(batches):
        for batch in batches:
            for a, values, begin in gram_sets(batch.column(4), n):
                m = len(begin) - 1
                size = np.diff(begin)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(vec.mix(values + np.uint64(1)))])
                more = np.concatenate([[np.uint64(0)], np.cumsum(vec.mix(values ^ np.uint64(0x5555AAAA12345678)))])
                band = bands(minima(values, begin, count), width)
                flat = pa.array(band.reshape(-1).view(np.int64))
                own = batch.slice(a, m)
                keep = pa.array(size > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *own.columns[:4],
                        pa.array(size.astype(np.int32)),
                        pa.array((sums[begin[1:]] - sums[begin[:-1]]).view(np.int64)),
                        pa.array((more[begin[1:]] - more[begin[:-1]]).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * band.shape[1]), flat),
                    ],
                    names=["k1", "k2", "kid", "doc_id", "size", "same1", "same2", "bands"],
                ).filter(keep)

    return rows.mapInArrow(run, "k1 long, k2 long, kid long, doc_id long, size int, same1 long, same2 long, bands array<long>")


def stand_ins(sets: DataFrame) -> DataFrame:
    """(kid, rep, copies): the least key of the documents with the same set, and how often the document's row is there."""
    once = sets.groupBy("kid").agg(F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("size").alias("size"), F.first("same1").alias("same1"), F.first("same2").alias("same2"), F.count(F.lit(1)).alias("copies"))
    rep = once.groupBy("size", "same1", "same2").agg(F.min(F.struct("k1", "k2", "kid")).alias("rep"))
    return once.join(rep, ["size", "same1", "same2"]).select("kid", F.col("rep.kid").alias("rep"), "copies")


def star_links(sets: DataFrame) -> DataFrame:
    """(a, b): each set linked with the least one that has a band in common with it.

    One shuffle of (band hash, kid); the runs of equal hashes are found in the sorted partitions."""

    @vec.tidy
    def run(batches):
        last_h, last_a = None, 0
        for batch in batches:
            h, kid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(h):
                continue
            new = np.concatenate([[last_h is None or h[0] != last_h], h[1:] != h[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            least = np.where(at >= 0, kid[np.maximum(at, 0)], last_a)
            last_h, last_a = h[-1], least[-1]
            own = least != kid
            yield pa.RecordBatch.from_arrays([pa.array(least[own]), pa.array(kid[own])], names=["a", "b"])

    each = sets.select(F.posexplode("bands").alias("band", "h"), "kid").select(F.xxhash64("band", "h").alias("h"), "kid")
    return each.repartition("h").sortWithinPartitions("h", "kid").mapInArrow(run, "a long, b long").distinct()


def heavy_grams(rows: DataFrame, n: int, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent n-grams and their document counts (of blocks of documents in which they occur repeatedly)."""

    @vec.tidy
    def run(batches):
        held, total = [], 0

        def flush():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            some = c >= _LOCAL
            return pa.RecordBatch.from_arrays([pa.array(v[some].view(np.int64)), pa.array(c[some])], names=["gram", "n"])

        for batch in batches:
            for _, values, _ in gram_sets(batch.column(4), n):
                held.append(values)
                total += len(values)
                if total > 4_000_000:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    counts = rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "gram").limit(most).toPandas()
    top = top.sort_values("gram")
    return top["gram"].to_numpy().view(np.uint64), top["n"].to_numpy()


def ordered(values: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Values of the global order: frequency rank above the 48 bits of the n-gram."""
    grams, n = heavy
    if not len(grams):
        return values
    at = np.minimum(np.searchsorted(grams, values), len(grams) - 1)
    rank = np.where(grams[at] == values, np.minimum(n[at], 65535), 0).astype(np.uint64)
    return values | (rank << np.uint64(48))


def needed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The least overlap with which sets of these sizes reach the threshold."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


_POST = np.dtype([("gram", "u1", 6), ("at", "<u2")])
_HEAD = np.dtype([("kid", "<i8"), ("label", "<i8"), ("size", "<i4"), ("n", "<i4")])


def postings(rows: DataFrame, n: int, t: float, buckets: int, heavy) -> DataFrame:
    """(bucket, heads, posts): packed beginnings of the sets of ``rows``, which have (kid, label, text) last."""
    shared = rows.sparkSession.sparkContext.broadcast(heavy)

    @vec.tidy
    def run(batches):
        own_heavy = shared.value
        for batch in batches:
            kid, label = (batch.column(k).to_numpy() for k in (0, 1))
            for a, values, begin in gram_sets(batch.column(2), n):
                values, begin = vec.distinct(ordered(values, own_heavy), begin)
                size = np.diff(begin)
                some = size - np.ceil(t * size - 1e-9).astype(np.int64) + (size > 0)
                row = np.repeat(np.arange(len(size)), some)
                place = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
                gram = values[begin[:-1][row] + place] & _LOW48
                bucket = ((gram >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((place, row, bucket))
                bucket, row, gram, place = bucket[order], row[order], gram[order], place[order]
                post = np.empty(len(gram), _POST)
                post["gram"] = np.ascontiguousarray(gram).view(np.uint8).reshape(-1, 8)[:, :6]
                post["at"] = np.minimum(place, 65535)
                there, cut = np.unique(bucket, return_index=True)
                out = []
                for k, i, j in zip(there.tolist(), cut, np.append(cut[1:], len(bucket))):
                    docs, count = np.unique(row[i:j], return_counts=True)
                    head = np.empty(len(docs), _HEAD)
                    head["kid"], head["label"], head["size"], head["n"] = kid[a + docs], label[a + docs], size[docs], count
                    out.append((k, head.tobytes(), post[i:j].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["bucket", "heads", "posts"])

    return rows.mapInArrow(run, "bucket int, heads binary, posts binary")


def _later_pairs(begin: np.ndarray, end: np.ndarray, most: int = 2_000_000):
    """(left, right) places: each place with those from ``begin`` to ``end`` of it, in bounded blocks."""
    count = end - begin
    total = np.cumsum(count)
    at = 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        own = count[at:stop]
        if own.any():
            x = np.repeat(np.arange(at, stop), own)
            yield x, np.arange(len(x)) + np.repeat(begin[at:stop] - (np.cumsum(own) - own), own)
        at = stop


def _ends(new: np.ndarray) -> np.ndarray:
    """Where the run of each place ends, for marks of the first places of runs."""
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new))
    return np.repeat(last, last - first)


def shared_beginnings(heads: np.ndarray, gram: np.ndarray, at: np.ndarray, t: float, extra: int):
    """(kid, kid, size, size, count) of pairs of sets with different labels that share counted beginnings.

    Sets of one label that share an n-gram stand side by side and are passed over together."""
    doc = np.repeat(np.arange(len(heads), dtype=np.int32), heads["n"])
    size, label = heads["size"].astype(np.int64), heads["label"]
    codes, counts, total = [], [], 0

    def fold():
        v, back = np.unique(np.concatenate(codes), return_inverse=True)
        return [v], [np.bincount(back, weights=np.concatenate(counts), minlength=len(v)).astype(np.int64)]

    for part in range(8):  # an eighth of the hash space at a time
        own = np.flatnonzero((gram & np.uint64(7)).astype(np.uint8) == part)
        order = own[np.lexsort((label[doc[own]], gram[own]))]
        g, d, p = gram[order], doc[order].astype(np.int64), at[order].astype(np.int64)
        if not len(g):
            continue
        new, kin = np.concatenate([[True], g[1:] != g[:-1]]), label[d]
        for x, y in _later_pairs(_ends(new | np.concatenate([[True], kin[1:] != kin[:-1]])), _ends(new)):
            dx, dy = d[x], d[y]
            sx, sy = size[dx], size[dy]
            most = np.maximum(sx, sy)
            ok = np.minimum(sx, sy) >= t * most - 1e-9
            x, y, dx, dy, sx, sy, most = (v[ok] for v in (x, y, dx, dy, sx, sy, most))
            o = needed(sx, sy, t)
            k = np.minimum(extra, np.maximum(o - np.ceil(t * most - 1e-9).astype(np.int64), 0))
            ok = (p[x] <= sx - o + k) & (p[y] <= sy - o + k)
            dx, dy = dx[ok], dy[ok]
            codes.append(np.minimum(dx, dy) * len(heads) + np.maximum(dx, dy))
            counts.append(np.ones(len(dx), np.int64))
            total += len(dx)
            if total > 6_000_000:
                codes, counts = fold()
                total = len(codes[0])
    if not codes:
        return (np.zeros(0, np.int64),) * 5
    codes, counts = fold()
    x, y = codes[0] // len(heads), codes[0] % len(heads)
    return heads["kid"][x], heads["kid"][y], size[x], size[y], counts[0]


def counted_links(packed: DataFrame, t: float, extra: int) -> DataFrame:
    """(a, b) of the pairs of different labels whose shared beginnings suffice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = np.frombuffer(b"".join(pdf["heads"]), _HEAD)
        post = np.frombuffer(b"".join(pdf["posts"]), _POST)
        gram = np.zeros((len(post), 8), np.uint8)
        gram[:, :6] = post["gram"]
        gram = gram.view(np.uint64)[:, 0]
        a, b, sa, sb, c = shared_beginnings(heads, gram, post["at"], t, extra)
        del pdf, heads, post, gram
        vec.release()
        swap = a > b
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        o = needed(sa, sb, t)
        k = np.minimum(extra, np.maximum(o - np.ceil(t * np.maximum(sa, sb) - 1e-9).astype(np.int64), 0))
        return pd.DataFrame({"a": a, "b": b, "k": k.astype(np.int32), "c": c.astype(np.int32)})

    pairs = packed.groupBy("bucket").applyInPandas(run, "a long, b long, k int, c int")
    return pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("k").alias("k")).where("c > k").select("a", "b")


def trie_pairs(sets: list[np.ndarray], sizes: np.ndarray, t: float, left: int | None = None, connect: bool = False):
    """(i, j, overlap) of the sets (sorted values of the global order) whose Jaccard reaches ``t``.

    With ``left``, only pairs of one set before that place and one from there on. With ``connect``, pairs that connect
    what all of them connect (and no others): some sets are compared with all that have no group yet, and take those
    that reach the threshold for their group; in the trie, sets of one group needn't meet."""
    m = len(sets)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    values, back, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    seqs = []
    for k in range(m):
        own = back[begin[k] : begin[k + 1]]
        seqs.append(number[own[shared[own]]].astype(np.int32))
    has = np.zeros((int(shared.sum()), m), np.uint8)
    for k, s in enumerate(seqs):
        has[s, k] = 1
    out = []
    group = np.arange(m)
    if connect:
        rest = np.arange(m)
        for _ in range(PIVOTS):
            if len(rest) < 2:
                break
            k = int(rest[len(rest) // 2])
            o = has[seqs[k]][:, rest].sum(0, dtype=np.int64)
            own = (o >= t * (sizes[rest] + sizes[k] - o) - 1e-9) & (rest != k)
            out += [(k, q, v) for q, v in zip(rest[own].tolist(), o[own].tolist())]
            group[rest[own]] = k
            rest = rest[~own & (rest != k)]
    order = sorted(range(m), key=lambda k: seqs[k].astype(">i4").tobytes())
    if left is not None:
        order = [k for k in order if k < left]
    place = np.full(m, -1)
    place[order] = np.arange(len(order))
    length = np.array([len(s) for s in seqs], np.int64)
    everyone = np.arange(m) if left is None else np.arange(left, m)
    stack = [(0, len(order), 0, np.zeros(len(everyone), np.int64), everyone)]
    while stack:
        lo, hi, depth, over, alive = stack.pop()
        if hi <= lo:
            continue
        below = np.array(order[lo:hi])
        if connect and (group[below] == group[below[0]]).all():
            some = group[alive] != group[below[0]]
            over, alive = over[some], alive[some]
            if not len(alive):
                continue
        first, last = seqs[order[lo]], seqs[order[hi - 1]]
        most = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:most] != last[depth:most])
        end = depth + (int(differ[0]) if len(differ) else most - depth)
        if end > depth:
            over = over + has[first[depth:end]][:, alive].sum(0, dtype=np.int64)
        remain = int(length[below].max()) - end
        need = t / (1 + t) * (sizes[alive] + int(sizes[below].min())) - 1e-9
        keep = over + np.minimum(remain, length[alive] - over) >= need
        if left is None:
            keep &= place[alive] > lo
        over, alive = over[keep], alive[keep]
        if not len(alive):
            continue
        at = lo
        while at < hi and length[order[at]] == end:
            k = order[at]
            good = over >= t * (sizes[alive] + sizes[k] - over) - 1e-9
            if left is None:
                good &= place[alive] > at
            for q, v in zip(alive[good], over[good]):
                out.append((k, int(q), int(v)))
            at += 1
        if at < hi:
            heads = np.array([seqs[order[x]][end] for x in range(at, hi)])
            cut = np.concatenate([[0], np.flatnonzero(heads[1:] != heads[:-1]) + 1, [hi - at]])
            for x, y in zip(cut[:-1], cut[1:]):
                stack.append((at + int(x), at + int(y), end, over, alive))
    return out


def _pack(values: np.ndarray) -> bytes:
    """48-bit n-grams, six bytes each."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def _packed_sets(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` end with the text, which becomes ``grams``: the set's n-grams, packed."""
    names = rows.columns[:-1]

    @vec.tidy
    def run(batches):
        for batch in batches:
            for a, values, begin in gram_sets(batch.column(batch.num_columns - 1), n):
                data = _pack(values)
                own = batch.slice(a, len(begin) - 1)
                grams = pa.array([data[6 * i : 6 * j] for i, j in zip(begin[:-1], begin[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], grams], names=[*names, "grams"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, schema + ", grams binary")


def block_parts(rows: DataFrame, blocks: DataFrame, n: int, part: int = PART) -> DataFrame:
    """(kid, label, i, x, y, grams): the sets of the documents of each block (node, label), once a block, and where a
    block has several parts, once for each pair of parts (x, y) that the document's part i belongs to. A document that
    has several rows comes several times. Further columns of ``blocks`` are kept, before the sets."""
    more = [c for c in blocks.columns if c not in ("node", "label")]
    sized = blocks.join(blocks.groupBy("label").agg(F.count(F.lit(1)).alias("m")), "label")
    parts = F.ceil(F.col("m") / part).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    spread = sized.select(F.col("node").alias("kid"), "label", mine.alias("i"), parts.alias("p"), *more)
    packed = _packed_sets(sized_join(rows.select("kid", "text"), spread, ["kid"], "inner").select("kid", "label", "i", "p", *more, "text"), n)
    each = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    return each.select("kid", "label", "i", F.least("i", "other").alias("x"), F.greatest("i", "other").alias("y"), *more, "grams")


def part_sets(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], int | None]:
    """(kids, sets, first place of the second part) of a group of ``block_parts``."""
    x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
    pdf = pdf.drop_duplicates("kid").sort_values(["i", "kid"])
    return pdf["kid"].to_numpy(), [unpack(g) for g in pdf["grams"]], None if x == y else int((pdf["i"] == x).sum())


def part_pairs(pdf: pd.DataFrame, t: float, heavy, connect: bool = False):
    """(kids, sizes of their sets, and places i, j and overlaps of the pairs) of a group of ``block_parts``."""
    kid, sets, left = part_sets(pdf)
    sets = [np.sort(ordered(s, heavy)) for s in sets]
    sizes = np.array([len(s) for s in sets], np.int64)
    found = trie_pairs(sets, sizes, t, left, connect)
    i, j, o = (np.array(v, np.int64) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return kid, sizes, i, j, o


def verified(rows: DataFrame, blocks: DataFrame, n: int, t: float, heavy, part: int = PART, connect: bool = False) -> DataFrame:
    """(a, b, jaccard) of the documents of each block whose sets reach the threshold, a < b; with ``connect``, as many
    of them as connect the same."""
    shared = rows.sparkSession.sparkContext.broadcast(heavy)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kid, sizes, i, j, o = part_pairs(pdf, t, shared.value, connect)
        a, b = kid[i], kid[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "jaccard": o / np.maximum(sizes[i] + sizes[j] - o, 1)})

    return block_parts(rows, blocks, n, part).groupBy("label", "x", "y").applyInPandas(run, "a long, b long, jaccard double")


def partner_counts(pdf: pd.DataFrame, kid: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """(a, b, links) of the sets ``kid`` of a group of ``block_parts`` that are in pairs (i, j): the first set that these
    connect with b, and the documents (``held`` by each set) of all its partners."""
    own = pdf.drop_duplicates("kid").set_index("kid")["held"].loc[kid].to_numpy()
    links = np.zeros(len(kid), np.int64)
    np.add.at(links, i, own[j])
    np.add.at(links, j, own[i])
    some = links > 0
    return pd.DataFrame({"a": kid[connected(len(kid), i, j)][some], "b": kid[some], "links": links[some]})


def candidates(docs: DataFrame, n: int, t: float, extra: int, id_col: str, text_col: str):
    """The ``keyed`` rows, their sketches and stand-ins, the blocks (node, label) of stand-ins that may be pairs, and the
    most frequent n-grams."""
    if not 0 < t <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    sets = materialise(sketches(rows, n, BANDS * ROWS, ROWS), "sets")
    reps = materialise(stand_ins(sets), "reps")
    total = sets.agg(F.sum("size")).first()[0] or 0
    heavy = heavy_grams(rows, n, min(HEAVIEST, max(HEAVY, total // 1000)))
    once = sets.join(reps.where("kid = rep").select("kid"), "kid", "left_semi").dropDuplicates(["kid"])
    stars = materialise(star_links(once), "stars")
    labels = components(stars)
    # documents that aren't on their own: others are labelled by themselves
    side = reps.where("kid != rep").select("kid", F.lit(None).cast("long").alias("label")).unionByName(labels.select(F.col("node").alias("kid"), "label").withColumn("label", F.coalesce("label", "kid")))
    side = side.withColumn("out", F.col("label").isNull())
    joined = sized_join(rows.select("kid", "text"), side, ["kid"], "left")
    own = joined.where(~F.coalesce("out", F.lit(False))).select("kid", F.coalesce("label", "kid").alias("label"), "text")
    buckets = max(6, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, int(total * (1 - t)) // BUCKET)
    links = counted_links(postings(own, n, t, buckets, heavy), t, extra)
    return rows, sets, reps, components(links.unionByName(stars)), heavy


def near_pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD, extra: int = EXTRA, id_col: str = "doc_id", text_col: str = "text", connect: bool = False):
    """Two tables: (a, b, jaccard) of the stand-ins that reach the threshold (with ``connect``, as many as connect the
    same), and (kid, rep, copies, k1, k2, doc_id)."""
    rows, sets, reps, blocks, heavy = candidates(docs, n, t, extra, id_col, text_col)
    return verified(rows, blocks, n, t, heavy, connect=connect), node_ids(sets, reps)


def node_ids(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(kid, rep, copies, k1, k2, doc_id)."""
    ids = sets.groupBy("kid").agg(F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("doc_id").alias("doc_id"))
    return reps.join(ids, "kid")


def pair_rows(pairs: DataFrame, nodes: DataFrame, part: int = PART) -> DataFrame:
    """(doc_a, doc_b, jaccard) of all documents: pairs of stand-ins stand for those of all documents of their sets, and
    the documents of one set are pairs of each other. Sets of over ``part`` documents are paired in parts."""
    ids = materialise(nodes.select("kid", "rep", "doc_id"), "members")
    near = pairs.join(ids.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), "a").join(ids.select(F.col("rep").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y", "jaccard")
    parts = ids.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    own = ids.join(parts, "rep").withColumn("own", F.pmod(F.xxhash64("kid"), "p").cast("int"))
    left = own.select("rep", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("p") - 1)).alias("j"), F.col("kid").alias("a"), F.col("doc_id").alias("x"))
    right = own.select("rep", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("kid").alias("b"), F.col("doc_id").alias("y"))
    same = left.join(right, ["rep", "i", "j"]).where("i < j or a < b").select("x", "y", F.lit(1.0).alias("jaccard"))
    return near.unionByName(same).where("x != y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")


def stand_in_rows(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_a, doc_b, jaccard) of the stand-ins, and of each document with the stand-in of its set."""
    ids = materialise(nodes.select("kid", "rep", "doc_id"), "members")
    reps = ids.where("kid = rep").select("kid", "doc_id")
    near = pairs.join(reps.toDF("a", "x"), "a").join(reps.toDF("b", "y"), "b").select("x", "y", "jaccard")
    same = ids.where("kid != rep").select("rep", F.col("doc_id").alias("y")).join(reps.toDF("rep", "x"), "rep").select("x", "y", F.lit(1.0).alias("jaccard"))
    return near.unionByName(same).where("x != y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")


def near_classes(
    docs: DataFrame, n: int = N, t: float = THRESHOLD, extra: int = EXTRA, id_col: str = "doc_id", text_col: str = "text", part: int = PART
) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each document: the least doc_id of its class, which is what the pairs
    connect, and the number of other documents with which it is a pair. Pairs stay in their blocks."""
    rows, sets, reps, blocks, heavy = candidates(docs, n, t, extra, id_col, text_col)
    members = materialise(node_ids(sets, reps).select("kid", "rep", "doc_id"), "members")
    held = members.groupBy("rep").agg(F.count(F.lit(1)).alias("held"), F.min("doc_id").alias("least"))
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kid, _, i, j, _ = part_pairs(pdf, t, shared.value)
        return partner_counts(pdf, kid, i, j)

    parts = block_parts(rows, blocks.join(held.select(F.col("rep").alias("node"), "held"), "node"), n, part)
    found = materialise(parts.groupBy("label", "x", "y").applyInPandas(run, "a long, b long, links long"), "links")
    links = found.groupBy(F.col("b").alias("rep")).agg(F.sum("links").alias("links"))
    labels = components(found).withColumnRenamed("node", "rep")
    own = held.join(links, "rep", "left").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    own = materialise(own.select("rep", "label", "least", (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links")), "classes")
    classes = own.drop("least").join(own.groupBy("label").agg(F.min("least").alias("class_id")), "label")
    each = members.select("kid", "rep").join(classes, "rep").select("kid", "class_id", "n_links")
    every = rows.select("kid", "doc_id").dropDuplicates(["kid"])
    return every.join(each, "kid", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, n: int = N, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row (the least key) of each group that pairs connect."""
    pairs, nodes = near_pairs(docs, n, t, EXTRA, id_col, text_col, connect=True)
    nodes = materialise(nodes, "nodes")
    edges = pairs.select("a", "b").unionByName(nodes.where("kid != rep").select(F.col("rep").alias("a"), F.col("kid").alias("b")))
    groups = components(edges).join(nodes.select(F.col("kid").alias("node"), "k1", "k2"), "node")
    least = groups.groupBy("label").agg(F.min(F.struct("k1", "k2", "node")).alias("least"))
    gone = groups.join(least, "label").where("node != least.node").select("k1", "k2")
    a, b = fresh(docs.columns, "k1", "k2")
    k1, k2 = doc_key(docs, id_col, text_col)
    kept = sized_join(docs.withColumns({a: k1, b: k2}), gone.toDF(a, b), [a, b], "left_anti")
    again = nodes.where("copies > 1").select("k1", "k2").toDF(a, b)
    if again.limit(1).count():
        kept = kept.join(again, [a, b], "left_anti").unionByName(kept.join(again, [a, b], "left_semi").dropDuplicates([a, b]))
    return kept.select(*docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), N, THRESHOLD)


OP9_CLASSES_SQL = """
with recursive d as materialized (
    select row_number() over (order by doc_id, text) as k, doc_id, text from (select distinct doc_id, text from documents)
), w as (
    select k, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as ws from d
), g as materialized (
    select distinct k, array_to_string(ws[i : least(i + 3, len(ws))], ' ') as gram
    from w, lateral (select unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i) where len(ws) > 0
), s as (
    select k, count(*) as n from g group by k
), p as (
    select a.k as a, b.k as b, count(*) as o from g a join g b on a.gram = b.gram and a.k <> b.k group by all
), e as materialized (
    select a, b from p join s x on x.k = a join s y on y.k = b where o / (x.n + y.n - o) >= 0.5
), r as (
    select k, k as other from d
    union
    select r.k, e.b from r join e on e.a = r.other
), c as (
    select r.k, min(d.doc_id) as class_id from r join d on d.k = r.other group by r.k
), l as (
    select a as k, count(*) as n_links from e group by a
)
select d.doc_id, c.class_id, coalesce(l.n_links, 0) as n_links from d join c on c.k = d.k left join l on l.k = d.k
"""
# the pairs of ``stand_in_rows``
OP9_SQL = """
with w as (
    select doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as ws from documents
), g as (
    select distinct doc_id, array_to_string(ws[i : least(i + 3, len(ws))], ' ') as gram
    from w, lateral (select unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i) where len(ws) > 0
), s as (
    select doc_id, count(*) as n, string_agg(gram, '|' order by gram) as grams from g group by doc_id
), r as (
    select *, min(doc_id) over (partition by grams) as rep from s
), p as (
    select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as o
    from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id
    where a.doc_id in (select rep from r) and b.doc_id in (select rep from r)
    group by all
)
select doc_a, doc_b, o / (x.n + y.n - o) as jaccard
from p join s x on x.doc_id = doc_a join s y on y.doc_id = doc_b
where o / (x.n + y.n - o) >= 0.5
union all
select rep, doc_id, 1.0::double from r where rep <> doc_id
"""
