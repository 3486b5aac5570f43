"""Benchmark decontamination by greedy string tiling.

Every window of ``tile`` words of a document is hashed (Karp-Rabin, all windows at once) and joined with the windows
of the benchmark items. A fixed-size bitmap of the benchmark's windows, sized by their checked count, keeps windows
that no item has from leaving the scan. The joined window pairs (place in item, place in document) hold every common
run of at least ``tile`` words as a diagonal run, so the tiling needs no text: the longest unmarked run is marked
again and again, words are marked once on either side, until no run of ``tile`` words is left. The share of an item's
words that is marked is its coverage; order doesn't matter to it, so that passages put together anew count in full.

Defined cases
    null or empty text, or fewer words than a tile: no match (an item shorter than a tile is matched as one window of
    its own length). Null doc_id: matched like any other, returned with a null id. Repeated rows: each gets the same
    answer, given once per (doc_id, text). Repeated items: each is an item. Ties of equal length: the run first in the
    item, then first in the document. Empty tables: no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.llm import vec
from fanloom.llm.keys import doc_key, sized_join

TILE = 4
COVERAGE = 0.5
_MOST_BITS = 1 << 24


def greedy_tiles(pairs: np.ndarray, spans: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles (item place, document place, words) from window pairs; ``spans``: words of each pair's window.

    Windows that follow each other on a diagonal form one run. The longest run (ties: first in the item, then in the
    document) is marked; runs that it cuts go back as what is left of them.
    """
    if not len(pairs):
        return []
    order = np.lexsort((pairs[:, 0], pairs[:, 1] - pairs[:, 0]))
    i, j, n = pairs[order, 0], pairs[order, 1], spans[order]
    least = int(n.min())
    new = np.ones(len(i), bool)
    new[1:] = ((j - i)[1:] != (j - i)[:-1]) | (i[1:] != i[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(i)]]) - 1
    heap = [(-int(i[b] + n[b] - i[a]), int(i[a]), int(j[a])) for a, b in zip(at, last)]
    heapq.heapify(heap)
    item, doc, tiles = set(), set(), []
    while heap:
        size, a, b = heapq.heappop(heap)
        size = -size
        free = [a + k not in item and b + k not in doc for k in range(size)]
        if all(free):
            item.update(range(a, a + size))
            doc.update(range(b, b + size))
            tiles.append((a, b, size))
            continue
        k = 0
        while k < size:
            if free[k]:
                e = k
                while e < size and free[e]:
                    e += 1
                if e - k >= least:
                    heapq.heappush(heap, (-(e - k), a + k, b + k))
                k = e
            else:
                k += 1
    return tiles


def _windows(column: pa.Array, tile: int):
    """(row, place, hash) of every window and each row's words, in chunks of rows."""
    buf, off = vec.raw(column)
    for a, b in vec.chunks(off):
        h, _, _, first = vec.words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        g, begin = vec.ngrams(h, first, tile)
        row = np.repeat(np.arange(b - a), np.diff(begin))
        yield a + row, np.arange(len(g)) - begin[row], g, np.diff(first), a


def item_windows(benchmark: DataFrame, tile: int = TILE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(seed, item_id, i, item_words, span) of the benchmark."""

    @vec.tidy
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, place, g, n, a in _windows(batch.column(1), tile):
                size = n[row - a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), ids.take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.minimum(size, tile).astype(np.int32))],
                    names=["seed", "item_id", "i", "item_words", "span"],
                )

    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "seed long, item_id long, i int, item_words int, span int"
    )


def _bitmap(seeds: DataFrame, n: int) -> np.ndarray:
    bits = 1 << 16
    while bits < 16 * n and bits < _MOST_BITS:
        bits *= 2

    @vec.tidy
    def run(batches):
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for (own,) in seeds.select("seed").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(own, np.uint8)
    return np.unpackbits(whole, bitorder="little").astype(bool)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(k1, k2, doc_id, item_id, n_tiles, matched_words, item_words, coverage) of the pairs at or over ``coverage``."""
    spark = docs.sparkSession
    from fanloom.session import materialise

    seeds = materialise(item_windows(benchmark, tile), "seeds")
    n = seeds.count()
    bits = spark.sparkContext.broadcast(_bitmap(seeds, n))
    short = [r[0] for r in seeds.where(F.col("span") < tile).select("span").distinct().collect()]

    @vec.tidy
    def scan(batches):
        hit_bits = bits.value
        last = np.uint64(len(hit_bits) - 1)
        for batch in batches:
            out = []
            for width in (tile, *short):
                for row, place, g, size, a in _windows(batch.column(3), width):
                    hit = hit_bits[(g & last).astype(np.int64)] & (size[row - a] >= width)
                    out.append((row[hit], place[hit], g[hit]))
            row, place, g = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
            if len(row):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(g.view(np.int64)), pa.array(place.astype(np.int32))],
                    names=["k1", "k2", "doc_id", "seed", "j"],
                )

    k1, k2 = doc_key(docs, id_col, text_col)
    hits = docs.select(k1.alias("k1"), k2.alias("k2"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        scan, "k1 long, k2 long, doc_id long, seed long, j int"
    )
    found = hits.join(F.broadcast(seeds) if n <= 500_000 else seeds, "seed")

    pairs = found.groupBy("k1", "k2", "doc_id", "item_id", "item_words").agg(F.collect_list(F.struct("i", "j", "span")).alias("w"))
    # an upper bound of the coverage: each window covers at most a tile of the item's words
    pairs = pairs.where(F.size(F.array_distinct(F.col("w.i"))) * tile >= coverage * F.col("item_words"))

    def tiled(frames):
        for pdf in frames:
            n, matched = [], []
            for w in pdf["w"]:
                at = np.array([(x["i"], x["j"], x["span"]) for x in w], np.int64)
                at = np.unique(at, axis=0)
                tiles = greedy_tiles(at[:, :2], at[:, 2])
                n.append(len(tiles))
                matched.append(sum(t[2] for t in tiles))
            out = pdf.drop(columns="w").assign(n_tiles=np.array(n, np.int32), matched_words=np.array(matched, np.int32))
            out["coverage"] = out["matched_words"] / out["item_words"]
            yield out[out["coverage"] >= coverage][columns]

    schema = "k1 long, k2 long, doc_id long, item_id long, n_tiles int, matched_words int, item_words int, coverage double"
    columns = [x.split()[0] for x in schema.split(", ")]
    return pairs.mapInPandas(tiled, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item to the coverage threshold."""
    from fanloom.session import fresh

    bad = contaminated(docs, benchmark, **kw).select("k1", "k2").distinct()
    a, b = fresh(docs.columns, "k1", "k2")
    k1, k2 = doc_key(docs, kw.get("id_col", "doc_id"), kw.get("text_col", "text"))
    bad = bad.toDF(a, b)
    return sized_join(docs.withColumns({a: k1, b: k2}), bad, [a, b], "left_anti").select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, benchmark, TILE, COVERAGE).drop("k1", "k2")
