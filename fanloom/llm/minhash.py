"""Document fingerprints: MinHash over word shingles, banded, joined and verified.

A document's shingles (distinct ``n``-word windows) go through ``BANDS * ROWS`` universal hash permutations (multiply
and shift, modulo 2**64) in vectorised numpy; the least value under each is its signature. Signatures are cut into
bands. Documents with a band in common are linked in Spark (each with the least document of the band, so that a group
costs links in proportion to its size), connected components of the links are blocks, and in each block all pairs that
share a band are verified with the exact Jaccard of their shingle sets. Documents with equal sets are joined first; the
pairs of the one of least key then hold for each of them, and they are pairs of each other. With 30 bands of 5 rows a pair of Jaccard 0.6 shares a band with
probability 0.91, one of 0.7 with 0.996.

``near_duplicates`` lists the pairs of all documents; the query gives a row for each document (``near_classes``): the
class that pairs connect and its number of pairs, copies counted, so that the rows follow the table.

Defined cases
    null and empty texts and texts without words: in no pair, a class of their own. Fewer words than ``n``: one shingle
    of all words. Null doc_id: left out of the pairs, has a class and links like others. Rows that repeat a doc_id and
    text are one document. Same doc_id with different texts: a pair of equal ids is left out, each has a row of its own
    and counts as a link of the other. Empty table: no rows. Further columns: ignored. No cap on partners.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.llm.groups import components
from fanloom.llm.ngramjoin import (
    bands,
    block_parts,
    keyed,
    minima,
    node_ids,
    pair_rows,
    part_sets,
    partner_counts,
    sketches,
    stand_ins,
    star_links,
)
from fanloom.session import materialise

N = 3
THRESHOLD = 0.6
BANDS, ROWS = 30, 5


def verified_candidates(sets: list[np.ndarray], t: float, count: int, width: int, left: int | None = None):
    """(i, j, jaccard) of the sets that share a band and reach the threshold; with ``left``, only across that place."""
    m = len(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    band = bands(minima(flat, begin, count * width), width)
    share = np.zeros((m, m), bool)
    for k in range(count):
        order = np.argsort(band[:, k], kind="stable")
        h = band[order, k]
        cut = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [m]])
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a > 1:
                own = order[a:b]
                share[np.ix_(own, own)] = True
    values, back, n = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), np.diff(begin))
    some = n[back] > 1
    number = (np.cumsum(n > 1) - 1)[back[some]]
    row = row[some]
    over = np.zeros((m, m), np.float32)
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    step = max(1, 20_000_000 // max(m, 1))
    top = int(number[-1]) + 1 if len(number) else 0
    for a in range(0, top, step):
        lo, hi = np.searchsorted(number, [a, a + step])
        has = np.zeros((m, min(step, top - a)), np.float32)
        has[row[lo:hi], number[lo:hi] - a] = 1
        over += has @ has.T
    size = np.diff(begin)
    jaccard = over.astype(np.float64) / np.maximum(size[:, None] + size[None, :] - over, 1)
    good = share & (jaccard >= t)
    i, j = np.nonzero(np.triu(good, 1))
    if left is not None:
        across = (i < left) & (j >= left)
        i, j = i[across], j[across]
    return i, j, jaccard[i, j]


def fingerprints(rows: DataFrame, n: int, count: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of ``keyed`` rows, their stand-ins, and the blocks (node, label) of stand-ins that bands connect."""
    sets = materialise(sketches(rows, n, count * width, width), "fingerprints")
    reps = materialise(stand_ins(sets), "reps")
    once = sets.join(reps.where("kid = rep").select("kid"), "kid", "left_semi").dropDuplicates(["kid"])
    return sets, reps, components(star_links(once))


def near_duplicates(
    docs: DataFrame, n: int = N, t: float = THRESHOLD, count: int = BANDS, width: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b."""
    rows = keyed(docs, id_col, text_col)
    sets, reps, blocks = fingerprints(rows, n, count, width)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kid, sets, left = part_sets(pdf)
        i, j, jaccard = verified_candidates(sets, t, count, width, left)
        return pd.DataFrame({"a": kid[i], "b": kid[j], "jaccard": jaccard})

    pairs = block_parts(rows, blocks, n).groupBy("label", "x", "y").applyInPandas(run, "a long, b long, jaccard double")
    return pair_rows(pairs, node_ids(sets, reps))


def near_classes(
    docs: DataFrame, n: int = N, t: float = THRESHOLD, count: int = BANDS, width: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each document: its class, which is what the pairs connect, and the number
    of other documents with which it is a pair. Pairs stay in their blocks, so that what is shuffled follows the rows."""
    rows = keyed(docs, id_col, text_col)
    _, reps, blocks = fingerprints(rows, n, count, width)
    held = reps.groupBy("rep").agg(F.count(F.lit(1)).alias("held"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kid, sets, left = part_sets(pdf)
        i, j, _ = verified_candidates(sets, t, count, width, left)
        return partner_counts(pdf, kid, i, j)

    parts = block_parts(rows, blocks.join(held.withColumnRenamed("rep", "node"), "node"), n)
    found = materialise(parts.groupBy("label", "x", "y").applyInPandas(run, "a long, b long, links long"), "links")
    links = found.groupBy(F.col("b").alias("rep")).agg(F.sum("links").alias("links"))
    labels = components(found).withColumnRenamed("node", "rep")
    classes = held.join(links, "rep", "left").join(labels, "rep", "left")
    classes = classes.select("rep", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links"))
    own = reps.select("kid", "rep").join(classes, "rep").drop("rep")
    every = rows.select("kid", "doc_id").dropDuplicates(["kid"])
    return every.join(own, "kid", "left").select("doc_id", F.coalesce("class_id", "kid").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), N, THRESHOLD, BANDS, ROWS)
