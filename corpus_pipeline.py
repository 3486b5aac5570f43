"""A corpus pipeline of five stages, from documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs`` (which
may be more than those of the table ``documents``; they are kept whatever their names). ``n_chars`` follows the text.

1. language_id: documents that no fitted language explains, or without words, go.
2. line_dedup: every line stays where it stands first; documents that lose all their lines go.
3. near_duplicates: of each group of near-duplicates (n-gram Jaccard join) the document of least id stays.
4. decontamination: documents that hold a benchmark item, whole or in pieces, go.
5. tokens: ids of the SentencePiece vocabulary, with checks.

Defined cases
    null or blank texts have no language and go in stage 1. Null doc_ids are ordered last and treated alike. Rows that
    repeat a doc_id and text: one is left after stage 2. Empty tables: no rows. Labels that are null: not used to fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.llm import decontaminate, langid, lines, ngramjoin, sentencepieces
from fanloom.session import materialise


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.trained(docs))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(docs, batches=4, fanout=3)
    dropped = done.columns[-1]
    kept = done.where(~((F.col(dropped) > 0) & (F.regexp_replace("text", r"\s", "") == "")))
    chars = F.when(F.col(dropped) > 0, F.char_length("text").cast("long"))
    return kept.select(*[F.coalesce(chars, F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_one(docs, ngramjoin.N, ngramjoin.THRESHOLD)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark, tile=decontaminate.TILE, coverage=decontaminate.COVERAGE)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_column(docs, sentencepieces.VOCABULARY)


STAGES = [
    ("language_id", _language_id),
    ("line_dedup", _line_dedup),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("tokens", _tokens),
]

#: A fitted model decides in the first stage, and ids come from a vocabulary file: SQL can't say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
