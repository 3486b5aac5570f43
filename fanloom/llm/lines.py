"""Line dedup with levelled sorted runs of line hashes.

The state is a set of runs: tables of line hashes in the shared folder, each sorted and written once. A batch of
documents is merge-anti-joined with every run, its new lines become a run of level 0, and when a level holds
``fanout`` runs they are merged into one run of the next level. The number of runs stays logarithmic, so a corpus can
arrive in any number of batches. Each batch shuffles the hashes of every run (12 bytes a line) once to merge them with
its own, so that the work of a batch grows with what the runs hold already, not with the batch alone.

What counts as a repeat
    A line is the text between line feeds, compared without surrounding blanks, by 96 bits of hash. The first line
    in the order of (doc_id, text hash, line number) stays; later ones go. Blank lines always stay.
Defined cases
    null text: stays null. Empty text: stays. Null doc_id: ordered after all others. Rows that repeat another row's
    doc_id and text: the copies lose all their non-blank lines; which of them is the copy goes by the hash of all
    columns (but for maps), the least one stays whole. Empty table: empty result. Further columns are kept
    as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fanloom.session import fresh, materialise, new_path, remove

_LAST = (1 << 63) - 1


def _doc_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)), F.xxhash64(docs[text_col])


class LineRuns:
    """Runs of (h1, h2): ``levels[k]`` holds the paths of level k, newest last."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.read.schema("h1 long, h2 int").parquet(p) for level in self.levels for p in level]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Merge-anti-join with every run."""
        for run in self.runs():
            lines = lines.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, hashes: DataFrame) -> None:
        """Writes one sorted run of level 0 and compacts the levels that are full."""
        self._write(hashes, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self.spark.read.schema("h1 long, h2 int").parquet(*old)
            self.levels[level] = []
            self._write(merged.repartition("h1", "h2"), level + 1)
            for path in old:
                remove(self.spark, path)
            level += 1

    def _write(self, hashes: DataFrame, level: int) -> None:
        path = new_path(self.spark, f"run{level}")
        hashes.select("h1", "h2").sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def drop(self) -> None:
        for level in self.levels:
            for path in level:
                remove(self.spark, path)
        self.levels = []


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, k1, k2, line_no) of every line that isn't blank."""
    k1, k2 = _doc_key(docs, id_col, text_col)
    split = docs.select(k1.alias("k1"), k2.alias("k2"), F.posexplode(F.split(docs[text_col], "\n")).alias("line_no", "line"))
    line = F.trim(F.col("line"), F.lit(" \t\r\f\x0b"))
    return split.where(line != "").select(F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"), "k1", "k2", "line_no")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 4, runs: LineRuns | None = None
) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines taken out of the text, and two further columns at the end,
    ``n_lines`` and ``n_dropped`` (named apart from the columns that docs has).

    ``batches`` ranges of doc_id pass through the runs one after the other, as batches of arriving documents would;
    the result doesn't depend on their number. With ``runs`` given, lines of earlier corpora count as seen.
    """
    spark = docs.sparkSession
    own = runs is None
    runs = runs or LineRuns(spark, fanout)
    ident = docs[id_col].cast("long")
    cuts: list[int] = []
    if batches > 1:
        found = docs.select(F.percentile_approx(ident, [k / batches for k in range(1, batches)], 1000)).first()[0]
        cuts = sorted(set(found or []))
    new_lines = []
    for k in range(len(cuts) + 1):
        low = ident > cuts[k - 1] if k else F.lit(True)
        high = ident <= cuts[k] if k < len(cuts) else F.lit(True)
        batch = docs.where(low & high)
        if k == len(cuts):
            batch = docs.where(ident.isNull() | low) if k else docs
        first = (
            explode_lines(batch, id_col, text_col)
            .groupBy("h1", "h2")
            .agg(F.min(F.struct("k1", "k2", "line_no")).alias("at"))
        )
        new = materialise(runs.unseen(first), "newlines")
        runs.add(new)
        new_lines.append(new.select("at.*"))
    if own:
        runs.drop()
    kept = new_lines[0]
    for more in new_lines[1:]:
        kept = kept.unionByName(more)
    a, b, nos, rank, parts, n_lines, n_dropped = fresh(docs.columns, "k1", "k2", "kept", "copy", "parts", "n_lines", "n_dropped")
    kept = kept.groupBy(F.col("k1").alias(a), F.col("k2").alias(b)).agg(F.collect_list("line_no").alias(nos))
    k1, k2 = _doc_key(docs, id_col, text_col)
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    joined = docs.withColumns({a: k1, b: k2}).join(kept.hint("merge"), [a, b], "left")
    joined = joined.withColumn(rank, F.row_number().over(Window.partitionBy(a, b).orderBy(tie)))
    some = F.when(F.col(rank) == 1, F.coalesce(F.col(nos), F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    blank = F.filter(
        F.transform(F.col(parts), lambda x, i: F.when(F.trim(x, F.lit(" \t\r\f\x0b")) == "", i)), lambda i: i.isNotNull()
    )
    joined = joined.withColumn(parts, F.split(F.col(text_col), "\n"))
    keep = F.array_sort(F.concat(some, blank))
    out = joined.withColumn(nos, keep)
    text = F.array_join(F.transform(F.col(nos), lambda i: F.element_at(F.col(parts), i + 1)), "\n")
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias(n_lines),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts) - F.size(nos)).cast("long").alias(n_dropped),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, batches=4, fanout=3)


OP5_SQL = """
with lines as (
    select doc_id, i as no, string_split(text, chr(10))[i] as line
    from documents, lateral (select unnest(range(1, len(string_split(text, chr(10))) + 1)) as i)
), ranked as (
    select *, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) = '' as blank,
        row_number() over (partition by trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) order by doc_id, no) as rn
    from lines
)
select doc_id,
    case when any_value(d.text) is not null then coalesce(string_agg(line, chr(10) order by no) filter (where blank or rn = 1), '') end as text,
    cast(count(line) as bigint) as n_lines,
    cast(count(line) filter (where not blank and rn > 1) as bigint) as n_dropped
from documents d left join ranked using (doc_id)
group by doc_id
"""
