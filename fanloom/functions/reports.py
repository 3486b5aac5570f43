"""Reports of attempts: resolution of outcomes, and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(items: Column, targets: Column) -> Column:
    """Report items with the targets that none names inferred as succeeded, joined to an item (Succeeded, null) if
    there is one; null if there are no items at all."""
    none = F.array().cast("array<struct<outcome:string,output:string,targetIds:array<string>>>")
    given = F.coalesce(items, none)
    named = F.flatten(F.transform(given, lambda x: F.coalesce(x["targetIds"], F.array().cast("array<string>"))))
    rest = F.array_except(F.coalesce(targets, F.array().cast("array<string>")), named)
    plain = lambda x: (x["outcome"] == "Succeeded") & x["output"].isNull()
    joined = F.transform(given, lambda x: F.when(plain(x), F.struct(x["outcome"].alias("outcome"), x["output"].alias("output"), F.concat(x["targetIds"], rest).alias("targetIds"))).otherwise(x))
    new = F.array(F.struct(F.lit("Succeeded").alias("outcome"), F.lit(None).cast("string").alias("output"), rest.alias("targetIds")))
    whole = F.when(F.size(rest) == 0, given).when(F.exists(given, plain), joined).otherwise(F.concat(given, new))
    return F.when(F.size(whole) > 0, whole)


def failed(report: Column) -> Column:
    """Whether any item failed."""
    return F.coalesce(F.exists(report, lambda x: x["outcome"] == "Failed"), F.lit(False))


def thrown(message: Column, targets: Column) -> Column:
    """The report of an attempt that raised: one failed item over all targets."""
    return F.array(F.struct(F.lit("Failed").alias("outcome"), message.alias("output"), F.coalesce(targets, F.array().cast("array<string>")).alias("targetIds")))


def csv_lines(report: DataFrame) -> DataFrame:
    """(job_id, chunk_index, pos, line): ``outcome,output,target_count,target_ids`` of flat report rows."""

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    line = F.concat_ws(
        ",", F.col("outcome"), F.when(F.col("output").isNull(), "").otherwise(quoted(F.col("output"))), F.size("targetIds").cast("string"), quoted(F.array_join("targetIds", ";"))
    )
    return report.select("job_id", "chunk_index", "pos", line.alias("line"))


def write_csv(report: DataFrame, path: str) -> None:
    """The report as CSV files with a header, everything quoted."""
    flat = report.select("outcome", "output", F.size("targetIds").alias("target_count"), F.array_join("targetIds", ";").alias("target_ids"))
    flat.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
