"""Lines of text files with their numbers, read in parallel, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.validate import triad
from .readers import CHAT, exists

#: Splits of which the table of first numbers is sent to all tasks; with more it is joined like any table.
MOST_SPLITS = 100_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, _file, _line (from 1, in the file) and _place (from 1, in all files of the path, ordered by name).

    Splits are read in parallel: one pass counts each split's lines, sums over the splits before give its first number,
    and within a split a line is numbered by its distance from the first one. No row moves for that. Files of no lines
    and empty lines count as they stand.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = text.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = lambda *by: Window.partitionBy(*by).orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each split.
    splits = splits.withColumns({"_in_file": F.coalesce(F.sum("_n").over(before("_file")), F.lit(0)), "_in_all": F.coalesce(F.sum("_n").over(before()), F.lit(0))})
    splits = splits.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), "_first", "_in_file", "_in_all")
    rows = splits.limit(MOST_SPLITS + 1).collect()
    if len(rows) <= MOST_SPLITS:
        splits = F.broadcast(spark.createDataFrame(rows, splits.schema))
    at = F.col("_id") - F.col("_first") + 1
    found = text.join(splits, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return found.select("value", "_file", (F.col("_in_file") + at).alias("_line"), (F.col("_in_all") + at).alias("_place"))


def multi_source_lines(spark: SparkSession, sources: list[tuple[str, str]], schema: str = CHAT, strict: bool = True) -> DataFrame:
    """JSON records of sources (tag, path) in order of priority, with _source, _rank, _file, _line and _place.

    Missing paths are skipped, and blank lines, which keep their numbers. A line that is no JSON fails a strict read and is
    left out of a tolerant one. First-wins goes by (_rank, _place).
    """
    names = None
    out = None
    for rank, (tag, path) in enumerate(sources):
        if not exists(spark, path):
            continue
        lines = numbered_lines(spark, path).filter(F.trim("value") != "")
        parsed = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        lines = lines.withColumn("_record", parsed)
        bad = F.col("_record").isNull() | F.col("_record._corrupt").isNotNull()
        if strict:
            lines = lines.withColumn("_record", F.when(bad, F.raise_error(F.concat(F.lit("no JSON in line "), F.col("_line").cast("string"), F.lit(" of "), F.col("_file")))).otherwise(F.col("_record")))
        else:
            lines = lines.filter(~bad)
        names = names or [f.name for f in lines.schema["_record"].dataType.fields if f.name != "_corrupt"]
        own = lines.select(*(F.col("_record")[n].alias(n) for n in names), F.lit(tag).alias("_source"), F.lit(rank).alias("_rank"), "_file", "_line", "_place")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], schema + ", _source string, _rank int, _file string, _line long, _place long")


def judged(lines: DataFrame, schema: str = CHAT) -> DataFrame:
    """Lines that are not blank, with is_json, html (the last message), is_html, reason (null if all is well) and sample, the reason in words."""
    record = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = lines.filter(F.trim("value") != "").withColumn("_r", record)
    out = out.withColumn("is_json", F.col("_r").isNotNull() & F.col("_r._corrupt").isNull())
    out = out.withColumn("html", F.when(F.col("is_json"), F.try_element_at("_r.messages", F.lit(-1))["content"]))
    out = out.withColumn("_lacks", triad("html"))
    out = out.withColumn("is_html", F.col("html").isNotNull() & (F.size("_lacks") == 0))
    reason = F.when(~F.col("is_json"), "json").when(F.col("html").isNull(), "content").when(~F.col("is_html"), "html")
    place = F.concat(F.lit("行"), F.col("_line").cast("string"), F.lit(": "))
    listed = F.concat(F.lit("['"), F.array_join("_lacks", "', '"), F.lit("']"))
    words = F.when(reason == "json", F.lit("JSON 解析失败")).when(reason == "content", F.lit("缺少 messages[-1].content"))
    words = words.when(reason == "html", F.concat(F.lit("HTML 缺少 "), listed, F.lit(" (长度="), F.length("html").cast("string"), F.lit(")")))
    return out.withColumns({"reason": reason, "sample": F.concat(place, words)}).drop("_r", "_lacks")


def quality_counts(lines: DataFrame, by: list) -> DataFrame:
    """For each group the lines, those that are JSON and pages, and the pages' least, greatest and mean length."""
    n = F.length("html")
    return lines.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("is_json").alias("valid_json"), F.count_if("is_html").alias("valid_html"),
        F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.floor(F.sum(n) / F.count(n)).alias("mean"),
    )


def first_samples(lines: DataFrame, by: list[str], order: Column | str, k: int = 3) -> DataFrame:
    """The first k bad lines of each group, with rank. Every task keeps k of a group before any row is sent on."""
    bad = lines.filter(F.col("reason").isNotNull())
    ranked = bad.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))
    return ranked.filter(F.col("rank") <= k).select(*by, "rank", "sample")
