"""Generation planning and serving rules: work lists, resume, shards, variants, ordered lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, has, strip

# Marks of an exhausted account.
BALANCE_MARKS = ["insufficient balance", "insufficient_quota", "insufficient funds", "payment required", "balance not enough", "余额不足", " 402", "(402", "status 402", "status_code=402"]
#: What is cut off around a variant.
QUOTES = "“”\"' "


def work_list(items: DataFrame, item_key: str, variants: list[str]) -> DataFrame:
    """Every item with every variant, keyed item_variant; the variants are a literal list, so this is an explode."""
    return items.withColumn("variant", F.explode(F.array(*map(F.lit, variants)))).withColumn("_source_key", F.concat_ws("_", item_key, "variant"))


def evolution_list(items: DataFrame, place: str, evolutions: list[str]) -> DataFrame:
    """Every item as it is, keyed base_<place>, and with every evolution, keyed evol_<place>_<name>; _evol_type names it."""
    kinds = F.explode(F.array(F.lit("base"), *map(F.lit, evolutions)))
    at = F.col(place).cast("string")
    key = F.when(F.col("_evol_type") == "base", F.concat(F.lit("base_"), at)).otherwise(F.concat_ws("_", F.lit("evol"), at, "_evol_type"))
    return items.withColumn("_evol_type", kinds).withColumn("_source_key", key)


def resume(work: DataFrame, done: DataFrame, key: str = "_source_key") -> DataFrame:
    """The work that is not done."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def shard(work: DataFrame, order: str, shards: int, index: int) -> DataFrame:
    """Every shards-th row in order, from index on, numbered after what was done is left out. Null orders come last.

    Numbers without one task for all rows: ranks within ranges of the order, each lifted by the rows of the ranges before
    it. One job finds the ranges' ends, a value for each of spark.sql.shuffle.partitions.
    """
    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(work.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)))
    slot = F.when(F.col(order).isNull(), len(cuts) + 1).otherwise(sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    work = work.withColumn("_slot", slot)
    before = F.sum("_own").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    # As many rows as ranges.
    starts = work.groupBy(F.col("_slot").alias("_at")).agg(F.count("*").alias("_own")).select("_at", F.coalesce(before, F.lit(0)).alias("_start"))
    ranked = work.withColumn("_r", F.row_number().over(Window.partitionBy("_slot").orderBy(order)) - 1).join(F.broadcast(starts), F.col("_slot") == F.col("_at"))
    return ranked.filter((F.col("_r") + F.col("_start")) % shards == index).drop("_slot", "_at", "_own", "_r", "_start")


def progress(df: DataFrame, ok: Column, seconds: Column, total: int, groups: tuple = ()) -> DataFrame:
    """done, failed, rate (rows a second) and eta_s, the seconds that what is left of ``total`` takes at that rate; 0 where none is known.

    ``seconds`` is the time that all rows of a group took, an aggregate.
    """
    out = df.groupBy(*groups).agg(F.count_if(ok).alias("done"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"), seconds.alias("_s"))
    n = F.col("done") + F.col("failed")
    out = out.withColumn("rate", F.when(F.col("_s") > 0, n / F.col("_s")).otherwise(F.lit(0.0)))
    return out.withColumn("eta_s", F.when(F.col("rate") > 0, F.greatest(F.lit(total) - n, F.lit(0)) / F.col("rate")).otherwise(F.lit(0.0))).drop("_s")


def clean_variants(answer, most: int = 10) -> Column:
    """The distinct usable lines of an answer, without numbering, bullets and quotes, at most ``most``."""
    lines = F.transform(F.split(col(answer), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    bare = F.transform(lines, lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"^\d+[.)、]\s*", ""), r"^[-•]\s*", ""), F.lit(QUOTES)))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: F.length(x) >= 2)), 1, most)


def clean_evolved(answer, least: int = 5) -> Column:
    """A rewritten instruction without quotes; null if too short."""
    s = F.regexp_replace(strip(answer), "^[\"'「」]+|[\"'「」]+$", "")
    return F.when(F.length(s) >= least, s)


def render(template: str, **values) -> Column:
    """The template with {name} replaced, in one pass: what a value holds is not filled in again."""
    parts = re.split("(" + "|".join(re.escape("{" + k + "}") for k in values) + ")", template) if values else [template]
    return F.concat(*(F.coalesce(col(values[p[1:-1]]), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def error_class(message) -> Column:
    low = F.lower(col(message))
    return F.when(has(low, *BALANCE_MARKS), "balance").when(has(low, "429", "rate limit"), "rate_limit").otherwise("other")


def latency_summary(df: DataFrame, ok: Column, limited: Column, seconds, groups: tuple = (), calls: int = 15) -> DataFrame:
    """Counts, extremes, mean and a recommended number of parallel calls of each test of ``calls`` calls.

    All if every call succeeded and none was limited, 10 from 12 successes on, else 5.
    """
    out = df.groupBy(*groups).agg(
        F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count_if(limited).alias("limited"),
        F.avg(F.when(ok, col(seconds))).alias("avg_s"), F.min(F.when(ok, col(seconds))).alias("min_s"), F.max(F.when(ok, col(seconds))).alias("max_s"),
    )
    return out.withColumn("advice", F.when((F.col("ok") == calls) & (F.col("limited") == 0), calls).when(F.col("ok") >= 12, 10).otherwise(5).cast("long"))


def lookup_template(instruction, templates: list[tuple[str, str]], existing: set[str]) -> Column:
    """The target of the first keyword in the text, as it is or in lower case, whose target exists; then the text itself, if it exists; else null."""
    out = None
    for word, target in templates:
        if target in existing:
            hit = has(instruction, word) | has(F.lower(col(instruction)), word)
            out = F.when(hit, target) if out is None else out.when(hit, target)
    exact = F.when(col(instruction).isin(sorted(existing)), col(instruction))
    return exact if out is None else F.coalesce(out, exact)


def enhance(instruction, rules: list[tuple[str, str]], generic: str, long: int = 25, short: int = 15) -> Column:
    """A short instruction, stripped, with the suffix of the first rule that matches and whose suffix is not yet there."""
    text = strip(instruction)
    out = F.when(F.length(text) > long, text)
    for pattern, suffix in rules:
        out = out.when(text.rlike(pattern) & ~F.contains(text, F.lit(suffix[:5])), F.concat(text, F.lit(suffix)))
    return out.when(F.length(text) < short, F.concat(text, F.lit(generic))).otherwise(text)
