"""Rules kept as relations: ordered matches, lookups, and what serving does with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col, strip

#: A rule table of more rows is refused: rules become part of the plan, so that patterns are compiled once.
MOST_RULES = 2000


def rule_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """priority and the named columns; the first row counts first."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "priority int, " + ", ".join(f"{n} string" for n in names))


def first_rule(rules: DataFrame, matches: Callable[[dict[str, Column]], Column], take: str, most: int = MOST_RULES) -> Column:
    """``take`` of the first rule by priority that matches, or null; ``rules`` is fetched after its size is checked."""
    rows = rules.orderBy("priority").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    out = F.lit(None).cast(dict(rules.dtypes)[take])
    for r in reversed(rows):
        own = {c: F.lit(r[c]) for c in rules.columns}
        out = F.when(matches(own), own[take]).otherwise(out)
    return out


def lookup(df: DataFrame, key: str, table: DataFrame, to: str, name: str, default) -> DataFrame:
    """Adds ``name``: what ``table`` (columns key and to, a row for each key) has for df's key, else the default."""
    own = table.select(F.col(key).alias("_k"), F.col(to).alias("_v"))
    return df.join(own, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_v", col(default) if isinstance(default, Column) else F.lit(default))).drop("_k", "_v")


def serve_template(df: DataFrame, instruction: str, rules: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds template and origin: the page of the first rule (word, target) whose word is in the instruction and whose target is a seed.

    The word may stand as it is or in lower case. Else the page of the seed that is the instruction; else null, and the
    model is asked. seeds: instruction, html, place; of seeds of one instruction the last place counts.
    """
    own = seeds.groupBy(F.col("instruction").alias("_seed")).agg(F.max_by("html", "place").alias("template"))
    live = rules.join(own.select(F.col("_seed").alias("target")), "target", "left_semi")
    text = F.col(instruction)
    target = first_rule(live, lambda r: F.contains(F.lower(text), r["word"]) | F.contains(text, r["word"]), "target")
    keyed = df.withColumn("_key", F.coalesce(target, text))
    found = keyed.join(own, F.col("_key") == F.col("_seed"), "left")
    return found.withColumn("origin", F.when(F.col("_seed").isNotNull(), "golden_template").otherwise("model")).drop("_key", "_seed")


def serve_enhanced(instruction, rules: DataFrame, generic: str, long: int = 25, short: int = 15) -> Column:
    """The instruction, stripped, with the suffix of the first rule (pattern, suffix) that matches.

    A rule whose suffix's first five characters are there already is passed over for a later one. A text of more than
    ``long`` characters stays as it is; one of fewer than ``short`` that no rule takes gets the generic suffix.
    """
    text = strip(instruction)
    suffix = first_rule(rules, lambda r: F.rlike(text, r["pattern"]) & ~F.contains(text, F.substring(r["suffix"], 1, 5)), "suffix")
    rest = F.when(F.length(text) < short, F.lit(generic)).otherwise(F.lit(""))
    return F.when(F.length(text) > long, text).otherwise(F.concat(text, F.coalesce(suffix, rest)))


