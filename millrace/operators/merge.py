"""Merging, deduplication and splits. Every choice of a row is by an explicit order, never by arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, normalized


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows by name, with _source and _rank (the source's place)."""
    out = None
    for rank, (tag, df) in enumerate(sources):
        tagged = df.withColumns({"_source": F.lit(tag), "_rank": F.lit(rank)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def _digest(keys: list) -> Column:
    """A short key in place of long ones. Each part is digested by itself, so no part runs into the next; null differs from every string."""
    return F.md5(F.concat(*(F.coalesce(F.md5(col(k).cast("string")), F.lit("-")) for k in keys)))


def first_of_each(df: DataFrame, keys: list, order: list, keep: list[str] | None = None) -> DataFrame:
    """The first row of each key, its columns ``keep`` (all, if None).

    A partial aggregate finds it, so that no hot key gathers its rows in one task; it holds a digest of the key and the
    columns to keep, not the key itself.
    """
    marked = df.withColumns({"_k": _digest(keys), "_o": F.struct(*(col(o) for o in order))})
    first = marked.groupBy("_k").agg(F.min_by(F.struct(*(keep or df.columns)), "_o").alias("_row"))
    return first.select("_row.*")


def kept_of_sources(df: DataFrame, keys: list, source: str = "_source", rank: str = "_rank") -> DataFrame:
    """Each source's rows (n) and how many keys it is the first source of (kept)."""
    counts = df.groupBy(_digest(keys).alias("_k"), F.col(source).alias("s"), F.col(rank).alias("r")).agg(F.count("*").alias("n"))
    # A row for each key, with as many entries as there are sources: texts are read and digested once.
    of_key = counts.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("r", "s", "n"))).alias("c"))
    each = of_key.select(F.posexplode("c").alias("i", "c"))
    return each.groupBy(F.col("c.s").alias(source)).agg(F.sum("c.n").alias("n"), F.count_if(F.col("i") == 0).alias("kept"))


def duplicate_flag(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Adds is_duplicate: whether an earlier row has the key. The order must tell rows apart."""
    marked = df.withColumns({"_k": _digest(keys), "_o": F.struct(*(col(o) for o in order))})
    first = marked.groupBy("_k").agg(F.min("_o").alias("_first"))
    return marked.join(first, "_k").withColumn("is_duplicate", F.col("_o") > F.col("_first")).select(*df.columns, "is_duplicate")


def reject_duplicates(df: DataFrame, keys: list, order: list, issue: str, passed: str = "passed", issues: str = "all_issues") -> DataFrame:
    """Rows of which an earlier one has the key no longer pass, and say why."""
    flagged = duplicate_flag(df, keys, order)
    more = F.when(F.col("is_duplicate"), F.concat(issues, F.array(F.lit(issue)))).otherwise(F.col(issues))
    return flagged.withColumns({issues: more, passed: F.col(passed) & ~F.col("is_duplicate")})


def _seeded(key: str, seed: str) -> Column:
    """A digest of a key and a seed; null counts as empty."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)))


def _ranked(df: DataFrame, digest: Column, key: str, groups: list[str], digits: int = 2) -> DataFrame:
    """Adds _r, the rank by the digest within the groups, and _n, their size. The digest is of every row, never null.

    No task sees a whole group: rows are ranked within slices of the digest's first digits, and the slices before,
    16**digits of a group at most, lift the ranks.
    """
    df = df.withColumn("_h", digest).withColumn("_s", F.substring("_h", 1, digits))
    slices = df.groupBy(*(F.col(g).alias(f"_group{i}") for i, g in enumerate(groups)), F.col("_s").alias("_t")).agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*(f"_group{i}" for i in range(len(groups))))
    before = F.sum("_c").over(own.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.withColumns({"_before": F.coalesce(before, F.lit(0)), "_n": F.sum("_c").over(own)})
    within = df.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_s").orderBy("_h", key)))
    same = within["_s"] == slices["_t"]
    for i, g in enumerate(groups):
        same = same & within[g].eqNullSafe(slices[f"_group{i}"])
    return within.join(slices, same).withColumn("_r", F.col("_r") + F.col("_before")).select(*df.drop("_h", "_s").columns, "_r", "_n")


def permuted(df: DataFrame, key: str, seed: str = "42", position: str = "position") -> DataFrame:
    """Adds the place of each row, from 0 and without gaps, in a seeded permutation: by a digest of the key, then by the key.

    Ranks are taken within 65,536 slices of the digest, each lifted by the rows of the slices before it, so that no task
    numbers all rows. Rows of equal key are neighbours; which of them comes first is open.
    """
    return _ranked(df, _seeded(key, seed), key, [], digits=4).withColumn(position, (F.col("_r") - 1).cast("long")).select(*df.columns, position)


def composite_key(instruction, *parts) -> Column:
    return F.concat_ws("|||", normalized(instruction), *(F.coalesce(col(p), F.lit("")) for p in parts))


def stratified_split(df: DataFrame, key: str, category: str, seed: str = "42", test: float = 0.05, val: float = 0.10, order: str | None = None) -> DataFrame:
    """key, category and split: whole groups, per category in the order of a seeded digest.

    A group's category is that of its first row by ``order``, or the least where no order is given. Rows without a key
    are one group, groups without a category one category.
    """
    first = F.min_by(category, order) if order else F.min(category)
    groups = df.groupBy(key).agg(first.alias(category)) if category != key else df.select(key).distinct()
    groups = _ranked(groups, _seeded(key, seed), key, [category])
    n = F.col("_n")
    n_test = F.when(n >= 3, F.greatest(F.lit(1), F.bround(n * test))).otherwise(0)
    n_val = F.when(n >= 2, F.greatest(F.lit(1), F.bround(n * val))).otherwise(0)
    split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    return groups.select(key, category, split.alias("split"))


def isolated_split(df: DataFrame, category: str, key: str, held_out: list[str], train_only: list[str], seed: str = "42", share: float = 0.8) -> DataFrame:
    """Adds split: held-out categories to val, train-only ones to train, of each other one the first share by a seeded digest."""
    other = ~F.col(category).isin(held_out + train_only) | F.col(category).isNull()
    rest = _ranked(df.filter(other), _seeded(key, seed), key, [category])
    rest = rest.withColumn("split", F.when(F.col("_r") <= F.floor(F.col("_n") * share), "train").otherwise("val"))
    fixed = df.filter(~other).withColumn("split", F.when(F.col(category).isin(held_out), "val").otherwise("train"))
    return fixed.select(*df.columns, "split").unionByName(rest.select(*df.columns, "split"))


def fan_out(seeds: DataFrame, variants: DataFrame, key: str, order: str, instruction: str = "instruction", place: str = "place") -> DataFrame:
    """Every seed with its own instruction, then every variant with its seed's other columns; _part and ``place`` order them."""
    first = seeds.withColumns({"_part": F.lit(0), place: F.lit(0)})
    more = variants.select(key, F.col(instruction).alias("_i"), place).join(seeds, key).withColumns({instruction: F.col("_i"), "_part": F.lit(1)})
    return first.unionByName(more.drop("_i")).select("_part", order, place, *(c for c in seeds.columns if c != order))


def leakage(df: DataFrame, train: DataFrame, key: Column) -> DataFrame:
    """The rows of df whose key occurs in train."""
    return df.withColumn("_key", key).join(train.select(key.alias("_key")).distinct(), "_key", "left_semi").drop("_key")
