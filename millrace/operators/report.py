"""Distributions, exact order statistics and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col


RANGES = 64


def score_buckets(df: DataFrame, score) -> DataFrame:
    low = F.floor(col(score) / 10) * 10
    return df.groupBy(F.concat_ws("-", low, low + 9).alias("bucket")).agg(F.count("*").alias("n"))


def top_issues(df: DataFrame, issues: str, order: str, n: int = 15) -> DataFrame:
    """The most frequent issues, ties by first appearance."""
    rows = df.select(F.col(order).alias("_o"), F.posexplode(issues).alias("_p", "issue"))
    counted = rows.groupBy("issue").agg(F.count("*").alias("n"), F.min(F.struct("_o", "_p")).alias("_f"))
    return counted.orderBy(F.desc("n"), "_f").limit(n).select("issue", "n")


def order_statistics(df: DataFrame, value, quantiles: dict[str, float]) -> DataFrame:
    """name, value: the element at index int(n*q) of the sorted values.

    Counts of each value are summed within ranges of values, RANGES at most, which the ranges before lift: no task sees
    more than one range's distinct values.
    """
    counts = df.filter(col(value).isNotNull()).groupBy(col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = sorted(set(counts.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []))
    ranged = counts.withColumn("s", sum((F.when(F.col("v") > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    sizes = ranged.groupBy(F.col("s").alias("t")).agg(F.sum("c").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # RANGES rows.
    sizes = sizes.withColumns({"before": before, "n": F.sum("own").over(Window.partitionBy(F.lit(0)))})
    upto = F.sum("c").over(Window.partitionBy("s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.withColumn("hi", upto).join(F.broadcast(sizes), F.col("s") == F.col("t")).withColumn("hi", F.col("hi") + F.col("before"))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(q).alias("q")) for k, q in quantiles.items())))
    at = F.floor(F.col("n") * F.col("w.q"))
    return ranked.select("v", "c", "hi", "n", wanted.alias("w")).filter((at < F.col("hi")) & (at >= F.col("hi") - F.col("c"))).select("w.name", F.col("v").alias("value"))


def histogram(df: DataFrame, value, edges: list[float]) -> DataFrame:
    """bin, n, percent: bins closed on the right, and one above the last edge; empty bins are left out."""
    out = F.when(col(value) <= edges[0], 0)
    for i, e in enumerate(edges[1:], 1):
        out = out.when(col(value) <= e, i)
    counts = df.filter(col(value).isNotNull()).groupBy(out.otherwise(len(edges)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def collapse(df: DataFrame, code_key, instruction) -> DataFrame:
    """codes, multi, heavy and the verdict on how many instructions share one code."""
    users = df.groupBy(col(code_key).alias("k")).agg(F.count_distinct(col(instruction)).alias("u"))
    out = users.agg(F.count("*").alias("codes"), F.count_if(F.col("u") >= 2).alias("multi"), F.count_if(F.col("u") >= 3).alias("heavy"))
    share = lambda c: F.col(c) / F.greatest(F.col("codes"), F.lit(1))
    return out.withColumn("verdict", F.when(share("heavy") > 0.05, "fail").when(share("multi") > 0.10, "mild").otherwise("pass"))


def wins(delta: Column) -> list[Column]:
    return [F.count_if(delta > 0).alias("wins"), F.count_if(delta == 0).alias("ties"), F.count_if(delta < 0).alias("losses")]


def best_point(df: DataFrame, step, loss, groups: list[str]) -> DataFrame:
    """The first least loss of each group, with first, last and least values."""
    own = df.filter(col(loss).isNotNull())
    return own.groupBy(*groups).agg(
        F.min_by(col(step), F.struct(col(loss), col(step))).alias("best_step"), F.min(col(loss)).alias("best_loss"),
        F.min_by(col(loss), col(step)).alias("first_loss"), F.max_by(col(loss), col(step)).alias("last_loss"),
    )


def best_of_n(df: DataFrame, group: str, attempt: str, score: str, mode: str, stop: int | None, floor: int, fallback_wins_ties: bool = False) -> DataFrame:
    """The chosen candidate of each group (null is a group), in one aggregate.

    Drawn candidates count up to the first that reaches ``stop``; the best of them, the earliest of equals, is taken. As
    all before it are below ``stop``, that first one is the best if there is one. If the best is below ``floor``, or there
    is none, the row of mode ``greedy`` replaces it if its score is higher (or equal, if it wins ties). Rows without a
    score do not count.
    """
    greedy, has_score = F.coalesce(F.col(mode) == "greedy", F.lit(False)), F.col(score).isNotNull()
    row = F.struct(F.col(score).alias("s"), (-F.col(attempt)).alias("a"))
    first = F.struct((-F.col(attempt)).alias("a"), F.col(score).alias("s"))
    over = ~greedy & ((F.col(score) >= stop) if stop is not None else F.lit(False))
    found = df.filter(has_score).groupBy(group).agg(F.max(F.when(~greedy, row)).alias("_drawn"), F.max(F.when(over, first)).alias("_stop"), F.max(F.when(greedy, row)).alias("_greedy"))
    found = found.withColumn("_best", F.when(F.col("_stop").isNotNull(), F.struct(F.col("_stop.s").alias("s"), F.col("_stop.a").alias("a"))).otherwise(F.col("_drawn")))
    better = F.col("_greedy.s") >= F.col("_best.s") if fallback_wins_ties else F.col("_greedy.s") > F.col("_best.s")
    fall = F.coalesce((F.col("_best.s") < floor) & better, F.col("_best").isNull() & F.col("_greedy").isNotNull(), F.lit(False))
    return found.select(group, F.when(fall, F.col("_greedy.s")).otherwise(F.col("_best.s")).alias("score"), F.when(fall, -F.col("_greedy.a")).otherwise(-F.col("_best.a")).alias("attempt"), fall.alias("fallback"))


def best_in_array(attempts, stop: int | None, floor: int, fallback_wins_ties: bool = False) -> Column:
    """As ``best_of_n``, over an array of structs (attempt, score, mode) in one row, without exploding it: a fold.

    The fold carries the best drawn attempt so far, whether one has reached ``stop``, and the best greedy one; what comes
    after the stop is passed over. A struct (score, attempt, fallback), null where nothing has a score.
    """
    kind = "struct<best: struct<s: long, a: long>, done: boolean, greedy: struct<s: long, a: long>>"
    rows = F.array_sort(F.filter(col(attempts), lambda x: x["score"].isNotNull()), lambda x, y: F.when(x["attempt"] < y["attempt"], -1).when(x["attempt"] > y["attempt"], 1).when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(0))
    own = lambda x: F.struct(x["score"].cast("long").alias("s"), x["attempt"].cast("long").alias("a"))
    higher = lambda x, than: than.isNull() | (x["score"] > than["s"])
    drawn = lambda x: ~F.coalesce(x["mode"] == "greedy", F.lit(False))
    reaches = lambda x: x["score"] >= stop if stop is not None else F.lit(False)

    def step(acc, x):
        counts = drawn(x) & ~acc["done"]
        return F.struct(
            F.when(counts & higher(x, acc["best"]), own(x)).otherwise(acc["best"]).alias("best"),
            (acc["done"] | (counts & reaches(x))).alias("done"),
            F.when(~drawn(x) & higher(x, acc["greedy"]), own(x)).otherwise(acc["greedy"]).alias("greedy"),
        )

    def finish(acc):
        better = acc["greedy"]["s"] >= acc["best"]["s"] if fallback_wins_ties else acc["greedy"]["s"] > acc["best"]["s"]
        fall = F.coalesce((acc["best"]["s"] < floor) & better, acc["best"].isNull() & acc["greedy"].isNotNull(), F.lit(False))
        chosen = F.when(fall, acc["greedy"]).otherwise(acc["best"])
        return F.when(chosen.isNotNull(), F.struct(chosen["s"].alias("score"), chosen["a"].alias("attempt"), fall.alias("fallback")))

    return F.aggregate(rows, F.struct(F.lit(None).alias("best"), F.lit(False).alias("done"), F.lit(None).alias("greedy")).cast(kind), step, finish)


def complete_only(df: DataFrame, item: str, version: str, versions: list) -> DataFrame:
    """The rows of items that have every one of the versions (a relational division); rows of other versions go."""
    own = df.filter(F.col(version).isin(versions))
    whole = own.groupBy(F.col(item).alias("_item")).agg(F.count_distinct(version).alias("_k")).filter(F.col("_k") == len(set(versions)))
    return own.join(whole, F.col(item) == F.col("_item"), "left_semi")


def paired(expected: DataFrame, one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """key, one, two, one_missing, two_missing, expected, delta: a full outer pairing; a missing side counts as 0.

    ``expected`` has the keys that must come out even if neither side has them; keys of one side alone come out too.
    Sides have a row for each key at most. A key that is null pairs with null.
    """
    side = lambda df, tag: df.select(F.col(key).alias(f"_k{tag}"), F.col(value).alias(f"_v{tag}"), F.lit(True).alias(f"_has{tag}"))
    a, b, e = side(one, 1), side(two, 2), expected.select(F.col(key).alias("_k0"), F.lit(True).alias("_has0")).distinct()
    both = a.join(b, a["_k1"].eqNullSafe(b["_k2"]), "full_outer").withColumn("_k", F.when(F.col("_has1"), F.col("_k1")).otherwise(F.col("_k2")))
    every = both.join(e, both["_k"].eqNullSafe(e["_k0"]) & (F.col("_has1") | F.col("_has2")), "full_outer")
    fill = lambda c: F.coalesce(c, F.lit(0))
    lacks = lambda c: ~F.coalesce(c, F.lit(False))
    return every.select(
        F.when(F.col("_has1") | F.col("_has2"), F.col("_k")).otherwise(F.col("_k0")).alias(key), fill(F.col("_v1")).alias("one"), fill(F.col("_v2")).alias("two"),
        lacks(F.col("_has1")).alias("one_missing"), lacks(F.col("_has2")).alias("two_missing"), F.coalesce("_has0", F.lit(False)).alias("expected"), (fill(F.col("_v2")) - fill(F.col("_v1"))).alias("delta"),
    )


# The labels of the ten-point scorer's dimensions in reports.
DIMENSION_LABELS = {
    "complete": "HTML完整",
    "no_fence": "无MD包裹",
    "viewport": "Viewport",
    "style": "风格匹配",
    "script": "JS功能",
    "no_cdn": "无外部CDN",
    "length_ok": "长度合理",
    "language": "中文界面",
}
# The greatest score of each dimension of the detailed scorer.
DIMENSION_MOST = {"J_js": 30, "I_instruction": 25, "F_feature": 20, "C_css": 15, "S_structure": 10}


def dimension_label(name) -> Column:
    """A dimension's label, or its name if it has none."""
    labels = F.create_map(*(F.lit(x) for pair in DIMENSION_LABELS.items() for x in pair))
    return F.coalesce(F.element_at(labels, col(name)), col(name))


def radar(df: DataFrame, versions: tuple[str, ...], id: str = "id") -> DataFrame:
    """id, version, scores and shares of the greatest score: a row of the radar matrix, in the order of DIMENSION_MOST.

    The columns of a version are its name, an underscore and the dimension.
    """
    rows = [F.struct(F.lit(v).alias("version"), F.array(*(F.col(f"{v}_{d}").cast("double") for d in DIMENSION_MOST)).alias("scores")) for v in versions]
    out = df.select(id, F.explode(F.array(*rows)).alias("x")).select(id, "x.*")
    most = F.array(*(F.lit(float(m)) for m in DIMENSION_MOST.values()))
    return out.withColumn("shares", F.zip_with("scores", most, lambda s, m: s / m))


def length_summary(df: DataFrame, parts: dict[str, Column], over: tuple[int, ...] = (2000, 3000, 4000, 5000)) -> DataFrame:
    """For each named length one row: rows, shortest, longest, mean (whole), and how many are over each bound."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), v.cast("long").alias("n")) for k, v in parts.items())))
    out = df.select(rows.alias("x")).select("x.*").groupBy("part")
    return out.agg(
        F.count("*").alias("rows"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.floor(F.sum("n") / F.count("n")).alias("mean"),
        *(F.count_if(F.col("n") > k).alias(f"over_{k}") for k in over),
    )


def split_summary(df: DataFrame, code: str, split: str, category: str, level: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """One row: sizes, ratios, groups, categories, levels and leakage of a split, from one pass over the rows.

    sizes, ratios, groups and leaked are maps by split, categories a map of maps, levels a map; total and total_groups are
    counts. A group is the rows of one code; a row leaks if its code is in train and its own split is another. Rows are
    summed to cells of (code, split, category, level) first, and everything else is grouping sets over cells. Null
    categories and levels count as the empty string; an empty table gives a row of empty maps.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = df.groupBy(F.col(code).alias("code"), F.col(split).alias("split"), named(category).alias("category"), named(level).alias("level")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("code")
    cells = cells.withColumns({"_train": F.max(F.when(F.col("split") == splits[0], 1).otherwise(0)).over(own), "_first": F.row_number().over(own.orderBy("split", "category", "level")), "_own": F.row_number().over(Window.partitionBy("code", "split").orderBy("category", "level"))})
    leaks = (F.col("_train") == 1) & (F.col("split") != splits[0])
    sums = cells.groupingSets([["split"], ["split", "category"], ["level"], []], "split", "category", "level").agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n"), F.count_if(F.col("_own") == 1).alias("groups"), F.count_if(F.col("_first") == 1).alias("all_groups"), F.sum(F.when(leaks, F.col("n")).otherwise(0)).alias("leaked"),
    )
    # As many rows as there are splits times categories.
    pairs = lambda g, k, v: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("g") == g, F.struct(F.col(k), F.col(v))))))
    by_split = sums.groupBy(F.when(F.col("g").isin(3, 1), F.col("split")).alias("s"), F.when(~F.col("g").isin(3, 1), F.col("g")).alias("other")).agg(
        *(F.max(F.when(F.col("g") == 3, F.col(c))).alias(c) for c in ("n", "groups", "leaked")), pairs(1, "category", "n").alias("categories"),
        pairs(6, "level", "n").alias("levels"), F.max(F.when(F.col("g") == 7, F.col("n"))).alias("total"), F.max(F.when(F.col("g") == 7, F.col("all_groups"))).alias("total_groups"),
    )
    is_split = F.col("s").isNotNull()
    each = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.when(is_split, F.struct(F.col("s"), v)))))
    out = by_split.agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.coalesce(F.max("total_groups"), F.lit(0)).alias("total_groups"), each(F.col("n")).alias("sizes"), each(F.col("groups")).alias("groups"),
        each(F.col("leaked")).alias("leaked"), F.map_from_entries(F.collect_list(F.when(is_split, F.struct(F.col("s"), F.col("categories"))))).alias("categories"),
        F.coalesce(F.max_by("levels", F.when(F.col("other") == 6, 1)), F.create_map().cast("map<string, bigint>")).alias("levels"),
    )
    return out.withColumn("ratios", F.transform_values("sizes", lambda _, n: F.format_string("%.1f%%", n / F.col("total") * 100)))


def bar(mean, most, width: int = 20) -> Column:
    """A bar of as many blocks as the whole part of the share of ``width``."""
    return F.repeat(F.lit("█"), F.floor(col(mean) / most * width).cast("int"))


def comparison_summary(df: DataFrame, versions: tuple[str, str], total: str = "total") -> DataFrame:
    """line, text: the summary of two versions' scores, of which df has a row for each case.

    Columns are a version's name, an underscore and a dimension of DIMENSION_MOST, or ``total``. Lines: how many cases, both
    means, their difference, wins and ties, then for each dimension the two means with bars and the difference.
    """
    one, two = versions
    mean = lambda v, d: F.avg(f"{v}_{d}").alias(f"{v}_{d}")
    delta = F.col(f"{two}_{total}") - F.col(f"{one}_{total}")
    dims = [*DIMENSION_MOST, total]
    s = df.agg(F.count("*").alias("cases"), *(mean(v, d) for v in versions for d in dims), *wins(delta))
    f = F.format_string
    lines = [
        f("cases: %d", F.col("cases")), *(f(f"{v} mean: %.2f/100", F.col(f"{v}_{total}")) for v in versions), f("difference: %+.2f", F.col(f"{two}_{total}") - F.col(f"{one}_{total}")),
        f(f"{two} wins %d, ties %d, {one} wins %d", F.col("wins"), F.col("ties"), F.col("losses")),
    ]
    for d, most in DIMENSION_MOST.items():
        lines += [F.concat(f(f"{d} {v}: %.2f/{most} ", F.col(f"{v}_{d}")), bar(f"{v}_{d}", most)) for v in versions]
        lines.append(f(f"{d} difference: %+.2f", F.col(f"{two}_{d}") - F.col(f"{one}_{d}")))
    return s.select(F.posexplode(F.array(*lines)).alias("line", "text"))
