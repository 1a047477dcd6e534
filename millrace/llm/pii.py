"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base entities of four kinds are found by patterns and checks; they are the seeds. Besides, loose patterns find strings
that look like identifiers but fail the base patterns. Both have a lexical pattern: the kind and the word to their left.
In each round a pattern is scored by the share of all occurrences of that word, anywhere in the corpus, that are
followed by a known identifier of the kind; patterns that are confident and supported by enough different identifiers
vote for the unknown ones in their place, whose scores combine as independent evidence; those that score high enough
become known, and so may lift further patterns. The graph has a row only where an identifier-like string stands, so it
is small beside the texts; every step is an aggregate with partial sums before its shuffle.

Rounds go on until one discovers nothing: as known identifiers only grow, that is a fixed point.

Edge cases: null text is empty, and has no spans; repeated rows and null ids each give a row; a text without blanks is one
word, however long; words before a string are taken whole; of spans that start alike kinds count in the order of KINDS; an
empty table gives an empty result; other columns of the input, whatever their names, are not looked at. Positions are code
points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize

KINDS = ["email", "ip", "card", "phone"]
SUPPORT = 5
#: Matches of a text that are put together in one fold; the folds of a text with more are then joined.
FOLD = 256
CONFIDENCE = 0.5

# Base patterns. A run is tried where it begins or where the last match ended, and quantifiers are possessive where
# nothing could be given back: the same matches as the plain patterns, in time linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Strings that look like an identifier: an address written out or without a domain's dot; a long number with separators
# or without a plus; a card number's digits whatever their check digit; an IPv4 address with its dots in brackets.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\x20?[\[(](?:dot|\.)[\])]\x20?)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"(?<![0-9+(])[(]?[0-9](?:[().\x20-]{0,2}[0-9])++",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(1) + (i + 1) % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column, loose: bool = False) -> Column:
    n = F.length(_digits(m))
    if kind == "ip" and loose:
        return F.forall(F.split(m, "[^0-9]+"), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(m, "\\."), lambda p: part(p) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), F.lit(True) if loose else _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


SPAN = "array<struct<start:bigint,`end`:bigint,kind:int,value:string,word:string,glued:boolean>>"


def _spans(found: Column, pieces: Column, kind: str, loose: bool = False) -> Column:
    """Spans of the matches ``found``, between which ``pieces`` lie, that pass the kind's check."""
    # A fold copies what it has gathered with each match, so a text's matches are folded FOLD at a time.
    last = F.size(found) - 1
    folds = F.sequence(F.lit(0), F.floor(last / FOLD).cast("int"))
    size = lambda f: F.aggregate(F.slice(F.transform(found, F.length), f * FOLD + 1, F.lit(FOLD)), F.lit(0), lambda a, n: a + n) + F.aggregate(F.slice(F.transform(pieces, F.length), f * FOLD + 1, F.lit(FOLD)), F.lit(0), lambda a, n: a + n)

    def step(acc, i):
        m, before = F.get(found, i), F.get(pieces, i)
        a = acc["at"] + F.length(before)
        b = a + F.length(m)
        parts = F.split(before, r"\s+")
        word = F.lower(F.coalesce(F.when(F.element_at(parts, -1) != "", F.element_at(parts, -1)).otherwise(F.get(parts, F.size(parts) - 2)), F.lit("")))
        glued = before.rlike(r"\S$")
        span = F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"), F.lit(KINDS.index(kind)).alias("kind"), m.alias("value"), word.alias("word"), glued.alias("glued"))
        keep = F.when(_valid(kind, m, loose), F.array(span)).otherwise(F.array().cast(SPAN))
        return F.struct(b.cast("bigint").alias("at"), F.concat(acc["out"], keep).alias("out"))

    def fold(s):
        start = F.struct(s["at"].cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.sequence(s["fold"] * FOLD, F.least(s["fold"] * FOLD + FOLD - 1, last)), start, step, lambda acc: acc["out"])

    none = F.array().cast("array<struct<fold:int,at:int>>")
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    at = F.aggregate(folds, first, lambda acc, f: F.struct((acc["at"] + size(f)).alias("at"), F.concat(acc["out"], F.array(F.struct(f.alias("fold"), acc["at"].alias("at")))).alias("out")), lambda acc: acc["out"])
    return F.flatten(F.transform(at, fold))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doc_id, base and loose: the spans of each text, loose ones apart from base ones."""
    df = docs.select(F.xxhash64(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    digits = F.col("t").rlike("[0-9]")
    need = {"email": F.contains("t", F.lit("@")), "ip": digits, "card": digits, "phone": F.contains("t", F.lit("+"))}
    near = {"email": F.contains("t", F.lit("@")) | F.contains("t", F.lit("at]")) | F.contains("t", F.lit("at)")), "ip": digits & (F.contains("t", F.lit("]")) | F.contains("t", F.lit(")"))), "card": digits, "phone": digits}
    none = F.array().cast("array<string>")
    gates = {f"b_{k}": (p, need[k]) for k, p in BASE.items()} | {f"l_{k}": (p, near[k]) for k, p in LOOSE.items()}
    df = df.select("*", *(F.when(gate, F.regexp_extract_all("t", F.lit(p), 0)).otherwise(none).alias(c) for c, (p, gate) in gates.items()))
    empty = F.array().cast(SPAN)
    out = {c: F.when(F.size(c) > 0, _spans(F.col(c), F.split("t", p, -1), c[2:], c[0] == "l")).otherwise(empty).alias(c) for c, (p, _) in gates.items()}
    df = df.select("key", "doc_id", *out.values())
    base = F.array_sort(F.concat(*(f"b_{k}" for k in BASE)))
    df = df.select("key", "doc_id", base.alias("base"), F.concat(*(f"l_{k}" for k in LOOSE)).alias("loose"))
    # Base spans in lots with their least start and greatest end, so that a loose span is held to the lots near it only.
    lot = lambda i: F.slice("base", i * FOLD + 1, F.lit(FOLD))
    bounds = lambda i: F.struct(F.array_min(F.transform(lot(i), lambda b: b["start"])).alias("lo"), F.array_max(F.transform(lot(i), lambda b: b["end"])).alias("hi"), lot(i).alias("spans"))
    lots = F.when((F.size("base") > 0) & (F.size("loose") > 0), F.transform(F.sequence(F.lit(0), F.floor((F.size("base") - 1) / FOLD).cast("int")), bounds))
    df = df.withColumn("lots", lots)
    meets = lambda c: F.exists("lots", lambda x: (x["lo"] < c["end"]) & (c["start"] < x["hi"]) & F.exists(x["spans"], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    apart = F.when(F.col("lots").isNull(), F.col("loose")).otherwise(F.filter("loose", lambda c: ~meets(c)))
    return df.select("key", "doc_id", "base", apart.alias("loose"))


def _contexts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """word and all: how often each wanted word stands as a left context, before a blank or, if it does so anywhere, before
    a string that follows it without a blank. A word that ends in a letter or digit is such a context only before a number."""
    tokens = docs.select(F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("word"))
    whole = tokens.join(wanted.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("all"))
    glued = wanted.filter("glued").select("word").distinct()
    lengths = [r[0] for r in glued.select(F.length("word").alias("n")).distinct().collect()]  # one row for each length
    if lengths:
        longest = max(lengths) + 1
        heads = tokens.filter(F.length("word") > min(lengths)).groupBy(F.substring("word", 1, longest).alias("token")).agg(F.count("*").alias("all"))
        cut = heads.withColumn("n", F.explode(F.array(*map(F.lit, sorted(lengths))))).filter(F.col("n") < F.length("token"))
        cut = cut.select(F.substring("token", F.lit(1), F.col("n")).alias("word"), F.substring("token", F.col("n") + 1, F.lit(1)).alias("next"), "all")
        cut = cut.filter(~F.col("word").rlike(r"[\p{L}\p{N}]$") | F.col("next").rlike(r"[0-9+(]"))
        whole = whole.unionByName(cut.join(glued, "word", "left_semi").select("word", "all"))
    return whole.groupBy("word").agg(F.sum("all").alias("all"))


def bootstrap(spans: DataFrame, docs: DataFrame, text: str = "text", rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """kind and value of the identifiers that contexts discover; spans is the written table of ``scan``.

    Rounds go on until one discovers nothing, or to the number given.
    """
    occurrences = lambda c: spans.select(F.explode(c).alias("s")).select("s.kind", "s.value", "s.word", "s.glued").filter("word <> ''").groupBy("kind", "value", "word").agg(F.count("*").alias("n"), F.max("glued").alias("glued"))
    loose = materialize(occurrences("loose"), "pii-loose")
    if loose.isEmpty():
        return loose.select("kind", "value")
    # Only words beside an unknown string can discover anything.
    wanted = loose.select("kind", "word").distinct()
    seeds = materialize(occurrences("base").join(wanted, ["kind", "word"], "left_semi"), "pii-seeds")
    sides = seeds.unionByName(loose).groupBy("kind", "word").agg(F.sum("n").alias("least"), F.max("glued").alias("glued"), F.count_distinct("value").alias("values"))
    # A word beside fewer values than a pattern needs never becomes one.
    sides = materialize(sides.filter(F.col("values") >= support).drop("values"), "pii-sides")
    # A context after another identifier is no token's head: what the spans show of it is its floor.
    words = sides.join(_contexts(docs, sides, text), "word", "left").select("kind", "word", F.greatest("least", F.coalesce("all", F.lit(0))).alias("all"))
    words = materialize(words, "pii-words")
    known, size, done = seeds.select("kind", "value").limit(0), 0, 0
    while rounds is None or done < rounds:
        learned = loose.join(known, ["kind", "value"], "left_semi")
        patterns = (
            seeds.unionByName(learned).groupBy("kind", "word").agg(F.sum("n").alias("hits"), F.count_distinct("value").alias("values"))
            .join(words, ["kind", "word"]).withColumn("p", F.least(F.col("hits") / F.col("all"), F.lit(0.999)))
            .filter((F.col("values") >= support) & (F.col("p") >= confidence))
        )
        scored = loose.join(patterns.select("kind", "word", "p"), ["kind", "word"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("score"))
        known = materialize(scored.filter(F.col("score") >= confidence).select("kind", "value").unionByName(known).distinct(), "pii-known")
        last, size, done = size, known.count(), done + 1
        if size == last:
            break
    return known


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """key, doc_id, base and more: the base spans, and those that contexts add."""
    spans = materialize(scan(docs, doc_id, text), "pii-spans")
    known = bootstrap(spans, docs, text, **limits)
    rows = spans.select("key", F.explode("loose").alias("s")).withColumns({"kind": F.col("s.kind"), "value": F.col("s.value")})
    more = rows.join(known, ["kind", "value"], "left_semi").groupBy("key").agg(F.collect_set("s").alias("more"))
    return spans.select("key", "doc_id", "base").join(more, "key", "left").select("key", "doc_id", "base", F.coalesce("more", F.array().cast(SPAN)).alias("more"))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_found, the number of all spans."""
    got = find(documents(spark, sf_dir))
    order = F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    base = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    of = lambda i: F.filter("base", lambda s: s["kind"] == i)
    count = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *count, F.sha2(_text(base), 256).alias("base_sha256"), _text(order).alias("spans"), F.size(order).cast("long").alias("n_found"))
