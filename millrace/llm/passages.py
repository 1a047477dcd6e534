"""Substring dedup by paragraph MinHash banding.

Paragraphs are lines, whole. All of them with a shingle of five words get BANDS bands of ROWS minhashes: two at Jaccard 0.8
share a band with probability 0.98. Distinct paragraphs that collide are joined with their shingles, verified by exact
Jaccard and linked as a spanning forest; links give classes by connected components. Besides, to find passages however
they are wrapped, the text is cut, whatever its lines, where the hash of a word pair is least among its neighbours, in
pieces of some 9 words, and equal pieces meet by hash. Words count without case and punctuation; a paragraph or piece is
known by 96 bits of hash, a line among its near ones by 64 of these.

A paragraph or piece is repeated if two documents hold one of its class where the repeated ones that follow each other
come to at least RUN_WORDS words. Of each class of lines the occurrence in the smallest (doc_id, start) stays;
the others are removals. Pieces that a removed line takes in or overlaps go with it or stay with what is left, and have
no row; of the rest, the first of each class stays. A piece within a line that stays has a row only if it is removed.

No line is left out because its band is full: such bands are dealt to several tasks (``near.exact_components``).

Edge cases: null or empty text has no paragraphs; lines under five words are compared only within pieces, which join them
to their neighbours; a long line is one paragraph whatever its length; rows repeated with the same id and text count as one
document; null ids are documents of their own by text and come first in order; of equal candidates to stay the first in
(id, start, key) does; an empty table gives no rows; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, materialize, release, ship
from .near import SHINGLE, exact_components, filter_of, firsts, grouped, mix, names_of, passing, set_column, shingles_of, through, words_of

REACH = 4
PIECE, LINE = 0, 1
BANDS, ROWS = 4, 2
BAND_NAMES = [f"band{i}" for i in range(BANDS)]
RUN_WORDS = 20
#: Rows of one class that go to one task in the join with classes, on average.
DEALT = 1000


def _pieces(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The first words of the pieces, which content alone cuts, within the texts ``of`` which the words are."""
    if not len(h):
        return np.zeros(0, np.int64)
    first = np.zeros(len(h), bool)
    first[firsts(of)] = True
    g = mix(np.where(first, np.uint64(0), np.roll(h, 1)) * np.uint64(3) + h)
    # Texts lie REACH apart, so that no word is measured against those of another text.
    at = np.arange(len(h)) + np.cumsum(first) * REACH
    apart = np.full(at[-1] + 1 + REACH, 2**64 - 1, np.uint64)
    apart[at] = g
    left, right = apart[at - 1], apart[at + 1]
    for i in range(2, REACH + 1):
        left, right = np.minimum(left, apart[at - i]), np.minimum(right, apart[at + i])
    return np.flatnonzero(first | (g < left) & (g <= right))


def paragraphs(text: str | None):
    """(start, end, number of words, hashes of words, first word) of each piece of a text; together they cover it."""
    of, starts, ends, h, _ = words_of([text])
    at = _pieces(h, of)
    n = np.diff(np.append(at, len(h)))
    return starts[at], ends[at + n - 1], n, h, at


def _levels(of: np.ndarray, h: np.ndarray, line: np.ndarray):
    """(level, first words, numbers of words) of what is compared: LINE for whole lines, PIECE."""
    for level, at in ((LINE, firsts(line)), (PIECE, _pieces(h, of))):
        n = np.diff(np.append(at, len(h)))
        own = n >= (SHINGLE if level == LINE else 1)
        yield level, at[own], n[own]


def _bands(s: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The band keys of the lines at ``at`` of ``n`` >= SHINGLE words, s being the shingles of all words."""
    if not len(at):
        return np.zeros((0, BANDS), np.int64)
    s = np.append(s, np.uint64(0))
    cuts = np.minimum(np.stack([at, at + n - SHINGLE + 1], 1).ravel(), len(s) - 1)
    keys = np.zeros((len(at), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at), b + 1, np.uint64)
        for r in range(ROWS):
            salt = np.uint64((0xA0761D6478BD642F * (b * ROWS + r + 1)) % 2**64)
            key = mix(key ^ np.minimum.reduceat(mix(s ^ salt), cuts)[::2])
        keys[:, b] = key
    return keys.view(np.int64)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(doc_id, text).alias("key"), F.col(doc_id).alias("id"), F.col(text).alias("text"))


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key (of the document), id, h and g (the name), at, of and, for lines, the bands of all that is compared.

    at is start and end, of is first word and twice the number of words plus the level, each 32 bits of a long.
    """
    kind = dict(docs.dtypes)[doc_id]
    names = ["key", "id", "h", "g", "at", "of", *BAND_NAMES]

    def run(batches):
        for batch, texts in grouped(batches, 2):
            of, start, end, h, line = words_of(texts)
            first = firsts(of)
            number = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
            shingles = shingles_of(h)
            for level, at, n in _levels(of, h, line):
                name, more = names_of(h, at, n, level)
                rows = pa.array(of[at])
                places = pa.array(start[at] << 32 | end[at + n - 1]), pa.array(number[at] << 32 | n << 1 | level)
                bands = list(map(pa.array, _bands(shingles, at, n).T)) if level == LINE else [pa.nulls(len(at), pa.int64())] * BANDS
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(name), pa.array(more), *places, *bands], names)
        release()

    return ship(_keyed(docs, doc_id, text)).mapInArrow(run, f"key long, id {kind}, h long, g int, at long, of long, " + ", ".join(f"{b} long" for b in BAND_NAMES))


def _sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """node and set (distinct shingles) of the lines whose h is a ``wanted`` node."""
    sieve = docs.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def run(batches):
        for _, texts in grouped(batches, 0):
            of, _, _, h, line = words_of(texts)
            level, at, n = next(_levels(of, h, line))
            name, _ = names_of(h, at, n, level)
            own, shingles = through(sieve, name), shingles_of(h)
            sets = [np.unique(shingles[a : a + k - SHINGLE + 1]) for a, k in zip(at[own].tolist(), n[own].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(name[own]), set_column(sets)], ["node", "set"])
        release()

    found = ship(docs.select(text)).mapInArrow(run, "node long, set array<long>")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def classes(parts: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """h, g, component: the names of lines that are near-equal to others, and their class; parts is the written table of ``units``."""
    # Each distinct line once: copies of a line, however many, are one row of its bands.
    lines = parts.filter(F.col(BAND_NAMES[0]).isNotNull()).groupBy("h", "g").agg(*(F.first(b).alias(b) for b in BAND_NAMES))
    lines = materialize(lines, "distinct-lines")
    # Bands are counted first; only those of several lines are joined back. Of bands that hold the same lines, one will do.
    each = lines.select("h", F.explode(F.array(*BAND_NAMES)).alias("band"))
    groups = each.groupBy("band").agg(F.count("*").alias("size"), F.min("h").alias("first"), F.bit_xor(F.xxhash64("h")).alias("all"), F.max("h").alias("last")).filter("size > 1")
    groups = materialize(groups.groupBy("size", "first", "last", "all").agg(F.min("band").alias("band")).select("band", "size", "first"), "groups")
    held = _of_bands(lines, groups)
    members = materialize(held.join(groups, "band"), "members")
    discard(lines, groups)
    sets = materialize(_sets(docs, members.select("node").distinct(), text), "sets")
    names = members.select("node", "g").distinct()
    found = materialize(exact_components(members, sets).join(names, "node").select(F.col("node").alias("h"), "g", "component"), "classes")
    discard(members, sets)
    return found


def _of_bands(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """node, g, band of the lines' bands that may be in ``groups``; what is not is left out by a filter of fixed size."""
    sieve = lines.sparkSession.sparkContext.broadcast(filter_of(groups.select("band")))

    def run(batches):
        for batch in batches:
            own = pa.array(passing(sieve, np.asarray(batch.column(2))))
            yield pa.RecordBatch.from_arrays([c.take(own) for c in batch.columns], ["node", "g", "band"])

    return ship(lines).select("h", "g", F.explode(F.array(*BAND_NAMES)).alias("band")).mapInArrow(run, "node long, g int, band long")


def _dealt_join(rows: DataFrame, per_class: DataFrame) -> DataFrame:
    """rows with the columns of their class; a class of many rows (column rows) is dealt to as many tasks as these need."""
    shares = F.floor(F.col("rows") / DEALT)
    per_share = per_class.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares))).drop("rows")
    own = F.pmod(F.xxhash64("key", "at"), shares + 1)
    return rows.withColumn("share", own).drop("rows").join(per_share, ["class_id", "class_g", "share"]).drop("share")


def _with_first(rows: DataFrame) -> DataFrame:
    """rows of the classes that two documents hold, with n_docs and removed; the first row not ``cut`` of a class stays."""
    # One row for each class and document first, so that a passage of many documents is summed up where it is read.
    may_stay = F.when(~F.col("cut"), F.col("at"))
    per_doc = rows.groupBy("class_id", "class_g", "key", "id").agg(F.min(may_stay).alias("at"), F.max("rows").alias("rows"))
    first = F.min(F.when(F.col("at").isNotNull(), F.struct("id", "at", "key"))).alias("first")
    per_class = per_doc.groupBy("class_id", "class_g").agg(F.count("*").alias("n_docs"), first, F.max("rows").alias("rows")).filter("n_docs > 1 and first is not null")
    stays = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.at") == F.col("at")) & (F.col("first.key") == F.col("key"))
    return _dealt_join(rows, per_class).withColumn("removed", ~stays).drop("first")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, id, start, end, n, class_id, n_docs and removed of every repeated paragraph."""
    parts = materialize(units(docs, doc_id, text), "paragraphs")
    near = classes(parts, docs, text)
    # Two documents must hold a paragraph or one linked to it: a narrow aggregate finds these, and only their rows go on.
    spread = parts.groupBy("h", "g").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("rows"))
    spread = spread.join(near, ["h", "g"], "left").filter("lo <> hi or component is not null")
    own_g = F.when(F.col("component").isNull(), F.col("g")).otherwise(0)
    spread = materialize(spread.select("h", "g", "lo", "hi", "rows", F.coalesce("component", "h").alias("class_id"), own_g.alias("class_g")), "spread")
    of_class = spread.groupBy("class_id", "class_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows")).filter("lo <> hi")
    labelled = spread.select("h", "g", "class_id", "class_g").join(of_class.select("class_id", "class_g", "rows"), ["class_id", "class_g"])
    labelled = materialize(labelled, "repeated")
    discard(near, spread)
    held = parts.drop(*BAND_NAMES).join(labelled, ["h", "g"])
    size = F.col("of").bitwiseAND(F.lit(2**32 - 1))
    columns = F.shiftrightunsigned("of", 32).alias("word"), F.shiftrightunsigned(size, 1).alias("n"), size.bitwiseAND(F.lit(1)).cast("int").alias("level")
    held = held.select("key", "id", "at", "class_id", "class_g", "rows", *columns)
    # Runs of what follows each other in a document; a row that is there twice (of repeated rows of the table) counts once.
    in_doc = Window.partitionBy("key", "id").orderBy("word", F.desc("n"), F.desc("level"))
    before, last = in_doc.rowsBetween(Window.unboundedPreceding, -1), F.col("word") + F.col("n")
    again = (F.lag("at").over(in_doc) == F.col("at")) & (F.lag("level").over(in_doc) == F.col("level"))
    held = held.withColumn("_again", F.coalesce(again, F.lit(False))).filter("not _again")
    held = held.withColumn("_run", F.when(F.col("word") <= F.max(last).over(before), 0).otherwise(1))
    held = held.withColumn("_run", F.sum("_run").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    of_run = Window.partitionBy("key", "id", "_run")
    held = held.withColumn("_long", F.max(last).over(of_run) - F.min("word").over(of_run) >= RUN_WORDS).filter("_long")
    held = materialize(held.drop("_again", "_run", "_long"), "occurrences")
    discard(parts, labelled)
    lines = _with_first(held.filter(F.col("level") == LINE).withColumn("cut", F.lit(False)))
    lines = materialize(lines.drop("cut"), "lines")
    # Pieces within a removed line go with it; those that overlap one may go, but do not stay for others.
    off = F.when((F.col("level") == LINE) & F.col("removed"), last)
    on = F.when((F.col("level") == LINE) & ~F.col("removed"), last)
    after = Window.partitionBy("key", "id").orderBy(F.desc("word"), "n", "level").rowsBetween(Window.unboundedPreceding, -1)
    pieces = held.filter(F.col("level") == PIECE).unionByName(lines.select("key", "id", "at", "class_id", "class_g", "word", "n", "level", "removed"), allowMissingColumns=True)
    off_word = F.when(off.isNotNull(), F.col("word"))
    pieces = pieces.withColumns({"_off": F.max(off).over(before), "_on": F.max(on).over(before)}).withColumn("_next", F.min(off_word).over(after))
    pieces = pieces.filter((F.col("level") == PIECE) & ~F.coalesce(F.col("_off") >= last, F.lit(False)))
    pieces = pieces.withColumn("cut", F.coalesce(F.col("_off") > F.col("word"), F.lit(False)) | F.coalesce(F.col("_next") < last, F.lit(False)))
    pieces = materialize(pieces.withColumn("_inside", F.coalesce(F.col("_on") >= last, F.lit(False))).drop("_off", "_on", "_next", "removed"), "pieces")
    pieces = _with_first(pieces).filter("removed or not _inside")
    names = ["key", "id", "at", "n", "class_id", "n_docs", "removed"]
    out = lines.select(*names).unionByName(pieces.select(*names))
    return out.select("key", "id", F.shiftrightunsigned("at", 32).alias("start"), F.col("at").bitwiseAND(F.lit(2**32 - 1)).alias("end"), "n", "class_id", "n_docs", "removed")


def without(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removals of ``found`` cut out of their texts; texts without any stay as they are."""
    cuts = found.filter("removed").groupBy(F.col("key").alias("_millrace_key"), F.col("id").alias("_millrace_id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_millrace_cuts"))
    names = docs.columns

    def run(batches):
        at = names.index(text)
        for batch, texts in grouped(batches, at):
            out = []
            for t, cut in zip(texts, batch.column(len(names)).to_pylist()):
                if cut:
                    parts, last = [], 0
                    for c in cut:
                        parts.append(t[last : c["start"]].rstrip(" ") if last or c["start"] else "")
                        last = max(last, c["end"])
                    t = " ".join(p.strip(" ") for p in [*parts, t[last:]] if p.strip(" "))
                    t = re.sub(r"[ \t]*\n[ \t\n]*", "\n", t).strip("\n")
                out.append(t)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)
        release()

    keyed = docs.withColumn("_millrace_key", F.xxhash64(doc_id, text)).alias("d")
    own = (F.col("d._millrace_key") == F.col("c._millrace_key")) & F.col(f"d.`{doc_id}`").eqNullSafe(F.col("c._millrace_id"))
    keyed = keyed.join(cuts.alias("c"), own, "left").select(*(f"d.`{c}`" for c in names), "_millrace_cuts")
    return ship(keyed).mapInArrow(run, docs.schema)


def op10_passages(spark, sf_dir: str) -> DataFrame:
    """One row for each repeated paragraph."""
    found = repeated(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.col("start"), F.col("end"), F.col("n").alias("n_words"), "class_id", "n_docs", "removed")
