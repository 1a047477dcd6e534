"""Collocations by depth-limited count tries.

The corpus is cut into shards of about SHARD_BYTES of text. A shard's trie, DEPTH words deep, is built level by level in
arrays: the node of a position at one level and the word that follows give its node at the next, and counts are numbers of
equal nodes. Its nodes are written sorted by their path. Sorted runs are then dealt by ranges of their prefix (language and
first two words, so that a subtree stays whole) and merged there, and nodes below LEAST go.

A walk over the merged trie, parents before children, gives every node the counts of its ancestors (the left parts of a
phrase) and its largest child. A node's suffix link leads to the node of the phrase without its first word: its counts and
those of its own links are the right parts, and the largest node that links to a node is its largest extension to the left.
Counts fall along extensions, so a phrase lies in some longer one of a given share if and only if it does in one that is a
single word longer.

Most paths of a corpus are rare, and writing them would cost more than the corpus. A first pass therefore counts paths of
all lengths by hash, in counters that stop at LEAST; what falls on a counter below LEAST occurs less often than that,
whatever else falls there, and neither it nor a longer path over it is written. There is a counter for about eight bytes of
text, 2**MOST_BITS of them at most. They come to the driver as bits: at most 2**MOST_BITS / 8 bytes, whatever the corpus
holds. They change no result, only how much is written.

Edge cases: null text counts as empty; a text without words adds nothing; null lang is ``und``, together with a language of
that name; repeated rows count each; ties go by count, then by the phrase's bytes; texts are taken whole, however long; an
empty table gives no rows; columns besides text and lang, whatever their names, are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, release, ship

DEPTH = 4
LEAST = 30
TOP = 2000
#: A phrase goes if a longer one has so many hundredths of its count.
SHARE = 80
SCALE = 2_000_000
SHARD_BYTES = 6 << 20
LEAST_BITS, MOST_BITS = 20, 28
BLOCK = 1 << 16
#: Tasks' first lists of a language, before they are merged.
SLICES = 64

# What ends a piece, what ends a word, and case.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if b in _ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = ["w1", "w2", "w3", "w4"]


class Shard:
    """The words of some texts as arrays: for each place the word's number and its language's, or a mark between pieces."""

    def __init__(self, texts: list[tuple[int, bytes]], langs: list[str]):
        # A byte that no UTF-8 text holds marks the ends of pieces, and with a number the beginning of a text.
        joined = b" ".join(b" \xff%d %s \xff" % (lang, t.translate(_TABLE).replace(b"\n", b" \xff ")) for lang, t in texts)
        coded = pa.array(joined.split(), pa.binary()).dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        marks = np.array([w[:1] == b"\xff" for w in self.words], bool)
        begins = np.array([int(w[1:]) if w[:1] == b"\xff" and len(w) > 1 else -1 for w in self.words], np.int64)
        self.is_word = ~marks[self.code] if len(self.code) else np.zeros(0, bool)
        at = begins[self.code] if len(self.code) else np.zeros(0, np.int64)
        last = np.maximum.accumulate(np.where(at >= 0, np.arange(len(at)), 0)) if len(at) else at
        self.lang = at[last] if len(at) else at
        self.langs = langs
        self._hash = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        self._lang_hash = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in langs], np.uint64)

    def paths(self, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth, whether a path of so many words begins at each place, and its counter."""
        size, shift = len(self.code), np.uint64(64 - bits)
        words, out = self._hash[self.code], []
        with np.errstate(over="ignore"):
            h, goes = _mix(words ^ self._lang_hash[self.lang]), self.is_word
            for d in range(DEPTH):
                if d:
                    after = min(d, size)
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([words[d:], np.zeros(after, np.uint64)]))
                    goes = goes & np.concatenate([self.is_word[d:], np.zeros(after, bool)])
                out.append((goes, (h >> shift).astype(np.int64)))
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _shards(batches):
    """Shards of a task's batches (text, lang)."""
    texts, langs, size = [], {}, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for t, lang in zip(part.column(0), part.column(1).to_pylist()):
                data = t.as_buffer().to_pybytes()
                texts.append((langs.setdefault(lang, len(langs)), data))
                size += len(data)
                if size >= SHARD_BYTES:
                    yield Shard(texts, list(langs))
                    texts, langs, size = [], {}, 0
    if texts:
        yield Shard(texts, list(langs))


def _own(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return ship(docs).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))


def counter_bits(docs: DataFrame, text: str = "text") -> int:
    """The number of bits of a counter's place that suits the texts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (size // 8).bit_length()))


def counters(docs: DataFrame, bits: int, least: int = LEAST, text: str = "text", lang: str = "lang") -> np.ndarray:
    """A bit for each of 2**bits counters, set where paths come to ``least`` or more (at most 255)."""
    blocks = max(1, (1 << bits) // BLOCK)

    def count(batches):
        for shard in _shards(batches):
            at, n = np.unique(np.concatenate([at[goes] for goes, at in shard.paths(bits)]), return_counts=True)
            block, inside = at // BLOCK, (at % BLOCK).astype("<u2")
            n = np.minimum(n, least).astype(np.uint8)
            ends = np.searchsorted(block, np.arange(blocks + 1))
            some = np.flatnonzero(np.diff(ends))
            rows = [[inside[ends[b] : ends[b + 1]].tobytes() for b in some], [n[ends[b] : ends[b + 1]].tobytes() for b in some]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(r, pa.binary()) for r in rows)], ["block", "at", "n"])
        release()

    def add(batches):
        block, held = None, np.zeros(BLOCK, np.uint16)
        done = []
        for batch in batches:
            for b, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    if block is not None:
                        done.append((block, np.packbits(held >= least).tobytes()))
                    block, held[:] = b, 0
                at = np.frombuffer(at, "<u2")
                held[at] = np.minimum(held[at] + np.frombuffer(n, np.uint8), least)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.binary())], ["block", "set"])
                done = []
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(held >= least).tobytes()], pa.binary())], ["block", "set"])

    if least > 255:
        raise ValueError("counters stop at 255")
    sums = _own(docs, text, lang).mapInArrow(count, "block int, at binary, n binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros(blocks * BLOCK // 8, np.uint8)
    for r in sums.mapInArrow(add, "block int, set binary").toLocalIterator():
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["set"], np.uint8)
    return out


def tries(docs: DataFrame, counted: np.ndarray, bits: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, w1 to w4 (null below a node's depth), n: the nodes of every shard's trie, sorted; the root has no word."""
    sent = docs.sparkSession.sparkContext.broadcast(counted)
    names = ["lang", *WORDS, "n"]

    def run(batches):
        for shard in _shards(batches):
            code, size = shard.code, len(shard.code)
            root, n = np.unique(shard.lang[shard.is_word], return_counts=True)
            # Columns of nodes: language, words by number (-1 for none), count.
            nodes = [np.column_stack([root, *[np.full(len(root), -1)] * DEPTH, n])]
            # A path goes on where the shorter one, and the one a word later, are frequent too.
            goes = []
            for mask, at in shard.paths(bits):
                mask = mask & (sent.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
                goes.append(mask & goes[-1] & np.concatenate([goes[-1][1:], np.zeros(min(1, size), bool)]) if goes else mask)
            node = np.full(size, -1, np.int64)
            for d, mask in enumerate(goes):
                at = np.flatnonzero(mask & (node >= 0)) if d else np.flatnonzero(mask)
                above = node[at] if d else shard.lang[at]
                key, first, own, n = np.unique(above * len(shard.words) + code[np.minimum(at + d, size - 1)], return_index=True, return_inverse=True, return_counts=True)
                where = at[first]
                path = np.full((len(key), DEPTH), -1)
                for k in range(d + 1):
                    path[:, k] = code[where + k]
                nodes.append(np.column_stack([shard.lang[where], path, n]))
                node = np.full(size, -1, np.int64)
                node[at] = own
            rows = np.concatenate(nodes)
            # Numbers in the order of the words' bytes; none comes first.
            order = sorted(range(len(shard.words)), key=shard.words.__getitem__)
            rank = np.empty(len(order) + 1, np.int64)
            rank[order], rank[-1] = np.arange(len(order)), -1
            rows = rows[np.lexsort([rank[rows[:, k]] for k in range(DEPTH, 0, -1)] + [rows[:, 0]])]
            table = pa.array([None if w[:1] == b"\xff" else w.decode() for w in shard.words], pa.string())
            for at in range(0, len(rows), 65536):
                part = rows[at : at + 65536]
                words = [table.take(pa.array(np.where(part[:, k] < 0, 0, part[:, k]), mask=part[:, k] < 0)) for k in range(1, DEPTH + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([shard.langs[i] for i in part[:, 0]], pa.string()), *words, pa.array(part[:, -1], pa.int64())], names)
        release()

    return _own(docs, text, lang).mapInArrow(run, "lang string, w1 string, w2 string, w3 string, w4 string, n long")


def merged(runs: DataFrame, least: int = LEAST) -> DataFrame:
    """The nodes of all tries of ``least`` or more, and roots, in ranges of their prefix, sorted by path."""
    dealt = runs.repartitionByRange(F.col("lang"), F.col("w1"), F.col("w2"))
    sums = dealt.groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
    return sums.filter((F.col("n") >= least) | F.col("w1").isNull()).sortWithinPartitions("lang", *WORDS)


def walk(nodes: DataFrame) -> DataFrame:
    """lang, m (words), phrase, n, up2, up3 (counts of the ancestors of two and three words), child (the largest child's).

    Parents come before children and a subtree of two words is in one partition, so a stack of DEPTH nodes is all that is held.
    """
    names = ["lang", "m", "phrase", "n", "up2", "up3", "child"]

    def run(batches):
        stack: list[list] = []  # [lang, words, n, up2, up3, child]
        done: list[list] = []

        def leave(depth):
            while len(stack) > depth:
                done.append(stack.pop())

        def flush():
            rows = [(s[0], len(s[1]), " ".join(s[1]), *s[2:]) for s in done]
            done.clear()
            kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for lang, *words, n in zip(*(c.to_pylist() for c in batch.columns)):
                words = [w for w in words if w is not None]
                while stack and not (stack[-1][0] == lang and stack[-1][1] == words[: len(stack[-1][1])] and 2 <= len(stack[-1][1]) < len(words)):
                    leave(len(stack) - 1)
                up = {len(s[1]): s[2] for s in stack}
                if stack:
                    stack[-1][5] = max(stack[-1][5] or 0, n)
                stack.append([lang, words, n, up.get(2), up.get(3), None])
            yield flush()
        leave(0)
        yield flush()

    return ship(nodes).mapInArrow(run, "lang string, m int, phrase string, n long, up2 long, up3 long, child long")


def _score(a: str, l: Column, r: Column) -> Column:  # noqa: E741
    whole = (F.lit(SCALE).cast("decimal(7,0)") * F.col(a).cast("decimal(20,0)")).cast("decimal(38,0)")
    # A quotient of decimals is rounded, so the division is of whole numbers.
    return F.call_function("div", whole, l.cast("decimal(20,0)") + r.cast("decimal(20,0)"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases of two to DEPTH words.

    A phrase of which a longer one makes up SHARE hundredths or more is left out.
    """
    bits = bits or counter_bits(docs, text)
    runs = materialize(tries(docs, counters(docs, bits, least, text, lang), bits, text, lang), "tries")
    nodes = materialize(walk(merged(runs, least)), "trie")
    by = lambda m: nodes.filter(F.col("m") == m)
    suffix = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    first = F.substring_index("phrase", " ", 1)
    # Suffix links, level by level: a node's right parts are its link's count and its link's right parts.
    level = by(1).select("lang", "phrase", "n", F.array().cast("array<long>").alias("right"))
    linked = []
    for m in range(2, DEPTH + 1):
        link = level.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.concat(F.array("n"), "right").alias("right"))
        level = by(m).withColumn("_s", suffix).join(link, (F.col("lang") == F.col("_l")) & (F.col("_s") == F.col("_p"))).drop("_l", "_p")
        linked.append(level)
    phrases = reduce(DataFrame.unionByName, linked)
    ones = by(1).select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("n").alias("up1"))
    phrases = phrases.withColumn("_w", first).join(ones, (F.col("lang") == F.col("_l")) & (F.col("_w") == F.col("_p"))).drop("_l", "_p")
    # The largest extension to the left, through the links the other way.
    wider = nodes.filter(F.col("m") > 2).groupBy(F.col("lang").alias("_l"), suffix.alias("_p")).agg(F.max("n").alias("left"))
    phrases = phrases.join(wider, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left").drop("_l", "_p")
    large = lambda c, k: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)") * k
    kept = phrases.filter((large("child", 100) < large("n", SHARE)) & (large("left", 100) < large("n", SHARE)))
    cut = [F.struct(_score("n", F.col(f"up{k}"), F.get("right", F.lit(k - 1))).alias("score"), F.lit(k).alias("k"), F.col(f"up{k}").alias("l"), F.get("right", F.lit(k - 1)).alias("r")) for k in range(1, DEPTH)]
    best = F.array_min(F.slice(F.array(*cut), F.lit(1), F.col("m") - 1))
    scored = kept.withColumn("c", best).select("lang", "phrase", F.col("n").alias("a"), "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Lists of slices of a language first, so that none of its rows but those meet.
    sliced = scored.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    lists = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("rank") <= top).drop("_s", "rank")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = by(0).select(F.col("lang").alias("_l"), F.col("n").alias("total"))
    return ranked.join(totals, F.col("lang") == F.col("_l")).select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def oracle_sql() -> str:
    grams = "flatten([list_transform(range(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k], ' ')) for k in range(4)])"
    return rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS p FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM d),
        t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
        g AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest({grams}) AS p FROM w) GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
        c AS (SELECT lang, p, f, string_split(p, ' ') AS s FROM g WHERE contains(p, ' ')),
        inside AS (SELECT DISTINCT x.lang, x.q FROM (SELECT lang, f, unnest(list_distinct(flatten([[array_to_string(s[i:j], ' ') for j in range(i + 1, len(s) + 1) if j - i + 1 < len(s)] for i in range(1, len(s))]))) AS q FROM c) x JOIN g ON g.lang = x.lang AND g.p = x.q WHERE 100 * x.f >= {SHARE} * g.f),
        cut AS (SELECT lang, p, f, s, unnest(range(1, len(s))) AS k FROM c WHERE (lang, p) NOT IN (SELECT lang, q FROM inside)),
        v AS (SELECT cut.lang, cut.p, cut.f, k, a.f AS l, b.f AS r, CAST({SCALE}::HUGEINT * cut.f // (a.f + b.f) AS BIGINT) AS score FROM cut JOIN g a ON a.lang = cut.lang AND a.p = array_to_string(s[1:k], ' ') JOIN g b ON b.lang = cut.lang AND b.p = array_to_string(s[k + 1:], ' ')),
        one AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, p) AS rank FROM one)
        SELECT o.lang, rank, p AS phrase, f AS a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= {TOP}
    """
