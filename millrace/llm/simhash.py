"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is two segments of 32. Fingerprints that differ in at most 3 bits differ in at most 1 bit in one
of the segments, so each distinct fingerprint is stored in a table under both of its segments, and looks up the Hamming
ball of radius 1 around each. Of two segments one bit apart one has that bit set, so balls are enumerated downwards only:
the segment itself and it with each set bit cleared. All rows of a segment value meet in one place, are verified by
complete distance, and yield only a spanning forest of their links, never all pairs. A segment value that more than
MOST_ROWS fingerprints share is not held in memory: its fingerprints are dealt again by what remains of their other
segment once any 3 of its bits are cleared, which finds the same links in groups of at most some hundred.

``similar`` does the same for a similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more. At that similarity fingerprints of five-word shingles differ in 15 % of their bits, too many for small balls, but
those of the sets of single words in 5 %. So its index holds 256 bits of the latter, as 8 segments of 32 with balls of
radius 1, verifies 64 bits, and what it links is then compared by exact Jaccard, each linked group in itself.

Edge cases: null, empty or blank text has fingerprint zero, which links like any other; repeated rows and null ids each
give a row; component_id is the smallest id that is not null, and null where a component has none; an empty table gives no
rows; a text's length has no bound but a worker's memory for that text; other columns of the input are not looked at.
For ``similar`` words count without case and punctuation, texts of fewer than five words are alike if their words are the
same, and null ids come last in the order by which a document stays.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, release, ship, small
from .components import components
from .near import SHINGLE as FIVE
from .near import exact_components, filter_of, firsts, grouped, mix, names_of, set_column, shingles_of, through, words_of

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints under one segment value that are compared in memory; with more, they are dealt again.
MOST_ROWS = 16_384
#: Segments of 32 bits, and differing bits allowed in the first two of them, of the index for similar documents.
SEGMENTS, LOOSE_RADIUS = 8, 10


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint of one text: bit i is set if more than half of the shingles' hashes have it."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for at in range(0, n, 65536):
        part = words[at : at + 65536 + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        h = np.array([digest(s, SEED) for s in shingles], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        for batch in small(batches):
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [doc_id, "fp"])
        release()

    return ship(docs).select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, fp long")


def _balls(batches):
    """For each fingerprint and segment: the table's row, and a row for each ball member below it."""
    for batch in small(batches, 20_000):
        fp = np.asarray(batch.column(0)).astype(np.int64)
        keys, fps, table = [], [], []
        for s in (0, 1):
            half = (fp.view(np.uint64) >> np.uint64(32 * s) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for bit in range(-1, 32):
                own = slice(None) if bit < 0 else np.flatnonzero(half >> bit & 1)
                k = half[own] & ~(1 << bit if bit >= 0 else 0)
                keys.append(k | s << 32)
                fps.append(fp[own])
                table.append(np.full(len(k), bit < 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(fps)), pa.array(np.concatenate(table))], ["k", "fp", "in_table"])


def _forest(fp: np.ndarray, radius: int) -> tuple[list, list]:
    """A spanning forest of the links among distinct fingerprints, breadth first; memory in proportion to them."""
    a, b, left = [], [], fp.view(np.uint64)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            found = left[near]
            a += [int(np.uint64(x).view(np.int64))] * len(found)
            b += found.view(np.int64).tolist()
            queue += list(found)
            left = left[~near]
    return a, b


def _linker(radius: int, most: int | None):
    """From rows sorted by k to links (a, b); rows of a k with more than ``most`` rows come out with again = k instead."""

    def link(batches):
        held: list[tuple] = []

        def emit(a, b, again=None):
            again = again if again is not None else [None] * len(a)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(again, pa.int64())], ["a", "b", "again"])

        def groups(k, fp, table):
            a, b = [], []
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            ends = np.append(starts[1:], len(k))
            has = np.logical_or.reduceat(table, starts)
            pair = starts[(ends - starts == 2) & has]
            near = pair[np.bitwise_count(fp[pair].view(np.uint64) ^ fp[pair + 1].view(np.uint64)) <= radius]
            a += fp[near].tolist()
            b += fp[near + 1].tolist()
            for i in np.flatnonzero((ends - starts > 2) & has):
                x, y = _forest(np.unique(fp[starts[i] : ends[i]]), radius)
                a += x
                b += y
            return emit(a, b)

        large = None
        for batch in batches:
            new = tuple(np.asarray(batch.column(i)) for i in range(2)) + (batch.column(2).to_numpy(zero_copy_only=False),)
            k, fp, table = (np.concatenate([h, n]) for h, n in zip(held, new)) if held else new
            if not len(k):
                continue
            if large is not None:
                cut = int(np.searchsorted(k, large, "right"))
                yield emit(fp[:cut], fp[:cut], k[:cut])
                k, fp, table = k[cut:], fp[cut:], table[cut:]
                if not len(k):
                    held = []
                    continue
                large = None
            last = int(np.searchsorted(k, k[-1], "left"))
            if last:
                yield groups(k[:last], fp[:last], table[:last])
            k, fp, table = k[last:], fp[last:], table[last:]
            held = [k, fp, table]
            if most is not None and len(k) > most:
                large = k[-1]
                yield emit(fp, fp, k)
                held = []
        if held and len(held[0]):
            yield groups(*held)
        release()

    return link


def _masks(batches):
    """Rows of an overfull k, dealt by the other segment with any 3 bits cleared."""
    masks = np.array([~sum(1 << i for i in c) & 0xFFFFFFFF for c in combinations(range(32), 3)], np.uint64)
    index = np.arange(len(masks), dtype=np.uint64)
    for batch in small(batches, 64):
        fp, k = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)).astype(np.int64)
        u, seg = fp.view(np.uint64), (k >> 32).astype(np.uint64)
        other = np.where(seg == 0, u >> np.uint64(32), u & np.uint64(0xFFFFFFFF))
        rest = (other[:, None] & masks[None, :]).astype(np.uint64)
        mixed = (rest * np.uint64(0x9E3779B97F4A7C15)) ^ (index[None, :] << np.uint64(40)) ^ (k.view(np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F))
        yield pa.RecordBatch.from_arrays([pa.array(mixed.ravel().view(np.int64)), pa.array(np.repeat(fp, len(masks))), pa.array(np.ones(len(fp) * len(masks), bool))], ["k", "fp", "in_table"])


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST_ROWS) -> DataFrame:
    """(a, b): a spanning forest of the links among distinct fingerprints (column fp), at most ``radius`` = 3 bits apart."""
    if radius > 3:
        raise ValueError("two segments with balls of radius 1 find at most 3 differing bits")
    rows = ship(fps).select("fp").mapInArrow(_balls, "k long, fp long, in_table boolean")
    found = materialize(rows.repartition("k").sortWithinPartitions("k").mapInArrow(_linker(radius, most), "a long, b long, again long"), "links")
    again = found.filter("again is not null")
    if again.isEmpty():
        return found.select("a", "b")
    dealt = ship(again).select("a", "again").mapInArrow(_masks, "k long, fp long, in_table boolean").repartition("k").sortWithinPartitions("k")
    more = dealt.mapInArrow(_linker(radius, None), "a long, b long, again long")
    return found.filter("again is null").select("a", "b").union(more.select("a", "b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that links reach from a document's fingerprint."""
    prints = materialize(fingerprints(docs, doc_id, text, width), "fingerprints")
    first = prints.groupBy("fp").agg(F.min(doc_id).alias("first"))
    of = components(links(first, radius))
    joined = first.join(of, first["fp"] == of["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = joined.groupBy("c").agg(F.min("first").alias("component_id"))
    label = joined.join(least, "c").select("fp", "component_id")
    return prints.join(label, "fp").select(doc_id, "fp", "component_id")


def _word_prints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key (of id and text), id, t and g (the name of the words) and w0 to w3, 256 bits of the set of words, of each document."""
    kind = dict(docs.dtypes)[doc_id]
    salts = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64) for i in range(SEGMENTS // 2)]

    def run(batches):
        for batch, texts in grouped(batches, 2):
            of, _, _, h, _ = words_of(texts)
            at = firsts(of)
            n = np.diff(np.append(at, len(h)))
            t, g = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32)
            t[of[at]], g[of[at]] = names_of(h, at, n, 0)
            bits = np.zeros((len(texts), len(salts)), np.int64)
            for a, k in zip(at.tolist(), n.tolist()):
                words = np.unique(h[a : a + k])
                for i, salt in enumerate(salts):
                    x, ones = mix(mix(words ^ salt) + words), np.zeros(64, np.int64)
                    for lo in range(0, len(x), 65536):
                        ones += np.unpackbits(x[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                    bits[of[a], i] = np.packbits(2 * ones > len(x), bitorder="little").view(np.int64)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t), pa.array(g), *map(pa.array, bits.T.copy())], names)
        release()

    names = ["key", "id", "t", "g", *(f"w{i}" for i in range(len(salts)))]
    keyed = docs.select(F.xxhash64(doc_id, text).alias("key"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return ship(keyed).mapInArrow(run, f"key long, id {kind}, t long, g int, " + ", ".join(f"{n} long" for n in names[4:]))


def _word_balls(batches):
    """Rows (t, w0, w1, ...) -> for each segment the table's row, and a row for each ball member below it: k, w0, t, in_table."""
    for batch in small(batches, 10_000):
        t, words = np.asarray(batch.column(0)), [np.asarray(batch.column(i)).astype(np.int64) for i in range(1, batch.num_columns)]
        for s in range(SEGMENTS):
            half = (words[s // 2].view(np.uint64) >> np.uint64(32 * (s % 2)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for bit in range(-1, 32):
                own = slice(None) if bit < 0 else np.flatnonzero(half >> bit & 1)
                k = half[own] & ~(1 << bit if bit >= 0 else 0) | s << 32
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(words[0][own]), pa.array(t[own]), pa.array(np.full(len(k), bit < 0))], ["k", "w", "t", "in_table"])


def _loosely(most: int):
    """From rows (k, w, t, in_table) sorted by k to links (a, b) of texts t whose w are near under one k.

    What is linked too much is parted again by the exact comparison: under a k of more than ``most`` rows all are linked.
    """

    def link(batches):
        held, large = None, None

        def emit(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def near(w, t, table):
            if not table.any() or len(t) < 2:
                return [], []
            t, one = np.unique(t, return_index=True)
            left, w, a, b = np.arange(len(t)), w[one].view(np.uint64), [], []
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    close = np.bitwise_count(w[left] ^ w[x]) <= LOOSE_RADIUS
                    found = left[close]
                    a += [int(t[x])] * len(found)
                    b += t[found].tolist()
                    queue += found.tolist()
                    left = left[~close]
            return a, b

        for batch in batches:
            new = [np.asarray(batch.column(i)) for i in range(3)] + [batch.column(3).to_numpy(zero_copy_only=False)]
            k, w, t, table = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if large is not None and len(k):
                cut = int(np.searchsorted(k, large[0], "right"))
                yield emit([large[1]] * cut, t[:cut])
                k, w, t, table = k[cut:], w[cut:], t[cut:], table[cut:]
                large = None if len(k) else large
            if not len(k):
                held = None
                continue
            starts = firsts(k)
            ends = np.append(starts[1:], len(k))
            several = np.flatnonzero((ends - starts > 1)[:-1] & np.logical_or.reduceat(table, starts)[:-1])
            pairs = [near(w[i:j], t[i:j], table[i:j]) for i, j in zip(starts[several].tolist(), ends[several].tolist())]
            if pairs:
                yield emit([x for a, _ in pairs for x in a], [x for _, b in pairs for x in b])
            held = [x[starts[-1] :] for x in (k, w, t, table)]
            if len(held[0]) > most:
                large = (held[0][0], int(held[2][0]))
                yield emit([large[1]] * len(held[2]), held[2])
                held = None
        if held is not None:
            yield emit(*near(*held[1:]))
        release()

    return link


def _shingle_sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """node and set (distinct five-word shingles) of the texts whose name is a ``wanted`` node."""
    sieve = docs.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def run(batches):
        for _, texts in grouped(batches, 0):
            of, _, _, h, _ = words_of(texts)
            at = firsts(of)
            n = np.diff(np.append(at, len(h)))
            name, _ = names_of(h, at, n, 0)
            own = through(sieve, name)
            sets = [np.unique(shingles_of(h[at[i] : at[i] + n[i]])) if n[i] >= FIVE else name[i : i + 1].view(np.uint64) for i in own.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(name[own]), set_column(sets)], ["node", "set"])
        release()

    found = ship(docs.select(text)).mapInArrow(run, "node long, set array<long>")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_ROWS) -> DataFrame:
    """key, id, group and group_g of each document: documents of equal group and group_g are linked by similarity."""
    prints = materialize(_word_prints(docs, doc_id, text), "word-prints")
    words = [c for c in prints.columns if c[0] == "w"]
    distinct = prints.groupBy("t").agg(*(F.min(w).alias(w) for w in words))
    rows = ship(distinct).mapInArrow(_word_balls, "k long, w long, t long, in_table boolean").repartition("k").sortWithinPartitions("k")
    loose = materialize(components(materialize(rows.mapInArrow(_loosely(most), "a long, b long"), "links")), "loose")
    sizes = loose.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    members = materialize(loose.join(sizes, "component").withColumnRenamed("component", "band"), "members")
    sets = materialize(_shingle_sets(docs, members.select("node").distinct(), text), "sets")
    of = exact_components(members, sets)
    label = F.coalesce("component", "t").alias("group"), F.when(F.col("component").isNull(), F.col("g")).otherwise(0).alias("group_g")
    return prints.join(of, F.col("t") == F.col("node"), "left").select("key", "id", *label)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of ``similar`` ones: that of the smallest id, of repeated rows one."""
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first")
    stay = similar(docs, doc_id, text).groupBy("group", "group_g").agg(first).select(F.col("first.key").alias("_millrace_key"), F.col("first.id").alias("_millrace_id"))
    keyed = docs.withColumn("_millrace_key", F.xxhash64(doc_id, text)).alias("d")
    own = (F.col("d._millrace_key") == F.col("s._millrace_key")) & F.col(f"d.`{doc_id}`").eqNullSafe(F.col("s._millrace_id"))
    kept = keyed.join(stay.alias("s"), own, "left_semi")
    return kept.dropDuplicates(["_millrace_key", doc_id]).select(*docs.columns)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
