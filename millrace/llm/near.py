"""What the operators on word shingles share: hashed words, shingles, exact links by Jaccard similarity, dealt groups.

Words are runs of characters that are not blank; their hashes leave case and punctuation out. They are found in arrays of
whole batches of texts, so that no worker remembers words.
"""

from __future__ import annotations

import pickle
import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release, ship, use_cache
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Members of one group that one task compares.
DEALT_MEMBERS = 256
#: Members, and shingles of theirs, that are held at a time where a group is compared lot by lot.
LOT, LOT_SHINGLES = 4096, 1 << 21
#: Characters whose words are found at a time, and at most about which texts are taken together.
CHUNK, GROUP = 1 << 18, 1 << 19
#: Bits of the filter of wanted names: its size is the same whatever the corpus holds.
FILTER_BITS = 1 << 26

_blank = re.compile(r"[ \t-\r]")
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _characters() -> np.ndarray:
    """For each character of the basic plane a value that is the same for both cases; 0 if it is no letter or digit."""
    if "characters" not in _tables:
        low = [(ord(x) if len(x := c.lower()) == 1 else ord(c)) + 1 if c.isalnum() else 0 for c in map(chr, range(1 << 16))]
        codes = np.array(low, np.uint64)
        _tables["characters"] = np.where(codes > 0, mix(mix(codes * np.uint64(0xD6E8FEB86659FD93)) + codes), np.uint64(0))
    return _tables["characters"]


def powers(n: int, base: int) -> np.ndarray:
    """The powers of an odd number, n of them at least."""
    name = f"powers-{base}"
    if len(_tables.get(name, ())) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _tables[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _tables[name]


def _chunk_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(starts, ends, hashes, newlines before) of the words of a text, and its number of newlines; offsets are code points."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = np.concatenate([[True], (codes == 32) | (codes - np.uint32(9) <= 4), [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    newlines = np.cumsum(codes == 10, dtype=np.int32)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), starts, int(newlines[-1]) if len(codes) else 0
    value = _characters()[np.minimum(codes, np.uint32(65535))]
    if codes.max() > 65535:
        value = np.where(codes > 65535, mix(codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), value)
    kept = np.flatnonzero(value)
    first = np.searchsorted(kept, starts)
    n = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first, n)
    h = np.zeros(len(starts), np.uint64)
    if len(kept):
        h[n > 0] = np.add.reduceat(value[kept] * powers(int(n.max()), 0xA24BAED4963EE407)[place], first[n > 0])
    return starts, ends, mix(mix(h) + n.astype(np.uint64)), newlines[starts], int(newlines[-1])


def _cut(text: str) -> list[tuple[int, str]]:
    """(offset, part) of a text, in parts of about CHUNK characters that end at blanks."""
    out, at = [], 0
    while len(text) - at > CHUNK and (m := _blank.search(text, at + CHUNK)):
        out.append((at, text[at : m.end()]))
        at = m.end()
    return [*out, (at, text[at:])]


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, hash, line) of all words of the texts; lines are numbered through, a text begins a new one."""
    parts: list[tuple] = []
    line, of, held, size = 0, [], [], 0

    def flush():
        nonlocal line, held, of, size
        starts, ends, h, before, newlines = _chunk_words("\n".join(held))
        at = np.cumsum([0, *(len(t) + 1 for t in held[:-1])])
        k = np.searchsorted(at, starts, "right") - 1
        shift = np.array([x for _, x in of], np.int64) - at
        parts.append((np.array([i for i, _ in of], np.int64)[k], starts + shift[k], ends + shift[k], h, before + line))
        line += newlines
        held, of, size = [], [], 0

    for i, text in enumerate(texts):
        line += 1  # of the newline between two texts, whether or not they share a chunk
        for at, part in _cut(text or ""):
            if size + len(part) > CHUNK and held:
                flush()
            held.append(part)
            of.append((i, at))
            size += len(part)
            if at or len(part) >= CHUNK:
                flush()
    if held:
        flush()
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def firsts(x: np.ndarray) -> np.ndarray:
    """The first place of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def shingles_of(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = max(0, len(h) - width + 1)
    s = np.zeros(n, np.uint64)
    for i in range(width):
        s = mix(s + h[i : i + n])
    return s


def names_of(h: np.ndarray, at: np.ndarray, n: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash of the runs of ``n`` > 0 words at ``at``."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    inside = np.repeat(at, n)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(n) - n, n)
    words, firsts = h[inside + place], np.cumsum(n) - n
    salt = n.astype(np.uint64) * np.uint64(2) + np.uint64(level)
    a = mix(mix(np.add.reduceat(words * powers(int(n.max()), 0x9FB21C651E98DF25)[place], firsts)) + salt)
    b = mix(np.add.reduceat(mix(words) * powers(int(n.max()), 0xD1342543DE82EF95)[place], firsts) + salt)
    return a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def grouped(batches, text: int):
    """Slices of Arrow batches, and their texts, of about GROUP characters (a longer text stands alone).

    Nothing is remembered from text to text; what an earlier stage's tasks left remembered in this worker is dropped.
    """
    use_cache("none", dict)
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP, "right")))
            part = batch.slice(at, stop - at)
            yield part, part.column(text).to_pylist()
            at = stop


def filter_of(wanted: DataFrame) -> bytes:
    """FILTER_BITS bits, of which those are set that the longs of the only column name. It lets rows through, never keeps one."""
    bit = F.pmod(wanted.columns[0], F.lit(FILTER_BITS)) + 1
    words = wanted.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for r in words.toLocalIterator():  # FILTER_BITS / 32768 rows at most
        at = (r["bucket"] - 1) * 4096
        bits[at : at + len(r["bits"])] = r["bits"]
    return bytes(bits)


def passing(sieve, name: np.ndarray) -> np.ndarray:
    """The places of the names that the filter (a broadcast) lets through."""
    bit, bits = name % FILTER_BITS, np.frombuffer(sieve.value, np.uint8)
    return np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)


def through(sieve, name: np.ndarray) -> np.ndarray:
    """The places of the names that the filter lets through, of equal names the first."""
    own = passing(sieve, name)
    return own[np.unique(name[own], return_index=True)[1]]


def set_column(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))


def _root(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def _against(ids: list, sets: list[np.ndarray], more: list, others: list[np.ndarray], parent: dict, similarity: float) -> tuple[list, list]:
    """Links of some members to others that join trees which no link has joined so far."""
    a, b = [], []
    sizes = np.array([len(s) for s in others])
    whole = np.concatenate(others)
    order = np.argsort(whole, kind="stable")
    values, owner = whole[order], np.repeat(np.arange(len(others)), sizes)[order]
    trees = {_root(parent, i) for i in more}
    for i, s in zip(ids, sets):
        if trees == {_root(parent, i)}:
            continue
        lo, n = np.searchsorted(values, s), np.searchsorted(values, s, "right")
        n -= lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(others))
        joined = False
        for j in np.flatnonzero(both >= similarity * (sizes + len(s) - both) - 1e-9).tolist():
            x, y = _root(parent, i), _root(parent, more[j])
            if x != y:
                parent[x], joined = y, True
                a.append(i)
                b.append(more[j])
        if joined:
            trees = {_root(parent, t) for t in trees}
    return a, b


def _link(ids: list, sets: list[np.ndarray], more: list, others: list[np.ndarray], parent: dict, similarity: float) -> tuple[list, list]:
    """Links between two lots (or within one, given twice) that join trees; every pair counts but those of one tree."""
    roots = Counter(_root(parent, i) for i in (*ids, *more))
    if len(roots) == 1:
        return [], []
    most = roots.most_common(1)[0][0]
    rest = [k for k, i in enumerate(ids) if _root(parent, i) != most]
    a, b = _against([ids[k] for k in rest], [sets[k] for k in rest], more, others, parent, similarity) if rest else ([], [])
    if ids is more or len(rest) == len(ids):
        return a, b
    rest = [k for k, i in enumerate(more) if _root(parent, i) != _root(parent, most)]
    x, y = _against([more[k] for k in rest], [others[k] for k in rest], ids, sets, parent, similarity) if rest else ([], [])
    return a + x, b + y


def linked(ids: list, sets: list[np.ndarray], similarity: float) -> tuple[list, list, list]:
    """A spanning forest of the pairs at least this alike, and one member of each tree."""
    parent: dict = {}
    a, b = _link(ids, sets, ids, sets, parent, similarity)
    return a, b, list({_root(parent, i): i for i in ids}.values())


def verify(batches):
    """Rows (group, node, set) or (group, node, set, tree), rows of a group together -> links (a, b) between trees.

    Full lots of a group wait in a file of the task for the group's later lots.
    """
    band, ids, sets, lots, size, parent = None, [], [], 0, 0, {}

    with tempfile.TemporaryFile() as kept:

        def emit():
            a, b = _link(ids, sets, ids, sets, parent, SIMILARITY) if len(ids) > 1 else ([], [])
            kept.seek(0)
            for _ in range(lots):
                x, y = _link(*pickle.load(kept), ids, sets, parent, SIMILARITY)
                a, b = a + x, b + y
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            trees = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for k, h, s, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), trees):
                if k != band:
                    if ids and (lots or len(ids) > 1):
                        yield emit()
                    if lots:
                        kept.seek(0)
                        kept.truncate()
                    ids, sets, lots, size, parent = [], [], 0, 0, {}
                band = k
                if tree is not None:
                    parent[h] = parent.setdefault(tree, tree)
                ids.append(h)
                sets.append(np.array(s.values))
                size += len(sets[-1])
                if len(ids) >= LOT or size >= LOT_SHINGLES:
                    yield emit()
                    kept.seek(0, 2)
                    pickle.dump((ids, sets), kept)
                    ids, sets, lots, size = [], [], lots + 1, 0
        if ids and (lots or len(ids) > 1):
            yield emit()
    release()


def exact_components(members: DataFrame, sets: DataFrame) -> DataFrame:
    """node, component: the nodes that chains of pairs within groups link whose sets are at least SIMILARITY alike.

    members: node, band (the group), size and first (node) of each group; sets: node and set. Both are written tables.
    Groups of more than DEALT_MEMBERS nodes are dealt to several tasks, each with the group's first node, which most of
    a large group is alike to. Where that leaves several trees in a group, its nodes are compared once more, lot by lot,
    each lot with all lots before it, but for pairs of one tree. So no pair is left out, and no task holds a whole group.
    """
    shares = F.ceil(F.col("size") / DEALT_MEMBERS)
    every = F.sequence(F.lit(0).cast("long"), shares - 1)
    dealt = F.when((shares == 1) | (F.col("node") == F.col("first")), every).otherwise(F.array(F.pmod(F.xxhash64("node"), shares)))
    rows = members.select("band", "node", F.explode(dealt).alias("share")).join(sets, "node")
    rows = rows.select(F.xxhash64("band", "share").alias("group"), "node", "set").repartition("group").sortWithinPartitions("group")
    links = materialize(ship(rows).mapInArrow(verify, "a long, b long"), "links")
    large = members.filter(F.col("size") > DEALT_MEMBERS)
    if large.isEmpty():
        found = components(links)
        discard(links)
        return found
    trees = materialize(components(links).withColumnRenamed("node", "n"), "trees")
    large = materialize(large.join(trees, F.col("node") == F.col("n"), "left").select("band", "node", F.coalesce("component", "node").alias("tree")), "large")
    several = large.groupBy("band").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).filter("lo <> hi").select("band")
    again = large.join(several, "band", "left_semi").join(sets, "node").select("band", "node", "set", "tree").repartition("band").sortWithinPartitions("band")
    more = materialize(ship(again).mapInArrow(verify, "a long, b long"), "links")
    discard(large)
    if more.isEmpty():
        discard(links, more)
        return trees.withColumnRenamed("n", "node")
    found = components(links.union(more))
    discard(links, more, trees)
    return found
