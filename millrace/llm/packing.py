"""Shortest-pack-first histogram packing.

Documents become pieces of at most ``length`` tokens; only the histogram of piece lengths (at most ``length`` rows)
reaches the driver. There lengths are placed longest first, each into the packs that are shortest so far and still have
room, as counts of packing patterns. Patterns go back to the pieces by rank: the r-th piece of a length takes the slot
whose run of ranks holds r. Ranks need no window over all pieces of a length: pieces are ranked within (length, bucket)
and the buckets' sizes, summed beforehand, give each bucket its first rank.

Edge cases: null or empty text is the end token alone; repeated rows and rows of null id are packed each on their own; of
pieces of one length any may take a slot, which is settled by a number drawn once and written down; a long text is as many
pieces as it needs; an empty table gives an empty result; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _ids_bytes, default_tokenizer, vocabulary
from .common import documents, materialize, release, ship, small, use_cache

SEQUENCE = 2048
END_ID = 1
#: Words of which a Python worker remembers the ids.
CACHE_WORDS = 300_000
BUCKETS, BUCKET_ROWS = 512, 1_000_000

_cache: dict[str, _Ids] = {}


class _Ids(dict):
    """word -> ids as bytes. The first CACHE_WORDS words are remembered; others are merged anew."""

    def __init__(self, tokenizer: str):
        v = vocabulary(tokenizer)
        super().__init__((k, _ids_bytes([i])) for k, i in v.special.items())
        self.merge = v.merger()

    def __missing__(self, word: str) -> bytes:
        ids = _ids_bytes(self.merge(word.encode()))
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


def encoder(tokenizer: str):
    """text -> ids as bytes, by what a worker remembers of words."""
    if tokenizer not in _cache:
        _cache[tokenizer] = _Ids(tokenizer)
    get, split = _cache[tokenizer].__getitem__, vocabulary(tokenizer).splitter
    return lambda text: b"".join([b"".join(map(get, words)) for words in split.runs(text)])


def _begin() -> None:
    """For task functions, which must not name the cache themselves: they would carry a copy of it."""
    use_cache("packing", _cache.clear)


def pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every text's ids and the end id, cut every ``length`` ids."""
    end = _ids_bytes([end_id])

    def cut(batches):
        _begin()
        encode = encoder(tokenizer)
        for batch in small(batches):
            cols: list[list] = [[], [], [], [], []]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(t or "") + end
                for at in range(0, len(ids), 4 * length):
                    part = ids[at : at + 4 * length]
                    for col, x in zip(cols, (d, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)
        release()

    names = [doc_id, "start", "length", "ids_crc32", "doc_tokens"]
    return ship(docs).select(doc_id, text).mapInArrow(cut, f"{doc_id} {dict(docs.dtypes)[doc_id]}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], length: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """[(number of packs, lengths in the pack)], covering the histogram exactly."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n > 0:
            gap = max(room, default=-1)
            if gap < size:
                put, pattern, gap = n, (), length
            else:
                pattern, have = next(iter(room[gap].items()))
                put = min(n, have)
                room[gap][pattern] -= put
                if not room[gap][pattern]:
                    del room[gap][pattern]
                    if not room[gap]:
                        del room[gap]
            more = room[gap - size]
            more[(*pattern, size)] = more.get((*pattern, size), 0) + put
            n -= put
    return [(k, p) for _, by in sorted(room.items()) for p, k in by.items()]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): which ranks of a length lie where."""
    out, used, sequence = [], defaultdict(int), 0
    for count, pattern in patterns:
        offset = 0
        for size in pattern:
            out.append((size, used[size], used[size] + count, sequence, offset))
            used[size] += count
            offset += size
        sequence += count
    return out


def pack(parts: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns length and any others); pieces are read twice, so pass a written table.

    A column _lot, if there is one, deals pieces of one length to buckets, else the hash of all columns.
    """
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(shortest_pack_first(histogram, length))
    where = spark.createDataFrame(table, "length long, lo long, hi long, first long, offset long")
    buckets = max(BUCKETS, sum(histogram.values()) // BUCKET_ROWS)
    names = [c for c in parts.columns if c != "_lot"]
    bucketed = parts.withColumn("_b", F.pmod("_lot" if "_lot" in parts.columns else F.xxhash64(*parts.columns), F.lit(buckets)).cast("int")).select(*names, "_b")
    before = (
        bucketed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
        .withColumn("_from", F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_b", F.coalesce("_from", F.lit(0)).alias("_from"))
    )
    ranked = bucketed.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy(*names)) - 1)
    ranked = ranked.join(before, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_from"))
    # The table of slots has a few rows for each pattern; the histogram bounds it, not the corpus.
    at = F.broadcast(where.withColumnRenamed("length", "_l"))
    return (
        ranked.join(at, (F.col("length") == F.col("_l")) & (F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi")))
        .withColumn("sequence_id", F.col("first") + F.col("_r") - F.col("lo"))
        .select(*names, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """All documents' pieces with their sequence_id and offset."""
    cut = pieces(docs, tokenizer or default_tokenizer(), length)
    return pack(materialize(cut.withColumn("_lot", F.floor(F.rand() * 2**40).cast("long")), "pieces"), length)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
