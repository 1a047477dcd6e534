"""Token ids as raw binary shards, with a minimal perfect hash index from document keys to places in them.

``write`` encodes every text once (words that a worker has seen are not merged again; the ids are those of the tokenizers
library) and deals the ids to shards by ranges of the documents' ids; each task writes a shard's
ids, little-endian and without gaps, into one file. ``index`` deals the keys to index parts by a hash, and each task writes
one part's minimal perfect hash: levels of bits, where a key that is alone at its place stays and the others go on to the
next level. A key's slot is the number of set bits before its own; there the part keeps a fingerprint (32 bits of a second
hash), the shard, the offset and the length. So a lookup costs a few probes and one read of the payload, whatever the
corpus holds, and a key that was never written is told by its fingerprint, but for one in 2**32.

A folder holds shard and index files and manifest.json, which names the files that count: a task that is run again writes
under another name, and only the files that a committed task has reported are listed. ``Store`` reads a folder without
Spark, one key at a time; ``lookup`` and ``read`` serve many keys in tasks, by index part and then by place.

The folder is a URI that pyarrow.fs opens (file, hdfs, s3, gs): executors write to it themselves.

Edge cases: null or empty text is the end id alone; rows of equal doc_id are told by an ordinal, from 0, in the order of a
hash of their texts; rows of null doc_id come first and have ordinals too; an id that holds very many rows spans several
shards, by that hash; of repeated rows any may come first; a text is encoded whole, however long; an empty table gives a
folder without shards and no rows; columns besides doc_id and text are not looked at. The doc_id is of an integer type.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import full_uri, open_folder
from .bpe import _ids_bytes, default_tokenizer, vocabulary
from .common import documents, materialize, release, shared_dir, ship, small
from .packing import _begin, encoder

END_ID = 0
#: Documents of a shard and keys of an index part, about.
SHARD_DOCS, PART_KEYS = 1 << 20, 1 << 20
#: Ids of a payload that one group of reads covers.
REGION = 1 << 22
GAMMA, LEVELS = 2.0, 64
MAGIC = b"MPHIDX01"
ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a full URI."""
    uri = full_uri(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    files, root = open_folder(uri)
    files.create_dir(root)
    return uri


@dataclass
class Written:
    """A folder, and the table of its documents: doc_id, ordinal, shard, offset (in the shard), n."""

    uri: str
    catalog: DataFrame


def _manifest(files: pafs.FileSystem, root: str, **entries) -> None:
    """Adds entries to the folder's manifest; the new one takes the old one's place at once."""
    held = _read_manifest(files, root) if files.get_file_info(f"{root}/manifest.json").type == pafs.FileType.File else {}
    name = f"{root}/manifest-{uuid.uuid4().hex}"
    with files.open_output_stream(name) as out:
        out.write(json.dumps(held | entries).encode())
    files.move(name, f"{root}/manifest.json")


def _read_manifest(files: pafs.FileSystem, root: str) -> dict:
    with files.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS) -> Written:
    """Encodes all texts, each with the end id, and writes them in ascending order of doc_id."""
    spark = docs.sparkSession
    uri = new_folder(spark, "ids")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // shard_docs))
    # A value that fills several shards is a cut several times. One value a shard reaches the driver.
    cut = np.array(own.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 else [], np.float64)
    width = "<u2" if max([end_id, *vocabulary(tokenizer).vocab.values(), *vocabulary(tokenizer).special.values()]) < 1 << 16 else "<u4"
    end = _ids_bytes([end_id])

    def encode(batches):
        _begin()
        to_ids = encoder(tokenizer)
        for batch in small(batches):
            rows = [[], [], []]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = to_ids(t or "") + end
                digest = xxhash.xxh64_intdigest(ids)
                lo, hi = (0, 0) if d is None else (int(np.searchsorted(cut, d, s)) for s in ("left", "right"))
                for column, x in zip(rows, (lo + (digest * (hi - lo + 1) >> 64), digest >> 1, np.frombuffer(ids, "<u4").astype(width).tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["doc_id", "shard", "digest", "ids"])
        release()

    def put(batches):
        files, root = open_folder(uri)
        shard = out = None
        try:
            for batch in batches:
                made = []
                for s, d, ids in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(3)):
                    if s != shard:
                        if out is not None:
                            out.close()
                        shard, offset, last, ordinal = s, 0, object(), 0
                        name = f"shard-{s:06d}-{uuid.uuid4().hex}.ids"
                        out = files.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                    ordinal = ordinal + 1 if d == last else 0
                    last, data = d, ids.as_buffer()
                    out.write(data)
                    made.append((d, ordinal, s, offset, data.size // int(width[2]), name))
                    offset += data.size // int(width[2])
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], ["doc_id", "ordinal", "shard", "offset", "n", "file"])
        finally:
            if out is not None:
                out.close()
        release()

    dealt = ship(own).mapInArrow(encode, "doc_id long, shard int, digest long, ids binary").repartitionById(shards, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "digest")
    placed = materialize(dealt.mapInArrow(put, "doc_id long, ordinal long, shard int, offset long, n long, file string"), "ids-catalog")
    at = F.struct("offset", "doc_id", "ordinal")
    # One row a shard: its file and length, and the ids at its ends, by which ordinals go on from shard to shard.
    rows = placed.groupBy("shard").agg(F.first("file").alias("file"), F.sum("n").alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).orderBy("shard").collect()
    start, table, lifts, last, seen = 0, [], [], object(), 0
    for r in rows:
        first = r["a"]["doc_id"]
        lift = seen if first == last else 0
        table.append({"shard": r["shard"], "file": r["file"], "start": start, "n": r["n"]})
        lifts.append((r["shard"], first, lift))
        start, last = start + r["n"], r["b"]["doc_id"]
        seen = r["b"]["ordinal"] + 1 + (lift if first == last else 0)
    _manifest(*open_folder(uri), width=int(width[2]), end_id=end_id, shards=table)
    lifted = F.broadcast(spark.createDataFrame(lifts, "_shard int, _first long, _lift long"))
    same = F.col("doc_id").eqNullSafe(F.col("_first"))
    ordinal = F.col("ordinal") + F.when(same, F.col("_lift")).otherwise(0)
    catalog = placed.join(lifted, F.col("shard") == F.col("_shard")).select("doc_id", ordinal.alias("ordinal"), "shard", "offset", "n")
    return Written(uri, catalog)


def key_hashes(doc_id: Column, ordinal: Column) -> tuple[Column, Column]:
    """Two hashes of a key; ``python_hashes`` gives the same."""
    return F.xxhash64(doc_id, ordinal), F.xxhash64(ordinal, doc_id, F.lit(1).cast("long"))


def python_hashes(doc_id: int | None, ordinal: int) -> tuple[int, int]:
    def chain(*values):
        h = 42
        for v in values:
            h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return h

    return chain(doc_id, ordinal), chain(ordinal, doc_id, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h1 + (h2 | np.uint64(1)) * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


class Perfect:
    """A minimal perfect hash of keys given by two 64-bit hashes: slots 0 to n - 1, each taken once."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        #: Set bits before each level, and within it up to each place.
        self.ranks = [np.cumsum(b, dtype=np.int64) for b in levels]
        self.before = np.concatenate([[0], np.cumsum([r[-1] for r in self.ranks])]).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> Perfect:
        """Keys must differ; any that no level tells apart are listed (two equal keys would be)."""
        levels, left = [], np.arange(len(h1))
        while len(left) and len(levels) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            at = _places(h1[left], h2[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.stack([h1[left], h2[left]], axis=1))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A key's slot; of a key that is not in the set, any slot or -1."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, bits in enumerate(self.levels):
            at = _places(h1[left], h2[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[level] + self.ranks[level][at[hit]] - 1
            left = left[~hit]
        for i, key in enumerate(self.rest):
            out[left[(h1[left] == key[0]) & (h2[left] == key[1])]] = self.before[-1] + i
        return out

    def dump(self) -> bytes:
        head = struct.pack("<II", len(self.levels), len(self.rest)) + b"".join(struct.pack("<Q", len(b)) for b in self.levels)
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels) + self.rest.astype("<u8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> tuple[Perfect, int]:
        """The hash, and how many bytes it took."""
        n, rest = struct.unpack_from("<II", data)
        sizes, at = struct.unpack_from(f"<{n}Q", data, 8), 8 + 8 * n
        levels = []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels, np.frombuffer(data, "<u8", 2 * rest, at).reshape(-1, 2)), at + 16 * rest


def _fingerprint(h2: np.ndarray) -> np.ndarray:
    return (h2 >> np.uint64(32)).astype("<u4")


def _part(parts: int) -> Column:
    """A key's index part, by bits of the second hash that its fingerprint does not hold."""
    return F.pmod(F.col("h2").bitwiseAND(0xFFFFFFFF), F.lit(parts)).cast("int")


def index(written: Written, part_keys: int = PART_KEYS) -> None:
    """Writes the index of the folder's documents."""
    catalog, uri = written.catalog, written.uri
    spark = catalog.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-catalog.count() // part_keys))
    h1, h2 = key_hashes(F.col("doc_id"), F.col("ordinal"))
    keyed = catalog.select(h1.alias("h1"), h2.alias("h2"), "shard", "offset", "n").withColumn("part", _part(parts)).repartitionById(parts, F.col("part"))

    def put(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            a, b = (t.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            perfect = Perfect.build(a, b)
            entries = np.zeros(len(a), ENTRY)
            at = perfect.slots(a, b)
            for name, x in (("print", _fingerprint(b)), *((c, t.column(c).to_numpy()) for c in ("shard", "offset", "n"))):
                entries[name][at] = x
            files, root = open_folder(uri)
            part = t.column("part")[0].as_py()
            name = f"index-{part:06d}-{uuid.uuid4().hex}.mph"
            with files.open_output_stream(f"{root}/{name}") as out:
                hashed = perfect.dump()
                out.write(MAGIC + struct.pack("<Q", len(hashed)) + hashed + entries.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(a)], pa.int64())], ["part", "file", "keys"])
        release()

    # One row an index part.
    made = materialize(ship(keyed).mapInArrow(put, "part int, file string, keys long"), "ids-index").collect()
    _manifest(*open_folder(uri), parts=parts, index=[{"part": r["part"], "file": r["file"], "keys": r["keys"]} for r in made])


def _open_index(files: pafs.FileSystem, path: str) -> tuple[Perfect, np.ndarray]:
    with files.open_input_file(path) as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"{path} is no index")
    (size,) = struct.unpack_from("<Q", data, 8)
    return Perfect.load(data[16 : 16 + size])[0], np.frombuffer(data, ENTRY, offset=16 + size)


def _find(held: tuple[Perfect, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys that the index holds, and their entries."""
    perfect, entries = held
    at = perfect.slots(h1, h2)
    known = at >= 0
    known[known] = entries["print"][at[known]] == _fingerprint(h2[known])
    return np.flatnonzero(known), entries[at[known]]


def lookup(keys: DataFrame, uri: str) -> DataFrame:
    """doc_id, ordinal, shard, offset, n of those keys (doc_id, ordinal) that the folder holds."""
    manifest = _read_manifest(*open_folder(uri))
    names = {x["part"]: x["file"] for x in manifest["index"]}
    h1, h2 = key_hashes(F.col("doc_id"), F.col("ordinal"))
    keyed = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"))
    keyed = keyed.withColumns({"h1": h1, "h2": h2}).withColumn("part", _part(manifest["parts"])).repartitionById(manifest["parts"], F.col("part"))

    def find(batches):
        files, root = open_folder(uri)
        part = held = None
        for batch in batches:
            if not batch.num_rows or (own := batch.column(4)[0].as_py()) not in names:
                continue
            if own != part:
                part, held = own, _open_index(files, f"{root}/{names[own]}")
            at, e = _find(held, *(np.asarray(batch.column(c)).view(np.uint64) for c in (2, 3)))
            found = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [found.column(0), found.column(1), pa.array(e["shard"].astype(np.int32)), pa.array(e["offset"].astype(np.int64)), pa.array(e["n"].astype(np.int64))], ["doc_id", "ordinal", "shard", "offset", "n"]
            )
        del held
        release()

    return ship(keyed).mapInArrow(find, "doc_id long, ordinal long, shard int, offset long, n long")


def read(found: DataFrame, uri: str, finish, schema: str) -> DataFrame:
    """doc_id, start (ids before it in all shards), n, and what ``finish`` makes of the ids of rows as from ``lookup``.

    finish(list of ids, one 32-bit array for each document) -> list of Arrow arrays, the columns of ``schema``. Rows are
    dealt and sorted by place, so that a task reads its files forward.
    """
    manifest = _read_manifest(*open_folder(uri))
    shards, width = {x["shard"]: (x["file"], x["start"]) for x in manifest["shards"]}, manifest["width"]
    names = ["doc_id", "start", "n", *(x.strip().split()[0] for x in schema.split(","))]

    def run(batches):
        files, root = open_folder(uri)
        shard = f = None
        try:
            for batch in small(batches):
                starts, payload = [], []
                for s, offset, n in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                    if s != shard:
                        if f is not None:
                            f.close()
                        shard, f = s, files.open_input_file(f"{root}/{shards[s][0]}")
                    payload.append(np.frombuffer(f.read_at(n * width, offset * width), f"<u{width}").astype("<u4"))
                    starts.append(shards[s][1] + offset)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), batch.column(4), *finish(payload)], names)
        finally:
            if f is not None:
                f.close()
        release()

    dealt = found.repartition("shard", F.floor(F.col("offset") / REGION)).sortWithinPartitions("shard", "offset")
    return ship(dealt).mapInArrow(run, f"doc_id long, start long, n long, {schema}")


class Store:
    """Keyed access to a folder, without Spark: a probe of the index and one read for each document."""

    def __init__(self, uri: str):
        self.files, self.root = open_folder(uri)
        self.manifest = _read_manifest(self.files, self.root)
        self.shards = {x["shard"]: x for x in self.manifest["shards"]}
        self.index = {x["part"]: x["file"] for x in self.manifest["index"]}
        self._open = lru_cache(maxsize=64)(lambda part: _open_index(self.files, f"{self.root}/{self.index[part]}"))

    def get(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        """The ids of a document, or None."""
        h1, h2 = python_hashes(doc_id, ordinal)
        part = (h2 & 0xFFFFFFFF) % self.manifest["parts"]
        if part not in self.index:
            return None
        _, found = _find(self._open(part), np.array([h1], np.uint64), np.array([h2], np.uint64))
        if not len(found):
            return None
        width = self.manifest["width"]
        with self.files.open_input_file(f"{self.root}/{self.shards[int(found['shard'][0])]['file']}") as f:
            return np.frombuffer(f.read_at(int(found["n"][0]) * width, int(found["offset"][0]) * width), f"<u{width}").astype(np.uint32)


def _crc(payload: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([zlib.crc32(x) for x in payload], pa.int64())]


def op12_id_store(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document: its key looked up in the index, its ids read from the shards."""
    written = write(documents(spark, sf_dir), tokenizer or default_tokenizer())
    index(written)
    found = lookup(written.catalog.select("doc_id", "ordinal"), written.uri)
    return read(found, written.uri, _crc, "ids_crc32 long").withColumnRenamed("n", "n_tokens")
