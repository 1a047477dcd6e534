"""Byte-level BPE by a distinct-word table.

Encoding never runs the merges over a running text. The corpus is split into words (the pre-tokenizer's rule), and each
distinct word is encoded once. The table of distinct words has two parts:

* the head, the words that are most frequent in a sample of SAMPLE_DOCS documents, cut by count so that at most
  HEAD_WORDS words and HEAD_BYTES bytes remain. It is broadcast; its size is bounded whatever the corpus holds, and
  which words it has changes no result, only how much is left for the second part;
* the rest, every other distinct word of the corpus, kept in a distributed table. Its ids come back by a shuffle join
  on the word and then by position: keyed by a hash of the document's id and text and by the word's place among the
  document's own rare words. Two documents of one hash get more places than they have such words; theirs are encoded anew.

Texts are shuffled once, compressed, and only their rare words besides. Decoding takes every id from the id-to-piece
table (as many rows as the vocabulary).

Edge cases: null text counts as empty (no ids); a special token's string in a text becomes its id, as in the
tokenizers library; repeated rows each give a row; null ids are kept; words that are as frequent as others at the head's
border go by count together; very long texts are split run by run; an empty table gives an empty result; other columns of
the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, release, ship, small, use_cache

SAMPLE_DOCS = 50_000
HEAD_WORDS = 400_000
HEAD_BYTES = 16 << 20
DICTIONARY_WORDS, DICTIONARY_BYTES = 20_000, 200_000
#: Distinct words a task holds before it hands its counts on.
FLUSH_WORDS = 300_000
#: Texts longer than this are split in runs of about this length, at places that are word ends anyway.
RUN_CHARS = 1 << 20

# The pre-tokenizer's pattern, once for all of Unicode and once with its classes written out for Latin-1.
FULL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_L, LATIN_N, LATIN_S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PATTERN = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_L}]+| ?[{LATIN_N}]+| ?[^{LATIN_S}{LATIN_L}{LATIN_N}]+"
    f"|[{LATIN_S}]+(?![^{LATIN_S}])|[{LATIN_S}]+"
)
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")


class Splitter:
    """Splits a text into the words of a byte-level pre-tokenizer; joined again they are the text."""

    def __init__(self, specials: tuple[str, ...] = ()):
        import regex

        self.latin, self.full = re.compile(LATIN_PATTERN).findall, regex.compile(FULL_PATTERN).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def _plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.full(text)
        return self.latin(text)

    def runs(self, text: str) -> Iterator[list[str]]:
        if self.specials and (parts := self.specials.split(text))[1:]:
            for i, part in enumerate(parts):
                if i % 2:
                    yield [part]
                elif part:
                    yield from self._runs(part)
        else:
            yield from self._runs(text)

    def _runs(self, text: str) -> Iterator[list[str]]:
        at = 0
        while len(text) - at > RUN_CHARS and (m := _CUT.search(text, at + RUN_CHARS)):
            yield self._plain(text[at : m.start()])
            at = m.start()
        yield self._plain(text[at:] if at else text)


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are supported")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.splitter = Splitter(tuple(self.special))

    def piece(self, token: str) -> bytes:
        return bytes(self.to_byte[c] for c in token)

    def pieces(self) -> list[bytes]:
        """The id-to-piece table, as a list by id."""
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        out = [b""] * size
        for token, i in self.vocab.items():
            out[i] = self.piece(token)
        for token, i in self.special.items():
            out[i] = token.encode()
        return out

    def merger(self):
        """bytes of one word -> ids, by tiktoken's core (ids of a byte-level vocabulary are in merge order)."""
        import tiktoken

        ranks = {self.piece(k): v for k, v in self.vocab.items()}
        order = {b: i for i, b in enumerate(sorted(ranks, key=ranks.get))}
        at = sorted(ranks.values())
        core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=order, special_tokens={})._core_bpe
        same = at == list(range(len(at)))
        return (lambda b: core.encode_single_piece(b)) if same else (lambda b: [at[i] for i in core.encode_single_piece(b)])


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One Vocabulary per process and file."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _ids_bytes(ids) -> bytes:
    return array("I", ids).tobytes()


def word_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(word, n): every distinct word of all texts with its number of occurrences. Tasks count before the shuffle."""

    def count(batches):
        split, seen = vocabulary(tokenizer).splitter, Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for words in split.runs(t or ""):
                    seen.update(words)
                if len(seen) > FLUSH_WORDS:
                    yield flush(seen)
                    seen = Counter()
        yield flush(seen)
        del seen
        release()

    def flush(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return ship(docs).select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, tokenizer: str, placed: bool = False) -> DataFrame:
    """The columns of words besides ``word``, and ids: little-endian unsigned 32-bit.

    Rows of a word must follow each other in one partition; each distinct word is then encoded once. With ``placed``,
    the columns key and at become key and place: at in 4 bytes, then the ids, in 16 bits each where the vocabulary
    allows it, as one narrow value.
    """
    names = ["key"] if placed else [c for c in words.columns if c != "word"]
    to = "place" if placed else "ids"

    def encode(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        t, special = Tokenizer.from_file(tokenizer), vocabulary(tokenizer).special
        t.no_truncation()
        t.no_padding()
        last: dict[str, bytes] = {}
        width = "<u2" if len(_pieces(tokenizer)) <= 1 << 16 else "<u4"
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                coded = part.column("word").dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                new = [w for w in distinct if w not in last]
                last |= {w: _ids_bytes([special[w]] if w in special else e.ids) for w, e in zip(new, t.encode_batch_fast(new, add_special_tokens=False))}
                ids = pa.array([last[w] for w in distinct], pa.binary()).take(coded.indices)
                last = {distinct[-1]: last[distinct[-1]]}
                if placed:
                    at = np.asarray(part.column("at")).astype("<u4")
                    ids = pa.array([at[k].tobytes() + np.frombuffer(x, "<u4").astype(width).tobytes() for k, x in enumerate(ids.to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), ids], [*names, to])
        del t, last
        release()

    kinds = dict(words.dtypes)
    return ship(words).mapInArrow(encode, ", ".join([*(f"{c} {kinds[c]}" for c in names), f"{to} binary"]))


def head_count(words: DataFrame, most_words: int, most_bytes: int) -> int:
    """The least count n so that the words counted n times or more stay within both bounds.

    Read from a histogram of counts on a logarithmic scale, of some hundred rows.
    """
    rows = (
        words.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("b"))
        .agg(F.count("*").alias("k"), F.sum(F.octet_length("word")).alias("bytes"))
        .collect()
    )
    k = size = 0
    least = 1 << 62
    for r in sorted(rows, key=lambda r: -r["b"]):
        k, size = k + r["k"], size + r["bytes"]
        if k > most_words or size > most_bytes:
            break
        least = math.ceil(round(2 ** (r["b"] / 4), 9))
    return least


_heads: dict[str, dict[str, bytes]] = {}


def _head(name: str, packed) -> dict[str, bytes]:
    """The head in this worker, unpacked once. A plain dict: a set's difference() looks words up in nothing else."""
    use_cache("bpe", _heads.clear)
    if name not in _heads:
        _heads.clear()
        table = pa.ipc.open_stream(packed.value[0]).read_all()
        _heads[name] = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
    return _heads[name]


def head_words(docs: DataFrame, tokenizer: str, text: str = "text") -> tuple[bytes, bytes]:
    """The head, (word, ids), as an Arrow stream; and its most frequent words, in which texts are compressed better."""
    n = docs.count()
    sample = docs.select(text).sample(min(1.0, SAMPLE_DOCS / max(n, 1)), seed=7)
    counts = materialize(word_counts(sample, tokenizer, text).filter("n > 1"), "bpe-sample")
    top = counts.filter(F.col("n") >= head_count(counts, HEAD_WORDS, HEAD_BYTES))
    table = encode_words(top.select("word", F.col("word").alias("head"), "n"), tokenizer).toArrow().sort_by([("n", "descending"), ("head", "ascending")])
    frequent = "".join(reversed(table.column("head").slice(0, DICTIONARY_WORDS).to_pylist())).encode()[-DICTIONARY_BYTES:]
    table = table.drop_columns("n")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes(), frequent


def _zstd(packed, level: int = 6):
    """(compress, decompress) of texts, with the head's most frequent words as a dictionary."""
    import zstandard

    if not packed.value[1]:
        return zstandard.ZstdCompressor(level=level).compress, zstandard.ZstdDecompressor().decompress
    words = zstandard.ZstdCompressionDict(packed.value[1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level)
    return zstandard.ZstdCompressor(level=level, dict_data=words).compress, zstandard.ZstdDecompressor(dict_data=words).decompress


def encode_documents(docs: DataFrame, tokenizer: str, finish, schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text through the distinct-word table; ``finish`` makes the columns of ``schema``.

    finish(texts' ids: list of bytes, one for each document) -> list of Arrow arrays.
    """
    spark = docs.sparkSession
    packed_head = spark.sparkContext.broadcast(head_words(docs, tokenizer, text))
    name = uuid.uuid4().hex
    keyed = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(doc_id, text).alias("key"))

    def rare(batches):
        split, known = vocabulary(tokenizer).splitter, _head(name, packed_head)
        for batch in small(batches):
            own = [sorted(set().union(*map(set, split.runs(t))).difference(known)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.string()))], ["key", "words"])
        release()

    placed = ship(keyed).select("key", "text").mapInArrow(rare, "key long, words array<string>").select("key", F.posexplode("words").alias("at", "word"))
    # No word of the rest is frequent (frequent ones are in the head), so dealing by the word is even.
    dealt = encode_words(placed.repartition("word").sortWithinPartitions("word"), tokenizer, placed=True)
    tail = dealt.groupBy("key").agg(F.collect_set("place").alias("tail"))

    def pack(batches):
        compress, _ = _zstd(packed_head)
        for batch in small(batches):
            packed = pa.array([compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2)], ["id", "packed", "key"])
        release()

    def join(batches):
        merge, special = vocabulary(tokenizer).merger(), vocabulary(tokenizer).special
        split, known, (_, decompress) = vocabulary(tokenizer).splitter, _head(name, packed_head), _zstd(packed_head)
        get, width = known.__getitem__, "<u2" if len(_pieces(tokenizer)) <= 1 << 16 else "<u4"
        for batch in small(batches):
            ids = []
            for packed, tail in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = [w for run in split.runs(decompress(packed).decode()) for w in run]
                rare_words = sorted(set(words).difference(known))
                if len(tail or ()) == len(rare_words):
                    own = {int.from_bytes(x[:4], "little"): np.frombuffer(x, width, offset=4).astype("<u4").tobytes() for x in tail or ()}
                    rest = {w: own[i] for i, w in enumerate(rare_words)}
                else:
                    rest = {w: _ids_bytes([special[w]] if w in special else merge(w.encode())) for w in rare_words}
                known.update(rest)
                ids.append(b"".join(map(get, words)))
                for w in rest:
                    del known[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), *finish(ids)], names)
        release()

    id_type = dict(docs.dtypes)[doc_id]
    names = [doc_id, *(x.strip().split()[0] for x in schema.split(","))]
    return (
        ship(keyed).mapInArrow(pack, f"id {id_type}, packed binary, key long")
        .join(tail, "key", "left")
        .select("id", "packed", "tail")
        .mapInArrow(join, f"{doc_id} {id_type}, {schema}")
    )


def decode(ids: list[bytes], pieces: pa.Array) -> list[bytes]:
    """Each list of ids as the UTF-8 of its text: pieces taken from the id-to-piece table, then joined.

    Bytes that are no UTF-8 become replacement characters, as in the library.
    """
    if not ids:
        return []
    taken = pieces.take(pa.Array.from_buffers(pa.uint32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))]))
    ends = np.frombuffer(taken.buffers()[1], np.int64)
    raw = taken.buffers()[2].to_pybytes() if taken.buffers()[2] else b""
    at = ends[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])].tolist() if len(taken) else [0] * (len(ids) + 1)
    return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(at, at[1:])]


def op9_bpe(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    tokenizer = tokenizer or default_tokenizer()

    def finish(ids):
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in decode(ids, _pieces(tokenizer))], pa.string()),
        ]

    return encode_documents(documents(spark, sf_dir), tokenizer, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")


_tables: dict[str, pa.Array] = {}


def _pieces(tokenizer: str) -> pa.Array:
    if tokenizer not in _tables:
        _tables[tokenizer] = pa.array(vocabulary(tokenizer).pieces(), pa.large_binary())
    return _tables[tokenizer]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
