"""Product codes of vectors by a filtering Lloyd iteration.

A vector of integers is cut into PARTS consecutive parts; each part position has a codebook of at most ENTRIES entries, and
a vector's code is the nearest entry of each part. Every task builds kd-trees over the parts of the vectors it reads,
CHUNK vectors a tree, with the sum and the number of the parts below each node, and writes them once. A round walks every
tree with the codebook: at a node the entry nearest to the middle of the node's box is compared with every other one at the
corner of the box that favours the other one most. An entry that loses there is nearest to nothing in the box. Where one
entry is left, it takes the whole subtree by its cached sum and count; else the walk goes on, and leaves compare what is
left with each part. Tasks hand on one row of sums for each entry.

Only codebooks (PARTS x ENTRIES rows) pass through the driver; trees and results are written tables in the shared folder.
All arithmetic is exact: in doubles while every distance stays below 2**53, else in Python's integers.

Edge cases: a vector that is null or holds null or non-finite components takes no part; nor does one whose length differs
from that of the first vector kept (the smallest vec_id). Components are held to +-2**52 after scaling, a result to the
range of a long. A length that PARTS does not divide gives parts of which the first are one longer; an empty vector has
empty parts, all of entry 0. Rows of null vec_id are coded but begin no entry unless there are too few others; repeated
rows count each; of equal vec_ids the lesser vector comes first; fewer rows than ENTRIES give as many entries; an empty
table gives no rows; columns that clash with those added are not looked at.
"""

from __future__ import annotations

import hashlib
import io
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, ship

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
CHUNK = 4096
LEAF = 32
MOST = 1 << 52
LONG = (1 << 63) - 1
TREES = "trees binary"


def scaled_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the vector as integers floor(scale * x); only rows that take part."""
    x = F.col(vector).cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c * scale).cast("long"))))
    return df.filter(sound).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def cuts(size: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its length."""
    return [0, *np.cumsum([size // parts + (i < size % parts) for i in range(parts)]).tolist()]


def _kind(points: np.ndarray, other: int = 0):
    """The type in which distances between components of up to these magnitudes are exact."""
    most = max(int(abs(points).max(initial=0)), other)
    return np.float64 if 16 * most * most * max(1, points.shape[1]) < 2**53 else object


class Tree:
    """A kd-tree over rows of integers. Node i holds the rows order[start[i]:end[i]]; its children, if any, follow as left[i] and right[i]."""

    NAMES = ("points", "order", "start", "end", "left", "right", "low", "high", "total")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(points))
        nodes, todo = [], [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            at = len(nodes)
            nodes.append([a, b, -1, -1, low, high, own.astype(object).sum(axis=0) if MOST // 4 < abs(own).max(initial=0) else own.sum(axis=0)])
            if parent >= 0:
                nodes[parent][2 + side] = at
            wide = (high - low).argmax() if len(low) else 0
            if b - a > leaf and len(low) and high[wide] > low[wide]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], middle)]
                todo += [(a, a + middle, at, 0), (a + middle, b, at, 1)]
        columns = list(zip(*nodes))
        return cls(points=points[order], order=order, **{n: np.array(c) for n, c in zip(cls.NAMES[2:], columns)})

    def walk(self, book: np.ndarray, subtree, rest) -> None:
        """subtree(node, entry) for nodes that one entry takes whole; rest(node, entries, entry of each row) for leaves."""
        kind = _kind(self.points, int(abs(book).max(initial=0)))
        points, low, high, book = (x.astype(kind) for x in (self.points, self.low, self.high, book))
        todo = [(0, np.arange(len(book)))] if len(points) else []
        while todo:
            node, left = todo.pop()
            if len(left) > 1:
                left = self._filter(low[node], high[node], book, left)
            if len(left) == 1:
                subtree(node, int(left[0]))
            elif self.left[node] >= 0:
                todo += [(self.left[node], left), (self.right[node], left)]
            else:
                own = points[self.start[node] : self.end[node]]
                d = ((own[:, None, :] - book[left][None, :, :]) ** 2).sum(axis=2)
                rest(node, left[d.argmin(axis=1)])

    @staticmethod
    def _filter(low, high, book, left):
        """The entries that may be nearest to something in the box; entries ascend, so argmin takes the lowest of equals."""
        own = book[left]
        best = ((2 * own - (low + high)) ** 2).sum(axis=1).argmin()
        star = own[best]
        corner = np.where(own > star, high, low)
        mine, other = ((own - corner) ** 2).sum(axis=1), ((star - corner) ** 2).sum(axis=1)
        loses = (mine > other) | ((mine == other) & (left > left[best]))
        loses[best] = False
        return left[~loses.astype(bool)]


def _dump(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: v.astype(str) if v.dtype == object else v for k, v in arrays.items()})
    return out.getvalue()


def _load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {k: np.array([int(x) for x in held[k].ravel()], object).reshape(held[k].shape) if held[k].dtype.kind == "U" else held[k] for k in held.files}


def _trees(data: bytes) -> list[Tree]:
    held = _load(data)
    return [Tree(**{n: held[f"{p}_{n}"] for n in Tree.NAMES}) for p in range(len(held) // len(Tree.NAMES))]


def trees(vectors: DataFrame, size: int, parts: int = PARTS) -> DataFrame:
    """vec_id, label (lists of a chunk's rows) and its trees, one for each part; vectors are of one size."""
    at = cuts(size, parts)

    def build(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(begin, CHUNK)
                m = np.asarray(piece.column(2).flatten()).reshape(piece.num_rows, size)
                held = {f"{p}_{n}": getattr(t, n) for p in range(parts) for t in [Tree.build(m[:, at[p] : at[p + 1]])] for n in Tree.NAMES}
                lists = [pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), c) for c in (piece.column(0), piece.column(1))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([_dump(held)], pa.binary())], ["vec_id", "label", "trees"])
        release()

    kinds = dict(vectors.dtypes)
    own = ship(vectors).select("vec_id", "label", "v")
    return own.mapInArrow(build, f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, {TREES}")


def _sums(books):
    """A task's sums and counts of each part and entry."""

    def run(batches):
        own = [np.zeros(b.shape, object) for b in books.value]
        counts = [np.zeros(len(b), np.int64) for b in books.value]
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for p, tree in enumerate(_trees(data)):

                    def subtree(node, entry, p=p, tree=tree):
                        own[p][entry] += tree.total[node].astype(object)
                        counts[p][entry] += tree.end[node] - tree.start[node]

                    def rest(node, entries, p=p, tree=tree):
                        a, b = tree.start[node], tree.end[node]
                        np.add.at(own[p], entries, tree.points[a:b].astype(object))
                        counts[p] += np.bincount(entries, minlength=len(counts[p]))

                    tree.walk(books.value[p], subtree, rest)
        rows = [(p, e, int(c), [Decimal(int(x)) for x in own[p][e]]) for p in range(len(own)) for e, c in enumerate(counts[p]) if c]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "entry", "n", "sums"])

    return run


def lloyd(held: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after the rounds; ``held`` is a written table of ``trees``."""
    spark = held.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        sums = ship(held).select("trees").mapInArrow(_sums(sent), "part int, entry int, n long, sums array<decimal(38,0)>")
        width = max((b.shape[1] for b in books), default=0)
        each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
        books = [b.copy() for b in books]
        # At most PARTS * ENTRIES rows.
        for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
            books[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(books[row["part"]].shape[1])]
        sent.destroy()
    return books


def assign(held: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector."""
    spark = held.sparkSession
    sent = spark.sparkContext.broadcast(books)
    kinds = {k: v[len("array<") : -1] for k, v in held.dtypes if k != "trees"}

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(2).to_pylist()):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                code, error = np.full(len(ids), "", object), np.zeros(len(ids), object)
                for p, tree in enumerate(_trees(data)):
                    entry = np.zeros(len(ids), np.int64)

                    def subtree(node, e, tree=tree, entry=entry):
                        entry[tree.start[node] : tree.end[node]] = e

                    def rest(node, entries, tree=tree, entry=entry):
                        entry[tree.start[node] : tree.end[node]] = entries

                    book = sent.value[p]
                    tree.walk(book, subtree, rest)
                    kind = _kind(tree.points, int(abs(book).max(initial=0)))
                    d = ((tree.points.astype(kind) - book[entry].astype(kind)) ** 2).sum(axis=1)
                    error[tree.order] += [int(x) for x in d]
                    code[tree.order] += np.array([f"{e:02x}" for e in entry], object)
                errors = pa.array([min(int(e), LONG) for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), errors], ["vec_id", "label", "code", "error"])
        release()

    return ship(held).select("vec_id", "label", "trees").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of vectors as from ``scaled_vectors``, as a written table; and the codebooks."""
    # ENTRIES rows at most.
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    size = len(first[0]["v"]) if first else 0
    own = vectors.filter(F.size("v") == size)
    seeds = own.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    at = cuts(size, parts)
    m = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), size)
    held = materialize(trees(own, size, parts), "trees")
    books = lloyd(held, [m[:, a:b] for a, b in zip(at, at[1:])], rounds if seeds else 0)
    return materialize(assign(held, books), "codes"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors of equal labels together (nulls are one label), held to the range of a long."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(LONG)).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector of embeddings."""
    coded, books = encode(scaled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same rows by comparing every part with every entry, round after round."""
    d = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings"
        " WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))",
        "p AS MATERIALIZED (SELECT r, label, i AS part, list_slice(w, i * len(w) // 4 + 1, (i + 1) * len(w) // 4) AS x FROM k, range(4) t(i))",
        "b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 256)",
    ]
    near = "SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, p.part, entry, {d} AS d FROM p JOIN {b} b ON p.part = b.part) GROUP BY 1, 2"
    for n in range(ROUNDS):
        steps += [
            f"a{n} AS MATERIALIZED ({near.format(d=d, b=f'b{n}')})",
            f"u{n} AS (SELECT part, entry, list(m ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS m FROM a{n} JOIN p USING (r, part), range(1, len(x) + 1) t(i) GROUP BY ALL) GROUP BY 1, 2)",
            f"b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u.c, b.c) AS c FROM b{n} b LEFT JOIN u{n} u USING (part, entry))",
        ]
    steps += [
        f"a AS MATERIALIZED ({near.format(d=d, b=f'b{ROUNDS}')})",
        "e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY 1)",
        f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN e USING (r), h"
