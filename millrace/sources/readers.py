"""Readers. Paths go through Spark's file systems only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .shared import full_uri, key_file, open_folder, ship

START, END = "<|im_start|>", "<|im_end|>"
MESSAGE = "struct<role: string, content: string>"
CHAT = f"messages array<{MESSAGE}>, _source_key string, _style string, _category string, _evol_type string, _base_instr string, _cross_type string"
#: Bytes of pages, about, and rows that a batch holds.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: str = CHAT) -> DataFrame:
    """Strict: a line that is no JSON fails the read. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str = CHAT) -> DataFrame:
    """Lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_quality(spark: SparkSession, path: str, schema: str = CHAT) -> DataFrame:
    """Every line with what is wrong with it: value, valid, and the parsed record."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.withColumn("record", parsed).withColumn("valid", F.col("record").isNotNull() & F.col("record._corrupt").isNull())


def multi_source(spark: SparkSession, sources: list[tuple[str, str]], schema: str = CHAT) -> DataFrame:
    """Sources (tag, path) in order of priority, with _source, _rank and _file; missing paths are skipped."""
    out = None
    for rank, (tag, path) in enumerate(sources):
        if exists(spark, path):
            df = jsonl_tolerant(spark, path, schema).withColumns({"_source": F.lit(tag), "_rank": F.lit(rank), "_file": F.col("_metadata.file_path")})
            out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema + ", _source string, _rank int, _file string")


def preferred(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, else the last."""
    return next((p for p in paths if exists(spark, p)), paths[-1])


def named_splits(spark: SparkSession, paths: dict[str, str], schema: str = CHAT) -> DataFrame:
    out = None
    for name, path in paths.items():
        df = jsonl(spark, path, schema).withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: name and html."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.html?$", 1).alias("name"), F.col("value").alias("html"))


def expected_pages(expected: DataFrame, path: str, keys: list[str], folders: int = 0) -> DataFrame:
    """Every expected row with its page (without white space at its ends), and there: false, with a null page, where none was written.

    The files are those of ``writers.page_files``, in as many folders. A row's key names its file, which the task opens: no folder is listed.
    """
    uri = full_uri(expected.sparkSession, path)

    def page(files, name):
        try:
            with files.open_input_stream(name) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def get(batches):
        files, root = open_folder(uri)
        for batch in batches:
            named, rows = batch.column(batch.num_columns - 1).to_pylist(), batch.drop_columns(["_keys"])
            at, size, found = 0, 0, []
            for i, values in enumerate(named, 1):
                found.append(page(files, f"{root}/{key_file(keys, values, folders)}"))
                size += len(found[-1] or b"")
                if size >= BATCH_BYTES or len(found) == BATCH_ROWS or i == len(named):
                    there = pa.array([x is not None for x in found])
                    part = rows.slice(at, len(found))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x or None for x in found], pa.binary()), there], [*part.schema.names, "_page", "_there"])
                    at, size, found = i, 0, []

    rows = expected.select("*", F.array(*(F.col(k).cast("string") for k in keys)).alias("_keys"))
    schema = T.StructType([*expected.schema.fields, T.StructField("_page", T.BinaryType()), T.StructField("_there", T.BooleanType())])
    return ship(rows).mapInArrow(get, schema).select(*expected.columns, strip(F.col("_page").cast("string")).alias("html"), F.col("_there").alias("there"))


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count() if exists(spark, path) else 0


def by_role(role: str, messages: str = "messages") -> Column:
    """The first message of a role, or nothing."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"], F.lit(""))


def by_position(i: int, messages: str = "messages") -> Column:
    """The message at a place, counted from 1, or from the end if negative."""
    return F.try_element_at(F.col(messages), F.lit(i))["content"]


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and messages in order of the turns; a conversation is as long as its turns, which one row must hold."""
    own = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(own, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def render_chat(messages: str = "messages") -> Column:
    """The messages as one text with role marks."""
    one = lambda m: F.concat(F.lit(START), F.coalesce(m["role"], F.lit("")), F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(END))
    return F.array_join(F.transform(messages, one), "\n")


def reply_spans(messages: str = "messages", role: str = "assistant") -> Column:
    """Where the replies of a role lie in the rendered chat, with their end marks: structs (start, end), in code points.

    Training on replies alone takes these spans for its loss. A fold carries the offset from message to message.
    """
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")

    def step(acc, m):
        begin = acc["at"] + len(START) + size(m["role"]) + 1
        end = begin + size(m["content"]) + len(END)
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(m["role"] == role, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"))
    return F.aggregate(messages, nothing, step, lambda acc: acc["spans"])
