"""Writers of records and reports."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import exists
from .shared import full_uri, key_file, open_folder, ship


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def routed(df: DataFrame, passed: str, kept: str, rejected: str) -> None:
    """Both outputs of a verdict in one pass over df: one write, partitioned by the verdict, read twice, then removed.

    A null verdict is a rejection.
    """
    staged, spark = kept.rstrip("/") + "_routed", df.sparkSession
    verdict = df.withColumn(passed, F.coalesce(passed, F.lit(False)))
    verdict.write.mode("overwrite").partitionBy(passed).parquet(staged)
    back = spark.read.schema(verdict.schema).parquet(staged)
    jsonl(back.filter(F.col(passed)).drop(passed), kept)
    jsonl(back.filter(~F.col(passed)).drop(passed), rejected)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header whose first name carries a byte order mark, as spreadsheets want it."""
    first, *rest = df.columns
    named = df.select(F.col(first).alias("﻿" + first if bom else first), *rest)
    named.write.mode("overwrite").csv(path, header=True)


def json_report(df: DataFrame) -> str:
    """A one-row frame as indented JSON."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("j")).first()["j"]


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a Markdown table."""
    rows = [["" if x is None else str(x) for x in r] for r in df.limit(most).collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def page_files(df: DataFrame, path: str, html: str = "html", by: tuple[str, ...] = ("tag", "version"), folders: int = 0) -> None:
    """A file for each page, named by its key, in a folder of its own or in so many folders; keys differ from row to row.

    Folders take as much disk as short pages: with many pages, give a number.

    Tasks write the files themselves, so that neither a job's commit nor the driver handles each of them. A file gets its
    name when it is whole. A page ends with a line end; a null page is an empty file.
    """
    spark, keys = df.sparkSession, list(by)
    uri = full_uri(spark, path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hadoop.delete(folder, True)
    hadoop.mkdirs(folder)

    def put(batches):
        files, root = open_folder(uri)
        made = set()
        for batch in batches:
            for values, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = f"{root}/{key_file(keys, values, folders)}"
                parent = own.rsplit("/", 1)[0]
                if parent not in made:
                    files.create_dir(parent)
                    if folders:
                        made.add(parent)
                name = f"{parent}/_{uuid.uuid4().hex}"
                with files.open_output_stream(name, buffer_size=None) as out:
                    if page.is_valid:
                        out.write(page.as_py() + b"\n")
                try:
                    files.move(name, own)
                except OSError:
                    # Some file systems keep the file that another attempt at this task has written.
                    if not files.get_file_info(own).is_file:
                        raise
                    files.delete_file(name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = df.select(F.array(*(F.col(k).cast("string") for k in keys)).alias("keys"), F.col(html).cast("binary").alias("page"))
    ship(rows).mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def shards(df: DataFrame, path: str, order: list, by: str | None = None, files: int | None = None) -> None:
    """JSON lines in files whose names and lines follow the order, in a folder for each value of ``by``."""
    keys = [by, *order] if by else order
    dealt = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    writer = dealt.sortWithinPartitions(*keys).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def append_new(df: DataFrame, path: str, key: str, run: str) -> None:
    """Adds the rows whose key no other run has written, as run ``run``: a folder of the output for each run.

    The output is its own ledger. A run that is repeated, or was cut off, writes its folder anew as a whole, and adds
    nothing to what it has written already; a folder stands only when its run has ended. A null key is a key.
    """
    spark = df.sparkSession
    new = df.withColumn("_run", F.lit(run))
    if exists(spark, path.rstrip("/") + "/_run=*"):
        held = spark.read.schema(new.schema).json(path).filter(F.col("_run") != run).select(F.col(key).alias("_key"))
        new = new.join(held, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run").json(path)
