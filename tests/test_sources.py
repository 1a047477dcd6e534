import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, writers

GOOD = {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "做"}, {"role": "assistant", "content": "<p>"}], "_style": "a"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(GOOD, ensure_ascii=False) + "\n\n" + json.dumps(GOOD) + "\n")
    (tmp_path / "b.shard1.jsonl").write_text("{bad\n" + json.dumps({"messages": []}) + "\n")
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.shard*.jsonl")
    assert readers.jsonl(spark, a).count() == 2 and readers.line_count(spark, a) == 3 and readers.line_count(spark, a + "x") == 0
    assert readers.jsonl_quality(spark, b).agg(F.count("*"), F.count_if("valid")).first()[0:2] == (2, 1)
    both = readers.multi_source(spark, [("a", a), ("gone", a + "x"), ("b", b)])
    assert {r["_rank"] for r in both.collect()} == {0, 2}
    got = readers.jsonl(spark, a).select(readers.by_role("user").alias("u"), readers.by_position(-1).alias("l"), readers.by_position(9).alias("n"), readers.by_role("tool").alias("t")).first()
    assert tuple(got) == ("做", "<p>", None, "")
    assert readers.preferred(spark, a + "x", a) == a and readers.named_splits(spark, {"train": a, "val": a}).groupBy("split").count().count() == 2
    (tmp_path / "doc.json").write_text('[{"step": 1,\n "loss": 2.0}, {"step": 2, "eval_loss": 1.0}]')
    assert readers.json_document(spark, str(tmp_path / "doc.json")).filter("loss is null").count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "做", True), (2, "b", False)], "i int, t string, ok boolean")
    unsure = df.withColumn("ok", F.when(F.col("i") == 1, F.lit(True)))
    writers.routed(unsure, "ok", str(tmp_path / "sure"), str(tmp_path / "unsure"))
    assert spark.read.json(str(tmp_path / "unsure")).count() == 1 and not (tmp_path / "sure_routed").exists()
    writers.routed(df, "ok", str(tmp_path / "kept"), str(tmp_path / "rejected"))
    assert [r["i"] for r in spark.read.json(str(tmp_path / "kept")).collect()] == [1] and [r["i"] for r in spark.read.json(str(tmp_path / "rejected")).collect()] == [2]
    writers.jsonl(df, str(tmp_path / "kept"), append=True)
    assert spark.read.json(str(tmp_path / "kept")).count() == 3
    writers.csv(df.coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfi,t,ok")
    assert json.loads(writers.json_report(df.limit(1)))["t"] == "做" and writers.markdown(df.orderBy("i")).splitlines()[2] == "| 1 | 做 | True |"
    writers.page_files(df.select(F.lit("<p>").alias("html"), F.lit("c1").alias("tag"), F.lit("v1").alias("version")).limit(1), str(tmp_path / "pages"))
    assert readers.pages(spark, str(tmp_path / "pages" / "tag=c1" / "version=v1")).first()["html"].strip() == "<p>"


@pytest.mark.parametrize("folders", [0, 2])
def test_page_files(spark, tmp_path, folders):
    """Keys of any text, pages of several lines and null ones; tasks write the files, so no job's commit moves each of them."""
    pages = [("a/b", "v=1", " <p>\n做\r\n</p>\n\n"), ("", "%", "x"), (None, "v", "y"), ("__none", "v", None), ("empty", "v", ""), ("é 1", None, "z" * 100000)]
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(pages)], "tag string, version string, body string, i long")
    path = str(tmp_path / "pages%20 é")
    writers.page_files(df.limit(1), path, "body", folders=folders)
    writers.page_files(df.filter("i > 0"), path, "body", folders=folders)
    assert len(list((tmp_path / "pages%20 é").rglob("*.html"))) == 5 and not list((tmp_path / "pages%20 é").rglob("*.crc"))
    if folders:
        assert len([p for p in (tmp_path / "pages%20 é").rglob("*") if p.is_dir()]) <= 2
    expected = df.select("i", "tag", "version").unionByName(spark.createDataFrame([(9, "a", "b")], "i long, tag string, version string"))
    got = readers.expected_pages(expected, path, ["tag", "version"], folders)
    assert got.columns == ["i", "tag", "version", "html", "there"] and expected.columns == ["i", "tag", "version"]
    want = {(0, None, False), (1, "x", True), (2, "y", True), (3, None, True), (4, "", True), (5, "z" * 100000, True), (9, None, False)}
    assert {(r["i"], r["html"], r["there"]) for r in got.collect()} == want
    writers.page_files(df, path, "body", folders=folders)
    assert readers.expected_pages(expected, path, ["tag", "version"], folders).filter("i = 0").first()["html"] == "<p>\n做\r\n</p>"


def test_page_files_are_neither_listed_nor_committed(spark, tmp_path):
    """The jobs of a thousand pages are as few as those of one; no folder of theirs is listed."""
    path = str(tmp_path / "many")
    writers.page_files(spark.range(1000).select(F.col("id").alias("tag"), F.lit("v").alias("version"), F.lit("<p>").alias("html")), path)
    got = readers.expected_pages(spark.range(1001).select(F.col("id").alias("tag"), F.lit("v").alias("version")), path, ["tag", "version"])
    assert got.inputFiles() == [] and "Join" not in got._jdf.queryExecution().toString()
    assert got.filter("there").count() == 1000
