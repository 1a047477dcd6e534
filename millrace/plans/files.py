"""Queries that write the standard tables in the formats of the pipeline and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import plan as P
from ..operators import report as R
from ..sources import readers, shared, writers
from .curation import ATTEMPTS, BEST, EVENT_LINES, _attempts
from .pages import TEN
from .registry import SQL, query
from .texts import SPLIT, STRIP, _split

def _chat(d: DataFrame) -> DataFrame:
    """Documents as chat records."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return d.select(F.array(turn("system", F.col("source")), turn("user", F.col("lang")), turn("assistant", F.col("text"))).alias("messages"), F.col("doc_id").cast("string").alias("_source_key"), F.col("lang").alias("_style"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc, coalesce(source, '') AS system, coalesce(lang, '') AS asked, md5(text) AS answer_md5 FROM documents")
def read_strict(t):
    d = t("documents")
    path = shared.scratch(d.sparkSession, "chat")
    writers.jsonl(_chat(d), path)
    back = readers.jsonl(d.sparkSession, path)
    return back.select(F.col("_source_key").alias("doc"), readers.by_role("system").alias("system"), readers.by_role("user").alias("asked"), F.md5(readers.by_position(-1)).alias("answer_md5"))


@query(f"{EVENT_LINES} SELECT CAST(event_id AS VARCHAR) AS event FROM l WHERE k <> 0")
def read_tolerant(t):
    e = t("events")
    path = shared.scratch(e.sparkSession, "broken")
    whole = F.to_json(F.struct(F.col("event_id").cast("string").alias("_source_key")))
    # Every seventh line is cut, and a blank one follows each third.
    cut = F.when(F.col("event_id") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    e.select(F.concat(cut, F.when(F.col("event_id") % 3 == 0, F.lit("\n")).otherwise("")).alias("value")).write.text(path)
    return readers.jsonl_tolerant(e.sparkSession, path).filter("_source_key IS NOT NULL").select(F.col("_source_key").alias("event"))


@query("SELECT 'src' || doc_id % 3 AS part, doc_id % 3 * 2 AS rank, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY ALL")
def read_sources(t):
    d = t("documents")
    spark, path = d.sparkSession, shared.scratch(d.sparkSession, "shards")
    _chat(d).withColumn("part", F.col("_source_key").cast("long") % 3).repartition(6).write.partitionBy("part").json(path)
    # Two of five sources are not there; the others are folders of shards.
    sources = [(f"src{k // 2}", f"{path}/part={k // 2 if k % 2 == 0 else 99}/part-*.json") for k in range(5)]
    rows = readers.multi_source(spark, sources)
    return rows.groupBy(F.col("_source").alias("part"), F.col("_rank").cast("long").alias("rank")).agg(F.count("*").alias("n"), F.sum(F.col("_source_key").cast("long")).alias("ids"))


#: Folders that hold page files.
PAGE_FOLDERS = 256


@query(f"SELECT page_id AS tag, 'v' || page_id % 2 AS version, page_id % 5 <> 0 AS there, CASE WHEN page_id % 5 <> 0 THEN md5({STRIP.format('html')}) END AS html_md5 FROM pages")
def read_expected_pages(t):
    p = t("pages").select(F.col("page_id").alias("tag"), F.concat(F.lit("v"), (F.col("page_id") % 2).cast("string")).alias("version"), "html")
    path = shared.scratch(p.sparkSession, "pages")
    writers.page_files(p.filter("tag % 5 <> 0"), path, folders=PAGE_FOLDERS)
    got = readers.expected_pages(p.select("tag", "version"), path, ["tag", "version"], PAGE_FOLDERS)
    return got.select("tag", "version", "there", F.md5("html").alias("html_md5"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, max_by(role, turn) AS last FROM conversations GROUP BY 1")
def read_documents_of_json(t):
    c = t("conversations")
    path = shared.scratch(c.sparkSession, "json")
    # A document is an array of the records of at most 64 conversations.
    rows = c.groupBy(F.floor(F.col("conv_id") / 64).alias("b")).agg(F.to_json(F.collect_list(F.struct("conv_id", "turn", "role", "text")), {"pretty": "true"}).alias("value"))
    rows.select("b", "value").repartition("b").write.partitionBy("b").text(path)
    back = readers.json_document(c.sparkSession, path + "/*")
    return back.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.max_by("role", "turn").alias("last"))


@query("SELECT 'src' || k AS part, (SELECT count(*) FROM documents WHERE doc_id % 3 = k) AS n FROM range(4) r(k)")
def line_counts(t):
    d = t("documents")
    spark, path = d.sparkSession, shared.scratch(d.sparkSession, "counted")
    _chat(d).withColumn("part", F.col("_source_key").cast("long") % 3).write.partitionBy("part").json(path)
    # A count for each file of a fixed list; the last one is not there.
    return spark.createDataFrame([(f"src{k}", readers.line_count(spark, f"{path}/part={k}")) for k in range(4)], "part string, n long")


@query(f"{SPLIT}, j AS (SELECT split, length(text) AS n FROM documents JOIN s ON md5(text) = h WHERE split <> 'test') SELECT split, count(*) AS rows, CAST(sum(n) AS BIGINT) AS chars FROM j WHERE split <> 'train' OR n <= 4096 GROUP BY 1")
def read_named_splits(t):
    d = t("documents")
    spark, path = d.sparkSession, shared.scratch(d.sparkSession, "splits")
    rows = _chat(d).withColumn("h", F.md5(readers.by_position(-1))).join(_split(t).select("h", "split"), "h").drop("h")
    rows.write.partitionBy("split").json(path)
    # Of train there is a filtered file, which goes before the whole one; of val there is none.
    spark.read.schema(readers.CHAT).json(f"{path}/split=train").filter(F.length(readers.by_position(-1)) <= 4096).write.json(f"{path}/filtered=train")
    chosen = {k: readers.preferred(spark, f"{path}/filtered={k}", f"{path}/split={k}") for k in ("train", "val")}
    back = readers.named_splits(spark, chosen)
    return back.groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.length(readers.by_position(-1))).alias("chars"))


#: Pages of fewer of the ten points are rejected.
LEAST_TEN = 4


@query(f"WITH g AS ({SQL['page_score_10']}) SELECT total >= {LEAST_TEN} AS kept, count(*) AS n, md5(string_agg(md5(url), '' ORDER BY page_id)) AS urls FROM g JOIN pages USING (page_id) GROUP BY 1")
def routed_pages(t):
    # A verdict that is null is a rejection.
    ten = F.aggregate(F.array(*(F.col(f"s.{k}") for k in TEN)), F.lit(0).cast("long"), lambda a, x: a + x)
    p = H.derive(t("pages")).withColumn("s", H.ten_points()).select("page_id", "url", F.when(ten >= LEAST_TEN, F.lit(True)).alias("passed"))
    spark, path = p.sparkSession, shared.scratch(p.sparkSession, "routed")
    writers.routed(p, "passed", f"{path}/kept", f"{path}/rejected")
    read = lambda side, kept: spark.read.schema("page_id long, url string").json(f"{path}/{side}").withColumn("kept", F.lit(kept))
    rows = read("kept", True).unionByName(read("rejected", False))
    # A digest of each side: some bytes a row.
    urls = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.md5("url").alias("m")))), lambda x: x["m"]), ""))
    return rows.groupBy("kept").agg(F.count("*").alias("n"), urls.alias("urls"))


@query("SELECT doc_id, lang, CAST(quality AS BIGINT) AS quality, 'say \"' || coalesce(source, '') || '\", ok' AS note FROM documents JOIN labels USING (doc_id)")
def csv_reports(t):
    rows = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id")
    rows = rows.select("doc_id", "lang", F.col("quality").cast("long").alias("quality"), F.concat(F.lit('say "'), F.coalesce("source", F.lit("")), F.lit('", ok')).alias("note"))
    path = shared.scratch(rows.sparkSession, "csv")
    writers.csv(rows, path)
    # A reader takes the mark for no part of the first name.
    return rows.sparkSession.read.option("header", True).option("escape", "\\").schema("doc_id long, lang string, quality long, note string").option("enforceSchema", True).csv(path)


@query(f"{SPLIT}, j AS (SELECT split, d.lang FROM documents d JOIN s ON md5(d.text) = h), n AS (SELECT split, lang, count(*) AS n FROM j GROUP BY 1, 2) SELECT split, lang, n FROM n")
def json_reports(t):
    rows = t("documents").select(F.md5("text").alias("h"), "lang").join(_split(t).select("h", "split"), "h").withColumn("level", F.lit("all"))
    report = R.split_summary(rows, "h", "split", "lang", "level")
    spark, path = rows.sparkSession, shared.scratch(rows.sparkSession, "report")
    # One row: a report.
    spark.createDataFrame([(writers.json_report(report),)], "value string").coalesce(1).write.text(path)
    back = spark.read.schema("categories map<string, map<string, bigint>>").option("multiLine", True).json(path)
    return back.select(F.explode("categories").alias("split", "m")).select("split", F.explode("m").alias("lang", "n"))


@query("WITH k AS (SELECT coalesce(lang, '') AS lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY lang) + 1 AS line, '| ' || lang || ' | ' || n || ' | ' || quality || ' |' AS text FROM k) SELECT * FROM r UNION ALL SELECT 0, '| lang | n | quality |' UNION ALL SELECT 1, '| --- | --- | --- |'")
def markdown_reports(t):
    rows = t("documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).join(t("labels"), "doc_id")
    table = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("quality")).orderBy("lang")
    lines = writers.markdown(table).splitlines()
    return rows.sparkSession.createDataFrame(list(enumerate(lines)), "line long, text string")


# ---- what generation sends and gets

@query("WITH done AS (SELECT DISTINCT text FROM documents WHERE doc_id % 5 = 0 UNION SELECT text FROM documents WHERE lang = 'de') SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.text = d.text)")
def plan_resume_texts(t):
    d = t("documents").select("doc_id", "lang", F.col("text").alias("instruction"))
    done = [d.filter("doc_id % 5 = 0"), d.filter("lang = 'de'")]
    return P.resume(d, reduce(DataFrame.unionByName, done), "instruction").select("doc_id")


TEMPLATE = "Write {what} in {lang}: {what}, {not this} and {source}."


@query("SELECT doc_id, 'Write ' || w || ' in ' || coalesce(lang, '') || ': ' || w || ', {not this} and ' || coalesce(source, '') || '.' AS prompt FROM (SELECT *, '{lang}' || substr(coalesce(text, ''), 1, 20) AS w FROM documents)")
def prompts(t):
    what = F.concat(F.lit("{lang}"), F.substring(F.coalesce("text", F.lit("")), 1, 20))
    return t("documents").select("doc_id", P.render(TEMPLATE, what=what, lang="lang", source="source").alias("prompt"))


#: Answers as models give them: in quotes, too short, in fences.
QUOTED = "CASE doc_id % 4 WHEN 0 THEN ' \"「' || substr(text, 1, 30) || '」\"' || chr(10) WHEN 1 THEN '「' || substr(text, 1, 4) || '」' WHEN 2 THEN '''' || substr(text, 1, 12) || '\"' ELSE text END"


def _quoted():
    lead = lambda n: F.substring("text", 1, n)
    k = F.col("doc_id") % 4
    return F.when(k == 0, F.concat(F.lit(' "「'), lead(30), F.lit('」"\n'))).when(k == 1, F.concat(F.lit("「"), lead(4), F.lit("」"))).when(k == 2, F.concat(F.lit("'"), lead(12), F.lit('"'))).otherwise(F.col("text"))


@query(f"WITH a AS (SELECT doc_id, regexp_replace(regexp_replace({STRIP.format('(' + QUOTED + ')')}, '^[\"''「」]+', ''), '[\"''「」]+$', '') AS e FROM documents) SELECT doc_id, CASE WHEN length(e) >= 5 THEN md5(e) END AS evolved FROM a")
def evolved_instructions(t):
    return t("documents").select("doc_id", _quoted().alias("a")).select("doc_id", F.md5(P.clean_evolved("a")).alias("evolved"))


FENCED = "CASE page_id % 4 WHEN 0 THEN '```html' || chr(10) || html || chr(10) || '```' WHEN 1 THEN '```html {x}' || chr(10) || html || '```' WHEN 2 THEN '  ```' || chr(10) || html ELSE html END"
TRIMMED = STRIP.format("(" + FENCED + ")")


@query(rf"""WITH a AS (SELECT page_id, {TRIMMED} AS s FROM pages), b AS (SELECT page_id, regexp_replace(s, '^```[a-zA-Z]*\n?', '') AS x, CASE WHEN starts_with(s, '```') THEN regexp_replace(s, '^[^\n]*\n', '') ELSE s END AS y FROM a),
c AS (SELECT page_id, CASE WHEN ends_with(x, '```') THEN regexp_replace(x, '\n?```$', '') ELSE x END AS x, CASE WHEN ends_with(y, '```') THEN left(y, length(y) - 3) ELSE y END AS y FROM b)
SELECT page_id, md5({STRIP.format('x')}) AS plain, md5({STRIP.format('y')}) AS whole_line FROM c""")
def unfenced_pages(t):
    k, html, end = F.col("page_id") % 4, F.col("html"), F.lit("```")
    fenced = F.when(k == 0, F.concat(F.lit("```html\n"), html, F.lit("\n"), end)).when(k == 1, F.concat(F.lit("```html {x}\n"), html, end)).when(k == 2, F.concat(F.lit("  ```\n"), html)).otherwise(html)
    p = t("pages").select("page_id", fenced.alias("a"))
    return p.select("page_id", F.md5(H.strip_fence("a")).alias("plain"), F.md5(H.strip_fence_line("a")).alias("whole_line"))


def _best_sql(score: str, stop: int | None, floor: int, ties: str) -> str:
    out = BEST.removeprefix(ATTEMPTS).replace("s < 40 AND gs > s", f"s < {floor} AND gs {ties} s")
    return ATTEMPTS.replace("length(text) % 100", score) + (out.replace("s >= 80", f"s >= {stop}") if stop is not None else out.replace("s >= 80", "false"))


@query(_best_sql("length(text) % 7", 6, 4, ">="))
def best_of_six(t):
    return R.best_of_n(_attempts(t, 7).select("conv_id", "x.*"), "conv_id", "attempt", "score", "mode", 6, 4, fallback_wins_ties=True)


@query(_best_sql("length(text) % 100", None, 50, ">"))
def best_of_all(t):
    return R.best_of_n(_attempts(t).select("conv_id", "x.*"), "conv_id", "attempt", "score", "mode", None, 50)
