"""Queries over documents, conversations and events: merging, splits, distributions, planning, serving rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merge as M
from ..operators import plan as P
from ..operators import report as R
from ..sources import readers
from .registry import any_of, big, first_match, q, query

RULES = [("greeting", ["hello", "dear"]), ("question", ["que ", "est "]), ("article", ["the ", "der ", "die "]), ("license", ["license", "rights reserved"])]
LEVELS = {"greeting": "L1", "license": "L3"}
HELD_OUT, TRAIN_ONLY = ["es"], ["fr", "de"]
EDGES = [200, 500, 1000, 1500, 2000, 3000, 4000, 5000, 8000, 12000, 20000]
ANSWER = r"regexp_replace(text, '\. ', '.' || chr(10), 'g')"

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NORM = f"translate(lower({STRIP.format('text')}), {q(T.DROPPED)}, '')"
SOURCES = "WITH s AS (SELECT doc_id, text, lang, source, CASE WHEN lang = 'en' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END AS rank FROM documents)"


def _sources(t):
    d = t("documents").select("doc_id", "text", "lang", "source")
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    return M.union_sources([(f"part{k}", d.filter(rank == k)) for k in range(3)])


def _tagged(t):
    """The same rows, marked in one scan of the table that holds all sources."""
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    return t("documents").select("doc_id", "text", "lang", "source", rank.alias("_rank"), F.concat(F.lit("part"), rank.cast("string")).alias("_source"))


@query(f"{SOURCES} SELECT 'part' || rank AS part, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY 1")
def merge_sources(t):
    return _sources(t).groupBy(F.col("_source").alias("part")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"{SOURCES} SELECT doc_id, lang FROM s QUALIFY row_number() OVER (PARTITION BY {STRIP.format('text')} ORDER BY rank, doc_id) = 1")
def dedupe_exact(t):
    return M.first_of_each(_tagged(t), [T.strip("text")], ["_rank", "doc_id"], keep=["doc_id", "lang"])


@query(f"SELECT doc_id, md5({NORM}) AS norm_md5, md5({NORM} || '|||' || coalesce(lang, '') || '|||' || coalesce(source, '')) AS key_md5 FROM documents")
def dedupe_keys(t):
    return t("documents").select("doc_id", F.md5(T.normalized("text")).alias("norm_md5"), F.md5(M.composite_key("text", "lang", "source")).alias("key_md5"))


@query(f"{SOURCES}, k AS (SELECT *, row_number() OVER (PARTITION BY {NORM}, coalesce(lang, ''), coalesce(source, '') ORDER BY rank, doc_id) AS r FROM s) SELECT 'part' || rank AS part, count(*) AS n, count(*) FILTER (r = 1) AS kept FROM k GROUP BY 1")
def dedupe_composite_stats(t):
    return M.kept_of_sources(_tagged(t), [M.composite_key("text", "lang", "source")]).withColumnRenamed("_source", "part")


CATEGORY = f"CASE WHEN source <> '' AND source NOT IN ('src0', 'src1') THEN source ELSE {first_match(RULES, 'lower(text)', 'other')} END"


@query(f"SELECT doc_id, {CATEGORY} AS category FROM documents")
def category_resolution(t):
    own = (F.col("source") != "") & ~F.col("source").isin("src0", "src1")
    return t("documents").select("doc_id", F.when(own, F.col("source")).otherwise(T.keyword_category("text", RULES, "other")).alias("category"))


CAT = first_match(RULES, "lower(text)", "other")


@query(f"WITH c AS (SELECT {CAT} AS category FROM documents) SELECT category, CASE category WHEN 'greeting' THEN 'L1' WHEN 'license' THEN 'L3' WHEN 'other' THEN 'L1' ELSE 'L2' END AS level, count(*) AS n FROM c GROUP BY 1, 2")
def category_levels(t):
    c = F.col("category")
    level = F.when(c.isin("greeting", "other"), "L1").when(c == "license", "L3").otherwise("L2")
    return t("documents").select(T.keyword_category("text", RULES, "other").alias("category")).withColumn("level", level).groupBy("category", "level").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, md5(url) AS url_md5, md5(regexp_replace(lower(html), '\s+', '', 'g')) AS code_md5, substr(sha1(html), 1, 16) AS short_key FROM pages")
def hash_keys(t):
    return t("pages").select("page_id", T.instruction_hash("url").alias("url_md5"), T.code_hash("html").alias("code_md5"), T.short_key("html").alias("short_key"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def duplicate_flags(t):
    return M.duplicate_flag(t("documents").select("doc_id", "text"), [T.instruction_hash("text")], ["doc_id"]).select("doc_id", "is_duplicate")


@query("WITH g AS (SELECT md5(regexp_replace(lower(html), '\\s+', '', 'g')) AS code, page_id, url FROM pages) SELECT code, count(*) AS n, min_by(url, page_id) AS first_url FROM g GROUP BY 1".replace("\\\\", "\\"))
def group_by_code(t):
    return t("pages").groupBy(T.code_hash("html").alias("code")).agg(F.count("*").alias("n"), F.min_by("url", "page_id").alias("first_url"))


SPLIT = """WITH g AS (SELECT md5(text) AS h, arg_min_null(lang, doc_id) AS lang FROM documents GROUP BY 1),
r AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(h || '42'), h) AS r FROM g),
x AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(0.05 * n, 0)) ELSE 0 END AS t, CASE WHEN n >= 2 THEN greatest(1, round_even(0.1 * n, 0)) ELSE 0 END AS v FROM r),
s AS (SELECT h, lang, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM x)"""


def _split(t):
    return M.stratified_split(t("documents").select(T.instruction_hash("text").alias("h"), "lang", "doc_id"), "h", "lang", order="doc_id")


@query(f"{SPLIT} SELECT * FROM s")
def split_stratified(t):
    return _split(t)


@query(f"{SPLIT} SELECT split, lang, count(*) AS n FROM s JOIN documents d ON md5(d.text) = h GROUP BY split, s.lang".replace("SELECT split, lang", "SELECT split, s.lang"))
def split_report(t):
    d = t("documents").select(T.instruction_hash("text").alias("h"))
    return d.join(_split(t), "h").groupBy("split", "lang").agg(F.count("*").alias("n"))


@query(f"{SPLIT}, d AS (SELECT md5(text) AS h, doc_id FROM documents), j AS (SELECT d.doc_id, s.split, d.h FROM d JOIN s USING (h)) SELECT count(*) AS leaked FROM j WHERE split <> 'train' AND h IN (SELECT h FROM j WHERE split = 'train')")
def split_leakage(t):
    j = t("documents").select(T.instruction_hash("text").alias("h"), "doc_id").join(_split(t), "h")
    return M.leakage(j.filter("split <> 'train'"), j.filter("split = 'train'"), F.col("h")).agg(F.count("*").alias("leaked"))


@query("SELECT count(*) AS leaked FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE md5(b.text) = md5(d.text))")
def benchmark_leakage(t):
    return M.leakage(t("documents").select("text"), t("benchmark").select("text"), T.instruction_hash("text")).agg(F.count("*").alias("leaked"))


ISOLATED = """WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '42'), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source NOT IN ('src3', 'src5', 'src8') OR source IS NULL),
s AS (SELECT doc_id, source, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM o UNION ALL SELECT doc_id, source, CASE WHEN source = 'src3' THEN 'val' ELSE 'train' END FROM documents WHERE source IN ('src3', 'src5', 'src8'))"""


def _isolated(t):
    return M.isolated_split(t("documents").select("doc_id", "source"), "source", "doc_id", ["src3"], ["src5", "src8"])


@query("""WITH o AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '42'), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang NOT IN ('es', 'fr', 'de') OR lang IS NULL)
SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM o UNION ALL SELECT doc_id, CASE WHEN lang = 'es' THEN 'val' ELSE 'train' END FROM documents WHERE lang IN ('es', 'fr', 'de')""")
def split_isolated(t):
    return M.isolated_split(t("documents").select("doc_id", "lang"), "lang", "doc_id", HELD_OUT, TRAIN_ONLY).select("doc_id", "split")


@query(f"{ISOLATED} SELECT count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, round_even(count(*) FILTER (split = 'train') / count(*), 3) AS share, 'src3' AS held_out_categories, 'src5,src8' AS train_categories FROM s")
def split_isolated_report(t):
    train = F.count_if(F.col("split") == "train")
    fixed = F.lit("src3").alias("held_out_categories"), F.lit("src5,src8").alias("train_categories")
    return _isolated(t).agg(F.count("*").alias("total"), train.alias("train"), F.count_if(F.col("split") == "val").alias("val"), F.bround(train / F.count("*"), 3).alias("share"), *fixed)


@query(f"{ISOLATED} SELECT split, source, count(*) AS n FROM s GROUP BY ALL")
def split_isolated_categories(t):
    return _isolated(t).groupBy("split", "source").agg(F.count("*").alias("n"))


SIZES = f"{SPLIT}, d AS (SELECT md5(text) AS h FROM documents), j AS (SELECT s.split, s.lang, d.h FROM d JOIN s USING (h))"


@query(f"{SIZES} SELECT count(*) AS total, count(DISTINCT h) AS groups, " + ", ".join(f"count(*) FILTER (split = '{x}') AS {x}, count(DISTINCT h) FILTER (split = '{x}') AS {x}_groups, printf('%.1f%%', count(*) FILTER (split = '{x}') / count(*) * 100) AS {x}_ratio" for x in ("train", "val", "test")) + ", 42 AS seed FROM j")
def split_sizes(t):
    j = t("documents").select(T.instruction_hash("text").alias("h")).groupBy("h").agg(F.count("*").alias("n")).join(_split(t), "h")
    rows = lambda x: F.coalesce(F.sum(F.when(F.col("split") == x, F.col("n"))), F.lit(0))
    total = F.sum("n")
    parts = [c for x in ("train", "val", "test") for c in (rows(x).alias(x), F.count_if(F.col("split") == x).alias(f"{x}_groups"), F.format_string("%.1f%%", rows(x) / total * 100).alias(f"{x}_ratio"))]
    return j.agg(total.alias("total"), F.count("*").alias("groups"), *parts, F.lit(42).alias("seed"))


@query("SELECT doc_id, CASE WHEN length(text) >= 200 THEN 0 ELSE 1 END + CASE WHEN d THEN 1 ELSE 0 END AS n_issues, length(text) >= 200 AND NOT d AS passed, CASE WHEN d THEN '指令重复' END AS last_issue FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS d FROM documents)")
def duplicate_issues(t):
    short = F.length("text") < 200
    d = t("documents").select("doc_id", "text", (~short).alias("passed"), F.when(short, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")).alias("all_issues"))
    d = M.reject_duplicates(d, [T.instruction_hash("text")], ["doc_id"], "指令重复")
    return d.select("doc_id", F.size("all_issues").alias("n_issues"), "passed", F.when(F.array_contains("all_issues", "指令重复"), F.element_at("all_issues", -1)).alias("last_issue"))


@query("SELECT 0 AS part, page_id, 0 AS place, url AS instruction FROM pages UNION ALL SELECT 1, page_id, i, url || '?' || i FROM pages, (VALUES (1), (2)) v(i)")
def plan_fan_out(t):
    seeds = t("pages").select("page_id", F.col("url").alias("instruction"), "html")
    more = t("pages").select("page_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("place"), "url")
    more = more.select("page_id", "place", F.concat("url", F.lit("?"), F.col("place").cast("string")).alias("instruction"))
    return M.fan_out(seeds, more, "page_id", "page_id").select(F.col("_part").alias("part"), "page_id", "place", "instruction")


@query("""WITH c AS (SELECT conv_id, max(length(text)) FILTER (role = 'assistant' AND turn = last) AS reply, sum(length(text)) AS total FROM (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM conversations) x GROUP BY 1),
u AS (SELECT 'assistant' AS part, reply AS n FROM c UNION ALL SELECT 'total', total FROM c)
SELECT part, count(*) AS rows, min(n)::BIGINT AS shortest, max(n)::BIGINT AS longest, CAST(sum(n) // count(n) AS BIGINT) AS mean, count(*) FILTER (n > 2000) AS over_2000, count(*) FILTER (n > 3000) AS over_3000, count(*) FILTER (n > 4000) AS over_4000, count(*) FILTER (n > 5000) AS over_5000 FROM u GROUP BY 1""")
def conversation_lengths(t):
    reply = F.max_by(F.when(F.col("role") == "assistant", F.length("text")), F.when(F.col("role") == "assistant", F.col("turn")))
    c = t("conversations").groupBy("conv_id").agg(reply.alias("reply"), F.sum(F.length("text")).alias("total"))
    return R.length_summary(c, {"assistant": F.col("reply"), "total": F.col("total")})


@query(None)
def token_length_filter(t):
    """Conversations of at most 256 tokens; tested against the tokenizers library."""
    from ..operators import tokens

    import public_tokenizers

    c = readers.conversations(t("conversations")).select("conv_id", readers.render_chat().alias("text"))
    counted = tokens.token_lengths(c, "text", public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.within(counted, 256).select("conv_id", "n_tokens")


@query("SELECT min(length(text)) AS shortest, max(length(text)) AS longest, CAST(sum(length(text)) // count(*) AS BIGINT) AS mean, count(*) FILTER (length(text) > 2000) AS over_2000, count(*) FILTER (length(text) > 3000) AS over_3000, count(*) FILTER (length(text) > 5000) AS over_5000, count(*) FILTER ((length(text) + 250) / 2.5 > 1024) AS tokens_over_1024, CAST(count(*) FILTER ((length(text) + 250) / 2.5 > 1024) * 100 // count(*) AS BIGINT) AS percent_over_1024, count(*) FILTER ((length(text) + 250) / 2.5 > 2048) AS tokens_over_2048 FROM documents")
def length_stats(t):
    n = F.length("text")
    tokens = T.token_estimate(n)
    over = [F.count_if(n > k).alias(f"over_{k}") for k in (2000, 3000, 5000)]
    return t("documents").agg(
        F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.floor(F.sum(n) / F.count("*")).alias("mean"), *over, F.count_if(tokens > 1024).alias("tokens_over_1024"),
        F.floor(F.count_if(tokens > 1024) * 100 / F.count("*")).alias("percent_over_1024"), F.count_if(tokens > 2048).alias("tokens_over_2048"),
    )


@query("SELECT doc_id, (length(text) + 250) / 2.5 AS tokens FROM documents WHERE (length(text) + 250) / 2.5 <= 4096")
def length_filter(t):
    d = t("documents").select("doc_id", T.token_estimate(F.length("text")).cast("double").alias("tokens"))
    return d.filter("tokens <= 4096")


@query("WITH r AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM documents), w AS (SELECT * FROM (VALUES ('p50', 0.5), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99)) x(name, q)) SELECT name, v AS value FROM r JOIN w ON i = floor(n * CAST(q AS DOUBLE))")
def length_order_statistics(t):
    return R.order_statistics(t("documents").select(F.length("text").cast("long").alias("v")), "v", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


BIN = "CASE " + " ".join(f"WHEN length(text) <= {e} THEN {i}" for i, e in enumerate(EDGES)) + f" ELSE {len(EDGES)} END"


@query(f"SELECT CAST({BIN} AS BIGINT) AS bin, count(*) AS n, count(*) / sum(count(*)) OVER () AS percent FROM documents GROUP BY 1")
def length_histogram(t):
    return R.histogram(t("documents").select(F.length("text").alias("v")), "v", EDGES)


@query("WITH u AS (SELECT md5(text) AS k, count(DISTINCT doc_id) AS u FROM documents GROUP BY 1), a AS (SELECT count(*) AS codes, count(*) FILTER (u >= 2) AS multi, count(*) FILTER (u >= 3) AS heavy FROM u) SELECT *, CASE WHEN heavy / greatest(codes, 1) > 0.05 THEN 'fail' WHEN multi / greatest(codes, 1) > 0.1 THEN 'mild' ELSE 'pass' END AS verdict FROM a")
def instruction_collapse(t):
    return R.collapse(t("documents"), T.instruction_hash("text"), "doc_id")


@query("SELECT md5(text) AS k, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 ORDER BY n DESC, first_doc LIMIT 5")
def most_shared_texts(t):
    return t("documents").groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).orderBy(F.desc("n"), "first_doc").limit(5)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 8000 ORDER BY doc_id LIMIT 20")
def dropped_first_20(t):
    return t("documents").select("doc_id", F.length("text").cast("long").alias("n")).filter("n > 8000").orderBy("doc_id").limit(20)


@query("SELECT CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS kind, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def composition(t):
    return t("documents").groupBy(F.when(F.length("text") < 200, "short").otherwise("long").alias("kind"), "lang").agg(F.count("*").alias("n"))


LOSS = "WITH l AS (SELECT event_type AS series, event_id AS step, value AS loss FROM events WHERE value IS NOT NULL)"


@query(f"{LOSS} SELECT series, min_by(step, (loss, step)) AS best_step, min(loss) AS best_loss, min_by(loss, step) AS first_loss, max_by(loss, step) AS last_loss FROM l GROUP BY 1")
def loss_best_point(t):
    return R.best_point(t("events").select(F.col("event_type").alias("series"), F.col("event_id").alias("step"), F.col("value").alias("loss")), "step", "loss", ["series"])


@query("SELECT event_id, event_id / max(event_id) OVER (PARTITION BY event_type) AS progress FROM events")
def loss_progress(t):
    last = t("events").groupBy("event_type").agg(F.max("event_id").alias("last"))
    return t("events").select("event_id", "event_type").join(last, "event_type").select("event_id", (F.col("event_id") / F.col("last")).alias("progress"))


@query("WITH c AS (SELECT lang, avg(quality) AS base_avg, avg(1 - toxic) AS ft_avg FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT lang, base_avg, ft_avg, lang IN ('es') AS held_out, row_number() OVER (ORDER BY ft_avg DESC, lang) AS rank FROM c")
def category_ranking(t):
    from pyspark.sql import Window

    c = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("base_avg"), F.avg(1 - F.col("toxic")).alias("ft_avg"))
    # One row for each category.
    return c.withColumns({"held_out": F.col("lang").isin(HELD_OUT), "rank": F.row_number().over(Window.orderBy(F.desc("ft_avg"), "lang")).cast("long")})


@query("SELECT sum(quality) AS base_total, sum(1 - toxic) AS tuned_total, sum(1 - toxic) - sum(quality) AS delta, sum(quality) / count(*) AS base_rate, count(*) FILTER (quality = 1 AND toxic = 0) AS passed, avg(quality) AS mean FROM labels".replace("sum(1 - toxic) - sum(quality)", "CAST(sum(1 - toxic) - sum(quality) AS BIGINT)").replace("sum(quality) AS base_total, sum(1 - toxic) AS tuned_total", "CAST(sum(quality) AS BIGINT) AS base_total, CAST(sum(1 - toxic) AS BIGINT) AS tuned_total"))
def base_vs_tuned(t):
    a, b = F.sum("quality"), F.sum(1 - F.col("toxic"))
    return t("labels").agg(a.alias("base_total"), b.alias("tuned_total"), (b - a).alias("delta"), (a / F.count("*")).alias("base_rate"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"), F.avg("quality").alias("mean"))


@query("SELECT lang, avg(quality) FILTER (doc_id % 2 = 0) AS v1, avg(quality) FILTER (doc_id % 2 = 1) AS v2 FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def round_summary(t):
    d = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").withColumn("version", F.when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2"))
    return d.groupBy("lang").pivot("version", ["v1", "v2"]).agg(F.avg("quality"))


@query("WITH e AS (SELECT event_id // 15 AS test, value >= 20 AS good, event_type = 'purchase' AND value < 30 AS capped, value FROM events), a AS (SELECT test, count(*) FILTER (good) AS ok, count(*) FILTER (NOT good) AS failed, count(*) FILTER (capped) AS limited, avg(value) FILTER (good) AS avg_s, min(value) FILTER (good) AS min_s, max(value) FILTER (good) AS max_s FROM e GROUP BY 1) SELECT *, CAST(CASE WHEN ok = 15 AND limited = 0 THEN 15 WHEN ok >= 12 THEN 10 ELSE 5 END AS BIGINT) AS advice FROM a")
def latency_report(t):
    e = t("events").withColumn("test", F.floor(F.col("event_id") / 15))
    return P.latency_summary(e, F.col("value") >= 20, (F.col("event_type") == "purchase") & (F.col("value") < 30), "value", ("test",))


@query("SELECT event_type, count(*) AS n, count(*) / (date_diff('second', min(ts), max(ts)) + 1) AS rate FROM events GROUP BY 1".replace("date_diff('second', min(ts), max(ts))", "(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))"))
def progress_rates(t):
    seconds = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts")) + 1
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), (F.count("*") / seconds).alias("rate"))


WORK = "WITH w AS (SELECT doc_id, doc_id || '_' || v AS _source_key FROM documents, (VALUES ('base'), ('depth'), ('breadth')) x(v)), done AS (SELECT doc_id || '_base' AS _source_key FROM documents WHERE lang = 'en')"


def _work(t):
    d = t("documents")
    work = P.work_list(d.select("doc_id"), "doc_id", ["base", "depth", "breadth"])
    return P.resume(work, d.filter("lang = 'en'").select(F.concat(F.col("doc_id").cast("string"), F.lit("_base")).alias("_source_key")))


@query(f"{WORK} SELECT _source_key FROM w WHERE _source_key NOT IN (SELECT _source_key FROM done)")
def plan_resume(t):
    return _work(t).select("_source_key")


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT doc_id FROM d WHERE i % 4 = 1")
def plan_shard(t):
    return P.shard(P.resume(t("documents").select("doc_id"), t("labels"), "doc_id"), "doc_id", 4, 1)


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split({ANSWER}, chr(10))) AS x, generate_subscripts(string_split({ANSWER}, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^\d+[.)、]\s*', ''), '^[-•]\s*', ''), '“”"'' ') AS v FROM l),
f AS (SELECT doc_id, v, min(i) AS i FROM c WHERE length(v) >= 2 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
SELECT doc_id, count(*) AS n, md5(string_agg(v, '|' ORDER BY i)) AS digest FROM r WHERE r <= 10 GROUP BY 1""")
def plan_variants(t):
    answer = F.regexp_replace("text", r"\. ", ".\n")
    got = t("documents").select("doc_id", P.clean_variants(answer).alias("v")).filter(F.size("v") > 0)
    return got.select("doc_id", F.size("v").cast("long").alias("n"), F.md5(F.array_join("v", "|")).alias("digest"))


@query("SELECT user_id, CASE WHEN regexp_matches(lower(props), 'insufficient balance|insufficient_quota|insufficient funds|payment required|balance not enough|余额不足| 402|\\(402|status 402|status_code=402') THEN 'balance' WHEN regexp_matches(lower(props), '429|rate limit') THEN 'rate_limit' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def error_classes(t):
    return t("events").groupBy("user_id", P.error_class(F.coalesce("props", F.lit(""))).alias("kind")).agg(F.count("*").alias("n"))


TEMPLATES = [("license", "licensed"), ("Apache", "missing"), ("the ", "english"), ("une ", "french")]
SUFFIXES = [(r"[13579]$", ", without oddity"), (r"[0-4]", ", low digits")]


@query(f"SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'licensed' WHEN contains(lower(text), 'the ') THEN 'english' WHEN contains(lower(text), 'une ') THEN 'french' END AS template, CASE WHEN {any_of(['license', 'the ', 'une '], 'lower(text)')} THEN 'golden_template' ELSE 'model' END AS origin FROM documents")
def serve_lookup(t):
    found = P.lookup_template("text", TEMPLATES, {"licensed", "english", "french"})
    return t("documents").select("doc_id", found.alias("template"), F.when(found.isNotNull(), "golden_template").otherwise("model").alias("origin"))


@query(r"""SELECT p_partkey, CASE WHEN length(p_brand) > 25 THEN p_brand WHEN regexp_matches(p_brand, '[13579]$') AND NOT contains(p_brand, ', wit') THEN p_brand || ', without oddity' WHEN regexp_matches(p_brand, '[0-4]') AND NOT contains(p_brand, ', low') THEN p_brand || ', low digits' WHEN length(p_brand) < 15 THEN p_brand || ' please' ELSE p_brand END AS enhanced FROM part""")
def serve_enhance(t):
    return t("part").select("p_partkey", P.enhance("p_brand", SUFFIXES, " please").alias("enhanced"))


@query("""WITH m AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS u, min_by(text, turn) FILTER (role = 'system') AS s, max_by(text, turn) AS last, count(*) AS n FROM conversations GROUP BY 1),
p AS (SELECT conv_id, text AS second FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 2)
SELECT conv_id, coalesce(u, '') AS user_text, coalesce(s, '') AS system_text, second, last, n FROM m LEFT JOIN p USING (conv_id)""")
def conversation_access(t):
    c = readers.conversations(t("conversations"))
    return c.select("conv_id", readers.by_role("user").alias("user_text"), readers.by_role("system").alias("system_text"), readers.by_position(2).alias("second"), readers.by_position(-1).alias("last"), F.size("messages").cast("long").alias("n"))


@query("""SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10) ORDER BY turn)) AS rendered FROM conversations GROUP BY 1""")
def conversation_render(t):
    return readers.conversations(t("conversations")).select("conv_id", F.md5(readers.render_chat()).alias("rendered"))


@query("SELECT o_orderkey, length(o_orderpriority) BETWEEN 2 AND 500 AND o_totalprice / 500000 BETWEEN 0 AND 1 AND o_custkey BETWEEN 64 AND 4096 AND 0.5 BETWEEN 0.1 AND 1 AS valid FROM orders")
def request_validation(t):
    from ..operators.validate import request_ok

    o = t("orders").withColumns({"temp": F.col("o_totalprice") / 500000, "p": F.lit(0.5)})
    return o.select("o_orderkey", request_ok("o_orderpriority", "temp", "o_custkey", "p").alias("valid"))
