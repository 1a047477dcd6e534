"""Queries over files and rules: line order, resumable output, serving, categories, pairing, reports, spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import rules as C
from ..functions import serving as S
from ..functions import text as T
from ..operators import merge as M
from ..operators import plan as P
from ..operators import report as R
from ..operators import rules as O
from ..sources import lines as L
from ..sources import readers, shared, writers
from .pages import ADHERENCE, KEYWORDS, TEN
from .registry import SQL as PAGE_SQL
from .registry import first_match, q, query
from .texts import SPLIT, STRIP, _split

# ---- files: line numbers, resumable output, quality

RANK = "CASE WHEN lang = 'en' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END"
#: Documents as lines of three sources, in an order that is not that of their ids.
LINES = f"WITH l AS (SELECT doc_id, text, lang, source, {RANK} AS rank, row_number() OVER (PARTITION BY {RANK} ORDER BY md5('x' || doc_id)) AS place FROM documents)"


def _written_sources(t):
    """Documents written as JSON lines of three sources, and read back with the numbers of their lines."""
    d = t("documents")
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    user = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    rows = d.select(rank.alias("part"), F.md5(F.concat(F.lit("x"), F.col("doc_id").cast("string"))).alias("_h"), user.alias("messages"), F.col("doc_id").cast("string").alias("_source_key"), F.col("lang").alias("_style"), F.col("source").alias("_category"))
    path = shared.scratch(d.sparkSession, "sources")
    writers.shards(rows, path, ["_h"], "part", files=8)
    # A source that is not there is skipped; it keeps its place in the order.
    return L.multi_source_lines(d.sparkSession, [(f"part{k}", f"{path}/part={k}/*.json") for k in (0, 1, 2)] + [("gone", f"{path}/part=9/*.json")])


@query(f"{LINES} SELECT CAST(doc_id AS VARCHAR) AS doc, 'part' || rank AS part, place FROM l QUALIFY row_number() OVER (PARTITION BY {STRIP.format('text')} ORDER BY rank, place) = 1")
def merge_lines(t):
    rows = _written_sources(t).withColumn("text", F.col("messages")[0]["content"])
    kept = M.first_of_each(rows, [T.strip("text")], ["_rank", "_place"], keep=["_source_key", "_source", "_place"])
    return kept.select(F.col("_source_key").alias("doc"), F.col("_source").alias("part"), F.col("_place").alias("place"))


NORM_LINE = f"translate(lower({STRIP.format('text')}), {q(T.DROPPED)}, '')"


@query(f"{LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY {NORM_LINE}, coalesce(lang, ''), coalesce(source, '') ORDER BY rank, place) AS r FROM l) SELECT 'part' || rank AS part, count(*) AS n, count(*) FILTER (r = 1) AS kept, max(place) FILTER (r = 1) AS last_kept FROM k GROUP BY 1")
def merge_lines_stats(t):
    rows = _written_sources(t).withColumn("text", F.col("messages")[0]["content"])
    key = M.composite_key("text", "_style", "_category")
    stats = M.kept_of_sources(rows, [key]).withColumnRenamed("_source", "part")
    last = M.first_of_each(rows, [key], ["_rank", "_place"], keep=["_source", "_place"]).groupBy(F.col("_source").alias("part")).agg(F.max("_place").alias("last_kept"))
    return stats.join(last, "part")


@query(
    "WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) SELECT 'once' AS after, (SELECT count(*) FROM a) AS rows, (SELECT count(DISTINCT doc_id) FROM a) AS keys, (SELECT count(*) FROM a) AS of_a, 0 AS of_b "
    "UNION ALL SELECT 'again', (SELECT count(*) FROM a), (SELECT count(DISTINCT doc_id) FROM a), (SELECT count(*) FROM a), 0 "
    "UNION ALL SELECT 'both', count(*), count(DISTINCT doc_id), count(*) FILTER (doc_id % 3 <> 0), count(*) FILTER (doc_id % 3 = 0) FROM documents "
    "UNION ALL SELECT 'both again', count(*), count(DISTINCT doc_id), count(*) FILTER (doc_id % 3 <> 0), count(*) FILTER (doc_id % 3 = 0) FROM documents"
)
def append_resumed(t):
    d = t("documents").select("doc_id", "lang", "text")
    spark, path = d.sparkSession, shared.scratch(d.sparkSession, "appended")
    out = None
    for after, run, rows in (("once", "a", d.filter("doc_id % 3 <> 0")), ("again", "a", d.filter("doc_id % 3 <> 0")), ("both", "b", d), ("both again", "b", d)):
        writers.append_new(rows, path, "doc_id", run)
        got = spark.read.schema("doc_id long, _run string").json(path)
        # The counts of this state; the folder changes with the next run.
        now = got.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("keys"), F.count_if(F.col("_run") == "a").alias("of_a"), F.count_if(F.col("_run") == "b").alias("of_b")).collect()
        state = spark.createDataFrame(now, "rows long, keys long, of_a long, of_b long").select(F.lit(after).alias("after"), "*")
        out = state if out is None else out.unionByName(state)
    return out


#: Events as lines of two sources: of every seven, one is cut, one has no messages and two lack something.
PAGE = "<!DOCTYPE html><meta name=viewport>"
VALUE = {0: ("substr(props, 1, length(props) - 1)", None), 1: ("'{\"messages\": []}'", None), 2: (None, "event_type"), 3: (None, f"'{PAGE}' || event_type")}
HTML = f"CASE event_id % 7 WHEN 2 THEN event_type WHEN 3 THEN '{PAGE}' || event_type ELSE '{PAGE}' || event_type || '</html>' END"
EVENT_LINES = f"""WITH l AS (SELECT event_id, event_type = 'error' AS late, event_id % 7 AS k, {HTML} AS html, row_number() OVER (PARTITION BY event_type = 'error' ORDER BY md5('y' || event_id)) AS place FROM events),
j AS (SELECT *, CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'content' WHEN 2 THEN 'html' WHEN 3 THEN 'html' END AS reason FROM l)"""


def _written_events(t):
    e, k = t("events"), F.col("event_id") % 7
    page = lambda end: F.concat(F.lit(PAGE), F.col("event_type"), F.lit(end))
    html = F.when(k == 2, F.col("event_type")).when(k == 3, page("")).otherwise(page("</html>"))
    whole = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content")), F.struct(F.lit("assistant").alias("role"), html.alias("content"))).alias("messages")))
    value = F.when(k == 0, F.expr("substr(props, 1, length(props) - 1)")).when(k == 1, '{"messages": []}').otherwise(whole)
    rows = e.select((F.col("event_type") == "error").cast("int").alias("late"), F.md5(F.concat(F.lit("y"), F.col("event_id").cast("string"))).alias("_h"), value.alias("value"))
    path = shared.scratch(e.sparkSession, "events")
    rows.repartitionByRange(4, "late", "_h").sortWithinPartitions("late", "_h").select("late", "value").write.partitionBy("late").text(path)
    spark, out = e.sparkSession, None
    for late in (0, 1):
        own = L.numbered_lines(spark, f"{path}/late={late}/*").withColumn("_line", F.col("_place")).withColumn("late", F.lit(bool(late)))
        out = own if out is None else out.unionByName(own)
    return L.judged(out)


@query(f"{EVENT_LINES} SELECT late, count(*) AS total, count(*) FILTER (k <> 0) AS valid_json, count(*) FILTER (reason IS NULL) AS valid_html, min(length(html)) FILTER (k > 1) AS shortest, max(length(html)) FILTER (k > 1) AS longest, CAST(floor(sum(length(html)) FILTER (k > 1) / count(*) FILTER (k > 1)) AS BIGINT) AS mean FROM j GROUP BY 1")
def quality_counts(t):
    return L.quality_counts(_written_events(t), ["late"])


LACKS = "CASE k WHEN 2 THEN '[''DOCTYPE'', ''</html>'', ''viewport'']' ELSE '[''</html>'']' END"
SAMPLE = f"'行' || place || ': ' || CASE reason WHEN 'json' THEN 'JSON 解析失败' WHEN 'content' THEN '缺少 messages[-1].content' ELSE 'HTML 缺少 ' || {LACKS} || ' (长度=' || length(html) || ')' END"


@query(f"{EVENT_LINES}, r AS (SELECT late, reason, row_number() OVER (PARTITION BY late, reason ORDER BY place) AS rank, {SAMPLE} AS sample FROM j WHERE reason IS NOT NULL) SELECT * FROM r WHERE rank <= 3")
def quality_samples(t):
    return L.first_samples(_written_events(t), ["late", "reason"], "_place")


@query(f"{EVENT_LINES}, r AS (SELECT late, row_number() OVER (PARTITION BY late ORDER BY place) AS rank, {SAMPLE} AS sample FROM j WHERE reason IS NOT NULL) SELECT * FROM r WHERE rank <= 3")
def quality_first_bad(t):
    return L.first_samples(_written_events(t), ["late"], "_place")


# ---- instructions made of documents' texts and the words of the rules

WORDS = [w for _, words in C.INSTRUCTION_CATEGORIES for w in words] + [w for _, words in C.SPLIT_CATEGORIES for w in words] + ["没有"]
OWN = ["multi", "seed_multi_impl", "", None, "cross_category", "social", "finance", "timer", ""]
CROSS = [*C.CROSS_CATEGORY, "new_type", "", None, "", None]


def _pick(values: list, index):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (index % len(values) + 1).cast("int"))


def _sql_pick(values: list, index: str) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + f"][{index} % {len(values)} + 1]"


def _items(t):
    i, lead = F.col("doc_id"), F.substring(F.coalesce("text", F.lit("")), 1, 6)
    return t("documents").select("doc_id", _pick(OWN, i).alias("own"), _pick(CROSS, i).alias("cross_type"), F.concat(lead, _pick(WORDS, i)).alias("instruction"), "text", "lang")


ITEMS = f"WITH i AS (SELECT doc_id, text, lang, {_sql_pick(OWN, 'doc_id')} AS own, {_sql_pick(CROSS, 'doc_id')} AS cross_type, substr(coalesce(text, ''), 1, 6) || {_sql_pick(WORDS, 'doc_id')} AS instruction FROM documents)"
CROSS_CASE = "CASE cross_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.CROSS_CATEGORY.items()) + " ELSE 'cross_category' END"
ITEM_CATEGORY = f"CASE WHEN coalesce(own, '') NOT IN ('cross_category', 'seed_multi_impl', '') THEN own WHEN coalesce(cross_type, '') <> '' THEN {CROSS_CASE} ELSE {first_match(C.INSTRUCTION_CATEGORIES, 'lower(instruction)', 'other')} END"
SPLIT_CATEGORY = first_match(C.SPLIT_CATEGORIES, "lower(instruction)", C.NO_SPLIT_CATEGORY)
LEVEL = "CASE WHEN category IN ('计时器/秒表', '随机/骰子', '计算器', '换算工具', '记分/投票', '其他') THEN 'L1_简单' WHEN category IN ('猜数/游戏', '音频/节拍', '打字/测试') THEN 'L3_挑战' ELSE 'L2_中等' END"


@query(f"{ITEMS} SELECT doc_id, {ITEM_CATEGORY} AS category FROM i")
def item_categories(t):
    return _items(t).select("doc_id", C.item_category("own", "cross_type", "instruction").alias("category"))


@query(f"{ITEMS} SELECT doc_id, {CROSS_CASE} AS category FROM i WHERE coalesce(cross_type, '') <> ''")
def cross_categories(t):
    items = _items(t).filter(F.coalesce("cross_type", F.lit("")) != "")
    table = items.sparkSession.createDataFrame(list(C.CROSS_CATEGORY.items()), "cross_type string, main string")
    return O.lookup(items, "cross_type", table, "main", "category", "cross_category").select("doc_id", "category")


@query(f"{ITEMS}, c AS (SELECT doc_id, instruction, {SPLIT_CATEGORY} AS category FROM i) SELECT doc_id, instruction, category, {LEVEL} AS level FROM c")
def instruction_levels(t):
    c = _items(t).select("doc_id", "instruction", C.split_category("instruction").alias("category"))
    return c.withColumn("level", C.category_level("category"))


HELD = ", ".join(map(q, C.HELD_OUT_CATEGORIES))
TRAINED = ", ".join(map(q, C.TRAIN_ONLY_CATEGORIES))


@query(f"""{ITEMS}, c AS (SELECT doc_id, {ITEM_CATEGORY} AS category FROM i),
o AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5(doc_id || '42'), doc_id) AS r, count(*) OVER (PARTITION BY category) AS n FROM c WHERE category NOT IN ({HELD}, {TRAINED}))
SELECT doc_id, category, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM o UNION ALL SELECT doc_id, category, CASE WHEN category IN ({HELD}) THEN 'val' ELSE 'train' END FROM c WHERE category IN ({HELD}, {TRAINED})""")
def split_item_categories(t):
    items = _items(t).select("doc_id", C.item_category("own", "cross_type", "instruction").alias("category"))
    return M.isolated_split(items, "category", "doc_id", C.HELD_OUT_CATEGORIES, C.TRAIN_ONLY_CATEGORIES)


LIST = "string_agg({0} || '=' || {1}, ',' ORDER BY {0})"


@query(f"""{SPLIT}, {ITEMS.removeprefix("WITH ")}, c AS (SELECT md5(text) AS h, {SPLIT_CATEGORY} AS category FROM i), j AS (SELECT c.h, split, category, {LEVEL} AS level FROM c JOIN s USING (h)),
z AS (SELECT split, count(*) AS n, count(DISTINCT h) AS g, count(*) FILTER (split <> 'train' AND h IN (SELECT h FROM j WHERE split = 'train')) AS l, printf('%.1f%%', count(*) / (SELECT count(*) FROM j) * 100) AS r FROM j GROUP BY 1),
k AS (SELECT split, category, count(*) AS n FROM j GROUP BY 1, 2), ks AS (SELECT split, {LIST.format('category', 'n')} AS x FROM k GROUP BY 1), v AS (SELECT level, count(*) AS n FROM j GROUP BY 1)
SELECT (SELECT count(*) FROM j) AS total, (SELECT count(DISTINCT h) FROM j) AS total_groups, {LIST.format('split', 'n')} AS sizes, {LIST.format('split', 'g')} AS groups, {LIST.format('split', 'r')} AS ratios, {LIST.format('split', 'l')} AS leaked,
(SELECT {LIST.format('level', 'n')} FROM v) AS levels, (SELECT string_agg(split || ':' || x, ';' ORDER BY split) FROM ks) AS categories FROM z""")
def split_summary(t):
    items = _items(t).select(F.md5("text").alias("h"), C.split_category("instruction").alias("category")).withColumn("level", C.category_level("category"))
    s = R.split_summary(items.join(_split(t).select("h", "split"), "h"), "h", "split", "category", "level")
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    nested = F.map_entries(F.transform_values("categories", lambda _, m: listed(m)))
    parts = F.array_join(F.transform(F.array_sort(nested), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")
    return s.select("total", "total_groups", *(listed(F.col(c)).alias(c) for c in ("sizes", "groups", "ratios", "leaked", "levels")), parts.alias("categories"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '42'), doc_id) - 1 AS position FROM documents")
def permuted_positions(t):
    return M.permuted(t("documents").select("doc_id"), "doc_id")


# ---- serving

TARGETS = [target for _, target in S.TEMPLATE_WORDS]
ASKED = [w for w, _ in S.TEMPLATE_WORDS] + ["bmi", "没有", ""]
#: Every second target, of those that a document's number reaches, is a seed.
SEEDS = f"WITH seeds AS (SELECT {_sql_pick(TARGETS, 'doc_id')} AS instruction, max_by(md5(text), doc_id) AS html FROM documents WHERE doc_id % {len(TARGETS)} % 2 = 0 GROUP BY 1)"
ASK = f"d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN {_sql_pick(TARGETS, 'doc_id')} ELSE substr(text, 1, 6) || {_sql_pick(ASKED, '(doc_id * 7)')} || {_sql_pick(ASKED, '(doc_id // 3)')} END AS instruction FROM documents)"
RULES = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(w)}, {q(x)})" for i, (w, x) in enumerate(S.TEMPLATE_WORDS)) + ") v(priority, word, target) WHERE target IN (SELECT instruction FROM seeds))"


@query(f"{SEEDS}, {ASK}, {RULES}, m AS (SELECT doc_id, min_by(target, priority) AS target FROM d JOIN r ON contains(lower(instruction), word) OR contains(instruction, word) GROUP BY 1) SELECT d.doc_id, seeds.html AS template, CASE WHEN seeds.html IS NULL THEN 'model' ELSE 'golden_template' END AS origin FROM d LEFT JOIN m USING (doc_id) LEFT JOIN seeds ON seeds.instruction = coalesce(m.target, d.instruction)")
def serve_templates(t):
    d = t("documents")
    i = F.col("doc_id")
    seeds = d.filter(i % len(TARGETS) % 2 == 0).select(_pick(TARGETS, i).alias("instruction"), F.md5("text").alias("html"), i.alias("place"))
    mixed = F.concat(F.substring("text", 1, 6), _pick(ASKED, i * 7), _pick(ASKED, F.floor(i / 3)))
    asked = d.select("doc_id", F.when(i % 11 == 0, _pick(TARGETS, i)).otherwise(mixed).alias("instruction"))
    rules = O.rule_table(d.sparkSession, S.TEMPLATE_WORDS, ["word", "target"])
    return O.serve_template(asked, "instruction", rules, seeds).select("doc_id", "template", "origin")


SHORT = [w for w, _ in S.TEMPLATE_WORDS] + ["todo", "账本", "打字测试", "食谱", "卡路里", "血压", "体重", "睡眠", "房贷", "复利", "GPA", "口算", "课程表", "纪念日", "人生进度", "真心话大冒险", "抽签", "抽奖", "分组", "井字棋", "演讲计时", "密码强度"]
#: Turns' beginnings with a word, of which every fifth has a rule's suffix already.
RAW = f"' ' || substr(coalesce(text, ''), 1, CAST(conv_id % 9 AS INTEGER)) || {_sql_pick(SHORT, '(conv_id * 3 + turn)')} || CASE WHEN conv_id % 5 = 0 THEN substr({_sql_pick([x for _, x in S.SUFFIX_RULES], 'conv_id')}, 1, 6) ELSE '' END || chr(10)"
SUFFIXED = " ".join(f"WHEN regexp_matches(raw, {q(p)}) AND NOT contains(raw, {q(x[:5])}) THEN raw || {q(x)}" for p, x in S.SUFFIX_RULES)


@query(f"WITH c AS (SELECT conv_id, turn, {STRIP.format('(' + RAW + ')')} AS raw FROM conversations) SELECT conv_id, turn, CASE WHEN length(raw) > 25 THEN raw {SUFFIXED} WHEN length(raw) < 15 THEN raw || {q(S.GENERIC_SUFFIX)} ELSE raw END AS enhanced FROM c")
def serve_suffixes(t):
    c, i = t("conversations"), F.col("conv_id")
    lead = F.coalesce("text", F.lit("")).substr(F.lit(1), (i % 9).cast("int"))
    held = F.when(i % 5 == 0, F.substring(_pick([x for _, x in S.SUFFIX_RULES], i), 1, 6)).otherwise("")
    raw = F.concat(F.lit(" "), lead, _pick(SHORT, i * 3 + F.col("turn")), held, F.lit("\n"))
    rules = O.rule_table(c.sparkSession, S.SUFFIX_RULES, ["pattern", "suffix"])
    return c.select("conv_id", "turn", raw.alias("raw")).select("conv_id", "turn", O.serve_enhanced("raw", rules, S.GENERIC_SUFFIX).alias("enhanced"))


# ---- pairs, complete sets, choices within a row, spans

@query("WITH e AS (SELECT DISTINCT doc_id // 2 AS tag FROM documents WHERE doc_id % 10 <> 9), a AS (SELECT doc_id // 2 AS tag, quality + 1 AS v FROM labels WHERE doc_id % 2 = 0), b AS (SELECT doc_id // 2 AS tag, quality + 1 AS v FROM labels WHERE doc_id % 2 = 1) SELECT coalesce(a.tag, b.tag, e.tag) AS tag, coalesce(a.v, 0) AS one, coalesce(b.v, 0) AS two, a.tag IS NULL AS one_missing, b.tag IS NULL AS two_missing, e.tag IS NOT NULL AS expected, coalesce(b.v, 0) - coalesce(a.v, 0) AS delta FROM a FULL JOIN b ON a.tag = b.tag FULL JOIN e ON e.tag = coalesce(a.tag, b.tag)")
def pairs_expected(t):
    tag = F.floor(F.col("doc_id") / 2).alias("tag")
    sides = t("labels").select(tag, (F.col("quality") + 1).alias("v"), (F.col("doc_id") % 2).alias("side"))
    expected = t("documents").filter("doc_id % 10 <> 9").select(tag)
    return R.paired(expected, sides.filter("side = 0"), sides.filter("side = 1"), "tag", "v")


@query("WITH l AS (SELECT doc_id // 2 AS item, CASE WHEN doc_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, quality, toxic FROM labels), w AS (SELECT item FROM l GROUP BY 1 HAVING count(DISTINCT version) = 2), c AS (SELECT * FROM l WHERE item IN (SELECT item FROM w)) SELECT version, count(*) AS n, avg(quality) AS quality, avg(quality) / 1 * 100 AS quality_percent, avg(toxic) AS toxic FROM c GROUP BY 1")
def complete_means(t):
    rows = t("labels").select(F.floor(F.col("doc_id") / 2).alias("item"), F.when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2").alias("version"), "quality", "toxic")
    own = R.complete_only(rows, "item", "version", ["v1", "v2"])
    return own.groupBy("version").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), (F.avg("quality") * 100).alias("quality_percent"), F.avg("toxic").alias("toxic"))


#: Turns as attempts; those of the system, or at the end of long talks, are greedy.
ATTEMPTS = "WITH a AS (SELECT conv_id, turn AS k, length(text) % 100 AS s, CASE WHEN role = 'system' OR turn >= 4 THEN 'greedy' ELSE 'sample' END AS mode FROM conversations WHERE text IS NOT NULL)"


def _attempts(t, most: int = 100):
    mode = F.when((F.col("role") == "system") | (F.col("turn") >= 4), "greedy").otherwise("sample")
    return t("conversations").filter("text IS NOT NULL").select("conv_id", F.struct(F.col("turn").alias("attempt"), (F.length("text") % most).cast("long").alias("score"), mode.alias("mode")).alias("x"))


BEST = f"""{ATTEMPTS}, st AS (SELECT conv_id, min(k) AS m FROM a WHERE mode <> 'greedy' AND s >= 80 GROUP BY 1), g AS (SELECT conv_id, s AS gs, k AS gk FROM a WHERE mode = 'greedy' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, k) = 1),
b AS (SELECT conv_id, s, k FROM a LEFT JOIN st USING (conv_id) WHERE mode <> 'greedy' AND (m IS NULL OR k <= m) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, k) = 1),
f AS (SELECT conv_id, s, k, gs, gk, (s IS NULL OR coalesce(s < 40 AND gs > s, false)) AS fallback FROM b FULL JOIN g USING (conv_id)) SELECT conv_id, CASE WHEN fallback THEN gs ELSE s END AS score, CASE WHEN fallback THEN gk ELSE k END AS attempt, fallback FROM f"""


@query(BEST)
def best_of_attempts(t):
    rows = _attempts(t).select("conv_id", "x.*")
    return R.best_of_n(rows, "conv_id", "attempt", "score", "mode", 80, 40)


@query(BEST)
def best_in_arrays(t):
    # A conversation's turns are one row, as a document of results has them.
    rows = _attempts(t).groupBy("conv_id").agg(F.collect_list("x").alias("attempts"))
    return rows.select("conv_id", R.best_in_array("attempts", 80, 40).alias("b")).select("conv_id", "b.*")


@query("WITH m AS (SELECT conv_id, turn, role, length(role) + 13 AS lead, length(coalesce(text, '')) + 10 AS body FROM conversations), o AS (SELECT *, coalesce(sum(lead + body + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM m) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS reply, CAST(pos + lead AS BIGINT) AS start, CAST(pos + lead + body AS BIGINT) AS \"end\" FROM o WHERE role = 'assistant'")
def reply_spans(t):
    c = readers.conversations(t("conversations"))
    return c.select("conv_id", F.posexplode(readers.reply_spans()).alias("reply", "s")).select("conv_id", F.col("reply").cast("long").alias("reply"), "s.*")


# ---- plans, progress, messages

EVOLUTIONS = ["depth", "breadth", "style", "mix"]


@query("WITH k AS (SELECT page_id, unnest(['base', 'depth', 'breadth', 'style', 'mix']) AS evol FROM pages), w AS (SELECT page_id, evol, CASE WHEN evol = 'base' THEN 'base_' || page_id ELSE 'evol_' || page_id || '_' || evol END AS key FROM k) SELECT key, evol FROM w WHERE NOT (page_id % 3 = 0 AND evol IN ('base', 'style'))")
def plan_evolutions(t):
    work = P.evolution_list(t("pages").select("page_id"), "page_id", EVOLUTIONS)
    done = t("pages").filter("page_id % 3 = 0").select(F.explode(F.array(F.concat(F.lit("base_"), F.col("page_id").cast("string")), F.concat(F.lit("evol_"), F.col("page_id").cast("string"), F.lit("_style")))).alias("_source_key"))
    return P.resume(work, done).select(F.col("_source_key").alias("key"), F.col("_evol_type").alias("evol"))


SECONDS = "(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))"


@query(f"WITH a AS (SELECT event_type, count(*) FILTER (value >= 20) AS done, count(*) FILTER (value < 20 OR value IS NULL) AS failed, {SECONDS} AS s FROM events GROUP BY 1), r AS (SELECT *, CASE WHEN s > 0 THEN (done + failed) / s ELSE 0.0 END AS rate FROM a) SELECT event_type, done, failed, rate, CASE WHEN rate > 0 THEN greatest(30000 - done - failed, 0) / rate ELSE 0.0 END AS eta_s FROM r")
def progress_eta(t):
    seconds = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).cast("double")
    return P.progress(t("events"), F.col("value") >= 20, seconds, 30000, ("event_type",))


# Messages that meet each branch; an event's number picks one, its type stands before it.
MESSAGES = [
    "Error: Insufficient Balance", "code insufficient_quota", "insufficient funds", "Payment Required", "balance not enough", "余额不足", "HTTP 402", "failed (402)",
    "status 402", "status_code=402", "load balancer at port:4021 unavailable", "port 4021", "your balance is fine", "429 too many", "Rate limit hit", "timeout", None,
]
KIND = "CASE WHEN regexp_matches(lower(m), 'insufficient balance|insufficient_quota|insufficient funds|payment required|balance not enough|余额不足| 402|\\(402|status 402|status_code=402') THEN 'balance' WHEN regexp_matches(lower(m), '429|rate limit') THEN 'rate_limit' ELSE 'other' END"


@query(f"WITH e AS (SELECT event_id, event_type || ': ' || {_sql_pick(MESSAGES, 'event_id')} AS m FROM events) SELECT event_id, m AS message, {KIND} AS kind FROM e")
def error_messages(t):
    m = F.concat("event_type", F.lit(": "), _pick(MESSAGES, F.col("event_id")))
    return t("events").select("event_id", m.alias("message")).withColumn("kind", P.error_class("message"))


# ---- reports over pages

TEN_SQL = PAGE_SQL["page_score_10"]
LABEL_CASE = "CASE dimension " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.DIMENSION_LABELS.items()) + " ELSE dimension END"


@query(f"WITH p AS ({TEN_SQL}), u AS (UNPIVOT p ON {', '.join(TEN)}, total INTO NAME dimension VALUE score) SELECT dimension, {LABEL_CASE} AS label, count(*) AS pages, CAST(sum(score) AS BIGINT) AS total, max(score) AS most FROM u GROUP BY 1, 2")
def dimension_labels(t):
    got = H.derive(t("pages")).select("page_id", H.ten_points().alias("s")).select("page_id", "s.*")
    got = got.withColumn("total", sum((F.col(k) for k in list(TEN)[1:]), F.col("complete")))
    rows = got.unpivot(["page_id"], [*TEN, "total"], "dimension", "score").withColumn("label", R.dimension_label("dimension"))
    return rows.groupBy("dimension", "label").agg(F.count("*").alias("pages"), F.sum("score").alias("total"), F.max("score").alias("most"))


PAIRED = f"WITH p AS ({PAGE_SQL['page_score_detailed']}), z AS (SELECT a.page_id AS id, a.j_js AS a1, a.i_instruction AS a2, a.f_feature AS a3, a.c_css AS a4, a.s_structure AS a5, a.total AS ta, b.j_js AS b1, b.i_instruction AS b2, b.f_feature AS b3, b.c_css AS b4, b.s_structure AS b5, b.total AS tb FROM p a JOIN p b ON b.page_id = a.page_id + 1 WHERE a.page_id % 2 = 0)"


def _versions(t):
    """Pages of even number and those after them, scored in detail, as two versions of one case."""
    names = {"J_js": "j_js", "I_instruction": "i_instruction", "F_feature": "f_feature", "C_css": "c_css", "S_structure": "s_structure", "total": "total"}
    got = H.detailed(t("pages"), ADHERENCE, KEYWORDS)
    side = lambda v, k: got.filter(F.col("page_id") % 2 == k).select((F.col("page_id") - k).alias("id"), *(F.col(c).cast("long").alias(f"{v}_{d}") for d, c in names.items()))
    return side("v1", 0).join(side("v2", 1), "id")


def _shares(x: str) -> str:
    return " || ',' || ".join(f"printf('%.4f', {x}{i} / {m})" for i, m in enumerate(R.DIMENSION_MOST.values(), 1))


@query(f"{PAIRED} SELECT id, 'v1' AS version, concat_ws(',', a1, a2, a3, a4, a5) AS scores, {_shares('a')} AS shares FROM z UNION ALL SELECT id, 'v2', concat_ws(',', b1, b2, b3, b4, b5), {_shares('b')} FROM z")
def radar_rows(t):
    r = R.radar(_versions(t), ("v1", "v2"))
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return r.select("id", "version", joined("scores", lambda x: x.cast("long").cast("string")).alias("scores"), joined("shares", lambda x: F.format_string("%.4f", x)).alias("shares"))


def _dimension_lines() -> str:
    out, at = [], 5
    for i, (d, most) in enumerate(R.DIMENSION_MOST.items(), 1):
        for v, x in (("v1", "a"), ("v2", "b")):
            out.append(f"({at}, printf('{d} {v}: %.2f/{most} ', avg({x}{i})) || repeat('█', CAST(floor(avg({x}{i}) / {most} * 20) AS BIGINT)))")
            at += 1
        out.append(f"({at}, printf('{d} difference: %+.2f', avg(b{i}) - avg(a{i})))")
        at += 1
    return ", ".join(out)


@query(f"""{PAIRED}, l AS (SELECT [(0, printf('cases: %d', count(*))), (1, printf('v1 mean: %.2f/100', avg(ta))), (2, printf('v2 mean: %.2f/100', avg(tb))), (3, printf('difference: %+.2f', avg(tb) - avg(ta))),
(4, printf('v2 wins %d, ties %d, v1 wins %d', count(*) FILTER (tb > ta), count(*) FILTER (tb = ta), count(*) FILTER (tb < ta))), {_dimension_lines()}] AS x FROM z), u AS (SELECT unnest(x) AS r FROM l) SELECT r[1] AS line, r[2] AS text FROM u""")
def version_report(t):
    return R.comparison_summary(_versions(t), ("v1", "v2"))
