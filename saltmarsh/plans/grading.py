"""Queries of grades, sample checks, reports and notices, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import text as T
from saltmarsh.functions.money import money
from saltmarsh.operators import grading
from saltmarsh.sources.tables import table

SPACE = T.SPACE


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _expected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What documents hold, and what was read of them: their first word without its accents' case, their source as the event of their number has it."""
    d = table(spark, sf_dir, "documents")
    word = F.substring_index("text", " ", 1)
    want = d.select("doc_id", "lang", "source", word.alias("word"), F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("size"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type", "value")
    m = d.join(e, "doc_id", "left")
    got = m.select(
        "doc_id",
        F.upper(F.concat(F.lit(" "), "source")).alias("source"),
        F.when(F.col("event_type") == "click", F.lit("?")).when(F.col("event_type") == "view", F.lit(" ")).otherwise(F.upper(word)).alias("word"),
        F.when(F.col("value") < 10, F.col("n_chars")).alias("size"),
    )
    return want, got.filter(F.coalesce(F.col("value"), F.lit(0.0)) < 40)


_GRADED = f"""m AS (SELECT doc_id, lang, source, split_part(text, ' ', 1) AS word, n_chars, event_type, value, coalesce(value, 0) < 40 AS answered FROM documents LEFT JOIN events ON event_id = doc_id),
f AS (SELECT doc_id, lang AS kind, 'source' AS field, {_strip('source')} AS want, CASE WHEN answered THEN {_strip("upper(' ' || source)")} END AS got FROM m
    UNION ALL SELECT doc_id, lang, 'word', {_strip('word')}, CASE WHEN answered THEN {_strip("CASE event_type WHEN 'click' THEN '?' WHEN 'view' THEN ' ' ELSE upper(word) END")} END FROM m
    UNION ALL SELECT doc_id, lang, 'size', CASE WHEN n_chars > 500 THEN n_chars::VARCHAR END, CASE WHEN answered AND value < 10 THEN n_chars::VARCHAR END FROM m),
g AS (SELECT *, CASE WHEN w IS NULL AND g IS NULL THEN 'correct' WHEN w IS NULL THEN 'false_fill' WHEN g IS NULL THEN 'miss' WHEN w = g THEN 'correct' ELSE 'wrong' END AS outcome
    FROM (SELECT doc_id, kind, field, nullif(lower(strip_accents(want)), '') AS w, nullif(lower(strip_accents(got)), '') AS g FROM f)),
r AS (SELECT doc_id, kind, bool_and(outcome = 'correct' OR field = 'size') AS ready FROM g GROUP BY 1, 2)"""


def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    want, got = _expected(spark, sf_dir)
    return grading.extraction_report(grading.graded_fields(want, got, "doc_id", ["source", "word", "size"], "lang"), "doc_id", ["source", "word"])


EXTRACTION_SQL = f"""WITH {_GRADED},
a AS (SELECT kind, grouping(kind) = 1 AS all_kinds, count(*) AS rows, round(avg(ready::INT), 4) AS ready_rate FROM r GROUP BY ROLLUP (kind)),
b AS (SELECT kind, grouping(kind) = 1 AS all_kinds, round(avg((outcome = 'correct')::INT), 4) AS field_rate, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'false_fill') AS false_fill,
    count(*) FILTER (outcome = 'miss') AS miss, count(*) FILTER (outcome = 'wrong') AS wrong FROM g GROUP BY ROLLUP (kind))
SELECT a.kind, a.all_kinds, rows, ready_rate, field_rate, correct, false_fill, miss, wrong FROM a JOIN b ON a.kind IS NOT DISTINCT FROM b.kind AND a.all_kinds = b.all_kinds"""


def extraction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.gates(extraction_scores(spark, sf_dir).filter("all_kinds"), {"field_rate": 0.85, "ready_rate": 0.80})


GATES_SQL = f"""WITH s AS (SELECT * FROM ({EXTRACTION_SQL}) WHERE all_kinds)
SELECT 'field_rate' AS gate, field_rate AS value, .85::DOUBLE AS threshold, field_rate >= .85 AS passed FROM s UNION ALL SELECT 'ready_rate', ready_rate, .8, ready_rate >= .8 FROM s"""


def agent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for turns: the type is the tool (none for errors), what was called goes by the value, and large values should be asked about."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    got = F.when(F.col("value") < 15, F.col("event_type")).when(k > 50, "search")
    return grading.agent_report(e.select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("tool"), F.when(F.col("value") < 35, got).alias("got_tool"), (F.col("value") > 30).alias("ask"), (k > 20).alias("asked")))


AGENT_SQL = """WITH t AS (SELECT CASE WHEN event_type <> 'error' THEN event_type END AS tool, CASE WHEN value < 15 THEN event_type WHEN value < 35 AND (props::JSON->>'$.k')::INT > 50 THEN 'search' END AS got, value > 30 AS ask, (props::JSON->>'$.k')::INT > 20 AS asked FROM events)
SELECT count(*) AS turns, round(avg(coalesce(tool = got, false)::INT) FILTER (tool IS NOT NULL), 4) AS tool_rate, round(avg(asked::INT) FILTER (ask), 4) AS ask_back_rate, round(avg((got IS NULL)::INT) FILTER (tool IS NULL), 4) AS restraint_rate FROM t"""


def narration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("context"))
    return grading.narration_report(table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("answer")).join(pages, "doc_id", "left"), "lang")


_NUM = r"list_distinct(list_transform(regexp_extract_all({0}, '\d[\d.,]*\d|\d'), lambda x: regexp_replace(x, '[.,]', '', 'g')))"
NARRATION_SQL = f"""WITH n AS (SELECT lang, {_NUM.format("coalesce(text, '')")} AS a, {_NUM.format("coalesce(html, '')")} AS c, len(regexp_extract_all(coalesce(text, ''), '(?i)\\b(margin|carrier_cost|internal)\\b')) > 0 AS leaks FROM documents LEFT JOIN pages ON page_id = doc_id),
t AS (SELECT lang, leaks, len(list_filter(a, lambda x: length(x) >= 4 AND NOT list_contains(c, x))) > 0 AS invents FROM n)
SELECT lang, count(*) AS answers, count(*) FILTER (invents) AS invented, count(*) FILTER (leaks) AS leaked, round(avg((NOT invents AND NOT leaks)::INT), 4) AS pass_rate FROM t GROUP BY lang"""


def sample_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as samples: their messages, the last answer with the one before as reasoning where it isn't short."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    thought = F.transform("m", lambda x, i: F.struct(x["role"].alias("role"), F.when((x["role"] == "assistant") & (i > 0), F.concat(F.lit("<think>"), F.get("m", i - 1)["text"], F.when(F.length(x["text"]) > 300, "</think>{").otherwise("</think>"), x["text"])).otherwise(x["text"]).alias("content")))
    return grading.sample_faults(c.select(F.col("conv_id").alias("id"), thought.alias("messages"))).select("id", F.array_join("faults", "; ").alias("faults"))


SAMPLES_SQL = f"""WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
a AS (SELECT conv_id, any_value(n) AS n, arg_max(i, i) FILTER (role = 'assistant') AS i, arg_max(prior, i) FILTER (role = 'assistant' AND i > 0) AS prior, arg_max(text, i) FILTER (role = 'assistant') AS text FROM c GROUP BY conv_id),
w AS (SELECT *, i > 0 AS wrapped, coalesce(length(text), 0) > 300 AS open FROM a)
SELECT conv_id AS id, concat_ws('; ', CASE WHEN n < 3 THEN 'fewer than 3 messages' END, CASE WHEN NOT coalesce(wrapped, false) THEN 'no reasoning' END,
    CASE WHEN wrapped AND length({_strip('prior')}) < 150 THEN 'reasoning under 150 characters' END, CASE WHEN wrapped AND open THEN 'unbalanced braces' END) AS faults FROM w"""


def seed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as seeds: their first line is the prompt."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("prompt"), "lang", "source")
    return grading.seed_faults(d, {"lang": ["en", "fr", "de"], "source": [f"src{i}" for i in range(18)]}).filter(F.size("faults") > 0).select("id", F.array_join("faults", "; ").alias("faults"))


SEEDS_SQL = f"""WITH d AS (SELECT doc_id AS id, lang, source, lower({_strip("coalesce(split_part(text, chr(10), 1), '')")}) AS p FROM documents),
f AS (SELECT id, concat_ws('; ', CASE WHEN NOT coalesce(lang IN ('en', 'fr', 'de'), false) THEN 'lang not known' END, CASE WHEN NOT coalesce(source IN (SELECT 'src' || i FROM range(18) t(i)), false) THEN 'source not known' END,
    CASE WHEN length(p) < 30 THEN 'prompt too short' END, CASE WHEN length(p) > 600 THEN 'prompt too long' END, CASE WHEN id <> min(id) OVER (PARTITION BY p) THEN 'prompt repeats' END) AS faults FROM d)
SELECT id, faults FROM f WHERE faults <> ''"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's price change stands for rain, its quantity for degrees."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", grading.weather(F.col("l_extendedprice") / 1000, F.col("l_quantity")).alias("weather"))


WEATHER_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice / 1000 > 50 THEN 'Rainy' WHEN l_quantity > 35 THEN 'Hot' ELSE 'Sunny' END AS weather FROM lineitem"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    q = F.col("l_quantity").cast("long")
    returned = F.col("l_returnflag") == "R"
    rows = l.select(F.col("l_orderkey").alias("batch"), q.alias("planned"), F.when(~returned, q).otherwise(0).alias("good"), F.when(returned, q).otherwise(0).alias("rejected"), F.when(~returned, money(F.col("l_extendedprice"))).alias("revenue"), (money(F.col("l_extendedprice")) * F.lit("0.5").cast("decimal(2,1)")).alias("cost"))
    found = grading.batch_report(rows, 60.0)
    return found.select("batch", *[F.col(c).cast("double").alias(c) for c in ("yield_pct", "ng_pct", "profit")], "warn")


BATCHES_SQL = """WITH s AS (SELECT l_orderkey AS batch, sum(l_quantity::BIGINT) AS planned, coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag <> 'R'), 0) AS good, coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R'), 0) AS bad,
    coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag <> 'R'), 0) - sum(l_extendedprice::DECIMAL(18,2) * 0.5::DECIMAL(2,1)) AS profit FROM lineitem GROUP BY 1),
t AS (SELECT batch, round(100 * good / planned, 2) AS yield_pct, round(100 * bad / (good + bad), 2) AS ng_pct, round(profit, 2)::DOUBLE AS profit FROM s)
SELECT *, yield_pct < 60 OR ng_pct > 3 AS warn FROM t"""


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notices; the channel goes by language."""
    channel = F.when(F.col("lang") == "en", "Zalo").when(F.col("lang") == "de", "telegram").when(F.col("lang") == "fr", "other")
    found = grading.routed_notices(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), channel.alias("channel"), "text"))
    return found.select("id", "channel", F.md5("text").alias("text_md5"))


NOTICES_SQL = "SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'zalo' WHEN 'de' THEN 'telegram' ELSE 'discord' END AS channel, md5(left(coalesce(text, ''), 3800)) AS text_md5 FROM documents"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are invoices, their returned lines adjust them: the status always, the amount in whole units if there was a discount."""
    issued = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice"), F.floor("o_totalprice").cast("long").alias("amount"), F.col("o_orderstatus").alias("status"))
    l = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")  # noqa: E741
    adjusted = l.select(F.col("l_orderkey").alias("invoice"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"), F.when(F.col("l_discount") > 0, F.floor("l_extendedprice").cast("long")).alias("amount"), "l_linestatus").groupBy("invoice", "seq").agg(F.max("amount").alias("amount"), F.max("l_linestatus").alias("status"))
    return grading.invoice_versions(issued, adjusted, ["amount", "status"])


VERSIONS_SQL = """WITH a AS (SELECT l_orderkey AS invoice, l_linenumber * 1000000 + l_partkey AS seq, max(CASE WHEN l_discount > 0 THEN floor(l_extendedprice)::BIGINT END) AS amount, max(l_linestatus) AS status FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2),
v AS (SELECT o_orderkey AS invoice, NULL AS seq, floor(o_totalprice)::BIGINT AS amount, o_orderstatus AS status FROM orders UNION ALL SELECT * FROM a),
w AS (SELECT invoice, (row_number() OVER o - 1)::INT AS version, last_value(amount IGNORE NULLS) OVER o AS amount, last_value(status IGNORE NULLS) OVER o AS status FROM v WINDOW o AS (PARTITION BY invoice ORDER BY seq NULLS FIRST))
SELECT *, sha256(invoice || '|' || version || '|' || coalesce(amount::VARCHAR, '') || '|' || coalesce(status, '')) AS sha256 FROM w"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a model's answers with reasoning around them and as messages with a request in brackets; pages as marked-up texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    raw = F.when(F.col("lang") == "en", F.concat(F.lit("<THINK>a\nb</think>```json\n"), "text", F.lit("\n```"))).when(F.col("lang") == "de", F.concat(F.lit("lost </think>"), "text", F.lit("<think>never closed"))).otherwise(F.col("text"))
    request = F.when(F.col("lang") == "fr", F.concat(F.lit("[SYSTEM] x [USER REQUEST] "), "text")).otherwise(F.col("text"))
    marked = F.concat(F.lit("## Head\n![i](u) see [this](http://x/y) "), "text", F.lit("\n\n\n\nend "))
    return d.select("doc_id", F.md5(T.clean_output(raw)).alias("answer_md5"), F.md5(T.user_content(request)).alias("request_md5"), F.md5(T.clean_markdown(marked)).alias("markdown_md5"), T.fuzzy_contains(F.col("text"), F.lit("ELLE")).alias("has_elle"))


_LINES = f"""l AS (SELECT doc_id, unnest(string_split({_strip('text')}, chr(10))) AS line, generate_subscripts(string_split({_strip('text')}, chr(10)), 1) AS i FROM documents),
r AS (SELECT *, length({_strip('line')}) >= 40 AND row_number() OVER (PARTITION BY doc_id, {_strip('line')} ORDER BY i) > 1 AS again FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM r WHERE NOT again GROUP BY doc_id)"""
CLEANED_SQL = f"""WITH {_LINES}, c AS (SELECT d.*, {_strip("CASE WHEN regexp_matches(text, '^\\s*[\\{{\\[]') THEN text ELSE coalesce(t, '') END")} AS answer FROM documents d LEFT JOIN k USING (doc_id))
SELECT doc_id, md5(CASE WHEN answer = '' THEN '{T.EMPTY_ANSWER}' ELSE answer END) AS answer_md5, md5(CASE WHEN lang = 'fr' THEN {_strip("regexp_extract(text, '(?s)^(.*?)(\\[|$)', 1)")} ELSE text END) AS request_md5,
    md5({_strip("regexp_replace(regexp_replace('Head' || chr(10) || ' see this ' || regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g') || repeat(chr(10), 4) || 'end ', '(?m)^#+\\s*', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS markdown_md5,
    contains(lower(strip_accents(text)), 'elle') AS has_elle FROM c"""


QUERIES = {
    "extraction_scores": extraction_scores,
    "extraction_gates": extraction_gates,
    "agent_scores": agent_scores,
    "narration_scores": narration_scores,
    "sample_checks": sample_checks,
    "seed_checks": seed_checks,
    "weather_class": forecasts,
    "batch_yield": batches,
    "notice_routing": notices,
    "invoice_versions": versions,
    "clean_texts": cleaned,
}
ORACLES = {
    "extraction_scores": EXTRACTION_SQL,
    "extraction_gates": GATES_SQL,
    "agent_scores": AGENT_SQL,
    "narration_scores": NARRATION_SQL,
    "sample_checks": SAMPLES_SQL,
    "seed_checks": SEEDS_SQL,
    "weather_class": WEATHER_SQL,
    "batch_yield": BATCHES_SQL,
    "notice_routing": NOTICES_SQL,
    "invoice_versions": VERSIONS_SQL,
    "clean_texts": CLEANED_SQL,
}
