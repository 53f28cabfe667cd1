"""Queries of the text, retrieval, session and corpus operators, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import text as T
from saltmarsh.operators import corpus, retrieval, search, selection, sessions
from saltmarsh.sources.tables import table

WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- sessions and metrics ---------------------------------------------------------------------------------


def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("session_id"), F.col("ts").alias("last_active"))
    return sessions.latest_session(events).select("user_id", "session_id")


LATEST_SQL = "SELECT user_id, event_id AS session_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def login_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "purchase", F.col("event_type")).when(F.col("value") > 90, "big").alias("workspace_id")).distinct()
    return sessions.login_state(events)


LOGIN_SQL = """SELECT user_id, count(w) AS workspaces, CASE count(w) WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'READY' ELSE 'AMBIGUOUS' END AS state
FROM (SELECT DISTINCT user_id, CASE WHEN event_type = 'purchase' THEN event_type WHEN value > 90 THEN 'big' END AS w FROM events) GROUP BY user_id"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


_TAIL = "FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6"
HISTORY_SQL = f"""SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (
    SELECT conv_id, turn, CASE WHEN lower(trim(role)) IN ('bot', 'ai', 'model') THEN 'assistant' ELSE lower(trim(role)) END AS role, text {_TAIL})
WHERE role IN ('user', 'assistant') AND {_strip("coalesce(text, '')")} <> ''"""


def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.sanitize_history(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"), F.md5("text").alias("text_md5"))


SANITIZED_SQL = f"""WITH r AS (SELECT conv_id, turn, role, {_strip("text")} AS t FROM conversations WHERE role IN ('user', 'assistant') AND {_strip("coalesce(text, '')")} <> ''),
c AS (SELECT conv_id, turn, role, CASE WHEN length(t) > 1200 THEN substr(t, 1, 1200) || ' […đã rút gọn]' ELSE t END AS t FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6),
b AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS begun FROM c)
SELECT conv_id, turn, role, length(t) AS n, md5(t) AS text_md5 FROM b WHERE begun = 1"""


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.context_text(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("context").alias("context_md5"), "n")


CONTEXT_SQL = f"""SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS context_md5, count(*) AS n FROM (
    SELECT conv_id, turn, CASE WHEN lower(trim(role)) IN ('bot', 'ai', 'model') THEN 'assistant' ELSE lower(trim(role)) END AS role, text {_TAIL})
WHERE role IN ('user', 'assistant') AND {_strip("coalesce(text, '')")} <> '' GROUP BY conv_id"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    turns = sessions.newest(table(spark, sf_dir, "events"), "event_id", 5000).select(
        F.col("event_type").alias("route"),
        (F.col("event_type") != "error").alias("ok"),
        F.round(F.col("value") * 10).cast("long").alias("latency"),
        F.when(e % 3 > 0, e % 2 == 0).alias("asked_back"),
        F.when(e % 5 == 0, e % 4 == 0).alias("workflow_valid"),
    )
    return sessions.metrics_summary(turns, ["route"])


METRICS_SQL = """WITH t AS (SELECT event_type AS route, event_type <> 'error' AS ok, round(value * 10)::BIGINT AS latency, CASE WHEN event_id % 3 > 0 THEN event_id % 2 = 0 END AS asked_back,
    CASE WHEN event_id % 5 = 0 THEN event_id % 4 = 0 END AS valid FROM events ORDER BY event_id DESC LIMIT 5000),
r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY route) AS n FROM t)
SELECT route, count(*) AS turns, round(avg(ok::INT), 4) AS ok_rate, round(avg(asked_back::INT), 4) AS asked_back_rate, round(avg(valid::INT), 4) AS workflow_valid_rate, max(latency) AS max_latency,
    max(latency) FILTER (i = floor(n * .5)) AS p50, max(latency) FILTER (i = floor(n * .95)) AS p95 FROM r GROUP BY route"""


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.index_percentile(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, 1)


PERCENTILES_SQL = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(value) FILTER (i = greatest(0, floor(n * .5) - 1)) AS p50, max(value) FILTER (i = greatest(0, floor(n * .95) - 1)) AS p95 FROM r GROUP BY event_type"""

# ---- text ----------------------------------------------------------------------------------------------------


def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunk_words(_docs(spark, sf_dir)).select(F.format_string("%d_%d", "doc_id", "chunk").alias("chunk_id"), F.md5("chunk_text").alias("text_md5"))


CHUNK_WORDS_SQL = f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, len(w), 120)) AS s FROM w)
SELECT doc_id || '_' || (s // 120) AS chunk_id, md5(array_to_string(w[s + 1:s + 150], ' ')) AS text_md5 FROM c"""


def chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunk_chars(_docs(spark, sf_dir)).select("doc_id", "chunk", F.length("chunk_text").cast("long").alias("n"), F.md5("chunk_text").alias("text_md5"))


CHUNK_CHARS_SQL = f"""WITH c AS (SELECT doc_id, unnest(range(0, length(text), 1050)) AS s, text FROM documents WHERE length(text) >= 100), t AS (SELECT doc_id, (s // 1050)::INT AS chunk, {_strip('substr(text, s + 1, 1200)')} AS t FROM c)
SELECT doc_id, chunk, length(t) AS n, md5(t) AS text_md5 FROM t WHERE length(t) > 100"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as answers, each with the page of its number as context."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    d = _docs(spark, sf_dir).select("doc_id", "text").join(pages, "doc_id", "left")
    invented = T.invented_numbers(F.col("text"), F.coalesce("html", F.lit("")))
    return d.select("doc_id", F.size(T.numbers_in(F.col("text"))).cast("long").alias("numbers"), F.size(invented).cast("long").alias("invented"))


_NUM = r"list_distinct(list_transform(regexp_extract_all({0}, '\d[\d.,]*\d|\d'), lambda x: regexp_replace(x, '[.,]', '', 'g')))"
NUMBERS_SQL = f"""WITH n AS (SELECT doc_id, {_NUM.format('text')} AS a, {_NUM.format("coalesce(html, '')")} AS c FROM documents LEFT JOIN pages ON page_id = doc_id)
SELECT doc_id, len(a) AS numbers, len(list_filter(a, lambda x: length(x) >= 4 AND NOT list_contains(c, x))) AS invented FROM n"""


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit(" sk-"), F.sha1(F.col("doc_id").cast("string")))).otherwise(F.col("text"))
    some = F.when(F.col("doc_id") % 89 == 0, F.concat(some, F.lit(" postgres://user:pass@db/x postgres://svc:k9f2@db.internal/x"))).otherwise(some)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.found_secrets(some), "|").alias("found")).filter("found <> ''")


SECRETS_SQL = r"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 97 = 0 THEN ' sk-' || sha1(doc_id::VARCHAR) ELSE '' END AS a FROM documents),
u AS (SELECT doc_id, a || CASE WHEN doc_id % 89 = 0 THEN ' postgres://user:pass@db/x postgres://svc:k9f2@db.internal/x' ELSE '' END AS b FROM t),
f AS (SELECT doc_id, list_concat(list_filter(regexp_extract_all(b, 'postgres(?:ql)?://[^\s"''\\]+'), lambda x: x NOT LIKE 'postgres://user:pass@%'),
    regexp_extract_all(b, 'npg_[A-Za-z0-9]{8,}'), regexp_extract_all(b, 'sk-[A-Za-z0-9]{20,}'), regexp_extract_all(b, 'AKIA[A-Z0-9]{16}'), regexp_extract_all(b, 'AIza[A-Za-z0-9_\-]{30,}')) AS found FROM u)
SELECT doc_id, array_to_string(found, '|') AS found FROM f WHERE len(found) > 0"""


def think(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>a</think>"), "text")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("<think>"), "text")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.strip_think(raw)).alias("text_md5"))


THINK_SQL = f"SELECT doc_id, md5({_strip('text')}) AS text_md5 FROM documents"


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.dedupe_lines(F.col("text"))).alias("text_md5"))


DEDUPE_SQL = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT *, length({_strip('line')}) >= 40 AND row_number() OVER (PARTITION BY doc_id, {_strip('line')} ORDER BY i) > 1 AS again FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM r WHERE NOT again GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN regexp_matches(text, '^\s*[\{{\[]') THEN text ELSE coalesce(t, '') END) AS text_md5 FROM documents LEFT JOIN k USING (doc_id)"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    phone, mail = F.concat(F.lit("09"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")), F.concat(F.lower("c_name"), F.lit("@shop.example"))
    return c.select("c_custkey", T.mask_phone(phone).alias("phone"), T.mask_email(mail).alias("email"))


MASKS_SQL = "SELECT c_custkey, 'XXXXXXX' || right(lpad(c_custkey::VARCHAR, 8, '0'), 3) AS phone, substr(lower(c_name), 1, 1) || '***@shop.example' AS email FROM customer"


def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    s = F.when(k == 0, F.concat(F.lit("SELECT * FROM t WHERE n = "), "p_name")).when(k == 1, "drop table x").when(k == 2, "select updated from x").otherwise("show x")
    return table(spark, sf_dir, "part").select("p_partkey", T.guard_sql(s).alias("refused"))


GUARD_SQL = "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'writes: DROP' WHEN 3 THEN 'no SELECT' END AS refused FROM part"


# ---- retrieval -----------------------------------------------------------------------------------------------


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(_docs(spark, sf_dir).select("doc_id", "text"), queries)


_LOWER_WORDS = WORDS.format("lower(text)")
BM25_SQL = f"""WITH t AS (SELECT doc_id, unnest({_LOWER_WORDS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM documents), av AS (SELECT sum(dl) / (SELECT n FROM n) AS av FROM dl),
idf AS (SELECT term, ln((n - count(*) + .5) / (count(*) + .5)) AS raw FROM tf, n GROUP BY term, n), fl AS (SELECT avg(raw) * .25 AS fl FROM idf),
q AS (SELECT item_id AS query_id, unnest({_LOWER_WORDS}) AS term FROM benchmark), a AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(times * CASE WHEN raw < 0 THEN fl ELSE raw END * tf * 2.5 / (tf + 1.5 * (.25 + .75 * dl / av))), 6) AS score FROM a JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), fl, av GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5"""


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.nearest(v, _asked(v)).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated queries of a search: the vectors whose id is divisible by 20."""
    return vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_COSINE = """usable AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
unit AS (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM usable),
near AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_dot_product(q.v, v.v) / CASE WHEN q.size * v.size = 0 THEN 1e-12 ELSE q.size * v.size END, 6) AS score FROM unit q JOIN unit v ON q.vec_id <> v.vec_id AND len(q.v) = len(v.v) WHERE q.vec_id % 20 = 0)"""
NEAREST_SQL = f"""WITH {_COSINE}
SELECT query_id, vec_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near QUALIFY rank <= 10"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item asks: its text, and the vector of its id."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    queries = items.join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")
    found = search.hybrid_search(_docs(spark, sf_dir).select("doc_id", "text"), v, queries, threshold=0.2)
    return found.select("query_id", F.md5("context").alias("context_md5"), F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"), F.col("n").cast("long").alias("n"))


def _hybrid_sql(lexical: str) -> str:
    words = "list_distinct({})".format(WORDS.format("lower(coalesce({0}, ''))"))
    return f"""WITH {_COSINE.replace("WHERE q.vec_id % 20 = 0", "WHERE q.vec_id IN (SELECT item_id FROM benchmark)")},
dense AS (SELECT query_id, vec_id AS doc_id FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10),
lexical AS ({lexical}),
met AS (SELECT query_id, text, min(doc_id) AS doc_id FROM (SELECT query_id, doc_id FROM dense UNION SELECT query_id, doc_id FROM lexical) JOIN documents USING (doc_id) GROUP BY query_id, text),
worded AS (SELECT query_id, doc_id, m.text, {words.format("b.text")} AS asked, {words.format("m.text")} AS held FROM met m JOIN benchmark b ON b.item_id = query_id),
scored AS (SELECT *, CASE WHEN len(asked) = 0 THEN 0 ELSE round(len(list_intersect(asked, held)) / len(asked), 6) END AS score FROM worded),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score >= .2 QUALIFY r <= 3)
SELECT item_id AS query_id, md5(coalesce(string_agg(r.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r), '')) AS context_md5, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY r), '') AS doc_ids, count(doc_id) AS n
FROM benchmark LEFT JOIN ranked r ON query_id = item_id GROUP BY item_id"""


HYBRID_SQL = _hybrid_sql(BM25_SQL)

ROUTES = ("EXPLAIN", "REPORT", "LOGISTICS", "TECHNICAL", "RETRIEVAL")


def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of label 0 to 4 are the five routes' examples; the stated queries are asked, each with the document of its id as text."""
    v = table(spark, sf_dir, "embeddings")
    examples = v.filter("label < 5").withColumn("route", F.element_at(F.array(*map(F.lit, ROUTES)), F.col("label").cast("int") + 1))
    near = search.nearest(examples, _asked(v), 1, "route").select("query_id", "route", F.col("score").alias("similarity"))
    said = _docs(spark, sf_dir).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), retrieval.keyword_route(F.col("text")).alias("keyword"))
    return retrieval.semantic_route(near.join(said, "query_id", "left"))


def _keyword_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{quoted(p)}', 'i') THEN '{route}'" for route, p in retrieval.KEYWORDS) + " END"


ROUTER_SQL = f"""WITH {_COSINE},
s AS (SELECT query_id, CASE label {" ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROUTES))} END AS route, max(score) AS sim FROM near WHERE label < 5 GROUP BY 1, 2),
r AS (SELECT query_id, route, sim, coalesce(lead(sim) OVER w, 0) AS nxt, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY query_id ORDER BY sim DESC, route)),
k AS (SELECT doc_id, {_keyword_sql()} AS keyword FROM documents),
m AS (SELECT query_id, route, keyword, round(sim, 4) AS score, round(sim - nxt, 4) AS gap, CASE WHEN keyword IS NOT NULL THEN 'keyword' WHEN sim < .4 THEN 'below_threshold' WHEN round(sim - nxt, 4) < .05 THEN 'narrow_margin' ELSE 'semantic' END AS method FROM r LEFT JOIN k ON doc_id = query_id WHERE r = 1)
SELECT query_id, CASE method WHEN 'keyword' THEN keyword WHEN 'semantic' THEN route ELSE 'GENERAL' END AS category, CASE WHEN method = 'keyword' THEN 1 ELSE score END AS score, gap, method FROM m"""

# ---- corpus --------------------------------------------------------------------------------------------------


def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers to the question that their source asks; the key takes the whole question and, as a rule of the method, the answer's first 160 characters."""
    key = corpus.dialogue_key(F.col("source"), F.col("text"))
    return corpus.keep_first(_docs(spark, sf_dir).select("doc_id", "source", "text"), key, "doc_id").select("doc_id")


KEEP_FIRST_SQL = f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5({_strip('source')} || '||' || substr(text, 1, 160))"


def share_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.share_cap(_docs(spark, sf_dir).select("doc_id", "lang"), F.col("lang") == "en", "doc_id")


SHARE_CAP_SQL = """WITH c AS (SELECT floor(.55 / (1 - .55) * greatest(count(*) FILTER (lang <> 'en'), 1)) AS cap FROM documents)
SELECT doc_id, lang FROM documents WHERE lang <> 'en' UNION ALL
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents WHERE lang = 'en'), c WHERE r <= cap"""


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stratified_split(_docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id")


SPLIT_SQL = """SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source) * .08)) THEN 'eval' ELSE 'train' END AS split FROM documents"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fingerprint(table(spark, sf_dir, "part"), ["p_brand"], F.format_string("%s@%d", "p_type", "p_size"))


FINGERPRINT_SQL = "SELECT p_brand, count(DISTINCT p_type || '@' || p_size)::INT AS items, substr(sha256(string_agg(DISTINCT p_type || '@' || p_size, '|' ORDER BY p_type || '@' || p_size)), 1, 16) AS fingerprint FROM part GROUP BY p_brand"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shape_errors(table(spark, sf_dir, "conversations"))


SHAPES_SQL = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT conv_id, count(*) AS messages, CASE WHEN count(*) < 3 THEN 'fewer than 3 messages' WHEN coalesce(arg_min(role, r), '') <> 'system' THEN 'first message isn''t the system''s'
    WHEN bool_or(r > 1 AND coalesce(role, '') <> CASE WHEN r % 2 = 0 THEN 'user' ELSE 'assistant' END) THEN 'roles don''t alternate' WHEN arg_max(role, r) <> 'assistant' THEN 'last message isn''t the assistant''s'
    WHEN {_strip("coalesce(arg_max(text, r), '')")} = '' THEN 'last message is empty' END AS fault FROM r GROUP BY conv_id"""


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("reason", corpus.convert_reason(F.col("text"), F.when(F.col("doc_id") % 13 == 0, "sql")))
    return corpus.share_of_groups(d, ["reason"], F.length("text").cast("long"))


REASONS_SQL = f"""WITH r AS (SELECT length(text) AS n, CASE WHEN {_strip("coalesce(text, '')")} = '' THEN 'empty_after_strip' WHEN doc_id % 13 = 0 THEN 'sql_action' WHEN length({_strip('text')}) > 12000 THEN 'too_long' WHEN length({_strip('text')}) > 1400 THEN 'report_ok' ELSE 'ok' END AS reason FROM documents)
SELECT reason, count(*) AS rows, min(n) AS least, round(avg(n), 4) AS mean, max(n) AS largest, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY reason"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "lang", "source")
    got = d.select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.upper("lang")).alias("lang"), F.when(F.col("doc_id") % 5 == 0, F.lit("src1")).otherwise(F.col("source")).alias("source"))
    want = d.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"), "source")
    return corpus.field_scores(got, want, "doc_id", ["lang", "source"])


SCORES_SQL = """WITH r AS (SELECT 'lang' AS field, CASE WHEN doc_id % 3 > 0 THEN lang END AS want, CASE WHEN doc_id % 7 > 0 THEN lang END AS got FROM documents
    UNION ALL SELECT 'source', source, CASE WHEN doc_id % 5 = 0 THEN 'src1' ELSE source END FROM documents)
SELECT field, count(*) FILTER (want IS NOT DISTINCT FROM got) AS correct, count(*) FILTER (want IS NULL AND got IS NOT NULL) AS false_fill, count(*) FILTER (want IS NOT NULL AND got IS NULL) AS miss, count(*) FILTER (want <> got) AS wrong FROM r GROUP BY field"""


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.within_budget(_docs(spark, sf_dir), F.ceil(F.length("text") / 3.5), 3000)


BUDGET_SQL = """SELECT count(*) AS rows, count(*) FILTER (ceil(length(text) / 3.5) > 3000) AS over, CASE WHEN over = 0 THEN 'ok' WHEN over / count(*) < .1 THEN 'warn' ELSE 'fail' END AS verdict FROM documents"""


QUERIES = {
    "latest_session": latest_session,
    "login_state": login_state,
    "history_last6": history,
    "sanitize_history": sanitized,
    "context_text": context,
    "metrics_summary": metrics,
    "latency_percentiles": percentiles,
    "chunk_words": chunk_words,
    "chunk_chars": chunk_chars,
    "numbers_containment": numbers,
    "secret_scan": secrets,
    "strip_think": think,
    "dedupe_lines": dedupe,
    "pii_mask": masks,
    "sql_guard": guard,
    "bm25_topk": bm25,
    "cosine_topk": nearest,
    "hybrid_search": hybrid,
    "router_margin": router,
    "dedup_keep_first": keep_first,
    "share_cap": share_cap,
    "stratified_split": split,
    "fingerprint": fingerprints,
    "role_alternation": shapes,
    "convert_reasons": reasons,
    "score_fields": scores,
    "token_budget": budget,
}
ORACLES = {
    "latest_session": LATEST_SQL,
    "login_state": LOGIN_SQL,
    "history_last6": HISTORY_SQL,
    "sanitize_history": SANITIZED_SQL,
    "context_text": CONTEXT_SQL,
    "metrics_summary": METRICS_SQL,
    "latency_percentiles": PERCENTILES_SQL,
    "chunk_words": CHUNK_WORDS_SQL,
    "chunk_chars": CHUNK_CHARS_SQL,
    "numbers_containment": NUMBERS_SQL,
    "secret_scan": SECRETS_SQL,
    "strip_think": THINK_SQL,
    "dedupe_lines": DEDUPE_SQL,
    "pii_mask": MASKS_SQL,
    "sql_guard": GUARD_SQL,
    "bm25_topk": BM25_SQL,
    "cosine_topk": NEAREST_SQL,
    "hybrid_search": HYBRID_SQL,
    "router_margin": ROUTER_SQL,
    "dedup_keep_first": KEEP_FIRST_SQL,
    "share_cap": SHARE_CAP_SQL,
    "stratified_split": SPLIT_SQL,
    "fingerprint": FINGERPRINT_SQL,
    "role_alternation": SHAPES_SQL,
    "convert_reasons": REASONS_SQL,
    "score_fields": SCORES_SQL,
    "token_budget": BUDGET_SQL,
}
