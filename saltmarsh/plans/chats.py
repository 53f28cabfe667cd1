"""Queries of sessions, stores, prompts and examples, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import text as T
from saltmarsh.operators import rules, sessions
from saltmarsh.plans.text import CONTEXT_SQL
from saltmarsh.sources.tables import table


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are attachments of the conversation whose number is their user's."""
    shown = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), "ts", F.concat("event_type", F.lit(".png")).alias("file_name"), F.col("props").alias("summary"))
    return sessions.context_with_attachment(table(spark, sf_dir, "conversations"), shown).select("conv_id", F.md5("context").alias("context_md5"), "n")


_PLAIN = CONTEXT_SQL.replace("md5(string_agg(", "(string_agg(", 1).replace("AS context_md5", "AS context", 1)
ATTACHED_SQL = f"""WITH c AS ({_PLAIN}), a AS (SELECT user_id AS conv_id, arg_max(event_type || '.png', (ts, event_type)) AS f, arg_max(props, (ts, event_type)) AS p FROM events GROUP BY user_id)
SELECT conv_id, md5(CASE WHEN f IS NULL THEN '' ELSE chr(10) || '[SYSTEM: The user just uploaded an image named ''' || f || '''.]' || chr(10) || '[IMAGE ANALYSIS]: ' || p || chr(10) || '(Use this analysis to answer questions about ''the image''.)' || chr(10) END || chr(10) || coalesce(context, '')) AS context_md5,
    coalesce(n, 0) AS n FROM c FULL JOIN a USING (conv_id)"""


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are members of the suppliers that they ordered from; suppliers are workspaces."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    members = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("workspace_id"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"))
    stores = sessions.store_details(s)
    return sessions.user_workspaces(members, stores)


WORKSPACES_SQL = """WITH m AS (SELECT DISTINCT o_custkey AS user_id, l_suppkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT user_id, id, CASE WHEN s_acctbal > 0 THEN s_name ELSE 'Store ' || id END AS name, row_number() OVER (PARTITION BY user_id ORDER BY id) AS place FROM m JOIN supplier ON s_suppkey = id"""


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are old messages of their users; how many each new session holds."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("role"), F.col("props").alias("content"), "ts")
    heads, messages = sessions.legacy_sessions(e)
    return heads.join(messages.groupBy("session_id").agg(F.count("*").alias("messages")), "session_id").select("session_id", "user_id", "title", "messages")


LEGACY_SQL = "SELECT 'legacy-' || user_id AS session_id, user_id, 'Legacy Conversation' AS title, count(*) AS messages FROM events WHERE user_id IS NOT NULL GROUP BY user_id"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests of their day, from a nation to the customer; cargo and pickup only for some states."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    day = F.to_date("o_orderdate")
    line = T.trip_summary(F.col("n_name"), F.col("c_name"), F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "O", F.col("c_mktsegment")).otherwise(""), F.when(F.col("o_orderstatus") != "F", day.cast("string")))
    return o.select("o_orderkey", T.extraction_prompt(F.col("c_mktsegment"), day).alias("prompt"), line.alias("summary"))


_DAYS = "[" + ", ".join(f"'{d}'" for d in T.WEEKDAYS) + "]"
PROMPTS_SQL = f"""SELECT o_orderkey, 'Hôm nay là ' || ({_DAYS})[isodow(o_orderdate)] || ', ngày ' || strftime(o_orderdate, '%Y-%m-%d') || '.' || chr(10) || 'Tin nhắn: ' || c_mktsegment AS prompt,
    concat_ws(', ', n_name || ' → ' || c_name, 'xe ' || o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN c_mktsegment END, CASE WHEN o_orderstatus <> 'F' THEN 'lấy hàng ' || strftime(o_orderdate, '%Y-%m-%d') END) AS summary
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workflows whose nodes are their lines, typed by flag; returned lines are blocked. The two best examples."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.concat("l_linenumber", F.lit("-"), "l_partkey").alias("name"), F.col("l_returnflag").alias("type")))).alias("nodes"))  # noqa: E741
    return rules.example_workflows(l, ["R"]).select("id", "patched", "size", F.array_join(F.transform("nodes", lambda x: x["type"]), ",").alias("types"))


EXAMPLES_SQL = """SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R')::INT AS patched, count(*)::INT AS size, string_agg(CASE WHEN l_returnflag = 'R' THEN 'noOp' ELSE l_returnflag END, ',' ORDER BY l_linenumber || '-' || l_partkey, l_returnflag) AS types
FROM lineitem GROUP BY l_orderkey HAVING count(*) BETWEEN 3 AND 7 ORDER BY patched, size, id LIMIT 2"""


QUERIES = {"context_attachment": context, "user_workspaces": workspaces, "legacy_sessions": legacy, "extraction_prompts": prompts, "example_workflows": examples}
ORACLES = {"context_attachment": ATTACHED_SQL, "user_workspaces": WORKSPACES_SQL, "legacy_sessions": LEGACY_SQL, "extraction_prompts": PROMPTS_SQL, "example_workflows": EXAMPLES_SQL}
