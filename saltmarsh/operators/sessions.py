"""Chat sessions, histories and turn metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.functions.text import stripped
from saltmarsh.operators.selection import index_percentile

MAX_CHARS, LIMIT = 1200, 6
CUT_MARK = " […đã rút gọn]"  # fixed value


def latest_session(sessions: DataFrame) -> DataFrame:
    """Each user's session with the latest ``last_active``, of all workspaces."""
    last = F.max_by(F.struct(*sessions.columns), F.struct("last_active", "session_id"))
    return sessions.groupBy(F.col("user_id").alias("_u")).agg(last.alias("_row")).select("_row.*")


def login_state(memberships: DataFrame) -> DataFrame:
    """READY, AMBIGUOUS or EMPTY by how many workspaces a user has."""
    n = F.count("workspace_id")
    return memberships.groupBy("user_id").agg(n.alias("workspaces"), F.when(n == 0, "EMPTY").when(n == 1, "READY").otherwise("AMBIGUOUS").alias("state"))


def normal_role(role: Column) -> Column:
    role = F.lower(F.trim(role))
    return F.when(role.isin("bot", "ai", "model"), "assistant").otherwise(role)


def history(messages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The newest ``limit`` messages of each conversation in order; empty ones and other roles go after that cut."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).drop("_r")
    rows = last.withColumn("role", normal_role(F.col("role")))
    return rows.filter(F.col("role").isin("user", "assistant") & (stripped(F.coalesce("text", F.lit(""))) != ""))


def sanitize_history(messages: DataFrame, limit: int = LIMIT, max_chars: int = MAX_CHARS) -> DataFrame:
    """User and assistant messages with text, cut to ``max_chars``, the last ``limit``, beginning with a user's."""
    rows = messages.filter(F.col("role").isin("user", "assistant") & (stripped(F.coalesce("text", F.lit(""))) != ""))
    text = stripped(F.col("text"))
    rows = rows.withColumn("text", F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit(CUT_MARK))).otherwise(text))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= limit)
    begun = F.max(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("_b", begun).filter("_b = 1").drop("_b", "_r")


def context_text(messages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The history of each conversation as lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))), lambda x: x["line"])
    return history(messages, limit).groupBy("conv_id").agg(F.array_join(lines, "\n").alias("context"), F.count("*").alias("n"))


def context_with_attachment(messages: DataFrame, attachments: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The history of each conversation behind what its latest attachment shows (conv_id, file_name, summary, ts); of equal times the larger name counts. A conversation with an attachment only has an empty history."""
    shown = F.max(F.struct("ts", "file_name", "summary"))
    last = attachments.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(shown.alias("a"))
    text = F.concat(F.lit("\n[SYSTEM: The user just uploaded an image named '"), F.coalesce("a.file_name", F.lit("")), F.lit("'.]\n[IMAGE ANALYSIS]: "), F.coalesce("a.summary", F.lit("")), F.lit("\n(Use this analysis to answer questions about 'the image'.)\n"))
    joined = context_text(messages, limit).join(last, "conv_id", "full")
    return joined.select("conv_id", F.concat(F.when(F.col("a").isNotNull(), text).otherwise(""), F.lit("\n"), F.coalesce("context", F.lit(""))).alias("context"), F.coalesce("n", F.lit(0)).alias("n"))


STORE_DEFAULTS = {"industry": "Retail", "location": "Unknown"}  # fixed values


def user_workspaces(memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(user_id, id, name, place): the workspaces (id, name) of each user's memberships (user_id, workspace_id), each once, in the order of their ids. Memberships of unknown workspaces give none."""
    own = memberships.select("user_id", F.col("workspace_id").alias("id")).distinct().join(workspaces, "id")
    return own.select("user_id", "id", "name", F.row_number().over(Window.partitionBy("user_id").orderBy("id")).alias("place"))


def store_details(workspaces: DataFrame) -> DataFrame:
    """Workspaces as stores: a name of its own where there is none, and the usual industry and place."""
    named = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Store "), F.col("id").cast("string")))
    return workspaces.select("id", named.alias("name"), *[F.lit(v).alias(k) for k, v in STORE_DEFAULTS.items()])


def legacy_sessions(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old messages (user_id, role, content, ts) moved to sessions: one for each user (session_id, user_id, title, last_active), and the messages with it. Messages without a user stay behind."""
    known = messages.filter(F.col("user_id").isNotNull())
    session = F.concat(F.lit("legacy-"), F.col("user_id").cast("string"))
    sessions = known.groupBy("user_id").agg(F.max("ts").alias("last_active"))
    return sessions.select(session.alias("session_id"), "user_id", F.lit("Legacy Conversation").alias("title"), "last_active"), known.select(session.alias("session_id"), "role", "content", F.col("ts").alias("created_at"))


def newest(rows: DataFrame, order: str, keep: int) -> DataFrame:
    """The ``keep`` rows that came last: a bounded registry or the tail of a log."""
    return rows.orderBy(F.desc(order)).limit(keep)


def registry(updates: DataFrame, capacity: int = 1000) -> DataFrame:
    """The newest ``capacity`` tasks of each owner by the time they first came, with their latest status: an update keeps its task's place.

    updates: owner, seq, task_id, status. Equal to the stream's registry as long as no task returns after its eviction. Tasks are aggregated first, so
    only (owner, task) rows are ranked; a task comes at its smallest ``seq``.
    """
    tasks = updates.groupBy("owner", "task_id").agg(F.min("seq").alias("since"), F.max_by("status", "seq").alias("status"))
    order = Window.partitionBy("owner").orderBy(F.desc("since"), F.desc("task_id"))
    return tasks.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= capacity).drop("_r")


def metrics_summary(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Rates and latencies of turns (ok, latency, asked_back, workflow_valid): of nullable flags only where they are known."""
    rates = turns.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        F.round(F.avg(F.col("ok").cast("int")), 4).alias("ok_rate"),
        F.round(F.avg(F.col("asked_back").cast("int")), 4).alias("asked_back_rate"),
        F.round(F.avg(F.col("workflow_valid").cast("int")), 4).alias("workflow_valid_rate"),
        F.max("latency").alias("max_latency"),
    )
    places = index_percentile(turns, keys, "latency", {"p50": 0.5, "p95": 0.95}).select(F.struct(*keys).alias("_k"), "p50", "p95")
    return rates.withColumn("_k", F.struct(*keys)).join(places, "_k", "left").drop("_k")
