"""Old training samples of several sources as one corpus: each with the reason why it is kept or not, and all of them accounted for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.text import strip_think, stripped
from saltmarsh.operators.corpus import MAX_ANSWER_CHARS, MAX_REPORT_CHARS
from saltmarsh.operators.extraction import any_object
from saltmarsh.operators.rules import validate_workflows

#: What marks a sample of another product; the kept kinds by reason. Fixed values.
FOREIGN = ("Make.com", '"__IMTCONN__"')
KINDS = {"ok": "v2_consult", "report_ok": "v2_report", "workflow_ok": "v2_n8n"}
MAX_NODES = 12


def _said(role: str, last: bool) -> Column:
    """The first or last message of a role."""
    own = F.filter("messages", lambda m: m["role"] == role)
    return F.coalesce(F.try_element_at(own, F.lit(-1 if last else 1))["content"], F.lit(""))


def _nodes(flow: Column) -> Column:
    """The nodes of a workflow (variant), as ``validate_workflows`` takes them."""
    get = F.try_variant_get
    return F.transform(
        get(flow, "$.nodes", "array<variant>"),
        lambda n: F.struct(
            get(n, "$.name", "string").alias("name"),
            get(n, "$.type", "string").alias("type"),
            get(n, "$.typeVersion", "double").alias("typeVersion"),
            get(n, "$.position", "array<int>").alias("position"),
            get(n, "$.parameters.query", "string").alias("statement"),
        ),
    )


def _edges(flow: Column) -> Column:
    """The connections of a workflow, from name to name."""
    links = F.map_entries(F.coalesce(F.try_variant_get(flow, "$.connections", "map<string,variant>"), F.create_map().cast("map<string,variant>")))

    def of(entry: Column) -> Column:
        ends = F.flatten(F.coalesce(F.try_variant_get(entry["value"], "$.main", "array<array<variant>>"), F.array().cast("array<array<variant>>")))
        return F.transform(ends, lambda e: F.struct(entry["key"].alias("src"), F.try_variant_get(e, "$.node", "string").alias("dest")))

    return F.flatten(F.transform(links, of))


def convert(samples: DataFrame, catalog: DataFrame, blocked: list[str]) -> DataFrame:
    """Each sample (id, messages: array of role, content) with its ``reason`` and, if kept, ``kind``, ``question`` and ``answer``.

    Reasons, the first that holds: malformed (fewer than two messages), make_com, malformed (no question or answer), empty_after_strip (nothing but reasoning), sql_action,
    workflow_invalid or workflow_ok (an envelope ``create_workflow`` or a workflow itself, of 12 nodes at most, checked as a graph), malformed (an answer that begins as another
    object), too_long, report_ok, ok. Samples are read once; only workflows meet the catalogue.
    """
    m = F.coalesce(F.size("messages"), F.lit(0))
    blob = F.concat_ws("\n", F.transform("messages", lambda x: x["content"]))
    foreign = F.lit(False)
    for mark in FOREIGN:
        foreign = foreign | F.contains(blob, F.lit(mark))
    rows = samples.select("*", _said("user", False).alias("question"), strip_think(_said("assistant", True)).alias("answer"), _said("assistant", True).alias("_raw"), foreign.alias("_foreign"), m.alias("_n"))
    rows = rows.withColumn("_block", any_object(F.when(F.contains("answer", F.lit("{")), F.col("answer")).otherwise("")))
    rows = rows.withColumn("_v", F.try_parse_json("_block"))
    action = F.try_variant_get("_v", "$.action", "string")
    flow = F.when(action == "create_workflow", F.coalesce(F.try_variant_get("_v", "$.payload", "variant"), F.col("_v"))).when(F.try_variant_get("_v", "$.nodes", "array<variant>").isNotNull(), F.col("_v"))
    rows = rows.withColumn("_action", action).withColumn("_flow", flow)
    before = (
        F.when(F.col("_n") < 2, "malformed")
        .when(F.col("_foreign"), "make_com")
        .when((F.col("question") == "") | (F.col("_raw") == ""), "malformed")
        .when(F.col("answer") == "", "empty_after_strip")
        .when(F.col("_action") == "query_db", "sql_action")
    )
    after = (
        F.when(F.col("_block").isNotNull() & (F.startswith("answer", F.lit("{")) | F.startswith("answer", F.lit("```"))), "malformed")
        .when(F.length("answer") > MAX_REPORT_CHARS, "too_long")
        .when(F.length("answer") > MAX_ANSWER_CHARS, "report_ok")
        .otherwise("ok")
    )
    rows = rows.withColumn("_before", before)
    named = F.coalesce(F.try_variant_get("_flow", "$.name", "string"), F.try_variant_get("_v", "$.name", "string"), F.lit("workflow"))
    flows = rows.filter(F.col("_flow").isNotNull() & F.col("_before").isNull()).select("id", named.alias("name"), _nodes(F.col("_flow")).alias("nodes"), _edges(F.col("_flow")).alias("edges"))
    faults = validate_workflows(flows, catalog, blocked).select("id", "fault", F.lit(True).alias("_checked"))
    large = F.size(F.try_variant_get("_flow", "$.nodes", "array<variant>")) > MAX_NODES
    workflow = F.when(F.col("fault").isNotNull() | F.coalesce(large, F.lit(False)), "workflow_invalid").otherwise("workflow_ok")
    told = rows.join(faults, "id", "left").withColumn("reason", F.coalesce("_before", F.when(F.coalesce("_checked", F.lit(False)), workflow), after))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("reason"))
    kept = F.col("reason").isin(*KINDS)
    text = F.when(F.col("reason") == "workflow_ok", F.col("_block")).otherwise(F.col("answer"))
    return told.select(*samples.columns, "reason", F.when(kept, kind).alias("kind"), F.when(kept, F.col("question")).alias("question"), F.when(kept, stripped(text)).alias("answer"))


def merge(sources: dict[str, DataFrame], catalog: DataFrame, blocked: list[str]) -> DataFrame:
    """All samples (id, messages) of the named sources, converted. Ids are made those of (source, id)."""
    every = [df.select(F.lit(name).alias("source"), F.struct(F.lit(name).alias("source"), "id").alias("id"), "messages") for name, df in sources.items()]
    return convert(reduce(DataFrame.unionByName, every), catalog, blocked)


def account(converted: DataFrame) -> DataFrame:
    """Samples, and kept ones, of each source and reason."""
    return converted.groupBy("source", "reason").agg(F.count("*").alias("samples"), F.count("kind").alias("kept"))
