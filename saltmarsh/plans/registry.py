"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.plans import business, chats, events, extraction, grading, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**business.QUERIES, **text.QUERIES, **events.QUERIES, **extraction.QUERIES, **grading.QUERIES, **chats.QUERIES}
ORACLES: dict[str, str] = {**business.ORACLES, **text.ORACLES, **events.ORACLES, **extraction.ORACLES, **grading.ORACLES, **chats.ORACLES}
