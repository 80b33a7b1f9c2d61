"""Audit events: A1-A3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeep.sources.tables import write_table

SEVERITIES = ("INFO", "WARNING", "ERROR")
DEFAULT_LIMIT = 50
MAX_LIMIT = 200
EVENT_SCHEMA = "event_type string, message string, severity string"


def event_rows(spark: SparkSession, events: list[tuple[str, str, str]]) -> DataFrame:
    """A batch of ``(event_type, message, severity)`` with a timestamp."""
    return spark.createDataFrame(events, EVENT_SCHEMA).withColumn(
        "created_at", F.current_timestamp())


def log_event(spark: SparkSession, path: str, event_type: str, message: str,
              severity: str = "INFO") -> DataFrame:
    """A1: append one audit event (callers batch several into one write
    with :func:`log_events`)."""
    return log_events(spark, path, [(event_type, message, severity)])


def append_events(events: DataFrame, path: str) -> DataFrame:
    """A1 for events that a job derives: rows with ``event_type``, ``message``
    and ``severity`` are appended where they are, each with an id of its own;
    ``created_at`` is now, where they bring none."""
    if "created_at" not in events.columns:
        events = events.withColumn("created_at", F.current_timestamp())
    return write_table(events.select("event_type", "message", "severity", "created_at"), path)


def log_events(spark: SparkSession, path: str, events: list[tuple[str, str, str]]) -> DataFrame:
    return write_table(event_rows(spark, events), path)


def list_events(log: DataFrame, event_type: str | None = None, severity: str | None = None,
                limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """A2: optional equality filters, newest first, ``offset`` then
    ``limit`` (1..200).  Sort + offset + limit plans a bounded top-k."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    out = log
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    if severity:
        out = out.where(F.col("severity") == severity)
    ordered = out.orderBy(F.col("created_at").desc(), F.col("id").desc())
    # limit(offset + limit).offset(offset) is the LIMIT .. OFFSET shape that
    # plans TakeOrderedAndProject(limit, offset): a per-partition top-k.
    return ordered.limit(offset + limit).offset(offset) if offset else ordered.limit(limit)


def severity_counts(events: DataFrame) -> DataFrame:
    """A3: INFO / WARNING / ERROR counts of the listed page."""
    s = F.col("severity")
    return events.agg(*[F.count_if(s == v).cast("long").alias(v.lower()) for v in SEVERITIES])
