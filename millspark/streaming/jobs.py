"""Structured Streaming jobs. Sinks write one folder per micro-batch, so a repeated batch overwrites itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millspark.functions.keyed import latest_by, order_key


def batch_sink(stream: DataFrame, path: str, build: Callable[[DataFrame, int], DataFrame], mode: str = "append") -> DataStreamWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch, batch_id).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write)


def written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def dedupe_uploads(stream: DataFrame, path: str) -> DataStreamWriter:
    """First upload of each content hash: the earliest of its batch, unless an earlier batch wrote that hash.

    No watermark decides: a new document stays new however late it comes. Of earlier output only the hashes are read.
    """
    def build(batch: DataFrame, batch_id: int) -> DataFrame:
        first = F.min_by(F.struct(*[F.col(c) for c in batch.columns]), order_key("uploaded_at", "document_id"))
        fresh = batch.groupBy("sha256").agg(first.alias("_first")).select("_first.*")
        if batch_id == 0:
            return fresh
        known = written(batch.sparkSession, path).filter(F.col("batch") < batch_id).select("sha256").distinct()
        return fresh.join(known, "sha256", "left_anti").select(batch.columns)
    return batch_sink(stream, path, build)


def first_uploads(uploads: DataFrame) -> DataFrame:
    """Batch twin: the first document of each hash, in the same order the stream sees them."""
    return uploads.groupBy("sha256").agg(F.min_by("document_id", order_key("uploaded_at", "document_id")).alias("document_id"))


def route_uploads(stream: DataFrame, path: str) -> DataStreamWriter:
    """Every upload with ``original_id``: the first document of the same content, null for that document itself.

    The state holds one id per content hash, so a batch looks up its own hashes only and reads no earlier output. In a
    batch the earliest upload is the first; an upload that arrives in a later batch is a duplicate however early its time.
    """
    kind = dict(stream.dtypes)

    def route(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["document_id", "uploaded_at", "sha256", "original_id"]
        if state.exists:
            for rows in frames:
                yield rows.assign(original_id=pd.array([state.get[0]] * len(rows), "Int64"))[columns]
            return
        # The three columns of a batch's uploads of one new hash are held to find the earliest.
        rows = pd.concat(list(frames)).sort_values(["uploaded_at", "document_id"], kind="stable")
        original = int(rows["document_id"].iloc[0])
        state.update((original,))
        yield rows.assign(original_id=pd.array([pd.NA] + [original] * (len(rows) - 1), "Int64"))[columns]

    schema = f"document_id {kind['document_id']}, uploaded_at {kind['uploaded_at']}, sha256 string, original_id bigint"
    routed = stream.select("document_id", "uploaded_at", "sha256").groupBy("sha256").applyInPandasWithState(route, schema, "original_id bigint", "append", GroupStateTimeout.NoTimeout)
    return batch_sink(routed, path, lambda batch, _: batch)


def current_values(stream: DataFrame, path: str) -> DataStreamWriter:
    """Newest value per (roll, field) in the state store; each batch writes the keys that changed."""
    newest = stream.groupBy("product_id", "field_path").agg(F.max_by(F.struct("observation_id", "normalized_value"), order_key("observed_at", "observation_id")).alias("v"))
    return batch_sink(newest.select("product_id", "field_path", "v.*"), path, lambda batch, _: batch, "update")


def read_current_values(spark: SparkSession, path: str) -> DataFrame:
    return latest_by(written(spark, path), ["product_id", "field_path"], ["batch"]).drop("batch")


def job_states(stream: DataFrame, path: str) -> DataStreamWriter:
    """Last known state of each job."""
    last = stream.groupBy("job_id").agg(F.max_by(F.struct("status", "attempts", "max_attempts", "heartbeat_at"), order_key("heartbeat_at")).alias("s"))
    return batch_sink(last.select("job_id", "s.*"), path, lambda batch, _: batch, "update")


def job_health(states: DataFrame, timeout_seconds: int = 300) -> DataFrame:
    """Running jobs without a heartbeat for the timeout before the newest one: retry, or failed at the last attempt."""
    now = states.agg(F.max("heartbeat_at").alias("now")).scalar()
    silent = F.col("heartbeat_at").isNull() | (F.unix_seconds(F.to_timestamp(now)) - F.unix_seconds(F.to_timestamp("heartbeat_at")) > timeout_seconds)
    return states.filter((F.col("status") == "running") & silent).select(
        "job_id", F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("retry").alias("decision"))


def period_counts(uploads: DataFrame, time: str, period: str) -> DataFrame:
    """Rows per period ending on each day: '1 day', '7 days' or '30 days' windows that slide by a day."""
    window = F.window(time, period, "1 day") if period != "1 day" else F.window(time, "1 day")
    return uploads.groupBy(window.alias("w"), "kind").agg(F.count("*").alias("n")).select(
        F.to_date("w.start").alias("start_date"), F.to_date("w.end").alias("end_date"), "kind", "n")


def period_counts_stream(stream: DataFrame, time: str, period: str, path: str, delay: str = "1 day") -> DataStreamWriter:
    """The same counts over a stream; each batch writes the periods that changed, late rows beyond the delay are dropped."""
    return batch_sink(period_counts(stream.withWatermark(time, delay), time, period), path, lambda batch, _: batch, "update")


def pane_counts_stream(stream: DataFrame, time: str, path: str, delay: str = "1 day") -> DataStreamWriter:
    """Counts per day and kind; the state holds one number per open day whatever periods are read from it."""
    daily = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"), "kind").agg(F.count("*").alias("n"))
    return batch_sink(daily.select(F.to_date("w.start").alias("day"), "kind", "n"), path, lambda batch, _: batch, "update")


def read_panes(spark: SparkSession, path: str) -> DataFrame:
    return latest_by(written(spark, path), ["day", "kind"], ["batch"]).drop("batch")


def sliding_periods(panes: DataFrame, days: int) -> DataFrame:
    """Counts of the ``days`` days up to each day, from daily panes: a pane belongs to the periods that end on its day or after."""
    ends = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    return panes.select("kind", "n", "day", ends.alias("k")).groupBy(F.date_add("day", F.col("k")).alias("end_date"), "kind").agg(F.sum("n").alias("n"))


def classify_stream(stream: DataFrame, catalog: DataFrame, path: str) -> DataStreamWriter:
    """Facts as they arrive, through the batch classification; stateless, so batches may repeat or run apart."""
    from millspark.operators import classification as cl
    return batch_sink(stream, path, lambda batch, _: cl.results(cl.scenario_decisions(batch, catalog)))
