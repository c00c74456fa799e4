"""The circuit breaker over a stream of calls.

State is a small table, one row a key, written anew with every micro-batch under the batch's
number: a batch that is run again reads the same former state and overwrites its own output, so
each call is folded once. Keys that were silent for longer than a time to live are dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.reliability import SCHEMA, Breaker

STATE = "key long, state string, failures int, last double, seen double"
_ROW = SCHEMA + ", last double, is_state boolean"


def fold_batch(calls: DataFrame, state: DataFrame, threshold: int = 5, wait: float = 10.0) -> DataFrame:
    """Calls of a batch with their outcome, and one row of new state for each of their keys."""

    def fold(rows: pd.DataFrame, was: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=["key", "event", "ts", "ok", "admitted", "state", "failures", "last", "is_state"]).astype({"failures": "int32"})
        b = Breaker(threshold, wait)
        if len(was):
            last = was["last"].iat[0]
            b = Breaker(threshold, wait, was["state"].iat[0], int(was["failures"].iat[0]), None if pd.isna(last) else float(last))
        rows = rows.sort_values(["ts", "event"], kind="stable").reset_index(drop=True)
        done = [(b.call(ts, bool(ok)), b.state, b.failures) for ts, ok in zip(rows["ts"], rows["ok"])]
        out = rows[["key", "event", "ts", "ok"]].join(pd.DataFrame(done, columns=["admitted", "state", "failures"]))
        out["last"], out["is_state"] = b.last, False
        end = out.tail(1).assign(is_state=True, ts=rows["ts"].max())
        return pd.concat([out, end], ignore_index=True)

    rows = calls.select("key", "event", F.col("ts").cast("double").alias("ts"), "ok")
    return rows.groupBy("key").cogroup(state.groupBy("key")).applyInPandas(fold, _ROW)


def _state(spark: SparkSession, path: str, batch: int) -> DataFrame:
    return spark.read.schema(STATE).parquet(f"{path}/state/{batch}") if batch >= 0 else spark.createDataFrame([], STATE)


def process_batch(calls: DataFrame, batch: int, path: str, threshold: int = 5, wait: float = 10.0, ttl: float = 1800.0) -> None:
    """Folds micro-batch number batch: writes path/calls/<batch> and path/state/<batch>."""
    spark = calls.sparkSession
    before = _state(spark, path, batch - 1)
    fold_batch(calls, before, threshold, wait).write.mode("overwrite").parquet(f"{path}/fold/{batch}")
    both = spark.read.schema(_ROW).parquet(f"{path}/fold/{batch}")
    both.where("not is_state").drop("last", "is_state").write.mode("overwrite").parquet(f"{path}/calls/{batch}")
    new = both.where("is_state").select("key", "state", "failures", "last", F.col("ts").alias("seen"))
    every = new.unionByName(before.join(new.select("key"), "key", "left_anti"))
    newest = F.broadcast(every.agg(F.max("seen").alias("newest")))  # one row
    every.join(newest).where(F.col("seen") >= F.col("newest") - ttl).drop("newest").write.mode("overwrite").parquet(f"{path}/state/{batch}")


def start_breaker(calls: DataFrame, path: str, threshold: int = 5, wait: float = 10.0, ttl: float = 1800.0, **trigger) -> StreamingQuery:
    """Runs circuit_breaker() over a stream of calls (key, event, ts in seconds, ok) into the tables under path."""
    writer = calls.writeStream.foreachBatch(lambda df, batch: process_batch(df, batch, path, threshold, wait, ttl))
    return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def windowed_metrics(calls: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, ok, calls) of a stream with an event time column time; later rows than late are dropped."""
    return calls.withWatermark("time", late).groupBy(F.window("time", window), "ok").agg(F.count(F.lit(1)).alias("calls"))
