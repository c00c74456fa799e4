"""Reliability of calls as folds over their history: circuit breaker, retries, health, metrics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.base import places_below
from ..functions.vector import backoff_ms

#: Errors that another attempt may mend.
RETRYABLE = ("rate_limited", "timeout", "unavailable")


@dataclass
class Breaker:
    """Closed until failures reach threshold, open for wait seconds after the last, then one probe."""

    threshold: int = 5
    wait: float = 10.0
    state: str = "closed"
    failures: int = 0
    last: float | None = None

    def call(self, at: float, ok: bool) -> bool:
        """Whether a call at that time is let through; its outcome moves the state."""
        if self.state == "open":
            if at - self.last < self.wait:
                return False
            self.state = "half_open"
        probe = self.state == "half_open"
        if ok:
            self.state, self.failures = "closed", 0
            return True
        self.failures, self.last = self.failures + 1, at
        if probe or self.failures >= self.threshold:
            self.state = "open"
        return True


SCHEMA = "key long, event long, ts double, ok boolean, admitted boolean, state string, failures int"


def circuit_breaker(calls: DataFrame, threshold: int = 5, wait: float = 10.0) -> DataFrame:
    """calls (key, event, ts in seconds, ok) with admitted, and the state and failures after each.

    One key's calls are one fold, in time order (ties by event): tasks sort their keys' calls,
    which may spill, and read them batch by batch with the breaker's state carried along, so that
    no history is held as a whole.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, b = object(), None
        for pdf in batches:
            rows = []
            for k, ts, ok in zip(pdf["key"], pdf["ts"], pdf["ok"]):
                if k != key:
                    key, b = k, Breaker(threshold, wait)
                rows.append((b.call(ts, bool(ok)), b.state, b.failures))
            yield pd.concat([pdf, pd.DataFrame(rows, columns=["admitted", "state", "failures"], index=pdf.index)], axis=1)

    rows = calls.select("key", "event", F.col("ts").cast("double").alias("ts"), "ok")
    return rows.repartition("key").sortWithinPartitions("key", "ts", "event").mapInPandas(fold, SCHEMA)


def failure_runs(calls: DataFrame) -> DataFrame:
    """calls with the number of failures in a row so far: what a closed breaker counts; by windows alone."""
    w = Window.partitionBy("key").orderBy("ts", "event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum(F.col("ok").cast("int")).over(w)
    by = Window.partitionBy("key", "run").orderBy("ts", "event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.withColumn("run", run).withColumn("in_a_row", F.count_if(~F.col("ok")).over(by)).drop("run")


def retry_plan(calls: DataFrame, max_attempts: int = 3, initial_ms: int = 100) -> DataFrame:
    """calls (call, attempt, error) with whether another attempt follows, and after how long."""
    again = F.col("error").isin(*RETRYABLE) & (F.col("attempt") < max_attempts)
    return calls.withColumn("retry", F.coalesce(again, F.lit(False))).withColumn("wait_ms", F.when(F.coalesce(again, F.lit(False)), backoff_ms(F.lit(initial_ms), F.col("attempt"))))


def provider_health(verifications: DataFrame) -> DataFrame:
    """(provider, verified, failed, health): the worse of what a provider says (own) and what its aliases show.

    A provider without checks (ok null) keeps its own state; a state that is not known is the worst.
    """
    rank = {"healthy": 0, "degraded": 1, "unhealthy": 2}
    own = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    g = verifications.groupBy("provider").agg(F.count_if(F.col("ok")).alias("verified"), F.count_if(~F.col("ok")).alias("failed"), F.max(F.struct(F.when(F.col("own").isNull(), 0).otherwise(F.coalesce(own[F.col("own")], F.lit(2))).alias("rank"), F.coalesce("own", F.lit("healthy")).alias("state"))).alias("own"))
    seen = F.when(F.col("failed") == 0, 0).when(F.col("verified") == 0, 2).otherwise(1)
    health = F.when(F.col("own.rank") >= seen, F.col("own.state")).when(seen == 2, "unhealthy").otherwise("degraded")
    return g.select("provider", "verified", "failed", health.alias("health"))


#: Ranges of ms that percentiles are counted in.
RANGES = 128
#: Percentiles, in hundredths.
PERCENTILES = (50, 95)


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, in which nulls are equal too; the keys are left's."""
    right = right.select(*(F.col(c).alias(f"right_{c}" if c in keys else c) for c in right.columns))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys])
    return left.join(right, same, how).drop(*(f"right_{k}" for k in keys))


def call_metrics(calls: DataFrame) -> DataFrame:
    """(alias, task, provider, status, calls, total_ms, mean_ms, p50, p95).

    A percentile is exact: the smallest ms that so many hundredths of the group's are not above;
    nulls do not count, and a group of nulls has none. Ranks are counted over different ms, first
    by ranges of all calls' ms, then in the ranges that hold the percentiles, so that no task gets
    a large group as a whole. The ranges' bounds are approximate, which changes the work only.
    """
    keys = ["alias", "task", "provider", "status"]
    totals = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"))
    bounds = calls.agg(F.percentile_approx("ms", [i / RANGES for i in range(1, RANGES)]).alias("bounds"))
    counts = calls.where("ms is not null").groupBy(*keys, "ms").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.crossJoin(F.broadcast(bounds)).select(*keys, "ms", "n", places_below(F.col("bounds"), F.array("ms"))[0].alias("range"))

    ranges = counts.groupBy(*keys, "range").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys)
    before = F.sum("n").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ranges = ranges.select(*keys, "range", "n", before.alias("before"), F.sum("n").over(group).alias("all"))
    ranges = ranges.select("*", F.explode(F.array(*map(F.lit, PERCENTILES))).alias("p"))
    # the rank is that of whole hundredths: a share as a double may fall beside it
    ranges = ranges.withColumn("rank", F.expr("(all * p + 99) div 100") - F.col("before")).where("rank between 1 and n")

    held = _join(counts, ranges.select(*keys, "range", "p", "rank"), [*keys, "range"], "inner")
    upto = F.sum("n").over(Window.partitionBy(*keys, "p").orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = held.withColumn("upto", upto).where("rank > upto - n and rank <= upto")
    found = found.groupBy(*keys).agg(*(F.max(F.when(F.col("p") == p, F.col("ms"))).alias(f"p{p}") for p in PERCENTILES))
    return _join(totals, found, keys, "left")


def load_states(events: DataFrame) -> DataFrame:
    """(alias, state): the latest load event of each alias; failed, loading and loaded as they come."""
    return events.groupBy("alias").agg(F.max_by("state", F.struct("ts", "event")).alias("state"))


def usage_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("alias").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum(F.coalesce("total", F.col("prompt") + F.col("completion"))).alias("total"))
