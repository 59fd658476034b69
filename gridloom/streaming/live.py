"""Structured Streaming forms of the windowed operators.

Event times are cast to TIMESTAMP, which watermarks need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamped(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame) -> DataFrame:
    """12-hour periods from 08 and 20 of UTC+8, which are 00 and 12 UTC."""
    w = F.window("ts", "12 hours")
    return stamped(events).groupBy(w.alias("w"), "event_type").agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "high", "low", "n")


def sliding(events: DataFrame) -> DataFrame:
    w = F.window("ts", "24 hours", "3 hours")
    return stamped(events).groupBy(w.alias("w"), "event_type").agg(F.max("value").alias("high"), F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "high", "n")


def sessions(events: DataFrame, gap: str = "3 hours") -> DataFrame:
    """Spells of a user's events with no gap of that length."""
    w = F.session_window("ts", gap)
    return stamped(events).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("high")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n", "high")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return stamped(events).dropDuplicatesWithinWatermark(keys)


def decayed_bias(errors: DataFrame, alpha: float):
    """Stateful decaying average of (key, ts, e), its rows in order of time within a batch: emits key, times and bias after each micro-batch.

    A batch of n errors moves the state in one step: their weights are powers of 1 - alpha, so nothing is looped over.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, frames, state):
        n, bias = state.get if state.exists else (0, 0.0)
        e = pd.concat(list(frames)).sort_values(["ts", "e"])["e"].to_numpy(dtype=float)
        e = e[~np.isnan(e)]
        if len(e):
            if not n:
                bias = float(e[0])  # the first error begins the average
            kept = (1 - alpha) ** np.arange(len(e) - 1, -1, -1)
            bias = float(bias * (1 - alpha) ** len(e) + alpha * (kept * e).sum()) if n else float(bias * (1 - alpha) ** (len(e) - 1) + alpha * (kept[1:] * e[1:]).sum())
            n += len(e)
        state.update((n, bias))
        yield pd.DataFrame({"key": [key[0]], "times": [n], "bias": [bias]})

    return errors.groupBy("key").applyInPandasWithState(update, "key string, times long, bias double", "n long, bias double", "update", GroupStateTimeout.NoTimeout)


#: The state store that processors with timers need; a session names it before such a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def corrected_bias(errors: DataFrame, alpha: float, keep_days: int = 10, idle_days: int = 30, delay: str = "0 seconds") -> DataFrame:
    """Decaying average of a key's daily errors (key, ts, e), one of each day, where a later row corrects its day.

    The last ``keep_days`` days of a key stay open: a correction or a late day among them changes the average as if it had
    come in order.  Days before them are folded into one number and can no longer change.  A key without rows for
    ``idle_days`` of event time is closed: it is told once more with ``closed`` and forgotten.  Emits key, days, bias and
    closed for the keys that a batch touches.  The session's state store must be ``STATE_STORE``.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    day_ms = 86_400_000
    out = "key string, days long, bias double, closed boolean"

    class Average(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.open = handle.getMapState("open", "day long", "e double")
            self.folded = handle.getValueState("folded", "days long, bias double, last long")

        def _state(self):
            days, bias, last = self.folded.get() if self.folded.exists() else (0, None, None)
            return days, bias, last, sorted((k[0], v[0]) for k, v in self.open.iterator())

        @staticmethod
        def _on(bias, e):
            return e if bias is None else (1 - alpha) * bias + alpha * e

        def _row(self, key, days, bias, listed, closed):
            for _, e in listed:
                bias = self._on(bias, e)
            return pd.DataFrame({"key": [key[0]], "days": [days + len(listed)], "bias": [bias], "closed": [closed]})

        def handleInputRows(self, key, rows, timerValues):
            days, bias, last, _ = self._state()
            frame = pd.concat(list(rows)).dropna(subset=["ts", "e"])
            newest = int(frame["ts"].max().timestamp() * 1000) if len(frame) else None
            for ts, e in zip(frame["ts"], frame["e"]):
                day = int(ts.timestamp() * 1000) // day_ms
                if last is None or day > last:
                    self.open.updateValue((day,), (float(e),))
            listed = self._state()[3]
            for day, e in listed[: max(0, len(listed) - keep_days)]:
                days, bias, last = days + 1, self._on(bias, e), day
                self.open.removeKey((day,))
            if last is not None:
                self.folded.update((days, bias, last))
            for timer in self.handle.listTimers():
                newest = None if newest is None else max(newest, timer - idle_days * day_ms)
            if newest is not None:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(newest + idle_days * day_ms)
            yield self._row(key, days, bias, listed[max(0, len(listed) - keep_days) :], False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            days, bias, _, listed = self._state()
            self.open.clear()
            self.folded.clear()
            yield self._row(key, days, bias, listed, True)

        def close(self):
            pass

    timed = errors.select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("e").cast("double").alias("e")).withWatermark("ts", delay)
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=Average(), outputStructType=out, outputMode="Update", timeMode="EventTime")


def upsert_stream(events: DataFrame, path: str, keys: list[str], seq: str, checkpoint: str, buckets: int = 64):
    """Keeps the last report of each key in a store of buckets by key; a batch writes a new version of the buckets that it touches, and of no others.

    Late reports replace earlier ones, which deduplication by watermark, keeping the first, cannot do.  A batch that is run
    again starts from the versions before it and writes the same.  ``upserted`` reads the store; give the stream to
    ``awaitTermination``.
    """
    from gridloom.sources import stores

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        old = upserted(spark, path, batch.schema, number - 1, touched)
        both = stores.upsert(old, new, [*keys, "bucket"], seq).select(*batch.columns, "bucket", F.lit(number).cast("long").alias("version"))
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        spark.range(1).select(F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{path}/_done/{number:010d}")

    return events.writeStream.foreachBatch(merge).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark, path: str, schema, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """A store's rows with their ``bucket``: of each bucket the newest version of a batch that was done (or done up to a number)."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import types as T

    shape = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*shape.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])
    none = spark.createDataFrame([], whole).drop("version")
    try:
        done = spark.read.schema("batch long").option("recursiveFileLookup", True).parquet(f"{path}/_done").agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    last = done if upto is None or done is None else min(done, upto)
    if last is None or last < 0:
        return none
    rows = spark.read.schema(whole).parquet(path).where(F.col("version") <= last)
    rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version")).collect()  # from the folders' names: a row for each bucket
    named = [f"{r.bucket}/{r.version}" for r in newest]
    return rows.where(F.concat_ws("/", "bucket", "version").isin(named)).drop("version") if named else none


def drain(spark, df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream to the end of what is there and gives its result table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
