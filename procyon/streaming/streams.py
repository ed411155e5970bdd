"""Streaming operators: ingest, change feed, quotas, deduplication, roll-ups, source health, versions, stale alerts.

Operators take and return streaming (or batch, where stateless) DataFrames; `run_available` runs one to the end of the
data that is there and reads its result back from the shared folder.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.state import KeyedTable, scratch, shared_folder, write_tables

#: Of keys whose rows are put in order: calls into the state are by bucket and slot, however many keys there are.
BUCKETS, SLOTS, PACKED = 1024, 4, 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; ts as a timestamp (UTC session)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """What a stream yields for the data that is there. keys: in update mode, the latest row of each.

    In append mode windows that the watermark has not passed are missing; in complete mode each batch replaces the last.
    folder: where state and results of earlier runs are, so that this run goes on from them.
    """
    spark, folder = stream.sparkSession, folder or own_folder(stream.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/b{batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("__batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("__batch").alias("__batch"))), "__batch", "left_semi")
    if keys:
        out = out.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("__batch").desc()))).where("__n = 1").drop("__n")
    return out.drop("__batch")


def run_in_turns(turns: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """What build(stream) yields when the rows of `turns` arrive one frame after another.

    After each the stream stops, and goes on from its checkpoint with the next: a restart between any two.
    """
    spark, folder = turns[0].sparkSession, own_folder(turns[0].sparkSession)
    out = None
    for turn in turns:
        turn.write.mode("append").parquet(f"{folder}/in")
        out = run_available(build(spark.readStream.schema(turn.schema).parquet(f"{folder}/in")), mode, keys, folder)
    return out


def stream_change_feed(events: DataFrame, event_type: str | None = None, after: str | None = None) -> DataFrame:
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    return events if after is None else events.where(F.col("ts") > F.lit(after).cast("timestamp"))


def quota_windows(requests: DataFrame, limit: dict[str, int], burst: int = 0, late: str = "1 minute") -> DataFrame:
    """(client, tier, start, hits, allowed, remaining) of each client's fixed 60-second windows. requests (client, tier, ts)."""
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limit.items() for x in kv]), F.col("tier")), F.lit(0)) + burst
    out = requests.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds"), "client", "tier").agg(F.count("*").alias("hits"))
    return out.select("client", "tier", F.col("window.start").alias("start"), "hits", (F.col("hits") <= most).alias("allowed"), F.greatest(most - F.col("hits"), F.lit(0)).alias("remaining"))


def stream_exact_dedup(items: DataFrame, keys: list[str], horizon: str, at: str = "ts") -> DataFrame:
    """Drops items of equal keys seen again within the horizon; state older than it is let go."""
    return items.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def sliding_counts(events: DataFrame, window: str, slide: str, late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"))
    return out.select("event_type", F.col("window.start").alias("start"), "n")


class _LateCounts(StatefulProcessor):
    """Rows of one window in time, and behind the watermark. What Spark takes for its watermark is `back` behind it."""

    def __init__(self, length_ms: int, back_ms: int):
        self.length, self.back = length_ms, back_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counts", "n bigint, late bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.exists()
        n, late = self.state.get() if known else (0, 0)
        end = key[1] + self.length
        told = timerValues.getCurrentWatermarkInMs()
        more = sum(len(frame) for frame in rows)
        if told > 0 and end <= told + self.back:
            late += more
        else:
            n += more
        self.state.update((n, late))
        if not known:
            self.handle.registerTimer(end)
        yield pd.DataFrame({"event_type": [key[0]], "start_ms": [key[1]], "n": [n], "late": [late]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def sliding_counts_with_late(events: DataFrame, window: str, slide: str, late: str = "10 minutes", horizon: str = "30 days") -> DataFrame:
    """(event_type, start, n, late): sliding_counts, and how many rows came when the window's end was behind the watermark.

    The watermark is that of sliding_counts: `late` behind the newest time of the batches before. Spark would drop those
    rows unseen, so it is given one that is `horizon` further back; rows later still are dropped and not counted, and a
    window's counts are forgotten then. In update mode, a row for each change of a window.
    """
    length, back = (int(pd.Timedelta(x) / pd.Timedelta("1ms")) for x in (window, horizon))
    allowed = f"{int(pd.Timedelta(late) / pd.Timedelta('1ms')) + back} milliseconds"
    rows = events.withWatermark("ts", allowed).withColumn("first", F.window("ts", slide)["start"])
    step = int(pd.Timedelta(slide) / pd.Timedelta("1ms"))
    rows = rows.select("event_type", "ts", F.explode(F.sequence(F.unix_millis("first") - F.lit(length - step), F.unix_millis("first"), F.lit(step))).alias("start_ms"))
    out = _with_state(rows, ["event_type", "start_ms"], _LateCounts(length, back), "event_type string, start_ms bigint, n bigint, late bigint", "Update", "EventTime")
    return out.select("event_type", F.timestamp_millis("start_ms").alias("start"), "n", "late")


def edit_sessions(events: DataFrame, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): sessions of events of one key no further apart than gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _with_state(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str, time: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time)


class _Ordered(StatefulProcessor):
    """A reorder buffer: a key's rows wait until the watermark has passed their time, and are stepped through in order.

    Keys are dealt to BUCKETS by their hash, as a call into the state takes longer than the work on a row. A bucket's
    rows wait in list state, packed by batch, and one timer for each bucket stands at the earliest of them. When it
    fires, every row behind the watermark is released by (key, ms, order), as no earlier one can come any more, and the
    timer moves on. What is kept of keys is packed by slots of a bucket, and only slots that have rows are read and
    written. What a worker holds is what waits of a bucket within the watermark's delay, and what is kept of a slot.
    """

    def __init__(self, key: str, columns: list[str], out: list[str]):
        self.columns, self.out = ["slot", key, "ms", *columns], out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.timer = handle.getValueState("timer", "ms bigint")
        self.kept = handle.getMapState("kept", "slot int", "states binary")

    def _pack(self, rows: list[tuple]) -> list[tuple]:
        return [(pickle.dumps(rows[a : a + PACKED]),) for a in range(0, len(rows), PACKED)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            held = frame[self.columns].astype(object).where(frame[self.columns].notna(), None)
            self.waiting.appendList(self._pack(list(held.itertuples(index=False, name=None))))
            first = int(frame["ms"].min()) if first is None else min(first, int(frame["ms"].min()))
        if first is not None:
            self._set(first)
        return iter(())

    def _set(self, ms: int) -> None:
        if self.timer.exists():
            if self.timer.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((ms,))
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [r for packed in self.waiting.get() for r in pickle.loads(packed[0])]  # noqa: S301
        rest = [r for r in rows if r[2] > passed]
        self.timer.clear()
        if rest:
            self.waiting.put(self._pack(rest))
            self._set(min(r[2] for r in rest))
        else:
            self.waiting.clear()
        found = []
        for slot, own in groupby(sorted((r for r in rows if r[2] <= passed), key=lambda r: r[:4]), lambda r: r[0]):
            kept = self.kept.getValue((slot,))
            states = pickle.loads(kept[0]) if kept else {}  # noqa: S301
            for one, its in groupby(own, lambda r: r[1]):
                out, state = [], states.setdefault(one, self.empty())
                for r in its:
                    self.step(one, state, r[3:], out)
                found += self.told(out)
            self.kept.updateValue((slot,), (pickle.dumps(states),))
        if found:
            yield pd.DataFrame(found, columns=self.out)

    def empty(self) -> list:
        """What is kept of a key before its first row."""
        raise NotImplementedError

    def step(self, key: Any, state: list, row: tuple, out: list[tuple]) -> None:
        """Takes the next row of a key, the values of `columns`, into its state; adds what it yields to out."""
        raise NotImplementedError

    def told(self, out: list[tuple]) -> list[tuple]:
        """What is told of all that one release yields for a key."""
        return out

    def close(self) -> None:
        pass


def _in_buckets(rows: DataFrame, key: str, processor: _Ordered, schema: str, mode: str) -> DataFrame:
    h = F.xxhash64(key)
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(h, F.lit(BUCKETS)))  # with null keys in it, pandas would make the others floats
    rows = rows.withColumns({"bucket": bucket.cast("int"), "slot": F.pmod(F.shiftright(h, 32), F.lit(SLOTS)).cast("int")})
    return _with_state(rows, ["bucket"], processor, schema, mode, "EventTime")


class _Health(_Ordered):
    """Consecutive failures and smoothed duration of a source."""

    def empty(self) -> list:
        return [0, None, 0]

    def step(self, key: Any, state: list, row: tuple, out: list[tuple]) -> None:
        failures, average, runs = state
        _, status, ms = row
        failures = failures + 1 if status == "FAILED" else 0
        if ms is not None:
            average = float(ms) if average is None else round(average * 0.7 + float(ms) * 0.3, 2)
        state[:] = failures, average, runs + 1
        health = "OFFLINE" if failures >= 10 else "FAILING" if failures >= 4 else "DEGRADED" if failures >= 1 else "HEALTHY"
        out.append((key, runs + 1, failures, health, average))

    def told(self, out: list[tuple]) -> list[tuple]:
        return out[-1:]


def stream_source_health(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """runs (source_id, id, started_at, status, duration_ms) as they arrive -> a source's health, in update mode.

    Runs count in the order of started_at, then id, once the watermark (`late` behind the newest) has passed them; runs
    that come later than that are dropped.
    """
    rows = runs.withWatermark("started_at", late).select("source_id", "id", "started_at", "status", "duration_ms", F.unix_millis("started_at").alias("ms"))
    health = _Health("source_id", ["id", "status", "duration_ms"], ["source_id", "runs", "consecutive_failures", "health", "average_ms"])
    return _in_buckets(rows, "source_id", health, "source_id bigint, runs bigint, consecutive_failures bigint, health string, average_ms double", "Update")


class _Versions(_Ordered):
    """The values in force of an opportunity, and the documents that it had."""

    def __init__(self, fields: list[str], document: str):
        super().__init__("opportunity_id", ["seq", *fields, document], ["opportunity_id", "seq", "version", *fields, "document_added", "changed"])
        self.fields = fields

    def empty(self) -> list:
        return [0, [None] * len(self.fields), set()]

    def step(self, key: Any, state: list, row: tuple, out: list[tuple]) -> None:
        version, now, seen = state
        seq, *values, url = row
        changed = [f for f, old, new in zip(self.fields, now, values, strict=True) if new is not None and new != old]
        now = [old if new is None else new for old, new in zip(now, values, strict=True)]
        fresh = url is not None and url not in seen
        if fresh:
            seen.add(url)
        if version == 0 or changed or fresh:
            version += 1
            out.append((key, seq, version, *now, fresh, ",".join(sorted(changed)) if version > 1 else ""))
        state[:2] = version, now


def stream_versions(observations: DataFrame, fields: list[str], document: str = "document_url", late: str = "1 hour") -> DataFrame:
    """observations (opportunity_id, at, seq, fields, document) -> a row for each new version, fields as text.

    Observations count in the order of (at, seq), in whatever order and batch they come: each waits until the watermark
    (`late` behind the newest `at`) has passed it. Those that come later than that are dropped.
    """
    text = observations.withWatermark("at", late).select("opportunity_id", "at", F.unix_millis("at").alias("ms"), "seq", *[F.col(f).cast("string").alias(f) for f in [*fields, document]])
    schema = f"opportunity_id bigint, seq bigint, version bigint, {', '.join(f'`{f}` string' for f in fields)}, document_added boolean, changed string"
    return _in_buckets(text, "opportunity_id", _Versions(fields, document), schema, "Append")


class _Stale(StatefulProcessor):
    """A timer for each source, set anew by each success."""

    def __init__(self, horizon_s: int):
        self.horizon = horizon_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        good = [frame.loc[frame["status"] != "FAILED", "started_at"].max() for frame in rows]
        good = [x for x in good if not pd.isna(x)]
        if good:
            ms = pd.Timestamp(max(good)).value // 1_000_000
            if not self.last.exists() or ms > self.last.get()[0]:
                if self.last.exists():
                    self.handle.deleteTimer(self.last.get()[0] + self.horizon)
                self.last.update((ms,))
                self.handle.registerTimer(ms + self.horizon)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield pd.DataFrame({"source_id": [key[0]], "last_success_ms": [self.last.get()[0]]})

    def close(self) -> None:
        pass


def stream_stale_alerts(runs: DataFrame, horizon_s: int = 96 * 3600, late: str = "1 hour") -> DataFrame:
    """(source_id, last_success_ms) when event time passes a source's last success by the horizon."""
    return _with_state(runs.withWatermark("started_at", late), ["source_id"], _Stale(horizon_s), "source_id bigint, last_success_ms bigint", "Append", "EventTime")


def stream_ingest(items: DataFrame, path: str, process: Callable[[DataFrame, DataFrame | None], dict[str, DataFrame]], checkpoint: str, buckets: int = 64) -> Any:
    """Runs process(batch, current) for each micro-batch and writes its tables; a replayed batch writes them again.

    process gives the rows of `opportunities` that are new or changed, and histories. current is what the batches
    before have left in `opportunities` (a KeyedTable under path), or None. Histories get a partition for each batch;
    the keyed table's manifest is written last and commits the batch. What process saved on its way is deleted then.
    """
    spark = items.sparkSession
    table = KeyedTable(spark, f"{path}/opportunities", buckets=buckets)

    def one(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            found = process(batch, table.read(batch_id - 1))
            write_tables({k: df for k, df in found.items() if k != "opportunities"}, path, str(batch_id), rewritten=())
            table.write(found["opportunities"], batch_id)

    return items.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()
