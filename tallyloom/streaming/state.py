"""Stateful stream operators: escalation of what stays open, and a run log with retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def escalations(events: DataFrame, raised: str, answer: str, hours: int, late: str) -> DataFrame:
    """(event_id, user_id) of raised events that no answer of the same user followed in time.

    State per user: the events still open.  One is escalated when a later event of
    the user, or the watermark, shows that its time is up.
    """
    limit = hours * 3_600_000

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (user,) = key
        ids, at = (list(x) for x in state.get) if state.exists else ([], [])
        due: list[int] = []

        def pass_to(now: int) -> None:
            late_ones = [i for i, a in zip(ids, at) if a + limit <= now]
            kept = [(i, a) for i, a in zip(ids, at) if a + limit > now]
            due.extend(late_ones)
            ids[:], at[:] = [i for i, _ in kept], [a for _, a in kept]

        if state.hasTimedOut:
            pass_to(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(frames)).sort_values(["ms", "event_id"])
            for event_id, kind, ms in zip(rows["event_id"], rows["event_type"], rows["ms"]):
                pass_to(int(ms))
                if kind == answer:
                    ids, at = [], []
                elif kind == raised:
                    ids.append(int(event_id))
                    at.append(int(ms))
            pass_to(state.getCurrentWatermarkMs())
        if ids:
            state.update((ids, at))
            state.setTimeoutTimestamp(max(min(at) + limit, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if due:
            yield pd.DataFrame({"event_id": due, "user_id": [user] * len(due)})

    used = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return used.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long", "ids array<long>, at array<long>", "append", GroupStateTimeout.EventTimeTimeout)


#: Groups that keys share; a call of the stateful step serves one of them, not one key.
KEY_GROUPS = 2048


def first_of_repeats(events: DataFrame, keys: list[str], hours: int, late: str) -> DataFrame:
    """(keys, event_id, repeats): events that none of the same keys came before within the time, and how many after them did.

    A run's first event opens it; what follows within ``hours`` of it repeats it.  State per group of keys: their open runs.
    A run goes out, and leaves the state, when a later event or the watermark shows that its time is up.  Events of one
    batch are taken in the order of their times; what comes later than the watermark is dropped.
    """
    limit = hours * 3_600_000
    # Keys travel as one text, so nulls and large whole numbers stay what they are.
    types = T.StructType([events.schema[k] for k in keys])
    kept = "key array<string>, event_id array<long>, ms array<long>, repeats array<long>"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: run for k, *run in zip(*state.get)} if state.exists else {}
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["ms", "event_id"])
            for k, event_id, ms in zip(rows["key"].tolist(), rows["event_id"].tolist(), rows["ms"].tolist()):
                run = held.get(k)
                if run and run[1] + limit < ms:
                    out.append((k, run[0], run[2]))
                    run = None
                if run:
                    run[2] += 1
                else:
                    held[k] = [event_id, ms, 0]
        now = state.getCurrentWatermarkMs()
        for k in [k for k, run in held.items() if run[1] + limit < now]:
            run = held.pop(k)
            out.append((k, run[0], run[2]))
        if held:
            state.update(tuple(map(list, zip(*((k, *run) for k, run in held.items())))))
            state.setTimeoutTimestamp(max(min(run[1] for run in held.values()) + limit + 1, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "event_id", "repeats"])

    group = F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS))
    used = events.withWatermark("ts", late).select(group.alias("group"), F.to_json(F.struct(*keys)).alias("key"), "event_id", "ts", F.unix_millis("ts").alias("ms"))
    found = used.groupBy("group").applyInPandasWithState(step, "key string, event_id long, repeats long", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.from_json("key", types).alias("key"), "event_id", "repeats").select("key.*", "event_id", "repeats")


#: Parts that a log's keys are dealt to; a batch rewrites those that it has keys of.
LOG_PARTS = 64


def logged_with_retention(stream: DataFrame, key: str, order: list[str], keep: int, target: str) -> DataFrame:
    """Appends each micro-batch to the log in folder ``target`` and keeps the last ``keep`` rows a key; the log that is left.

    A batch writes new versions of the parts that it has keys of and a list of all parts' versions.  It reads the list of
    the batch before it, so a batch that is run again replaces its own versions only, and a query that is started
    again on the same folder goes on.  A stream without rows gives an empty table.
    """
    spark, path = stream.sparkSession, target.rstrip("/")

    def versions(number: int) -> dict[int, int]:
        return {r["part"]: r["version"] for r in spark.read.schema("part int, version long").parquet(f"{path}/versions/{number}").collect()}

    def log_of(known: dict[int, int], schema) -> DataFrame:
        places = [f"{path}/v{v}/__part={p}" for p, v in sorted(known.items())]
        return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)

    def write(batch: DataFrame, number: int) -> None:
        known = versions(number - 1) if number else {}
        part = F.pmod(F.xxhash64(key), F.lit(LOG_PARTS)).cast("int")
        touched = [r[0] for r in batch.select(part).distinct().collect()]
        rows = log_of({p: v for p, v in known.items() if p in touched}, batch.schema).unionByName(batch)
        last = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))
        rows.withColumn("__n", last).where(F.col("__n") <= keep).drop("__n").withColumn("__part", part).write.mode("overwrite").partitionBy("__part").parquet(f"{path}/v{number}")
        now = known | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{number}")
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/last")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        number = spark.read.schema("number long").parquet(f"{path}/last").first()["number"]
    except AnalysisException:  # no batch has been written yet
        return spark.createDataFrame([], stream.schema)
    return log_of(versions(number), stream.schema)
