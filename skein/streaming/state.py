"""STR-1, 2, 3, 5: operators with state for each key, on streams.

Rows of a key are taken in the order of time and id within a micro-batch, and micro-batches
as they come. Keys are dealt to BUCKETS, whose keys are served by one call, as a call costs
far more than a key's few rows. A task holds one bucket's rows of one micro-batch, which the
source's trigger limits bound, and state is a few numbers a key. It is kept for good unless ``idle``
is set: then that of a key without rows for so many seconds of the clock is dropped. Don't set it
with an availableNow trigger, as Spark would wait for the timeouts in batches without end.
A missing time counts as the earliest; a missing key is a key of its own unless
an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


#: Fixed for a checkpoint, whose state lies by bucket.
BUCKETS = 4096


def _micros(c: Column) -> Column:
    return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(0))


def _packed(c: Column, kind: str) -> Column:
    """A key as text from which _unpacked makes the same value, so that nulls and large numbers stay what they are in pandas."""
    return F.base64(c) if kind == "binary" else (F.unix_micros(c) if kind == "timestamp" else c).cast("string")


def _unpacked(c: Column, kind: str) -> Column:
    return F.unbase64(c) if kind == "binary" else F.timestamp_micros(c.cast("long")) if kind == "timestamp" else c.cast(kind)


def _keyed(rows: DataFrame, keys: list[str], out: str, state_type: str, step: Callable, idle: int | None) -> DataFrame:
    """Rows (keys, id, t, ...) through step(a key's rows in order, its state or None) -> (columns,
    new state); rows and columns are arrays by name."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    coded, made = [f"_key{n}" for n in range(len(keys))], [c.split()[0] for c in out.split(", ")]
    whole = types["id"] in ("tinyint", "smallint", "int", "bigint")  # a null would make doubles of all ids
    names = [*coded, "id", "_none", "t", *made]

    def run(key, frames, state):
        held, now = {}, state.getCurrentProcessingTimeMs() if idle else 0
        if state.exists:
            was = state.get
            held = dict(zip(zip(*was[: len(keys)]), zip(*was[len(keys) :])))
        part = None
        if not state.hasTimedOut:
            part = pd.concat(list(frames), ignore_index=True)
            part["_group"] = part.groupby(coded, dropna=False, sort=False).ngroup()
            part = part.sort_values(["_group", "t", "_none", "id"], kind="stable", ignore_index=True)
            ends = np.append(np.flatnonzero(np.diff(part["_group"].to_numpy())) + 1, len(part)).tolist()
            own = list(zip(*(part[c].astype(object).where(part[c].notna(), None) for c in coded)))
            data = {c: part[c].to_numpy() for c in part.columns if c not in (*coded, "_group", "_none", "id")}
            columns = {c: [] for c in made}
            for a, b in zip([0, *ends], ends):
                before = held.get(own[a])
                found, after = step({c: x[a:b] for c, x in data.items()}, before[1:] if before else None)
                held[own[a]] = (now, *after)
                for c in made:
                    columns[c].extend(found[c])
        if idle:
            held = {k: v for k, v in held.items() if now - v[0] < idle * 1000}
        if held:
            state.update(tuple(list(c) for c in (*zip(*held), *zip(*held.values()))))
            if idle:
                state.setTimeoutDuration(max(1, min(v[0] for v in held.values()) + idle * 1000 - now))
        else:
            state.remove()
        if part is not None:
            yield part.assign(**columns)[names]

    dealt = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    kept = [F.coalesce("id", F.lit(0).cast(types["id"])).alias("id") if whole else F.col("id"), (F.col("id").isNull() if whole else F.lit(False)).alias("_none")]
    packed = rows.select(dealt, *(_packed(F.col(k), types[k]).alias(c) for k, c in zip(keys, coded)), *kept, *(c for c in types if c not in (*keys, "id")))
    schema = ", ".join([*(f"{c} string" for c in coded), f"id {types['id']}", "_none boolean", "t long", out])
    states = ", ".join(f"{c} array<{k}>" for c, k in [*((c, "string") for c in coded), ("seen", "long"), *(c.split() for c in state_type.split(", "))])
    gone = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    done = packed.groupBy("_bucket").applyInPandasWithState(run, schema, states, "append", gone)
    return done.select(*(_unpacked(F.col(c), types[k]).alias(k) for k, c in zip(keys, coded)), F.when(~F.col("_none"), F.col("id")).alias("id"), "t", *made)


def rate_limit(stream: DataFrame, keys: list[str], id_: str, time: str, most: int, seconds: int, idle: int | None = None) -> DataFrame:
    """STR-3: (keys, id, t, start, place, allowed): a key's window starts with its first row
    after the window before has ended and lets ``most`` rows through; 0 lets all through.
    Times are microseconds. A row that comes late counts in the open window."""
    width = seconds * 1_000_000

    def step(part, state):
        t = np.maximum.accumulate(part["t"])
        start, used = state or (None, 0)
        starts, places, at = np.empty(len(t), "int64"), np.empty(len(t), "int64"), 0
        while at < len(t):  # one turn a window, not a row
            if start is None or t[at] >= start + width:
                start, used = int(t[at]), 0
            end = int(np.searchsorted(t, start + width, "left"))
            starts[at:end], places[at:end] = start, used + 1 + np.arange(end - at)
            used, at = used + end - at, end
        return {"start": starts, "place": places, "allowed": (places <= most) | (most == 0)}, (start, used)

    rows = stream.select(*keys, F.col(id_).alias("id"), _micros(F.col(time)).alias("t"))
    return _keyed(rows, keys, "start long, place long, allowed boolean", "start long, used long", step, idle)


def deliveries(stream: DataFrame, provider: str, hook: str, id_: str, time: str, outcome: str, ended: str, patience: int = 15 * 60, idle: int | None = None) -> DataFrame:
    """STR-1, 2: (provider, hook, id, t, processed, status, ended) of each delivery.

    The first delivery of (provider, hook) is processed; a repeat is ignored unless the one
    processed before has failed by then, or is still at work for more than ``patience``
    seconds. A delivery without a hook is always processed. Status: completed or failed as
    ``outcome`` says, with the time of its end, processing if that is missing, ignored."""
    wait = patience * 1_000_000
    far = np.iinfo("int64").max

    def step(part, state):
        begun, end, failed = state or (None, far, False)
        taken = []
        for t, e, o in zip(part["t"].tolist(), part["ended"].tolist(), part["outcome"]):
            take = begun is None or (failed if t >= end else t - begun > wait)
            if take:
                begun, end, failed = int(t), int(e), o == "failed"
            taken.append(take)
        return {"processed": taken, "outcome": part["outcome"], "ended": part["ended"]}, (begun, end, failed)

    o = F.when(F.col(outcome).isin("completed", "failed"), F.col(outcome))
    e = F.when(o.isNotNull() & F.col(ended).isNotNull(), F.unix_micros(F.col(ended).cast("timestamp")))
    rows = stream.select(
        F.col(provider).alias("provider"), F.col(hook).alias("hook"), F.col(id_).alias("id"), _micros(F.col(time)).alias("t"),
        F.coalesce(o, F.lit("processing")).alias("outcome"), F.coalesce(e, F.lit(int(far))).alias("ended"),
    )
    known = _keyed(rows.where("hook is not null"), ["provider", "hook"], "processed boolean, outcome string, ended long", "begun long, ended long, failed boolean", step, idle)
    free = rows.where("hook is null").select("provider", "hook", "id", "t", F.lit(True).alias("processed"), "outcome", "ended")
    status = F.when(~F.col("processed"), "ignored").when(F.col("ended") == int(far), "processing").otherwise(F.col("outcome"))
    over = F.when(F.col("processed") & (F.col("ended") < int(far)), F.col("ended"))
    return known.unionByName(free).select("provider", "hook", "id", "t", "processed", status.alias("status"), over.alias("ended"))


def changed_rows(stream: DataFrame, keys: list[str], id_: str, time: str, hash_: Column, idle: int | None = None) -> DataFrame:
    """STR-5: (keys, id, t, hash) of the rows whose hash differs from that of the key's row
    before, so that what overlapping increments repeat is left out; a row that is older
    than the last one kept is outdated and left out too."""
    def step(part, state):
        last, at, new = *(state or (None, 0)), []
        for t, h in zip(part["t"].tolist(), part["hash"]):
            fresh = last is None or (h != last and t >= at)
            if fresh:
                last, at = h, int(t)
            new.append(fresh)
        return {"hash": part["hash"], "fresh": new}, (last, at)

    rows = stream.select(*keys, F.col(id_).alias("id"), _micros(F.col(time)).alias("t"), F.coalesce(hash_, F.lit("")).alias("hash"))
    return _keyed(rows, keys, "hash string, fresh boolean", "hash string, at long", step, idle).where("fresh").drop("fresh")
