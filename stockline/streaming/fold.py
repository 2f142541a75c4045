"""Structured Streaming over usage rows: fold, segments, meter, alerts, backstop and profiles per session, in one state per session.

A stream brings rows of extract_usage (session_id, ord, ts, message_id, model, cr, cc, inp, outp, human_turn). Rows of a session arrive in the
order of ord, in micro-batches of any size. The values of a call are those of the batch operators at that call.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stockline.functions import text as X
from stockline.functions.economics import BR_AMBER
from stockline.functions.models import COST_RATIOS, DEFAULT_COST_RATIO
from stockline.operators.calls import EMA_ALPHA, EMA_FLOOR, EMA_SEED, MISS_DROP, STOCK_EPSILON

OUTPUT = (
    "session_id long, kind string, ord long, call_id string, folded_seq long, turn_seq long, segment long, l long, miss boolean, g double, burn double, cycles long, progress double, "
    "deep_water boolean, gate_fires boolean, n_calls long, l_peak long, tokens long, dw_bills double, laps long, backstop_fires boolean, "
    "model string, l_floor long, b_total long, g_final double, o_avg double, c_ratio double, turns long, duration_ms long, total_tokens_read long, mf double, pp_exit double, br_exit double, "
    "br_peak double, pp_peak double, g_min double, p0 double, b_axis double, x_axis double, turn_at_br_amber long"
)
PROFILE = (
    "session_id", "segment", "model", "l_floor", "b_total", "l_peak", "g_final", "o_avg", "c_ratio", "turns", "n_calls", "duration_ms", "total_tokens_read", "mf", "pp_exit", "br_exit",
    "br_peak", "pp_peak", "g_min", "p0", "b_axis", "x_axis", "turn_at_br_amber",
)
#: The state of a session beside its known calls, which are a map of their own.
STATE = (
    "seq long, turn long, segment long, l long, stock long, dead long, ceiling long, g double, first boolean, burn double, micro long, run long, run_cycles long, fired boolean, n long, peak long, human boolean, "
    "bills double, laps long, turn0 long, amber long, ts0 long, ts1 long, read long, out long, model string, r double, mf double, pp double, br double, pp_peak double, br_peak double, g_min double, recent string, spilled boolean"
)
#: Keys of a session's map that stay in its value.
FEW = 128
#: Rows of a pack at most, and a processor's output of packs.
PACK = 256
PACKED = "session_id {0}, kind string, n int, pack string"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
IDLE_MS = 7 * 24 * 3600 * 1000


@functools.lru_cache(1024)
def _ratio(model: str) -> float:
    import re

    return next((r for p, r in COST_RATIOS if re.search(p, model or "", re.I)), DEFAULT_COST_RATIO)


def fresh() -> dict:
    return {"seq": 0, "turn": 0, "segment": 0, "l": 0, "stock": 0, "known": {}, "dead": 0, "ceiling": 0, "g": EMA_SEED, "first": True, "burn": None, "micro": 0, "run": 0, "run_cycles": 0, "fired": False, "n": 0, "peak": 0, "human": False} | {
        "bills": 0.0, "laps": 0, "turn0": None, "amber": None, "ts0": None, "ts1": None, "read": 0, "out": 0, "model": None, "r": None, "mf": None, "pp": None, "br": None, "pp_peak": None, "br_peak": None, "g_min": None,
    }


def _most(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else max(a, b)


def _closed(session: int, s: dict) -> dict:
    """The profile of the segment that ends, with the columns and values of the batch profile."""
    g, floor, o_avg = max(s["g"], EMA_FLOOR), s["dead"] or None, s["out"] / s["n"] if s["n"] else None
    head = {"session_id": session, "kind": "closed", "segment": s["segment"], "n_calls": s["n"], "l_peak": s["peak"], "g": g}
    if not s["n"]:
        return head
    return head | {
        "model": s["model"], "l_floor": floor, "b_total": floor, "g_final": g, "o_avg": o_avg, "c_ratio": s["r"], "turns": s["turn"] - s["turn0"] + 1, "duration_ms": None if s["ts0"] is None else s["ts1"] - s["ts0"],
        "total_tokens_read": s["read"], "mf": s["mf"], "pp_exit": s["pp"], "br_exit": s["br"], "br_peak": s["br_peak"], "pp_peak": s["pp_peak"], "g_min": s["g_min"],
        "p0": floor and floor / (s["r"] * g), "b_axis": 2 * o_avg / g, "x_axis": floor and s["peak"] / floor, "turn_at_br_amber": None if s["amber"] is None else s["amber"] - s["turn0"],
    }


def _interval(mf: float | None, target: float = BR_AMBER) -> float:
    """Bills between two backstops: the square of the right root of mf (u - 1)^2 / (2 u) = target."""
    if not mf:
        return math.inf
    half = mf + target
    return ((half + math.sqrt(half * half - mf * mf)) / mf) ** 2


def metered(s: dict, length: int, b: float, g: float, r: float) -> dict:
    """The position of a call against ``b``, and what the meter, the gate and the backstop in ``s`` make of it."""
    burn = max(0, length - b) / (r * b) if b else None
    before = s["micro"] // 1_000_000
    if burn is not None and s["burn"] is not None:
        s["micro"] += math.floor((s["burn"] + burn) / 2 * 1_000_000)
    s["burn"] = burn
    cycles = s["micro"] // 1_000_000
    deep, mf, pp, br = False, None, None, None
    if b:
        d, arm = math.sqrt(2 * r * g / b), math.sqrt(2 * r * b * g)
        mf = arm / (arm + b + r * g)
        if length > b:
            u = (length / b - 1) / d
            pp = (u - 1) ** 2 / (2 * u)
            br = mf * pp
            deep = length / b >= 1 + d and br >= BR_AMBER
    s["run"], s["run_cycles"] = (s["run"] + 1, s["run_cycles"] + cycles - before) if deep else (0, 0)
    fires = deep and not s["fired"] and s["run"] >= 3 and s["run_cycles"] > 0
    s["fired"] = s["fired"] or fires
    backstop = False
    if s["fired"] and not fires and deep:
        s["bills"] += cycles - before
        if s["bills"] >= _interval(mf):
            backstop, s["bills"], s["laps"] = True, 0.0, s["laps"] + 1
    s["r"], s["mf"], s["pp"], s["br"] = r, mf, pp, br
    if pp is not None:
        s["pp_peak"], s["br_peak"] = _most(s["pp_peak"], pp), _most(s["br_peak"], br)
    s["g_min"] = g if s["g_min"] is None else min(s["g_min"], g)
    return {"g": g, "burn": burn, "cycles": cycles, "progress": s["micro"] % 1_000_000 / 1_000_000, "deep_water": deep, "gate_fires": fires, "dw_bills": s["bills"], "laps": s["laps"], "backstop_fires": backstop}


def step(session: int, s: dict, row) -> list[dict]:
    """State after one usage row, and what it emits: a call, a revision of a known call, and a closed segment before a boundary."""
    out = []
    key = row.message_id if isinstance(row.message_id, str) else f"row:{row.ord}"
    total = int(row.cr + row.cc + row.inp + row.outp)
    if key in s["known"]:
        if total >= s["known"][key]:
            s["known"][key] = total
            out.append({"session_id": session, "kind": "revision", "ord": row.ord, "call_id": key, "tokens": total})
        return out
    stock = int(row.cr + row.cc + row.inp)
    miss = s["l"] > 0 and row.cr < MISS_DROP * s["l"] and stock >= s["stock"] - STOCK_EPSILON
    length = int(row.cr + row.cc if miss else row.cr)
    if s["stock"] > 0 and stock < s["stock"] - STOCK_EPSILON:
        out.append(_closed(session, s))
        s["known"].clear()
        keep = {k: s[k] for k in ("seq", "turn", "human", "known")}
        s.update(fresh() | keep | {"segment": s["segment"] + 1})
    s["known"][key] = total
    s["seq"] += 1
    s["turn"] += bool(s["seq"] == 1 or row.human_turn)
    if not s["ceiling"] and max(row.cr, row.cc, row.inp) > 0:
        s["dead"], s["ceiling"] = int(max(row.cr, row.cc, row.inp)), stock
    if s["first"]:
        s["first"] = False
    else:
        delta = length - s["l"]
        if s["l"] < s["ceiling"] and delta > 0:
            delta = max(0, length - s["ceiling"])
        s["g"] = EMA_ALPHA * max(delta, 0) + (1 - EMA_ALPHA) * s["g"]
    s["l"], s["stock"], s["n"], s["peak"] = length, stock, s["n"] + 1, max(s["peak"], length)
    position = metered(s, length, s["dead"], max(s["g"], EMA_FLOOR), _ratio(row.model))
    if s["turn0"] is None:
        s["turn0"] = s["turn"]
    if s["amber"] is None and s["br"] is not None and s["br"] >= BR_AMBER:
        s["amber"] = s["turn"]
    ms = getattr(row, "ms", None)
    if ms is not None:
        s["ts0"], s["ts1"] = (ms, ms) if s["ts0"] is None else (min(s["ts0"], ms), max(s["ts1"], ms))
    s.update({"read": s["read"] + stock, "out": s["out"] + int(row.outp), "model": row.model})
    out.append({
        "session_id": session, "kind": "call", "ord": row.ord, "call_id": key, "folded_seq": s["seq"], "turn_seq": s["turn"], "segment": s["segment"], "l": length, "miss": bool(miss), "tokens": total,
        **position,
    })
    return out


_STATE = [c.split()[0] for c in STATE.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    """Maps in state need the RocksDB store. A query that was started before keeps the store of its checkpoint."""
    spark.conf.set(*STORE)


def emitted(rows: Iterable[dict], columns: list[str]) -> Iterator[Row]:
    row = Row(*columns)
    return (row(*(x.get(c) for c in columns)) for x in rows)


def packs(rows: Iterable[dict]) -> Iterator[dict]:
    """kind, number and columns (as JSON) of rows of one kind, up to PACK of them: to hand out each row by itself costs Python and Arrow many times a row's own work.

    A column of equal values is told once.
    """
    alike: dict[tuple, list[dict]] = {}
    for row in rows:
        alike.setdefault((row["kind"], *row), []).append(row)
    for (kind, *names), same in alike.items():
        for i in range(0, len(same), PACK):
            part = same[i : i + PACK]
            columns = zip(*(row.values() for row in part), strict=True)
            told = {c: values[:1] if values.count(values[0]) == len(values) else values for c, values in zip(names, columns, strict=True) if c not in ("session_id", "kind")}
            yield {"kind": kind, "n": len(part), "pack": json.dumps(told)}


def rows_of(pack: str, n: int) -> Iterator[dict]:
    columns = json.loads(pack)
    return (dict(zip(columns, values, strict=True)) for values in zip(*(v if len(v) == n else v * n for v in columns.values()), strict=True))


def emitted_packs(session, rows: Iterable[dict]) -> Iterator[Row]:
    return emitted(({"session_id": session, **pack} for pack in packs(rows)), ["session_id", "kind", "n", "pack"])


def unpacked(packed: DataFrame, schema: str) -> DataFrame:
    """Rows of ``packs``, with the columns of ``schema``: those that aren't in the packs are the packed rows' own."""
    fields = [c.split(" ", 1) for c in schema.split(", ")]
    told = [(name, kind) for name, kind in fields if name not in packed.columns]
    columns = F.from_json("pack", ", ".join(f"{name} array<{kind}>" for name, kind in told))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    rows = X.let(columns, lambda p: F.transform(places, lambda i: F.struct(*[F.get(p[name], i % F.size(p[name])).alias(name) for name, _ in told])))
    return packed.select(*[name for name, _ in fields if name in packed.columns], F.inline(rows)).select(*[name for name, _ in fields])


class Held:
    """A map in state while one session's rows of a batch are taken in: a key is read once at most, and ``flush`` writes each changed key once.

    A call of a state goes through a socket and costs more than a row's own work. Of a map that is ``empty`` (of a new session), or was
    cleared in this batch, nothing is read at all. Only the keys that a batch brings are held, unless the map is iterated.
    """

    def __init__(self, state, empty: bool = False):
        self.state, self.values, self.changed, self.whole, self.stored, self.cleared = state, {}, {}, empty, not empty, False

    def getValue(self, key: tuple) -> tuple | None:
        if key not in self.values and not self.whole:
            self.values[key] = self.state.getValue(key)
        return self.values.get(key)

    def containsKey(self, key: tuple) -> bool:
        return self.getValue(key) is not None

    def updateValue(self, key: tuple, value: tuple | None) -> None:
        self.values[key] = value
        self.changed[key] = None

    def removeKey(self, key: tuple) -> None:
        self.updateValue(key, None)

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        """Keys and values in the order of keys."""
        if self.whole and not self.values:
            return iter(())
        if not self.whole:
            self.values = {tuple(k): tuple(v) for k, v in self.state.iterator()} | self.values
            self.whole = True
        return iter(sorted((k, v) for k, v in self.values.items() if v is not None))

    def clear(self) -> None:
        self.cleared = self.stored
        if self.values or not self.whole:
            self.values, self.changed, self.whole = {}, {}, True

    def flush(self) -> None:
        if self.cleared:
            self.state.clear()
        for key in self.changed:
            if self.values[key] is not None:
                self.state.updateValue(key, self.values[key])
            elif self.stored and not self.cleared:
                self.state.removeKey(key)
        self.changed, self.stored, self.cleared = {}, True, False


class Recent(Held):
    """A map of strings to numbers whose newest keys are part of the session's own value (``recent``), up to FEW; more of them go to the map at once.

    A session of few keys never calls the map.
    """

    def __init__(self, state, recent: dict | None, spilled: bool | None):
        super().__init__(state, not spilled)
        self.recent, self.spilled = dict(recent or {}), bool(spilled)

    def getValue(self, key: tuple) -> tuple | None:
        return (self.recent[key[0]],) if key[0] in self.recent else super().getValue(key)

    def updateValue(self, key: tuple, value: tuple) -> None:
        if key[0] in self.recent or super().getValue(key) is None:
            self.recent[key[0]] = value[0]
        else:
            super().updateValue(key, value)

    def clear(self) -> None:
        super().clear()
        self.recent, self.spilled = {}, False

    def flush(self) -> None:
        if len(self.recent) > FEW:
            for key, value in self.recent.items():
                super().updateValue((key,), (value,))
            self.recent, self.spilled = {}, True
        super().flush()


class _Known:
    """The calls of a session and their largest totals: a map in state, of which a batch touches only its own ids."""

    def __init__(self, held: Recent):
        self.held = held

    def __contains__(self, key: str) -> bool:
        return self.held.containsKey((key,))

    def __getitem__(self, key: str) -> int:
        return self.held.getValue((key,))[0]

    def __setitem__(self, key: str, total: int) -> None:
        self.held.updateValue((key,), (total,))

    def clear(self) -> None:
        self.held.clear()


class FoldProcessor(StatefulProcessor):
    """``step`` for each row of a session, in order; after ``idle_ms`` without rows the segment is closed and the state goes."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "call_id string", "tokens long")
        self.value = handle.getValueState("session", STATE)

    def _load(self) -> dict:
        held = self.value.get()
        s = fresh() | (dict(zip(_STATE, held, strict=True)) if held else {})
        return s | {"known": _Known(Recent(self.known, json.loads(s.get("recent") or "{}"), s.get("spilled")))}

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        s, out = self._load(), []
        for row in sorted(rows, key=lambda r: r.ord):
            out += step(key[0], s, row)
        known = s["known"].held
        known.flush()
        s.update({"recent": json.dumps(known.recent), "spilled": known.spilled})
        self.value.update(tuple(s[c] for c in _STATE))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from emitted_packs(key[0], out)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[Row]:
        s = self._load()
        self.known.clear()
        self.value.clear()
        yield from emitted_packs(key[0], [_closed(key[0], s)])

    def close(self) -> None:
        pass


def stream_fold(usage: DataFrame, timeout: bool = True) -> DataFrame:
    """Calls, revisions and closed segments of a stream of usage. A session that is idle for a week closes its segment and leaves the state.

    A finite input (trigger availableNow) is run without the time-out, which would wait for it.
    """
    use_rocksdb(usage.sparkSession)
    if "ts" in usage.columns:
        usage = usage.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).drop("ts")
    packed = usage.groupBy("session_id").transformWithState(FoldProcessor(IDLE_MS if timeout else None), PACKED.format("long"), "append", "processingTime" if timeout else "none")
    return unpacked(packed, OUTPUT)


def closed_profiles(stream: DataFrame) -> DataFrame:
    """Profiles of the segments that ended, from the rows of stream_fold: what segment_profiles gives for them in batch."""
    return stream.where("kind = 'closed' AND n_calls > 0").select(*PROFILE)


def stream_entries(lines: DataFrame) -> DataFrame:
    """Entries of a stream of lines (session_id, ord, line)."""
    from stockline.sources.transcripts import parse_entries

    return parse_entries(lines)


def stream_fold_daily(usage: DataFrame, delay: str = "2 days") -> DataFrame:
    """Last snapshot of each call within its day, for daily totals: the id is kept for as long as the watermark needs it."""
    kept = usage.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "session_id", "message_id").agg(F.max_by(F.struct("model", "cr", "cc", "inp", "outp"), "ord").alias("x"))
    return kept.select(F.to_date("w.start").alias("day"), "session_id", "message_id", "x.*")


def _fork(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    forks = 0
    for row in pd.concat(list(batches)).sort_values("ord").itertuples():
        if isinstance(row.uuid, str):
            forks += last is not None and row.parent_uuid != last
            last = row.uuid
    state.update((last or "",))
    yield pd.DataFrame({"session_id": [key[0]], "n_forks": [forks]}).iloc[: int(forks > 0)]


def replay_queue(entries: DataFrame) -> DataFrame:
    """Sessions of a stream whose newest entry doesn't continue the one before: they are replayed in batch and upserted as replays."""
    main = entries.where(~F.col("is_sidechain")).select("session_id", "ord", "uuid", "parent_uuid")
    return main.groupBy("session_id").applyInPandasWithState(_fork, "session_id long, n_forks long", "uuid string", "update", GroupStateTimeout.NoTimeout)


def discard_stale(results: DataFrame, uses: DataFrame) -> DataFrame:
    """Results whose use is of the same segment; what comes after a context was left no longer counts."""
    return results.join(uses.select("session_id", "id", "segment"), ["session_id", "id", "segment"], "left_semi")


def reanchor(samples: DataFrame) -> DataFrame:
    """Adds ``anchor`` to samples (session_id, ord, state_key, seq): the meter starts anew, and cycles stay, where the identity
    changes or the number falls back."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("ord")
    changed = (F.lag("state_key").over(w) != F.col("state_key")) | (F.lag("seq").over(w) > F.col("seq"))
    return samples.withColumn("anchor", F.coalesce(changed, F.lit(True)))


def sweep(usage: DataFrame, waiting: DataFrame) -> DataFrame:
    """Analysed calls of the sessions that wait for a replay: the batch operators over a bounded list."""
    from stockline.operators.calls import analyse

    return analyse(usage.join(waiting.select("session_id"), "session_id", "left_semi"))


def snapshot_sink(stream: DataFrame, write, every: str | None = "30 seconds", checkpoint: str | None = None):
    """A started query that gives each micro-batch's calls to ``write(df, batch_id)``; without ``every`` it ends when the input does."""
    writer = stream.writeStream.foreachBatch(write).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
