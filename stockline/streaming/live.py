"""A live replay: lines of growing transcripts in, calls with B(t), settlement, growth, meter and alerts out.

Two stateful steps by session, with the library's own column expressions between them:

1. ``Sequencer`` puts lines in order, follows the conversation tree, folds calls and matches tool results with their uses. Its state is a
   few numbers, and maps (first line -> run of rows, first line -> run of links of the tree, call id -> tokens, tool use id -> use); a batch touches the keys it brings.
   - Lines may come in any order and in any micro-batch: one that is early waits in the map until all before it are there.
   - A result counts only in the segment of its use; uses are forgotten when their segment ends, and those of other than file tools after two turns.
   - While entries continue the one before, nothing but the new rows is read. After the first entry that does not, each batch compares
     the plan (the active branch, or the branch of each root) with what was folded: if that is no beginning of the plan, the session was rewound,
     and it is folded again from its rows in state (``rewind``). A longer branch is only continued.
2. ``tools.writes_of`` turns the matched events into lines of paths, in the JVM.
3. ``Ledger`` keeps path -> totals and (path, epoch, line) -> tokens, credits B with what a call's events wrote, settles it against the
   growth of L, smooths the rest, and moves the meter, the gate and the backstop. ``lifetime`` counts the bill cycles of a session: it never falls,
   and calls that a rewind repeats don't count again. ``anchor`` marks calls where the meter starts anew: a new segment, or a number that falls back.

What stays of a session after its last rewind is what ``operators.replay`` gives for its lines (and ``billing`` for the meter). A session's rows stay in
state until it is idle for ``idle_ms``, since a rewind needs them. Two results for one path in one line count as one write.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stockline.functions import text as X
from stockline.operators import tools
from stockline.operators.calls import EMA_ALPHA, EMA_FLOOR, EMA_SEED, MISS_DROP, STOCK_EPSILON
from stockline.operators.ledger import CLEARS
from stockline.sources import transcripts

from .fold import BR_AMBER, IDLE_MS, PACKED, Held, Recent, _closed, _ratio, emitted, emitted_packs, metered, packs, rows_of, unpacked, use_rocksdb

MAX_TURNS = 2
#: Lines, and characters, of a run of rows that is one value of the state.
RUN_ROWS, RUN_CHARS = 256, 1 << 20
EVENT = (
    "session_id {0}, kind string, at long, rewinds long, again boolean, ord long, segment long, boundary string, call_id string, folded_seq long, turn_seq long, miss boolean, l long, delta_l long, dead long, stock long, "
    "outp long, tokens long, model string, ms long, id string, name string, input string, cwd string, result_text string, turns long"
)
#: What the sequencer hands out: packs of its events; a tool event is a pack of its own, beside what its writes are told from.
TOOL = ("name", "input", "cwd", "result_text")
SENT = PACKED + ", name string, input string, cwd string, result_text string"
CALL = (
    "session_id {0}, kind string, at long, rewinds long, ord long, segment long, call_id string, folded_seq long, turn_seq long, miss boolean, l long, dead long, tokens long, b double, deferred double, residual double, g double, burn double, "
    "cycles long, progress double, lifetime long, anchor boolean, deep_water boolean, gate_fires boolean, dw_bills double, laps long, backstop_fires boolean, n_calls long, l_peak long, "
    "model string, l_floor long, b_total double, g_final double, o_avg double, c_ratio double, turns long, duration_ms long, total_tokens_read long, mf double, pp_exit double, br_exit double, br_peak double, pp_peak double, g_min double, "
    "p0 double, b_axis double, x_axis double, turn_at_br_amber long, path string, path_tokens double"
)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def entry_rows(lines: DataFrame) -> DataFrame:
    """session_id, ord and ``row`` (JSON of what the sequencer needs) of lines (session_id, ord, line); null for lines that are no entry of the main chain."""
    block = F.from_json("content", "array<struct<type:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>")
    blocks = F.when(F.ltrim("content").startswith("["), F.filter(block, lambda b: b["type"].isin("tool_use", "tool_result")))
    part = lambda b: F.struct(
        F.coalesce(b["id"], b["tool_use_id"]).alias("id"), (b["type"] == "tool_use").alias("use"), b["name"].alias("name"), b["input"].alias("input"), X.result_text(b["content"]).alias("text"), b["is_error"].alias("bad")
    )
    # the counters are columns before what asks them, so a usage is read once
    counters = transcripts.counters()
    entries = transcripts.parse_entries(lines, keep=True).withColumns(counters).withColumns({"_used": transcripts.is_used({n: F.col(n) for n in counters}), "_turn": transcripts.is_turn_boundary()})
    row = F.to_json(F.struct("uuid", F.col("parent_uuid").alias("parent"), transcripts.fold_key().alias("call"), F.unix_millis("ts").alias("ms"), "cwd", "model", "cr", "cc", "inp", "outp", F.col("_used").alias("used"), F.col("_turn").alias("turn"), F.transform(blocks, part).alias("blocks")))
    return entries.select("session_id", "ord", F.when(F.col("type").isNotNull() & ~F.col("is_sidechain"), row).alias("row"))


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (session_id, ord, row) that follow one another in a session as one row of lists."""
    for batch in batches:
        ids = batch.column(0)
        starts = np.flatnonzero(np.concatenate([[True], pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)])) if len(ids) else np.empty(0, int)
        offsets = pa.array(np.append(starts, len(ids)), pa.int32())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), *(pa.ListArray.from_arrays(offsets, batch.column(i)) for i in (1, 2))], ["session_id", "ords", "rows"])


def replay_plan(links: list[tuple[int, str, str | None]]) -> list[tuple[int, int]]:
    """(line, number of its root) in replay order, of (line, uuid, parent) in order of lines: as ``tree.replay_plan``."""
    place = {uuid: (ord_, parent) for ord_, uuid, parent in links}
    up = {uuid: p if p != uuid and p in place else None for uuid, (_, p) in place.items()}
    last: dict[str, str] = {}
    for uuid in sorted(place, key=lambda u: place[u][0]):
        if up[uuid]:
            last[up[uuid]] = uuid
    roots = sorted((u for u in place if up[u] is None), key=lambda u: place[u][0])

    def branch(start: str) -> set[str]:
        seen = set()
        while start in last and start not in seen:
            seen.add(start)
            start = last[start]
        path: set[str] = set()
        at: str | None = start
        while at and at not in path:
            path.add(at)
            at = up[at]
        return path

    chosen: dict[str, int] = {}
    starts = roots if len(roots) > 1 else [max(place, key=lambda u: place[u][0])]
    for k, start in enumerate(starts):
        for uuid in branch(start):
            chosen.setdefault(uuid, k + 1)
    return sorted(((ord_, chosen[uuid]) for ord_, uuid, _ in links if uuid in chosen), key=lambda x: (x[1], x[0]))


#: What the sequencer knows of a session beside its maps. ``folded`` and ``mark`` say which lines were folded, and in which order;
#: ``opens``: the next call is the first of a root, ``parts``: nothing of that root went out.
SESSION = "next long, at long, rewinds long, linear boolean, tree boolean, latest string, roots long, folded long, mark long, root long, opens boolean, parts boolean, seq long, turn long, bump boolean, segment long, n long, l long, stock long, dead long, ceiling long, " + (
    "recent string, spilled boolean, recent_uuids string, spilled_uuids boolean"
)
_SESSION = _names(SESSION)


def _new_session() -> dict:
    return dict.fromkeys(_SESSION, 0) | {"linear": True, "tree": False, "latest": None, "opens": False, "parts": False, "bump": False, "recent": "{}", "recent_uuids": "{}", "spilled": False, "spilled_uuids": False}


class _Timed(StatefulProcessor):
    """A processor whose sessions leave the state after ``idle_ms`` without rows (never, if it is None)."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def touch(self, timer_values) -> None:
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

    def close(self) -> None:
        pass


class Sequencer(_Timed):
    """``early`` holds lines that wait for those before them; ``runs`` the rows, and ``links`` the tree, of lines in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("session", SESSION)
        self.runs = handle.getMapState("runs", "first long", "rows array<string>")
        self.links = handle.getMapState("links", "first long", "ords array<long>, uuids array<string>, parents array<string>")
        self.maps = {
            "early": handle.getMapState("early", "ord long", "row string"),
            "uuids": handle.getMapState("uuids", "uuid string", "ord long"),
            "known": handle.getMapState("known", "call_id string", "tokens long"),
            "waiting": handle.getMapState("waiting", "id string", "name string, input string, cwd string, turn long"),
        }

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        held = self.value.get()
        s = dict(zip(_SESSION, held, strict=True)) if held else _new_session()
        self.out: list[dict] = []
        self.session = key[0]
        self.early, self.waiting = (Held(self.maps[m], not held) for m in ("early", "waiting"))
        self.known, self.uuids = Recent(self.maps["known"], json.loads(s["recent"]), s["spilled"]), Recent(self.maps["uuids"], json.loads(s["recent_uuids"]), s["spilled_uuids"])
        self.starts, self.run = None, None
        came = {}
        for _, ords, texts in rows:
            # one text for all lines of a run: a call of the parser costs as much as a line
            read = json.loads(f"[{','.join('null' if text is None else text for text in texts)}]")
            came.update((ord_, (text, row)) for ord_, text, row in zip(ords, texts, read, strict=True) if ord_ >= s["next"])
        at = first = s["next"]
        run, fresh = [], []
        while True:
            if at in came:
                text, row = came.pop(at)
                if held:
                    self.early.removeKey((at,))
            elif self.early.containsKey((at,)):
                text = self.early.getValue((at,))[0]
                row = None if text is None else json.loads(text)
                self.early.removeKey((at,))
            else:
                break
            # a plan is made of links, so a line without uuid is never read again
            run.append(text if row and row.get("uuid") is not None else None)
            if row is not None:
                fresh.append((at, row))
            at += 1
        s["next"] = at
        for ord_, (text, _) in came.items():
            self.early.updateValue((ord_,), (text,))
        if any(run):
            self._keep(first, run)
        self._follow(s, fresh)
        for state in (self.early, self.uuids, self.known, self.waiting):
            state.flush()
        s.update({"recent": json.dumps(self.known.recent), "spilled": self.known.spilled, "recent_uuids": json.dumps(self.uuids.recent), "spilled_uuids": self.uuids.spilled})
        self.value.update(tuple(s[c] for c in _SESSION))
        self.touch(timer_values)
        yield from self._sent()

    def _sent(self) -> Iterator[Row]:
        tools_ = [e for e in self.out if e["kind"] == "tool"]
        sent = list(packs(e for e in self.out if e["kind"] != "tool"))
        for event in tools_:
            apart = {c: event.pop(c) for c in TOOL}
            sent += (pack | apart for pack in packs([event]))
        return emitted(({"session_id": self.session, **x} for x in sent), _SENT)

    def _keep(self, first: int, rows: list[str | None]) -> None:
        """Lines from ``first`` on as runs in state; one without any row isn't kept."""
        start, chars = 0, 0
        for i, raw in enumerate(rows):
            chars += len(raw or "")
            if i + 1 == len(rows) or i + 1 - start == RUN_ROWS or chars >= RUN_CHARS:
                if chars:
                    self.runs.updateValue((first + start,), (rows[start : i + 1],))
                start, chars = i + 1, 0

    def _row(self, ord_: int) -> dict:
        """A line that was kept, from its run; one run is held at a time."""
        if self.starts is None:
            self.starts = sorted(k[0] for k in self.runs.keys())
        first = self.starts[bisect.bisect_right(self.starts, ord_) - 1]
        if self.run is None or self.run[0] != first:
            self.run = (first, self.runs.getValue((first,))[0])
        return json.loads(self.run[1][ord_ - first])

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[Row]:
        for state in (self.value, self.runs, self.links, *self.maps.values()):
            state.clear()
        yield from ()

    def _follow(self, s: dict, fresh: list[tuple[int, dict]]) -> None:
        """Folds new rows that continue the session; else compares the plan with what was folded."""
        straight, tree = [], []
        for ord_, row in fresh:
            uuid, parent = row.get("uuid"), row.get("parent")
            if uuid is None:
                if not s["tree"]:
                    straight.append((ord_, row, 1))
                continue
            known = parent is not None and parent != uuid and self.uuids.containsKey((parent,))
            if (not s["tree"] and s["folded"] + len(straight)) or self.uuids.containsKey((uuid,)) or (known and parent != s["latest"]):
                s["linear"] = False
            s["roots"] += not known
            s["tree"], s["latest"] = True, uuid
            self.uuids.updateValue((uuid,), (ord_,))
            tree.append((ord_, uuid, parent))
            straight.append((ord_, row, s["roots"]))
        for i in range(0, len(tree), RUN_ROWS):
            part = tree[i : i + RUN_ROWS]
            self.links.updateValue((part[0][0],), tuple(list(x) for x in zip(*part, strict=True)))
        if s["linear"]:
            for ord_, row, root in straight:
                self._fold(s, ord_, row, root, False)
            return
        if not fresh:
            return
        links = sorted((x for _, v in self.links.iterator() for x in zip(*v, strict=True)), key=lambda x: x[0])
        plan, done = replay_plan(links), s["folded"]
        mark = 0
        for ord_, _ in plan[:done]:
            mark = zlib.crc32(b"%d," % ord_, mark)
        again = fresh[0][0]
        if len(plan) < done or mark != s["mark"]:
            keep = {k: s[k] for k in ("next", "at", "linear", "tree", "latest", "roots")}
            s.update(_new_session() | keep | {"rewinds": s["rewinds"] + 1})
            self.known.clear()
            self.waiting.clear()
            self._emit(s, kind="rewind")
            done = 0
        for ord_, root in plan[done:]:
            self._fold(s, ord_, self._row(ord_), root, ord_ < again)

    def _emit(self, s: dict, **row) -> None:
        if s["parts"] and row["kind"] in ("tool", "call"):  # a root parts segments at its first event
            s["parts"] = False
            self._emit(s, kind="root", segment=s["segment"])
        s["at"] += 1
        self.out.append({"at": s["at"], "rewinds": s["rewinds"], **row})

    def _fold(self, s: dict, ord_: int, row: dict, root: int, again: bool) -> None:
        s["folded"] += 1
        s["mark"] = zlib.crc32(b"%d," % ord_, s["mark"])
        if s["root"] and root != s["root"]:
            s["opens"] = s["parts"] = True
            self.waiting.clear()
        s["root"] = root
        inside = s["segment"] + (s["opens"] and s["seq"] > 0)
        for b in row.get("blocks") or ():
            if b.get("id") is None:
                continue
            if b["use"]:
                self.waiting.updateValue((b["id"],), (b.get("name") or "", b.get("input"), row.get("cwd"), s["turn"]))
            elif self.waiting.containsKey((b["id"],)):
                name, given, cwd, turn = self.waiting.getValue((b["id"],))
                if not (b.get("bad") and name in tools.FILE_TOOLS):
                    self.waiting.removeKey((b["id"],))
                    self._emit(s, kind="tool", ord=ord_, segment=inside, id=b["id"], name=name, input=given, cwd=cwd, result_text=b.get("text"), turns=s["turn"] - turn)
        s["bump"] = s["bump"] or row["turn"]
        if row["used"]:
            self._call(s, ord_, row, again)

    def _call(self, s: dict, ord_: int, row: dict, again: bool) -> None:
        cr, cc, inp, outp = row["cr"], row["cc"], row["inp"], row["outp"]
        call, total, stock = row.get("call") or f"row:{ord_}", cr + cc + inp + outp, cr + cc + inp
        known = self.known.getValue((call,))
        if known:
            if total >= known[0]:
                self.known.updateValue((call,), (total,))
                self._emit(s, kind="revision", ord=ord_, segment=s["segment"], call_id=call, tokens=total, ms=row.get("ms"))
            return
        self.known.updateValue((call,), (total,))
        evicted = s["l"] > 0 and cr < MISS_DROP * s["l"]
        miss = evicted and not s["opens"] and stock >= s["stock"] - STOCK_EPSILON
        fell = s["stock"] > 0 and stock < s["stock"] - STOCK_EPSILON and not (s["tree"] and evicted)
        boundary = None
        if s["seq"] and (s["opens"] or fell):
            boundary = "root" if s["opens"] else "fall"
            if boundary == "fall":
                self.waiting.clear()
            s.update({"segment": s["segment"] + 1, "n": 0, "dead": 0, "ceiling": 0})
        length, before = cr + cc if miss else cr, s["l"] if s["n"] else None
        s["opens"], s["seq"], s["n"] = False, s["seq"] + 1, s["n"] + 1
        if s["bump"] or s["seq"] == 1:
            s["turn"], s["bump"] = s["turn"] + 1, False
            for id_, held in list(self.waiting.iterator()):
                if held[0] not in tools.FILE_TOOLS and s["turn"] - held[3] > MAX_TURNS:
                    self.waiting.removeKey((id_[0],))
        if not s["dead"]:
            s["dead"], s["ceiling"] = max(cr, cc, inp), stock
        delta = None if before is None else length - before
        if delta is not None and before < s["ceiling"] and delta > 0:
            delta = max(0, length - s["ceiling"])
        s["l"], s["stock"] = length, stock
        self._emit(
            s, kind="call", again=again, ord=ord_, segment=s["segment"], boundary=boundary, call_id=call, folded_seq=s["seq"], turn_seq=s["turn"], miss=miss, l=length, delta_l=delta, dead=s["dead"], stock=stock,
            outp=outp, tokens=total, model=row.get("model"), ms=row.get("ms"),
        )


#: The ledger's numbers: of the segment, then of the session.
SEGMENT = (
    "paths double, prev_b double, bank double, g double, burn double, micro long, run long, run_cycles long, fired boolean, bills double, laps long, n long, peak long, b double, dead long, turn long, turn0 long, amber long, ts0 long, ts1 long, "
    "read long, out long, model string, r double, mf double, pp double, br double, pp_peak double, br_peak double, g_min double"
)
LEDGER = SEGMENT + ", segment long, rewinds long, lifetime long, applied long, last_seq long"
_LEDGER = _names(LEDGER)


_SENT = _names(SENT)
_SEGMENT = dict.fromkeys(_names(SEGMENT)) | dict.fromkeys(("paths", "prev_b", "bank", "bills", "b"), 0.0) | {"g": EMA_SEED, "micro": 0, "run": 0, "run_cycles": 0, "fired": False, "laps": 0, "n": 0, "peak": 0, "dead": 0, "turn": 0, "read": 0, "out": 0}


def _new_segment() -> dict:
    return dict(_SEGMENT)


class Ledger(_Timed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("session", LEDGER)
        self.maps = {
            "lines": handle.getMapState("lines", "path string, epoch long, line long", "tokens double"),
            "paths": handle.getMapState("paths", "path string", "epoch long, lines double, edits double, overhead double, total double"),
            "grown": handle.getMapState("grown", "path string", "tokens double"),
        }

    def _hold(self, empty: bool) -> None:
        self.lines, self.paths, self.grown = (Held(m, empty) for m in self.maps.values())

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        held = self.value.get()
        s = dict(zip(_LEDGER, held, strict=True)) if held else _new_segment() | {"segment": 0, "rewinds": 0, "lifetime": 0, "applied": -1, "last_seq": 0}
        self.out: list[dict] = []
        self.session = key[0]
        self._hold(not held)
        events = [(e["at"], kind, e, writes) for _, kind, n, pack, writes in rows for e in rows_of(pack, n)]
        for at, kind, e, writes in sorted(events, key=lambda x: x[0]):
            if kind == "tool":
                self._write(s, writes or [])
            elif kind == "call":
                self._call(s, e)
            elif kind == "revision":
                self.out.append({"kind": kind} | {c: e[c] for c in ("at", "rewinds", "ord", "segment", "call_id", "tokens")})
            else:
                self._end(s, at, closed=kind == "root")
                s["rewinds"] = e["rewinds"]
                if kind == "rewind":
                    self.out.append({"kind": kind, "at": at, "rewinds": e["rewinds"]})
        for state in (self.lines, self.paths, self.grown):
            state.flush()
        self.value.update(tuple(s[c] for c in _LEDGER))
        self.touch(timer_values)
        yield from emitted_packs(self.session, self.out)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[Row]:
        held = self.value.get()
        self.out, self.session = [], key[0]
        self._hold(False)
        if held:
            self._end(dict(zip(_LEDGER, held, strict=True)), None)
        for state in (self.value, *self.maps.values()):
            state.clear()
        yield from emitted_packs(self.session, self.out)

    def _end(self, s: dict, at: int | None, closed: bool = True) -> None:
        """The segment ends: its profile and its paths go out, unless a rewind makes them void."""
        if closed and s["n"]:
            self.out.append(_closed(self.session, s) | {"at": at, "rewinds": s["rewinds"], "b_total": s["b"]})
            place = {"kind": "path", "segment": s["segment"], "at": at, "rewinds": s["rewinds"]}
            self.out.extend(place | {"path": k[0], "path_tokens": v[4]} for k, v in self.paths.iterator() if v[4] > 0)
        s.update(_new_segment())
        for state in (self.lines, self.paths, self.grown):
            state.clear()

    def _write(self, s: dict, writes: list[dict]) -> None:
        """Lines of one event: a clearing write starts a path's epoch anew, a line keeps its last tokens, edits add up."""
        by_path: dict[str, list] = {}
        for w in writes:
            by_path.setdefault(w["path"], []).append(w)
        for path, own in by_path.items():
            held = self.paths.getValue((path,))
            epoch, lines, edits, overhead, total = held if held else (0, 0.0, 0.0, None, 0.0)
            own.sort(key=lambda w: w["line"] or 0)
            if own[0]["op"] in CLEARS:
                epoch, lines, edits, overhead = epoch + 1, 0.0, 0.0, None
            for w in own:
                if w["op"] == "editDelta":
                    edits += w["tokens"]
                    continue
                line = (path, epoch, w["line"] or 0)
                before = self.lines.getValue(line)
                lines += w["tokens"] - (before[0] if before else 0.0)
                self.lines.updateValue(line, (w["tokens"],))
                overhead = overhead if w["overhead"] is None else w["overhead"]
            after = max(0.0, lines + edits + (overhead or 0.0))
            self.paths.updateValue((path,), (epoch, lines, edits, overhead, after))
            grown = self.grown.getValue((path,))
            self.grown.updateValue((path,), ((grown[0] if grown else 0.0) + after - total,))
            s["paths"] += after - total

    def _call(self, s: dict, row: dict) -> None:
        if row["boundary"] == "fall":
            self._end(s, row["at"])
        anchor = s["n"] == 0 or row["folded_seq"] < s["last_seq"]
        b, residual = row["dead"] + s["paths"], None
        if row["delta_l"] is not None:
            positive = sum([max(0.0, v[0]) for _, v in self.grown.iterator()])
            up, db = max(0.0, float(row["delta_l"])), b - s["prev_b"]
            behind = max(0.0, up - db)
            retired = min(s["bank"], behind)
            residual = behind - retired
            s["bank"] += min(max(0.0, db - up), positive) - retired
            s["g"] = EMA_ALPHA * residual + (1 - EMA_ALPHA) * s["g"]
        self.grown.clear()
        before = s["micro"] // 1_000_000
        position = metered(s, row["l"], b, max(s["g"], EMA_FLOOR), _ratio(row["model"]))
        if not row["again"] and row["ord"] > s["applied"]:
            s["lifetime"] += position["cycles"] - before
            s["applied"] = row["ord"]
        turn, ms = row["turn_seq"], row["ms"]
        s.update({"prev_b": b, "b": b, "dead": row["dead"], "n": s["n"] + 1, "peak": max(s["peak"], row["l"]), "turn": turn, "segment": row["segment"], "last_seq": row["folded_seq"], "model": row["model"], "read": s["read"] + row["stock"], "out": s["out"] + row["outp"]})
        s["turn0"] = turn if s["turn0"] is None else s["turn0"]
        if s["amber"] is None and s["br"] is not None and s["br"] >= BR_AMBER:
            s["amber"] = turn
        if ms is not None:
            s["ts0"], s["ts1"] = (ms, ms) if s["ts0"] is None else (min(s["ts0"], ms), max(s["ts1"], ms))
        self.out.append({
            "kind": "call", "at": row["at"], "rewinds": row["rewinds"], "ord": row["ord"], "segment": row["segment"], "call_id": row["call_id"], "folded_seq": row["folded_seq"], "turn_seq": turn, "miss": row["miss"], "l": row["l"],
            "dead": row["dead"], "tokens": row["tokens"], "b": b, "deferred": s["bank"], "residual": residual, "lifetime": s["lifetime"], "anchor": anchor, **position,
        })


def _kind(df: DataFrame) -> str:
    return df.schema["session_id"].dataType.simpleString()


def _sent(lines: DataFrame, timeout: bool) -> DataFrame:
    use_rocksdb(lines.sparkSession)
    runs = entry_rows(lines).mapInArrow(_in_runs, f"session_id {_kind(lines)}, ords array<long>, rows array<string>")
    return runs.groupBy("session_id").transformWithState(Sequencer(IDLE_MS if timeout else None), SENT.format(_kind(lines)), "append", "processingTime" if timeout else "none")


def sequenced(lines: DataFrame, timeout: bool = True) -> DataFrame:
    """Calls, revisions, matched tool events, roots and rewinds of a stream of lines (session_id, ord from 0 without gaps, line)."""
    return unpacked(_sent(lines, timeout), EVENT.format(_kind(lines)))


def live_packs(lines: DataFrame, ascii_ctp: Column, cjk_ctp: Column, timeout: bool = True) -> DataFrame:
    """The rows of ``live_replay`` as packs (``fold.packs``): who needs few of their kinds or columns reads only those."""
    sent = _sent(lines, timeout).withColumn("skill_text", F.lit(None).cast("string"))
    written = sent.select("session_id", "kind", "n", "pack", F.when(F.col("kind") == "tool", tools.writes_of(ascii_ctp, cjk_ctp)).alias("writes"))
    return written.groupBy("session_id").transformWithState(Ledger(IDLE_MS if timeout else None), PACKED.format(_kind(lines)), "append", "processingTime" if timeout else "none")


def live_replay(lines: DataFrame, ascii_ctp: Column, cjk_ctp: Column, timeout: bool = True) -> DataFrame:
    """Calls, revisions, rewinds and closed segments of a stream of lines; ``at`` orders a session's rows, ``rewinds`` counts what made earlier ones void."""
    return unpacked(live_packs(lines, ascii_ctp, cjk_ctp, timeout), CALL.format(_kind(lines)))


def residual_uses(events: DataFrame) -> DataFrame:
    """Matched events of ``sequenced`` whose result came within two turns of its use: those that a residual is dealt to."""
    return events.where((F.col("kind") == "tool") & (F.col("turns") <= MAX_TURNS))
