"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation's roles must read `(s?(ua)+)?` in their initials: system at most once and first, then user and assistant by
turns. Each row is kept (cost 0), given the role that the place asks for (2) or deleted (3); a missing user or assistant
row is inserted with an empty text (2). Blank and repeated rows must go; a truncated row that stays costs 1 more. Of the
cheapest edits those whose initials are least in ASCII order count.

What has been read so far is one of four states (nothing, after system, after user, after assistant), so a row, and any
run of rows, is a step: for each state before it and each after it, the least cost, and for each state before it the order
of the states after it by their least edits. Edits end with a row's own letter, so no run's edits begin another's, and
that order is all that is needed to compose steps. Hirschberg's scheme works on a list of steps: forward four-state costs
up to the middle and backward ones from the end meet; of the states in which a cheapest way crosses the middle, the first in
the order of the forward edits is taken, and both halves are solved likewise, in memory linear in the list.

Conversations may be long, so the scheme runs on three levels:

1. All rows are sorted by conversation and turn (a range shuffle, so that a long conversation spans several tasks) and cut
   into pieces of `PIECE` rows or `PIECE_BYTES` bytes at most. A conversation within one piece is solved there and done.
2. For the pieces of other conversations, the first of each role and text comes from a partial aggregate of hashes; each
   piece becomes one step. Steps are composed in groups of `FAN`, groups likewise, until each conversation is one step;
   then the crossings are found from the top down.
3. Each piece is solved between its two states. Its part of the repaired conversation goes, in order, through one hash
   object for each conversation: SHA-256 can only be taken in order, so this one stage reads a long conversation in one
   task, as a stream.

Nulls in role, text or the damage's key count as one space; null turns come first; a null conv_id is a conversation.
Rows of one turn go by role, then text; a repeated row is a duplicate unless it is blank. An empty text is blank. All
conversations are returned, those without rows with zeros. Columns other than the four named are ignored, and an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage

PIECE = 2048
PIECE_BYTES = 1 << 20
FAN = 256
INF = 1 << 60

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: (state, initial) -> state
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ASKED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}

OK, BLANK, DUPLICATE, TRUNCATED = range(4)

Step = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]
"""Costs and ranks: cost[before][after], rank[before][after] (lower is less; only states that can be reached count)."""


# --- damage and faults ---


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the crc32 of `conv_id:turn` asks for; null role and text are a space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    held = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20)).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return held.where("_k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("col")


def _own_fault(text: str) -> int:
    last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
    return OK if last and last in ".!?" else TRUNCATED if last else BLANK


# --- steps ---


@lru_cache(maxsize=64)
def row_step(initial: str, fault: int) -> tuple[Step, dict[tuple[int, int], str]]:
    """The step of one row with the inserts before it, and its least edits between two states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        at, spent, done = before, 0, ""
        for _ in range(4):
            ways = [(at, DELETE, "D")]
            if fault in (OK, TRUNCATED):
                extra = int(fault == TRUNCATED)
                ways.append((ASKED[at], REROLE + extra, "R"))
                if (at, initial) in NEXT:
                    ways.append((NEXT[at, initial], KEEP + extra, "K"))
            for after, cost, letter in ways:
                way = (spent + cost, done + letter)
                best[before, after] = min(best.get((before, after), way), way)
            at, spent, done = ASKED[at], spent + INSERT, done + "I"
    return _as_step({k: (c, e) for k, (c, e) in best.items()}), {k: e for k, (_, e) in best.items()}


def _as_step(best: dict[tuple[int, int], tuple[int, object]]) -> Step:
    cost, rank = [], []
    for before in range(4):
        own = [best.get((before, after)) for after in range(4)]
        order = sorted(x[1] for x in own if x)
        cost.append(tuple(x[0] if x else INF for x in own))
        rank.append(tuple(order.index(x[1]) if x else 4 for x in own))
    return tuple(cost), tuple(rank)


#: What ends a conversation: the inserts that its last state asks for. All end in one state.
ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
END: Step = (tuple((INF, INF, INF, len(ENDING[s]) * INSERT) for s in range(4)), ((4, 4, 4, 0),) * 4)


def forward(line: tuple[tuple[int, ...], tuple[int, ...]], step: Step) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Costs and order of the four states after a step, from those before it."""
    (cost, rank), (by, order) = line, step
    best = {}
    for after in range(4):
        ways = [(cost[s] + by[s][after], (rank[s], order[s][after])) for s in range(4) if cost[s] < INF and by[s][after] < INF]
        if ways:
            best[after] = min(ways)
    keys = sorted(k for _, k in best.values())
    return tuple(best[s][0] if s in best else INF for s in range(4)), tuple(keys.index(best[s][1]) if s in best else 4 for s in range(4))


def _lowered(line: tuple[tuple[int, ...], tuple[int, ...]]) -> tuple[int, tuple[tuple[int, ...], tuple[int, ...]]]:
    low = min(line[0])
    return low, (tuple(c - low if c < INF else INF for c in line[0]), line[1])


@lru_cache(maxsize=1 << 16)
def _known_forward(line: tuple[tuple[int, ...], tuple[int, ...]], step: Step) -> tuple[int, tuple[tuple[int, ...], tuple[int, ...]]]:
    return _lowered(forward(line, step))


def _backward(cost: tuple[int, ...], step: Step) -> tuple[int, tuple[int, ...]]:
    out = [min((by + c for by, c in zip(step[0][s], cost, strict=True) if by < INF and c < INF), default=INF) for s in range(4)]
    low = min(out)
    return low, tuple(c - low if c < INF else INF for c in out)


_known_backward = lru_cache(maxsize=1 << 16)(_backward)


def begins(state: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    return tuple(0 if s == state else INF for s in range(4)), tuple(0 if s == state else 4 for s in range(4))


def compose(steps: list[Step]) -> Step:
    """One step for a run of steps."""
    cost, rank = [], []
    for state in range(4):
        spent, line = 0, begins(state)
        for step in steps:
            low, line = _known_forward(line, step)
            spent += low
        cost.append(tuple(c + spent if c < INF else INF for c in line[0]))
        rank.append(line[1])
    return tuple(cost), tuple(rank)


def crossings(steps: list[Step], start: int, end: int) -> list[int]:
    """The state before each step and after the last on the cheapest way from `start` to `end` with the least edits."""
    states = [start] * (len(steps) + 1)
    states[-1] = end
    todo = [(0, len(steps))] if len(steps) > 1 else []
    while todo:
        lo, hi = todo.pop()
        mid = (lo + hi) // 2
        line = begins(states[lo])
        for step in steps[lo:mid]:
            _, line = _known_forward(line, step)
        back = begins(states[hi])[0]
        for step in reversed(steps[mid:hi]):
            _, back = _known_backward(back, step)
        states[mid] = min((line[0][s] + back[s], line[1][s], s) for s in range(4))[2]
        todo += [(a, b) for a, b in ((lo, mid), (mid, hi)) if b - a > 1]
    return states


# --- a piece ---


class Piece:
    """Neighbouring rows of a conversation in order."""

    def __init__(self, turns: list, roles: list[str], texts: list[str]):
        self.turns, self.roles, self.texts = turns, roles, texts
        self.faults = [_own_fault(t) for t in texts]
        self.hashes = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for r, t in zip(roles, texts, strict=True)]

    def mark(self, first: set[int] | None = None) -> None:
        """Sets the duplicates: rows that are not the first of their role and text (`first`: places of those that are)."""
        seen: set[bytes] = set()
        for i, h in enumerate(self.hashes):
            again = h in seen if first is None else i not in first
            if again and self.faults[i] != BLANK:
                self.faults[i] = DUPLICATE
            seen.add(h)

    def steps(self) -> list[tuple[Step, dict[tuple[int, int], str]]]:
        return [row_step(r[:1], f) for r, f in zip(self.roles, self.faults, strict=True)]

    def counts(self) -> dict[str, int]:
        pairs = zip(self.roles, self.roles[1:], strict=False)
        turns = [t for t in self.turns if t is not None]
        out = {k: self.faults.count(f) for k, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
        return out | {"illegal": sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in pairs), "turns": len(set(turns))}

    def repaired(self, states: list[int], edits: list[str]) -> tuple[str, Iterator[str]]:
        """The edits of all rows, and the rows that they leave, as role:text."""

        def lines() -> Iterator[str]:
            for k, (role, text) in enumerate(zip(self.roles, self.texts, strict=True)):
                at = states[k]
                for letter in edits[k]:
                    if letter == "I":
                        at = ASKED[at]
                        yield f"{ROLES[at]}:"
                    elif letter == "R":
                        yield f"{ROLES[ASKED[at]]}:{text}"
                    elif letter == "K":
                        yield f"{role}:{text}"

        return "".join(edits), lines()


def _closing(state: int) -> list[str]:
    out = []
    for _ in ENDING[state]:
        state = ASKED[state]
        out.append(f"{ROLES[state]}:")
    return out


def _gaps(low, high, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


@lru_cache(maxsize=1 << 16)
def _solved(kinds: tuple[tuple[str, int], ...]) -> tuple[int, list[int], list[str]]:
    """Cost, states and edits of a whole conversation of these initials and faults."""
    steps = [row_step(*k) for k in kinds]
    whole = [*(s for s, _ in steps), END]
    states = crossings(whole, START, ASSISTANT)
    cost = sum(s[0][a][b] for s, a, b in zip(whole, states, states[1:], strict=False))
    return cost, states, [e[a, b] for (_, e), a, b in zip(steps, states, states[1:], strict=False)]


def whole(piece: Piece) -> dict[str, object]:
    """The result of a conversation that is one piece."""
    piece.mark()
    kinds = tuple((r[:1], f) for r, f in zip(piece.roles, piece.faults, strict=True))
    cost, states, edits = _solved(kinds) if len(kinds) <= 16 else _solved.__wrapped__(kinds)
    audit, lines = piece.repaired(states, edits)
    counts, turns = piece.counts(), [t for t in piece.turns if t is not None]
    sha = hashlib.sha256("\n".join([*lines, *_closing(states[-2])]).encode()).hexdigest()
    return {k: counts[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": _gaps(min(turns, default=None), max(turns, default=None), counts["turns"]), "cost": cost, "audit": audit + ENDING[states[-2]], "repaired_sha256": sha}


# --- conversations as DataFrames ---

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[object, int, bool, bool, Piece]]:
    """conv_id, number, whether it is the task's first and last of its conversation, and the piece, from sorted rows."""
    held: list[tuple] = []
    size, number, here = 0, 0, object()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)

    for row in rows():
        new = row[0] != here
        if held and (new or len(held) >= most or size + len(row[3]) > PIECE_BYTES):
            yield here, number, number == 0, new, Piece(*map(list, list(zip(*held, strict=True))[1:]))
            number, held, size = (0 if new else number + 1), [], 0
        number = 0 if new else number
        here = row[0]
        held.append(row)
        size += len(row[3])
    if held:
        yield here, number, number == 0, True, Piece(*map(list, list(zip(*held, strict=True))[1:]))


def repair(rows: DataFrame, parts: int | None = None, most: int = PIECE) -> DataFrame:
    """conv_id and the columns of RESULT for each conversation of rows (conv_id, turn, role, text), no null role or text; pieces of `most` rows."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    held = rows.select("conv_id", "turn", "role", "text")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = held.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = f"conv_id {kind}, task int, number int, {RESULT}, turns array<{turn}>, roles array<string>, texts array<string>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        # whether a task's first and last conversation go on in its neighbours isn't known here, so these two stay open
        waiting, first, out = None, True, []
        for conv, number, begins_, ends, piece in _pieces(batches, most):
            if waiting is not None:
                out.append({"conv_id": waiting[0], **whole(waiting[1])})
                waiting = None
            if begins_ and ends and not first:
                waiting = (conv, piece, number)
            else:
                out.append(_raw(conv, task, number, piece))
            first = first and not ends
            if len(out) >= 512 or (out and "roles" in out[-1]):
                yield _batch(out, shape)
                out = []
        if waiting is not None:
            out.append(_raw(waiting[0], task, waiting[2], waiting[1]))
        if out:
            yield _batch(out, shape)

    shape = to_arrow_schema(spark.createDataFrame([], schema).schema)
    first = cut_lineage(ranged.mapInArrow(cut, schema))
    done = first.where(F.col("roles").isNull()).select("conv_id", *(c.split()[0] for c in RESULT.split(", ")))
    return done.unionByName(_long(first.where(F.col("roles").isNotNull()).select("conv_id", "task", "number", "turns", "roles", "texts")))


def _raw(conv: object, task: int, number: int, piece: Piece) -> dict[str, object]:
    return {"conv_id": conv, "task": task, "number": number, "turns": piece.turns, "roles": piece.roles, "texts": piece.texts}


def _batch(rows: list[dict[str, object]], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in shape], schema=shape)


def _long(pieces: DataFrame) -> DataFrame:
    """The results of conversations whose rows are in several pieces (or at the edge of a task)."""
    kind, turn = (pieces.schema[c].dataType for c in ("conv_id", "turns"))
    turn = turn.elementType
    key = ["conv_id", "task", "number"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, task, number, turns, roles, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = Piece(turns, roles, texts).hashes
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([conv] * n, batch.schema.field(0).type), pa.array([task] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(hashes, pa.binary())], [*key, "place", "hash"])

    each = pieces.mapInArrow(listed, f"conv_id {kind.simpleString()}, task int, number int, place int, hash binary")
    firsts = each.groupBy("conv_id", "hash").agg(F.min(F.struct("task", "number", "place")).alias("at")).groupBy("conv_id", "at.task", "at.number").agg(F.collect_list("at.place").alias("firsts"))  # a piece's rows at most
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.task") == F.col(f"{b}.task")) & (F.col(f"{a}.number") == F.col(f"{b}.number"))
    told = pieces.alias("p").join(firsts.alias("f"), same("p", "f"), "left").select("p.*", F.coalesce("f.firsts", F.array().cast("array<int>")).alias("firsts"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, task, number, turns, roles, texts, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece = Piece(turns, roles, texts)
                piece.mark(set(firsts))
                real = [t for t in turns if t is not None]
                out.append({"conv_id": conv, "task": task, "number": number, **piece.counts(), "low": min(real, default=None), "high": max(real, default=None), "opens": roles[0][:1], "closes": roles[-1][:1], "step": _flat(compose([s for s, _ in piece.steps()]))})
            if out:
                yield _batch(out, sums)

    of_step = f"conv_id {kind.simpleString()}, task int, number int, blank long, duplicate long, truncated long, illegal long, turns long, low {turn.simpleString()}, high {turn.simpleString()}, opens string, closes string, step array<long>"
    sums = to_arrow_schema(pieces.sparkSession.createDataFrame([], of_step).schema)
    each = told.mapInArrow(summed, of_step)
    # a place for each piece, by its task's first: a window over a conversation's tasks, not over its pieces
    each = cut_lineage(each)
    tasks = each.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"))
    tasks = tasks.select("conv_id", "task", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("task")) - F.col("n")).alias("from"))
    at_task = F.col("p.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("p.task") == F.col("t.task"))
    steps = cut_lineage(each.alias("p").join(tasks.alias("t"), at_task).select("p.*", (F.col("t.from") + F.col("p.number")).cast("int").alias("nth")))
    # counts: what neighbours share is taken off
    last = steps.select("conv_id", (F.col("nth") + 1).alias("nth"), F.col("closes").alias("c"), F.col("high").alias("h"))
    beside = F.col("p.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("p.nth") == F.col("b.nth"))
    legal = F.concat("b.c", "p.opens").isin("su", "ua", "au")
    edges = steps.alias("p").join(last.alias("b"), beside, "left").select("p.conv_id", "p.blank", "p.duplicate", "p.truncated", (F.col("p.illegal") + F.when(F.col("b.c").isNotNull() & ~legal, 1).otherwise(0)).alias("illegal"), (F.col("p.turns") - F.when(F.col("b.h") == F.col("p.low"), 1).otherwise(0)).alias("turns"), "p.low", "p.high")
    sum_ = lambda c: F.sum(c).alias(c)
    totals = edges.groupBy("conv_id").agg(*map(sum_, ("blank", "duplicate", "truncated", "illegal", "turns")), F.min("low").alias("low"), F.max("high").alias("high"))
    totals = totals.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal")
    ways, ends = _ways(steps.select("conv_id", "nth", "task", "number", "step"))
    solved = told.alias("p").join(ways.alias("w"), same("p", "w")).select("p.*", "w.nth", "w.before", "w.after", "w.last")

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, _, _, turns, roles, texts, firsts, nth, start, end, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece = Piece(turns, roles, texts)
                piece.mark(set(firsts))
                steps = piece.steps()
                states = crossings([s for s, _ in steps], start, end)
                audit, lines = piece.repaired(states, [e[a, b] for (_, e), a, b in zip(steps, states, states[1:], strict=False)])
                text = [*lines, *(_closing(end) if last else [])]
                yield pa.RecordBatch.from_arrays([pa.array([conv], batch.schema.field(0).type), pa.array([nth], pa.int32()), pa.array([audit + (ENDING[end] if last else "")]), pa.array([len(text)], pa.int32()), pa.array(["\n".join(text).encode()], pa.binary())], ["conv_id", "nth", "audit", "lines", "bytes"])

    repaired = cut_lineage(solved.mapInArrow(mended, f"conv_id {kind.simpleString()}, nth int, audit string, lines int, bytes binary"))

    key_type = to_arrow_schema(pieces.select("conv_id").schema).field(0).type

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for conv, own in groupby(rows, lambda r: r[0]):
            sha, any_ = hashlib.sha256(), False
            for _, _, lines, data in own:
                if lines:
                    sha.update(b"\n" + data if any_ else data)
                    any_ = True
            yield pa.RecordBatch.from_arrays([pa.array([conv], key_type), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    hashes = repaired.select("conv_id", "nth", "lines", "bytes").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "nth").mapInArrow(hashed, f"conv_id {kind.simpleString()}, repaired_sha256 string")
    audits = repaired.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "audit"))), lambda x: x["audit"]), "").alias("audit"))  # one letter a row: the result itself
    match = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    out = totals.alias("t").join(ends.alias("e"), match("t", "e")).join(audits.alias("a"), match("t", "a")).join(hashes.alias("h"), match("t", "h"))
    return out.select("t.conv_id", *(f"t.{c}" for c in _COUNTS[:-1]), "e.cost", "a.audit", "h.repaired_sha256")


def _flat(step: Step) -> list[int]:
    return [v for table in step for row in table for v in row]


def _step(flat: list[int]) -> Step:
    rows = [tuple(flat[i : i + 4]) for i in range(0, 32, 4)]
    return tuple(rows[:4]), tuple(rows[4:])


def _ways(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each piece with the states before and after it and whether it is its conversation's last; and each conversation's cost. steps: conv_id, nth (from 0), task, number, step."""
    kind = steps.schema["conv_id"].dataType.simpleString()
    level, levels = steps, [steps]
    while (level.agg(F.max("nth")).first()[0] or 0) > 0:

        def composed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by("nth")
            step = compose([_step(s) for s in table["step"].to_pylist()])
            return pa.table([pa.array([key[0].as_py()], table.schema.field("conv_id").type), pa.array([key[1].as_py()], pa.int32()), pa.array([_flat(step)], pa.list_(pa.int64()))], names=["conv_id", "nth", "step"])

        up = level.groupBy("conv_id", F.floor(F.col("nth") / FAN).cast("int").alias("up")).applyInArrow(composed, f"conv_id {kind}, nth int, step array<long>")
        level = cut_lineage(up)
        levels.append(level)
    total = lambda s, end: s[0][START][end] + len(ENDING[end]) * INSERT

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, _step(s)) for conv, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            ends = [min(range(4), key=lambda e: (total(s, e), s[1][START][e])) for _, s in rows]
            costs = [total(s, e) for (_, s), e in zip(rows, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([START] * len(rows), pa.int32()), pa.array(ends, pa.int32()), pa.array(costs, pa.int64())], ["conv_id", "before", "after", "cost"])

    top = cut_lineage(level.select("conv_id", "step").mapInArrow(ended, f"conv_id {kind}, before int, after int, cost long"))
    known = top.select("conv_id", F.lit(0).alias("nth"), "before", "after", F.lit(True).alias("last"))
    for level in reversed(levels[:-1]):
        extra = [c for c in ("task", "number") if c in level.columns]

        def crossed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by("nth")
            start, end, last = (table[c][0].as_py() for c in ("before", "after", "last"))
            states = crossings([_step(s) for s in table["step"].to_pylist()], start, end)
            n = len(table)
            own = [table[c].combine_chunks() for c in ("conv_id", "nth", *extra)]
            return pa.table([*own, pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()), pa.array([False] * (n - 1) + [last])], names=["conv_id", "nth", *extra, "before", "after", "last"])

        here = level.withColumn("up", F.floor(F.col("nth") / FAN).cast("int")).alias("l")
        both = here.join(known.alias("k"), F.col("l.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("l.up") == F.col("k.nth"))).select("l.*", "k.before", "k.after", "k.last")
        known = cut_lineage(both.groupBy("conv_id", "up").applyInArrow(crossed, f"conv_id {kind}, nth int, {''.join(f'{c} int, ' for c in extra)}before int, after int, last boolean"))
    if len(levels) == 1:  # each conversation has one piece
        known = level.alias("l").join(known.alias("k"), F.col("l.conv_id").eqNullSafe(F.col("k.conv_id"))).select("l.conv_id", "l.nth", "l.task", "l.number", "k.before", "k.after", "k.last")
    return known, top.select("conv_id", "cost")


def structure(conversations: DataFrame, most: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation, damaged and repaired."""
    done = repair(damaged(conversations.select("conv_id", "turn", "role", "text")), most=most)
    every = conversations.select("conv_id").distinct()
    out = every.alias("c").join(done.alias("d"), F.col("c.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    zero = [F.coalesce(F.col(f"d.{c}"), F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    return out.select("c.conv_id", *zero, F.coalesce("d.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
