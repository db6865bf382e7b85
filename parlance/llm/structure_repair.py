"""Cheapest repair of conversations whose turns don't alternate.

A repaired conversation says nothing, or an optional system turn and then user and
assistant turns in pairs.  Rows may be kept, given another role, deleted, and empty turns
inserted; of the cheapest repairs the one whose edits' initials are ASCII-least is taken.

The search is a shortest path over rows and four states (nothing yet, after the system
turn, after a user turn, after an assistant turn).  A step is a macro edit: a run of
inserts and then what happens to the row.  Written as letters, no macro edit is the
beginning of another, so two audits of as many rows compare as their lists of codes do.
A layer therefore keeps no audit strings, only each state's cost, the rank of its audit
among the layer's, and a pointer to its parent; the edits are read off the pointers.

Rows come sorted within a conversation, dealt by its id, and go by as a stream: as soon
as all states worth keeping go back to one row, the edits up to there are settled and
leave.  What a task holds of a conversation is the rows since then and one 16-byte
digest a row, to know what was said before.

Null roles and texts read as one space; so do null ids and turns where the damage's key
is made (the id stays null in the result, and null turns come first and have no gap).
Rows with one turn go by role and text.  Empty texts are blank.  Equal rows are duplicates
after the first.  An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import named

# What the edits cost, and what a truncated row costs that isn't deleted.
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED_COST = 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to, by the state before.
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL_PAIRS = {"su", "ua", "au"}
#: What it costs at most to do from one state what could be done from another: a state whose cost is further above another's is never on the best path.
BRIDGE = {
    (SYSTEM, NOTHING): 7, (USER, NOTHING): 5, (ASSISTANT, NOTHING): 3,
    (NOTHING, SYSTEM): 0, (USER, SYSTEM): 2, (ASSISTANT, SYSTEM): 0,
    (NOTHING, USER): 2, (SYSTEM, USER): 2, (ASSISTANT, USER): 2,
    (NOTHING, ASSISTANT): 0, (SYSTEM, ASSISTANT): 4, (USER, ASSISTANT): 2,
}
LONGEST_RUN, SETTLE_EVERY, BLOCK_ROWS, BLOCK_CHARS = 2, 64, 2048, 1 << 20
BLANK, LAST, END = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)"), frozenset(".!?")

EDITS = "place long, edit string, role string, text string, was_role string, turn long, fault string"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as a careless export leaves them; copies is 0 for dropped ones, 2 for repeated ones."""
    word = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).when(kind == 0, "").otherwise(word("text"))
    return rows.select(
        named("conv_id").alias("conv_id"), named("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """The same shape for rows that are taken as they are."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


def _after_insert(state: int) -> tuple[int, str]:
    return (ASSISTANT, "assistant") if state == USER else (USER, "user")


@cache
def macros(initial: str, must_go: bool) -> list[tuple[int, int, int, int, str]]:
    """(state before, code's rank, state after, cost, code) of every macro edit for a row of this initial."""
    found = []
    for begin in range(4):
        state, run = begin, ""
        for _ in range(LONGEST_RUN + 1):
            ends = {"D": state}
            if not must_go:
                ends |= {"K": STEPS.get(initial, {}).get(state), "R": _after_insert(state)[0]}
            found += [(begin, run + op, to, COST["I"] * len(run) + COST[op]) for op, to in ends.items() if to is not None]
            state, run = _after_insert(state)[0], run + "I"
    # the rank must be one order for rows of every kind
    codes = sorted("I" * n + op for n in range(LONGEST_RUN + 1) for op in "DKR")
    return [(begin, codes.index(code), to, cost, code) for begin, code, to, cost in found]


class _Conversation:
    """One conversation's search: rows in, settled edits out."""

    def __init__(self):
        self.best: dict[int, tuple[int, int]] = {NOTHING: (0, 0)}  # state: cost and rank of its audit
        self.layers: list[dict[int, tuple[int, str]]] = []  # state: parent and code
        self.rows: list[tuple] = []
        self.seen: set[bytes] = set()
        self.state, self.place = NOTHING, 0

    def fault(self, role: str, text: str) -> str | None:
        if not BLANK.search(text):
            return "blank"
        said = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if said in self.seen:
            return "duplicate"
        self.seen.add(said)
        return None if LAST.search(text)[0] in END else "truncated"

    def add(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        fault = self.fault(role, text)
        must_go = fault in ("blank", "duplicate")
        found: dict[int, tuple[int, int, int, int, str]] = {}
        for begin, code_rank, to, cost, code in macros(role[:1] if role[:1] in STEPS else "", must_go):
            if begin in self.best:
                so_far, rank = self.best[begin]
                total = so_far + cost + (TRUNCATED_COST if fault == "truncated" and code[-1] != "D" else 0)
                if to not in found or (total, rank, code_rank) < found[to][:3]:
                    found[to] = (total, rank, code_rank, begin, code)
        kept = {s: f for s, f in found.items() if not any(o != s and found[o][0] + BRIDGE[o, s] < f[0] for o in found)}
        order = sorted(kept, key=lambda s: kept[s][1:3])
        self.best = {s: (kept[s][0], order.index(s)) for s in kept}
        self.layers.append({s: (f[3], f[4]) for s, f in kept.items()})
        self.rows.append((turn, role, text, fault))
        if len(self.rows) % SETTLE_EVERY == 0:
            yield from self.settle()

    def settle(self) -> Iterator[tuple]:
        """Emit the edits that all states left have in common."""
        alive = set(self.best)
        for k in range(len(self.layers) - 1, -1, -1):
            if len(alive) == 1:
                yield from self.emit(self.codes(k + 1, next(iter(alive))))
                return
            alive = {self.layers[k][s][0] for s in alive}

    def codes(self, n: int, state: int) -> list[str]:
        """The codes of the first ``n`` layers on the way to ``state``."""
        out = []
        for layer in reversed(self.layers[:n]):
            state, code = layer[state]
            out.append(code)
        return out[::-1]

    def _insert(self) -> tuple:
        self.state, role = _after_insert(self.state)
        self.place += 1
        return (self.place - 1, "I", role, "", None, None, None)

    def emit(self, codes: list[str]) -> Iterator[tuple]:
        for code, (turn, role, text, fault) in zip(codes, self.rows):
            for _ in code[:-1]:
                yield self._insert()
            op, now = code[-1], role
            if op == "K":
                self.state = STEPS[role[:1]][self.state]
            elif op == "R":
                self.state, now = _after_insert(self.state)
            yield (self.place, op, None if op == "D" else now, None if op == "D" else text, role, turn, fault)
            self.place += 1
        del self.rows[: len(codes)], self.layers[: len(codes)]

    def finish(self) -> Iterator[tuple]:
        more = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        last = min(self.best, key=lambda s: (self.best[s][0] + COST["I"] * more[s], self.best[s][1]))
        yield from self.emit(self.codes(len(self.layers), last))
        for _ in range(more[last]):
            yield self._insert()
        if not self.place:
            yield (None,) * 7  # no row is left, but the conversation is known


def repair(rows: DataFrame) -> DataFrame:
    """Every edit of every conversation in order: what was done, to which row, with what fault, and the role and text it has now.

    ``rows`` is as ``damage`` or ``undamaged`` gives it.  A conversation of dropped rows
    alone has one line without an edit.  A conversation's lines lie together, in order.
    """
    kind = dict(rows.dtypes)["conv_id"]
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {kind}, {EDITS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names, id_type = ["conv_id", "place", "edit", "role", "text", "was_role", "turn", "fault"], None
        ready, chars = [], 0

        def block() -> pa.RecordBatch:
            columns = list(zip(*ready)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *types])], names=names)

        def edits() -> Iterator[tuple]:
            nonlocal id_type
            now, last = None, None
            for batch in batches:
                id_type = batch.column(0).type
                for conv, turn, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
                    if now is None or conv != last:
                        if now is not None:
                            yield from ((last, *e) for e in now.finish())
                        now, last = _Conversation(), conv
                    for _ in range(copies):
                        yield from ((last, *e) for e in now.add(turn, role, text))
            if now is not None:
                yield from ((last, *e) for e in now.finish())

        for e in edits():
            ready.append(e)
            chars += len(e[4] or "")
            if len(ready) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                yield block()
                ready, chars = [], 0
        if ready:
            yield block()

    return dealt.mapInArrow(run, schema)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edits: DataFrame) -> DataFrame:
    """One line for each conversation of ``repair``'s result, made as its lines go by."""
    kind = dict(edits.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lines, id_type, now = [x.strip().split(" ")[0] for x in f"conv_id x, {REPORT}".split(",")], [], None, None

        def done() -> tuple:
            turns = now["turns"]
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            return (now["id"], gaps, *(now[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(now["audit"]), now["sha"].hexdigest())

        for batch in batches:
            id_type = batch.column(0).type
            for conv, place, edit, role, text, was, turn, fault in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or conv != now["id"]:
                    if now is not None:
                        lines.append(done())
                    now = {"id": conv, "turns": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "first": True, "was": None}
                if edit is None:
                    continue
                now["audit"].append(edit)
                now["cost"] += COST[edit] + (TRUNCATED_COST if fault == "truncated" and edit != "D" else 0)
                if fault:
                    now[fault] += 1
                if was is not None:
                    now["illegal"] += now["was"] is not None and now["was"][:1] + was[:1] not in LEGAL_PAIRS
                    now["was"] = was
                if turn is not None:
                    low, high, n = now["turns"] or (turn, None, 0)
                    now["turns"] = (low, turn, n + (turn != high))
                if edit != "D":
                    now["sha"].update(("" if now["first"] else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    now["first"] = False
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), [id_type, *[pa.int64()] * 6, pa.string(), pa.string()])], names=names)
                lines = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), [id_type, *[pa.int64()] * 6, pa.string(), pa.string()])], names=names)

    return edits.mapInArrow(run, f"conv_id {kind}, {REPORT}")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Conversations damaged and repaired, one line each."""
    return report(repair(damage(conversations)))
