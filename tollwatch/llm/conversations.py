"""Repair of the turn structure of conversations at the least cost.

A conversation is to read as one optional system message and then pairs of a
user's and an assistant's message. Rows are kept, given another role or deleted,
and empty messages are inserted; among the cheapest ways the one whose initials
come first as text (the audit) is taken. Where a conversation stands is one of
four states: nothing yet, after system, after user, after assistant.

The edits come from divide and conquer in linear space: costs to reach each
state from the front and costs to finish from the back meet in the middle, where
the crossing is chosen that is cheapest and, among those, has the least audit;
each half is then solved between known states. A crossing needs no audits, only
their order: two audits up to one row are told apart by where they came from or,
from one state, by what the last row adds. Long conversations are cut into
segments with one small table of costs and orders each. Tables are combined in
order, which gives each segment its states, and segments are solved apart.
"""

import functools
import hashlib

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tollwatch.session import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Who speaks next in each state, where that is a user or an assistant.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: Kinds of a row: its role's initial, and its fault. The end is a row of its own.
INITIALS = "sua"
FINE, TRUNCATED, GONE = range(3)
END = 12
#: Rows and characters of a segment; a single longer row is a segment of its own.
SEGMENT_ROWS = 4096
SEGMENT_CHARS = 1 << 20


def _kind(initial, fault):
    return (INITIALS.find(initial) if initial and initial in INITIALS else 3) * 3 + fault


def _moves(kind):
    """Per state before and after a row of a kind: cost, and initials of inserts and edit."""
    best = [[(FAR, "")] * 4 for _ in STATES]
    for s in STATES:
        state = s
        for inserts in range(3):
            ends = []
            if kind == END:
                ends = [(START, 0, "")] if state in (START, ASSISTANT) else []
            else:
                role, fault = divmod(kind, 3)
                ends = [(state, DELETE_COST, DELETE)]
                if fault != GONE:
                    more = TRUNCATED_COST if fault == TRUNCATED else 0
                    ends.append((NEXT[state], REROLE_COST + more, REROLE))
                    if role == 0 and state == START:
                        ends.append((SYSTEM, KEEP_COST + more, KEEP))
                    if role in (USER - 1, ASSISTANT - 1) and NEXT[state] == role + 1:
                        ends.append((NEXT[state], KEEP_COST + more, KEEP))
            for t, cost, edit in ends:
                best[s][t] = min(best[s][t], (cost + INSERT_COST * inserts, INSERT * inserts + edit))
            state = NEXT[state]
    return best


MOVES = [_moves(kind) for kind in range(END + 1)]


def _ranked(found):
    """Costs, and the order of the audits, of four (cost, order key) or None."""
    keys = sorted({k for c, k in found if c < FAR})
    place = {k: i for i, k in enumerate(keys)}
    return [c for c, _ in found], [place.get(k, 9) for _, k in found]


def forward(kinds, costs, order):
    """Least costs to be in each state behind some rows, and the order of their audits."""
    for kind in kinds:
        moves = MOVES[kind]
        found = []
        for t in STATES:
            best = min(((costs[s] + moves[s][t][0], (order[s], moves[s][t][1])) for s in STATES))
            found.append(best if best[0] < FAR else (FAR, ()))
        costs, order = _ranked(found)
    return costs, order


def backward(kinds, target):
    """Least costs from each state in front of some rows to the state ``target`` behind them."""
    costs = [0 if s == target else FAR for s in STATES]
    for kind in reversed(kinds):
        moves = MOVES[kind]
        costs = [min(moves[s][t][0] + costs[t] for t in STATES) for s in STATES]
    return costs


def _from(state):
    return [0 if s == state else FAR for s in STATES], [0 if s == state else 9 for s in STATES]


def crossing(kinds, start, target):
    """Initials of the edits of each row (inserts in front first), by crossings in the middle."""
    if len(kinds) == 1:
        return [MOVES[kinds[0]][start][target][1]]
    half = len(kinds) // 2
    costs, order = forward(kinds[:half], *_from(start))
    rest = backward(kinds[half:], target)
    state = min((c + r, o, s) for s, (c, o, r) in enumerate(zip(costs, order, rest, strict=True)))[2]
    return crossing(kinds[:half], start, state) + crossing(kinds[half:], state, target)


_short = functools.lru_cache(1 << 14)(crossing)


def edits(kinds, start, target):
    return _short(kinds, start, target) if len(kinds) <= 32 else crossing(kinds, start, target)


def table(kinds):
    """Costs and orders of audits from each state to each over some rows, as 32 numbers."""
    found = [forward(kinds, *_from(s)) for s in STATES]
    return [x for costs, order in found for x in (*costs, *order)]


def states(tables):
    """State in front of each segment, and the cost of all, from the tables in order."""
    costs, order = _from(START)
    came = []
    for flat in [*tables, table(bytes([END]))]:
        found, sources = [], []
        for t in STATES:
            best = min((costs[s] + flat[8 * s + t], (order[s], flat[8 * s + 4 + t]), s) for s in STATES)
            found.append(best[:2] if best[0] < FAR else (FAR, ()))
            sources.append(best[2])
        costs, order = _ranked(found)
        came.append(sources)
    state, out = START, []
    for sources in reversed(came):
        state = sources[state]
        out.append(state)
    return out[::-1], costs[START]


def _apply(initials, state, rows):
    """Messages (role, text) that the edits leave of some rows."""
    out = []
    for edit, (role, text) in zip(initials, rows, strict=True):
        for step in edit:
            if step == DELETE:
                continue
            if step == KEEP:
                state = SYSTEM if role[:1] == "s" else NEXT[state]
                out.append((role, text))
            else:
                state = NEXT[state]
                out.append((ROLES[state], text if step == REROLE else ""))
    return out


def _cost(kinds, initials):
    cost = {KEEP: KEEP_COST, REROLE: REROLE_COST, DELETE: DELETE_COST, INSERT: INSERT_COST}
    return sum(sum(map(cost.get, edit)) + TRUNCATED_COST * (
        kind < END and kind % 3 == TRUNCATED and edit[-1] != DELETE)
        for kind, edit in zip(kinds, initials, strict=True))


def _digest(messages):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()


COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns")
TOTALS = ", ".join(f"{c} long" for c in (*COUNTS, "first_turn", "last_turn"))
MESSAGES = "messages array<struct<role: string, text: string>>"
FOUND = ("conv {0}, segment long, whole boolean, audit string, cost long, sha256 string, " + MESSAGES
         + ", " + TOTALS + ", first_initial string, last_initial string, tables array<long>,"
         " kinds binary")
MET = "conv {0}, segment long, start int, target int, last boolean, cost long, " + TOTALS
SOLVED = "conv {0}, segment long, audit string, " + MESSAGES
JOINED = "conv {0}, audit string, sha256 string"


class _Segment:
    """Rows of one conversation as they come: their kinds, counts and messages."""

    def __init__(self, conv, last=None):
        self.conv, self.kinds, self.rows, self.chars = conv, bytearray(), [], 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn, role, text, fault, counted):
        c = self.counts
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            c["illegal"] += 1
        self.last = initial
        if turn is not None:
            if self.last_turn != turn:
                c["turns"] += 1
                self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        c["n_rows"] += 1
        if counted:
            c[counted] += 1
        self.kinds.append(_kind(initial, fault))
        self.rows.append((role, "" if fault == GONE else text))
        self.chars += len(text)

    def full(self):
        return len(self.rows) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS

    def row(self, number, whole, digest):
        out = {"conv": self.conv, "segment": number, "whole": whole, **self.counts,
               "first_turn": self.first_turn, "last_turn": self.last_turn,
               "first_initial": self.first, "last_initial": self.last}
        if whole:
            kinds = bytes(self.kinds) + bytes([END])
            found = edits(kinds, START, START)
            messages = _apply(found, START, [*self.rows, ("", "")])
            out["audit"], out["cost"] = "".join(found), _cost(kinds, found)
            out["sha256" if digest else "messages"] = _digest(messages) if digest else [
                {"role": r, "text": t} for r, t in messages]
        else:
            out["tables"], out["kinds"] = table(self.kinds), bytes(self.kinds)
            out["messages"] = [{"role": r, "text": t} for r, t in self.rows]
        return out


def _faults(first, blank, truncated):
    if blank:
        return GONE, "blank"
    if not first:
        return GONE, "duplicate"
    return (TRUNCATED, "truncated") if truncated else (FINE, None)


def _segments(digest, schema):
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, cut, first, out = None, False, True, []

        def close(whole):
            nonlocal number
            out.append(held.row(number, whole, digest))
            number += 1

        for batch in batches:
            # few rows at a time, so that memory follows the segments and not the batch
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                for conv, turn, role, text, n, new, blank, truncated in zip(
                        *(part.column(k).to_pylist() for k in range(8)), strict=True):
                    if held is None or conv != held.conv:
                        if held is not None:
                            close(not (cut or first))
                            first = False
                        held, cut = _Segment(conv), False
                    for copy in range(n):
                        if held.full():
                            close(False)
                            held, cut = _Segment(conv), True
                        held.add(turn, role, text, *_faults(new and copy == 0, blank, truncated))
                if out:
                    yield _batch(out, schema)
                    out.clear()
        if held is not None:
            close(False)
            yield _batch(out, schema)
    return run


def _batch(rows, schema):
    return pa.RecordBatch.from_pylist(rows, schema)


def _solved(schema):
    """Edits and messages of segments whose states are known; the last one has the end too."""
    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                kinds = bytes(row["kinds"]) + (bytes([END]) if row["last"] else b"")
                rows = [(m["role"], m["text"]) for m in row["messages"]]
                found = edits(kinds, row["start"], row["target"])
                rows += [("", "")] * (len(kinds) - len(rows))
                messages = _apply(found, row["start"], rows)
                yield _batch([{"conv": row["conv"], "segment": row["segment"],
                               "audit": "".join(found),
                               "messages": [{"role": r, "text": t} for r, t in messages]}], schema)
    return run


def _meet(schema):
    """States of the segments of each conversation, from their tables in order."""
    def run(batches):
        held = []

        def close():
            start, cost = states([r["tables"] for r in held])
            total = {c: sum(r[c] for r in held) for c in COUNTS}
            for a, b in zip(held, held[1:]):
                total["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
                total["illegal"] += a["last_initial"] + b["first_initial"] not in ("su", "ua", "au")
            turns = [r[k] for r in held for k in ("first_turn", "last_turn") if r[k] is not None]
            out = []
            for k, row in enumerate(held):
                last = k == len(held) - 1
                out.append({"conv": row["conv"], "segment": row["segment"], "start": start[k],
                            "target": START if last else start[k + 1], "last": last, "cost": cost,
                            **total, "first_turn": min(turns, default=None),
                            "last_turn": max(turns, default=None)})
            return _batch(out, schema)

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv"] != held[0]["conv"]:
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()
    return run


def _joined(schema):
    """Audit and digest of each conversation over its segments, one segment at a time."""
    def run(batches):
        conv, audit, sha, some = None, None, None, False
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if audit is None or row["conv"] != conv:
                    if audit is not None:
                        yield _batch([{"conv": conv, "audit": "".join(audit),
                                       "sha256": sha.hexdigest()}], schema)
                    conv, audit, sha, some = row["conv"], [], hashlib.sha256(), False
                audit.append(row["audit"])
                if row["messages"]:
                    text = "\n".join(f"{m['role']}:{m['text']}" for m in row["messages"])
                    sha.update((("\n" if some else "") + text).encode())
                    some = True
        if audit is not None:
            yield _batch([{"conv": conv, "audit": "".join(audit), "sha256": sha.hexdigest()}], schema)
    return run


def _ordered(rows, conv_id, turn, role, text):
    """One row for all that are equal in conversation, turn, role and text, with their faults."""
    base = rows.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    at = F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))
    first = base.groupBy("conv", "role", "key").agg(F.min(at).alias("at")).select(
        "conv", F.col("at.turn").alias("turn"), "role", "key", F.lit(None).cast("string").alias("text"),
        F.lit(0).alias("n"), F.lit(True).alias("new"))
    every = base.select("conv", "turn", "role", "key", "text", F.lit(1).alias("n"),
                        F.lit(False).alias("new")).union(first)
    one = every.groupBy("conv", "turn", "role", "key").agg(
        F.max("text").alias("text"), F.sum("n").alias("n"), F.max("new").alias("new"))
    bare = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    blank = bare == ""
    return one.select(
        "conv", "turn", "role", "key", F.when(F.col("new") & ~blank, F.col("text")).otherwise("")
        .alias("text"), "n", "new", blank.alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))


def _repaired(rows, digest, conv_id, turn, role, text):
    """Conversations inside one segment, and segments, states and edits of the others."""
    kind = dict(rows.dtypes)[conv_id]

    def shape(columns):
        columns = columns.format(kind)
        return columns, to_arrow_schema(StructType.fromDDL(columns))

    order = ["conv", "turn", "role", "key"]
    found, schema = shape(FOUND)
    found = written(
        _ordered(rows, conv_id, turn, role, text).repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", "turn", "role", "text", "n", "new", "blank", "truncated")
        .mapInArrow(_segments(digest, schema), found), "conversations")
    cut = found.where("not whole")
    met, schema = shape(MET)
    met = cut.select("conv", "segment", "tables", *COUNTS, "first_turn", "last_turn", "first_initial",
                     "last_initial").repartition("conv").sortWithinPartitions("conv", "segment") \
        .mapInArrow(_meet(schema), met)
    solved, schema = shape(SOLVED)
    solved = cut.select("conv", "segment", "kinds", "messages").join(
        met.select("segment", "start", "target", "last"), "segment").select(
        "conv", "segment", "kinds", "messages", "start", "target", "last").mapInArrow(
        _solved(schema), solved)
    joined, schema = shape(JOINED)
    joined = solved.repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(
        _joined(schema), joined)
    return found.where("whole"), met, solved, joined


def repair_conversations(rows, conv_id="conv_id", turn="turn", role="role", text="text"):
    """Repaired messages: conv_id, segment, audit and messages (role, text) of each segment.

    Most conversations are one row. Long ones, and those that lie across two
    tasks, are several, to be read in order of ``segment``; so no row and no
    task holds a conversation of unknown length. Rows go by turn, those without
    one first, those of one turn by role and digest of the text. Faults and
    edits are those of ``summarize_repairs``. A conversation of which nothing
    is left has no messages. An empty table gives an empty one.
    """
    whole, _, solved, _ = _repaired(rows, False, conv_id, turn, role, text)
    columns = [F.col("conv").alias(conv_id), "segment", "audit", "messages"]
    return whole.select(*columns).union(solved.select(*columns))


def summarize_repairs(rows, conv_id="conv_id", turn="turn", role="role", text="text"):
    """One row per conversation: what is wrong with it, and its cheapest repair.

    ``gaps`` counts the turns missing between the least and the greatest, rows
    without a turn left out. The first fault of a row counts: ``blank`` (a null
    or empty text, or white space), ``duplicate`` (role and text of an earlier
    row, so repeated rows too) or ``truncated`` (no ``.``, ``!`` or ``?`` at the
    end). ``illegal`` counts neighbours whose roles do not follow each other.
    ``cost`` and ``audit`` are of the cheapest edits, ties by the least audit,
    ``repaired_sha256`` of the repaired ``role:text`` lines. A null role is
    empty, it and other roles can only be changed or deleted. Rows without a
    conversation id are one conversation. Long conversations are solved segment
    by segment; their digest alone is one stream over their segments, of which
    its task holds one at a time. Columns not named are not looked at.
    """
    whole, met, _, joined = _repaired(rows, True, conv_id, turn, role, text)
    totals = ["conv", *COUNTS, "first_turn", "last_turn", "cost"]
    last = met.where("last").select(*totals)
    cut = last.join(joined.withColumnRenamed("conv", "own"), F.col("conv").eqNullSafe(F.col("own")))
    every = whole.select(*totals, "audit", "sha256").union(cut.select(*totals, "audit", "sha256"))
    gaps = F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")
    return every.select(
        F.col("conv").alias(conv_id), F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), "blank",
        "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))
