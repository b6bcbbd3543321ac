"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``.  That is an automaton of
four states, so the cheapest edits of a stretch of rows are a table: for each state before it and each
state after it, a cost and the place of its audit among the audits of equal cost.  A forward
vector of four costs from the beginning and a backward one from the end meet in the middle;
the crossing of least total cost whose audit is least is kept, and both halves are solved the
same way.  Only vectors of four entries live beside the audit itself, which is what is returned.

Audits of equal cost compare at the crossing alone: a crossing lies right behind a row, every audit
up to there holds one letter for each row, so none begins another, and the lesser
beginning decides.

A conversation may hold any share of the rows.  Narrow rows (no texts) are range-partitioned by
conversation and place, so a long one lies in many tasks; each reduces its stretch to a table, the
tables of the open stretches (two a task at most) are solved per conversation by the same recursion,
and each task then solves its stretch between the crossings found.  Texts move once, to be hashed in
order as they stream by: the digest of a conversation is sequential by definition, its memory is not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
NOT_SPACE = r"[^\x20\x09-\x0D]"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: States: nothing yet, behind a system row, behind a user row, behind an assistant row.
STATES, ACCEPTING = range(4), (0, 3)
#: The state that an inserted or re-roled row leads to: its role is the only one that fits.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE_OF = {1: "system", 2: "user", 3: "assistant"}
#: Where a kept row of each initial leads.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Codes of a row: its initial (capital: truncated), or X where it must go.
GONE, OTHER = "X", "o"

#: A table: for each state before, what each state after it costs, and its audit (or the audit's rank).
Table = tuple[dict[int, tuple[int, object]], ...]


@lru_cache(maxsize=None)
def row_table(code: str) -> Table:
    """The table of one row: insertions, then the row's own letter."""
    if code == GONE:
        return tuple({s: (COST[DELETE], DELETE)} for s in STATES)
    extra = TRUNCATED_COST if code.isupper() else 0
    table = []
    for s in STATES:
        # a row deleted behind an insertion would sort before it at the same cost: never least
        best, at = {s: (COST[DELETE], DELETE)}, s
        for k in range(3):
            moves = [(KEEP, KEPT[code.lower()][at])] if at in KEPT.get(code.lower(), ()) else []
            for letter, to in [*moves, (REROLE, NEXT[at])]:
                found = (k * COST[INSERT] + COST[letter] + extra, INSERT * k + letter)
                best[to] = min(best.get(to, found), found)
            at = NEXT[at]
        table.append(best)
    return tuple(table)


def end_table() -> Table:
    """Insertions that are left behind the last row."""
    def left(s: int) -> tuple[int, str]:
        k = 0
        while s not in ACCEPTING:
            s, k = NEXT[s], k + 1
        return k * COST[INSERT], INSERT * k

    return tuple({0: left(s)} for s in STATES)


Vector = dict[int, tuple[int, int]]


def forward(vector: Vector, table: Table) -> Vector:
    """Cost and rank of the least audit at each state behind one more element."""
    best: dict[int, tuple] = {}
    for s, (cost, rank) in vector.items():
        for to, (more, suffix) in table[s].items():
            found = (cost + more, rank, suffix)
            if to not in best or found < best[to]:
                best[to] = found
    order = sorted(best, key=lambda to: best[to][1:])
    return {to: (best[to][0], place) for place, to in enumerate(order)}


def backward(costs: dict[int, int], table: Table) -> dict[int, int]:
    """Least cost from each state before one more element to the end."""
    out = {}
    for s in STATES:
        found = [more + costs[to] for to, (more, _) in table[s].items() if to in costs]
        if found:
            out[s] = min(found)
    return out


def crossings(tables: list[Table], first: int, last: int, lo: int = 0, hi: int | None = None) -> Iterator[int]:
    """States behind each element of ``tables[lo:hi]`` on the way of the least audit from ``first`` to ``last``."""
    hi = len(tables) if hi is None else hi
    if hi - lo <= 1:
        yield last
        return
    mid = (lo + hi) // 2
    ahead: Vector = {first: (0, 0)}
    for i in range(lo, mid):
        ahead = forward(ahead, tables[i])
    behind = {last: 0}
    for i in range(hi - 1, mid - 1, -1):
        behind = backward(behind, tables[i])
    meet = min((s for s in ahead if s in behind), key=lambda s: (ahead[s][0] + behind[s], ahead[s][1]))
    yield from crossings(tables, first, meet, lo, mid)
    yield from crossings(tables, meet, last, mid, hi)


def stretch_table(codes: str) -> Table:
    """The table of a stretch of rows, audits given by their ranks."""
    out = []
    for s in STATES:
        vector: Vector = {s: (0, 0)}
        for c in codes:
            vector = forward(vector, row_table(c))
        out.append(dict(vector))
    return tuple(out)


def audit_between(codes: str, first: int, last: int) -> str:
    """The least audit of a stretch that leads from ``first`` to ``last``."""
    tables = [row_table(c) for c in codes]
    parts, s = [], first
    for table, to in zip(tables, crossings(tables, first, last)):
        parts.append(table[s][to][1])
        s = to
    return "".join(parts)


def repair(codes: str) -> tuple[int, str]:
    """Least cost and audit of a whole conversation."""
    return _repair_short(codes) if len(codes) <= 64 else _repair(codes)


def _repair(codes: str) -> tuple[int, str]:
    tables = [*(row_table(c) for c in codes), end_table()]
    vector: Vector = {0: (0, 0)}
    for t in tables:
        vector = forward(vector, t)
    parts, s = [], 0
    for table, to in zip(tables, crossings(tables, 0, 0)):
        parts.append(table[s][to][1])
        s = to
    return vector[0][0], "".join(parts)


_repair_short = lru_cache(maxsize=1 << 16)(_repair)


# rows

def damage(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` damaged by their key; a dropped one stays with ``gone``.

    ``copies`` is 2 where a row is repeated.  Null roles and texts are one space, as are nulls in the key.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), blank), F.coalesce(F.col("role"), blank)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"), (kind == 0).alias("gone"))


def _undamaged(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                       F.lit(1).alias("copies"), F.lit(False).alias("gone"))


def _long(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


def _digest(rows: DataFrame) -> Column:
    """Stands for role and text of a row wherever rows are compared or ordered."""
    return F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)


#: Order of a conversation's rows; Spark puts nulls first.
PLACE = ["turn", "digest"]


def _narrow(rows: DataFrame) -> DataFrame:
    """One row for each different row of a conversation: place, code and number of copies, no text."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return (rows.where("not gone").select(
        "conv_id", "turn", _digest(rows).alias("digest"), "copies", initial.alias("initial"), code.alias("code"),
        (~F.col("text").rlike(NOT_SPACE)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
        .groupBy("conv_id", "turn", "digest", "initial", "code", "blank", "cut").agg(F.sum("copies").alias("copies")))


STRETCH = ("conv_id bigint, part int, open boolean, codes string, turns bigint, first_turn bigint, last_turn bigint, blank bigint, "
           "duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, costs array<array<bigint>>, "
           "ranks array<array<int>>, audit string, cost bigint")
LEGAL = ("su", "ua", "au")


class _Stretch:
    """What a task knows of the rows of one conversation that it holds."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.codes: list[str] = []
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, initial: str, code: str, blank: bool, cut: bool, copies: int, first: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        pairs = copies - 1 if initial + initial not in LEGAL else 0
        if self.first_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in LEGAL:
            pairs += 1
        self.illegal += pairs
        self.last_initial = initial
        single = 0 if blank or not first else 1
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - single
        self.truncated += single if cut else 0
        self.codes.append((code.upper() if cut else code) * single + GONE * (copies - single))

    def row(self, part: int, is_open: bool) -> tuple:
        codes = "".join(self.codes)
        costs = ranks = audit = cost = None
        if is_open:
            table = stretch_table(codes)
            costs = [[table[s].get(t, (None, None))[0] for t in STATES] for s in STATES]
            ranks = [[table[s].get(t, (None, None))[1] for t in STATES] for s in STATES]
        else:
            (cost, audit), codes = repair(codes), None
        return (self.conv_id, part, is_open, codes, self.turns, self.first_turn, self.last_turn, self.blank, self.duplicate,
                self.truncated, self.illegal, self.first_initial, self.last_initial, costs, ranks, audit, cost)


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
             "array<array<bigint>>": pa.list_(pa.list_(pa.int64())), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(cols)], [c for c, _ in cols])


def _tuples(b: pa.RecordBatch | pa.Table, names: list[str]) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in names))


def _stretches(narrow: DataFrame, tasks: int | None) -> DataFrame:
    """One row for each conversation and task: solved where the task holds all of it, else (``open``) its table.

    The first row of a (role, text) in a conversation is marked by a row of its own that sorts right before it.
    """
    nothing = {c: F.lit(None).cast(t) for c, t in narrow.dtypes}
    firsts = (narrow.where("not blank").groupBy("conv_id", "digest")
              .agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("at")))
    marks = firsts.select(*({**nothing, "conv_id": F.col("conv_id"), "turn": F.col("at.turn"), "digest": F.col("digest"),
                             "copies": F.lit(0).cast("bigint")}[c].alias(c) for c in narrow.columns))
    place = ["conv_id", *PLACE]
    both = narrow.union(marks)
    dealt = both.repartitionByRange(tasks, *place) if tasks else both.repartitionByRange(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, leads, marked, out = TaskContext.get().partitionId(), None, True, False, []
        for b in batches:
            for conv, turn, initial, code, blank, cut, copies in _tuples(
                    b, ["conv_id", "turn", "initial", "code", "blank", "cut", "copies"]):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        # the first and the last conversation of a task may go on in its neighbours
                        out.append(now.row(part, leads))
                        leads = False
                    now = _Stretch(conv)
                if copies:
                    now.add(turn, initial, code, blank, cut, copies, marked)
                marked = not copies
            if len(out) >= 4096:
                yield _arrow(out, STRETCH)
                out = []
        if now is not None:
            out.append(now.row(part, True))
        yield _arrow(out, STRETCH)

    return dealt.sortWithinPartitions(*place, F.col("copies") > 0).mapInArrow(run, STRETCH)


FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
MET = "conv_id bigint, part int, first int, last int, tail string, " + FACTS


def _meet(t: pa.Table) -> pa.Table:
    """Crossings between the stretches of one conversation, and its facts on the first of them."""
    rows = sorted(t.to_pylist(), key=lambda r: r["part"])
    tables: list[Table] = [tuple({s: (c, k) for s, c, k in zip(STATES, costs, ranks) if c is not None}
                                 for costs, ranks in zip(r["costs"], r["ranks"])) for r in rows]
    tables.append(end_table())
    vector: Vector = {0: (0, 0)}
    for table in tables:
        vector = forward(vector, table)
    states = [0, *crossings(tables, 0, 0)]
    turns, low, high, illegal = 0, None, None, 0
    for i, r in enumerate(rows):
        illegal += r["illegal"] + (i > 0 and rows[i - 1]["last_initial"] + r["first_initial"] not in LEGAL)
        if r["turns"]:
            turns += r["turns"] - (high == r["first_turn"])
            low, high = r["first_turn"] if low is None else low, r["last_turn"]
    facts = [_gaps(low, high, turns), *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), illegal, vector[0][0]]
    end = len(rows) - 1
    return pa.Table.from_batches([_arrow(
        [(r["conv_id"], r["part"], states[i], states[i + 1], tables[-1][states[i + 1]][0][1] if i == end else "",
          *(facts if not i else [None] * len(facts))) for i, r in enumerate(rows)], MET)])


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return min(high - low + 1 - turns, 2 ** 63 - 1) if turns else 0


def _audits(rows: DataFrame, tasks: int | None) -> DataFrame:
    """``(conv_id, part, audit)`` pieces in order of ``part``, the facts of ``FACTS`` on the first piece."""
    facts = [c.split()[0] for c in FACTS.split(", ")]
    found = stage(_stretches(stage(_narrow(rows), "conversations-narrow"), tasks), "conversations-stretches")
    spread = F.try_add(F.try_subtract("last_turn", "first_turn"), 1 - F.col("turns"))  # null beyond a long
    solved = found.where("not open").select(
        "conv_id", "part", "audit", F.when(F.col("turns") > 0, F.coalesce(spread, F.lit(2 ** 63 - 1))).otherwise(0).alias("gaps"),
        *facts[1:])
    opened = found.where("open")
    met = opened.drop("codes", "audit").groupBy("conv_id").applyInArrow(_meet, MET)
    own = opened.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "codes")
    both = own.join(met, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("part")))
    names = ["conv_id", "part", "codes", "first", "last", "tail", *facts]
    schema = "conv_id bigint, part int, audit string, " + FACTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _arrow([(conv, part, audit_between(codes, first, last) + tail, *known)
                          for conv, part, codes, first, last, tail, *known in _tuples(b, names)], schema)

    return solved.union(both.select(*names).mapInArrow(run, schema))


class _Replay:
    """Replays the audit of one conversation over its rows as they come."""

    def __init__(self, conv_id: int | None, with_rows: bool):
        self.conv_id, self.with_rows = conv_id, with_rows
        self.pieces: list[str] = []
        self.facts: tuple = (0,) * 6
        self.audit: str | None = None
        self.at = self.place = self.state = 0
        self.digest = hashlib.sha256()
        self.out: list[tuple] = []

    def _emit(self, edit: str, turn: int | None, role: str, text: str) -> None:
        if self.with_rows:
            self.out.append((self.conv_id, self.place, edit, turn, role, text))
        self.digest.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
        self.place += 1

    def inserts(self) -> None:
        if self.audit is None:
            self.audit = "".join(self.pieces)
        while self.audit[self.at:self.at + 1] == INSERT:
            self.state, self.at = NEXT[self.state], self.at + 1
            self._emit(INSERT, None, ROLE_OF[self.state], "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != DELETE:
            self.state = NEXT[self.state] if edit == REROLE else KEPT[role[0]][self.state]
            self._emit(edit, turn, ROLE_OF[self.state] if edit == REROLE else role, text)

    def result(self) -> tuple:
        self.inserts()
        return (self.conv_id, *self.facts, self.audit, self.digest.hexdigest())


RESULT = "conv_id bigint, " + FACTS + ", audit string, repaired_sha256 string"
ROWS = "conv_id bigint, place bigint, edit string, turn bigint, role string, text string"


def _run(rows: DataFrame, damaged: bool, tasks: int | None, with_rows: bool) -> DataFrame:
    cols = rows.select(_long("conv_id"), _long("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    cols = damage(cols) if damaged else _undamaged(cols)
    facts = [c.split()[0] for c in FACTS.split(", ")]
    audits = _audits(cols, tasks).withColumn("kind", F.lit(0))
    texts = cols.select("conv_id", "turn", F.col("gone").cast("int").alias("gone"), _digest(cols).alias("digest"), "copies",
                        F.when(~F.col("gone"), F.col("role")).alias("role"), F.when(~F.col("gone"), F.col("text")).alias("text"),
                        F.lit(1).alias("kind"))
    both = texts.unionByName(audits, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "part", *PLACE)
    schema = ROWS if with_rows else RESULT
    names = ["conv_id", "kind", "turn", "role", "text", "copies", "gone", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def close() -> None:
            done = now.result()
            out.extend(now.out if with_rows else [done])

        for b in batches:
            for (conv, kind, turn, role, text, copies, gone, audit), known in zip(_tuples(b, names), _tuples(b, facts)):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        close()
                    now = _Replay(conv, with_rows)
                if not kind:
                    now.pieces.append(audit)
                    now.facts = known if known[0] is not None else now.facts
                elif not gone:
                    for _ in range(copies):
                        now.row(turn, role, text)
            if now is not None:
                out.extend(now.out)
                now.out = []
            if out:
                yield _arrow(out, schema)
                out = []
        if now is not None:
            close()
            yield _arrow(out, schema)

    return both.mapInArrow(run, schema)


def repair_conversations(rows: DataFrame, damaged: bool = False, tasks: int | None = None) -> DataFrame:
    """One row for each ``conv_id`` of ``rows (conv_id, turn, role, text)``: the columns of ``RESULT``.

    ``damaged`` first damages the rows by their keys (see ``damage``).  Null roles and texts are one space, a
    null ``conv_id`` is a conversation like any other, null turns come first.  Rows of one turn are ordered by a
    digest of role and text; equal ones are copies, of which the first alone may stay.  A row with
    a role of another initial than s, u or a (an empty one too) is re-roled or deleted.  A conversation
    all of whose rows were dropped has zeros, an empty audit and the digest of no bytes.  Columns not named
    play no part, an empty table gives an empty result.  ``tasks`` fixes the number of range partitions.
    """
    return _run(rows, damaged, tasks, False)


def repaired_rows(rows: DataFrame, damaged: bool = False, tasks: int | None = None) -> DataFrame:
    """The repaired conversations themselves: the columns of ``ROWS``, ``place`` counting from 0.

    ``edit`` is K, R or I; an inserted row has no turn and an empty text.  Else as ``repair_conversations``.
    """
    return _run(rows, damaged, tasks, True)
