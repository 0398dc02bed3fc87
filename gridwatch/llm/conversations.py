"""Conversation structure repair by depth-first branch and bound.

A conversation's rows, in order of their turn, are edited until the initials of their roles
read ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 3, Delete 4 (the only edit for a
blank or repeated row), Insert an empty row of user or assistant 3; a truncated row that stays
adds 3.  Of the cheapest edit sequences the one with the ASCII-least string of initials
(the audit) is taken.

``search`` is the branch and bound: an explicit stack of prefixes (row, state, cost, audit), children
in the order of their initials.  A prefix is dropped if

* its cost and a lower bound of the rest exceed the incumbent (cost, audit), or equal its cost
  without a lesser audit.  The bound adds what each remaining row costs at the least, and half of
  the least further cost for each illegal neighbourship of rows that may stay (an edit mends two at the most);
* the table of its node (row, state) holds a prefix that is no worse in (cost, audit).  Any continuation
  fits both, so the worse one cannot lead to the result.  (Prefixes come in ascending order, so a node is entered again
  only at a strictly lower cost.)

When the stack is empty, the incumbent is proved.  It starts as a greedy repair.

On Spark: damage, faults and digests of the texts are DataFrame functions.  A row is a duplicate if a row
before it has its role and text; rows of later turns are found by a grouped minimum over (conversation, role, digest)
without texts, and a marker row is sorted directly before each of them.  Rows and markers are then dealt by
conversation and sorted, and streamed: a conversation is worked on in chunks of ``CHUNK_ROWS`` rows or
``CHUNK_BYTES``; between chunks only the best (cost, audit, running hash) for each of the four states stays.
So memory is bounded by one chunk and the audits, however long a conversation is.  All rows of one
conversation pass one task, since its digest is that of one sequence of bytes.

Defined results: nulls in any column count as one space, so a null turn is sorted first and
does not count for gaps; a null conv_id is one conversation; rows of one turn are ordered by role, then by
the SHA-256 of their text; a conversation without rows after damage has zeros, an empty audit and the
hash of the empty string; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import slices

CHUNK_ROWS = 128
CHUNK_BYTES = 1 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States by what the last row is: none, system, user, assistant.
NONE, S, U, A = range(4)
STATE = {"s": S, "u": U, "a": A}
#: The state that a further user or assistant row leads to, and the initials a row may have to be kept.
NEXT = {NONE: U, S: U, U: A, A: U}
KEEPS = {NONE: ("s", "u"), S: ("u",), U: ("a",), A: ("u",)}
#: The states that later rows can lead to.
REACH = {NONE: {NONE, S, U, A}, S: {S, U, A}, U: {U, A}, A: {U, A}}
NAME = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
ACCEPTED = frozenset((NONE, A))
SPACES = " \t\n\x0b\x0c\r"

ANCHOR, MARKER, ROW = range(3)


class Row:
    """What the search needs to know of a row, and its texts."""

    __slots__ = ("forced", "initial", "role", "text", "truncated")

    def __init__(self, role: str, text: str, forced: bool, truncated: bool):
        self.role, self.text, self.forced, self.truncated = role, text, forced, truncated
        self.initial = role[:1]

    @property
    def least(self) -> int:
        """The least that any edit of the row costs."""
        stay = TRUNCATED * self.truncated + (KEEP if self.initial in STATE else REROLE)
        return DELETE if self.forced else min(DELETE, stay)


class Bounds:
    """Lower bounds of what the rows from ``i`` on cost in each state."""

    def __init__(self, rows: list[Row], exits: frozenset):
        n = len(rows)
        # Doubled, so that halves stay whole; ``following[i]`` is the first row from i on that may stay.
        self.fixed, self.faults, self.following = [0] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        self.exits = exits
        for i in range(n - 1, -1, -1):
            r = rows[i]
            self.fixed[i] = self.fixed[i + 1] + 2 * r.least
            self.faults[i], self.following[i] = self.faults[i + 1], self.following[i + 1]
            if r.forced:
                continue
            other = self.following[i + 1]
            if r.initial in STATE:
                if other is None:
                    self.faults[i] += 0 if STATE[r.initial] in exits else self.weight(r)
                elif other.initial in STATE and r.initial + other.initial not in LEGAL:
                    self.faults[i] += min(self.weight(r), self.weight(other))
            self.following[i] = r

    @staticmethod
    def weight(row: Row) -> int:
        """The least cost, beyond ``least``, of an edit that mends a fault beside the row: deleting a truncated row costs 1 more."""
        return DELETE - TRUNCATED if row.truncated else min(REROLE, INSERT)

    def rest(self, i: int, state: int) -> int:
        other = self.following[i]
        if other is None:
            seam = 0 if state in self.exits else 2 * INSERT
        else:
            seam = self.weight(other) if other.initial in STATE and other.initial not in KEEPS[state] else 0
        return (self.fixed[i] + self.faults[i] + seam + 1) // 2


def greedy(rows: list[Row], state: int, exits: frozenset) -> tuple[int, str] | None:
    """A first (cost, audit): keep what fits, rerole the rest; None if inserts don't lead to an exit."""
    cost, audit = 0, []
    for r in rows:
        if r.forced:
            cost, edit = cost + DELETE, "D"
        elif r.initial in KEEPS[state]:
            cost, state, edit = cost + TRUNCATED * r.truncated, STATE[r.initial], "K"
        else:
            cost, state, edit = cost + REROLE + TRUNCATED * r.truncated, NEXT[state], "R"
        audit.append(edit)
    for _ in range(3):
        if state in exits:
            return cost, "".join(audit)
        cost, state = cost + INSERT, NEXT[state]
        audit.append("I")
    return None


def search(rows: list[Row], entry: int = NONE, exits: frozenset = ACCEPTED) -> tuple[int, str] | None:
    """The least (cost, audit) of edits that lead from the entry state to one of the exits; None if none does."""
    n, bounds = len(rows), Bounds(rows, exits)
    incumbent = greedy(rows, entry, exits)
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if not exits & REACH[state]:
            continue
        if incumbent is not None:
            least = cost + bounds.rest(i, state)
            if least > incumbent[0] or (least == incumbent[0] and audit > incumbent[1][:len(audit)]):
                continue
        best = table.get((i, state))
        if best is not None and best <= (cost, audit):
            continue
        table[i, state] = (cost, audit)
        if i == n and state in exits and (incumbent is None or (cost, audit) < incumbent):
            incumbent = (cost, audit)
        # Pushed in descending order of initials, so D comes off first.
        if i < n:
            r = rows[i]
            if not r.forced:
                stay = TRUNCATED * r.truncated
                kept = r.initial in KEEPS[state]
                if not kept or STATE[r.initial] != NEXT[state]:
                    stack.append((i + 1, NEXT[state], cost + REROLE + stay, audit + "R"))
                if kept:
                    stack.append((i + 1, STATE[r.initial], cost + KEEP + stay, audit + "K"))
        stack.append((i, NEXT[state], cost + INSERT, audit + "I"))
        if i < n:
            stack.append((i + 1, state, cost + DELETE, audit + "D"))
    return incumbent


def apply_edits(rows: list[Row], audit: str, state: int = NONE):
    """(role, text) of each repaired row."""
    at = iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield NAME[state], ""
            continue
        r = next(at)
        if edit == "K":
            state = STATE[r.initial]
            yield r.role, r.text
        elif edit == "R":
            state = NEXT[state]
            yield NAME[state], r.text


class Label:
    """The best repair of all rows so far that ends in one state."""

    __slots__ = ("audit", "cost", "digest", "lines", "some")

    def __init__(self):
        self.cost, self.audit, self.digest, self.some, self.lines = 0, "", hashlib.sha256(), False, []

    def extended(self, rows: list[Row], state: int, cost: int, audit: str, keep_lines: bool) -> Label:
        out = Label()
        out.cost, out.audit, out.digest, out.some = self.cost + cost, self.audit + audit, self.digest.copy(), self.some
        out.lines = list(self.lines)
        for role, text in apply_edits(rows, audit, state):
            out.digest.update(f"{chr(10) if out.some else ''}{role}:{text}".encode())
            out.some = True
            if keep_lines:
                out.lines.append({"role": role, "text": text})
        return out


def advance(labels: dict[int, Label], rows: list[Row], last: bool, keep_lines: bool = False) -> dict[int, Label]:
    """The best repair for each exit state after a further chunk; after the last chunk a single one."""
    found = {}
    for exits in ([ACCEPTED] if last else [frozenset((e,)) for e in (NONE, S, U, A)]):
        best = None
        for state, label in labels.items():
            way = search(rows, state, exits)
            if way is not None and (best is None or (label.cost + way[0], label.audit + way[1]) < best[:2]):
                best = (label.cost + way[0], label.audit + way[1], state, *way)
        if best is not None:
            found[min(exits)] = labels[best[2]].extended(rows, best[2], best[3], best[4], keep_lines)
    return found


class Conversation:
    """One conversation's counts and labels while its rows stream by."""

    def __init__(self, conv_id, keep_lines: bool):
        self.conv_id, self.keep_lines = conv_id, keep_lines
        self.labels, self.chunk, self.size = {NONE: Label()}, [], 0
        self.first = self.last = self.previous = self.key = self.marked = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def mark(self, key) -> None:
        self.marked = key

    def add(self, turn, role: str, text: str, key, blank: bool, truncated: bool) -> None:
        repeated = key == self.key or key == self.marked
        self.key = key
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += truncated and not blank and not repeated
        if self.previous is not None:
            self.illegal += self.previous + role[:1] not in LEGAL
        self.previous = role[:1]
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if len(self.chunk) >= CHUNK_ROWS or self.size >= CHUNK_BYTES:
            self.labels = advance(self.labels, self.chunk, False, self.keep_lines)
            self.chunk, self.size = [], 0
        self.chunk.append(Row(role, text, blank or repeated, truncated and not blank and not repeated))
        self.size += len(text)

    def result(self) -> tuple:
        (label,) = advance(self.labels, self.chunk, True, self.keep_lines).values()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, label.cost, label.audit,
                label.digest.hexdigest(), label.lines)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage (conv_id, turn, role, text, copy); a dropped row leaves an anchor with null role and text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    return (rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate"))
            .select("conv_id", "turn",
                    F.when(F.col("fate") == 0, F.lit(None)).when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fate") == 0, F.lit(None)).when(F.col("fate") == 1, "")
                    .when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")))


RESULT = pa.schema([*((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    ("audit", pa.string()), ("repaired_sha256", pa.string()),
                    ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


def repair(rows: DataFrame, keep_lines: bool = True) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): its counts, cost, audit, digest and repaired rows.

    A row of null role is an anchor: it only says that the conversation is there.  Without ``keep_lines``
    the repaired rows are left out and memory does not grow with a conversation's text.
    """
    ends = F.rtrim("text", F.lit(SPACES))
    every = (rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.sha2("text", 256).alias("sha"),
                         (ends == "").alias("blank"), (~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("truncated"),
                         F.when(F.col("role").isNull(), ANCHOR).otherwise(ROW).alias("kind")))

    # Later turns on which a role and text stand again; a null turn is before all others.
    places = every.filter(F.col("kind") == ROW).select("conv_id", "role", "sha", "turn").distinct()
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = (places.groupBy("conv_id", "role", "sha").agg(F.min(order).alias("first"), F.count("*").alias("turns"))
             .filter("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s"), "first"))
    again = (places.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")))
             .filter(~F.col("turn").eqNullSafe(F.col("first.turn")))
             .select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"), "sha", F.lit(None).cast("boolean").alias("blank"),
                     F.lit(None).cast("boolean").alias("truncated"), F.lit(MARKER).alias("kind")))

    names = RESULT.names if keep_lines else RESULT.names[:-1]

    def run(batches):
        open_, done, held = None, [], 0

        def out():
            nonlocal done, held
            columns = list(zip(*done, strict=True))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], conv_type), *(pa.array(c, RESULT.field(n).type) for c, n in zip(columns[1:], names, strict=False))],
                names=["conv_id", *names])
            done, held = [], 0
            return batch

        conv_type = None
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                conv_type = batch.column(0).type
                for conv, turn, role, text, sha, blank, truncated, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if open_ is None or open_.conv_id != conv:
                        if open_ is not None:
                            done.append(open_.result())
                            held += len(done[-1][7]) + 200
                        open_ = Conversation(conv, keep_lines)
                    if kind == ROW:
                        open_.add(turn, role, text, (turn, role, sha), blank, truncated)
                    elif kind == MARKER:
                        open_.mark((turn, role, sha))
                    if held > 1 << 20:
                        yield out()
        if open_ is not None:
            done.append(open_.result())
        if done:
            yield out()

    kinds = ", ".join(f"{n} {'long' if RESULT.field(n).type == pa.int64() else 'string'}" for n in names if n != "repaired")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {kinds}" + (
        ", repaired array<struct<role:string,text:string>>" if keep_lines else "")
    return (every.unionByName(again).repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "sha", "kind")
            .mapInArrow(run, schema))


def repair_query(conversations: DataFrame) -> DataFrame:
    """Digest columns of ``repair`` over the damaged rows."""
    return repair(damaged(conversations), keep_lines=False)
