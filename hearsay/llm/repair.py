"""Conversation structure repair: the cheapest edits that give every conversation the form (s?(ua)+)?.

A conversation's turns have one initial each: of system, user, assistant or anything else. The
repaired ones begin with at most one system turn, then users and assistants take turns, the last an
assistant. Edits are Keep, Rerole (to user or assistant), Delete and Insert (an empty user or
assistant turn).

Between two turns of the table, inserts only help to reach the turn's role, and an insert ahead of
a deleted turn can as well follow it, which is less in ASCII. So the edits of one turn are one
macro: Delete, or a run of at most one insert and then Keep or Rerole. The macros' codes, D < IK <
IR < K < R, are free of prefixes, so strings of equally many macros compare as their first different
macros do, and a state of a layer needs only its cost and the rank of its string among the layer's.
Strings are never kept: each layer leaves parent pointers, and the best string is read back from them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.lineage import stored

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
CODES = ("D", "IK", "IR", "K", "R")
#: Which role the automaton's states have seen last: none, system, user, assistant.
NONE, S, U, A = range(4)
#: From a state, the state and the inserted turns (0 or 1) of a turn with that initial.
MOVES = {("s", NONE): (S, 0)} | {("u", p): (U, int(p == U)) for p in range(4)} | {("a", p): (A, int(p != U)) for p in range(4)}
#: Inserts after the last turn that make a state final.
CLOSE = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}
ROLES = {U: "user", A: "assistant"}
START = ((0, 0), None, None, None)
BLANK = "[^\\x20\\x09-\\x0D]"

PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@lru_cache(maxsize=1 << 16)
def layer(before: tuple, initial: str, must_go: bool, truncated: bool) -> tuple[tuple, int, bytes]:
    """The layer after one more turn, what its cheapest state costs more than before's, and four parent pointers.

    A layer has (cost beyond the cheapest, rank of the string) for each state, or None for one that
    can't be reached or that another one beats whatever follows. A pointer is 8 * parent + code.
    """
    best: list = [None] * 4
    for p, known in enumerate(before):
        if known is None:
            continue
        options = [(p, DELETE, 0)]
        for role in "" if must_go else "sua":
            if (role, p) in MOVES and (role == initial or role != "s"):
                to, inserts = MOVES[role, p]
                options.append((to, INSERT * inserts + (0 if role == initial else REROLE) + TRUNCATED * truncated, 1 + (role != initial) if inserts else 3 + (role != initial)))
        for to, cost, code in options:
            found = (known[0] + cost, known[1], code, p)
            if best[to] is None or found < best[to]:
                best[to] = found
    if best[A]:
        # after an assistant's turn all goes on as from the start, but that a system turn has to go
        if best[NONE] and best[NONE][0] > best[A][0] + DELETE:
            best[NONE] = None
        if best[S] and best[S][0] > best[A][0]:
            best[S] = None
    least = min(b[0] for b in best if b)
    order = sorted(b[1:3] for b in best if b)
    after = tuple(b and (b[0] - least, order.index(b[1:3])) for b in best)
    return after, least, bytes(8 * b[3] + b[2] if b else 255 for b in best)


class Turns:
    """One conversation as its turns come in order: counts, the last layer, and four bytes of pointers for each turn."""

    def __init__(self, conv):
        self.conv, self.layer, self.cost, self.pointers = conv, START, 0, bytearray()
        self.faults, self.illegal, self.turns, self.low, self.last, self.initial = [0, 0, 0], 0, 0, None, None, None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        """fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
        if turn is not None and turn != self.last:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.last = turn
        if fault:
            self.faults[fault - 1] += 1
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.layer, more, pointers = layer(self.layer, initial if initial in ("s", "u", "a") else "", fault in (1, 2), fault == 3)
        self.cost += more
        self.pointers += pointers

    def plan(self) -> tuple:
        cost, _, state = min((x[0] + INSERT * CLOSE[s], x[1], s) for s, x in enumerate(self.layer) if x)
        codes = ["I" * CLOSE[state]]
        for at in range(len(self.pointers) - 4, -1, -4):
            state, code = divmod(self.pointers[at + state], 8)
            codes.append(CODES[code])
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults, self.illegal, self.cost + cost, "".join(reversed(codes)))


def damage(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by crc32("conv_id:turn") % 20, for trying repairs on.

    0 drops a row (gone is true, so that its conversation stays known), 1 empties its text, 2 takes
    `.`, `!` and `?` out of it, 3 repeats it, 4 makes its role user. Null roles and texts, and
    nulls within the hashed key, are one space.
    """
    space = F.lit(" ")
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    own = conversations.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    kind = F.crc32(F.concat(*(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id",)), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    own = own.withColumn("kind", kind).withColumn("times", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"))


def _digest() -> Column:
    return F.md5(F.col("text").cast("binary"))


def plan_repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation of rows (conv_id, turn, role, text, gone).

    Rows are taken by turn, nulls first, equal turns by role and then by the text's MD5. A row's
    first fault counts: blank, duplicate (the conversation has the role and text earlier) or
    truncated (its last character is not `.`, `!` or `?`). illegal counts neighbours whose initials
    are not su, ua or au; gaps are the turn numbers lacking between the least and the greatest.
    cost and audit are those of the cheapest edits, the ASCII-least of equal ones.

    Where a text was seen first is an aggregate that is joined back, so no conversation's texts are
    held. Turns come in order by a sort within partitions that tasks stream through: a task holds
    four bytes a turn of one conversation (its audit, which is returned whole, has up to two).

    Null role and text: one space. A null conv_id is a conversation of its own. Equal rows are
    duplicates of the first. gone rows only name their conversation: with none other, it has zeros
    and an empty audit. An empty table gives no rows; other columns are ignored.
    """
    space = F.lit(" ")
    own = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), "gone")
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    own = own.select("conv_id", "turn", "gone", "role", _digest().alias("digest"), fault.alias("fault"))
    key = ["conv_id", "role", "digest"]
    seen = own.where("not gone").groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"), F.lit(True).alias("repeats"))
    met = own.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & ~F.col("gone"), "left")
    later = F.coalesce(F.col("repeats"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    met = met.select("conv_id", "turn", "gone", "role", "digest", F.when((F.col("fault") != 1) & later, 2).otherwise(F.col("fault")).alias("fault"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, before = None, [], None
        for batch in batches:
            for conv, turn, gone, role, digest, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv != held.conv:
                    if held is not None:
                        done.append(held.plan())
                    held, before = Turns(conv), None
                if gone:
                    continue
                now = (turn, role, digest)
                held.add(turn, role[:1], 2 if now == before and fault != 1 else fault)
                before = now
            if done:
                yield _rows(done)
                done = []
        if held is not None:
            yield _rows([held.plan()])

    return met.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest").mapInArrow(run, PLAN)


def _rows(plans: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PLAN.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in plans], pa.string() if n == "audit" else pa.int64()) for i, n in enumerate(names)], names)


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns that plans' audits make of rows, in order from place 0.

    A conversation's audit is sorted ahead of its turns, and tasks stream through both: they hold
    the audit and one batch of texts, however long the conversation. Its turns follow each other
    within one partition of the result.
    """
    space = F.lit(" ")
    turns = rows.where("not gone").select("conv_id", F.lit(True).alias("is_turn"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")).withColumn("digest", _digest())
    audits = plans.select("conv_id", F.lit(False).alias("is_turn"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("digest"))
    both = audits.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", "turn", "role", "digest").select("conv_id", "is_turn", "role", "text")
    names = ["conv_id", "place", "edit", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, NONE, 0
        out: list[tuple] = []

        def turned(edit: str, role: str, text: str) -> None:
            nonlocal place
            out.append((conv, place, edit, role, text))
            place += 1

        def inserts() -> None:
            nonlocal at, state
            while audit[at : at + 1] == "I":
                state = A if state == U else U
                turned("I", ROLES[state], "")
                at += 1

        for batch in batches:
            for own, is_turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_turn:
                    inserts()  # what closes the one before
                    conv, audit, at, state, place = own, text, 0, NONE, 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = {"s": S, "u": U, "a": A}[role[0]]
                    turned("K", role, text)
                elif edit == "R":
                    state = A if state == U else U
                    turned("R", ROLES[state], text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
                out.clear()
        inserts()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return both.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of a conversation's `role:text`, joined by newlines, for the frame that repaired_turns gives.

    It streams through the partitions as they are, in which a conversation's turns follow each other.
    """
    import hashlib

    names = ["conv_id", "repaired_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, whole, done = None, None, []
        for batch in batches:
            for own, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if whole is not None:
                        done.append((conv, whole.hexdigest()))
                    conv, whole = own, hashlib.sha256()
                whole.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names)
                done = []
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([whole.hexdigest()])], names)

    return turns.select("conv_id", "place", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, turns) of rows (conv_id, turn, role, text, gone): see plan_repairs and repaired_turns. Plans are stored, as turns read them again."""
    plans = stored(plan_repairs(rows))
    return plans, repaired_turns(rows, plans)
