"""Repairs against a search over all single edits with whole strings, and edges."""

import hashlib
import random

import pytest

from hearsay.llm import queries, repair
from tests.check import assert_same

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, digest string, n long"


def table(spark, rows):
    """(conv_id, turn, role, text[, gone]) with columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r[:4], bool(r[4:] and r[4]), "x", 1) for r in rows], SCHEMA)


def searched(turns):
    """(cost, audit, said) of the cheapest, then ASCII-least edits: one edit at a time, up to three inserts in any gap."""
    seen, faults = set(), []
    for role, text in turns:
        kept = text.strip(" \t\n\v\f\r")
        faults.append(1 if not kept else 2 if (role, text) in seen else 3 if kept[-1] not in ".!?" else 0)
        seen.add((role, text))
    grammar = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def inserted(states):
        found = dict(states)
        for _ in range(3):
            for last, (cost, audit, said) in list(found.items()):
                for role in ("user", "assistant"):
                    if (last, role[0]) in grammar:
                        new = (cost + 2, audit + "I", [*said, f"{role}:"])
                        if role[0] not in found or new[:2] < found[role[0]][:2]:
                            found[role[0]] = new
        return found

    # every prefix of edits of equal length in turns, so strings of a state compare as they are
    states = {"": (0, "", [])}
    for (role, text), fault in zip(turns, faults, strict=True):
        after = {}
        for last, (cost, audit, said) in [*states.items(), *((k, v) for k, v in inserted(states).items() if states.get(k) != v)]:
            options = [(last, (cost + 3, audit + "D", said))]
            if fault not in (1, 2):
                extra = int(fault == 3)
                if (last, role[:1]) in grammar:
                    options.append((role[0], (cost + extra, audit + "K", [*said, f"{role}:{text}"])))
                options += [(new[0], (cost + 2 + extra, audit + "R", [*said, f"{new}:{text}"])) for new in ("user", "assistant") if (last, new[0]) in grammar]
            for to, value in options:
                if to not in after or value[:2] < after[to][:2]:
                    after[to] = value
        states = after
    ends = [v for k, v in [*states.items(), *inserted(states).items()] if k in ("", "a")]
    return min(ends, key=lambda v: v[:2])


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_against_a_search(spark, seed):
    rng = random.Random(seed)
    convs = {c: [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", " "]), rng.choice(["a.", "b!", "c", "d?", "", " \n", "e. "])) for _ in range(rng.randrange(9))] for c in range(300)}
    rows = [(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
    plans, turns = repair.repair(table(spark, rows))
    got = {r.conv_id: (r.cost, r.audit) for r in plans.collect()}
    said = {r.conv_id: r.repaired_sha256 for r in repair.digests(turns).collect()}
    for c, turns in convs.items():
        if turns:
            cost, audit, lines = searched(turns)
            assert got[c] == (cost, audit), turns
            assert said.get(c) == (hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None)


def test_repaired_turns_alternate(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", "u?"), (1, 2, "user", "u?"), (1, 5, "assistant", "cut")]
    plans, turns = repair.repair(table(spark, rows))
    plan = plans.collect()[0]
    assert (plan.gaps, plan.blank, plan.duplicate, plan.truncated, plan.illegal, plan.cost, plan.audit) == (2, 0, 1, 1, 2, 6, "KIKKDK")
    assert [(r.place, r.edit, r.role, r.text) for r in turns.orderBy("place").collect()] == [(0, "K", "system", "s."), (1, "I", "user", ""), (2, "K", "assistant", "a."), (3, "K", "user", "u?"), (4, "K", "assistant", "cut")]


def test_edges(spark):
    rows = [(None, None, None, None), (None, None, "user", "x."), (2, None, "user", "x."), (2, 3, "user", "x."), (2, 3, "user", "x."), (3, 1, "user", "a.", True), (4, 7, "", "y" * 300_000), (5, 1, "systemic", "only."), (6, 0, "user", "q.\n\x0b"), (6, 9, "assistant", "r ")]
    plans, turns = repair.repair(table(spark, rows))
    got = {r.conv_id: tuple(r)[1:] for r in plans.collect()}
    assert got[None] == (0, 1, 0, 0, 1, 5, "DKI")  # null role and text are a space
    assert got[2] == (0, 0, 2, 0, 2, 8, "KDDI")
    assert got[3] == (0, 0, 0, 0, 0, 0, "")
    assert got[4] == (0, 0, 0, 1, 0, 3, "D")
    assert got[5] == (0, 0, 0, 0, 0, 3, "D")
    assert got[6] == (8, 0, 0, 1, 0, 1, "KK")  # a no-break space is a character
    assert {r.conv_id for r in turns.collect()} == {None, 2, 6}
    assert repair.repair(table(spark, []))[0].count() == 0


def test_a_long_conversation(spark):
    plans, turns = repair.repair(table(spark, [(1, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(30_000)]))
    plan = plans.collect()[0]
    assert (plan.cost, plan.audit) == (4, "I" + "K" * 30_000 + "I")
    assert turns.count() == 30_002


def test_layers_stay_few():
    repair.layer.cache_clear()
    rng = random.Random(5)
    held = repair.Turns(1)
    for t in range(20_000):
        held.add(t, rng.choice(["s", "u", "a", "t", ""]), rng.choice([0, 0, 1, 2, 3]))
    assert repair.layer.cache_info().currsize < 2_000


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "a. b! c") for c in range(40) for t in range(5)] + [(None, 1, None, None), (1, None, "user", "z.")]
    got = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        new = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text, kind == 0)
        want += [new] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_same_rows_as_sql(spark, sf, duck):
    assert_same(queries.QUERIES["op13_repair"](spark, sf), duck.sql(queries.ORACLE_SQL["op13_repair"]))
