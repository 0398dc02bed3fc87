"""Conversation repair against a plain shortest path over all edits, and by hand."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from gridwatch.llm import conversations as C
from gridwatch.llm.common import load

GOOD = re.compile("(s?(ua)+)?")


def cheapest(rows, entry=C.NONE, exits=C.ACCEPTED):
    """The least (cost, audit) by Dijkstra's algorithm over all edits: no bounds, no incumbent."""
    heap, done = [(0, "", 0, entry)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in exits:
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, C.NEXT[state]))
        if i < len(rows):
            r = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if not r.forced:
                extra = 3 * r.truncated
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, C.NEXT[state]))
                if r.initial in C.KEEPS[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, C.STATE[r.initial]))
    return None


def random_rows(rng, n):
    return [C.Row(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " "]), f"t{i}", rng.random() < 0.15, rng.random() < 0.2)
            for i in range(n)]


def tidy(rows):
    for r in rows:
        r.truncated = r.truncated and not r.forced
    return rows


def test_search_equals_shortest_path():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 5, 9, 14] * 60:
        rows = tidy(random_rows(rng, n))
        assert C.search(rows) == cheapest(rows)
        for entry, leave in itertools.product(range(4), range(4)):
            assert C.search(rows, entry, frozenset((leave,))) == cheapest(rows, entry, {leave})


def test_all_short_conversations():
    kinds = [("user", False, False), ("assistant", False, False), ("system", False, False), ("assistant", False, True), ("user", True, False)]
    for n in range(5):
        for case in itertools.product(kinds, repeat=n):
            rows = [C.Row(role, "x", forced, cut) for role, forced, cut in case]
            cost, audit = C.search(rows)
            assert (cost, audit) == cheapest(rows)
            assert GOOD.fullmatch("".join(role[0] for role, _ in C.apply_edits(rows, audit)))


def test_bounds_never_exceed_the_rest():
    rng = random.Random(2)
    for _ in range(200):
        rows = tidy(random_rows(rng, rng.randint(0, 9)))
        for exits in (C.ACCEPTED, frozenset((C.U,)), frozenset((C.S,))):
            bounds = C.Bounds(rows, exits)
            for i, state in itertools.product(range(len(rows) + 1), range(4)):
                rest = cheapest(rows[i:], state, exits)
                assert rest is None or bounds.rest(i, state) <= rest[0]


def test_chunks_give_the_whole(monkeypatch):
    rng = random.Random(3)
    for _ in range(60):
        rows = tidy(random_rows(rng, rng.randint(1, 30)))
        labels = {C.NONE: C.Label()}
        for a in range(0, len(rows), 4):
            labels = C.advance(labels, rows[a:a + 4], a + 4 >= len(rows), True)
        (label,) = labels.values()
        cost, audit = cheapest(rows)
        lines = list(C.apply_edits(rows, audit))
        assert (label.cost, label.audit) == (cost, audit) and [(x["role"], x["text"]) for x in label.lines] == lines
        assert label.digest.hexdigest() == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()


def test_long_conversation_is_proved():
    rng = random.Random(4)
    rows = tidy(random_rows(rng, 400))
    assert C.search(rows) == cheapest(rows)


def brute(rows):
    """The contract read literally; rows of one turn by role, then SHA-256 of the text."""
    out, by_conv = [], {}
    show = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        mine = by_conv.setdefault(conv, [])
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        mine += [(turn, role, text)] * (2 if fate == 3 else 1)
    for conv, mine in by_conv.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, made = set(), []
        count = {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            visible = re.findall("[^\x20\x09-\x0D]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            made.append(C.Row(role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        cost, audit = cheapest(made)
        text = "\n".join(f"{a}:{b}" for a, b in C.apply_edits(made, audit))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count.values(),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, C.repair_query(df).collect()), key=str)


@pytest.mark.parametrize("chunk", [128, 3])
def test_query(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
    rng = random.Random(6)
    texts = ["Yes.", "No", "Same text!", " \n", "", None, "éé 日本。", "ends here? \t", "x" * 9]
    rows = [(c if c < 60 else None, rng.choice([None, *range(12)]) if c % 5 == 0 else t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts))
            for c in range(62) for t in range(rng.randint(1, 14))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(700)] + [(101, t, "user", "again.") for t in range(300)]
    rows += [(102, 5, "user", "tie.")] * 4 + [(103, 1, "assistant", "z" * 300_000)]
    gone = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "dropped")]
    df = spark.createDataFrame([(*r, 9, "q") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string")
    got = result(df.repartition(5))
    assert got == brute(rows)
    assert [r for r in got if r[0] == gone] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert result(df.limit(0)) == []


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = C.repair(df).collect()
    assert (r.cost, r.audit) == (3, "KIKK")
    assert [(x.role, x.text) for x in r.repaired] == [("user", "Hi."), ("assistant", ""), ("user", "Hello?"), ("assistant", "Yes.")]


def test_conversations(spark):
    df = load(spark, "/root/testdata/sf0.01", "conversations")
    assert result(df) == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
