"""Conversation repair against brute force over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from lictor.llm import conversation_repair as repair

GOOD = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, audit) by trying all edit sequences, cheapest and ASCII-least first, over initials written so far."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, i, initials = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(initials):
            return cost, audit
        steps = [("I", 5, i, c) for c in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append(("D", 2, i + 1, ""))
            if fault != repair.GONE:
                more = 5 * (fault == repair.CUT)
                steps += [("K", more, i + 1, initial or "?"), *[("R", 1 + more, i + 1, c) for c in "ua"]]
        for edit, price, at, c in steps:
            if any(GOOD.fullmatch(initials + c + rest) for rest in ("", "a", "ua")):
                heapq.heappush(heap, (cost + price, audit + edit, at, initials + c))


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_all_edit_sequences(seed):
    draw = random.Random(seed)
    for _ in range(60):
        rows = [(draw.choice(["u", "a", "u", "a", "s", "x", ""]), draw.choice([0, 0, 0, 1, 2])) for _ in range(draw.randint(0, 7))]
        assert repair.search(rows) == cheapest(rows), rows


def test_estimates_never_exceed_the_cost():
    draw = random.Random(9)
    for _ in range(100):
        rows = [(draw.choice("uas "), draw.choice([0, 0, 1, 2])) for _ in range(draw.randint(1, 8))]
        assert repair.estimates(rows)[repair.START][0] <= repair.search(rows)[0]


def test_long_conversation():
    draw = random.Random(1)
    rows = [(draw.choice("uuaas"), draw.choice([0, 0, 0, 1, 2])) for _ in range(20_000)]
    cost, audit = repair.search(rows)
    assert len(audit.replace("I", "")) == len(rows)
    done = list(repair.repaired_turns(((r[0], "") for r in rows), audit))
    assert GOOD.fullmatch("".join(role[0] for role, _ in done)) and cost > 0


def expected(rows):
    """Everything but the search, by plain Python, from original rows."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in held if t is not None]
        faults, seen, coded = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in held:
            shown = re.sub("[\x20\x09-\x0D]", "", text)
            name = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if name:
                faults[name] += 1
            coded.append((role[:1], {None: 0, "truncated": 1}.get(name, 2)))
        cost, audit = cheapest(coded)
        done, i = [], 0
        for edit in audit:
            need = "assistant" if done and done[-1][0][:1] == "u" else "user"
            if edit == "I":
                done.append((need, ""))
                continue
            _, role, text = held[i]
            i += 1
            if edit != "D":
                done.append((role if edit == "K" else need, text))
        initials = [r[:1] for _, r, _ in held]
        out[conv] = dict(
            conv_id=conv, gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **faults,
            illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost=cost, audit=audit,
            repaired_sha256=hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, kind string, audit string, fault int"


def test_report_equals_brute_force(spark):
    draw = random.Random(4)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(draw.randint(1, 7)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = draw.choice(["Hello there.", "Really?", "cut off", " \t", "", None, "Yes! ", "long " * 5000 + ".", f"No {turn}."])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [(99, 0, "user", "Same."), (99, 0, "user", "Same."), (98, None, None, None)]
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    found = {r.conv_id: r.asDict() for r in repair.report(table, repair.damaged(table)).collect()}
    assert found == expected(rows)


def test_repaired_turns_and_empty_tables(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Go on."), (2, 0, "assistant", "Cut")], "conv_id long, turn int, role string, text string")
    found = repair.audits(table)
    got = {(r.conv_id, r.nth): (r.role, r.text) for r in repair.repaired(table, found).collect()}
    assert got == {(1, 0): ("user", "Hi."), (1, 1): ("assistant", "Go on.")}
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (3, "KDR"), 2: (2, "D")}
    none = table.limit(0)
    assert repair.report(none, repair.damaged(none)).collect() == [] and repair.repaired(none, repair.audits(none)).collect() == []
    lost = repair.report(table, none).where("conv_id = 1").first()
    assert (lost.cost, lost.audit, lost.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
