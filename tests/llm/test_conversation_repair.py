"""Repair of conversations against exhaustive search and a plain version of the whole query."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from plumbrule.llm import conversation_repair as repair
from tests.llm.common import FOLDER

SCHEMA = "conv_id long, turn long, role string, text string, conv string, fault int"
NAMES = "sua?"


def cheapest(symbols, costs=repair.Costs()):
    """All strings of edits with at most two insertions in a row, the cheapest and of these the ASCII-least."""
    best = None
    options = [["D"] if s == repair.GONE else ["D", "K", "R"] for s in symbols]
    for gaps in itertools.product(range(3), repeat=len(symbols) + 1):
        for letters in itertools.product(*options):
            cost, roles, audit = 0, "", ""
            for i in range(len(symbols) + 1):
                for _ in range(gaps[i]):
                    roles, audit, cost = roles + "*", audit + "I", cost + costs.insert
                if i == len(symbols):
                    break
                audit += letters[i]
                if letters[i] == "D":
                    cost += costs.delete
                    continue
                cost += costs.unfinished * (symbols[i] % 2) + (costs.rerole if letters[i] == "R" else 0)
                roles += "*" if letters[i] == "R" else NAMES[symbols[i] // 2]
            body = roles[1:] if roles[:1] == "s" else roles
            fits = len(body) % 2 == 0 and all(c in ("*", "ua"[i % 2]) for i, c in enumerate(body)) and (body or not roles)
            if fits and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("costs", [repair.Costs(), repair.Costs(5, 1, 2, 3), repair.Costs(3, 3, 0, 0), repair.Costs(9, 1, 9, 1)])
@pytest.mark.parametrize("block", [1, 3])
def test_edits_equal_exhaustive_search(costs, block):
    rng = random.Random(7)
    cases = [[rng.randrange(9) for _ in range(rng.randrange(5))] for _ in range(60 if block == 3 else 20)]
    cost, audit = repair.least_edits(np.array([s for c in cases for s in c]), np.array([len(c) for c in cases]), costs, block)
    assert [(int(c), a) for c, a in zip(cost, audit)] == [cheapest(c, costs) for c in cases]


def plain_edits(symbols):
    """Least (cost, edits) per state, row by row; equal edits always lead to equal states."""
    def more(best):
        for q, to in [(0, 2), (1, 2), (2, 3), (3, 2), (2, 3)]:
            if q in best:
                new = (best[q][0] + 5, best[q][1] + "I")
                best[to] = min(best.get(to, new), new)
        return best

    best = more({0: (0, "")})
    for s in symbols:
        after = {}
        for q, (cost, audit) in best.items():
            moves = [(q, 2, "D")]
            if s != repair.GONE:
                kept = {0: 1 if q == 0 else None, 1: 2 if q != 2 else None, 2: 3 if q == 2 else None}.get(s // 2)
                moves += [(kept, 5 * (s % 2), "K")] if kept is not None else []
                moves += [(3 if q == 2 else 2, 1 + 5 * (s % 2), "R")]
            for to, price, letter in moves:
                new = (cost + price, audit + letter)
                after[to] = min(after.get(to, new), new)
        best = more(after)
    return min(v for q, v in best.items() if q in (0, 3))


def test_long_sequences():
    rng = random.Random(3)
    cases = [[rng.choice([0, 2, 2, 4, 4, 3, 5, 6, 8]) for _ in range(n)] for n in (0, 1, 2, 3, 4, 50, 333, 2000)]
    cost, audit = repair.least_edits(np.array([s for c in cases for s in c]), np.array([len(c) for c in cases]))
    assert [(int(c), a) for c, a in zip(cost, audit)] == [plain_edits(c) for c in cases]


def plain(rows):
    """The whole query over (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        own += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, symbols, counts = set(), [], {1: 0, 2: 0, 3: 0}
        for _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            fault = 2 if not body else 3 if (role, text) in seen else 0 if body[-1] in ".!?" else 1
            seen.add((role, text))
            counts[fault] = counts.get(fault, 0) + 1
            kind = "sua".find(role[:1]) if role else 3
            symbols.append(repair.GONE if fault >= 2 else 2 * (3 if kind < 0 else kind) + fault)
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[0] for r in own if r[0] is not None}
        cost, audit = plain_edits(symbols)
        lines, at, user = [], 0, True
        for letter in audit:
            name = "user" if user else "assistant"
            if letter == "I":
                lines.append(name + ":")
                user = not user
                continue
            _, role, text = own[at]
            at += 1
            if letter != "D":
                role = name if letter == "R" else role
                lines.append(f"{role}:{text}")
                user = role[0] == "s" or not user
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts[2], counts[3], counts[1], illegal, cost, audit, digest))
    return sorted(out, key=lambda r: (r[0] is None, r[0]))


def result(df):
    return sorted(map(tuple, repair.repair_digest(df).collect()), key=lambda r: (r[0] is None, r[0]))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)


def test_equals_the_plain_version(spark):
    for folder in (FOLDER, "/root/testdata/sf0.1"):
        rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
        assert result(rows) == plain([tuple(r) for r in rows.collect()])


def edge_rows():
    rng = random.Random(5)
    texts = ["", " \t\n\r\x0b\x0c", None, "Yes.", "no", "Why?\n ", "«ä»!", "a\nb", "x" * 70_000 + ".", ".", "...", "　"]
    roles = ["user", "assistant", "system", None, "", "User", "tool", "überuser"]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 9, -4]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randrange(1, 9))]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (99, 2**62, "user", "a."), (99, -(2**62), "assistant", "b.")]
    return rows + [(500, i, rng.choice(["user", "assistant"]), f"{i % 700} ok.") for i in range(12_000)]


def test_edge_rows(spark):
    rows = edge_rows()
    assert result(frame(spark, rows)) == plain(rows)


def test_conversation_that_loses_all_rows(spark):
    lost = [t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0][:2]
    assert result(frame(spark, [(7, t, "user", "Hi.") for t in lost])) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert result(frame(spark, [])) == []
