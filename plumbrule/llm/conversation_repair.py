"""Least-cost repair of the order of roles in conversations, by Four-Russians block tables.

A repaired conversation has the role initials ``(s?(ua)+)?``: perhaps a system turn, then user and assistant
in turns.  Rows may be kept (K), given another role (R), deleted (D), and empty rows inserted (I), each at a
cost.  The automaton of that pattern has four states; the least cost of repairing the rest of a conversation
is a vector of four numbers.  Less their minimum these vectors are few, so a table holds the vector and the
added cost for every vector and every block of ``BLOCK`` symbols.  Conversations are read from their end, one
lookup a block, all conversations of a batch at once.  Then each block is expanded backward from the vector at
its right border, which gives the cost still to come at every row, and the edits are chosen from the first row
on: the ASCII-least edit that keeps the cost least, so ties are decided as whole strings would be.

Defined cases: missing roles and texts are one space; rows stand by turn (missing first), then role, then
text; a missing conversation id is a conversation of its own; conversations without rows keep a row of zeros.
A conversation passes through one task as a sorted stream; a task holds one byte of symbol, eight of turn and
the edit letters of every row of the conversation at hand, never its texts.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbrule.llm.vectors import crc_remainder

#: Rows looked up at once.
BLOCK = 3
#: Classes of role initials; all others are the fourth.
INITIALS = "sua"
#: Symbols: 2 * class + truncated, then a row that has to go, then no row.
GONE, NONE = 8, 9
SYMBOLS = 10
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
GROWN = np.array([2, 2, 3, 2])  # the state after a user or assistant turn that continues the pattern
ENDS = (0, 3)
FAR = 1 << 40
#: A character that is no blank; a text that ends with a full stop, exclamation or question mark.
VISIBLE = r"[^\x20\x09-\x0D]"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"


@dataclasses.dataclass(frozen=True)
class Costs:
    """Costs of the edits; truncated rows that are not deleted add ``unfinished``."""

    delete: int = 2
    insert: int = 5
    rerole: int = 1
    unfinished: int = 5

    def __post_init__(self):
        if self.insert < 1 or min(self.delete, self.rerole, self.unfinished) < 0:
            raise ValueError("inserting must cost something and no cost may be negative")


def _kept_state(state: int, kind: int) -> int | None:
    """The state after keeping a row of that class of initials, if the pattern allows it."""
    if kind == 0:
        return 1 if state == 0 else None
    return {1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(kind)


def _closed(vector: list[int], insert: int) -> tuple[int, ...]:
    """Least costs when up to two rows may be inserted first; more never help."""
    once = [min(vector[q], insert + vector[GROWN[q]]) for q in range(4)]
    return tuple(min(vector[q], insert + once[GROWN[q]]) for q in range(4))


def _row_choices(after: tuple[int, ...], symbol: int, state: int, costs: Costs) -> list[tuple[str, int, int]]:
    """(letter, state behind the row, cost of the row and all that follows) of the edits of one row."""
    out = [("D", state, costs.delete + after[state])]
    if symbol != GONE:
        kind, more = symbol // 2, costs.unfinished * (symbol % 2)
        kept = _kept_state(state, kind)
        if kept is not None:
            out.append(("K", kept, more + after[kept]))
        grown = int(GROWN[state])
        out.append(("R", grown, costs.rerole + more + after[grown]))
    return out


@dataclasses.dataclass(frozen=True)
class Tables:
    """``vectors[v]`` are costs to come less their least; ``following`` and ``added`` go one row to the left,
    ``block_following`` and ``block_added`` a whole block; ``letters[edits[v, symbol, state]]`` are the edits of a row
    before vector ``v`` and ``states`` the state behind it."""

    vectors: np.ndarray
    following: np.ndarray
    added: np.ndarray
    block_following: np.ndarray
    block_added: np.ndarray
    letters: list[str]
    edits: np.ndarray
    states: np.ndarray


@functools.lru_cache(maxsize=4)
def tables(costs: Costs = Costs(), block: int = BLOCK) -> Tables:
    """All vectors that can occur behind any conversation, and the steps between them."""
    end = _closed([0 if q in ENDS else FAR for q in range(4)], costs.insert)
    known, steps, letters, edits, states = {end: 0}, [], [""], [], []
    todo = [end]
    for after in todo:
        row, row_edits, row_states = [], [], []
        for symbol in range(SYMBOLS):
            if symbol == NONE:
                row.append((known[after], 0))
                row_edits.append([0] * 4)
                row_states.append(list(range(4)))
                continue
            choices = [_row_choices(after, symbol, q, costs) for q in range(4)]
            whole = _closed([min(c[2] for c in choices[q]) for q in range(4)], costs.insert)
            least = min(whole)
            found = tuple(x - least for x in whole)
            if found not in known:
                known[found] = len(known)
                todo.append(found)
            row.append((known[found], least))
            names, ends = [], []
            for q in range(4):
                name, state = "", q
                while True:
                    best = {letter: to for letter, to, cost in choices[state] if cost == whole[state]}
                    if whole[state] == costs.insert + whole[GROWN[state]]:
                        best["I"] = int(GROWN[state])
                    letter = min(best)
                    name, state = name + letter, best[letter]
                    if letter != "I":
                        break
                if name not in letters:
                    letters.append(name)
                names.append(letters.index(name))
                ends.append(state)
            row_edits.append(names)
            row_states.append(ends)
        steps.append(row)
        edits.append(row_edits)
        states.append(row_states)
    following = np.array([[s[0] for s in row] for row in steps])
    added = np.array([[s[1] for s in row] for row in steps])
    size = len(steps)
    block_following, block_added = np.arange(size)[:, None], np.zeros((size, 1), np.int64)
    for _ in range(block):  # one more symbol on the left of the blocks so far
        more = following[block_following][:, :, :]  # vectors x blocks x symbols
        cost = block_added[:, :, None] + added[block_following]
        block_following, block_added = (x.transpose(0, 2, 1).reshape(size, -1) for x in (more, cost))
    return Tables(np.array(list(known)), following, added, block_following, block_added, letters, np.array(edits), np.array(states))


def least_edits(symbols: np.ndarray, sizes: np.ndarray, costs: Costs = Costs(), block: int = BLOCK) -> tuple[np.ndarray, list[str]]:
    """(least cost, ASCII-least edits of that cost) for consecutive conversations of ``sizes`` symbols each."""
    t = tables(costs, block)
    if not len(sizes):
        return np.zeros(0, np.int64), []
    blocks = -(-sizes // block)
    first = np.cumsum(blocks) - blocks
    padded = np.full((int(blocks.sum()), block), NONE)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first * block, sizes)
    padded.ravel()[place] = symbols
    codes = padded @ (SYMBOLS ** np.arange(block - 1, -1, -1))
    order = np.argsort(-blocks, kind="stable")
    longest = np.sort(blocks)[::-1]
    # from the right, one block of every conversation that has so many
    vector, cost = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    border = np.zeros(len(codes), np.int64)
    for done in range(int(longest[0])):
        active = order[: np.searchsorted(-longest, -done, "left")]
        at = first[active] + blocks[active] - 1 - done
        border[at] = vector[active]
        cost[active] += t.block_added[border[at], codes[at]]
        vector[active] = t.block_following[border[at], codes[at]]
    cost += t.vectors[vector, 0]
    # every block expanded backward from its right border
    inner = np.zeros(padded.shape, np.int64)
    behind = border
    for j in range(block - 1, -1, -1):
        inner[:, j] = behind
        behind = t.following[behind, padded[:, j]]
    # and the edits from the left
    state, chosen = np.zeros(len(sizes), np.int64), np.zeros(padded.shape, np.int64)
    for done in range(int(longest[0])):
        active = order[: np.searchsorted(-longest, -done, "left")]
        at = first[active] + done
        for j in range(block):
            chosen[at, j] = t.edits[inner[at, j], padded[at, j], state[active]]
            state[active] = t.states[inner[at, j], padded[at, j], state[active]]
    names = np.array(t.letters, object)[chosen.ravel()]
    closing = ["", "II", "I", ""]
    return cost, ["".join(names[f * block : (f + b) * block]) + closing[s] for f, b, s in zip(first, blocks, state)]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, lost``: rows with seeded faults; lost rows stay as marks of their conversation."""
    name, said = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    place = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), name.alias("role"), said.alias("text"), crc_remainder(place, 20).alias("fault"))
    fault, text_ = F.col("fault"), F.col("text")
    new = F.when(fault <= 1, "").when(fault == 2, F.regexp_replace(text_, "[.!?]", "")).otherwise(text_)
    return out.select(
        "conv", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), (fault == 0).alias("lost"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _symbols(rows: DataFrame) -> DataFrame:
    """``conv, turn, fault, symbol``, sorted inside every partition; fault 0 none, 1 truncated, 2 blank, 3 duplicate, 4 lost."""
    same = Window.partitionBy("conv", "lost", "role", F.xxhash64("text"), "text").orderBy(F.col("turn").asc_nulls_first())
    seen = rows.repartition("conv").withColumn("_seen", F.row_number().over(same))
    fault = F.when(F.col("lost"), 4).when(~F.col("text").rlike(VISIBLE), 2).when(F.col("_seen") > 1, 3).when(~F.col("text").rlike(FINISHED), 1).otherwise(0)
    kind = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    kind = F.when((kind > 0) & (F.length("role") > 0), kind - 1).otherwise(len(INITIALS))
    out = seen.withColumn("_fault", fault).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return out.select("conv", "turn", F.col("_fault").cast("byte").alias("fault"), kind.cast("byte").alias("kind"))


FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _starts(column: pa.Array) -> np.ndarray:
    """Places where the value differs from the one before; missing values are equal."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)


def _facts(key: list, turns: np.ndarray, known: np.ndarray, fault: np.ndarray, kind: np.ndarray, sizes: np.ndarray, costs: Costs) -> pa.RecordBatch:
    """One row per conversation from the rows of whole conversations."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    here = fault < 4
    turns, known, fault, kind, owner = (x[here] for x in (turns, known, fault, kind, owner))
    sizes = np.bincount(owner, minlength=len(sizes))
    count = lambda mask: np.bincount(owner[mask], minlength=len(sizes))
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True
    next_to = owner[1:] == owner[:-1]
    illegal = np.bincount(owner[1:][next_to & ~legal[kind[:-1], kind[1:]]], minlength=len(sizes))
    # sorted turns: first and last known one, and how often they change
    at, own = turns[known], owner[known]
    fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1])])[: len(own)]
    distinct = np.bincount(own[fresh], minlength=len(sizes))
    low, high = np.searchsorted(own, np.arange(len(sizes)), "left"), np.searchsorted(own, np.arange(len(sizes)), "right") - 1
    gaps = [min(int(at[h]) - int(at[f]) + 1 - int(d), (1 << 63) - 1) if d else 0 for f, h, d in zip(low, high, distinct)]
    cost, audit = least_edits(np.where(fault >= 2, GONE, 2 * kind + (fault == 1)), sizes, costs)
    columns = [gaps, count(fault == 2), count(fault == 3), count(fault == 1), illegal, cost]
    return pa.RecordBatch.from_arrays([key, *[pa.array(c, pa.int64()) for c in columns], pa.array(audit, pa.large_string())], ["conv", *FOUND, "audit"])


def diagnose(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation of ``conv, turn, role, text, lost``."""
    kind = rows.schema["conv"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the conversation that is not at its end yet

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                at = _starts(whole.column(0))
                sizes = np.diff(np.append(at, whole.num_rows))
                turn = whole.column(1)
                numbers = [turn.fill_null(0).to_numpy(zero_copy_only=False), turn.is_valid().to_numpy(zero_copy_only=False)]
                numbers += [whole.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3)]
                yield _facts(whole.column(0).take(pa.array(at)), *numbers, sizes, costs)

        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(_starts(batch.column(0))[-1])
            if held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
                yield from done(held)
                held = []
            if last:
                yield from done([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        yield from done(held)

    schema = f"conv {kind}, " + ", ".join(f"{c} long" for c in FOUND) + ", audit string"
    return _symbols(rows).mapInArrow(work, schema)


def _line_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the digest of every repaired conversation: each conversation is a stream, its edits first."""
    types = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    facts = F.struct(*FOUND)
    none = F.lit(None)
    edits = found.select("conv", F.lit(0).alias("part"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"), facts.alias("facts"))
    lines = rows.where(~F.col("lost")).select("conv", F.lit(1).alias("part"), "turn", "role", "text", none.cast(edits.schema["facts"].dataType).alias("facts"))
    stream = edits.unionByName(lines).repartition("conv").sortWithinPartitions("conv", "part", F.col("turn").asc_nulls_first(), "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        audit = key = facts = None
        digest, at, user, first = hashlib.sha256(), 0, True, True

        def add(line: str) -> None:
            nonlocal first
            digest.update(("" if first else "\n").encode() + line.encode())
            first = False

        def inserted() -> None:
            nonlocal at, user
            while at < len(audit) and audit[at] == "I":
                add("user:" if user else "assistant:")
                at, user = at + 1, not user

        def finish() -> None:
            if audit is not None:
                inserted()
                out.append((key, facts, audit, digest.hexdigest()))

        def packed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], key_type), *[pa.array([r[1][c] for r in out], pa.int64()) for c in FOUND], pa.array([r[2] for r in out], pa.large_string()), pa.array([r[3] for r in out], pa.string())],
                ["conv", *FOUND, "audit", "digest"],
            )
            out.clear()
            return made

        for batch in batches:
            key_type = batch.schema.field(0).type
            convs, parts, facts_of = (batch.column(batch.schema.get_field_index(c)) for c in ("conv", "part", "facts"))
            for i, (part, role, text) in enumerate(zip(parts.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if part == 0:
                    finish()
                    key, facts, audit = convs[i].as_py(), facts_of[i].as_py(), text
                    digest, at, user, first = hashlib.sha256(), 0, True, True
                    continue
                inserted()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                if letter == "R":
                    role = "user" if user else "assistant"
                add(f"{role}:{text}")
                user = True if role[:1] == "s" else not user
            if out:
                yield packed()
        finish()
        if out:
            yield packed()

    schema = f"conv {types['conv']}, " + ", ".join(f"{c} long" for c in FOUND) + ", audit string, digest string"
    return stream.select("conv", "part", "role", "text", "facts").mapInArrow(work, schema)


def repair_digest(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of damaged conversations."""
    rows = damaged(conversations)
    out = _line_hashes(rows, diagnose(rows, costs))
    return out.select(F.col("conv").alias("conv_id"), *FOUND, "audit", F.col("digest").alias("repaired_sha256"))
