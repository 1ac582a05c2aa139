"""Repair of conversations: faults, cheapest edits by min-plus run-length programming, repaired texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import stored

BLANK = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States of the role initials read so far: nothing, ``s``, an open ``u``, a closed ``ua``.
START, SYSTEM, USER, DONE = range(4)
#: State after a user or assistant turn that an insert or a new role puts there.
NEXT = (USER, USER, DONE, USER)
ROLE = {USER: "user", DONE: "assistant"}
FAR = np.int64(1) << 60
#: Cost of ending in each state: inserts that close the pattern.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a matrix or a vector."""
    if b.ndim == 1:
        return np.minimum((a + b[None, :]).min(1), FAR)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def keeps(initial: str, state: int) -> int | None:
    """State after a kept row with this role initial, None if the pattern forbids it."""
    return {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, DONE: USER}, "a": {USER: DONE}}.get(initial, {}).get(state)


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> np.ndarray:
    """Costs from state to state over 2**k rows of one symbol (role initial and fault), inserts included.

    The symbols are four kinds of initials times three kinds of faults, so the cache stays small.
    """
    if k:
        half = power(symbol, k - 1)
        return min_plus(half, half)
    initial, fault = symbol
    insert = np.full((4, 4), FAR)
    for state in range(4):
        at = state
        for n in range(4):
            insert[state, at] = min(insert[state, at], n * INSERT)
            at = NEXT[at]
    row = np.full((4, 4), FAR)
    for state in range(4):
        row[state, state] = DELETE
        if fault != "x":
            cut = CUT if fault == "t" else 0
            row[state, NEXT[state]] = min(row[state, NEXT[state]], REROLE + cut)
            to = keeps(initial, state)
            if to is not None:
                row[state, to] = min(row[state, to], cut)
    return min_plus(insert, row)


def symbol_of(initial: str, fault: str) -> str:
    """One of the symbols: rows that must go are alike, and so are unknown initials."""
    return "?x" if fault == "x" else (initial if initial in ("s", "u", "a") else "?") + fault


def before(symbol: str, n: int, after: np.ndarray) -> np.ndarray:
    """Cheapest costs before a run of ``n`` equal symbols, given those after it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = min_plus(power(symbol, k), after)
    return after


def unroll(symbol: str, n: int, after: np.ndarray, state: int, out: list[str]) -> int:
    """Append the ASCII-least cheapest edits of a run that starts in ``state``; returns the state after it.

    The run is halved until one row is left; costs between the halves come from the cached powers, so
    the work is linear in the edits and the depth logarithmic.
    """
    if n > 1:
        half = n // 2
        state = unroll(symbol, n - half, before(symbol, half, after), state, out)
        return unroll(symbol, half, after, state, out)
    initial, fault = symbol
    cut = CUT if fault == "t" else 0
    now = min_plus(power(symbol, 0), after)
    while True:
        to = keeps(initial, state) if fault != "x" else None
        if now[state] == DELETE + after[state]:
            out.append("D")
            return state
        if now[state] == INSERT + now[NEXT[state]]:
            out.append("I")
            state = NEXT[state]
        elif to is not None and now[state] == cut + after[to]:
            out.append("K")
            return to
        else:
            out.append("R")
            return NEXT[state]


def cheapest(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a conversation given as runs of equal symbols.

    The audit is a word over D, I, K and R. It fixes the roles of all new turns, as after each state
    one role can follow; so the ASCII-least word is found by taking the least letter that stays cheapest.
    """
    costs = [END]
    for symbol, n in reversed(runs):
        costs.append(before(symbol, n, costs[-1]))
    costs.reverse()
    out: list[str] = []
    state = START
    for (symbol, n), after in zip(runs, costs[1:], strict=True):
        state = unroll(symbol, n, after, state, out)
    while END[state]:
        out.append("I")
        state = NEXT[state]
    return int(costs[0][START]), "".join(out)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after planted damage, chosen by crc32 of ``conv_id:turn``.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats the row and
    4 makes its role user. Null roles and texts become one space, as null parts of the crc's text do.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    return rows.filter("_d <> 0").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_d") == 3, 2).otherwise(1).alias("copies")
    )


def repair(conversations: DataFrame, every_id: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and hash of the repaired text of each conversation.

    ``conversations`` has conv_id, turn, role, text and, if rows repeat, copies; nulls in role and text
    count as one space. Rows are taken by turn (nulls first), ties by role and then by SHA-256 of the
    text. Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256,
    one row per conv_id of ``every_id`` (default: of ``conversations``), null being a conversation of
    its own; without rows: zeros, an empty audit and the hash of an empty string. A role whose first
    character is not s, u or a (or that is empty) can't be kept. An empty table gives no rows; other
    columns play no part.

    Equal rows meet map-side as one row with a count; faults are found by groups of (conversation, role,
    digest), small rows without texts. Then each conversation is one sorted stream: first its symbols,
    of which a task holds the runs, then its texts, which pass batch by batch into the running hash. A
    SHA-256 of the whole can only be taken in order, so the texts of one conversation go through one
    task, in bounded memory; what grows there is the audit, one value of the result.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies").cast("long") if "copies" in conversations.columns else F.lit(1).cast("long")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), copies.alias("copies")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))

    tail = F.rtrim("text", F.lit(BLANK))
    fault = F.when(tail == "", "x").when(F.substring(tail, -1, 1).isin(".", "!", "?"), "o").otherwise("t")
    at = ["conv_id", "turn", "role", "digest"]
    small = rows.select(*at, fault.alias("fault"), "copies").groupBy(*at, "fault").agg(F.sum("copies").alias("n"))
    small = stored(small, "conversation-symbols")
    same = ["conv_id", "role", "digest"]
    # A null turn sorts first, and so it does as the first part of a struct.
    first = small.filter("fault <> 'x'").groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_first"), F.count(F.lit(1)).alias("_turns"))
    first = stored(first.filter("_turns > 1").drop("_turns"), "conversation-repeats")
    on = F.lit(True)
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    later = F.col("_first").isNotNull() & (F.col("fault") != "x") & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    symbols = small.join(first, on, "left").select(*at, "fault", "n", later.alias("later"))

    blank = F.lit(None)
    heads = symbols.select("conv_id", F.lit(0).alias("part"), "turn", "role", "digest", "fault", "n", "later", blank.cast("string").alias("text"))
    texts = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", blank.cast("string").alias("fault"), F.col("copies").alias("n"), blank.cast("boolean").alias("later"), "text")
    stream = heads.unionByName(texts).repartition("conv_id")
    stream = stream.sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "digest")
    out = "illegal bigint, blank bigint, duplicate bigint, truncated bigint, gaps bigint, cost bigint, audit string, repaired_sha256 string"
    found = stream.select("conv_id", "part", "turn", "role", "fault", "n", "later", "text").mapInArrow(_stream, f"conv_id {kind}, {out}")
    if every_id is None:
        every_id = conversations
    ids = every_id.select(F.col("conv_id").alias("_id")).distinct()
    done = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return done.select(
        F.col("_id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


class Conversation:
    """One conversation as its sorted rows come in: symbols first, texts after them."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id = conv_id
        self.runs: list[list] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.turns = 0
        self.last: str | None = None
        self.audit: str | None = None
        self.cost, self.at, self.state = 0, 0, START
        self.hash, self.begun = hashlib.sha256(), False

    def _run(self, symbol: str, n: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([symbol, n])

    def symbols(self, turn: int | None, role: str, fault: str, n: int, later: bool) -> None:
        """``n`` equal rows; all but the first of their role and text in the conversation are duplicates."""
        initial = role[:1]
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += n - 1  # a role never follows itself
        self.last = initial
        if fault == "x":
            self.blank += n
            self._run(symbol_of(initial, "x"), n)
            return
        single = 0 if later else 1
        self.duplicate += n - single
        self.truncated += single * (fault == "t")
        if single:
            self._run(symbol_of(initial, fault), 1)
        if n > single:
            self._run("?x", n - single)

    def _turn(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + role + ":" + text).encode())
        self.begun = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self._turn(ROLE[self.state], "")
            self.at += 1

    def plan(self) -> None:
        self.cost, self.audit = cheapest([(s, n) for s, n in self.runs])
        self.runs = []

    def text(self, role: str, text: str, n: int) -> None:
        if self.audit is None:
            self.plan()
        for _ in range(n):
            self._inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = keeps(role[:1], self.state)
                self._turn(role, text)
            elif edit == "R":
                self.state = NEXT[self.state]
                self._turn(ROLE[self.state], text)

    def result(self) -> tuple:
        if self.audit is None:
            self.plan()
        self._inserts()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, self.illegal, self.blank, self.duplicate, self.truncated, gaps, self.cost, self.audit, self.hash.hexdigest())


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of rows sorted by conversation, part and place."""
    now: Conversation | None = None
    kind = None
    names = ["conv_id", "illegal", "blank", "duplicate", "truncated", "gaps", "cost", "audit", "repaired_sha256"]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [kind, *types], strict=True)], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        done = []
        columns = [batch.column(i).to_pylist() for i in range(7)]
        text = batch.column(7)
        for i, (conv_id, part, turn, role, fault, n, later) in enumerate(zip(*columns, strict=True)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.result())
                now = Conversation(conv_id)
            if part == 0:
                now.symbols(turn, role, fault, n, later)
            else:
                now.text(role, text[i].as_py(), n)
        yield batch_of(done)
    if now is not None:
        yield batch_of([now.result()])
