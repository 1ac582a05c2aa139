"""Conversation repair against a plain search over all edits and against the rules read row by row."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from headway.llm import conversations
from headway.llm.queries import QUERIES

INK = re.compile(r"[^\x20\x09-\x0D]")
SF = "/root/testdata/sf0.01"


def damage(rows):
    """(conv_id, turn, role, text) after damage, as the task states it."""
    out = []
    space = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        role, text = space(role), space(text)
        d = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def search(rows):
    """Cheapest (cost, audit, texts) by best-first search over (row, roles so far)."""
    heap = [(0, "", 0, "", ())]
    seen = {}
    while heap:
        cost, audit, i, roles, texts = heapq.heappop(heap)
        tail = roles[-2:] if not roles.startswith("s") or len(roles) > 2 else roles
        key = (i, roles == "", tail)
        if seen.get(key, (cost, audit)) < (cost, audit):
            continue
        seen[key] = (cost, audit)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, texts
        steps = [(2, "I", i, "user", ""), (2, "I", i, "assistant", "")]
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, texts))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                steps += [(cut, "K", i + 1, role, text), (2 + cut, "R", i + 1, "user", text), (2 + cut, "R", i + 1, "assistant", text)]
        for price, letter, to, role, text in steps:
            more = roles + role[:1] if role[:1] else "-"
            if re.fullmatch("s?(ua)*u?", more):
                heapq.heappush(heap, (cost + price, audit + letter, to, more, (*texts, f"{role}:{text}")))
    raise AssertionError


def expected(rows):
    """All columns of one conversation, row by row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, marked, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, _, role, text in rows:
        ink = INK.findall(text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        count[fault] += 1
        marked.append((role, text, fault))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    cost, audit, texts = search(marked)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())


def compare(result, rows, ids):
    got = {r.conv_id: tuple(r)[1:] for r in result.collect()}
    groups = {i: [] for i in ids}
    for r in rows:
        groups[r[0]].append(r)
    assert set(got) == set(groups)
    for i, mine in groups.items():
        assert got[i] == expected(mine), (i, mine)


def test_whole_table_against_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(QUERIES["op11_conversation_repair"](spark, SF), damage(rows), {r[0] for r in rows})


def test_odd_conversations(spark):
    """Null ids, turns, roles and texts, ties, repeats, unknown roles, blank texts, a long run."""
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.randrange(1, 9)):
            turn = rng.choice([None, 0, 1, 2, 3, 5, 9])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No", "a.b ", "", None, " \t\n", "Wait!\n", "é?", "so .x ", "Yes."])
            rows.append((conv, turn, role, text))
    rows += [rows[5]] * 3
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, n bigint, fault string")
    compare(conversations.repair(conversations.damaged(frame), frame), damage(rows), {r[0] for r in rows})
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    compare(conversations.repair(frame), plain, {r[0] for r in rows})
    assert conversations.repair(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_search(seed):
    rng = random.Random(seed)
    symbols = ["so", "uo", "ao", "?o", "st", "ut", "at", "?t", "?x"]
    name = {"o": "", "t": "truncated", "x": "blank"}
    for _ in range(25):
        runs = [(rng.choice(symbols), rng.randrange(1, 5)) for _ in range(rng.randrange(0, 4))]
        rows = [(s[0], "t", name[s[1]]) for s, n in runs for _ in range(n)]
        assert conversations.cheapest(runs) == search(rows)[:2]


def test_a_very_long_run():
    cost, audit = conversations.cheapest([("uo", 100_001)])
    # each further user turn gets an empty answer (2) or becomes the answer (2 for two rows)
    assert cost == 100_002 and len(audit) == 100_002 and set(audit) <= set("DIKR")
    assert conversations.cheapest([("?x", 70_000)]) == (210_000, "D" * 70_000)


def test_one_large_conversation(spark):
    """Half of all rows in one conversation, many of them alike."""
    rows = [(1, i // 3, ("user", "assistant")[i // 5 % 2], f"Line {i % 50}.") for i in range(400)] + [(i, 0, "user", "Hm") for i in range(2, 300)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in conversations.repair(frame).collect()}
    assert len(got) == 299 and got[1].duplicate == 400 - len({(r, t) for _, _, r, t in rows[:400]})
    assert got[7][1:8] == (0, 0, 0, 1, 0, 3, "D")
