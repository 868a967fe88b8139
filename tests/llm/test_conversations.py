"""Repaired conversations against a search over all edits, in one task and in blocks."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sentrylake.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, conv string, cost string, letters string"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """The rows by conversation, after damage and in order."""
    out = {}
    for conv, turn, role, text in rows:
        part = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        part += [] if code == 0 else [(turn, role, text)] * (2 if code == 3 else 1)
    return {c: sorted(p, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, p in out.items()}


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def search(rows, faults):
    """(cost, audit, lines) by uniform-cost search over edits, the least audit first; no grammar but the pattern itself."""
    ahead = lambda s: any(LEGAL.fullmatch(s + more) for more in ("", "ua", "a"))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        # what is legal behind them depends on the last initial and on whether there is any
        state = (i, initials[-1:], len(initials) == 1)
        if i == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, lines
        if state in done:
            continue
        done.add(state)
        nexts = [(2, "I", i, x, (f"{name}:",)) for x, name in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            _, role, text = rows[i]
            nexts.append((3, "D", i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                nexts.append((more, "K", i + 1, role[:1] or "?", (f"{role}:{text}",)))
                nexts += [(2 + more, "R", i + 1, x, (f"{name}:{text}",)) for x, name in (("u", "user"), ("a", "assistant"))]
        for add, letter, j, x, line in nexts:
            if not x or ahead(initials + x):
                # of the initials only an end is needed, of odd or even length as before
                s = initials + x
                heapq.heappush(heap, (cost + add, audit + letter, j, s if len(s) < 5 else s[:1] * (s[0] == "s") + s[-2:] if s[-1] == "a" else s[:1] * (s[0] == "s") + "u", lines + line))
    raise AssertionError("no repair")


def plain(rows):
    out = []
    for conv, part in damaged(rows).items():
        faults = faults_of(part)
        cost, audit, lines = search(part, faults)
        turns = {t for t, _, _ in part if t is not None}
        initials = [r[:1] for _, r, _ in part]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, seed, longest=9):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(1, longest)):
            role = draw.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "u"])
            text = draw.choice(["Yes.", "No?", "well", None, "", " \n", "So it is!  ", "one. two", f"turn {draw.randrange(40)}."])
            rows.append((conv, draw.choice([turn, turn, turn, None, turn * 3, 2]), role, text))
    return rows


AWKWARD = [
    (None, None, None, None), (None, None, "user", "Hello."), (None, 3, "assistant", "Hi!"), (900, -(1 << 63), "user", "Far."), (900, (1 << 63) - 1, "assistant", "Away."),
    (901, (1 << 53) + 1, "user", "a."), (901, (1 << 53) + 3, "assistant", "b."), (901, None, "system", "c."), ((1 << 53) + 1, 1, "user", "x" * 200_000), (902, 1, "user", "Twin."), (902, 1, "user", "Twin."),
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("conversations"))
    rows = made(300, 1) + AWKWARD
    spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return folder


def read(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


ORDER = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(rows, want):
    got = sorted((tuple(r) for r in rows), key=str)
    far = (1 << 63) - 1
    want = sorted(((w[0], min(w[1], far), *w[2:]) for w in want), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b


@pytest.mark.parametrize("of", ["table", "awkward"])
def test_repairs(spark, sf, awkward, of):
    folder = sf if of == "table" else awkward
    check(queries.op11_conversation_repair(spark, folder).select(*ORDER).collect(), plain(read(spark, folder)))


@pytest.mark.parametrize("max_rows, max_bytes", [(1, 1 << 20), (3, 1 << 20), (4, 30)])
def test_long_conversations_in_blocks(spark, awkward, max_rows, max_bytes):
    rows = conversations.damage(spark.read.parquet(f"{awkward}/conversations.parquet").where("conv_id is null or conv_id < 90 or conv_id >= 300"))
    out = conversations.repair(rows, max_rows, max_bytes)
    there = {r["conv"] for r in rows.select("conv").distinct().collect()}
    want = [w for w in plain(read(spark, awkward)) if w[0] in there]
    check(out.withColumn("repaired_sha256", F.lower(F.hex("digest"))).withColumnRenamed("conv", "conv_id").select(*ORDER).collect(), want)


def test_hot_conversation(spark, monkeypatch):
    """One conversation with most of the rows goes through several rounds of adjacent spans."""
    monkeypatch.setattr(conversations, "FAN", 4)
    draw = random.Random(5)
    rows = [(7, t // 2, draw.choice(["user", "assistant", "user", "assistant", "tool"]), draw.choice(["Yes.", "well", f"number {t}.", ""])) for t in range(1_500)] + made(20, 9)[:60]
    out = conversations.repair(conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)), 20, 1 << 20)
    check(out.withColumn("repaired_sha256", F.lower(F.hex("digest"))).withColumnRenamed("conv", "conv_id").select(*ORDER).collect(), plain(rows))


def test_cells_do_not_depend_on_the_split():
    draw = random.Random(3)
    for _ in range(60):
        letters = "".join(draw.choice("suaxSUAXd") for _ in range(draw.randrange(2, 14)))
        whole = conversations.span_cell(letters)
        cut = draw.randrange(1, len(letters))
        assert conversations.product(conversations.span_cell(letters[:cut]), conversations.span_cell(letters[cut:])) == whole


def test_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damage(rows)).collect() == []
