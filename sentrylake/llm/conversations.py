"""Repair of conversation structure by weighted interval parsing.

The grammar of a repaired conversation's role initials, ``(s?(ua)+)?``, is in
Chomsky normal form: a nonterminal [p, q] stands for "leads the automaton from
state p to state q", with rules [p, q] -> [p, r] [r, q] and, for a single row,
what one edit of it yields.  The cell of a span holds, for each nonterminal,
the least (cost, audit) of repairing the span's rows to it.  Inserted rows are
a closure: cells of the empty span, multiplied to each leaf on both sides.

Cells are combined bottom-up, spans of one row first, then of two, four and so
on.  As the language is regular, the cell of a span is the same for every
split, so one split a span is enough, and the chart has as many cells as rows.
(The least audit of a product is the product of the least audits: two audits
of one span and one cost cannot be prefixes of each other, as each letter of a
row and each I adds its cost.)

A conversation of bounded size is parsed in the task that holds its rows.  A
longer one is cut into blocks of rows by sorted ranges, so it spreads over
many tasks: its blocks' cells are made apart, combined by ``FAN`` adjacent spans
a round, and the least audit is dealt to the blocks again, which repair their
rows.  Only the digest of a repaired text, a chain by its nature, then goes over a
conversation's blocks in order, with a block in memory at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import checkpointed, stored

#: Rows and bytes of a conversation that one task repairs at once, and of a block of a longer one.
MAX_ROWS, MAX_BYTES = 1_024, 8 << 20
#: Adjacent spans that are combined in one round.
FAN = 64
#: States of the automaton: nothing yet, behind s, behind u, behind a pair.
STATES, FINAL = range(4), (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Classes of rows as one letter each: the initial of a sound row (x: any other), upper case if it is truncated, d if it must go.
MUST_GO = "d"


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of (conv_id, turn, role, text) after the stated damage, by crc32 of ``conv_id:turn`` mod 20."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(code == 4, F.lit("user")).otherwise(spaced("role"))
    times = F.explode(F.when(code == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(1))))
    return rows.where(code != 0).select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def row_class(role: str, text: str, seen: bool) -> tuple[str, str]:
    """(class, fault) of a row; fault: blank, duplicate, truncated or empty."""
    last = text.rstrip(BLANK)[-1:]
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    if not last:
        return MUST_GO, "blank"
    if seen:
        return MUST_GO, "duplicate"
    return (initial, "") if last in ENDS else (initial.upper(), "truncated")


def _least(cells: list[dict]) -> dict:
    out: dict = {}
    for cell in cells:
        for k, v in cell.items():
            if k not in out or v < out[k]:
                out[k] = v
    return out


def product(left: dict, right: dict) -> dict:
    """The cell of two adjacent spans: the least (cost, audit) by the rules [p, q] -> [p, r] [r, q]."""
    out: dict = {}
    for (p, r), (a, x) in left.items():
        for q in STATES:
            if (r, q) in right:
                b, y = right[r, q]
                if (p, q) not in out or (a + b, x + y) < out[p, q]:
                    out[p, q] = (a + b, x + y)
    return out


@lru_cache(maxsize=1)
def insertions() -> dict:
    """The cell of the empty span: nothing, or any number of inserted rows; closed when another insertion changes nothing."""
    cell = {(p, p): (0, "") for p in STATES}
    one = {(p, q): (INSERT, "I") for (p, initial), q in STEP.items() if initial in ROLES}
    while (wider := _least([cell, product(cell, one)])) != cell:
        cell = wider
    return cell


@lru_cache(maxsize=64)
def leaf(letter: str) -> dict:
    """The cell of one row of a class: keep, rerole or delete, and insertions on both sides."""
    edits = [{(p, p): (DELETE, "D") for p in STATES}]
    if letter != MUST_GO:
        more = TRUNCATED if letter.isupper() else 0
        edits.append({(p, q): (KEEP + more, "K") for (p, initial), q in STEP.items() if initial == letter.lower()})
        edits.append({(p, q): (REROLE + more, "R") for (p, initial), q in STEP.items() if initial in ROLES})
    return product(product(insertions(), _least(edits)), insertions())


@lru_cache(maxsize=50_000)
def _short_cell(letters: str) -> dict:
    if len(letters) < 2:
        return leaf(letters) if letters else insertions()
    half = 1 << (len(letters) - 1).bit_length() - 1
    return product(_short_cell(letters[:half]), _short_cell(letters[half:]))


def combined(cells: list[dict]) -> dict:
    """The cell of adjacent spans, bottom-up: pairs, pairs of pairs and so on."""
    while len(cells) > 1:
        cells = [product(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else insertions()


def span_cell(letters: str) -> dict:
    """The cell of a span of rows, given by their classes.  Short spans recur, so their cells are kept."""
    return combined([_short_cell(letters[i : i + 16]) for i in range(0, len(letters), 16)])


def best(cell: dict) -> tuple[int, str]:
    return min(cell[0, q] for q in FINAL if (0, q) in cell)


def repaired(rows: list[tuple[str, str]], audit: str, before: int, odd: bool) -> Iterator[str]:
    """The lines of the rows that an audit leaves.  before: rows that stay ahead of these; odd: whether a system row stands first in the whole."""
    left = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter != "K":
            role = "user" if (before - odd) % 2 == 0 else "assistant"
        before += 1
        yield f"{role}:{text}"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))


def _gaps(turns: list[str | None]) -> int:
    known = {int(t) for t in turns if t is not None}
    return min(max(known) - min(known) + 1 - len(known), (1 << 63) - 1) if known else 0


_RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, digest binary"
_FAULTS = ("blank", "duplicate", "truncated")


def _order() -> list[Column]:
    """Turn, nulls first; rows of one turn by role and text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _whole(rows: DataFrame) -> DataFrame:
    """The repair of conversations of bounded size, each in the task that holds its rows."""

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(conv, turns: list, rows: list[tuple[str, str]]):
            seen: set = set()
            letters, faults = "", dict.fromkeys(_FAULTS, 0)
            for row in rows:
                letter, fault = row_class(*row, row in seen)
                seen.add(row)
                letters += letter
                if fault:
                    faults[fault] += 1
            cost, audit = best(span_cell(letters))
            stay = len(audit) - audit.count("D")
            text = "\n".join(repaired(rows, audit, 0, stay % 2 == 1))
            return (conv, _gaps(turns), *faults.values(), _illegal([r[:1] for r, _ in rows]), cost, audit, hashlib.sha256(text.encode()).digest())

        now, turns, rows = None, [], []
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(batch["conv"], batch["turn"], batch["role"], batch["text"]):
                if rows and conv != now:
                    out.append(one(now, turns, rows))
                    turns, rows = [], []
                now = conv
                turns.append(turn)
                rows.append((role, text))
            yield pd.DataFrame(out, columns=names, dtype=object)
        if rows:
            yield pd.DataFrame([one(now, turns, rows)], columns=names, dtype=object)

    names = ["conv", "gaps", *_FAULTS, "illegal", "cost", "audit", "digest"]
    # equal rows of one turn differ in nothing, so their order does not matter
    placed = rows.repartition("conv").sortWithinPartitions("conv", *_order())
    # a long with nulls would reach pandas as a double
    return placed.withColumn("turn", F.col("turn").cast("string")).mapInPandas(repair, _RESULT)


def _blocks(rows: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """(conv, block, roles, texts, keys) of long conversations, blocks numbered from 0 in their order; keys are digests of role and text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, conv_now, roles, texts, size = None, 0, None, [], [], 0

        def block():
            return pd.DataFrame([(conv_now, part, n, roles, texts, [hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for r, t in zip(roles, texts)])], columns=["conv", "part", "n", "roles", "texts", "keys"], dtype=object)

        for batch in batches:
            for conv, here, role, text in zip(batch["conv"], batch["part"], batch["role"], batch["text"]):
                if roles and (conv != conv_now or len(roles) >= max_rows or size >= max_bytes):
                    yield block()
                    n, roles, texts, size = n + 1, [], [], 0
                part, conv_now = int(here), conv
                roles.append(role)
                texts.append(text)
                size += len(text)
        if roles:
            yield block()

    # a tie beyond the text only spreads equal rows over tasks; it is written, so that a task that runs again deals them alike
    keyed = stored(rows.withColumn("tie", F.monotonically_increasing_id()))
    keys = [F.col("conv"), *_order(), F.col("tie")]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    cuts = stored(placed.mapInPandas(cut, "conv string, part int, n long, roles array<string>, texts array<string>, keys array<binary>"))
    # a row for each block, not for each row of the conversation
    number = F.row_number().over(Window.partitionBy("conv").orderBy("part", "n")) - 1
    numbers = cuts.select("conv", "part", "n").withColumn("block", number.cast("long")).drop("conv")
    return cuts.join(numbers, ["part", "n"]).drop("part", "n")


_CELL = "array<struct<p:int,q:int,cost:long,audit:string>>"


def _pack(cell: dict) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in cell.items()]


def _unpack(cells) -> dict:
    return {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cells}


def _in_blocks(rows: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """The repair of long conversations, spread by blocks of their rows."""
    blocks = stored(_blocks(rows, max_rows, max_bytes))
    each = blocks.select("conv", "block", F.posexplode("keys").alias("i", "key"))
    first = each.groupBy("conv", "key").agg(F.min(F.struct("block", "i")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = each.join(first, ["conv", "key"]).where(F.struct("block", "i") > F.col("first")).groupBy("conv", "block").agg(F.collect_list("i").alias("again"))

    @F.pandas_udf(f"letters string, blank long, duplicate long, truncated long, illegal long, head string, tail string, cell {_CELL}")
    def parse(roles: pd.Series, texts: pd.Series, again: pd.Series) -> pd.DataFrame:
        out = []
        for r, t, gone in zip(roles, texts, again):
            gone = set() if gone is None else set(gone)
            classes = [row_class(a, b, i in gone) for i, (a, b) in enumerate(zip(r, t))]
            letters = "".join(c for c, _ in classes)
            faults = [sum(f == fault for _, f in classes) for fault in _FAULTS]
            out.append((letters, *faults, _illegal([a[:1] for a in r]), r[0][:1], r[-1][:1], _pack(span_cell(letters))))
        return pd.DataFrame(out, columns=["letters", *_FAULTS, "illegal", "head", "tail", "cell"])

    marked = blocks.join(again, ["conv", "block"], "left")
    parsed = stored(marked.select("conv", "block", parse("roles", "texts", "again").alias("parsed")).select("conv", "block", "parsed.*"))

    def folded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("span")
        cell = combined([_unpack(c) for c in group["cell"]])
        return pd.DataFrame({"conv": group["conv"].iloc[:1], "span": group["up"].iloc[:1], "cell": [_pack(cell)]})

    spans, many = parsed.select("conv", F.col("block").alias("span"), "cell"), parsed.agg(F.max("block")).first()[0] or 0
    while many:
        many //= FAN
        spans = checkpointed(spans.withColumn("up", F.floor(F.col("span") / FAN)).groupBy("conv", "up").applyInPandas(folded, f"conv string, span long, cell {_CELL}"))

    @F.pandas_udf("cost long, audit string")
    def least(cells: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(_unpack(c)) for c in cells], columns=["cost", "audit"])

    found = checkpointed(spans.select("conv", least("cell").alias("best")).select("conv", "best.*"))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The part of the audit that is a block's: its letters but I are as many as its rows."""
        for batch in batches:
            for conv, audit, lengths in zip(batch["conv"], batch["audit"], batch["lengths"]):
                odd, at, before, parts = (len(audit) - audit.count("D")) % 2 == 1, 0, 0, []
                for n in lengths:
                    end = at
                    while n:
                        n -= audit[end] != "I"
                        end += 1
                    parts.append((audit[at:end], before))
                    at, before = end, before + end - at - audit.count("D", at, end)
                # what is inserted behind the last row
                parts[-1] = (parts[-1][0] + audit[at:], parts[-1][1])
                yield pd.DataFrame({"conv": conv, "block": range(len(parts)), "part": [p for p, _ in parts], "before": [b for _, b in parts], "odd": odd})

    lengths = parsed.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", F.length("letters").alias("n")))), lambda b: b["n"]).alias("lengths"))
    parts = found.join(lengths, "conv").mapInPandas(dealt, "conv string, block long, part string, before long, odd boolean")

    @F.pandas_udf("binary")
    def lines(roles: pd.Series, texts: pd.Series, part: pd.Series, before: pd.Series, odd: pd.Series) -> pd.Series:
        return pd.Series(["".join(f"\n{x}" for x in repaired(list(zip(r, t)), p, b, o)).encode() for r, t, p, b, o in zip(roles, texts, part, before, odd)])

    written = blocks.join(parts, ["conv", "block"]).select("conv", "block", lines("roles", "texts", "part", "before", "odd").alias("lines"))

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chain, first = None, hashlib.sha256(), True
        for batch in batches:
            out = []
            for conv, block in zip(batch["conv"], batch["lines"]):
                if conv != now:
                    out += [] if now is None else [(now, chain.digest())]
                    now, chain, first = conv, hashlib.sha256(), True
                # the first line has no line end before it
                chain.update(block[1:] if first else block)
                first = first and not block
            yield pd.DataFrame(out, columns=["conv", "digest"], dtype=object)
        if now is not None:
            yield pd.DataFrame([(now, chain.digest())], columns=["conv", "digest"], dtype=object)

    digests = written.repartition("conv").sortWithinPartitions("conv", "block").mapInPandas(chained, "conv string, digest binary")
    seam = (~F.concat("tail", F.lead("head").over(Window.partitionBy("conv").orderBy("block"))).isin(*LEGAL_PAIRS)).cast("long")
    edges = parsed.select("conv", "block", *_FAULTS, "illegal", "head", "tail").withColumn("seam", F.coalesce(seam, F.lit(0)))
    counts = edges.groupBy("conv").agg(*(F.sum(f).alias(f) for f in _FAULTS), F.sum(F.col("illegal") + F.col("seam")).alias("illegal"))
    turns = rows.groupBy("conv").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.countDistinct("turn").alias("n"))
    # decimals, as two longs may be further apart than a long can say
    span = F.col("hi").cast("decimal(38,0)") - F.col("lo") + 1 - F.col("n")
    gaps = turns.select("conv", F.when(span.isNull(), F.lit(0)).otherwise(F.least(span, F.lit((1 << 63) - 1))).cast("long").alias("gaps"))
    out = found.join(counts, "conv").join(gaps, "conv").join(digests, "conv")
    return out.select("conv", "gaps", *_FAULTS, "illegal", "cost", "audit", "digest")


def repair(rows: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The repair of each conversation of ``rows``: conv, turn, role, text (none of them null but for conv and turn).

    Returns conv, gaps, blank, duplicate, truncated, illegal, cost, audit and
    digest (SHA-256 of the repaired ``role:text`` lines).  Rows are taken by
    turn, nulls first, rows of one turn by role and text.  Conversations of up
    to ``max_rows`` rows and ``max_bytes`` bytes are repaired in one task each,
    longer ones in blocks of that size; both give the same rows.

    A null conv is a conversation.  Repeated rows are duplicates.  A role that
    is empty or starts with another letter than s, u or a cannot be kept.
    Other columns are not looked at.  An empty table gives an empty table.
    """
    conv_type = rows.schema["conv"].dataType
    # a name that is never null; ids of any type come back as they were
    name = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    rows = rows.select(name.alias("conv"), "turn", "role", "text")
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = checkpointed(sizes.where((F.col("n") > max_rows) | (F.col("bytes") > max_bytes)).select("conv"))
    if long.isEmpty():
        found = _whole(rows)
    else:
        short, rest = rows.join(long, "conv", "left_anti"), rows.join(long, "conv", "left_semi")
        found = _whole(short).unionByName(_in_blocks(rest, max_rows, max_bytes))
    return found.withColumn("conv", F.when(F.col("conv") != "", F.substring("conv", 2, (1 << 31) - 1)).cast(conv_type))
