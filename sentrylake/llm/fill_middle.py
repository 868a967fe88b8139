"""Fill-in-the-middle: a text is cut in three, and its middle goes to the end behind marks.

One regular expression makes all three parts.  ``regexp_count`` gives the
number of units of a text; two cuts a <= b of that count are written into the row's own
pattern, ``(unit{a}+)(unit{b-a}+)(.*+)``, whose quantifiers are exact and
possessive, so the match goes once over the text and never back.  A
``regexp_replace`` with the form's order of groups writes the result.

All of it is built-in columns: no shuffle, and no row depends on another.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, free_name, text_or_empty

#: A unit is a code point, line ends included; it must match every character that it is tried at.
UNIT = r"(?s:.)"
#: Units that are counted as one match.
BLOCK = 1_024
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def draws(key: Column, seed: int = 1, n: int = 4) -> Column:
    """Array of ``n`` (8 at most) unsigned 32-bit integers: 8-digit groups of the hex SHA-256 of ``seed:key``.  A null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(digest), lambda d: F.array(*(F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n))))[0]


def count_units(text: Column, unit: str = UNIT) -> Column:
    """Number of units, counted by blocks of ``BLOCK``, as a count of single units would hold an object for each of them."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?:{unit}){{1,{BLOCK}}}+"), F.lit(0))
    n = bound(blocks, lambda b: F.when(F.size(b) == 0, F.lit(0)).otherwise((F.size(b) - 1) * BLOCK + F.regexp_count(F.element_at(b, -1), F.lit(unit))))
    return n.cast("long")


def has_mark(text: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """Whether any mark stands in ``text``; such a text could not be restored."""
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(text, F.lit(mark))
    return found


def pattern(prefix: Column, middle: Column, unit: str = UNIT) -> Column:
    """The row's pattern: ``prefix`` units, ``middle`` units and the rest, each in a group."""
    return F.format_string(rf"\A((?:{unit}){{%d}}+)((?:{unit}){{%d}}+)((?s:.*+))\z".replace("%", "%%").replace("%%d", "%d"), prefix, middle)


def _order(form: Column, marks: tuple[str, str, str]) -> Column:
    p, s, m = (mark.replace("\\", r"\\").replace("$", r"\$") for mark in marks)
    return F.when(form == "spm", F.lit(f"{s}$3{p}$1{m}$2")).otherwise(F.lit(f"{p}$1{s}$3{m}$2"))


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    new: str = "fim",
    seed: int = 1,
    rate: int = 90,
    spm_rate: int = 20,
    unit: str = UNIT,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``docs`` and a struct ``new``: n (units of the text), form, prefix and middle (units), output.

    The cuts, the form and its rate (``rate`` and ``spm_rate`` of 100) come from
    ``draws`` of the id and the seed, so a rerun or a retried task gives the
    same rows.  form: plain (the text itself), psm (prefix, suffix, middle) or
    spm (suffix, prefix, middle).

    A null text counts as empty; empty texts and those that hold a mark stay
    plain, with null prefix and middle.  A null id draws as an empty id.
    Repeated rows get equal outputs; texts may be of any length: the match is
    one pass without a way back.  All columns are kept whatever their names,
    but for one named ``new``, which is replaced.  An empty table gives an
    empty table.
    """
    docs = docs.drop(new)
    text, h, n, cuts, form = (free_name(docs, f"fim_{x}") for x in ("text", "draws", "n", "cuts", "form"))
    of = lambda name: F.col(name)
    drawn = docs.withColumn(text, text_or_empty(text_col)).withColumn(h, draws(F.col(id_col), seed)).withColumn(n, count_units(of(text), unit))
    ends = F.array_sort(F.array(of(h)[0] % (of(n) + 1), of(h)[1] % (of(n) + 1)))
    plain = (of(text) == "") | has_mark(of(text), marks) | (of(h)[2] % 100 >= rate)
    drawn = drawn.withColumn(form, F.when(plain, F.lit("plain")).when(of(h)[3] % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm"))).withColumn(cuts, ends)
    cut = of(form) != "plain"
    prefix, middle = of(cuts)[0], of(cuts)[1] - of(cuts)[0]
    output = F.when(cut, F.regexp_replace(of(text), pattern(prefix, middle, unit), _order(of(form), marks))).otherwise(of(text))
    made = F.struct(of(n).alias("n"), of(form).alias("form"), F.when(cut, prefix).alias("prefix"), F.when(cut, middle).alias("middle"), output.alias("output"))
    return drawn.withColumn(new, made).select(*docs.columns, new)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output of ``transform``; an output without its form's marks stays as it is."""
    p, s, m = map(re.escape, marks)
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
