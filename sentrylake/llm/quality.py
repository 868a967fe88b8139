"""Quality rules: base counts, and divergence of a document's histograms from its language's.

Two histograms of a document's words are compared to its language's: of
character classes (by code points) and of the language's most common words
(lower-cased, with one bin for all others).  The references are those of all
documents of the language together.
A language of fewer than ``min_words`` words has no reference and its documents
are not judged by divergence; only documents without a language are compared to
the whole corpus.  The measure is the Jensen-Shannon distance (base 2, 0 to 1).
A document that is too short for a histogram is not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import checkpointed
from .common import SPACE, bound, free_name, words

#: Fixed values of the base counts.
SYMBOLS = r"[#*$%&|<>]+"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

COMMON_WORDS = 24
#: Words are first counted by so many values of their hash, of which so many are looked into at first.
BUCKETS, FIRST_BUCKETS = 1 << 16, 256
#: Words that a language needs for a reference, whatever lies beside it.
MIN_REFERENCE_WORDS = 5_000
#: A table of more references is joined, not broadcast.
MAX_BROADCAST = 10_000
MAX_BROADCAST_BUCKETS = 200_000
#: Guards: code points of words for the character classes, words for the common words.
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 80, 50
#: Distances above these are rejected.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.27, 0.36
#: Character classes in the order in which they are taken away: each removes its runs from what the others left.
SPACE_CLASS, SYMBOL_CLASS = 1, 5
CLASSES = (r"\p{Ll}+", SPACE, r"\p{Lu}+", r"\p{N}+", r"""[.,;:!?'"()-]+""", SYMBOLS)
POOLED = "*"


def _char_counts(text: Column) -> Column:
    """Array of the code points of each class and, last, of none of them."""

    def left(rest: Column, patterns: tuple[str, ...], sizes: list[Column]) -> Column:
        sizes = [*sizes, F.char_length(rest)]
        if not patterns:
            return F.array(*(a - b for a, b in zip(sizes, sizes[1:])), sizes[-1])
        # bound by a lambda, so that each class's removal is done once
        return F.transform(F.array(F.regexp_replace(rest, patterns[0], "")), lambda r: left(r, patterns[1:], sizes))[0]

    return left(text, CLASSES, [])


def _windows(w: Column) -> Column:
    """A hash of each window of five words, from the words' hashes."""

    def of(h: Column) -> Column:
        grams = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))
        return F.slice(grams, F.lit(1), F.greatest(F.lit(0), F.size(h) - (WINDOW - 1)))

    return bound(F.transform(w, lambda x: F.xxhash64(x)), of)


def _repeat_words(w: Column) -> Column:
    """Words in a window of five words that is found twice or more in the text."""

    def covered(g: Column) -> Column:
        at = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            last = F.size(s) - 1

            def twice(x: Column, j: Column) -> Column:
                return ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])) | ((j < last) & (F.get(s, F.least(j + 1, last))["h"] == x["h"]))

            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

        def length(p: Column) -> Column:
            # each window covers its words up to the next window's first
            steps = F.transform(p, lambda a, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - a, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

        found = F.transform(F.array(F.transform(F.array(at), positions)[0]), length)[0]
        # most texts repeat nothing, which a hash set tells sooner than a sort
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(found)

    return F.transform(F.array(_windows(w)), covered)[0].cast("long")


def _dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""

    def of(lines: Column) -> Column:
        def without_blank(x: Column) -> Column:
            return F.size(x) - F.size(F.array_distinct(x))

        worded = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return F.when(F.size(F.array_distinct(lines)) == F.size(lines), F.lit(0)).otherwise(F.transform(F.array(worded), without_blank)[0])

    return F.transform(F.array(F.split(text, "\n")), of)[0].cast("long")


def _base(t: Column, w: Column, chars: Column) -> list[Column]:
    """The base counts of a text, its words and its character counts."""
    return [
        F.size(w).cast("long").alias("n_words"),
        (F.char_length(t) - chars[SPACE_CLASS]).cast("long").alias("word_chars"),
        chars[SYMBOL_CLASS].cast("long").alias("n_symbols"),
        _dup_lines(t).alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
    ]


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def _with_pooled(df: DataFrame) -> DataFrame:
    """Every count belongs to its language and to the pooled reference."""
    return df.withColumn("lang", F.explode(F.array_distinct(F.array("lang", F.lit(POOLED)))))


def common_words(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", n: int = COMMON_WORDS, buckets: int = BUCKETS, first: int = FIRST_BUCKETS) -> DataFrame:
    """(lang, total, top): the words of each language and of ``*``, and its first n, as structs (-c, word), by count, ties to the lesser.

    Words are lower-cased and of any length.  The rare ones are never shuffled:
    all are counted by buckets of their hash, and one by one only in the largest
    buckets.  A word has at most its bucket's count, so the first n are exact once
    the n-th of them has more than the largest bucket left out; until then more
    buckets are looked into.
    """
    each = docs.select(F.coalesce(F.col(lang_col), F.lit(POOLED)).alias("lang"), F.explode(words(F.col(text_col))).alias("w")).select("lang", F.lower("w").alias("word"))
    each = each.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    by_bucket = checkpointed(_with_pooled(each.groupBy("lang", "bucket").agg(F.count("*").alias("c"))).groupBy("lang", "bucket").agg(F.sum("c").alias("c")))
    ranked = checkpointed(by_bucket.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "bucket"))))
    total = ranked.groupBy("lang").agg(F.sum("c").alias("total"), F.max("r").alias("most"))
    while True:
        chosen = checkpointed(ranked.where(F.col("r") <= first).select("lang", "bucket"))
        # a row for each bucket, with the languages that look into it; a word of any language may be common in the whole corpus
        looked = chosen.groupBy("bucket").agg(F.collect_set("lang").alias("langs")).withColumn("all", F.array_contains("langs", POOLED))
        few = chosen.limit(MAX_BROADCAST_BUCKETS + 1).count() <= MAX_BROADCAST_BUCKETS
        near = each.join(F.broadcast(looked) if few else looked, "bucket").where(F.col("all") | F.array_contains("langs", F.col("lang")))
        counts = near.groupBy("lang", "bucket", "word").agg(F.count("*").alias("c"))
        counts = _with_pooled(counts).groupBy("lang", "bucket", "word").agg(F.sum("c").alias("c")).join(chosen, ["lang", "bucket"], "left_semi")
        # the first n of each of 64 parts, then of all, so that no task sorts a language's words
        best = Window.partitionBy("lang", F.pmod("bucket", F.lit(64))).orderBy(F.desc("c"), "word")
        item = F.struct((-F.col("c")).alias("c"), "word")
        tops = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n).groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(item)), 1, n).alias("top"))
        tops = checkpointed(tops.join(total, "lang"))
        left = ranked.where(F.col("r") == first + 1).select("lang", F.col("c").alias("left"))
        open_ = tops.join(left, "lang").where((F.size("top") < n) | (-F.element_at("top", -1)["c"] <= F.col("left")))
        if open_.isEmpty():
            return tops.select("lang", "total", "top")
        first *= 8


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_words: int = MIN_REFERENCE_WORDS) -> DataFrame:
    """(lang, common, longest, word_ref, char_ref) of each language of ``min_words`` words, and ``*`` for the whole corpus.

    common: the first words by count, ties to the lesser; longest: the code points of the longest; word_ref: their shares and, last, that of all other words;
    char_ref: the shares of the character classes among the characters of
    words.  Counts cover all documents.  The table is checkpointed:
    several joins read it, and it has a row for each language.
    """
    k = len(CLASSES) + 1

    tops = common_words(docs, lang_col, text_col)
    chars = docs.select(F.coalesce(F.col(lang_col), F.lit(POOLED)).alias("lang"), _char_counts(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
    chars = chars.groupBy("lang").agg(*(F.sum(F.col("n")[i].cast("long")).alias(f"c{i}") for i in range(k)))
    chars = _with_pooled(chars).groupBy("lang").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k)))
    table = checkpointed(tops.join(chars, "lang").where(F.col("total") >= min_words))

    shares = F.transform("top", lambda x: -x["c"] / F.col("total"))
    rest = 1 + F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s + x["c"]) / F.col("total")
    all_chars = sum((F.col(f"c{i}") for i in range(k) if i != SPACE_CLASS), F.lit(0))
    return table.select(
        "lang",
        F.transform("top", lambda x: x["word"]).alias("common"),
        F.array_max(F.transform("top", lambda x: F.char_length(x["word"]))).alias("longest"),
        F.concat(shares, F.array(rest)).alias("word_ref"),
        F.array(*(F.col(f"c{i}") / all_chars for i in range(k) if i != SPACE_CLASS)).alias("char_ref"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of one length, 0 to 1."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0)) + F.when(y > 0, y * F.log2(y / m)).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x) / 2))


def _char_distance(chars: Column, n: Column, ref: Column) -> Column:
    """chars: code points of each class; n: those of words."""
    return js_distance(F.array(*(chars[i] / n for i in range(len(CLASSES) + 1) if i != SPACE_CLASS)), ref)


def _word_distance(w: Column, common: Column, longest: Column, ref: Column) -> Column:
    """longest: code points of the longest common word.

    Each common word is written as one sign, and the signs are counted.  Words
    that are too long to be common are not looked up (lower case has no fewer
    code points).
    """
    signs = [chr(0x21 + k) for k in range(COMMON_WORDS)]  # all of one byte
    of_place = F.array(F.lit(""), *map(F.lit, signs))

    def of(found: Column) -> Column:
        n, words_ = F.octet_length(found), F.size(w)
        shares = F.array(*((n - F.octet_length(F.replace(found, F.lit(s), F.lit("")))) / words_ for s in signs))
        return js_distance(F.concat(F.slice(shares, F.lit(1), F.size(common)), F.array(1 - n / words_)), ref)

    short = F.filter(w, lambda x: F.char_length(x) <= longest)
    return bound(F.array_join(F.transform(short, lambda x: F.get(of_place, F.array_position(common, F.lower(x)).cast("int"))), ""), of)


def judge(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    refs: DataFrame | None = None,
    min_chars: int = MIN_CHARS_JUDGED,
    min_words: int = MIN_WORDS_JUDGED,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """``docs`` and a struct ``quality``: the base counts, base_failed, char_distance, word_distance, kept.

    refs: a table as ``references`` makes; by default that of ``docs``.  A null
    language is compared to the pooled one.  A distance is null where the
    language has no reference or the text is too short, and then rejects nothing.  A null text has no words and fails the base rules.  Rows stay as
    they are, repeated ones too; a column named quality is replaced.
    Texts of any length are judged as a whole; an empty table gives an empty table.
    """
    docs = docs.drop("quality")
    refs = references(docs, lang_col, text_col) if refs is None else refs
    of_lang, ref_col = free_name(docs, "quality_lang"), free_name(docs, "quality_ref")
    own = refs.select(F.col("lang").alias(of_lang), F.struct("common", "longest", "word_ref", "char_ref").alias(ref_col))
    own = F.broadcast(own) if refs.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else own
    joined = docs.join(own, F.coalesce(F.col(lang_col), F.lit(POOLED)) == F.col(of_lang), "left")
    ref = F.col(ref_col)
    t = F.coalesce(F.col(text_col), F.lit(""))

    def of(x: Column) -> Column:
        w, chars = x["w"], x["chars"]
        n = F.char_length(t) - chars[SPACE_CLASS]
        return F.struct(
            *_base(t, w, chars),
            F.when(ref.isNotNull() & (n >= min_chars), _char_distance(chars, n, ref["char_ref"])).alias("char_distance"),
            F.when(ref.isNotNull() & (F.size(w) >= min_words), _word_distance(w, ref["common"], ref["longest"], ref["word_ref"])).alias("word_distance"),
        )

    once = F.struct(words(F.col(text_col)).alias("w"), _char_counts(t).alias("chars"))

    def verdict(q: Column) -> Column:
        diverges = F.coalesce(q["char_distance"] > max_char_distance, F.lit(False)) | F.coalesce(q["word_distance"] > max_word_distance, F.lit(False))
        counts = (q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        failed = base_failed(q)
        return F.struct(*counts, failed.alias("base_failed"), q["char_distance"].alias("char_distance"), q["word_distance"].alias("word_distance"), (~failed & ~diverges).alias("kept"))

    measured = F.transform(F.transform(F.array(once), of), verdict)[0]
    return joined.withColumn("quality", measured).select(*docs.columns, "quality")
