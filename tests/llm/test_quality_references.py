"""References of languages: none is judged by another's, and common words are those of all lengths."""

import random

from sentrylake.llm import quality

SCHEMA = "doc_id long, text string, lang string"


def docs(rng, lang, first, n, common, rare):
    draw = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(rare)
    return [(first + i, " ".join(draw() for _ in range(100)), lang) for i in range(n)]


def corpus():
    rng = random.Random(3)
    large = docs(rng, "en", 0, 1200, ["the", "of", "and", "to", "in"], [f"word{i}" for i in range(500)])
    greek = docs(rng, "el", 10_000, 60, ["\u03ba\u03b1\u03b9", "\u03c4\u03bf", "\u03bd\u03b1"], [f"\u03bb\u03ad\u03be\u03b7\u03c5{chr(945 + i % 24)}{chr(945 + i // 24)}" for i in range(300)])
    tiny = docs(rng, "zz", 20_000, 2, ["\u5186", "\u6708"], [f"\u65e5{chr(0x4e00 + i)}" for i in range(300)])
    return large, greek, tiny


def test_a_small_language_is_not_judged_by_others(spark):
    large, greek, tiny = corpus()
    # so much English that Greek has under a thousandth of the words
    rows = spark.createDataFrame(large, SCHEMA)
    many = spark.range(60).crossJoin(rows).select("doc_id", "text", "lang")
    beside = many.unionByName(spark.createDataFrame(greek + tiny, SCHEMA))
    judged = quality.judge(beside).where("lang <> 'en'").select("doc_id", "lang", "quality.*").collect()
    assert len(judged) == 62 and all(r["kept"] for r in judged)
    assert all((r["word_distance"] is None) == (r["lang"] == "zz") for r in judged)


def test_common_words_are_of_any_length(spark):
    rng = random.Random(5)
    long = ["Donaudampfschiff", "selbstverst\u00e4ndlich", "m\u00f6glicherweise", "Kurz"]
    rows = docs(rng, "de", 0, 100, long, [f"seltenes{i}wort" for i in range(900)]) + docs(rng, "en", 500, 100, ["the"], [f"w{i}" for i in range(900)])
    df = spark.createDataFrame(rows, SCHEMA)
    for buckets, first in ((1 << 16, 256), (64, 1)):  # the second has to look into more buckets
        got = {r["lang"]: (r["total"], [(-x["c"], x["word"]) for x in r["top"]]) for r in quality.common_words(df, buckets=buckets, first=first).collect()}
        for lang in ("de", "en", "*"):
            count = {}
            for _, text, of in rows:
                if lang in (of, "*"):
                    for w in text.lower().split():
                        count[w] = count.get(w, 0) + 1
            want = sorted((-c, w) for w, c in count.items())[:24]
            assert got[lang] == (sum(count.values()), [(-c, w) for c, w in want])
