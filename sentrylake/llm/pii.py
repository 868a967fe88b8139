"""Personal data: patterns, and terms that disclose what the patterns protect.

The base kinds are found by patterns.  What they find are protected entities: a
value, such as one e-mail address, and its holder, which is what all values of one
owner share (an e-mail's domain, a network, an issuer, a dialling code).  How much
a term reveals of an entity is their pointwise mutual information over the
documents of the corpus, ``log2(N n(t, e) / (n(t) n(e)))``, as a share of the
entity's own information ``log2(N / n(e))``.  A term at or above the disclosure
threshold is as good as the entity itself: wherever it stands, in documents with
and without the entity, it is generalised, or removed if it gives the entity away
nearly entirely.

All counts are of documents: n(t) those with the term anywhere outside the
patterns' places, n(e) those with the entity, n(t, e) those with both.  Of rare
events mutual information says too much, so n(t, e) is discounted by one document, and
a pair must be in two different texts.  An entity of few bits is common knowledge
(an address in every footer), and terms reveal nothing by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpointed
from .common import bound, free_name, running

#: The base patterns, in the order in which kinds are listed.  They match what the plain patterns
#: match; an e-mail's local part is only tried where one can begin, and repetitions do not give back.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Every text with a match has this; most others have not.
GUARD = r"@[A-Za-z0-9-]|[0-9]\.[0-9]|\+[0-9]|[0-9](?:[\x20-]?[0-9]){15}"
KINDS = (*PATTERNS, "term")
#: A term is a run of letters and digits, lower-cased, of so many code points at least.
TERM, NO_TERM = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
MIN_TERM_CHARS = 4
#: Shares of an entity's information from which on a term is generalised, and removed.
DISCLOSURE, REMOVE_AT = 0.9, 0.95
#: Bits that a term must give, different texts in which it must stand with the entity, and documents taken off these.
MIN_BITS, MIN_TEXTS, DISCOUNT = 5.0, 2, 1.0
#: Tables of terms and of texts with spans are broadcast up to so many rows, and joined by shuffle beyond.
MAX_BROADCAST = 1_000_000
#: Bytes of the strings of a table that is broadcast, and pairs of one text that one task looks at, at most.
MAX_BROADCAST_BYTES, PART_PAIRS = 64 << 20, 1_000_000


def matches(text: Column, pattern: str | Column) -> Column:
    """Array of structs (start, stop, value): the leftmost matches that do not overlap, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def of(x: Column) -> Column:
        steps = F.zip_with(x["values"], F.slice(x["gaps"], F.lit(1), F.size(x["values"])), lambda v, g: F.char_length(v) + F.char_length(g))
        return F.zip_with(x["values"], running(steps, F.lit(0), lambda a, b: a + b), lambda v, e: F.struct((e - F.char_length(v)).alias("start"), e.alias("stop"), v.alias("value")))

    return bound(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps")), of)


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(F.char_length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


def _entities(kind: str, value: Column) -> Column:
    """The value and its holder."""
    plain = F.lower(value) if kind in ("email", "ip") else F.regexp_replace(value, "[^0-9]", "")
    holder = {
        "email": lambda v: F.substring_index(v, "@", -1),
        "ip": lambda v: F.substring_index(v, ".", 2),
        "card": lambda v: F.substring(v, 1, 6),
        "phone": lambda v: F.substring(v, 1, 4),
    }[kind]
    return bound(plain, lambda v: F.array(F.concat(F.lit(f"{kind}:"), v), F.concat(F.lit(f"{kind} of "), holder(v))))


def base_spans(text: Column) -> Column:
    """Array of structs (kind, start, stop, entities) by kind as listed, then start; null for a null text."""

    def of(kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), _entities(kind, m["value"]).alias("entities")))

    return F.concat(*(of(kind) for kind in PATTERNS))


def masked(text: Column, spans: Column) -> Column:
    """The text with a space for each code point of a span; places stay as they are."""

    def without(rest: Column, kind: str) -> Column:
        def of(x: Column) -> Column:
            t, own = x["t"], x["own"]
            # the spans of one kind do not overlap and are in order
            behind = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(own, i - 1)["stop"])
            parts = F.transform(own, lambda s, i: F.concat(F.substring(t, behind(i) + 1, s["start"] - behind(i)), F.repeat(F.lit(" "), s["stop"] - s["start"])))
            done = F.concat(F.array_join(parts, ""), F.substring(t, F.element_at(own, -1)["stop"] + 1, F.char_length(t)))
            return F.when(F.size(own) == 0, t).otherwise(done)

        return bound(F.struct(rest.alias("t"), F.filter(spans, lambda s: s["kind"] == kind).alias("own")), of)

    for kind in PATTERNS:
        text = without(text, kind)
    return text


def _tokens(text: Column) -> Column:
    """The different runs of letters and digits of a text that are long enough."""
    return F.filter(F.array_distinct(F.split(F.regexp_replace(text, NO_TERM, " "), " ")), lambda t: F.char_length(t) >= MIN_TERM_CHARS)


def _few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has at most ``MAX_BROADCAST`` rows and its strings ``MAX_BROADCAST_BYTES``."""
    strings = [F.octet_length(f.name) for f in df.schema if f.dataType.simpleString() == "string"]
    size = F.coalesce(F.sum(sum(strings, F.lit(0)).cast("long")), F.lit(0))
    rows, length = df.limit(MAX_BROADCAST + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= MAX_BROADCAST and length <= MAX_BROADCAST_BYTES else df


def protected_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(tk, c, base, entities, terms, moved) of each different text with a base span.

    tk: the text's MD5, c: its rows, base: its spans, terms: its terms outside of
    them.  moved: (term, by), 1 for a term that only the spans' absence
    makes, -1 for one that stands only in spans.
    """
    text = F.col(text_col)
    rows = docs.where(text.rlike(GUARD)).select(text.alias("text"), base_spans(text).alias("base")).where(F.size("base") > 0)
    whole, outside = _tokens(F.lower("text")), _tokens(F.lower(masked(F.col("text"), F.col("base"))))
    rows = rows.select(F.unhex(F.md5("text")).alias("tk"), "base", whole.alias("whole"), outside.alias("terms"))
    moved = F.concat(
        F.transform(F.array_except("terms", "whole"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("by"))),
        F.transform(F.array_except("whole", "terms"), lambda t: F.struct(t.alias("term"), F.lit(-1).alias("by"))),
    )
    span = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    rows = rows.select("tk", F.transform("base", span).alias("base"), F.array_distinct(F.flatten("base.entities")).alias("entities"), "terms", moved.alias("moved"))
    # copies agree in all of this, and are one row of each task before they are shuffled
    return rows.groupBy("tk").agg(F.count("*").alias("c"), *(F.first(x).alias(x) for x in ("base", "entities", "terms", "moved")))


def term_documents(docs: DataFrame, found: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_t): the documents that have each wanted term outside of base spans; summed in each task first."""
    all_ = docs.select(F.explode(_tokens(F.lower(text_col))).alias("term")).join(_few(wanted), "term", "left_semi")
    moved = found.select(F.explode("moved").alias("m"), "c").select("m.term", (F.col("m.by") * F.col("c")).alias("n")).join(_few(wanted), "term", "left_semi")
    counts = all_.groupBy("term").agg(F.count("*").alias("n")).unionByName(moved.groupBy("term").agg(F.sum("n").alias("n")))
    return counts.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosures(
    docs: DataFrame,
    found: DataFrame,
    text_col: str = "text",
    disclosure: float = DISCLOSURE,
    min_bits: float = MIN_BITS,
    min_texts: int = MIN_TEXTS,
    discount: float = DISCOUNT,
) -> DataFrame:
    """(entity, term, bits, disclosure) of the pairs at or above the thresholds.  found: as ``protected_texts`` makes it.

    What cannot reach them is left out before pairs are formed, by three facts:
    n(t, e) is at most n(e), so an entity must have ``min_bits`` itself; a pair
    in ``min_texts`` texts has an entity and a term with as many; and a term that
    discloses is in n(e)^d N^(1-d) documents at most.  So common entities and
    common words form no pairs.
    """
    n = float(docs.count())
    # a text of very many values and words is dealt to tasks by its words
    parts = F.ceil(F.size("entities").cast("long") * F.size("terms") / PART_PAIRS).cast("int")
    found = found.withColumn("parts", F.greatest(F.lit(1), parts))
    entities = found.select("tk", "c", "parts", F.explode("entities").alias("entity"))
    shared = entities.groupBy("entity").agg(F.sum("c").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    shared = checkpointed(shared.where(F.log2(F.lit(n) / F.col("n_e")) >= min_bits).drop("texts"))
    held = checkpointed(entities.join(_few(shared), "entity"))
    terms = found.join(held.select("tk").distinct(), "tk", "left_semi").select("tk", "parts", F.explode("terms").alias("term"))
    wanted = checkpointed(terms.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts).select("term"))
    counted = checkpointed(term_documents(docs, found, wanted, text_col))
    # the most documents of a term that an entity of so many can be told by
    most = lambda n_e: F.pow(n_e, F.lit(disclosure)) * F.pow(F.lit(n), F.lit(1 - disclosure)) * 1.0001
    # words that are too common for every value of their text go before they meet any
    widest = held.groupBy("tk").agg(F.max("n_e").alias("widest"))
    near = terms.join(_few(counted), "term").join(widest, "tk").where(F.col("n_t") <= most(F.col("widest")))
    near = near.select("tk", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), "term", "n_t")
    spread = held.select("tk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "c", "entity", "n_e")
    pairs = spread.join(near, ["tk", "part"]).where(F.col("n_t") <= most(F.col("n_e")))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("c").alias("n_te"), F.count("*").alias("texts"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    pairs = pairs.where((F.col("texts") >= min_texts) & (F.col("n_te") > discount))
    bits = F.log2(F.lit(n) * (F.col("n_te") - F.lit(discount)) / (F.col("n_t").cast("double") * F.col("n_e")))
    share = F.when(F.col("n_e") < n, F.round(bits / F.log2(F.lit(n) / F.col("n_e")), 9)).otherwise(F.lit(0.0))
    pairs = pairs.select("entity", "term", bits.alias("bits"), share.alias("disclosure"))
    return pairs.where((F.col("disclosure") >= disclosure) & (F.round("bits", 9) >= min_bits))


def find(
    docs: DataFrame,
    text_col: str = "text",
    disclosure: float = DISCLOSURE,
    remove_at: float = REMOVE_AT,
    min_bits: float = MIN_BITS,
    min_texts: int = MIN_TEXTS,
    discount: float = DISCOUNT,
) -> DataFrame:
    """``docs`` and ``pii``: an array of structs (kind, start, stop, removed), by kind as listed, then start.

    Places are code points of the whole text, stop exclusive; kind term is the
    method's, all others are the patterns'.  removed is true for terms that
    give an entity away nearly entirely.  Every document is judged, of any
    length.  Null and empty texts have no spans, an empty table stays empty.
    Rows stay as they are, repeated ones too: what is found depends on the text
    and on the corpus, so rows of one text are alike (the documents of all its
    rows count).  A column named pii is replaced; all others are kept.
    """
    docs = docs.drop("pii")
    tk, base_col, hits_col, text = *(free_name(docs, f"pii_{x}") for x in ("tk", "base", "hits")), F.col(text_col)
    marked = docs.withColumn(tk, F.unhex(F.md5(text_col)))
    found = checkpointed(protected_texts(docs, text_col))
    telling = disclosures(docs, found, text_col, disclosure, min_bits, min_texts, discount)
    telling = checkpointed(telling.groupBy("term").agg((F.max("disclosure") >= remove_at).alias("removed")))

    # the telling terms of each text, as they are written there
    written = docs.select(F.unhex(F.md5(text_col)).alias("tk"), F.explode(_tokens(text)).alias("token"))
    hits = written.join(_few(telling), F.lower("token") == F.col("term")).select("tk", "token", "removed").distinct()
    hits = hits.groupBy("tk").agg(F.array_sort(F.collect_list(F.struct("token", "removed"))).alias("hits"))
    spans = checkpointed(found.select("tk", "base").join(hits, "tk", "full").select(F.col("tk").alias(tk), F.col("base").alias(base_col), F.col("hits").alias(hits_col)))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,removed:boolean>>")

    def terms(x: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(x["hits"]["token"], "|"), F.lit(r")(?![\p{L}\p{N}])"))
        gone = F.filter(x["hits"], lambda h: h["removed"])["token"]
        return F.transform(matches(x["text"], pattern), lambda m: F.struct(F.lit("term").alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), F.array_contains(gone, m["value"]).alias("removed")))

    base = F.coalesce(F.transform(base_col, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(False).alias("removed"))), none)
    plain = F.when(F.col(base_col).isNull(), text).otherwise(masked(text, F.col(base_col)))
    added = F.when(F.col(hits_col).isNull(), none).otherwise(bound(F.struct(plain.alias("text"), F.col(hits_col).alias("hits")), terms))
    keys = spans.select(tk)
    if spans.limit(MAX_BROADCAST + 1).count() > MAX_BROADCAST:
        return marked.join(spans, tk, "left").withColumn("pii", F.concat(base, added)).select(*docs.columns, "pii")
    # few texts have spans, so the others need not be shuffled
    hit = marked.join(F.broadcast(keys), tk, "left_semi").join(spans, tk, "left").withColumn("pii", F.concat(base, added))
    clean = marked.join(F.broadcast(keys), tk, "left_anti").withColumn("pii", none)
    return hit.select(*docs.columns, "pii").unionByName(clean.select(*docs.columns, "pii"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with a sign of its kind, such as <EMAIL>, for each span, and nothing for removed ones.

    Where spans overlap, the one that begins first counts, the longer of two
    that begin together, and the others only for what they have beyond it.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("minus_stop"), s["kind"].alias("kind"), s["removed"].alias("removed"))))

    def of(x: Column) -> Column:
        t, own, ends = x["text"], x["own"], x["ends"]

        def piece(s: Column, i: Column) -> Column:
            behind, stop = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)), -s["minus_stop"]
            # what lies between the spans before and this one, then this one's sign
            between = F.substring(t, behind + 1, F.greatest(F.lit(0), s["start"] - behind))
            sign = F.when(s["removed"] | (stop <= behind), F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            return F.concat(between, sign)

        return F.concat(F.array_join(F.transform(own, piece), ""), F.substring(t, F.element_at(ends, -1) + 1, F.char_length(t)))

    def with_ends(own: Column) -> Column:
        ends = running(F.transform(own, lambda s: -s["minus_stop"]), F.lit(0), lambda a, b: F.greatest(a, b))
        return bound(F.struct(text.alias("text"), own.alias("own"), ends.alias("ends")), of)

    return F.when(F.size(spans) == 0, text).otherwise(bound(ordered, with_ends))
