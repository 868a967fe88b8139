"""Plain Python versions of what the contracts state, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from xxhash import xxh64_intdigest

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def quality(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 10 or 100 * out[4] > 20 * out[0])


def fill_middle(doc_id, text):
    text = text or ""
    n, digest = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, sha(f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)


def substring_dedup(docs):
    """docs: {id: text}; {id: (n_words, n_removed, kept)}."""
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    out = {}
    for i, text in docs.items():
        w = words(text)
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def simhash(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = words(lowered)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """fps: {id: fingerprint}; {id: least id linked}, by comparing all pairs."""
    ids, parent = sorted(fps), {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def targets(sizes, share=1.5, most=2.0):
    """sizes: {source: words}; {source: target} by water-filling in rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > most * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in above}


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url(u):
    if not u or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def sketch(shingle_hashes, k):
    return sorted(set(shingle_hashes))[:k]


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def group_sums(rows):
    out = defaultdict(int)
    for k, v in rows:
        out[k] += v
    return dict(out)


def pii_entities(kind, raw):
    v = raw.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", raw)
    holder = {"email": lambda: v.split("@")[-1], "ip": lambda: ".".join(v.split(".")[:2]), "card": lambda: v[:6], "phone": lambda: v[:4]}[kind]()
    return {f"{kind}:{v}", f"{kind} of {holder}"}


def disclosed(rows, disclosure=0.9, remove_at=0.95, min_bits=5.0, min_texts=2, discount=1.0):
    """rows: texts, one for each document; {text: [(kind, start, stop, removed)]} by counting all pairs."""
    import math

    import regex

    token = regex.compile(r"[\p{L}\p{N}]+")
    base = {t: pii(t) for t in set(rows)}
    bare = {}
    for t, spans in base.items():
        letters = list(t or "")
        for _, a, b in spans:
            letters[a:b] = " " * (b - a)
        bare[t] = "".join(letters)
    terms = {t: {m[0].lower() for m in token.finditer(x) if len(m[0].lower()) >= 4} for t, x in bare.items()}
    n, n_t, n_e, n_te, texts = len(rows), Counter(), Counter(), Counter(), defaultdict(set)
    for t in rows:
        n_t.update(terms[t])
        entities = set().union(*(pii_entities(k, t[a:b]) for k, a, b in base[t])) if base[t] else set()
        n_e.update(entities)
        for e in entities:
            for w in terms[t]:
                n_te[e, w] += 1
                texts[e, w].add(t)
    telling = {}
    for (e, w), both in n_te.items():
        if len(texts[e, w]) >= min_texts and both > discount and n_e[e] < n:
            bits = math.log2(n * (both - discount) / (n_t[w] * n_e[e]))
            share = round(bits / math.log2(n / n_e[e]), 9)
            if bits >= min_bits and share >= disclosure:
                telling[w] = max(share, telling.get(w, 0))
    return {
        t: [(*s, False) for s in base[t]] + [("term", *m.span(), telling[m[0].lower()] >= remove_at) for m in token.finditer(bare[t]) if m[0].lower() in telling and len(m[0]) >= 4] for t in base
    }


def _distance(p, q):
    """Jensen-Shannon distance of two lists of shares."""
    import math

    total = 0.0
    for x, y in zip(p, q):
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x > 0 else 0) + (y * math.log2(y / m) if y > 0 else 0)
    return math.sqrt(max(0.0, total / 2))


def _classes(text):
    """Code points of the classes of characters, white space left out."""
    import regex

    kinds = [r"\p{Ll}", r"[\x20\x09-\x0D]", r"\p{Lu}", r"\p{N}", r"""[.,;:!?'"()-]""", r"[#*$%&|<>]"]
    out = [0] * 7
    for c in text:
        out[next((i for i, k in enumerate(kinds) if regex.match(k, c)), 6)] += 1
    return out[:1] + out[2:]


def divergence(rows, min_reference=5_000, n_common=24, min_chars=80, min_words=50, max_char=0.27, max_word=0.36):
    """rows: (text, lang); for each (char_distance, word_distance, kept), by whole counts of each language."""
    counts, chars = defaultdict(Counter), defaultdict(lambda: [0] * 6)
    for text, lang in rows:
        for key in {lang or "*", "*"}:
            counts[key].update(w.lower() for w in words(text))
            chars[key] = [a + b for a, b in zip(chars[key], _classes(text or ""))]
    refs = {}
    for key, c in counts.items():
        total = sum(c.values())
        if total >= min_reference:
            top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n_common]
            refs[key] = [w for w, _ in top], [v / total for _, v in top] + [1 - sum(v for _, v in top) / total], [x / sum(chars[key]) for x in chars[key]]
    out = []
    for text, lang in rows:
        w, ref, own = words(text), refs.get(lang or "*"), _classes(text or "")
        by_char = _distance([x / sum(own) for x in own], ref[2]) if ref and sum(own) >= min_chars else None
        by_word = None
        if ref and len(w) >= min_words:
            c = Counter(x.lower() for x in w)
            shares = [c[x] / len(w) for x in ref[0]]
            by_word = _distance(shares + [1 - sum(shares)], ref[1])
        out.append((by_char, by_word, not quality(text)[5] and not (by_char or 0) > max_char and not (by_word or 0) > max_word))
    return out


def redact(text, spans):
    """Signs of kinds for spans (kind, start, stop, removed)."""
    out, at = [], 0
    for start, minus_stop, kind, removed in sorted((s[1], -s[2], s[0], s[3]) for s in spans):
        out.append(text[at : max(at, start)] + ("" if removed or -minus_stop <= at else f"<{kind.upper()}>"))
        at = max(at, -minus_stop)
    return "".join(out) + text[at:]


def resembling(texts, at_least=0.8):
    """{id: least id linked} by comparing all pairs of sets of five-word shingles."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {i: shingles((t or "").translate(lower)) for i, t in texts.items()}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small < at_least * large:
                continue
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= at_least * (small + large - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def mixed(docs, seed=42):
    """docs: {id: (source, size)}; {id: copies} by target, whole repetitions and a seeded order."""
    goal, groups = targets(group_sums(docs.values())), defaultdict(list)
    for i, (source, size) in docs.items():
        groups[source].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, size))
    out = {}
    for source, rows in groups.items():
        total = sum(size for *_, size in rows)
        whole = int(goal[source] // total) if total else 0
        run, rest = 0, goal[source] - whole * total
        for _, i, size in sorted(rows):
            run += size
            out[i] = whole + (size > 0 and run - size / 2 < rest)
    return out
