"""Plain Python versions of the corpus operators' contracts, for small tables."""

import hashlib
import math
import re
import sys
from collections import Counter

sys.set_int_max_str_digits(0)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def pii(text):
    t = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(only(m[0])) <= 15]
    return sorted(out)


def pii_text(spans):
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans)


def quality(text):
    w = words(text)
    runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "n_lines": len(lines), "n_upper": sum(c.isupper() for c in text or ""), "base_failed": len(w) < 20 or 100 * len(covered) > 30 * len(w)}


def binomial_tail(k, n, p):
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    return math.fsum(math.comb(n, j) * p**j * (1 - p) ** (n - j) if n < 1000 else math.exp(log(j)) for j in range(k + 1))


def verdicts(docs, labels, rules, risk, delta):
    """(doc_id -> kept, stratum -> level) for documents (doc_id, text, lang) with distinct ids."""
    stat = {i: quality(t) for i, t, _ in docs}
    value = {i: {r: eval(e.replace("greatest", "max"), {"max": max}, dict(s)) for r, (e, _) in rules.items()} for i, s in stat.items()}  # noqa: S307
    steps = len(next(iter(rules.values()))[1])
    fails = lambda i, j: any(value[i][r] > cuts[j] for r, (_, cuts) in rules.items())
    good = {i for i, q in labels if q == 1}
    groups = {}
    for i, _, lang in docs:
        if i in good and not stat[i]["base_failed"]:
            groups.setdefault(lang, []).append(i)
    sizes = sorted(map(len, groups.values()), reverse=True)
    tests = max((r for r, n in enumerate(sizes, 1) if (1 - risk) ** n <= delta / r), default=0)
    level = {}
    for g, ids in groups.items():
        level[g] = 0
        while tests and level[g] < steps and binomial_tail(sum(fails(i, level[g]) for i in ids), len(ids), risk) <= delta / tests:
            level[g] += 1
    return {i: not stat[i]["base_failed"] and not (level.get(lang) and fails(i, level[lang] - 1)) for i, _, lang in docs}, level


def shingles(text, size=4):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(docs, size=4):
    """Row number -> smallest doc_id, for documents (doc_id, text)."""
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    members = {}
    for i in range(len(docs)):
        members.setdefault(find(i), []).append(i)
    return {i: min((docs[k][0] for k in ks if docs[k][0] is not None), default=None) for ks in members.values() for i in ks}, [len(s) for s in sets]


def cut_repeats(texts, window=35):
    """(n_words, n_removed, kept_sha256) of each text."""
    all_words = [words(t) for t in texts]
    runs = Counter(tuple(w[i:i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = {k for i in range(len(w) - window + 1) if runs[tuple(w[i:i + window])] > 1 for k in range(i, i + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    """Source -> target by repeated sharing."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), budget * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = most * sizes[s]
            free.discard(s)
        left = budget * sum(sizes.values()) - sum(out.values())
    return out


def templates(text, names, numbers, units, other):
    """(template words, plain words) of a text; the patterns are the operator's fixed values, in Python's form."""
    t = numbers.sub("\x02", names.sub("\x01", text or ""))
    tmpl = [w for w in re.split(r"[\x20\x09-\x0D]+", other.sub("", t.lower())) if w]
    plain = [w for w in re.split(r"[\x20\x09-\x0D]+", other.sub("", (text or "").lower())) if w]
    return ["\x03" if w in units else w for w in tmpl], plain


def leaks(docs, items, split, window=6, least=3, literals=0.6, coverage=0.3):
    """(doc_id, item_id) -> (matched, coverage, verbatim), for documents (doc_id, text) and items (item_id, text) with distinct ids."""
    marks = {"\x01", "\x02", "\x03"}
    out = {}
    for item, text in items:
        t, p = split(text)
        if len(t) < least:
            continue
        size = min(window, len(t))
        places = [i for i in range(len(t) - size + 1) if sum(x not in marks for x in t[i:i + size]) >= math.ceil(size * literals)]
        plain = not places
        own = p if plain else t
        places = places or list(range(len(t) - size + 1))
        for doc, body in docs:
            dt, dp = split(body)
            theirs = dp if plain else dt
            shifts = {}
            for i in places:
                for j in range(len(theirs) - size + 1):
                    if theirs[j:j + size] == own[i:i + size]:
                        slots = set() if plain else {(k, a, b) for k, a, b in zip(t[i:i + size], p[i:i + size], dp[j:j + size]) if k in marks}
                        shifts.setdefault(j - i, {})[i] = slots
            matched, verbatim = set(), True
            for hits in shifts.values():
                filled = set().union(*hits.values())
                ok = len(filled) == len({(k, a) for k, a, _ in filled})
                counted = {i: x for i, x in hits.items() if ok or not x}
                matched |= set(counted)
                verbatim &= all(a == b for x in counted.values() for _, a, b in x)
            if matched and len(matched) / len(places) >= coverage:
                out[doc, item] = (len(matched), len(matched) / len(places), verbatim)
    return out
