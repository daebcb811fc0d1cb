"""Secret scan: candidate tokens, judged by a random forest.

Candidates are long tokens with digits or mixed case, values of six characters or
more assigned to names that end like those of secrets ("password", "DB_TOKEN",
"apiKey"), and private keys: from the header to the END line, or to the end of
the lines that look like a key. The forest sees a candidate's length,
its character classes and transitions (how often the class changes; how likely
its letter pairs are in ordinary words), its coverage by a dictionary, whether
it is part of a path or address, and its neighbouring words, and removes false
positives. It is trained on labelled findings: those given, in memory or as a
table, or else a generated set, always with the same seed. Of each class at most
``MAX_FINDINGS`` / 2 findings are used, chosen by hash.

Defined results: null or empty text has no findings; overlapping candidates
count once, the earlier first, of two from one place the longer; repeated rows are scanned each; an empty table
gives an empty result; redacting leaves other columns as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import arrow_batches, spread

MAX_FINDINGS = 20_000
TREES = 30
DEPTH = 8
MIN_SCORE = 0.5
REDACTED = "[SECRET]"

# Names near secrets, names near other hashes and ids, prefixes of public token formats, and a small dictionary.
SECRET_NAMES = frozenset("token secret key apikey api_key access_key secret_key password passwd pwd auth authorization bearer credential credentials private client_secret access_token auth_token".split())
OTHER_NAMES = frozenset("commit sha sha1 sha256 md5 checksum hash digest revision version build uuid guid id isbn doi file path url href src class function import example placeholder serial phone fax tel".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk_test_", "pk_live_", "AIza", "ya29.", "eyJ", "npm_", "SG.", "hf_")
DICTIONARY = (
    "about access account action active admin after again agent album alert alias align allow alpha always analysis apple application archive argument array article author auto"
    " background balance base before begin block board body book bottom bridge browser buffer build button cache call camera cancel card catch center chain change channel check child"
    " city class clean click client clock close cloud code color column command comment commit common compute config connect content control copy count country course cover create"
    " current custom data date day default define delete design detail device digital direct display document domain done down download drive edit element email enable engine english"
    " enter entry error event example export factory family feature field file filter final find first folder follow font form format forward frame free from front function future"
    " game gate general global good graph green group guide handle hash head health heart height hello help here hidden history home horse host house").split()

_RUN = re.compile(r"[A-Za-z0-9_+/=.~-]{16,}+")
# a name starts after something else than a letter, or with a capital after a small letter
_ASSIGNED = re.compile(
    r"(?i)(?:(?<![a-z])|(?<=(?-i:[a-z]))(?=(?-i:[A-Z])))(?:" + "|".join(sorted(SECRET_NAMES, key=lambda w: (-len(w), w)))
    + r")[\"']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}[\"'`]?([^\s\"'`]{6,}+)")
_HEADER = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
_BREAK = r"(?:\s|\\[nr])+"
_PEM = re.compile(
    _HEADER + r"(?:(?:(?!-----BEGIN )[A-Za-z0-9+/=:,.\s\\-])*?-----END [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|(?:{_BREAK}[A-Za-z0-9+/]{{16,}}={{0,2}})+(?:[ \t\r]*\n[A-Za-z0-9+/]+={{0,2}}(?=\s*(?:\n|\Z)))?)?")
_HEADER = re.compile(_HEADER)
_WORDS = re.compile(r"[A-Za-z0-9_]+")
_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_ALPHA = re.compile(r"[A-Za-z]+")
_IN_DICTIONARY = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w))))


def _pairs() -> np.ndarray:
    """Log-likelihood of letter pairs in ordinary words, over that of pairs at random."""
    c = np.full((26, 26), 0.5)
    for w in DICTIONARY:
        for a, b in zip(w, w[1:]):
            c[ord(a) - 97, ord(b) - 97] += 1
    return np.log(c / c.sum(1, keepdims=True) * 26)


_PAIRS = _pairs()


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the tokens worth a look, in order, not overlapping."""
    if not text:
        return []
    found = [(m.start(), m.end(), "private key") for m in _PEM.finditer(text)]
    for m in _RUN.finditer(text):
        token = m[0].rstrip(".=~-+/_") if not m[0].endswith("==") else m[0]
        start = m.start() + len(token) - len(token.lstrip(".=~-+/"))
        end = m.start() + len(token)
        if "=" in text[start:end].rstrip("="):  # name=value: the value
            start += text[start:end].rstrip("=").rfind("=") + 1
        token = text[start:end]
        inner = token[1:]
        if len(token) >= 16 and (any("0" <= c <= "9" for c in token) or inner != inner.lower() and inner != inner.upper()):
            found.append((start, end, "token"))
    if ":" in text or "=" in text:
        for m in _ASSIGNED.finditer(text):
            end = m.end(1)
            if text[end:end + 1] not in ("\"", "'", "`"):  # unquoted: punctuation behind the value isn't part of it
                end = m.start(1) + len(m[1].rstrip(",;)]}>."))
            if end - m.start(1) >= 6:
                found.append((m.start(1), end, "assigned"))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


FEATURES = (
    "log_length", "digits", "upper", "lower", "symbols", "changes", "pair_likelihood", "dictionary", "entropy", "hex", "uuid", "separators", "path_before",
    "secret_name", "other_name", "assigned", "quoted", "prefix", "distinct", "pem",
)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """The forest's view of one candidate (see FEATURES)."""
    if kind == "private key":  # judged by its header
        end = _HEADER.match(text, start).end()
    t = text[start:end]
    n = len(t)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in t]
    share = {k: kinds.count(k) / n for k in "duls"}
    pairs = [_PAIRS[ord(a) - 97, ord(b) - 97] for w in _ALPHA.findall(t) for a, b in zip(w.lower(), w.lower()[1:])]
    counts = np.array([t.count(c) for c in set(t)]) / n
    before, after = text[max(0, start - 60):start], text[end:end + 20]
    near = [w.lower() for w in _WORDS.findall(before)[-3:]]
    close = before.rstrip(" \t\"'`([{")
    return [
        math.log(n), share["d"], share["u"], share["l"], share["s"], sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        float(np.mean(pairs)) if pairs else -2.0, sum(map(len, _IN_DICTIONARY.findall(t.lower()))) / n, float(-(counts * np.log2(counts)).sum()),
        float(_HEX.fullmatch(t) is not None), float(_UUID.fullmatch(t) is not None), float(t.count("/") + t.count(".") + t.count("-")),
        float(before.endswith(("/", "\\", "@", "://", "#")) or after.startswith(("/", "@", "("))), float(any(w in SECRET_NAMES for w in near)),
        float(any(w in OTHER_NAMES for w in near)), float(close.endswith(("=", ":", "=>"))), float(before.endswith(("\"", "'", "`"))), float(t.startswith(PREFIXES)),
        len(set(t)) / n, float(kind == "private key"),
    ]


def generated_findings(rows: int = 3_000, seed: int = 7) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings (text, start, end, kind, is secret) in sentences of made-up words."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    hexes, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ("an", "er", "the", "ing", "on", "ble", "tion", "st", "re", "ou", "en", "la", "que", "ment", "sch", "ung", "ción", "ado", "éa", "ich")
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
    words = lambda: " ".join(word() for _ in range(int(rng.integers(0, 5))))
    names = sorted(SECRET_NAMES)

    def secret() -> tuple[str, str, str]:
        how = int(rng.integers(9))
        if how < 4:
            value = (chars(hexes, pick((32, 40, 48, 64))), chars(b62, int(rng.integers(20, 65))), chars(b62 + "+/", 43) + "=", chars(hexes, 40))[how]
            op = pick((" = \"", "=\"", ": \"", " := '", "=", ": ", " = ", " "))
            return pick(names) + op, value, "\"" if "\"" in op else "'" if "'" in op else ""
        if how == 4:
            return pick(("", word() + " ")), "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), ""
        if how == 5:
            return pick(("", "using ", "token ")), pick(("ghp_", "glpat-", "xoxb-", "sk_live_", "npm_", "hf_")) + chars(b62, int(rng.integers(24, 41))), ""
        if how == 6:
            return pick(("Authorization: Bearer ", "jwt ")), "eyJ" + chars(b62, 33) + "." + "eyJ" + chars(b62, 40) + "." + chars(b62 + "_-", 43), ""
        if how == 7:
            name, op = pick(names), pick((" = \"", ": \"", "=\"", "\": \"", "=", ": "))
            return pick(("", "", "DB_", "client_", "my")) + pick((name, name.upper())) + op, chars(b62 + "!$%#", int(rng.integers(10, 20))), "\"" if op.endswith("\"") else ""
        return "", "-----BEGIN " + pick(("RSA ", "EC ", "", "OPENSSH ")) + "PRIVATE KEY-----", ""

    def other() -> tuple[str, str, str]:
        how = int(rng.integers(16))
        d = lambda n: chars("0123456789", n)
        return (
            lambda: (pick(("commit ", "sha256:", "md5 ", "checksum = ", "revision ", "hash: ")), chars(hexes, pick((32, 40, 64))), ""),
            lambda: (pick(("id ", "uuid: ", "")), "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12)), ""),
            lambda: (pick(("/", "", "file ")), "/".join(pick(DICTIONARY) for _ in range(int(rng.integers(3, 6)))) + pick((".py", ".html", "2.txt", "")), ""),
            lambda: ("https://", pick(DICTIONARY) + ".example.com/" + pick(DICTIONARY) + "/" + d(int(rng.integers(3, 9))), ""),
            lambda: ("", "".join(pick(DICTIONARY).capitalize() for _ in range(int(rng.integers(3, 6)))), pick(("", "(", ""))),
            lambda: (pick(("", "key = ")), "_".join(pick(DICTIONARY) for _ in range(int(rng.integers(3, 6)))) + pick(("", "_2", "_v3")), ""),
            lambda: (pick(("", "card ", "phone ")), d(int(rng.integers(16, 20))), ""),
            lambda: ("", word() + word() + word() + word() + "." + d(2), "@mail" + d(1) + ".example.com"),
            lambda: (pick(("key=\"", "token = \"", "password: \"")), pick(("your-api-key-here", "xxxxxxxxxxxxxxxx0", "example_token_123", "change-me-please-1", "placeholder-value-00")), "\""),
            lambda: (pick(("", "version ")), f"2{d(3)}-{d(2)}-{d(2)}T{d(2)}.{d(2)}.{d(2)}", ""),
            lambda: (pick(("", "isbn ")), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", ""),
            lambda: (pick(("", "the ")), "".join(w.capitalize() for w in (word().encode("ascii", "ignore").decode(), pick(DICTIONARY), word().encode("ascii", "ignore").decode(), pick(DICTIONARY))) + d(1), ""),
            lambda: (pick(names) + pick((": ", " = ", "=", ": \"")), pick(("required", "string", "optional", "missing", "expired", "invalid", "unknown", "basic-auth", "changeme", "example", word() + "en")), ""),
            lambda: (pick(names) + pick((" = ", "=", ": ")), pick(("get_", "load_", "read_", "self.", "config.", "os.environ.", "settings.")) + pick(DICTIONARY) + "_" + pick(DICTIONARY) + pick(("", "()", "[0]")), ""),
            lambda: (pick(names) + pick((": ", " = ")), pick(("https://", "/", "./")) + pick(DICTIONARY) + "/" + pick(DICTIONARY) + "/" + pick(DICTIONARY), ""),
            lambda: (pick(names) + pick((" = \"", ": \"", "=\"")), pick(("<your-token>", "${SECRET_VALUE}", "{{ password }}", "****************", "xxxxxxxxxx", "your-secret-here", "REPLACE_ME_1", "insert-key-here")), "\""),
        )[how]()

    out = []
    for k in range(rows):
        before, value, after = secret() if k % 2 else other()
        lead = words() + " " + before
        text = lead + value + after + " " + words()
        kind = "private key" if value.startswith("-----") else "assigned" if before.rstrip("\"' ").endswith((":", "=")) and before.rstrip("\"' :=").lower().endswith(tuple(names)) else "token"
        out.append((text, len(lead), len(lead) + len(value), kind, k % 2))
    return out


class Forest:
    """A random forest for two classes: bagged trees, square-root feature subsets, Gini splits at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(len(x), size=len(x))
            nodes: list[list[float]] = []  # feature, threshold, left, right, share of secrets
            self._grow(x[rows], y[rows], depth, nodes, rng)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list[list[float]], rng: np.random.Generator) -> int:
        me, p = len(nodes), float(y.mean())
        nodes.append([-1, 0, 0, 0, p])
        if depth == 0 or len(y) < 6 or p in (0.0, 1.0):
            return me
        best = (p * (1 - p) - 1e-9, -1, 0.0)
        for f in rng.permutation(x.shape[1])[: max(1, round(math.sqrt(x.shape[1])))]:
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 19)))
            left = x[:, f][:, None] <= cuts
            nl = left.sum(0)
            nr = len(y) - nl
            sl = (left & (y[:, None] == 1)).sum(0)
            pl, pr = sl / np.maximum(nl, 1), (y.sum() - sl) / np.maximum(nr, 1)
            gini = np.where((nl > 1) & (nr > 1), (nl * pl * (1 - pl) + nr * pr * (1 - pr)) / len(y), 1.0)
            k = int(gini.argmin())
            if gini[k] < best[0]:
                best = (float(gini[k]), int(f), float(cuts[k]))
        if best[1] >= 0:
            go = x[:, best[1]] <= best[2]
            nodes[me][:2] = [best[1], best[2]]
            nodes[me][2] = self._grow(x[go], y[go], depth - 1, nodes, rng)
            nodes[me][3] = self._grow(x[~go], y[~go], depth - 1, nodes, rng)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(go, t[at, 2], t[at, 3]).astype(int), at)
            total += t[at, 4]
        return total / len(self.trees)


def _chosen(findings: list[tuple], most: int) -> list[tuple]:
    """At most ``most`` findings of each class, by hash."""
    out: list[tuple] = []
    for y in (0, 1):
        mine = [f for f in findings if int(f[4]) == y]
        if len(mine) > most:
            mine = sorted(mine, key=lambda f: hashlib.sha256(f"{f[1]} {f[2]} {f[0]}".encode("utf-8", "surrogatepass")).digest())[:most]
        out += mine
    return out


def findings_of(table: DataFrame, most: int = MAX_FINDINGS // 2) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings from a table (text, start, end, kind, is_secret): of each class the ``most`` first by hash.

    Rows with a null are left out. Every partition keeps ``most`` rows of a class at most, so that 2 ``most`` rows reach the driver.
    """
    named = table.select(F.col("text"), F.col("start"), F.col("end"), F.col("kind"), F.col("is_secret").cast("int").alias("y")).dropna()
    key = F.xxhash64("text", "start", "end")
    rows = [r for y in (0, 1) for r in named.where(F.col("y") == y).orderBy(key, "text", "start", "end").limit(most).collect()]
    return [(r[0], int(r[1]), int(r[2]), r[3], int(r[4])) for r in rows]


def train(findings: Sequence[tuple[str, int, int, str, int]] | None = None, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest from labelled findings (text, start, end, kind, is secret)."""
    rows = _chosen(list(findings), MAX_FINDINGS // 2) if findings is not None else generated_findings()
    x = np.array([features(t, s, e, k) for t, s, e, k, _ in rows])
    return Forest(x, np.array([y for *_, y in rows]), trees, depth)


def find(texts: Sequence[str | None], forest: Forest, min_score: float = MIN_SCORE) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of each text's secrets."""
    seen = [candidates(t) for t in texts]
    x = [features(texts[i], *c) for i, cs in enumerate(seen) for c in cs]
    scores = iter(forest.predict(np.array(x)).tolist() if x else [])
    return [[(*c, s) for c in cs if (s := next(scores)) >= min_score] for cs in seen]


_FINDINGS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64()), ("sha256", pa.string())]))


def scan(docs: DataFrame, forest: Forest | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id and ``found`` (start, end, kind, score, sha256 of the secret) of every row."""
    forest = forest or train()
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [[{"start": s, "end": e, "kind": k, "score": p, "sha256": hashlib.sha256(t[s:e].encode("utf-8", "surrogatepass")).hexdigest()} for s, e, k, p in found]
                    for t, found in zip(texts, find(texts, forest, min_score))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _FINDINGS)], ["doc_id", "found"])

    src = spread(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string").alias("text")))
    return src.mapInArrow(run, "doc_id bigint, found array<struct<start:int,end:int,kind:string,score:double,sha256:string>>")


def redact(docs: DataFrame, forest: Forest | None = None, min_score: float = MIN_SCORE, mark: str = REDACTED) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; n_chars, if there, follows the text."""
    forest = forest or train()
    arrow_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            changed = False
            for i, found in enumerate(find(texts, forest, min_score)):
                for s, e, *_ in reversed(found):
                    texts[i] = texts[i][:s] + mark + texts[i][e:]
                    changed = True
            columns = list(b.columns)
            if changed:
                columns[at] = pa.array(texts, b.schema.field(at).type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    old = columns[k].to_pylist()
                    columns[k] = pa.array([len(t) if t is not None else n for t, n in zip(texts, old)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return spread(docs).mapInArrow(run, docs.schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.selectExpr("doc_id", "inline(found)").selectExpr("doc_id", "start", "`end`", "kind", "round(score, 6) as score", "sha256")
