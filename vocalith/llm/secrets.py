"""Secret scans: wide candidate patterns, then a random forest that removes false positives.

Candidates: values assigned to a key (``name = value``, ``name: value``, names of any length) that have a digit or
whose key has a secret word as a part, private key blocks, and any run of 16 or more token characters with a digit.
A candidate's features: its length; its character transitions (share of changes between lower case, upper case,
digits and other, and mean log-probability of its letter pairs under the corpus); the share of its letters that
common corpus words cover; whether it stands in a path or an address, and, where the table has a column of paths, the
words of the document's own path; the words before and after it. The forest (bootstrap trees on Gini impurity, grown
here in numpy) learns from labelled findings; ``labelled_findings`` makes such a table by a seeded rule where no
reviewed one is at hand: credentials of common shapes among false positives such as checksums, identifiers,
addresses, card numbers and placeholders.

The dictionary and letter pairs come from word counts over all documents; the ``vocabulary`` most frequent words
of letters stay. Cases: null and empty texts have no finding; equal texts have equal findings, each in its own
row; repeated rows have the findings of each, null ids are kept as they are; an empty table has none; very long texts
are scanned whole; overlapping candidates give the longer one; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise
from .lm import split_words

_ASSIGNED = re.compile(r"""(?<![\w.-])[\d_.-]*+([^\W\d_][\w.-]*+)["']?[ \t]{0,2}(?:=|:)[ \t]{0,2}["']?([^\s"',;<>]{8,})""")
_RUN = re.compile(r"(?<![\w+/=.@-])[\w+/=.@-]*\d[\w+/=.@-]*(?![\w+/=.@-])", re.ASCII)
_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?)-----")
_BLOCK_LINES = re.compile(r"(?:\s+[\w+/=]+(?=\s|$))*", re.ASCII)
_LEAST = 16
_SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "private", "bearer", "key")
_HARMLESS_WORDS = ("sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "commit", "revision", "uuid", "guid", "version", "isbn", "order", "phone", "card", "mail", "id", "build", "etag")
_DUMMY = ("example", "sample", "dummy", "test", "placeholder", "changeme", "your", "xxxx", "todo", "none", "null")
_TEST_PATHS = ("test", "example", "sample", "doc", "fixture", "mock")


def _has(words: tuple[str, ...], of: list[str]) -> bool:
    """Whether a word is in ``of``, or, if it is long enough to be told from chance, a part of one."""
    return any(any(w == x or (len(w) > 4 and w in x) for w in words) for x in of)


def _secret_key(key: str) -> bool:
    return _has(_SECRET_WORDS, [key.lower(), *re.split(r"[_.-]+", key.lower())])


def _key_blocks(text: str) -> list[tuple[int, int, str]]:
    """Private key blocks; one without its end mark goes as far as its lines do."""
    heads = list(_BLOCK.finditer(text)) if "PRIVATE KEY" in text else []
    out = []
    for m, after in zip(heads, [*(h.start() for h in heads[1:]), len(text)], strict=False):
        mark = f"-----END {m.group(1)}-----"
        at = text.find(mark, m.end(), after)
        out.append((m.start(), at + len(mark) if at >= 0 else _BLOCK_LINES.match(text, m.end(), after).end(), "private_key"))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, key): the longer of two that overlap; key is the assigned name or empty."""
    found = [(m.start(2), m.end(2), m.group(1)) for m in _ASSIGNED.finditer(text)] if "=" in text or ":" in text else []
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= _LEAST:
            found.append((m.start(), m.end(), ""))
    found = [(a, b, k) for a, b, k in found if any(c.isdigit() for c in text[a:b]) or _secret_key(k)] + _key_blocks(text)
    out: list[tuple[int, int, str]] = []
    for a, b, k in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1]:
            if k and not out[-1][2]:  # the value inside name=value says more than the whole run
                out[-1] = (a, b, k)
            continue
        out.append((a, b, k))
    return out


#: Codes of letters: 0 is no letter, 1 to 26 a to z with or without marks, the rest are shared by the letters of other scripts.
_CODES = 64


@cache
def _code(c: str) -> int:
    """The code of a lower-case character."""
    base = unicodedata.normalize("NFD", c)[0]
    return ord(base) - 96 if "a" <= base <= "z" else 27 + ord(base) % (_CODES - 27) if base.isalpha() else 0


def _pairs(counts) -> np.ndarray:
    """Occurrences of letter pairs in (word, count) rows."""
    pairs = np.zeros((_CODES, _CODES))
    for w, n in counts:
        codes = [_code(c) for c in w]
        for a, b in zip(codes, codes[1:], strict=False):
            pairs[a, b] += n
    return pairs


@dataclass
class Language:
    """Common words, and log-probabilities of letter pairs in them."""

    words: frozenset[str]
    pairs: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, int], pairs: np.ndarray | None = None) -> Language:
        """``pairs``: letter pairs of all words, where ``counts`` has the common ones only."""
        pairs = 1 + (_pairs(counts.items()) if pairs is None else pairs)
        return cls(frozenset(w for w in counts if len(w) >= 3), np.log(pairs / pairs.sum(1, keepdims=True)))


def _kinds(s: str) -> list[int]:
    return [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in s]


def _coverage(s: str, words: frozenset[str]) -> float:
    """Share of the letters that a greedy longest match covers with dictionary words."""
    s = s.lower()
    letters = sum(c.isalpha() for c in s)
    if not letters:
        return 0.0
    at = got = 0
    while at < len(s):
        for n in range(min(12, len(s) - at), 2, -1):
            if s[at : at + n] in words:
                got += n
                at += n
                break
        else:
            at += 1
    return min(1.0, got / letters)


FEATURES = ("length", "changes", "letter_digit", "upper_share", "digit_share", "other_share", "hex_only", "entropy", "pair_log", "coverage", "assigned", "secret_word", "harmless_word", "secret_before", "harmless_before", "secret_after", "harmless_after", "dummy", "in_address", "slashes", "test_path", "at_sign", "digits_only", "repeats", "quoted")


def features(text: str, start: int, end: int, key: str, path: str, language: Language) -> list[float]:
    s = text[start:end]
    kinds = _kinds(s)
    n = len(s)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    mixed = sum({a, b} in ({0, 2}, {1, 2}) for a, b in zip(kinds, kinds[1:], strict=False))
    share = np.bincount([ord(c) % 256 for c in s], minlength=256) / n
    low = [_code(c) for c in s.lower()]
    pair = [language.pairs[a, b] for a, b in zip(low, low[1:], strict=False) if a and b]
    before = re.findall(r"\w+", text[max(0, start - 60) : start].lower())[-4:]
    after = re.findall(r"\w+", text[end : end + 40].lower())[:3]
    has = lambda words, of: float(_has(words, of))
    left = text[max(0, start - 80) : start].split()
    return [
        min(n, 256), changes / max(1, n - 1), mixed / max(1, n - 1), kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
        float(all(c in string.hexdigits for c in s)), float(-(share[share > 0] * np.log2(share[share > 0])).sum()),
        float(np.mean(pair)) if pair else -8.0, _coverage(s, language.words), float(bool(key)), has(_SECRET_WORDS, [key.lower()]), has(_HARMLESS_WORDS, [key.lower()]),
        has(_SECRET_WORDS, before), has(_HARMLESS_WORDS, before), has(_SECRET_WORDS, after), has(_HARMLESS_WORDS, after),
        float(any(w in s.lower() for w in _DUMMY)), float(text[start - 1 : start] in "/.@" and start > 0 or "://" in s or (bool(left) and "://" in left[-1] and not text[start - 1].isspace())),
        min(9, s.count("/") + s.count(".")), has(_TEST_PATHS, re.findall(r"[a-z]+", (path or "").lower())), float("@" in s), float(s.isdigit()),
        max(share) * n, float(text[start - 1 : start] in "\"'" and start > 0),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, children, share of secrets."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                f = feature[at[i]]
                at[i] = np.where(x[i, f] <= threshold[at[i]], left[at[i]], right[at[i]])
            total += value[at]
        return total / max(1, len(self.trees))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 5) -> Forest:
        rng = np.random.default_rng(seed)
        return cls([_tree(x[i], y[i], depth, least, rng) for i in (rng.integers(0, len(x), len(x)) for _ in range(trees))])


def _tree(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me, share = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, share])
        if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
            return me
        best = (share * (1 - share) * len(rows) - 1e-9, None, None)
        for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(v) - n >= least)
            if not ok.any():
                continue
            a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(v) - n)
            cost = np.where(ok, a * (1 - a) * n + b * (1 - b) * (len(v) - n), np.inf)
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (cost[k], f, v[k])
        if best[1] is None:
            return me
        goes = x[rows, best[1]] <= best[2]
        nodes[me][:2] = [best[1], best[2]]
        nodes[me][2], nodes[me][3] = grow(rows[goes], level + 1), grow(rows[~goes], level + 1)
        return me

    grow(np.arange(len(y)), 0)
    a = np.array(nodes, dtype=float)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


def labelled_findings(words: list[str], n: int = 3000, seed: int = 11, paths: bool = False) -> list[tuple[str, int, int, str, str, int]]:
    """(text, start, end, key, path, label): findings by a seeded rule, half of them secrets, among ``words``.

    ``paths``: whether documents come with paths; without, the path is empty here too, so the forest learns nothing
    from what scanning cannot know.
    """
    rng = np.random.default_rng(seed)
    words = words or ["the", "of", "and", "value", "is"]
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    hexes, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    b64 = alnum + "+/"
    some = lambda k: " ".join(rng.choice(words, k))

    def secret():
        kind = rng.integers(9)
        name = str(rng.choice(["password", "passwd", "secret", "token", "api_key", "access_key", "auth_token", "client_secret", "private_key", "credential"]))
        if kind == 0:
            return "", "AKIA" + pick(upper, 16)
        if kind == 1:
            return "", str(rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "npm_"])) + pick(alnum, int(rng.integers(20, 44)))
        if kind == 2:
            return "", ".".join(["eyJ" + pick(alnum, 17), "eyJ" + pick(alnum, 30), pick(alnum + "_-", 43)])
        if kind in (3, 4):
            return name, pick(hexes, int(rng.integers(12, 41)))
        if kind == 5:
            return name, pick(b64, int(rng.integers(16, 44)))
        if kind == 6:
            return name, pick(alnum + "!#$%&*", int(rng.integers(10, 24)))
        if kind == 7:  # a passphrase
            joint = str(rng.choice(["", "-", "_"]))
            return f"{rng.choice(['db', 'app', 'admin', 'user'])}_{name}", joint.join(str(w).capitalize() for w in rng.choice(words, int(rng.integers(3, 6)))) + str(rng.choice(["", "1", "!", "42"]))
        return "", pick(b64, 40)

    def harmless():
        kind = rng.integers(11)
        name = str(rng.choice(["sha256", "md5", "checksum", "digest", "commit", "revision", "etag", "build", "version", "uuid"]))
        if kind in (0, 1):
            return name, pick(hexes, int(rng.choice([32, 40, 64])))
        if kind == 2:
            return str(rng.choice(["", "uuid", "id"])), "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
        if kind == 3:
            return "", f"{pick(string.ascii_lowercase, int(rng.integers(3, 9)))}.{rng.integers(100):02d}@mail{rng.integers(10)}.example.com"
        if kind == 4:
            return str(rng.choice(["", "card", "phone", "order"])), pick(string.digits, int(rng.integers(16, 20)))
        if kind == 5:
            return "", "/".join([str(rng.choice(["https://", "http://"])) + str(rng.choice(words)).lower() + ".com", str(rng.choice(words)), str(rng.integers(2000, 2030)), str(rng.choice(words)) + ".html"])
        if kind == 6:
            return str(rng.choice(["password", "token", "api_key", "secret"])), str(rng.choice(["your_password_1", "changeme123", "example_token_0000", "xxxxxxxxxxxx1", "<password1>", "test_secret_12345"]))
        if kind == 7:
            return "", "_".join([*map(str, rng.choice(words, 3)), str(rng.integers(1000))])
        if kind == 8:
            return "", "".join(str(w).capitalize() for w in rng.choice(words, 4)) + str(rng.integers(100))
        if kind == 9:
            return "", "-".join([str(rng.integers(1900, 2030)), pick(string.digits, 2), pick(string.digits, 2)]) + "T" + ":".join(pick(string.digits, 2) for _ in range(3)) + "Z"
        return "", ".".join(map(str, rng.integers(0, 999, 6)))

    out = []
    for i in range(n):
        label = i % 2
        key, value = secret() if label else harmless()
        quote = str(rng.choice(["", '"']))
        lead = f"{some(int(rng.integers(0, 6)))} "
        if not key and not label and rng.random() < 0.3:
            lead += str(rng.choice(_HARMLESS_WORDS)) + " "
        if not key and label and rng.random() < 0.2:
            lead += str(rng.choice(_SECRET_WORDS)) + " "
        lead += f"{key}{rng.choice(['=', ' = ', ': '])}{quote}" if key else ""
        path = str(rng.choice(["", "src/app/config.py", "conf/settings.yml"] + ([] if label else ["tests/fixtures/data.json", "docs/example.md"]))) if paths else ""
        text = f"{lead}{value}{quote if key else ''} {some(int(rng.integers(0, 5)))}"
        out.append((text, len(lead), len(lead) + len(value), key, path, label))
    return out


def all_word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words of letters of any script over all texts, three to 24 long: (w, n, step of n on a logarithmic scale)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            words, _ = split_words(b.column("t"))
            words = pc.utf8_lower(words)
            words = words.filter(pc.match_substring_regex(words, "^\\pL{3,24}$"))
            got = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([got.field("values").cast(pa.string()), got.field("counts")], names=["w", "n"])

    got = docs.select(F.col(text).alias("t")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return materialise(got.withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")), "word-counts")


def letter_pairs(counts: DataFrame) -> np.ndarray:
    """Letter pairs over all rows of ``all_word_counts``: summed on the executors, at most 64 x 64 rows come back."""

    def run(batches):
        total = sum((_pairs(zip(b["w"], b["n"], strict=True)) for b in batches), np.zeros((_CODES, _CODES)))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"p": at, "n": total.ravel()[at].astype(np.int64)})

    got = counts.select("w", "n").mapInPandas(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_CODES * _CODES)
    for r in got:
        out[r["p"]] = r["n"]
    return out.reshape(_CODES, _CODES)


def word_counts(docs: DataFrame, text: str = "text", vocabulary: int = 20_000) -> dict[str, int]:
    """The ``vocabulary`` most frequent words of ``all_word_counts(docs)``."""
    return most_frequent(all_word_counts(docs, text), vocabulary)


def most_frequent(got: DataFrame, vocabulary: int = 20_000) -> dict[str, int]:
    """At most ``vocabulary`` words, by count, then word: a histogram of counts (some hundred steps, whatever the
    corpus) tells which steps come whole to the driver, and how many words of the next one.
    """
    left, least, part = vocabulary, 0, None
    for r in got.groupBy("step").agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():
        if r["k"] > left:
            least, part = r["step"] + 1, r["step"]
            break
        left, least = left - r["k"], r["step"]
    rows = got.where(F.col("step") >= least).select("w", "n").collect()
    if part is not None and left:
        rows += got.where(F.col("step") == part).orderBy(F.desc("n"), "w").select("w", "n").limit(left).collect()
    return {r["w"]: r["n"] for r in sorted(rows, key=lambda r: (-r["n"], r["w"]))}


def fit(language: Language, findings: list[tuple[str, int, int, str, str, int]], trees: int = 40) -> Forest:
    x = np.array([features(*f[:5], language) for f in findings])
    return Forest.fit(x, np.array([f[5] for f in findings]), trees)


def scan(docs: DataFrame, forest: Forest, language: Language, doc: str = "doc_id", text: str = "text", path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """All candidates: (doc, finding, start, length, key, sha256, probability, is_secret). The values stay out."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((forest, language))

    def run(batches):
        model, lang = shared.value
        for b in batches:
            rows, x = [], []
            for d, t, p in zip(b["d"], b["t"], b["p"], strict=True):
                for i, (start, end, key) in enumerate(candidates(t) if t else ()):
                    rows.append((d, i, start, end - start, key, hashlib.sha256(t[start:end].encode()).hexdigest()))
                    x.append(features(t, start, end, key, p, lang))
            out = pd.DataFrame(rows, columns=["d", "finding", "start", "length", "key", "sha256"])
            out["probability"] = model.predict(np.array(x)).round(6) if x else np.zeros(0)
            out["is_secret"] = out["probability"] >= threshold
            yield out.astype({"finding": "int64", "start": "int64", "length": "int64"})

    kind = docs.schema[doc].dataType.simpleString()
    got = docs.select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t"), (F.col(path) if path else F.lit("")).cast("string").alias("p"))
    got = got.mapInPandas(run, "d string, finding long, start long, length long, key string, sha256 string, probability double, is_secret boolean")
    return got.select(F.col("d").cast(kind).alias(doc), *got.columns[1:])
