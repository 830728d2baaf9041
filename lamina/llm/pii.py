"""Personal data: generators propose spans, boosted trees choose among them.

Four base kinds follow fixed formats and always stand. High-recall generators add candidates of
other forms (local telephone numbers, spelled-out addresses, national numbers, bank accounts,
IPv6). For each, boosted trees read its format (digits, groups, separators, check digits) and its
context (neighbouring characters and words); isotonic calibration on held-out folds turns scores
into probabilities, and each kind's threshold is the lowest that keeps the wanted precision there.
The training set is made from templates by a fixed seed: its size is a parameter, the corpus plays
no part in it. Candidates that overlap a base span or a better candidate are dropped.

Defined results. Null text: no spans. Empty tables: empty results. Repeated rows are scanned each.
Matching is linear in a text's length, but for a binary search for each candidate, so long texts
need no cut. Candidates of equal probability: the longer, then the earlier one. ``redact`` adds no
column; where ``scan`` adds one of a name that is taken, its own replaces the other.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.boost import Boosted, fit
from lamina.llm.common import Taken, documents, widened, without

BASE = ("email", "ip", "card", "phone")
EXTRA = ("number", "spelled", "national", "account", "ip6")
KINDS = (*BASE, *EXTRA)
TRAIN_ROWS = 6000
PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GENERATORS = {
    "number": re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])"),
    "national": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
}
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE | re.ASCII)
_CUES = re.compile(r"(?:tel|phone|call|mobile|cell|fax|mail|contact|ssn|social|account|iban|bank|address)[a-z]{0,6}[:.#\s]{0,3}\Z", re.IGNORECASE)
_AGAINST = re.compile(r"(?:version|v|release|page|section|order|isbn|figure|chapter|no|id|date|on|total|\$|€)[.:#\s]{0,3}\Z", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at-signs so that long runs cost no more than their length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, in order of start, then kind."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2]), s[1]))


def proposals(text: str) -> list[tuple[int, int, str]]:
    """Overlapping candidates of the added kinds."""
    out = []
    if _DIGIT.search(text):
        for kind, pattern in _GENERATORS.items():
            if kind == "ip6" and ":" not in text:
                continue
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    if "(" in text or "[" in text:
        out += [(m.start(), m.end(), "spelled") for m in _SPELLED.finditer(text)]
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    digits = [c for c in s if "0" <= c <= "9"]
    groups = re.findall(r"[0-9]+", s)
    iban = 0.0
    if kind == "account":
        t = s.replace(" ", "")
        iban = float(int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1)
    return [
        *(float(kind == k) for k in EXTRA),
        float(len(s)), float(len(digits)), float(len(groups)),
        float(len(groups[0])) if groups else 0.0, float(len(groups[-1])) if groups else 0.0, float(max(map(len, groups))) if groups else 0.0,
        float(s.count("-")), float(s.count(".")), float(s.count(" ")), float("(" in s),
        float(len(set(digits))), float(luhn("".join(digits))) if digits else 0.0, iban,
        float(bool(groups) and len(groups[0]) == 4 and groups[0][:2] in ("19", "20")), float(bool(groups) and len(groups[-1]) == 4 and groups[-1][:2] in ("19", "20")),
        float(bool(_CUES.search(before))), float(bool(_AGAINST.search(before))),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(after[:1] in ".,;" and after[:1] != ""), float(before[-1:] in "$€#/=_"),
    ]


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates from templates: personal data as it is written, and other numbers that look alike."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))

    def iban() -> str:
        body = r.choice(["DE", "FR", "ES", "GB"])
        tail = d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in tail + body + "00")) % 97
        return f"{body}{check:02d}{tail}"

    yes = [
        lambda: f"({r.randint(2, 9)}{d(2)}) {r.randint(2, 9)}{d(2)}-{d(4)}", lambda: f"{r.randint(2, 9)}{d(2)}-{r.randint(2, 9)}{d(2)}-{d(4)}", lambda: f"{r.randint(2, 9)}{d(2)}.{r.randint(2, 9)}{d(2)}.{d(4)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
        lambda: f"{r.randint(1, 8)}{d(2)}-{d(2)}-{d(4)}", iban, lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8)), lambda: f"{w()}.{w()} (at) {w()} (dot) com", lambda: f"{w()}[at]{w()}[dot]org", lambda: f"{w()} [at] {w()}.net",
    ]
    no = [
        lambda: f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.20{d(2)}", lambda: d(r.randint(7, 15)), lambda: f"{r.randint(1, 99)}.{d(2)}.{d(3)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"{d(4)} {d(4)}", lambda: f"{d(1)}.{d(7)}", lambda: f"19{d(2)}-20{d(2)}", lambda: f"GB{d(2)} {d(4)} {d(4)} {d(4)}", lambda: f"20{d(2)}{d(4)} {d(6)}",
    ]
    cue = ["call ", "tel: ", "phone ", "contact ", "mail ", "iban ", "ssn "]
    against = ["version ", "order ", "page ", "no. ", "on ", "$", "isbn ", "id "]
    x, y = [], []
    while len(y) < n:
        good = r.random() < 0.5
        s = r.choice(yes if good else no)()
        lead = r.choice(cue) if r.random() < (0.3 if good else 0.03) else r.choice(against) if r.random() < (0.02 if good else 0.4) else ""
        text = f"{w()} {lead}{s}{r.choice(['', '.', ','])} {w()}"
        at = text.index(s)
        for a, b, kind in proposals(text):
            if a < at + len(s) and b > at:
                x.append(features(text, a, b, kind))
                y.append(float(good and a >= at and b <= at + len(s) and b - a >= len(s) - 1))
    return np.array(x), np.array(y)


@lru_cache(maxsize=4)
def model(rows: int = TRAIN_ROWS, precision: float = PRECISION, seed: int = 20) -> tuple[Boosted, tuple[float, ...]]:
    """The trees and each added kind's threshold: the lowest with ``precision`` on fresh examples, else none passes."""
    x, y = _examples(rows, seed)
    trees = fit(x, y, trees=40)
    x, y = _examples(rows, seed + 1)
    p, out = trees.predict(x), []
    for k in range(len(EXTRA)):
        own = x[:, k] == 1
        order = np.argsort(-p[own], kind="stable")
        good = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        ps = p[own][order]
        last = np.append(ps[1:] != ps[:-1], True) if len(ps) else np.zeros(0, bool)
        fine = ps[last & (good >= precision)]
        out.append(float(max(fine.min(), 0.5)) if len(fine) else 2.0)
    return trees, tuple(out)


def find(text: str, trees: Boosted, thresholds: tuple[float, ...]) -> tuple[list, list]:
    """(base spans, added spans) of a text."""
    base = base_spans(text)
    taken = Taken(base)
    asked = [c for c in proposals(text) if not taken.meets(c[0], c[1])]
    if not asked:
        return base, []
    p = trees.predict(np.array([features(text, *c) for c in asked]))
    added: list[tuple[int, int, str]] = []
    for i in sorted(range(len(asked)), key=lambda i: (-p[i], asked[i][0] - asked[i][1], asked[i][0])):
        a, b, kind = asked[i]
        if p[i] >= thresholds[EXTRA.index(kind)] and not taken.meets(a, b):
            taken.add(a, b)
            added.append(asked[i])
    return base, added


def joined(spans, kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1])))


def scan(rows: DataFrame, *, text: str = "text") -> DataFrame:
    """``rows`` without the text, with counts and spans of personal data (columns pii_*)."""
    names = [f"pii_{k}" for k in (*BASE, "base_sha256", "spans")]
    rows = without(rows, *names)
    at = rows.columns.index(text)
    trees, thresholds = model()

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("email", "ip", "card", "phone", "base", "all")}
            for v in batch.column(at):
                base, added = find(v.as_py() or "", trees, thresholds)
                for k in BASE:
                    out[k].append(sum(s[2] == k for s in base))
                out["base"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["all"].append(joined(base + added))
            thin = batch.drop_columns([batch.schema.names[at]])
            new = [pa.array(out[k], pa.int64()) for k in BASE] + [pa.array(out[k], pa.string()) for k in ("base", "all")]
            yield pa.RecordBatch.from_arrays([*thin.columns, *new], names=[*thin.schema.names, *names])

    return rows.mapInArrow(run, widened(rows.drop(text), dict(zip(names, ["long"] * 4 + ["string"] * 2))))


def redact(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    at = docs.columns.index(text)
    count = docs.columns.index(length) if length in docs.columns else None
    trees, thresholds = model()

    def clean(s: str | None) -> str | None:
        if not s:
            return s
        base, added = find(s, trees, thresholds)
        spans = sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))
        if not spans:
            return s
        out, done, end = [], 0, -1
        for a, b, kind in spans:
            if a < end:
                end = max(end, b)
                done = end
                continue
            out += [s[done:a], f"<{kind.upper()}>"]
            done = end = b
        return "".join([*out, s[done:]])

    def run(batches):
        for batch in batches:
            new = [clean(v.as_py()) for v in batch.column(at)]
            cols = list(batch.columns)
            cols[at] = pa.array(new, pa.string())
            if count is not None:
                cols[count] = pa.array([old if n is None else len(n) for old, n in zip(batch.column(count).to_pylist(), new)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *(F.col(f"pii_{k}").alias(f"n_{k}") for k in BASE), F.col("pii_base_sha256").alias("base_sha256"), F.col("pii_spans").alias("spans"))


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
