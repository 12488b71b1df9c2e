"""Personal data: base patterns, and candidates judged by gradient-boosted trees.

Base matches are fixed rules and always stay. Beyond them, high-recall generators propose
spans that may overlap: grouped digits, obfuscated addresses, keys, account and identity
numbers. Boosted trees score each from its format and context, a calibrated probability
is held against its kind's threshold, and of overlapping spans the likelier stays.
The trees are fitted on rendered examples, drawn with a fixed seed.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans are listed.
KINDS = (*BASE, "account", "identity", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @ so that the cost stays linear."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def digits_of(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Matches of the base rules by kind: leftmost, non-overlapping, those that fail a check dropped."""
    out = {"email": emails(text) if "@" in text else []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.lstrip("0") else 0) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() > 15 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return out


# Candidates -----------------------------------------------------------------

#: Groups in full, or with one '::' at any place that stands for the missing ones.
_IPV6 = re.compile(
    r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f:]{0,30}[0-9A-Fa-f]{1,4}"
    r"|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
    r"|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:])"
)


class _Runs:
    """A pattern of runs, without those that go on in a word. Asked after the match, so that a long run that does is read once."""

    groups, _word = 0, re.compile(r"\w")

    def __init__(self, pattern: re.Pattern[str]) -> None:
        self.pattern = pattern

    def finditer(self, text: str) -> Iterator[re.Match[str]]:
        return (m for m in self.pattern.finditer(text) if not self._word.match(text, m.end()))


#: Generators: pattern (the candidate is its group, if it has one), and a cheaper pattern that every match of it holds (None: it runs on every text).
#: Runs have no upper length; a run that fails is tried again from few places only, so the cost stays linear.
GENERATORS = {
    "digits": (_Runs(re.compile(r"(?<![\w.])\(?[0-9](?:[ ()./-]{0,2}[0-9]){5,}+")), re.compile(r"[0-9][ ()./-]{0,2}[0-9][ ()./-]{0,2}[0-9]")),
    "hidden_email": (re.compile(r"(?:(?<![\w.+-])[\w.+-]++|(?<![\w.])[\w.+-]{1,40}+)\s?[\[(<{ ]\s?at\s?[\])>} ]\s?[\w-]++(?:\s?[\[(<{ ]\s?dot\s?[\])>} ]\s?[\w-]++)++", re.I), re.compile("dot", re.I)),
    "key": (re.compile(r"(?<![A-Za-z0-9_])(?:[0-9a-f]{32,}+|[A-Za-z]{2,6}[-_][A-Za-z0-9_-]{16,}+|AKIA[0-9A-Z]{16}|[A-Za-z0-9+/]{40,}={0,2})(?![A-Za-z0-9_])"), None),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), None),
    "ipv6": (_IPV6, re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]|::[0-9A-Fa-f]")),
    "assigned": (re.compile(r"(?<![^\W_])(?:passw(?:or)?d|passwort|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\w*+[\"']?\s?[:=]\s?[\"']?([^\s\"',;<>]{6,}+)", re.I), re.compile(r"[:=]\s?[\"']?[^\s\"',;<>]{6}")),
    "jwt": (re.compile(r"(?<![\w-])eyJ[\w-]++\.[\w-]++\.[\w-]*+", re.A), re.compile("eyJ")),
    "pem": (re.compile(r"-----BEGIN [A-Z0-9 ]*+-----[^-]*+(?:-(?!----)[^-]*+)*+(?:-----END [A-Z0-9 ]*+-----)?"), re.compile("-----BEGIN ")),
}

# Words that come before personal data, by the kind they point to.
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "anruf", "llamar", "telefono", "appel", "whatsapp"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "cvv"),
    "account": ("iban", "account", "konto", "compte", "cuenta", "bank", "routing"),
    "identity": ("ssn", "social", "passport", "national", "identity", "ausweis", "dni", "tax", "insurance"),
    "secret": ("token", "key", "secret", "password", "passwd", "api", "bearer", "auth", "credential"),
    "email": ("mail", "email", "e-mail", "contact", "write", "correo"),
    "ip": ("ip", "host", "server", "address", "addr", "ping"),
    "no": ("order", "invoice", "isbn", "issn", "version", "build", "page", "year", "figure", "table", "total", "price", "ticket", "commit", "md5", "sha1", "sha256", "checksum", "hash", "part", "item", "id", "no", "serial", "doi"),
}
_WORD = re.compile(r"[\w-]+")
#: Characters of context on each side.
CONTEXT = 40
FEATURES = 14 + len(GENERATORS) + len(CUES) + 8


def candidate_features(text: str, start: int, end: int, generator: str) -> list[float]:
    """Format and context of a candidate span."""
    s = text[start:end]
    d = digits_of(s)
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 8]
    words = [w.lower() for w in _WORD.findall(before)][-4:]
    distinct = len(set(s)) / max(len(s), 1)
    date = len(groups) == 3 and sorted(map(len, groups)) in ([2, 2, 4], [1, 2, 4], [1, 1, 4])
    out = [
        len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(luhn(d)) if len(d) >= 12 else 0.0, distinct, float(date), s.count("-"), s.count(" "), s.count("."), s.count("/"),
        float("(" in s), sum(c.isalpha() for c in s) / max(len(s), 1),
    ]
    out += [float(generator == g) for g in GENERATORS]
    out += [float(any(w.startswith(cue) if len(cue) > 3 else w == cue for w in words for cue in cues)) for cues in CUES.values()]
    tight = before.rstrip(" ")[-1:]
    out += [
        float(tight in ":=#\"'"), float(tight in ":="), float(tight in "$€£"), float(before[-1:] == "+"), float(after[:1] in "%€$£"),
        float(any(c.isdigit() for c in before[-3:])), float(bool(before.strip()) and not words), float(s.islower() or s.isupper()),
    ]
    return out


def kind_of(text: str, start: int, end: int, generator: str, x: list[float]) -> str:
    """The kind that a candidate is redacted as, by its generator, format and cues."""
    if generator != "digits":
        return {"hidden_email": "email", "iban": "account", "ipv6": "ip"}.get(generator, "secret")
    cue = dict(zip(CUES, x[14 + len(GENERATORS) :], strict=False))
    n = int(x[1])
    if cue["identity"] and n <= 12 or [len(g) for g in re.split(r"[^0-9]+", text[start:end]) if g] == [3, 2, 4]:
        return "identity"
    if cue["account"]:
        return "account"
    return "card" if n >= 13 else "phone"


#: The threshold of a kind whose precision no other reaches on the held-out rows, or that has none.
STRICT = 0.99

# Boosted trees --------------------------------------------------------------


@dataclass
class Trees:
    """Boosted depth-limited trees for log loss, with a calibration of the summed score."""

    trees: list[list[tuple[int, float, int, int, float]]]  # nodes: feature, cut, left, right, value
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)  # of each kind

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            f, c, left, right, v = (np.array(z) for z in zip(*nodes, strict=True))
            while (go := left[at] >= 0).any():
                i = np.flatnonzero(go)
                n = at[i]
                at[i] = np.where(x[i, f[n]] <= c[n], left[n], right[n])
            out += v[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.3, leaf: float = 1.0) -> Trees:
    """Gradient boosting with Newton leaves; cuts lie between values."""
    cuts = [np.unique(c)[:-1] for c in x.T]
    cuts = [c if len(c) <= 32 else np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in cuts]
    score, model = np.zeros(len(x)), Trees([])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes.append((0, 0.0, -1, -1, rate * gs / (hs + leaf)))
            best = (1e-6, None, None)
            for f in range(x.shape[1]) if level < depth else ():
                col = x[rows, f]
                for c in cuts[f]:
                    m = col <= c
                    gl, hl = g[rows][m].sum(), h[rows][m].sum()
                    if hl < 1e-3 or hs - hl < 1e-3:
                        continue
                    gain = gl * gl / (hl + leaf) + (gs - gl) ** 2 / (hs - hl + leaf) - gs * gs / (hs + leaf)
                    if gain > best[0]:
                        best = (gain, f, c)
            if best[1] is not None:
                m = x[rows, best[1]] <= best[2]
                a, b = grow(rows[m], level + 1), grow(rows[~m], level + 1)
                nodes[me] = (best[1], float(best[2]), a, b, 0.0)
            return me

        grow(np.arange(len(x)), 0)
        model.trees.append(nodes)
        score = score + Trees([nodes]).raw(x)
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, kinds: list[str], precision: float) -> None:
    """Fit the logistic calibration on held-out rows, and for each kind the least threshold, an even chance at least, that reaches the precision on its own."""
    s = model.raw(x)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * s + b)))
        ga, gb = ((p - y) * s).mean() + 1e-3 * a, (p - y).mean()
        a, b = a - 0.05 * ga, b - 0.5 * gb
    model.slope, model.shift = float(a), float(b)
    p, kind = model.probability(x), np.array(kinds)
    for k in sorted(set(kinds)):
        mine = kind == k
        reached = (t for t in np.linspace(0.5, 0.99, 50) if (chosen := mine & (p >= t)).any() and y[chosen].mean() >= precision)
        model.thresholds[k] = float(next(reached, STRICT))


def examples(n: int, seed: int) -> list[tuple[str, int, int, str, int]]:
    """Rendered candidates: text, start, end, generator, and whether it is personal data."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = lambda kind: r.choice(CUES[kind])
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "ti", "en", "chi", "la", "de")) for _ in range(r.randint(1, 4)))
    hexed = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", " ", "-", "/"))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{num(2)} {num(3)} {num(4)}", f"{a} {b} {c}", f"0{num(3)}/{num(6)}"))

    good = (
        lambda: (pick("phone"), phone()),
        lambda: (pick("card"), card()),
        lambda: (pick("identity"), f"{num(3)}-{num(2)}-{num(4)}"),
        lambda: (pick("account"), num(r.randint(8, 14))),
        lambda: (pick("account"), f"{r.choice(('DE', 'FR', 'ES', 'GB'))}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}"),
        lambda: (pick("email"), f"{word()}.{word()} at {word()} dot com"),
        lambda: (pick("email"), f"{word()} [at] {word()} [dot] org"),
        lambda: (pick("secret") + r.choice((" =", ":", " = \"", "=")), hexed(r.choice((32, 40, 64)))),
        lambda: (pick("secret") + r.choice((" =", ":", "=")), f"sk-{hexed(8)}{num(4)}{hexed(20)}"),
        lambda: (pick("ip"), ":".join(hexed(4) for _ in range(8))),
        lambda: (r.choice((word(), pick("secret"))), "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))),
        lambda: (word(), f"{r.choice(('password', 'passwd', 'pwd', 'secret', 'api_key'))}{r.choice(('=', ': ', ' = '))}{r.choice((hexed(r.randint(8, 40)), word().title() + num(3) + r.choice('!$%&') + hexed(4)))}"),
        lambda: (r.choice((word(), pick("secret"))), f"eyJ{mixed(20)}.eyJ{mixed(r.randint(20, 90))}.{mixed(43)}"),
        lambda: (word(), f"-----BEGIN {r.choice(('', 'RSA ', 'EC '))}PRIVATE KEY-----\n{mixed(64)}\n{mixed(64)}\n-----END PRIVATE KEY-----"),
    )
    bad = (
        lambda: (pick("no"), num(r.randint(6, 20))),
        lambda: (pick("no"), f"{num(3)}-{num(1)}-{num(2)}-{num(6)}"),
        lambda: (word(), num(r.randint(6, 19))),
        lambda: (word(), f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}"),
        lambda: (word(), f"{num(2)}/{num(2)}/{r.randint(1900, 2030)}"),
        lambda: (word(), f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}"),
        lambda: (pick("no"), f"{num(2)}.{num(3)}.{num(3)}"),
        lambda: (word() + r.choice((" $", " €")), f"{num(3)} {num(3)} {num(2)}"),
        lambda: (pick("no"), hexed(r.choice((32, 40, 64)))),
        lambda: (word(), hexed(r.choice((32, 40, 64)))),
        lambda: (word(), " ".join(num(r.randint(1, 3)) for _ in range(r.randint(5, 9)))),
        lambda: (word(), f"{word()} at {word()} dot {word()}"),
        lambda: (word(), "ab-" + "".join(word() for _ in range(8))),
        lambda: (word(), ":".join(num(2) for _ in range(4))),
        lambda: (word(), "".join(word() for _ in range(20))),
        lambda: (word(), phone()[1:8] + num(2)),
        lambda: (word(), f"{pick('secret')}{r.choice((': ', ' = '))}{word()}{word()}{word()}"),
        lambda: (word(), f"{r.choice(('token', 'secret', 'auth'))}: {word()}-{word()}-{word()}"),
        lambda: (word(), f"-----BEGIN CERTIFICATE-----\n{mixed(64)}\n-----END CERTIFICATE-----"),
    )
    out = []
    while len(out) < n:
        label = r.random() < 0.4
        cue, span = r.choice(good if label else bad)()
        head = " ".join(word() for _ in range(r.randint(0, 6)))
        text = f"{head} {cue} " + r.choice(("", "", "is ", "no. ")) + span + r.choice((" ", ". ", ", ", "\n")) + word()
        for a, b, generator in candidates(text):
            inside = text.find(span)
            hit = label and 2 * (min(b, inside + len(span)) - max(a, inside)) > len(span)  # most of it; parts of it are no data of their own
            out.append((text, a, b, generator, int(hit)))
    return out[:n]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """What the generators propose; spans may overlap."""
    out = []
    for name, (pattern, gate) in GENERATORS.items():
        if gate is None or gate.search(text):
            out += [(*m.span(pattern.groups), name) for m in pattern.finditer(text)]
    return out


@cache
def model(n: int = 3000, seed: int = 7, precision: float = 0.99) -> Trees:
    """The fitted trees; fitted once in the driver's process."""
    rows = examples(2 * n, seed)
    x = np.array([candidate_features(t, a, b, g) for t, a, b, g, _ in rows])
    y = np.array([v for *_, v in rows], float)
    trees = boost(x[:n], y[:n])
    calibrate(trees, x[n:], y[n:], [kind_of(*row[:4], list(f)) for row, f in zip(rows[n:], x[n:], strict=True)], precision)
    return trees


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], trees: Trees) -> list[tuple[str, int, int, float]]:
    """Spans beyond the base ones: kind, start, end and probability; none overlaps another or a base span."""
    found = candidates(text)
    if not found:
        return []
    fixed = sorted(s for spans in base.values() for s in spans)
    starts, ends = [a for a, _ in fixed], list(accumulate((b for _, b in fixed), max))
    found = [c for c in found if not (n := bisect_left(starts, c[1])) or ends[n - 1] <= c[0]]
    if not found:
        return []
    x = [candidate_features(text, *c) for c in found]
    p = trees.probability(np.array(x))
    out: list[tuple[str, int, int, float]] = []
    chosen: list[tuple[int, int]] = []  # sorted and apart, so that only the neighbours can overlap
    for i in np.lexsort(([c[0] for c in found], -p)):
        a, b, g = found[i]
        if p[i] < trees.thresholds.get(kind := kind_of(text, a, b, g, x[i]), STRICT):
            continue
        n = bisect_left(chosen, (a, b))
        if (n == len(chosen) or chosen[n][0] >= b) and (not n or chosen[n - 1][1] <= a):
            chosen.insert(n, (a, b))
            out.append((kind, a, b, float(p[i])))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by <KIND>; of overlapping ones the first to start covers the rest."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """Personal data of every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans
    (base and added, kind:start:end in code points, end exclusive) and n_added; with
    redacted=True also text, with every span replaced by its kind.

    A null text counts as empty (redacted: null); a text without matches has empty spans.
    Equal probabilities go to the earlier span. Repeated rows are treated alike, a null
    doc_id is kept, an empty table gives no rows; other columns are ignored.
    """
    trees = model()
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", *["text"] * redacted]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                t = text or ""
                base = base_spans(t)
                flat = [(k, a, b) for k in BASE for a, b in base[k]]
                more = [(k, a, b) for k, a, b, _ in added_spans(t, base, trees)]
                row = [*(len(base[k]) for k in BASE), hashlib.sha256(listed(flat).encode()).hexdigest(), listed(flat + more), len(more)]
                rows.append([*row, text and redact(text, flat + more)] if redacted else row)
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * redacted
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long" + ", text string" * redacted
    return docs.select("doc_id", "text").mapInArrow(find, schema)
