"""Personal data by candidate gradient boosting.

Two layers.  The base patterns find well-formed e-mail addresses, IPv4
addresses, card numbers (16 to 19 digits, Luhn) and international phone numbers.
The method adds what they miss: high-recall generators propose overlapping spans
(addresses written with "at" and "dot", national phone numbers, short or
dot-separated card numbers, IP addresses with bracketed or spaced dots), boosted
trees score each from its format and its context, and a threshold for each kind,
calibrated on held-out rows of that kind, selects spans.  Overlapping choices go
to the more probable, then the earlier.

The trees are trained on a labelled sample written here by templates
(``SAMPLE`` rows, fixed seed): personal data of each kind in sentences, and
look-alikes such as order and part numbers, book numbers, versions, dates and
times, coordinates and amounts.

Cases: a null or empty text has no spans; a null id stays null; further columns
are not read; of equal probabilities the earlier candidate wins; places are code points, end
exclusive; very long texts take time in proportion (no pattern backtracks over
more than a token); repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Boosted

KINDS = ["email", "ip", "card", "phone"]

#: Rows of the labelled sample that the trees are trained on.
SAMPLE = 4000

# Fixed patterns of the base spans.  Runs of digits are entered at their start
# only and never given back, which finds the same spans in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators of further candidates.
AT = r"(?:\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s|@)"
DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)"
AT_DOT = re.compile(rf"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{{2,64}}{AT}[A-Za-z0-9-]{{2,63}}(?:{DOT}[A-Za-z]{{2,24}}){{1,3}}(?![A-Za-z])")
NUMBER = re.compile(r"(?<![0-9])\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,22}(?![0-9])")

IP_PART = r"[0-9]{1,3}"
IP_DOT = r"(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\s\.\s?|\sdot\s)"
IP_WIDE = re.compile(rf"(?<![0-9.]){IP_PART}(?:{IP_DOT}{IP_PART}){{3}}(?![0-9])")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches: each @ with the run before it, from the last match's end on."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_END.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    out["email"] = emails(text)
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = digits_of(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that high-recall generators propose; those of different kinds overlap."""
    out = []
    for m in NUMBER.finditer(text):
        n = sum("0" <= c <= "9" for c in m[0])
        if 7 <= n <= 15:
            out.append(("phone", m.start(), m.end()))
        if 13 <= n <= 19:
            out.append(("card", m.start(), m.end()))
    if any(c in text for c in "[({<") or " dot " in text or " DOT " in text or "@" in text:
        out += [("email", *m.span()) for m in AT_DOT.finditer(text)]
    if any(c in text for c in ("[", "(", "{", " . ", " dot ", " .")):
        out += [("ip", *m.span()) for m in IP_WIDE.finditer(text)]
    return out


# Words that stand near personal data, or near numbers that are not.
NEAR = {
    "phone": ["phone", "call", "tel", "mobile", "fax", "dial", "contact", "whatsapp", "sms", "telefon"],
    "card": ["card", "visa", "credit", "debit", "payment", "mastercard", "amex", "karte", "tarjeta"],
    "email": ["mail", "write", "contact", "reach", "address", "send", "correo"],
    "ip": ["ip", "host", "server", "address", "ping", "router", "gateway", "client", "dns", "adresse"],
    "none": ["order", "invoice", "version", "isbn", "ticket", "serial", "total", "build", "part", "ref", "id", "date", "issn", "ean", "model", "section", "chapter", "lat", "lon", "pi"],
}
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")
DECIMAL = re.compile(r"[0-9]+\.[0-9]+$")


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the span and words of its context (40 characters before, 16 after)."""
    s = text[start:end]
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 16].lower()
    d = digits_of(s)
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g] or [0]
    near = re.findall(r"[a-zà-ÿ]+", before)[-4:]
    has = lambda k: float(any(w.startswith(tuple(NEAR[k])) for w in near))
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(d)), float(len(groups)), float(max(groups)), float(min(groups)),
        float(luhn(d)) if d else 0.0, float(d[:1] in ("3", "4", "5", "6")), float(s.startswith("(")), float(s.count("-")), float(s.count(".")), float(s.count(" ")), float(s.count("/")),
        float(d.startswith("0")), float("dot" in s.lower()), float(bool(re.search(r"\b(at|AT)\b|@", s))), float("[" in s or "(" in s), has(kind), has("none"),
        float(bool(DATE.match(s))), float(bool(DECIMAL.match(s))), float(d[:3] in ("978", "979") and len(d) in (10, 13)), max([float(g) for g in re.findall(r"[0-9]{1,3}", s)] or [0.0]) if kind == "ip" else 0.0,
        float(before[-1:] in ("#", "$", "€", "v", "-", "/")), float(after[:1] in ("%", "/", "-", ".")) if after else 0.0, float(after[:1].isalpha()) if after else 0.0,
    ]


def sample(rows: int = SAMPLE, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Labelled features: candidates of written sentences, right or not."""
    r = random.Random(seed)
    digits = lambda n, first="0123456789": r.choice(first) + "".join(r.choice("0123456789") for _ in range(n - 1))

    def card(n: int) -> str:
        d = digits(n - 1, "3456")
        return d + next(c for c in "0123456789" if luhn(d + c))

    def split(d: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(d[at : at + k])
            at += k
        return sep.join(out)

    names = ["anna", "j.smith", "maria_lopez", "bob77", "info", "k.mueller", "sales"]
    hosts = ["example", "mail", "acme-corp", "uni", "kontor"]
    fill = ["see the", "we met on", "the result was", "it ran for", "about", "and then", "near", "in the year", "a b c"]
    xs, ys = [], []
    while len(xs) < rows:
        kind, right = r.choice(["phone", "card", "email", "ip"]), r.random() < 0.5
        if kind == "email":
            dot, at = r.choice([" dot ", "[dot]", " [dot] ", " (dot) ", " DOT "]), r.choice([" at ", "[at]", " (at) ", " AT ", "@"])
            s = f"{r.choice(names)}{at}{r.choice(hosts)}{dot}{r.choice(['com', 'org', 'de', 'net'])}" if right else f"{r.choice(['look', 'arrived', 'stood', 'was'])} at {r.choice(['that', 'the', 'noon', 'least'])} dot {r.choice(['and', 'matrix', 'product', 'on'])}"
            cue = r.choice(NEAR["email"]) if right and r.random() < 0.8 else r.choice(fill)
        elif kind == "ip":
            dot = r.choice(["[.]", "(.)", " [.] ", "[dot]", " dot ", " . "])
            parts = [str(r.randint(1, 255)) if right or r.random() < 0.3 else str(r.randint(256, 999)) for _ in range(4)]
            s = dot.join(parts)
            right = all(int(p) < 256 for p in parts)
            cue = r.choice(NEAR["ip"]) if right and r.random() < 0.8 else r.choice(NEAR["none"] + fill)
        elif kind == "phone":
            if right:
                s = r.choice([lambda: f"({digits(3, '23456789')}) {digits(3)}-{digits(4)}", lambda: f"{digits(3, '23456789')}-{digits(3)}-{digits(4)}", lambda: f"0{digits(3)} {digits(7)}", lambda: f"0{digits(2)}/{digits(7)}", lambda: split("0" + digits(9), [2, 2, 2, 2, 2], r.choice(". "))])()
            else:
                s = r.choice([lambda: digits(r.randint(7, 15)), lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/19{digits(2)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{digits(1)}.{digits(2)}.{digits(4)}.{digits(2)}", lambda: f"20{digits(2)}-{digits(2, '01')}-{digits(2, '012')} {digits(2, '012')}", lambda: f"{r.randint(0, 180)}.{digits(r.randint(6, 12))}", lambda: f"{digits(4)} {digits(7)}", lambda: f"0{digits(3)} {digits(7)}", lambda: f"97{r.choice('89')}-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}"])()
            # A national number and a part number may look alike; then the words before them tell.
            cue = r.choice(NEAR["phone"]) if right and r.random() < 0.95 else r.choice(NEAR["none"] * 2 + fill)
        else:
            if right:
                n = r.choice([13, 14, 15, 16])
                sizes = {13: [4, 4, 5], 14: [4, 6, 4], 15: [4, 6, 5], 16: [4, 4, 4, 4]}[n]
                s = split(card(n), sizes if r.random() < 0.7 else [n], r.choice([".", "-", " "]))
            else:
                book = [f"97{r.choice('89')}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"97{r.choice('89')}{digits(10)}"]
                s = r.choice([digits(r.randint(13, 19), "0123456789"), *book, f"{r.randint(0, 99)}.{digits(r.randint(12, 16))}", split(digits(16), [4, 4, 4, 4], r.choice(".- "))])
            cue = r.choice(NEAR["card"]) if right and r.random() < 0.9 else r.choice(NEAR["none"] + fill)
        text = f"{r.choice(fill)} {cue}{r.choice([':', '', ' is', ' no.'])} {s}{r.choice(['.', ',', '', ' ok'])}"
        at = text.index(s)
        xs.append(features(kind, text, at, at + len(s)))
        ys.append(right)
    return np.array(xs), np.array(ys)


#: The least precision on held-out rows of a kind from which its candidates are taken.
PRECISION = 0.98


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, dict[str, float]]:
    """The trees and the threshold of each kind: the lowest at which the held-out rows of the kind reach PRECISION."""
    trees = Boosted().fit(*sample())
    x, y = sample(seed=18)
    p, kind = trees.probability(x), x[:, 0].astype(int)
    thresholds = {}
    for k, name in enumerate(KINDS):
        order = np.flatnonzero(kind == k)[np.argsort(-p[kind == k], kind="stable")]
        good = np.flatnonzero(np.cumsum(y[order]) >= PRECISION * np.arange(1, len(order) + 1))
        thresholds[name] = float(max(0.5, p[order[good[-1]]])) if len(good) else 1.0
    return trees, thresholds


def all_spans(text: str, fitted: tuple[Boosted, dict[str, float]]) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The base spans, and the base spans with those that the trees select."""
    trees, thresholds = fitted
    base = base_spans(text)
    more = {k: list(v) for k, v in base.items()}
    taken = [s for v in base.values() for s in v]
    found = [c for c in candidates(text) if not any(c[1] < e and s < c[2] for s, e in taken)]
    if found:
        p = trees.probability(np.array([features(k, text, s, e) for k, s, e in found]))
        chosen: list[Span] = []
        for i in np.argsort(-p, kind="stable"):
            kind, s, e = found[i]
            if p[i] >= thresholds[kind] and not any(s < b and a < e for a, b in chosen):
                chosen.append((s, e))
                more[kind].append((s, e))
    return base, {k: sorted(v) for k, v in more.items()}


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def redact(text: str, fitted: tuple[Boosted, dict[str, float]] | None = None) -> str:
    """The text with each span, longest first where they overlap, replaced by its kind in brackets."""
    spans = all_spans(text, fitted or model())[1]
    out, done = [], 0
    for s, _, kind, e in sorted((s, s - e, k, e) for k, v in spans.items() for s, e in v):
        if s >= done:
            out += [text[done:s], f"[{kind}]"]
            done = e
    return "".join([*out, text[done:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each document; one pass, no shuffle."""
    fitted = model()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", fitted) for t in batch.column(1).to_pylist()]
            base = [b for b, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    *[pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS],
                    pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([written(m) for _, m in found], pa.string()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
