"""Secrets by character Markov models.

The base patterns find assignments to secret-like names, access key ids and long
hex runs.  The method adds strings that look random: tokens of 20 or more key
characters, but rules of signs only, are scored by the log-likelihood ratio,
per character, of two character Markov models of order two, one of random
strings and one of ordinary names: identifiers of code, paths and slugs, and
long words and compounds of four languages.  Both are trained on labelled
samples written here (``SAMPLE`` strings each, fixed seed).  The threshold is
calibrated on held-out strings: it loses ``MISS_RATE`` of random ones of the
least length, and if over ``FALSE_RATE`` of the names were above that, it is the
one that leaves as many.

Cases: as in :mod:`.pii`; added spans have the kind ``random`` and do not
overlap base spans.
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

KINDS = ["assign", "access", "hex"]
SAMPLE = 4000
FALSE_RATE = 0.001
MISS_RATE = 0.003
LEAST = 20

# Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = {c: i for i, c in enumerate(ALPHABET)}
K = len(ALPHABET)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Words whose letters stand for those of ordinary long words, by language; compounds are made of them.
STEMS = {
    "en": "electro encephalo graphic ally pneumono ultra micro scopic silico volcano coniosis counter revolution ary under standing inter national ization photo synthesis character istic psycho logical responsi bility environ mental straight forward know ledge through thought strength neighbour hood develop ment government experience question because",
    "de": "donau dampf schiff fahrts gesellschaft kapitän rechts schutz versicherungs arbeits platz geschwindig keits begrenzung kraft fahrzeug haft pflicht grund stücks verkehrs genehmigung zuständig wissen schaft licher unab hängig keits erklärung straßen bahn halte stelle möglich über setzung freund schaft entwick lung zwischen",
    "fr": "anti constitution nelle ment inter gouverne mentale électro magnétique développe ment extra ordinaire ment aujourd hui quelque fois beaucoup longue ment compréhen sible environne mental responsabil ité philosophique heureuse malheureuse ment vraisembl able travail leurs chercheuse lumière",
    "es": "electro encefalo grafista anti constitucional mente desafortunada mente responsabil idad inter nacionaliz ación extra ordinaria conocimi ento desarrollo sostenible medio ambiental otorrino laringólogo imprescindible agradecimi ento trabaja dores pueblos ciudades llegar siempre caracter ística",
}


def long_words(r: random.Random, n: int) -> list[str]:
    """Compounds of one language in the cases of a text, without letters that keys don't have."""
    plain = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "é": "e", "è": "e", "ó": "o", "í": "i"})
    parts = {lang: words.translate(plain).split() for lang, words in STEMS.items()}
    out = []
    for _ in range(n):
        own = parts[r.choice(list(parts))]
        word = r.choice(own)
        while len(word) < LEAST:
            word += r.choice(["", "", "", "-"]) + r.choice(own)
        out.append(r.choice([str, str, str.capitalize, str.upper])(word))
    return out


def identifiers(r: random.Random, n: int) -> list[str]:
    """Ordinary names: words of syllables in the styles of code, paths, slugs and headings."""
    folders = "usr local lib bin home etc var opt src include share main java com org www http https html php assets images site packages python node modules dist build test tests docs static media css js api v1 v2".split()
    parts = "get set user name list item file path value index count data load save read write time date page view node tree text line word table query cache store event state error message config option result number string format parse token model train batch sort join merge group range shard stream window source target index".split()
    syllables = "ing er th en on re an ti es or ou at ed nd ha to nt is st le ve ment tion able ness ung keit lich sch ber eux aux ment cion ado mente que".split()
    out = []
    for _ in range(n):
        ws = [r.choice(parts) if r.random() < 0.6 else "".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(2, 7))]
        style = r.randint(0, 8)
        path = [r.choice(folders) if r.random() < 0.6 else w for w in ws]
        s = [lambda: "_".join(ws), lambda: "-".join(ws), lambda: "".join(w.title() for w in ws), lambda: "/".join(ws), lambda: "_".join(ws).upper(), lambda: "".join(ws), lambda: "".join(ws).upper(), lambda: "/" + "/".join(path), lambda: "/".join(path) + r.choice(["", "/", "3", "2", "-1"])][style]()
        if r.random() < 0.3:
            s += r.choice(["_", "-", ""]) + str(r.randint(0, 9999))
        while len(s) < LEAST:
            s += r.choice(["_", "-", ""]) + r.choice(parts)
        out.append(s)
    return out


def randoms(r: random.Random, n: int) -> list[str]:
    """Random strings in the alphabets of keys."""
    sets = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET, "abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789"]
    return ["".join(r.choices(r.choice(sets), k=r.randint(LEAST, 64))) for _ in range(n)]


def codes(s: str) -> np.ndarray:
    return np.fromiter((CODE[c] for c in s), np.int64, len(s))


def fitted(strings: list[str]) -> np.ndarray:
    """Log probabilities of a character after two, smoothed towards the order-one model."""
    two, one = np.zeros((K * K, K)), np.full((K, K), 0.5)
    for s in strings:
        c = codes(s)
        np.add.at(one, (c[:-1], c[1:]), 1)
        np.add.at(two, (c[:-2] * K + c[1:-1], c[2:]), 1)
    one /= one.sum(1, keepdims=True)
    prior = 4 * np.tile(one, (K, 1))
    return np.log((two + prior) / (two + prior).sum(1, keepdims=True))


def ratio(s: str, models: tuple[np.ndarray, np.ndarray]) -> float:
    """Log-likelihood ratio per character, random against ordinary."""
    c = codes(s)
    pair = c[:-2] * K + c[1:-1]
    return float((models[0][pair, c[2:]] - models[1][pair, c[2:]]).mean())


@lru_cache(maxsize=1)
def model(seed: int = 23) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """Both models, and the threshold of the ratio."""
    r = random.Random(seed)
    names = lambda: identifiers(r, SAMPLE // 2) + long_words(r, SAMPLE // 2)
    models = (fitted(randoms(r, SAMPLE)).astype(np.float32), fitted(names()).astype(np.float32))
    ordinary, odd = (sorted(ratio(s, models) for s in held) for held in (names(), [s[:LEAST] for s in randoms(r, SAMPLE)]))
    return models, max(ordinary[int(SAMPLE * (1 - FALSE_RATE)) - 1], odd[int(SAMPLE * MISS_RATE)])


#: Identifiers that are random by their nature, but no secrets.
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


def all_spans(text: str, fitted_model: tuple) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    models, threshold = fitted_model
    more = [
        ("random", *m.span())
        for m in CANDIDATE.finditer(text)
        if any(c.isalnum() for c in m[0]) and not UUID.fullmatch(m[0]) and not any(s < m.end() and m.start() < e for _, s, e in base) and ratio(m[0], models) > threshold
    ]
    order = [*KINDS, "random"]
    return base, sorted(base + more, key=lambda s: (s[1], order.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each document; one pass, no shuffle."""
    fitted_model = model()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", fitted_model) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    *[pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS],
                    pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string()),
                    pa.array([written(m) for _, m in found], pa.string()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
