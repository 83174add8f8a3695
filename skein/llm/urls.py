"""Verdicts on URLs: rules of hosts and paths, then gradient-boosted trees.

A rule (host, path) fits its host and all subdomains if the path starts with the
rule's; the longest that fits decides.  Other URLs get the verdict of boosted
trees on lexical features: length, depth, digit ratio, entropy, parameter and
hyphen counts, longest label, and the rates of blocked labels under the last and
the last two labels of the host in the training sample.  The trees are trained
from labelled URLs, by default a sample written here (``SAMPLE`` rows, fixed seed).

Cases: null or no ``://``: host and path are empty, no rule fits, and the trees
judge the empty host; repeated rows are judged alike; of rules of one length the
first listed counts; a url of any length is read in one pass; null ids stay null;
further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Boosted

#: Labelled URLs that the trees are trained on.
SAMPLE = 4000

# The rules of the query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def parts(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    after = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
    return rest[:end].translate(LOWER), rest[end:after]


def rule_of(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest rule that fits and its verdict.  Looks at each suffix of the host once."""
    best = None
    at = 0
    while host:
        suffix = host[at:]
        for start, verdict in rules.get(suffix, ()):
            if path.startswith(start) and (best is None or len(suffix + start) > len(best[0])):
                best = (suffix + start, verdict)
        at = host.find(".", at) + 1
        if not at:
            break
    return best


def by_host(rules: list[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        out.setdefault(host, []).append((path, verdict))
    return out


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def suffix_of(host: str, labels: int = 1) -> str:
    return ".".join(host.split(".")[-labels:])


def features(url: str | None, suffixes: dict[str, float]) -> list[float]:
    url = url or ""
    host, path = parts(url)
    query = url.partition("?")[2].partition("#")[0]
    letters = max(1, len(host))
    return [
        float(len(url)), float(len(host)), float(len(path)), float(path.count("/")), float(host.count(".")),
        sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host) / letters, entropy(host), entropy(path),
        float(query.count("=")), float(len(query)), float(host.count("-")), host.count("-") / letters, float(path.count("-")), float(url.count("%")),
        float(max(map(len, host.split(".")))), float(len(host.rpartition(".")[2])), suffixes.get(suffix_of(host), 0.5), suffixes.get(suffix_of(host, 2), suffixes.get(suffix_of(host), 0.5)),
    ]


def suffix_rates(labelled: list[tuple[str, int]]) -> dict[str, float]:
    """The smoothed share of blocked URLs under each last label and pair of last labels that several hosts have."""
    seen, bad, hosts = Counter(), Counter(), {}
    for url, label in labelled:
        host = parts(url)[0]
        for s in {suffix_of(host), suffix_of(host, 2)}:
            seen[s] += 1
            bad[s] += label
            hosts.setdefault(s, set()).add(host)
    return {s: (bad[s] + 5) / (n + 10) for s, n in seen.items() if "." not in s or len(hosts[s]) > 4}


def sample(rows: int = SAMPLE, seed: int = 31) -> list[tuple[str, int]]:
    """Labelled URLs: ordinary sites, and hosts and links in the manner of spam."""
    r = random.Random(seed)
    ordinary = "news blog shop river garden paper science music travel health city school market museum theatre library weather energy engine forum".split()
    lures = "cheap free casino pills loan bonus win poker replica deals spam farm bet crypto prize click hot best buy discount".split()
    ends = ["com", "net", "org", "de", "fr", "es", "edu", "eu", "co.uk", "io"]
    shared = ["blogs.com", "pages.net", "sites.org", "web.de"]
    word = lambda: r.choice(ordinary)
    out = []
    for _ in range(rows):
        bad = r.random() < 0.4
        if bad:
            host = "-".join(r.sample(lures, r.randint(2, 4))) + (str(r.randint(1, 999)) if r.random() < 0.4 else "")
            host = f"{host}.{r.choice(ends + shared + ['xyz', 'top', 'info', 'click', 'icu'] * 3)}"
            path = "/" + "/".join(r.choice(["go", "offer", "best-price-now", "r", "out.php", f"{r.choice(lures)}-{r.choice(lures)}", str(r.randint(1, 99999)), f"{r.randint(0, 1 << 40):x}"]) for _ in range(r.randint(1, 4)))
            query = "&".join(f"{r.choice('abcdefgh')}{i}={r.randint(0, 1 << 30):x}" for i in range(r.randint(0, 6)))
        else:
            name = r.choice([word(), word() + word(), f"{word()}-{word()}", "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 5)))])
            host = f"{r.choice(['', 'www.', 'm.', 'blog.', 'docs.'])}{name}.{r.choice(ends * 3 + shared + ['info'])}"
            path = r.choice(["", "/", "/index.html", f"/{word()}", f"/{word()}/{r.randint(1, 999)}{r.choice(['', '/', '.html'])}", "/" + "-".join(r.sample(ordinary, 4)), f"/{word()}/{r.randint(2000, 2025)}/{r.randint(1, 12)}/{word()}-{word()}", f"/~{word()}/{word()}.pdf", f"/{r.choice(['a', 'b', 'en', 'it'])}/{r.randint(1, 999)}"])
            query = r.choice(["", "", "", f"page={r.randint(1, 40)}", f"p={r.randint(1, 99)}&sort=date", "utm_source=feed", "q=" + word(), f"id={r.randint(1, 9999)}&lang=en"])
        out.append((f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.']) if bad else ''}{host}{path}{'?' + query if query else ''}{r.choice(['', '', '#top'])}", int(bad)))
    return out


def train(labelled: list[tuple[str, int]]) -> tuple[Boosted, dict[str, float]]:
    rates = suffix_rates(labelled)
    x = np.array([features(u, rates) for u, _ in labelled])
    return Boosted().fit(x, np.array([y for _, y in labelled])), rates


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, dict[str, float]]:
    return train(sample())


SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double"


def digest(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, trained: tuple | None = None) -> DataFrame:
    """Host, path, the rule that fits and the verdict for each page; one pass, no shuffle."""
    trees, rates = trained or model()
    lists = by_host(RULES if rules is None else rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            if not urls:
                continue
            split = [parts(u) for u in urls]
            fits = [rule_of(h, p, lists) for h, p in split]
            score = trees.probability(np.array([features(u, rates) for u in urls]))
            verdict = [f[1] if f else ("block" if s >= trees.threshold else "allow") for f, s in zip(fits, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([f[0] if f else None for f in fits], pa.string()),
                    pa.array(verdict, pa.string()),
                    pa.array(np.round(score, 6)),
                ],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    return pages.select("page_id", "url").mapInArrow(judge, SCHEMA)
