"""Plain reference versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

BLANK = " \t\n\x0b\f\r"


def words(text):
    return [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]


def shingles(text, k=5):
    ws = words(text)
    if not ws:
        return Counter()
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else Counter([tuple(ws)])


def jaccard(a, b):
    low = sum((a & b).values())
    high = sum((a | b).values())
    return low / high if high else 0.0


def classes(docs, least=0.8):
    """doc_id -> (copy_of, class_id) for (doc_id, text) rows."""
    heads = {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        heads.setdefault(t or "", d)
    nodes = sorted((d, shingles(t)) for t, d in heads.items())
    label = {d: d for d, _ in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    index = {}
    for d, s in nodes:
        for g in s:
            index.setdefault(g, []).append(d)
    bags = dict(nodes)
    seen = set()
    for ds in index.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if jaccard(bags[a], bags[b]) >= least:
                        x, y = sorted((root(a), root(b)))
                        label[y] = x
    return {d: (heads[t or ""], root(heads[t or ""])) for d, t in docs}


def substrings(docs, k=20):
    """doc_id -> (n_words, n_removed, digest)."""
    rows = sorted(((d, words(t)) for d, t in docs), key=lambda r: r[0])
    seen, out = {}, {}
    for d, ws in rows:
        gone = [False] * len(ws)
        for i in range(len(ws) - k + 1):
            w = tuple(ws[i : i + k])
            if w in seen:
                gone[i : i + k] = [True] * k
            else:
                seen[w] = (d, i)
        left = [w for w, g in zip(ws, gone, strict=True) if not g]
        out[d] = (len(ws), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def contaminated(docs, items, least=0.8):
    """(doc_id, item_id) of documents with a window of the item's size that is similar; all windows are tried."""
    norm = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for i, text in items:
        ws = norm(text)
        if not ws:
            continue
        k = min(5, len(ws))
        grams = lambda x: [tuple(x[j : j + k]) for j in range(len(x) - k + 1)]
        item = Counter(grams(ws))
        n = sum(item.values())
        for d, t in docs:
            g = grams(norm(t))
            if not set(g) & set(item):
                continue
            if any(jaccard(Counter(g[s : s + n]), item) >= least for s in range(max(1, len(g) - n + 1))):
                out.add((d, i))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [("email", m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [("phone", m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{s}:{e}" for k, (s, e) in spans)


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    kinds = ["assign", "access", "hex"]
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))


STOCK = [
    "all rights reserved", "cookie policy", "enable javascript", "privacy policy", "alle rechte vorbehalten", "cookie-richtlinie", "javascript aktivieren", "datenschutzerklärung",
    "tous droits réservés", "politique de cookies", "activer javascript", "politique de confidentialité", "todos los derechos reservados", "política de cookies", "habilite javascript", "política de privacidad",
]


def cleaned(text):
    """The text without its failing lines, or None if it is rejected."""
    text = text or ""
    ws = words(text)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    count = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    if len(ws) < 10 or 100 * len(again) > 20 * len(ws):
        return None

    def fails(line):
        lw = words(line)
        odd = sum(bool(re.search(r"[#*$%&|<>]|[!?]{2}$", w)) for w in lw)
        marks = line.count("|")
        dull = again and len(lw) >= 10 and len(set(lw)) <= 0.2 * len(lw)
        return bool(lw) and (odd > 0.3 * len(lw) or (marks >= 3 and 4 * marks >= len(lw)) or any(x in line.lower() for x in STOCK) or bool(dull))

    lines = text.split("\n")
    good = [x for x in lines if not fails(x)]
    left = sum(len(words(x)) for x in good)
    return None if left < 0.5 * len(ws) else "\n".join(good)


def targets(sizes):
    """source -> target of source -> size; None is the last source."""
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode("utf-32-be")) + [k for k in sizes if k is None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        open_ = [k for k in order if k not in capped]
        level = (total - sum(3 * sizes[k] for k in capped)) / sum(weight[k] for k in open_) if open_ else 0
        over = {k for k in open_ if level * weight[k] > 3 * sizes[k]}
        if not over:
            return {k: 3.0 * sizes[k] if k in capped else level * weight[k] for k in order}
        capped |= over


def mixed(rows):
    """How often each (doc_id, source, text) row is taken."""
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(words(t))
    aim, at, out = targets(sizes), Counter(), []
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    for row in sorted(rows, key=lambda r: (digest("null" if r[0] is None else str(r[0])), digest(r[2] or ""))):
        n = len(words(row[2]))
        out.append((row, sum(n > 0 and r * sizes[row[1]] + at[row[1]] + n / 2 < aim[row[1]] for r in range(3))))
        at[row[1]] += n
    return out


def licence_terms(text):
    ws = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])


def licences(files, templates, header, least, margin, reserved):
    """(license, how, from_path) of each (path, text, is_license_file) file."""
    n = len(templates)
    bags = [(name, licence_terms(t)) for name, t in templates]
    df = Counter(t for _, b in bags for t in b)
    weight = lambda t: math.log((1 + n) / (0.5 + df.get(t, 1)))
    norm = lambda b: math.sqrt(sum((c * weight(t)) ** 2 for t, c in b.items()))

    def best(text):
        bag = licence_terms(text)
        scores = {}
        for name, b in bags:
            dot = sum(c * b.get(t, 0) * weight(t) ** 2 for t, c in bag.items())
            scores[name] = max(scores.get(name, 0), round(dot / (norm(bag) * norm(b)), 6) if bag else 0)
        top = sorted((-s, name) for name, s in scores.items()) + [(0, "")]
        return (top[0][1] == reserved, top[0][0], top[0][1]) if -top[0][0] >= least and top[1][0] - top[0][0] >= margin else None

    own, whole = {}, {}
    for k, (path, text, is_file) in enumerate(files):
        text = text or ""
        lines = text.split("\n")
        paragraphs, run = [], []
        for x in [*lines, ""]:
            if re.search(r"[^\W_]", x) and len(x) <= 160:
                run.append(x)
            else:
                paragraphs.append(run)
                run = []
        parts = [x for x in lines if re.search(header, x)] + ["\n".join(p) for p in paragraphs if len(p) > 1 and any(re.search(header, x) for x in p)]
        named = is_file or re.fullmatch(r"(?i)(licen[cs]e|copying)(\..*)?", path.split("/")[-1])
        found = [f for f in map(best, parts + ([text] if named else [])) if f]
        if found:
            own[k] = min(found)
        if named and (f := best(text)):
            whole.setdefault(path.rpartition("/")[0], []).append((*f, path))
    out = []
    for k, (path, _, is_file) in enumerate(files):
        if k in own:
            out.append((own[k][2], "file" if is_file else "header", None))
            continue
        at = path.rpartition("/")[0]
        while at and at not in whole:
            at = at.rpartition("/")[0]
        out.append((min(whole[at])[2], "inherited", min(whole[at])[3]) if at in whole else (None, None, None))
    return out


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def url_rule(url):
    """(host, path, rule, verdict or None) by the stated rules."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def crc(text):
    return zlib.crc32((text or "").encode())


def divergence(docs, least=30, ranks=50):
    """Sorted (lang, source, part, item, value, rank) rows of (lang, source, text) rows."""
    docs = [tuple(x or "" for x in d) for d in docs]
    found = [(lang, source, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(s, ts) for g, s, ts in found if g == lang]
        seen = Counter(t for _, ts in mine for t in set(ts))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {None: Counter(t for _, ts in mine for t in ts if t in kept)}
        for s, ts in mine:
            counts.setdefault(s, Counter()).update(t for t in ts if t in kept)
        share = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in counts.keys() - {None}:
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in counts.keys() - {None, s}]
            terms = [(share[s][t] - share[None][t], t) for t in kept if counts[s][t] and share[s][t] > share[None][t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, ranks)):
                order = sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(order, 1)]
    return sorted(out)


def infill(key, text, unit="char"):
    """(units, form, code points of prefix and middle, rewritten text)."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = list(text) if unit == "char" else re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+$" if unit == "word" else r"[^\n]*\n|[^\n]+$", text)
    assert "".join(units) == text
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), out


def kneser_ney(rows):
    """(tokens of training, [(held_out, tokens, known, base score, score)]) of (key, text) rows, with the model's parts in the open."""
    lists = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)] + ["\n"] for _, t in rows]
    held = [zlib.crc32(b"" if k is None else str(k).encode()) % 10 == 0 for k, _ in rows]
    uses, pairs = Counter(), Counter()
    for ws, out in zip(lists, held, strict=True):
        if not out:
            uses.update(ws)
            pairs.update(zip([" ", *ws], ws, strict=False))
    follows, before = {}, Counter()
    for (v, w), n in pairs.items():
        follows.setdefault(v, []).append(n)
        before[w] += 1

    def discount(counts):
        n = Counter(counts)
        rate = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        ds = [0.0]
        for k in (1, 2, 3):
            d = k - (k + 1) * rate * n[k + 1] / n[k] if rate and n[k] and n[k + 1] else -1
            ds.append(d if 0 < d < k else k / 2)
        return lambda c: ds[min(c, 3)]

    d2, d1 = discount(pairs.values()), discount(before.values())
    left = sum(map(d1, before.values())) / len(pairs) if pairs else 1.0

    def alone(w):
        return (max(before[w] - d1(before[w]), 0) / len(pairs) if pairs else 0) + left / (len(uses) + 1)

    def p(w, v):
        if v not in follows:
            return alone(w)
        total = sum(follows[v])
        return max(pairs[v, w] - d2(pairs[v, w]), 0) / total + sum(map(d2, follows[v])) / total * alone(w)

    tokens = sum(uses.values())
    out = []
    for ws, h in zip(lists, held, strict=True):
        base = sum(math.log10((uses[w] + 0.1) / (tokens + 0.1 * (len(uses) + 1))) for w in ws)
        out.append((h, len(ws), sum(uses[w] > 0 for w in ws), base, sum(math.log10(p(w, v)) for v, w in zip([" ", *ws], ws, strict=False))))
    return tokens, out, p, uses
