"""Column functions on text.  JVM-side, but for the marked pandas functions."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .porter import stem as porter_stem


def tokens(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Runs of ASCII letters, digits and underscores, split first and lower-cased after."""
    parts = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\W+", -1), lambda w: w != ""), F.lower)
    return F.filter(parts, lambda w: ~w.isin(*stopwords)) if stopwords else parts


@pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """Porter stems; apply it to distinct terms."""
    return words.map(porter_stem, na_action="ignore")


def ngrams(words: Column, n: int) -> Column:
    """The n-grams in order, words joined by a space."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


@pandas_udf(StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


# Letters of other scripts in Latin ones, the longest first where several are one sound.
SPELT = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "đ": "d", "ł": "l", "Ł": "L", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "€": "EUR"}
GREEK = {
    "ου": "ou", "αυ": "au", "ευ": "eu", "γγ": "ng", "γχ": "nch",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "io", "є": "ie", "ж": "zh", "з": "z", "и": "i", "й": "i", "і": "i", "ї": "i", "ј": "j", "к": "k", "л": "l",
    "љ": "lj", "м": "m", "н": "n", "њ": "nj", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "ћ": "c", "ђ": "dj", "у": "u", "ў": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "џ": "dz",
    "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
}


def in_latin() -> tuple[re.Pattern, dict[str, str]]:
    """A pattern that matches the longest letters of the tables, and what each is in Latin; a capital's first letter is one.

    Letters are found after marks were taken off, but for those that are letters of their own (as й and ё).
    """
    table = dict(SPELT)
    for letters, latin in (GREEK | CYRILLIC).items():
        table[letters] = latin
        for other in {letters.upper(), letters.capitalize()}:
            table.setdefault(other, latin.upper() if len(letters) > 1 and other.isupper() else latin.capitalize())
    return re.compile("|".join(sorted(map(re.escape, table), key=len, reverse=True))), table


LETTERS, LATIN = in_latin()


def ascii_text(text: str) -> str:
    """Closest ASCII: Greek and Cyrillic letters and a few others spelt out, then other letters without their marks, the rest dropped."""
    if text.isascii():
        return text
    spelt = LETTERS.sub(lambda m: LATIN[m[0]], unicodedata.normalize("NFC", text))
    # Marks go one letter at a time, so that marked letters of the tables are found without them.
    plain = "".join(c for c in unicodedata.normalize("NFKD", spelt) if not unicodedata.combining(c))
    return LETTERS.sub(lambda m: LATIN[m[0]], plain).encode("ascii", "ignore").decode()


@pandas_udf(StringType())
def to_ascii(texts: pd.Series) -> pd.Series:
    """Closest ASCII, as :func:`ascii_text`; scripts other than Latin, Greek and Cyrillic are dropped."""
    return texts.map(ascii_text, na_action="ignore")


def unescape_backslashes(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def truncated(text: Column, most: int = 75, least: int = 0, suffix: str = "...") -> Column:
    """Cut before the last period in [least, most), else the last space, else at ``most``; the suffix is always added."""
    if most < least:
        raise ValueError("least is above most")

    def last(mark: str) -> Column:
        """The 0-based place of the last mark in [least, most), or null."""
        part = F.substring(text, least + 1, most - least)
        return F.when(F.instr(part, mark) > 0, F.lit(least) + F.length(part) - F.instr(F.reverse(part), mark))

    end = F.coalesce(last("."), last(" "), F.lit(most))
    cut = F.when(F.length(text) <= most, text).otherwise(F.left(text, end))
    return F.concat(cut, F.lit(suffix))


def cleaned(text: Column, title: Column, most: int = 5000, transliterate: bool = True) -> Column:
    """The content clean-up: spaces, escapes, ASCII, the title, share links, spaces before marks, length.

    The title is found by pieces of the split text, as it is a literal of each row.
    """
    text = escape_html(F.regexp_replace(text, r"\s+", " "))
    text = F.trim(to_ascii(text) if transliterate else text)
    pieces = F.split(text, F.concat(F.lit(r"\Q"), F.replace(title, F.lit(r"\E"), F.lit("")), F.lit(r"\E\s*-?\s*")), -1)
    text = F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(F.array_join(pieces, ""))
    for pattern, new in ((r"\s*Share this\s*", ""), (r"\s+,\s+", ", "), (r"\s+\.", ".")):
        text = F.regexp_replace(text, pattern, new)
    return truncated(text, most)


def google_source(title: Column, source: Column) -> tuple[Column, Column]:
    """(title, source) of aggregated titles "headline - publisher"; others stay."""
    pattern = r"^(.*) - (.+)$"
    split = F.contains(source, F.lit("Google News")) & title.rlike(pattern)
    return (
        F.when(split, F.regexp_extract(title, pattern, 1)).otherwise(title),
        F.when(split, F.concat(F.regexp_extract(title, pattern, 2), F.lit(" via Google News"))).otherwise(source),
    )


#: A sentence ends at . ! or ? before a space and a capital, digit or opening mark.
SENTENCE_END = r"(?<=[.!?])\s+(?=[\p{Lu}0-9\"'(\[])"


def two_sentences(content: Column) -> Column:
    """The first two sentences, after a bracketed dateline is dropped."""
    body = F.regexp_replace(content, r"^\s*[\(\[].*?[\)\]]\s*", "")
    return F.trim(F.array_join(F.slice(F.split(body, SENTENCE_END, -1), 1, 2), " "))


def plain_words(text: Column) -> Column:
    """Each non-word character as a space, as before classification."""
    return F.regexp_replace(text, r"\W", " ")


def html_title(page: Column) -> Column:
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(page: Column) -> Column:
    """Visible text: comments, scripts, styles, navigation and footers go, then tags; spaces collapse."""
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<(script|style|head|nav|footer)\b.*?</\1>", r"(?s)<[^>]*>"):
        page = F.regexp_replace(page, pattern, " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        page = F.replace(page, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(page, r"\s+", " "))


MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
MON = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DAY = "0?[1-9]|[12][0-9]|3[01]"

# Fixed date formats, first match wins; MM/DD before DD/MM.
DATES = [
    (rf"(?:{MON})\. (?:{DAY}), 20\d\d", "MMM. d, yyyy"),
    (rf"(?:{MON}) (?:{DAY}), 20\d\d", "MMM d, yyyy"),
    (rf"(?:{MONTH}) (?:{DAY}), 20\d\d", "MMMM d, yyyy"),
    (rf"(?:{DAY}) (?:{MONTH}), 20\d\d", "d MMMM, yyyy"),
    (rf"(?:{DAY}) (?:{MONTH}) 20\d\d", "d MMMM yyyy"),
    (rf"(?:{MON}) (?:{DAY}) 20\d\d", "MMM d yyyy"),
    (rf"(?:{MONTH}) (?:{DAY}) 20\d\d", "MMMM d yyyy"),
    (rf"20\d\d-(?:0?[1-9]|1[012])-(?:{DAY})(?![0-9])", "yyyy-M-d"),
    (r"(?:0[1-9]|1[012])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20)\d\d", "MM/dd/yyyy"),
    (rf"(?:{DAY}) (?:{MON}) 20\d\d", "d MMM yyyy"),
    (rf"(?:{DAY})/(?:0?[1-9]|1[012])/20\d\d", "d/M/yyyy"),
]


def found_date(text: Column) -> Column:
    """The first date, by the order of the formats, that the text has; null if none parses."""
    return F.coalesce(*[F.try_to_date(F.nullif(F.regexp_extract(text, f"({p})", 1), F.lit("")), f) for p, f in DATES])


def feed_date(text: Column, today: Column) -> Column:
    """The date of a feed's time (RFC 822 or ISO), else today."""
    rfc = F.try_to_timestamp(F.substring_index(text, ", ", -1), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(rfc.cast("date"), F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd"), today)


def declared_image(page: Column) -> Column:
    """The address of the image that a page declares as its own, or null."""
    return F.nullif(F.regexp_extract(page, r"""(?is)<meta[^>]*property=["']og:image["'][^>]*content=["']([^"']+)["']""", 1), F.lit(""))


def html_image(page: Column) -> Column:
    """The address of a page's representative image: the declared one, else that of the first image, else null."""
    first = F.regexp_extract(page, r"""(?is)<img[^>]*\ssrc=["']([^"']+)["']""", 1)
    return F.coalesce(declared_image(page), F.nullif(first, F.lit("")))


def image_path(urlid: Column, image_url: Column, folder: str = "public://images") -> Column:
    return F.when(F.coalesce(image_url, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"{folder}/"), urlid.cast("string"), F.lit(".jpg")))


# Fixed values of the e-mail form: the attributes of its images.
IMAGE_STYLE = 'align="left" style="margin: 8px 8px 8px 0; border: 1px solid #ccc; padding: 5px; background: white;" '


def absolute(text: Column, part: str, site: str) -> Column:
    """Links to a part of the site ("topic", "news") made absolute."""
    return F.replace(text, F.lit(f"/{part}/"), F.lit(f"{site}/{part}/"))


def unwrapped(body: Column) -> Column:
    """A body without the quotation and paragraph around it (fixed patterns of the site's markup)."""
    return F.regexp_replace(F.regexp_replace(body, r"^(<blockquote>)?<p>", ""), r"</p>(</blockquote>)?$", "")


def styled_images(markup: Column) -> Column:
    return F.replace(markup, F.lit("<img"), F.lit(f"<img {IMAGE_STYLE}"))


@pandas_udf(StringType())
def ranked_summary(contents: pd.Series) -> pd.Series:
    """The best 30 % of the sentences in the order of the text, the first four of these.

    A sentence's rank is the mean frequency in the text of its different words.
    """
    end = re.compile(r"(?<=[.!?])\s+(?=[^\W_a-z]|[\"'(\[])")

    def summary(text: str) -> str:
        sentences = [s for s in end.split(text) if s.strip()]
        words = [{w.lower() for w in re.findall(r"\w+", s, re.ASCII)} for s in sentences]
        count = Counter(w.lower() for w in re.findall(r"\w+", text, re.ASCII))
        rank = [sum(count[w] for w in ws) / len(ws) if ws else 0.0 for ws in words]
        best = sorted(range(len(sentences)), key=lambda k: (-rank[k], k))[: math.ceil(0.3 * len(sentences))]
        return " ".join(sentences[k] for k in sorted(best)[:4]).strip()

    return contents.map(summary, na_action="ignore")


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """The first pattern of the list that is found in the text, or null."""
    hits = [F.when(text.rlike(p), F.lit(p)) for p in patterns]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def has_word(text: Column, listed: list[str]) -> Column:
    """Whether a listed word stands between non-word characters, in either case; never at the very start or end."""
    if not listed:
        return F.lit(False)
    return text.rlike(r"(?i)\W(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in listed) + r")\W")
