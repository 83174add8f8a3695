"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

# Fixed tables of the published algorithm: suffix, replacement; the measure of the stem must be above 0.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def kinds(word: str) -> str:
    """c or v for each letter; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    """How many vowel-consonant sequences there are."""
    return kinds(stem).count("vc")


def has_vowel(stem: str) -> bool:
    return "v" in kinds(stem)


def double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and kinds(word)[-1] == "c"


def cvc(word: str) -> bool:
    return kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def replaced(word: str, table: list[tuple[str, str]], least: int) -> str:
    """The longest suffix of the table decides, even if its stem is too short."""
    for suffix, new in sorted(table, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if measure(stem) > least else word
    return word


def step_1(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and cvc(word):
                    word += "e"
                break
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return word


def step_4(word: str) -> str:
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            allowed = suffix != "ion" or stem.endswith(("s", "t"))
            return stem if measure(stem) > 1 and allowed else word
    return word


def step_5(word: str) -> str:
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not cvc(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stem(word: str) -> str:
    """The stem; words of two letters or fewer stay, as do those not starting in lower case."""
    if len(word) <= 2 or not word[0].islower():
        return word
    return step_5(step_4(replaced(replaced(step_1(word), STEP_2, 0), STEP_3, 0)))
