"""Porter's suffix-stripping stemmer (1980) with the widely used later refinements.

``stem(word)`` follows the published algorithm.  With ``extended=True`` (the
default) it adds the refinements common in today's toolkits: a short list of
irregular forms, words of one or two letters left alone, gentler treatment of
short -ies/-ied words, -y kept after a vowel, and the suffixes -fulli and -logi.
"""

from __future__ import annotations

from functools import lru_cache

# Irregular forms of the extended variant.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# The suffix tables of the published steps 2 to 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(part: str) -> str:
    """Map letters to v(owel) or c(onsonant); y is a vowel after a consonant."""
    out = []
    for ch in part:
        if ch in "aeiou" or (ch == "y" and out and out[-1] == "c"):
            out.append("v")
        else:
            out.append("c")
    return "".join(out)


def _measure(part: str) -> int:
    """Number of vowel-to-consonant changes."""
    return _shape(part).count("vc")


def _short_end(part: str, extended: bool) -> bool:
    shape = _shape(part)
    if shape.endswith("cvc") and part[-1] not in "wxy":
        return True
    return extended and shape == "vc"


def _replace(word: str, table: list[tuple[str, str]]) -> str:
    """Apply the rule with the longest fitting suffix if its stem is not empty in measure."""
    hits = [rule for rule in table if word.endswith(rule[0])]
    if hits:
        suffix, new = max(hits, key=lambda rule: len(rule[0]))
        base = word[: len(word) - len(suffix)]
        if _measure(base) > 0:
            return base + new
    return word


def _plural(word: str, extended: bool) -> str:
    if extended and len(word) == 4 and word.endswith("ies"):
        return word[:-1]
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str, extended: bool) -> str:
    if extended and word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        base = word[: len(word) - len(suffix)]
        if word.endswith(suffix):
            if "v" not in _shape(base):
                continue
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c":
                return base if base[-1] in "lsz" else base[:-1]
            if _measure(base) == 1 and _short_end(base, extended):
                return base + "e"
            return base
    return word


def _final_y(word: str, extended: bool) -> str:
    if not word.endswith("y"):
        return word
    shape = _shape(word[:-1])
    turns = len(shape) > 1 and shape[-1] == "c" if extended else "v" in shape
    return word[:-1] + "i" if turns else word


def _double_suffix(word: str, extended: bool) -> str:
    if not extended:
        return _replace(word, [("abli", "able") if rule[0] == "bli" else rule for rule in STEP2])
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _double_suffix(word[:-2], extended)
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replace(word, STEP2 + [("fulli", "ful")])


def _residual(word: str) -> str:
    hits = [s for s in STEP4 if word.endswith(s)]
    if not hits:
        return word
    suffix = max(hits, key=len)
    base = word[: len(word) - len(suffix)]
    if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
        return base
    return word


def _tidy(word: str, extended: bool) -> str:
    if word.endswith("e"):
        base = word[:-1]
        size = _measure(base)
        if size > 1 or (size == 1 and not _short_end(base, extended)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=200_000)
def stem(word: str, extended: bool = True) -> str:
    """Stem one lower-case word; the bounded cache lives in each Python worker."""
    if extended:
        if word in IRREGULAR:
            return IRREGULAR[word]
        if len(word) <= 2:
            return word
    word = _plural(word, extended)
    word = _past(word, extended)
    word = _final_y(word, extended)
    word = _double_suffix(word, extended)
    word = _replace(word, STEP3)
    word = _residual(word)
    return _tidy(word, extended)
