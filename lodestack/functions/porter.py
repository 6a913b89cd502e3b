"""The suffix stripping algorithm of M. F. Porter (Program 14(3), 1980), with the later -logi and
-bli rules."""

from __future__ import annotations

import re

# The suffix rules of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

def _shape(word: str) -> str:
    """c and v for each letter: y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short(word: str) -> bool:
    """consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _suffix(word: str, rules: list[str]) -> str:
    """The longest rule that fits; only it counts."""
    return max((r for r in rules if word.endswith(r) and len(r) < len(word)), key=len, default="")


def porter(word: str) -> str:
    if not 3 <= len(word.encode()) <= 64:
        return word
    # 1a plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b past and continuous forms
    if _suffix(word, ["eed"]):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        end = _suffix(word, ["ed", "ing"])
        if end and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    # 1c
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        end = _suffix(word, list(table))
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = _suffix(word, STEP4)
    stem = word[: len(word) - len(end)]
    if end and _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
        word = stem
    # 5 a last e, a double l
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
