"""Porter's suffix stripping (1980), for the dictionary of a batch: a word is stemmed once, however often it occurs."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The published rules, (suffix, replacement) in order; of the suffixes that fit, the longest decides.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


ENDINGS_2, ENDINGS_3, ENDINGS_4 = tuple(a for a, _ in STEP_2), tuple(a for a, _ in STEP_3), tuple(STEP_4)  # asked for at once


def shape(word: str) -> str:
    """``v`` or ``c`` for every letter: vowels are a, e, i, o, u, and y after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(word).count("vc")


def ends_short(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last one not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def replaced(word: str, rules: list[tuple[str, str]]) -> str:
    fitting = [rule for rule in rules if word.endswith(rule[0])]
    if not fitting:
        return word
    suffix, new = max(fitting, key=lambda rule: len(rule[0]))
    left = word[: len(word) - len(suffix)]
    return left + new if measure(left) > 0 else word


def past_or_progressive(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            if "v" not in shape(left):
                return word
            if left.endswith(("at", "bl", "iz")):
                return left + "e"
            if ends_double(left) and left[-1] not in "lsz":
                return left[:-1]
            return left + "e" if measure(left) == 1 and ends_short(left) else left
    return word


def porter(word: str) -> str:
    """The stem of a lower-cased word. Words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = past_or_progressive(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    if word.endswith(ENDINGS_2):
        word = replaced(word, STEP_2)
    if word.endswith(ENDINGS_3):
        word = replaced(word, STEP_3)
    fitting = max((s for s in STEP_4 if word.endswith(s)), key=len) if word.endswith(ENDINGS_4) else ""
    left = word[: len(word) - len(fitting)]
    if fitting and measure(left) > 1 and (fitting != "ion" or left.endswith(("s", "t"))):
        word = left
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not ends_short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word
