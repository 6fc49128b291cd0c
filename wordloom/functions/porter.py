"""Porter (1980) suffix stripping for one lowercase word — a small per-word helper.

Follows the published algorithm with the three well-known departures of the
widely used C release: step 2 maps -bli to -ble (instead of -abli to -able),
step 2 also maps -logi to -log, and words of one or two letters are left
alone.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The algorithm's suffix rules in their published order.
# Step 2 and step 3 are (suffix, replacement) applied when the measure of the
# remaining stem is > 0; step 4 suffixes are removed when the measure is > 1
# ("ion" only after s or t).  The first listed suffix that matches decides.
# ---------------------------------------------------------------------------
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
         ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]
VOWELS = "aeiou"


def _consonant_mask(w: str) -> list[bool]:
    mask = []
    for i, ch in enumerate(w):
        if ch in VOWELS:
            mask.append(False)
        elif ch == "y":
            mask.append(True if i == 0 else not mask[i - 1])
        else:
            mask.append(True)
    return mask


def measure(stem: str) -> int:
    """Number of vowel→consonant transitions: [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for is_cons in _consonant_mask(stem):
        if is_cons and prev_vowel:
            m += 1
        prev_vowel = not is_cons
    return m


def _has_vowel(stem: str) -> bool:
    return not all(_consonant_mask(stem)) if stem else False


def _double_consonant(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _consonant_mask(w)[-1]


def _cvc(w: str) -> bool:
    """consonant-vowel-consonant ending, the last not w, x or y."""
    if len(w) < 3:
        return False
    c = _consonant_mask(w)
    return c[-3] and not c[-2] and c[-1] and w[-1] not in "wxy"


def _rule_step(w: str, rules, min_measure: int) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if measure(stem) > min_measure else w
    return w


def _step1ab(w: str) -> str:
    if w.endswith("s"):
        if w.endswith("sses"):
            w = w[:-2]
        elif w.endswith("ies"):
            w = w[:-2]
        elif not w.endswith("ss"):
            w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w[: len(w) - len(suf)]):
            w = w[: len(w) - len(suf)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double_consonant(w):
                return w if w[-1] in "lsz" else w[:-1]
            if measure(w) == 1 and _cvc(w):
                return w + "e"
            return w
        if w.endswith(suf):
            return w
    return w


def _step1c(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and _has_vowel(w[:-1]) else w


def _step4(w: str) -> str:
    for suf in STEP4:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if suf == "ion" and not (stem and stem[-1] in "st"):
                return w
            return stem if measure(stem) > 1 else w
    return w


def _step5(w: str) -> str:
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("l") and _double_consonant(w) and measure(w) > 1:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    """Stem one lowercase word."""
    if len(word) <= 2:
        return word
    w = _step1ab(word)
    if len(w) <= 1:
        return w
    w = _step1c(w)
    w = _rule_step(w, STEP2, 0)
    w = _rule_step(w, STEP3, 0)
    w = _step4(w)
    return _step5(w)
