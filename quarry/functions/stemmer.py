"""The Porter2 stemmer for English, after its published description."""

from __future__ import annotations

import functools
import re

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published algorithm.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STOP_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

_REGION = re.compile(f"[^{_V}]*[{_V}]+[^{_V}]")
_SHORT_END = re.compile(f"(?:^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$")


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        m = _REGION.match(w)
        r1 = m.end() if m else len(w)
    m = _REGION.match(w[r1:])
    return r1, r1 + m.end() if m else len(w)


@functools.lru_cache(100_000)
def porter2(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.lstrip("'")
    w = re.sub(rf"^y|(?<=[{_V}])y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].+s$", w):
        w = w[:-1]
    if w.lower() in _STOP_1A:
        return w.lower()
    if w.endswith(("eed", "eedly")):
        cut = 3 if w.endswith("eed") else 5
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
        if end and re.search(f"[{_V}]", w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif _SHORT_END.search(w) and len(w) <= r1:
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, to in _STEP_2:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r1 and (end != "ogi" or stem.endswith("l")) and (end != "li" or stem[-1:] and stem[-1] in "cdeghkmnrt"):
                w = stem + to
            break
    for end, to in _STEP_3:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r1 and (end != "ative" or len(stem) >= r2):
                w = stem + to
            break
    end = next((e for e in _STEP_4 if w.endswith(e)), None)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        stem = w[:-1]
        if len(stem) >= r2 or len(stem) >= r1 and not _SHORT_END.search(stem):
            w = stem
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()
