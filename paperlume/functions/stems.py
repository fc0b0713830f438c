"""English stems by the published suffix rules of the second Porter algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that are never searched for. Fixed values.
STOPS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)
#: Words with stems of their own. Fixed values.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
#: Words that lose nothing more once their plural is gone. Fixed values.
WHOLE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what they become, longest first where one ends with another. Fixed values.
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

_VOWELS = "aeiouy"
_REGION = re.compile(rf"[{_VOWELS}][^{_VOWELS}]")
_SHORT = re.compile(rf"(?:[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY]|^[{_VOWELS}][^{_VOWELS}])$")
_HAS_VOWEL = re.compile(f"[{_VOWELS}]")
_CONSONANT_Y, _ENDS_IN_Y = re.compile(rf"(?:^|(?<=[{_VOWELS}]))y"), re.compile(rf".[^{_VOWELS}][yY]$")
_LEADS, _DOUBLED = ("gener", "commun", "arsen"), ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_PAST, _SECOND, _THIRD, _FOURTH = ("eedly", "ingly", "edly", "eed", "ing", "ed"), tuple(SECOND), tuple(THIRD), tuple(FOURTH)


def _after(word: str, begin: int) -> int:
    """Where the part begins that follows the first vowel and consonant from ``begin`` on."""
    found = _REGION.search(word, begin)
    return found.end() if found else len(word)


def _ending(word: str, endings: tuple[str, ...]) -> str | None:
    # Most words have none of them, which is one call.
    return next(e for e in endings if word.endswith(e)) if word.endswith(endings) else None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.lstrip("'")
    if "y" in word:
        word = _CONSONANT_Y.sub("Y", word)
    lead = next(p for p in _LEADS if word.startswith(p)) if word.startswith(_LEADS) else None
    one = len(lead) if lead else _after(word, 0)
    two = _after(word, one)
    if "'" in word:
        word = re.sub("(?:'s'|'s|')$", "", word)
    word = _plural(word)
    if word in WHOLE:
        return word
    word = _past(word, one)
    if word.endswith(("y", "Y")) and _ENDS_IN_Y.search(word):
        word = word[:-1] + "i"
    word = _derived(word, one, two)
    return word.lower().replace("Y", "y")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _HAS_VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, one: int) -> str:
    end = _ending(word, _PAST)
    if end is None:
        return word
    base = word[: -len(end)]
    if end.startswith("eed"):
        return base + "ee" if len(base) >= one else word
    if not _HAS_VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(_DOUBLED):
        return base[:-1]
    return base + "e" if len(base) <= one and _SHORT.search(base) else base


def _derived(word: str, one: int, two: int) -> str:
    """What is left without the endings that make words of other words."""
    end = _ending(word, _SECOND)
    if end and len(word) - len(end) >= one:
        before = word[: -len(end)]
        if end == "ogi":
            word = before + "og" if before.endswith("l") else word
        elif end == "li":
            word = before if before[-1:] in tuple("cdeghkmnrt") else word
        else:
            word = before + SECOND[end]
    end = _ending(word, _THIRD)
    if end and len(word) - len(end) >= (two if end == "ative" else one):
        word = word[: -len(end)] + THIRD[end]
    end = _ending(word, _FOURTH)
    if end and len(word) - len(end) >= two and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= two or len(word) - 1 >= one and not _SHORT.search(word[:-1])):
        return word[:-1]
    if word.endswith("ll") and len(word) - 1 >= two:
        return word[:-1]
    return word
