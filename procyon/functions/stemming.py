"""The English stemmer known as Porter2, written from its published description."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the algorithm: exceptions, and the suffixes of its steps with what replaces them.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIX_R1 = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile("[aeiouy]")


def _after(word: str, start: int) -> int:
    """Where the part behind the first vowel and consonant from `start` begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, suffixes) -> str | None:  # noqa: ANN001
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem_word(word: str) -> str:
    """The stem of a lower-case word; words of fewer than three letters and words that are not ASCII letters stay."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = word.lstrip("'")
    word = re.sub("(^|(?<=[aeiouy]))y", "Y", word)  # a y that begins a word or follows a vowel is a consonant
    known = next((p for p in PREFIX_R1 if word.lower().startswith(p)), None)
    r1 = len(known) if known else _after(word, 0)
    r2 = _after(word, r1)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b: past and present participles
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and _VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    # 1c: a final y behind a consonant that does not begin the word
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # 2 to 4: derivational endings within the regions
    end = _longest(word, (*STEP_2, "ogi", "li"))
    if end and len(word) - len(end) >= r1:
        if end == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif end == "li":
            word = word[:-2] if len(word) > 2 and word[-3] in "cdeghkmnrt" else word
        else:
            word = word[: -len(end)] + STEP_2[end]
    end = _longest(word, (*STEP_3, "ative"))
    if end and len(word) - len(end) >= r1:
        if end != "ative":
            word = word[: -len(end)] + STEP_3[end]
        elif len(word) - len(end) >= r2:
            word = word[:-5]
    end = _longest(word, (*STEP_4, "ion"))
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    # 5: a final e or l
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Stems of a column of distinct words."""
    return words.map(stem_word, na_action="ignore")
