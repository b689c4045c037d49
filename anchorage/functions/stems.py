"""Stems and lemmas of English words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import STOP_WORDS

#: Fixed values of Porter's algorithm (1980): endings of steps 2 and 3 with what takes their place, and of step 4.
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _form(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def porter(word: str) -> str:
    """The stem of a lower-case word by Porter's algorithm; words of one or two letters stay."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (e := _longest(w, ("ed", "ing"))) and "v" in _form(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (e := _longest(w, table)) and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    if (e := _longest(w, STEP4)) and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


#: Irregular forms that rules cannot reach.
IRREGULAR = {
    "was": "be", "were": "be", "been": "be", "is": "be", "are": "be", "had": "have", "has": "have", "did": "do", "done": "do", "went": "go", "gone": "go", "said": "say",
    "made": "make", "men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "teeth": "tooth", "mice": "mouse",
}


def lemma(word: str) -> str:
    """The base form of a lower-case word by rules of English inflection; without a tagger, nouns and verbs go by the same rules."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 4 and w.endswith(("sses", "shes", "ches", "xes", "zes")):
        return w[:-2]
    if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
        return w[:-1]
    for e in ("ing", "ed"):
        stem = w[: -len(e)]
        if w.endswith(e) and len(stem) > 2 and "v" in _form(stem):
            if e == "ed" and stem.endswith("i"):
                return stem[:-1] + "y"
            if _double(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if stem.endswith(("at", "bl", "iz", "v", "c", "s")) and not stem.endswith("ss") or _measure(stem) == 1 and _short(stem) and len(stem) < 4 else stem
    return w


#: Texts whose words are Python strings at once.
SLICE = 256


def _each(f):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def of(words: pa.Array) -> pa.Array:
        coded = words.values.dictionary_encode()
        made = pa.array([None if w is None else f(w) for w in coded.dictionary.to_pylist()], type=pa.string())
        return pa.ListArray.from_arrays(pa.array(words.offsets.to_numpy()), made.take(coded.indices), mask=words.is_null())

    return of


stemmed = _each(porter)


def context_terms(text: Column) -> Column:
    """Stems of the words that are all lower-case letters and no stop words, repeats included."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: w.rlike(r"^\p{Ll}+$") & ~w.isin(list(STOP_WORDS)))
    return stemmed(words)


def _maps(words: pa.Array, of: Callable[[list[str]], dict], value: pa.DataType) -> pa.Array:
    """The map of each list of words, made in slices."""
    parts = []
    for lo in range(0, len(words), SLICE):
        part = words.slice(lo, SLICE)
        at = part.offsets.to_numpy()
        flat = words.values.slice(at[0], at[-1] - at[0]).to_pylist()
        at = (at - at[0]).tolist()
        begins, keys, counts = [], [], []
        for i, known in enumerate(part.is_valid().to_pylist()):
            begins.append(len(keys) if known else None)
            if known:
                made = of(flat[at[i] : at[i + 1]])
                keys += made.keys()
                counts += made.values()
        parts.append(pa.MapArray.from_arrays(pa.array([*begins, len(keys)], type=pa.int32()), pa.array(keys, type=pa.string()), pa.array(counts, type=value)))
    return pa.concat_arrays(parts) if parts else pa.array([], type=pa.map_(pa.string(), value))


@F.arrow_udf(T.MapType(T.StringType(), T.DoubleType()))
def _shares(words: pa.Array) -> pa.Array:
    return _maps(words, lambda ws: {k: n / len(ws) for k, n in sorted(Counter(ws).items())}, pa.float64())


@F.arrow_udf(T.MapType(T.StringType(), T.IntegerType()))
def _vector(words: pa.Array) -> pa.Array:
    known: dict[str, bool] = {}

    def counts(w: str) -> bool:
        if w not in known:
            known[w] = lemma(w.lower()) not in STOP_WORDS
        return known[w]

    return _maps(words, lambda ws: dict(sorted((w, n) for w, n in Counter(ws).items() if counts(w))), pa.int32())


def context_counter(text: Column) -> Column:
    """Stems to their shares of a context, as a map."""
    return _shares(context_terms(text))


def term_vector(text: Column) -> Column:
    """Words to their counts, as a map, without those whose lemma is a stop word and without punctuation."""
    return _vector(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
