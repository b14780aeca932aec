"""Value generators and scores that need Python: Arrow-batched UDFs, seeded by a hash column so that reruns agree."""

from __future__ import annotations

import difflib
import random
import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinweave.functions.text import FILLERS

#: Short forms.
SHORT = {"street": "st", "saint": "st", "doctor": "dr", "company": "co", "incorporated": "inc", "university": "univ", "department": "dept"}
SIMILAR = {
    "a": ("a", "e", "o"),
    "e": ("e", "a", "i"),
    "i": ("i", "e", "y"),
    "o": ("o", "a", "u"),
    "u": ("u", "o", "v"),
    "b": ("b", "p", "d"),
    "p": ("p", "b"),
    "d": ("d", "b", "t"),
    "t": ("t", "d"),
    "g": ("g", "j", "q"),
    "j": ("j", "g"),
    "c": ("c", "k", "s"),
    "k": ("k", "c"),
    "s": ("s", "c", "z"),
    "z": ("z", "s"),
    "n": ("n", "m"),
    "m": ("m", "n"),
    "w": ("w", "v"),
    "v": ("v", "w", "u"),
    "f": ("f", "v", "ph"),
    "l": ("l", "r"),
    "r": ("r", "l"),
}


KEPT = string.whitespace + string.punctuation


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T of the matching blocks of both lower-cased texts."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def fix_escapes(values: pd.Series) -> pd.Series:
    """``\\u00e9`` and ``u00e9`` as the characters they mean."""
    return values.str.replace(r"\\?u(00[0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), regex=True)


def _vary(value: str, rng: random.Random) -> str:
    words = value.split()
    if not words:
        return value
    if value.lower() in ("true", "false", "yes", "no"):
        return {"true": "false", "false": "true", "yes": "no", "no": "yes"}[value.lower()]
    if value.replace(".", "", 1).lstrip("-").isdigit():
        return str(int(float(value)) + rng.choice((-1, 1)))
    i = rng.randrange(len(words))
    word = words[i]
    choice = rng.randrange(4)
    if choice == 0 and word.lower() in SHORT:
        words[i] = SHORT[word.lower()]
    elif choice == 1 and len(words) > 1:
        words[i] = word[0] + "."
    elif choice == 2 and len(word) > 4:
        words[i] = word[:-1] + rng.choice("aeiou")
    else:
        words[i] = word.swapcase() if word.isupper() else word.capitalize()
    return " ".join(words)


@F.pandas_udf(T.StringType())
def variation(values: pd.Series, keys: pd.Series) -> pd.Series:
    """A plausible variation of each value: abbreviation, initial, changed ending or case; numbers move by one."""
    return pd.Series([None if v is None else _vary(v, random.Random(k)) for v, k in zip(values, keys, strict=True)])


def _similar(c: str, rng: random.Random) -> str:
    """A character that is taken for ``c``, in its case."""
    found = rng.choice(SIMILAR.get(c.lower(), (c.lower(),)))
    return found.upper() if c.isupper() else found


def _noise(value: str, rng: random.Random, rate: float) -> str:
    """Texts of under three characters, white space and punctuation stay."""
    if len(value) < 3:
        return value
    out, at = [], 0
    while at < len(value):
        c, after = value[at], value[at + 1 : at + 2]
        at += 1
        kind = rng.choice(("substitute", "swap", "delete", "insert")) if c not in KEPT and rng.random() < rate else ""
        if kind == "substitute" and c.isalpha():
            out.append(_similar(c, rng))
        elif kind == "swap" and after.isalpha():
            out.append(after + c)
            at += 1
        elif kind == "insert":
            out.append(c + (_similar(c, rng) if c.isalpha() else c))
        elif kind != "delete":
            out.append(c)
    return "".join(out)


def noise(value: Column, key: Column, rate: float = 0.1) -> Column:
    """Replaces by a similar character, swaps, deletes or inserts characters at ``rate``."""
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else _noise(v, random.Random(k), rate) for v, k in zip(values, keys, strict=True)])

    return run(value, key)


def mask_span(value: Column, key: Column, share: float = 0.3, mask: str = "<mask>") -> Column:
    """One span of words replaced by a mask; its place comes from the key. Built in."""
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    n = F.size(words)
    length = F.greatest(F.lit(1), F.floor(n * share).cast("int"))
    start = (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.greatest(F.lit(1), n - length + 1)).cast("int")
    return F.when(n < 2, value).otherwise(F.array_join(F.concat(F.slice(words, F.lit(1), start), F.array(F.lit(mask)), F.slice(words, start + length + 1, n)), " "))


def _eda(value: str, rng: random.Random, alpha: float, count: int, synonyms: dict[str, list[str]]) -> list[str]:
    words = value.split()
    out = []
    if words:
        n = max(1, int(alpha * len(words)))
        for technique in range(count):
            new = list(words)
            for _ in range(n):
                i = rng.randrange(len(new))
                if technique % 4 == 0 and new[i].lower() in synonyms:
                    new[i] = rng.choice(synonyms[new[i].lower()])
                elif technique % 4 == 1 and new[i].lower() in synonyms:
                    new.insert(rng.randrange(len(new) + 1), rng.choice(synonyms[new[i].lower()]))
                elif technique % 4 == 2:
                    j = rng.randrange(len(new))
                    new[i], new[j] = new[j], new[i]
                elif technique % 4 == 3 and len(new) > 1:
                    del new[i]
            out.append(" ".join(new))
    return [*out, value]


def eda_variants(value: Column, key: Column, alpha: float = 0.1, count: int = 4, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Synonym replacement, insertion, swap and deletion, in turn; the original comes last."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(values: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else _eda(v, random.Random(k), alpha, count, synonyms or {}) for v, k in zip(values, keys, strict=True)])

    return run(value, key)


#: Endings that are no variation, short forms without a vowel, words that only a prompt has.
LAZY_SUFFIXES = ("jr", "jr.", "sr", "sr.", "ii", "iii", "iv")
VOICELESS = ("jr", "sr", "mr", "dr", "st", "nd", "rd", "th")
PROMPT_WORDS = ("rewrite", "paraphrase")
SHORT_WORDS = 5


def _alike(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def is_lazy_suffix(given: str, made: str) -> bool:
    """The given words and one ending that is no variation."""
    x, y = given.lower().split(), made.lower().split()
    return len(y) == len(x) + 1 and y[:-1] == x and y[-1] in LAZY_SUFFIXES


def unpronounceable(text: str) -> int:
    """Words of three letters or more without a vowel, y among the vowels."""
    return sum(len(w) > 2 and w not in VOICELESS and not set("aeiouy") & set(w) for w in _words(text))


def is_abbreviation(short: str, full: str) -> bool:
    starts = full.lower().startswith(short.lower())
    return starts and (len(short) == 1 or len(short) <= 3 < len(full))


def is_char_swap(a: str, b: str) -> bool:
    """Two neighbouring characters have changed places, and that is all."""
    a, b = a.lower(), b.lower()
    differ = [i for i, pair in enumerate(zip(a, b, strict=False)) if pair[0] != pair[1]]
    if len(a) != len(b) or len(differ) != 2 or differ[1] != differ[0] + 1:
        return False
    i, j = differ
    return a[i] == b[j] and a[j] == b[i]


def char_swaps(made: str, given: str) -> int:
    """Words that are a swap of the given word in their place; none if a word is another one altogether."""
    x, y = given.lower().split(), made.lower().split()
    changed = [(p, q) for p, q in zip(x, y, strict=False) if p != q]
    swapped = [is_char_swap(p, q) for p, q in changed]
    if len(x) != len(y) or any(not ok and _alike(q, p) < 0.7 for ok, (p, q) in zip(swapped, changed, strict=True)):
        return 0
    return sum(swapped)


def connection(word: str, others: set[str]) -> float:
    """1 for a word of ``others``, 0.7 for an abbreviation of one, the best similarity from 0.5 on, else 0."""
    if word in others:
        return 1.0
    if any(is_abbreviation(word, o) for o in others):
        return 0.7
    best = max((_alike(word, o) for o in others if len(o) > 1), default=0.0)
    return best if best >= 0.5 else 0.0


def _every_word_new(x: list[str], y: list[str]) -> bool:
    """No given word is in its place any more, and none was only dropped; one word is not enough."""
    return len(y) >= len(x) and len(y) >= 2 and all(p != q for p, q in zip(x, y, strict=False))


def _connected(words: set[str], first: set[str], second: set[str]) -> tuple[bool, bool]:
    """Whether any word comes from the first and from the second text; a word about as close to both comes from both."""
    sides = [False, False]
    for word in words:
        near = connection(word, first), connection(word, second)
        top = max(near)
        for k in (0, 1):
            sides[k] |= near[k] > 0.4 and (near[k] == top and near[1 - k] != top or top - near[k] < 0.15)
    return sides[0], sides[1]


def _short_score(given: str, made: str, other: str) -> tuple[float, str]:
    g, m, o = (t.strip().lower() for t in (given, made, other))
    if len(re.findall("u00[a-f0-9]{2}", m)) >= 2:
        return 0.05, "garbage"
    if unpronounceable(m):
        return 0.0, "unpronounceable"
    if m in (g, o):
        return 0.0, "identity"
    if is_lazy_suffix(g, m):
        return 0.1, "lazy suffix"
    x, y = g.split(), m.split()
    if len(y) < len(x) and set(y) <= set(x):
        return 0.15, "removal"
    if _every_word_new(x, y):
        return 1.0, "all modified"
    swaps = max(char_swaps(m, g), char_swaps(m, o) if o else 0)
    if swaps:
        return (0.7 if len(y) == 1 else 1.0 if swaps >= len(y) else round(0.2 + 0.4 * swaps / len(y), 2)), "swap"
    if max(_alike(m, g), _alike(m, o) if o else 0.0) > 0.9:
        return 0.2, "near copy"
    new, first, second = set(_words(m)), set(_words(g)), set(_words(o))
    added, lost = new - first - second, (first | second) - new
    if added and added <= set(FILLERS) and not lost:
        return 0.15, "filler"
    if lost and added <= set(FILLERS):
        return 0.15, "removal and filler"
    if len(new) > 1 and not added:
        return 0.15, "shuffle"
    from_first, from_second = _connected(new, first, second)
    same = bool(o) and g == o
    if from_first and from_second and not same:
        return 1.0, "mix"
    if from_first or from_second:
        return (0.8 if same else 0.7), "partial"
    return 0.1, "garbage"


def _meaning(a: str, b: str) -> float:
    """Stands for a sentence model: common words by the larger number of distinct words."""
    x, y = set(_words(a)), set(_words(b))
    return len(x & y) / max(len(x), len(y)) if x and y else 0.0


def _long_score(given: str, made: str, other: str) -> tuple[float, str]:
    m, texts = made.strip(), [t.strip() for t in (given, other) if t.strip()]
    if len(re.findall("u00[a-f0-9]{2}", m.lower())) >= 2:
        return 0.05, "garbage"
    letters = max(_alike(m, t) for t in texts)
    if letters > 0.9:
        return (0.0, "identity") if letters > 0.95 else (0.2, "near copy")
    meaning = max(_meaning(m, t) for t in texts)
    if meaning > 0.75:
        return (1.0, "rephrase") if letters < 0.7 else (0.6, "similar")
    bands = ((0.5, 0.7, "partial"), (0.3, 0.4, "weak"))
    return next(((score, why) for above, score, why in bands if meaning > above), (0.1, "garbage"))


def score_text(given: str | None, made: str | None, other: str | None = None) -> tuple[float, str]:
    """(score, reason) of a made text against the given one and, where there is one, the text of the other side."""
    given, made, other = given or "", made or "", other or ""
    if len(made.strip()) < 2:
        return -1.0, "empty"
    if any(w in made.lower() for w in PROMPT_WORDS):
        return -1.0, "leaked"
    if len(_words(given)) <= SHORT_WORDS:
        return _short_score(given, made, other)
    return _long_score(given, made, other)


def _shared(a: str, b: str) -> set[str]:
    """Words of both texts, and words of the first that resemble one of the second."""
    x, y = set(_words(a)), set(_words(b))
    both = x & y
    return both | {w for w in x - both if any(_alike(w, v) > 0.7 for v in y - both)}


def coherence(in_a: str, in_b: str, out_a: str, out_b: str) -> float:
    """0.15, up to 0.3, for each shared word varied alike on both sides; 0.1 if shared words stayed; else 0."""
    given, made = _shared(in_a, in_b), _shared(out_a, out_b)
    varied = sum(0.5 < _alike(m, g) < 0.95 for m in made for g in given)
    return min(0.3, 0.15 * varied) if varied else 0.1 if given & made else 0.0


SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType())])


@F.pandas_udf(SCORE)
def _scores(source: pd.Series, target: pd.Series, other: pd.Series) -> pd.DataFrame:
    rows = [score_text(*x) for x in zip(source, target, other, strict=True)]
    return pd.DataFrame(rows, columns=["score", "reason"]).astype({"score": "float64"})


def creativity_score(source: Column | str, target: Column | str, other: Column | str | None = None) -> Column:
    """struct(score, reason): ordered rules for given texts of up to five words, bands of letters and words for longer ones,
    -1 for empty or leaked targets; ``other`` is the text of the other side, if there is one."""
    return _scores(source, target, F.lit("") if other is None else other)


@F.pandas_udf(T.DoubleType())
def pair_score(in_a: pd.Series, in_b: pd.Series, out_a: pd.Series, out_b: pd.Series) -> pd.Series:
    """Mean of both sides' scores, a failed side as 0; bonuses for coherence and for two good sides fill what is missing to 1."""
    out = []
    for a, b, x, y in zip(*(s.fillna("") for s in (in_a, in_b, out_a, out_b)), strict=True):
        sides = [max(0.0, score_text(a, x, b)[0]), max(0.0, score_text(b, y, a)[0])]
        base = sum(sides) / 2
        bonus = coherence(a, b, x, y) + (0.1 if min(sides) >= 0.6 else 0.0)
        out.append(min(1.0, base + bonus * (1 - base)))
    return pd.Series(out, dtype="float64")
