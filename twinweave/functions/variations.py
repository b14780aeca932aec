"""Variations of values by typed strategies, as column expressions: what a value is decides what may be done to it, a hash of
its key decides what is done, and variations that no longer look like names are turned down."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinweave.functions import text as X

#: Attempts at a short value before it is only written another way.
ATTEMPTS = 4
#: Month names, and values that stand for their opposite.
SHORT_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
OPPOSITES = {"yes": "no", "no": "yes", "true": "false", "false": "true"}
#: Spellings that sound alike, in the order in which they are tried.
SPELLINGS = (("ph", "f"), ("ck", "k"), ("sch", "sh"), ("th", "t"), ("c", "k"), ("y", "i"), ("z", "s"), ("w", "v"), ("f", "ph"), ("i", "y"), ("k", "c"))
VOWELS, ENDINGS = ("a", "e", "i", "o", "u"), ("e", "o", "s", "er")
DATE, MONTH = r"^([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})", r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"
YEAR = r"\b([0-9]{4})\b"


def draw(key: Column, *parts: Column | int) -> Column:
    """A number from the hash of the key and further parts."""
    text = F.concat_ws("|", key, *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def pick(options: list[Column], number: Column) -> Column:
    return F.element_at(F.array(*options), (number % len(options) + 1).cast("int"))


def flipped(value: Column, number: Column) -> Column:
    """The opposite of a truth value, half of the time."""
    low = F.lower(F.trim(value))
    turned = reduce(lambda rest, pair: F.when(low == pair[0], pair[1]).otherwise(rest), OPPOSITES.items(), value)
    return F.when(number % 2 == 0, turned).otherwise(value)


def other_date(value: Column, number: Column) -> Column:
    """YYYY-MM-DD in another of four forms; null for anything else."""
    y, m, d = (F.regexp_extract(value, DATE, i) for i in (1, 2, 3))
    month = m.try_cast("int")
    name = F.element_at(F.array(*map(F.lit, SHORT_MONTHS)), F.greatest(F.lit(1), F.least(F.lit(12), F.coalesce(month, F.lit(1)))))
    forms = [F.concat_ws(" ", d.try_cast("int").cast("string"), name, y), F.concat_ws("/", d, m, y), F.concat_ws("/", m, d, y), F.concat(y, m, d)]
    return F.when(value.rlike(DATE) & month.between(1, 12), pick(forms, number))


def other_month(value: Column, number: Column) -> Column:
    """A date with a month's name, with another month and a year up to three years off; null for anything else."""
    found = F.initcap(F.regexp_extract(value, MONTH, 1))
    at = F.array_position(F.array(*map(F.lit, SHORT_MONTHS)), found)
    month = F.element_at(F.array(*map(F.lit, SHORT_MONTHS)), ((at - 1 + number % 11 + 1) % 12 + 1).cast("int"))
    year = F.regexp_extract(value, YEAR, 1).try_cast("int") + pick([F.lit(i) for i in (-3, -2, -1, 1, 2, 3)], F.floor(number / 11))
    day = F.regexp_extract(value, r"\b([0-9]{1,2})\b", 1)
    return F.when(value.rlike(MONTH) & value.rlike(YEAR), F.concat_ws(" ", F.when(day != "", day), month, year.cast("string")))


def other_digits(value: Column, number: Column) -> Column:
    """Two neighbouring digits change places; where all are alike, the last grows by one. Null without digits."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(value) - 1)), lambda i: F.substr(value, i, F.lit(2)).rlike("^[0-9]{2}$") & (F.substr(value, i, F.lit(1)) != F.substr(value, i + 1, F.lit(1))))
    at = F.get(places, (number % F.greatest(F.lit(1), F.size(places))).cast("int"))
    swapped = F.concat(F.substr(value, F.lit(1), at - 1), F.substr(value, at + 1, F.lit(1)), F.substr(value, at, F.lit(1)), F.substr(value, at + 2))
    last = F.regexp_extract(value, "([0-9])[^0-9]*$", 1).try_cast("int")
    grown = F.concat(F.regexp_extract(value, "^(.*)[0-9][^0-9]*$", 1), ((last + 1) % 10).cast("string"), F.regexp_extract(value, "[0-9]([^0-9]*)$", 1))
    return F.when(~value.rlike("[0-9]"), F.lit(None)).when(F.size(places) > 0, swapped).otherwise(grown)


def turned_code(value: Column, number: Column) -> Column:
    """A code's characters, begun at another place."""
    at = (number % F.greatest(F.lit(1), F.length(value) - 1) + 1).cast("int")
    return F.concat(F.substr(value, at + 1), F.substr(value, F.lit(1), at))


def doubled(word: Column, number: Column) -> Column:
    """The first consonant before a vowel twice."""
    return F.regexp_replace(word, "^(.+?)([bdfglmnprst])([aeiou])", "$1$2$2$3")


def other_vowel(word: Column, number: Column) -> Column:
    """The first vowel behind the first letter becomes another one."""
    old = F.regexp_extract(word, "^.[^aeiou]*([aeiou])", 1)
    new = pick([F.lit(v) for v in VOWELS], F.array_position(F.array(*map(F.lit, VOWELS)), old) + number % 4)
    return F.when(old == "", word).otherwise(F.concat(F.regexp_extract(word, "^(.[^aeiou]*)[aeiou]", 1), new, F.regexp_extract(word, "^.[^aeiou]*[aeiou](.*)$", 1)))


def other_spelling(word: Column, number: Column) -> Column:
    """The first spelling that has one that sounds alike, once."""
    out = word
    for old, new in reversed(SPELLINGS):
        out = F.when(word.contains(old), F.regexp_replace(word, f"^(.*?){old}", f"$1{new}")).otherwise(out)
    return out


def other_ending(word: Column, number: Column) -> Column:
    """An ending more, or for longer words the last letter less."""
    added = F.concat(word, pick([F.lit(e) for e in ENDINGS], F.floor(number / 2)))
    return F.when((F.length(word) > 4) & (number % 2 == 0), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(added)


def swapped_letters(word: Column, number: Column) -> Column:
    """The second and the third letter change places."""
    return F.regexp_replace(word, "^(.)([A-Za-z])([A-Za-z])", "$1$3$2")


WORD_STRATEGIES: list[Callable[[Column, Column], Column]] = [doubled, other_vowel, other_spelling, other_ending, swapped_letters]


def varied_word(word: Column, number: Column) -> Column:
    return pick([f(word, F.floor(number / 5)) for f in WORD_STRATEGIES], number)


def _each(words: Column, key: Column) -> Column:
    return F.transform(words, lambda w, i: varied_word(w, draw(key, w, i.cast("string"))))


def abbreviated(words: Column, key: Column) -> Column:
    """One word becomes its initial, the others are varied; a single word loses its end."""
    at = draw(key, "initial") % F.greatest(F.lit(1), F.size(words))
    many = F.transform(words, lambda w, i: F.when(i == at, F.concat(F.substr(w, F.lit(1), F.lit(1)), F.lit("."))).otherwise(varied_word(w, draw(key, w))))
    return F.when(F.size(words) > 1, many).otherwise(F.transform(words, lambda w: F.concat(F.substr(w, F.lit(1), F.lit(3)), F.lit("."))))


def turned(words: Column, key: Column) -> Column:
    """The words from back to front, each varied."""
    return F.reverse(_each(words, key))


def expanded(words: Column, key: Column) -> Column:
    """An article before the last word, the first varied."""
    n = F.size(words)
    return F.concat(F.transform(F.slice(words, F.lit(1), n - 1), lambda w: varied_word(w, draw(key, w))), F.array(F.lit("the")), F.slice(words, n, F.lit(1)))


def combined(words: Column, key: Column) -> Column:
    """Two strategies for each word, one after the other."""
    return _each(_each(words, F.concat(key, F.lit("|first"))), key)


def mixed(words: Column, other: Column) -> Column:
    """The first half of these words and the second half of the other text's."""
    theirs = X.words_of(other)
    half = lambda c: F.greatest(F.lit(1), F.floor((F.size(c) + 1) / 2)).cast("int")
    return F.concat(F.slice(words, F.lit(1), half(words)), F.slice(theirs, F.greatest(F.lit(1), F.size(theirs) - half(theirs) + 1), F.size(theirs)))


def _respelled(words: Column, key: Column) -> Column:
    return F.transform(words, lambda w: other_spelling(other_vowel(w, draw(key, w)), draw(key, w)))


def long_variation(value: Column, number: Column) -> Column:
    """A long text with its second half turned, cut to four fifths, or begun in the middle."""
    words = X.words_of(value)
    n = F.size(words)
    half = F.floor(n / 2).cast("int")
    first, second = F.slice(words, F.lit(1), half), F.slice(words, half + 1, n)
    return F.array_join(pick([F.concat(first, F.reverse(second)), F.slice(words, F.lit(1), F.ceil(n * 0.8).cast("int")), F.concat(second, first)], number), " ")


def numeric_variation(value: Column, number: Column) -> Column:
    code = F.when(F.trim(value).rlike("^[A-Za-z0-9_-]+$") & value.rlike("[A-Za-z]"), turned_code(F.trim(value), number))
    return F.coalesce(other_date(F.trim(value), number), other_month(value, number), code, other_digits(value, number), value)


def short_variation(value: Column, key: Column, other: Column | None = None) -> Column:
    """One attempt at a value of up to three words. A single word of over six letters is only varied as a word."""
    words, number = X.words_of(value), draw(key, "strategy")
    many = F.size(words) > 1
    each = _each(words, key)
    mix = each if other is None else F.when(F.size(X.words_of(other)) > 0, mixed(words, other)).otherwise(each)
    chosen = pick([F.when(many, expanded(words, key)).otherwise(each), each, F.when(many, turned(words, key)).otherwise(each), combined(words, key), mix, abbreviated(words, key), _respelled(words, key)], number)
    return F.array_join(F.when(~many & (F.length(F.trim(value)) > 6), each).otherwise(chosen), " ")


def plausible(value: Column, original: Column) -> Column:
    """Another text than the original, whose words all look like words."""
    return (F.lower(value) != F.lower(F.trim(original))) & F.forall(X.words_of(value), lambda w: X.is_plausible_name(F.regexp_replace(w, "[^\\p{L}]", "")))


def creative(value: Column, key: Column, other: Column | None = None) -> Column:
    """A variation of a value by its content: truth values flip, dates change form or month, numbers and codes change digits,
    long texts are rearranged, and short ones are varied until an attempt is plausible, mixed with ``other`` if it is given.
    Null stays null; texts under two characters stay. The same value and key give the same variation."""
    attempts = F.transform(F.array(*[F.lit(str(i)) for i in range(ATTEMPTS)]), lambda i: short_variation(value, F.concat_ws("|", key, i), other))
    light = F.when(value == F.initcap(F.lower(value)), F.upper(value)).otherwise(F.initcap(F.lower(value)))
    short = F.coalesce(F.get(F.filter(attempts, lambda a: plausible(a, value)), F.lit(0)), light)
    kind, number = X.content_type(value), draw(key, "number")
    made = F.when(kind == "invariant", flipped(value, number)).when(kind == "numeric", numeric_variation(value, number)).when(kind == "long", long_variation(value, number)).otherwise(short)
    return F.when(F.length(F.trim(value)) < 2, value).otherwise(made)
