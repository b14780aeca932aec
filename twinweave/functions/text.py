"""String functions of the value generators and matchers, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content, words to skip in scores, and what names a kind of attribute.
FILLERS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "by", "for")
STOPWORDS = ("a", "an", "the", "in", "on", "at", "to", "of", "and", "or", "is", "are", "was", "were", "be", "been", "by")
TYPE_KEYWORDS = {
    "name": ("name", "label", "title", "username"),
    "date": ("date", "time", "year", "birth", "death", "founded"),
    "number": ("age", "count", "population", "height", "weight", "score"),
    "location": ("location", "place", "city", "country", "address"),
    "description": ("description", "comment", "bio", "summary", "abstract"),
    "identifier": ("id", "uri", "url", "code", "isbn"),
}
NAME_KEYWORDS = "|".join(TYPE_KEYWORDS["name"])
LONG_TEXT_KEYWORDS = ("comment", "description", "bio", "biography", "summary", "abstract", "note", "text", "content", "article", "review")
INVARIANT_VALUES = ("yes", "no", "true", "false", "none", "null", "n/a", "na", "unknown")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
IMPOSSIBLE_STARTS = (
    "sn", "sr", "sb", "sd", "sf", "sg", "sv", "sz", "nm", "ng", "nr", "nl", "nb", "nd", "mr", "ml", "mn", "mt", "md", "lr", "lm", "ln", "lt", "ld", "lk",
    "tn", "tm", "tk", "tp", "tb", "td", "pn", "pm", "pk", "pb", "pd", "bn", "bm", "bk", "bp", "bd", "dn", "dm", "dk", "dp", "db",
)
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Inc", "Ltd", "Sr", "Jr", "etc")
GARBAGE = r"(?i)u00[a-f0-9]{2}|&#x[a-f0-9]{2,4};|&#[0-9]{2,4};|%[a-f0-9]{2}"


def stripped(value: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def tokens(value: Column) -> Column:
    """Lower-cased words."""
    return F.filter(F.split(F.lower(value), r"\s+"), lambda w: w != "")


def repaired(value: Column) -> Column:
    """``u00e9`` and ``\\u00e9`` as the characters they mean."""
    bits = F.split(value, r"\\?u(?=00[0-9a-fA-F]{2})", -1)
    code = lambda x: F.char(F.conv(F.substring(x, 3, 2), 16, 10).cast("long"))
    rest = F.transform(F.slice(bits, 2, F.greatest(F.lit(1), F.size(bits))), lambda x: F.concat(code(x), F.substring(x, F.lit(5), F.length(x))))
    return F.when(value.contains("u00"), F.concat(F.get(bits, F.lit(0)), F.array_join(rest, ""))).otherwise(value)


def simple_clean(value: Column) -> Column:
    """Repaired, without links, odd characters, immediately repeated words, single letters, and spaces, dots and dashes at the ends."""
    v = F.regexp_replace(repaired(value), r"http\S+", "")
    v = F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"[^\p{L}\p{N}_\s.\-']", " ")
    v = F.regexp_replace(v, r"(?iU)\b(\w+)(?: \1\b)++", "$1")  # possessive: no recursion along a run
    v = F.regexp_replace(v, r"(?U)\b[A-Za-z]\b", "")
    return F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"^[ .\-]+|[ .\-]+$", "")


def expand_predicate(name: Column, labels: Column | None = None) -> Column:
    """Local name with camel case, underscores and dashes as spaces, lower-cased; ``labels`` is a map of identifiers."""
    local = F.regexp_extract(name, "([^#/:]*)$", 1)
    split = F.lower(F.trim(F.regexp_replace(F.regexp_replace(local, "([a-z])([A-Z])", "$1 $2"), r"[_\-\s]+", " ")))
    return F.coalesce(F.try_element_at(labels, local), split) if labels is not None else split


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def grams(value: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased value with a space on each side."""
    padded = F.concat(F.lit(" "), F.lower(value), F.lit(" "))
    # A look-ahead matches at every character, so one pass of the pattern takes all grams.
    every = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(padded) < n, F.array(padded)).otherwise(F.array_distinct(every))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of distinct elements; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def trigram_jaccard(a: Column, b: Column) -> Column:
    return jaccard(grams(a), grams(b))


def content_words(value: Column) -> Column:
    return F.array_distinct(F.array_except(tokens(value), F.array(*map(F.lit, STOPWORDS))))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(content_words(a), content_words(b))


def token_overlap(given: Column, made: Column) -> Column:
    """Share of the made text's words, repeats counted, that the given one has; stop words count on neither side."""
    stop = F.array(*map(F.lit, STOPWORDS))
    sides = F.struct(F.filter(tokens(made), lambda w: ~F.array_contains(stop, w)).alias("made"), F.array_distinct(tokens(given)).alias("given"))
    share = lambda r: F.size(F.filter(r["made"], lambda w: F.array_contains(r["given"], w))) / F.size(r["made"])
    # A one-element transform names the word lists, so that they are made once.
    return F.get(F.transform(F.array(sides), lambda r: F.when(F.size(r["made"]) == 0, 0.0).otherwise(share(r))), F.lit(0))


def prompted(value: Column) -> Column:
    """What follows the first ``: ``, or the whole value."""
    return stripped(F.when(value.contains(": "), F.substring(value, F.instr(value, ": ") + 2, F.length(value))).otherwise(value))


def is_token_swap(a: Column, b: Column) -> Column:
    """Same words in another order or number of repeats."""
    key = lambda c: F.array_sort(F.array_distinct(tokens(c)))
    return (F.lower(prompted(a)) != F.lower(stripped(b))) & (key(prompted(a)) == key(b))


def differs_by_fillers(a: Column, b: Column) -> Column:
    fillers = F.array(*map(F.lit, FILLERS))
    rest = lambda c: F.filter(tokens(c), lambda w: ~F.array_contains(fillers, w))
    return (F.lower(prompted(a)) != F.lower(stripped(b))) & (rest(prompted(a)) == rest(b))


def is_garbage(value: Column) -> Column:
    """Has remains of escapes of any kind."""
    return value.rlike(GARBAGE)


def keeps_training_row(source: Column, target: Column, least_ratio: float = 0.1) -> Column:
    """Neither garbage, nor a swap, nor a filler difference, nor a pair with hardly an edit in common."""
    return ~is_garbage(source) & ~is_garbage(target) & ~is_token_swap(source, target) & ~differs_by_fillers(source, target) & ((source == target) | (levenshtein_ratio(source, target) >= least_ratio))


def value_type(value: Column) -> Column:
    """date (parts by dash or slash, one a number of four digits or more), number, id (short, with a digit) or text."""
    parts = F.split(F.replace(value, F.lit("/"), F.lit("-")), "-")
    date = (F.size(parts) >= 2) & F.exists(parts, lambda x: x.rlike("^[0-9]{4,}$"))
    number = F.replace(value, F.lit(","), F.lit("")).rlike(r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i)(nan|inf|infinity))\s*$")
    code = (F.length(value) < 20) & ~value.contains(" ") & value.rlike("[0-9]")
    return F.when(value == "", "unknown").when(date, "date").when(number, "number").when(code, "id").otherwise("text")


def first_number(value: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(value, "[, ]", ""), r"(-?[0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double")


def attribute_type(predicate: Column, value: Column) -> Column:
    """By keywords of the predicate, then by the value."""
    has = {kind: F.lower(predicate).rlike("|".join(words)) for kind, words in TYPE_KEYWORDS.items()}
    found = F.when(has["name"], "name")
    for kind in list(has)[1:]:
        found = found.when(has[kind], kind)
    found = found.when(F.translate(value, "-/:", "").rlike("^[0-9]+$"), "date").when(F.translate(value, ".,", "").rlike("^[0-9]+$"), "number")
    return found.when(F.size(tokens(value)) > 10, "description").otherwise("other")


def content_type(value: Column) -> Column:
    """invariant (constants), numeric (dates, numbers, codes, links, addresses), short (three words at most) or long."""
    v = stripped(value)
    words = tokens(v)
    dated = F.exists(words, lambda w: w.isin(*MONTHS)) & F.exists(words, lambda w: w.rlike("^[0-9]{4}$"))
    numeric = v.rlike(r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|^[0-9]{2}[-/][0-9]{2}[-/][0-9]{4}|^[0-9\s\-/:.]+$") | dated
    numeric = numeric | v.rlike(r"^[A-Za-z0-9\-_]{5,}$") & v.rlike("[0-9]") | v.rlike("^https?://") | v.contains("@")
    return F.when(F.lower(v).isin(*INVARIANT_VALUES), "invariant").when(numeric, "numeric").when(F.size(words) <= 3, "short").otherwise("long")


def is_plausible_name(value: Column) -> Column:
    """Has a vowel, no run of four consonants, no unlikely start; texts of under two characters can't be judged."""
    v = F.lower(stripped(value))
    long_run = F.regexp_replace(v, "[aeiou]", " ").rlike(r"\p{L}{4}")
    return (F.length(v) < 2) | v.rlike("[aeiou]") & ~long_run & ~F.substring(v, 1, 2).isin(*IMPOSSIBLE_STARTS)


def eda_clean(value: Column) -> Column:
    """Lower-case letters and single spaces."""
    v = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(value, "['\"’]", ""), r"[-\t\n]", " ")), "[^a-z ]", " ")
    return F.trim(F.regexp_replace(v, " +", " "))


def sentences(value: Column) -> Column:
    """Sentences: breaks after . ! ? before a space and a capital, not after abbreviations, and at newlines."""
    held = F.regexp_replace(value, f"({'|'.join(ABBREVIATIONS)})\\.", "$1\u0001")
    held = F.regexp_replace(held, r"(e)\.(g)\.|(i)\.(e)\.", "$1$3\u0001$2$4\u0001")
    marked = F.regexp_replace(held, r"([.!?])\s+([A-Z])", "$1\u0002$2")
    parts = F.split(F.regexp_replace(marked, r"\n+", "\u0002"), "\u0002")
    return F.filter(F.transform(parts, lambda s: stripped(F.translate(s, "\u0001", "."))), lambda s: s != "")


def chunks(value: Column, most: int = 80) -> Column:
    """Sentences packed in order into chunks of at most ``most`` words; a longer sentence stands alone."""
    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(st: Column, s: Column) -> Column:
        n = F.size(tokens(s))
        fits = (st["n"] > 0) & (st["n"] + n <= most)
        done = F.when(fits | (st["n"] == 0), st["done"]).otherwise(F.concat(st["done"], F.array(st["open"])))
        opened = F.when(fits, F.concat_ws(" ", st["open"], s)).otherwise(s)
        return F.struct(done.alias("done"), opened.alias("open"), F.when(fits, st["n"] + n).otherwise(n).alias("n"))

    return F.aggregate(sentences(value), first, step, lambda st: F.when(st["n"] > 0, F.concat(st["done"], F.array(st["open"]))).otherwise(st["done"]))


def align_chunks(a: Column, b: Column) -> Column:
    """array<struct<a,b>> of both chunk lists in step; the longer list's rest has no partner."""
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def is_long_text_predicate(predicate: Column) -> Column:
    return F.lower(predicate).rlike("|".join(LONG_TEXT_KEYWORDS))


def reordered(given: Column, made: Column) -> Column:
    """Words made for the sorted words of ``given``, put in the order of ``given``; the made text itself if none has a place."""
    sides = F.struct(tokens(given).alias("order"), F.array_sort(tokens(given)).alias("normal"), F.filter(F.split(made, r"\s+"), lambda w: w != "").alias("out"))
    place = lambda r: F.transform(r["order"], lambda w: F.get(r["out"], F.array_position(r["normal"], w).cast("int") - 1))
    # A one-element transform names the three lists, so that they are made once.
    placed = F.filter(F.flatten(F.transform(F.array(sides), place)), lambda w: w.isNotNull())
    return F.when(F.size(placed) > 0, F.array_join(placed, " ")).otherwise(made)


def cache_key(value: Column) -> Column:
    """Sorted words: values that differ by word order share a key."""
    return F.array_join(F.array_sort(tokens(value)), " ")


def canonical_value(predicate: Column, value: Column) -> Column:
    """Title case for names."""
    return F.when(F.lower(predicate).rlike(NAME_KEYWORDS), F.initcap(F.trim(value))).otherwise(F.trim(value))


def clean_markup(value: Column) -> Column:
    """Without tags, punctuation as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "<[^>]*>", ""), r"[!-/:-@\[-`{-~]", " "), r"\s+", " "))


def parse_object(value: Column) -> Column:
    """Literal text of a cell: without angle brackets, language mark and type."""
    v = F.regexp_replace(F.trim(value), "^<|>$", "")
    return F.regexp_replace(F.regexp_replace(v, r'"\^\^.*$|"@[a-zA-Z-]+$', '"'), '^"|"$', "")


def char_ids(value: Column, vocabulary: Column, length: int) -> Column:
    """Numbers of the first ``length`` characters by a map, 0 for unknown ones and as padding."""
    chars = F.slice(F.filter(F.split(F.trim(value), ""), lambda c: c != ""), 1, length)
    ids = F.transform(chars, lambda c: F.coalesce(F.try_element_at(vocabulary, c), F.lit(0).cast("long")))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), length)), 1, length)


def set_uri(a: Column, b: Column) -> Column:
    return F.concat(F.lit("set:"), a, F.lit("|"), b)


def set_members(uri: Column) -> Column:
    return F.split(F.substring(uri, F.lit(5), F.length(uri)), r"\|")


def minted(base: Column, n: Column) -> Column:
    return F.concat(base, F.lit("_aug"), n.cast("string"))


def adaptive_alpha(cosine: Column, base: float = 0.5, spread: float = 0.3) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.lit(base) + F.lit(spread) * (2 * ((cosine + 1) / 2) - 1)))


def duration(seconds: Column) -> Column:
    """1h 02m 03s; hours and minutes only where there are any."""
    s = F.floor(seconds).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m "), two(rest), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(rest), F.lit("s"))).otherwise(F.concat(rest.cast("string"), F.lit("s")))


def latex_escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([&%$#_{}])", r"\\$1")


def is_capitalised(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def words_of(value: Column) -> Column:
    """The words of a text as they are written."""
    return F.filter(F.split(value, r"\s+"), lambda w: w != "")


def entity_runs(value: Column) -> Column:
    """array<struct<first,behind>>: runs of words that begin with a capital, as places of words from 0."""
    words = words_of(value)
    capital = F.concat(F.array(F.lit(False)), F.transform(words, is_capitalised), F.array(F.lit(False)))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words)))
    # A place is a run's first if the place before is no capital, and its last if the place behind is none.
    edge = lambda step: F.transform(F.array(capital), lambda c: F.filter(places, lambda i: F.element_at(c, i + 1) & ~F.element_at(c, i + 1 + step)))[0]
    return F.when(F.size(words) == 0, F.array().cast("array<struct<first:int,behind:int>>")).otherwise(F.zip_with(edge(-1), edge(1), lambda a, b: F.struct((a - 1).alias("first"), b.alias("behind"))))


def mask_entities(value: Column, key: Column, entity_share: float = 0.5, other_share: float = 0.15, mask: str = "<mask>") -> Column:
    """Words masked one by one, each by the hash of the key and its place: those in capitalised runs with a share of their own.
    Texts of fewer than two words stay. The key and the words are made once a text, not once a word."""
    # The first 32 bits are below a share of 2 ** 32 if their digits sort before those of the least number that is not.
    bound = lambda share: F.lit(f"{max(0, math.ceil(share * 2**32)):08x}" if share < 1 else "g")
    hashed = lambda k, i: F.md5(F.concat(k, i.cast("string")))
    one = lambda k: lambda w, i: F.when(hashed(k, i) < F.when(is_capitalised(w), bound(entity_share)).otherwise(bound(other_share)), mask).otherwise(w)
    text = F.array(F.struct(F.concat_ws("|", key, F.lit("")).alias("key"), words_of(value).alias("words")))
    masked = F.transform(text, lambda t: F.when(F.size(t["words"]) > 1, F.array_join(F.transform(t["words"], one(t["key"])), " ")).otherwise(value))
    return F.when(value.isNotNull(), masked[0])


#: For a part of a dataset's label, the identifiers' beginnings that its names stand behind.
DBPEDIA = "http://dbpedia.org/resource/"
NAME_PREFIXES = (
    (("EN_JA",), (DBPEDIA, "http://ja.dbpedia.org/resource/")),
    (("EN_DE",), (DBPEDIA, "http://de.dbpedia.org/resource/")),
    (("EN_FR",), (DBPEDIA, "http://fr.dbpedia.org/resource/")),
    (("DBP_en_YG_en", "D_Y"), (DBPEDIA,)),
    (("DBP_en_WD_en", "D_W"), (DBPEDIA, "http://www.wikidata.org/entity/")),
)


def friendly_name(uri: Column, dataset: str) -> Column:
    """The name in an identifier: what follows the dataset's prefix; in other datasets, and for ``bbc`` without ``dbp:``, the last
    part of the path. Underscores become spaces."""
    behind = lambda mark: F.substring_index(uri, mark, -1)
    name = F.when(uri.contains("dbp:"), behind("dbp:")).otherwise(behind("/")) if "bbc" in dataset else behind("/")
    for labels, prefixes in NAME_PREFIXES:
        if any(label in dataset for label in labels):
            name = uri
            for prefix in reversed(prefixes):
                name = F.when(uri.contains(prefix), behind(prefix)).otherwise(name)
            break
    return F.replace(name, F.lit("_"), F.lit(" "))
