"""Secret scan in native expressions: anchored patterns, and sliding-window Shannon entropy over candidate strings.

Base kinds are regular expressions. Their positions come from ``split`` and ``regexp_extract_all`` of the same pattern:
what lies between the matches and the matches themselves add up to each start. The entropy kind looks at maximal runs of
secret-like characters, at least one window long. A window of ``WINDOW`` characters slides along the run; each step
updates two counts and the sum of c*log2(c), kept as integers in units of 2**-20 bits so that thresholds are exact. A
run's character class sets its threshold; from the first to the last window that reaches it is a span. Runs on the
allow-list are suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm._common import text_or_empty

#: Kinds in order, with patterns whose matches need no later length test except assign's group 2.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGNED = 6

WINDOW = 20
RUN = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class of a run, first that fits, and the bits per character that a window must reach.
CLASSES = (("hex", "^[0-9A-Fa-f]+$", 3.2), ("letters", "^([a-z]+|[A-Z]+|[A-Z][a-z]+)$", 4.15), ("alnum", "^[A-Za-z0-9]+$", 3.8), ("symbols", "", 3.9))
#: Runs that are no secrets, matched in lower case: these, and words joined by single separators.
ALLOWED = r"^[0-9]+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|example|sample|placeholder|changeme|dummy|0123456789|abcdefghij|qwertyuiop"
#: No group of these patterns repeats: the JVM matches a repeated group by recursion, which a long run would exhaust.
JOINED, SEPARATOR, TWO_SEPARATORS = "^[a-z][a-z/_-]*[a-z]$", "[/_-]", "[/_-][/_-]"
SCALE = 2**20
TERMS = tuple(round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1))


def sum_limit(bits: float) -> int:
    """Largest sum of c*log2(c) of a window with at least ``bits`` of entropy."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of the leftmost non-overlapping matches, in code points.

    Lengths are summed in runs of about the square root of the number of matches, then the runs' totals are summed, so
    that appending to an array, which copies it, never costs the square of the number.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    kind = "array<struct<start:int,end:int,m:string>>"
    none = F.array().cast(kind)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    def run_at(all_pairs: Column, run: Column):
        return lambda first: F.aggregate(F.slice(all_pairs, first, run), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def runs_of(all_pairs: Column) -> Column:
        run = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(all_pairs))).cast("int"))
        return F.transform(F.sequence(F.lit(1), F.size(all_pairs), run), run_at(all_pairs, run))

    def shifted(walked: Column, before: Column) -> Column:
        return F.transform(walked["out"], lambda x: F.struct((x["start"] + before).alias("start"), (x["end"] + before).alias("end"), x["m"].alias("m")))

    def placed(runs: Column) -> Column:
        before = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, r: F.struct((s["at"] + r["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(runs, before, shifted))

    # One-element transforms stand for local names, so that neither the pairs nor the runs are computed twice.
    walked = F.flatten(F.transform(F.transform(F.array(pairs), runs_of), placed))
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _entropy_span(run: str, limit: str) -> str:
    """SQL for struct<first,last>: starts of the run's first and last window whose sum is at most the limit; null if none.

    The state holds the window's count of each character of ALPHABET; a step changes the counts of the character that
    leaves and of the one that enters, and the sum by the difference of their terms.
    """
    terms = "array(" + ",".join(f"{t}L" for t in TERMS) + ")"
    n = f"length({run})"
    idx = f"transform(split({run}, ''), c -> instr('{ALPHABET}', c))"
    start = f"transform(sequence(1, {len(ALPHABET)}), k -> size(filter(slice(idx, 1, {WINDOW}), x -> x = k)))"
    term = lambda c: f"element_at(terms, {c} + 1)"
    enters, leaves = "element_at(r.idx, i)", f"element_at(r.idx, i - {WINDOW})"
    moved = f"{term(f'(element_at(st.counts, {enters}) + 1)').replace('terms', 'r.terms')} - {term(f'element_at(st.counts, {enters})').replace('terms', 'r.terms')} + {term(f'(element_at(st.counts, {leaves}) - 1)').replace('terms', 'r.terms')} - {term(f'element_at(st.counts, {leaves})').replace('terms', 'r.terms')}"
    total = f"st.total + if({enters} = {leaves}, 0L, {moved})"
    counts = f"if({enters} = {leaves}, st.counts, transform(st.counts, (c, k) -> c + if(k + 1 = {enters}, 1, 0) - if(k + 1 = {leaves}, 1, 0)))"
    step = f"named_struct('counts', {counts}, 'total', {total}, 'first', coalesce(st.first, if({total} <= r.lim, i - {WINDOW}, null)), 'last', if({total} <= r.lim, i - {WINDOW}, st.last))"
    # One-element transforms stand for local names: r holds the run's indexes, terms and limit; s the first window.
    first = f"transform(array(named_struct('counts', {start.replace('idx', 'r.idx')})), s -> named_struct('counts', s.counts, 'total', aggregate(s.counts, 0L, (a, c) -> a + element_at(r.terms, c + 1))))"
    seeded = f"transform({first}, s -> named_struct('counts', s.counts, 'total', s.total, 'first', if(s.total <= r.lim, 0, cast(null as int)), 'last', if(s.total <= r.lim, 0, cast(null as int))))"
    walked = f"transform({seeded}, s -> if(r.n > {WINDOW}, aggregate(sequence({WINDOW + 1}, greatest(r.n, {WINDOW + 1})), s, (st, i) -> {step}), s))"
    local = f"named_struct('idx', {idx}, 'terms', {terms}, 'lim', {limit}, 'n', {n})"
    return f"element_at(flatten(transform(array({local}), r -> {walked})), 1)"


def _allowed(run: Column) -> Column:
    low = F.lower(run)
    return low.rlike(ALLOWED) | (low.rlike(JOINED) & low.rlike(SEPARATOR) & ~low.rlike(TWO_SEPARATORS))


def _entropy_spans(text: Column) -> tuple[Column, str]:
    limits = "case " + " ".join(f"when x.m rlike '{p}' then {sum_limit(b)}L" for _, p, b in CLASSES if p) + f" else {sum_limit(CLASSES[-1][2])}L end"
    runs = F.filter(_matches(text, RUN), lambda x: ~_allowed(x["m"]))
    return runs, f"filter(transform(runs, x -> named_struct('run', x, 'w', {_entropy_span('x.m', limits)})), y -> y.w.first is not null)"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans array<struct<start,kind_no,end,kind>> by start, then kind.

    Null and empty texts have no spans. Texts are scanned whole, however many matches they hold and however long a run is. Positions count code
    points, the end is exclusive, a base span is the whole match. Rows that repeat are scanned each for itself; other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    text = F.col("_text")
    runs, entropy = _entropy_spans(text)
    rows = rows.select("_id", F.filter(_matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= MIN_ASSIGNED).alias("assign"), _matches(text, ACCESS).alias("access"), _matches(text, HEX).alias("hex"), runs.alias("runs"))
    rows = rows.withColumn("entropy", F.when(F.size("runs") > 0, F.expr(entropy)))

    def span(kind: int, start, end) -> Column:
        return F.struct(start.alias("start"), F.lit(kind).alias("kind_no"), end.alias("end"), F.lit(KINDS[kind]).alias("kind"))

    def spanner(kind: int):
        return lambda x: span(kind, x["start"], x["end"])

    base = [F.transform(F.col(k), spanner(i)) for i, k in enumerate(KINDS[:3])]
    more = F.transform(F.coalesce(F.col("entropy"), F.array().cast(rows.schema["entropy"].dataType)), lambda y: span(3, y["run"]["start"] + y["w"]["first"], y["run"]["start"] + y["w"]["last"] + WINDOW))
    return rows.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*base, more)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
