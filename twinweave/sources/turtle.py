"""Turtle files as triples, read in splits.

Spark's text source cuts a file into splits and gives each line to one of them, but a Turtle statement may run over many
lines, and a dot inside a long literal ends nothing. So two passes read the lines in order. The first asks, for each split
and each state that it may begin in (outside a long literal, or inside one of either quote), in which state it ends and
how many statements end in it; strung together file by file, these small tables say where each split begins. The second
cuts the lines at statement ends. Statements within a split are whole; the ends of splits, at most two pieces a split,
are put together by statement number. Prefixes hold from their declaration on, for the statements of their file.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.plans.storage import cut
from twinweave.plans.workers import make_importable

#: Splits whose states are broadcast; beyond, lines are shuffled to them and sorted again.
MOST_BROADCAST_SPLITS = 100_000

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_LOCAL = r"(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w:.·-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?"
TOKEN = re.compile(rf"""
 (?P<long>\"\"\"|''') | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*') | (?P<iri><[^<>"{{}}|^`\x00-\x20]*>) | (?P<comment>\#.*)
 |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*) | (?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w:]))
 |(?P<name>(?:[^\W_\d](?:[\w.-]*[\w-])?|_)?:(?:{_LOCAL})?) | (?P<word>[A-Za-z]+) | (?P<mark>\^\^|[.;,\[\]()])
""", re.VERBOSE)
_CLOSE = {1: re.compile(r'(?s)(?:[^"\\]|\\.|"(?!""))*"""'), 2: re.compile(r"(?s)(?:[^'\\]|\\.|'(?!''))*'''")}
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_SCHEME = re.compile("[A-Za-z][A-Za-z0-9+.-]*:")


def scan(line: str, state: int) -> tuple[int, list[int]]:
    """State behind a line that begins in ``state`` (0 outside, 1 and 2 inside a long literal), and where statements end in it."""
    at, ends = 0, []
    while at < len(line):
        if state:
            closed = _CLOSE[state].match(line, at)
            if not closed:
                return state, ends
            at, state = closed.end(), 0
            continue
        token = TOKEN.match(line, at)
        if not token:
            at += 1
            continue
        at = token.end()
        if token.lastgroup == "long":
            state = 1 if token[0] == '"""' else 2
        elif token[0] == ".":
            ends.append(at)
    return state, ends


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        token = TOKEN.match(text, at)
        if not token:
            raise ValueError(f"unreadable at {text[at : at + 20]!r}")
        at = token.end()
        if token.lastgroup == "long":
            closed = _CLOSE[1 if token[0] == '"""' else 2].match(text, at)
            if not closed:
                raise ValueError("a literal has no end")
            out.append(("string", text[token.start() : closed.end()]))
            at = closed.end()
        elif token.lastgroup != "comment":
            out.append((token.lastgroup, token[0]))
    return out


def _plain(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3] is not None:
            if m[3] not in _ESCAPES:
                raise ValueError(f"no such escape: {m[0]}")
            return _ESCAPES[m[3]]
        return chr(int(m[1] or m[2], 16))

    return _ESCAPE.sub(one, text) if "\\" in text else text


class _Statement:
    """One statement's triples (s, p, o, kind), read from its tokens; declarations change ``names`` ("" is the base)."""

    def __init__(self, text: str, names: dict[str, str], blank: str):
        self.tokens, self.at, self.names, self.blank = _tokens(text), 0, names, blank
        self.made, self.out, self.declared = 0, [], []
        while self.at < len(self.tokens):
            kind, word = self.tokens[self.at]
            if (kind == "lang" and word in ("@prefix", "@base")) or (kind == "word" and word.lower() in ("prefix", "base")):
                self._declare(word)
            else:
                self._triples()

    def _next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("a statement has no end")
        self.at += 1
        return self.tokens[self.at - 1]

    def _peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("mark", "lang") else ""

    def _expect(self, mark: str) -> None:
        kind, found = self._next()
        if kind != "mark" or found != mark:
            raise ValueError(f"{found!r} stands where {mark!r} should")

    def _declare(self, word: str) -> None:
        self._next()
        name = "base"
        if word.lower().endswith("prefix"):
            kind, name = self._next()
            if kind != "name" or not name.endswith(":"):
                raise ValueError(f"{name!r} is no prefix")
        kind, iri = self._next()
        if kind != "iri":
            raise ValueError(f"{iri!r} is no IRI")
        self.names[name] = self._iri(iri)
        self.declared.append((name, self.names[name]))
        if word.startswith("@"):
            self._expect(".")

    def _iri(self, token: str) -> str:
        iri = _plain(token[1:-1])
        return iri if _SCHEME.match(iri) or "base" not in self.names else urljoin(self.names["base"], iri)

    def _new(self) -> str:
        self.made += 1
        return f"_:{self.blank}.{self.made}"

    def _name(self, token: str) -> str:
        prefix, _, local = token.partition(":")
        if prefix == "_":
            return f"_:{self.blank.partition('.')[0]}.{local}"
        if f"{prefix}:" not in self.names:
            raise ValueError(f"prefix {prefix!r} is not declared")
        return self.names[f"{prefix}:"] + re.sub(r"\\(.)", r"\1", local)

    def _triples(self) -> None:
        anonymous = self._peek() == "["
        subject, kind = self._term()
        if kind == "lit":
            raise ValueError("a literal is a subject")
        if not (anonymous and self._peek() == "."):
            self._predicates(subject)
        self._expect(".")

    def _predicates(self, subject: str) -> None:
        while True:
            kind, word = self._next()
            if kind == "word" and word == "a":
                predicate = RDF + "type"
            elif kind in ("iri", "name") and not word.startswith("_:"):
                predicate = self._iri(word) if kind == "iri" else self._name(word)
            else:
                raise ValueError(f"{word!r} is no predicate")
            while True:
                self.out.append((subject, predicate, *self._term()))
                if self._peek() != ",":
                    break
                self._next()
            if self._peek() != ";":
                return
            while self._peek() == ";":
                self._next()
            if self._peek() in (".", "]"):
                return

    def _term(self) -> tuple[str, str]:
        kind, word = self._next()
        if kind == "iri":
            return self._iri(word), "uri"
        if kind == "name":
            return self._name(word), "uri"
        if kind == "string":
            wide = 3 if word[:3] in ('"""', "'''") and len(word) >= 6 else 1
            if self._peek() == "^^":
                self._next()
                if self._term()[1] != "uri":
                    raise ValueError("a literal's type is no IRI")
            elif self._peek().startswith("@"):
                self._next()
            return _plain(word[wide:-wide]), "lit"
        if kind == "number" or (kind == "word" and word in ("true", "false")):
            return word, "lit"
        if word == "[":
            node = self._new()
            if self._peek() != "]":
                self._predicates(node)
            self._expect("]")
            return node, "uri"
        if word == "(":
            items = []
            while self._peek() != ")":
                items.append(self._term())
            self._next()
            nodes = [self._new() for _ in items]
            for node, item, rest in zip(nodes, items, [*nodes[1:], RDF + "nil"], strict=True):
                self.out += [(node, RDF + "first", *item), (node, RDF + "rest", rest, "uri")]
            return (nodes[0] if nodes else RDF + "nil"), "uri"
        raise ValueError(f"{word!r} is no term")


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, str]]:
    """(file, split, ...) and line, in order."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(width)]
        for *key, line in zip(*columns, batch.column(width).to_pylist(), strict=True):
            yield tuple(key), line


def _split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[list] = []
    for key, line in _runs(batches, 2):
        if not done or tuple(done[-1][:2]) != key:
            done.append([*key, 0, 1, 2, 0, 0, 0])
        own = done[-1]
        known = {state: scan(line, state) for state in set(own[2:5])}
        for i in range(3):
            state, ends = known[own[2 + i]]
            own[2 + i], own[5 + i] = state, own[5 + i] + len(ends)
    names = ["file", "split", "to0", "to1", "to2", "ends0", "ends1", "ends2"]
    types = [pa.string(), pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 3]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)


def _strung(rows: pd.DataFrame) -> pd.DataFrame:
    """The state and the number of statements before each split of a file."""
    state, before, out = 0, 0, []
    for row in rows.sort_values("split").itertuples():
        out.append((row.file, row.split, state, before))
        before += getattr(row, f"ends{state}")
        state = getattr(row, f"to{state}")
    return pd.DataFrame(out, columns=["file", "split", "state", "before"])


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements and pieces of them: file, n, split, whole, text."""
    out: list[tuple] = []
    own, state, n, text, begun = None, 0, 0, [], False
    names, types = ["file", "n", "split", "whole", "text"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def leave() -> None:
        if own and any(map(str.strip, text)):
            out.append((own[0], n, own[1], False, "\n".join(text)))

    for (file, split, first, before), line in _runs(batches, 4):
        if (file, split) != own:
            leave()
            own, state, n, text, begun = (file, split), first, before, [], False
        state, ends = scan(line, state)
        at = 0
        for end in ends:
            text.append(line[at:end])
            # What ends first in a split may have begun in the one before it.
            out.append((file, n, split, begun, "\n".join(text)))
            n, text, at, begun = n + 1, [], end, True
        text.append(line[at:])
        if len(out) >= 4096:
            yield batch_of(out)
            out = []
    leave()
    yield batch_of(out)


def turtle_statements(spark: SparkSession, path: str) -> DataFrame:
    """file, n (the statement's place in its file, from 0), text; blank ends of files are none."""
    make_importable(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    states = lines.mapInArrow(_split_states, "file string, split long, to0 int, to1 int, to2 int, ends0 long, ends1 long, ends2 long")
    begins = cut(states.groupBy("file").applyInPandas(_strung, "file string, split long, state int, before long"))
    numbered = lines.withColumn("at", F.monotonically_increasing_id())
    if begins.count() <= MOST_BROADCAST_SPLITS:
        joined = numbered.join(F.broadcast(begins), ["file", "split"], "left")
    else:
        joined = numbered.join(begins.hint("shuffle_merge"), ["file", "split"], "left").repartition("file", "split").sortWithinPartitions("file", "split", "at")
    known = F.when(F.col("state").isNull(), F.raise_error(F.lit("the splits changed between the two passes"))).otherwise(F.col("state"))
    pieces = joined.select("file", "split", known.alias("state"), "before", "value").mapInArrow(_cut_lines, "file string, n long, split long, whole boolean, text string")
    pieces = cut(pieces)
    joined = pieces.where("not whole").groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return pieces.where("whole").select("file", "n", "text").unionByName(joined)


def _declared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Declarations (file, n, nth, name, iri) of the statements; a relative base or prefix is resolved with its own statement only."""
    out = []
    for batch in batches:
        for file, n, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            try:
                found = _Statement(text, {}, "").declared
            except ValueError:
                found = _leading(text)
            out += [(file, n, nth, *pair) for nth, pair in enumerate(found)]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["file", "n", "nth", "name", "iri"])


def _leading(text: str) -> list[tuple[str, str]]:
    """Declarations without a dot that stand before a statement which uses other prefixes."""
    out, tokens = [], []
    try:
        tokens = _tokens(text)
    except ValueError:
        return out
    while tokens and tokens[0][0] == "word" and tokens[0][1].lower() in ("prefix", "base"):
        width = 3 if tokens[0][1].lower() == "prefix" else 2
        if len(tokens) < width or tokens[width - 1][0] != "iri":
            break
        out.append((tokens[1][1] if width == 3 else "base", _plain(tokens[width - 1][1][1:-1])))
        tokens = tokens[width:]
    return out


class _Scope:
    """The names in force at each statement of a file."""

    def __init__(self, declared: list):
        self.after, self.names = [], [{}]
        for n, _, name, iri in declared:
            self.after.append(n)
            base = self.names[-1].get("base")
            self.names.append({**self.names[-1], name: iri if _SCHEME.match(iri) or base is None else urljoin(base, iri)})

    def at(self, n: int) -> dict[str, str]:
        return dict(self.names[bisect_left(self.after, n)])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    names = ["file", "n", "s", "p", "o", "o_kind", "error"]
    scopes: dict[str, _Scope] = {}
    for batch in batches:
        out: list[tuple] = []
        for file, n, text, declared in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if declared not in scopes:
                scopes[declared] = _Scope(json.loads(declared or "[]"))
            try:
                made = _Statement(text, scopes[declared].at(n), f"{crc32(file.encode()):08x}..{n}").out
                out += [(file, n, *triple, None) for triple in made]
            except (ValueError, RecursionError) as error:
                out.append((file, n, None, None, None, None, str(error)[:200] or "nested too deep"))
        types = [pa.string(), pa.int64(), *[pa.string()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def parse_turtle(spark: SparkSession, path: str) -> DataFrame:
    """file, n, s, p, o, o_kind, error: a row for each triple, and one with only an error for each broken statement.

    Blank nodes are ``_:<file>.<label>``, those without a label numbered by statement; language and type marks are dropped.
    A carriage return before a line end is lost inside long literals.
    """
    statements = turtle_statements(spark, path)
    some = statements.where(F.col("text").rlike(r"(?i)^(?:\s|#[^\n]*\n)*+@?(?:prefix|base)\b"))
    declared = some.mapInArrow(_declared, "file string, n long, nth int, name string, iri string")
    scope = declared.groupBy("file").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", "nth", "name", "iri"))), lambda x: F.array(x["n"].cast("string"), x["nth"].cast("string"), x["name"], x["iri"]))).alias("declared"))
    scope = cut(scope.withColumn("declared", F.regexp_replace("declared", r'\["(\d+)","(\d+)",', "[$1,$2,")))
    rows = statements.join(F.broadcast(scope) if scope.count() <= 1024 else scope, "file", "left")
    return rows.select("file", "n", "text", "declared").mapInArrow(_parsed, "file string, n long, s string, p string, o string, o_kind string, error string")


def read_turtle(spark: SparkSession, path: str, kg: int) -> DataFrame:
    """The distinct triples of Turtle files; statements that can't be read are left out, see ``broken_statements``."""
    rows = parse_turtle(spark, path).where("error is null")
    return rows.select(F.lit(kg).alias("kg"), "s", "p", "o", "o_kind").distinct()


def broken_statements(spark: SparkSession, path: str) -> DataFrame:
    """file, n, error of the statements that can't be read."""
    return parse_turtle(spark, path).where("error is not null").select("file", "n", "error")


def turtle_lines(triples: DataFrame, prefixes: dict[str, str], parts: int = 8) -> DataFrame:
    """Lines of Turtle, one statement a triple, behind the prefixes: every part of the rows begins with them, so however the
    lines are written into files in the order of (part, at, value), each file can be read for itself."""
    def short(c):
        out = F.concat(F.lit("<"), c, F.lit(">"))
        for name, iri in prefixes.items():
            local = F.substring(c, len(iri) + 1, 1 << 20)
            out = F.when(c.startswith(iri) & local.rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(f"{name}:"), local)).otherwise(out)
        return F.when(c.startswith("_:"), c).otherwise(out)

    escaped = F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = F.replace(escaped, F.lit("\r"), F.lit("\\r"))
    quotes = F.when(F.col("o").contains("\n"), '"""').otherwise('"')
    obj = F.when(F.col("o_kind") == "uri", short(F.col("o"))).otherwise(F.concat(quotes, escaped, quotes))
    body = triples.select(F.pmod(F.xxhash64("s"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("at"), F.concat(short(F.col("s")), F.lit(" "), short(F.col("p")), F.lit(" "), obj, F.lit(" .")).alias("value"))
    head = "\n".join(f"@prefix {name}: <{iri}> ." for name, iri in prefixes.items())
    heads = triples.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("at"), F.lit(head).alias("value"))
    return heads.unionByName(body)


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str], parts: int = 8) -> None:
    rows = turtle_lines(triples, prefixes, parts).repartition("part").sortWithinPartitions("part", "at", "value")
    rows.select("value").write.mode("overwrite").text(path)
