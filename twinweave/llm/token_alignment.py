"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentence-piece BPE (B) by elementary intervals.

Both tokenizers cover the same bytes. The union of both arrays of token ends parts them into elementary intervals; a
binary search in each array gives the A token and the B token that own an interval, so each interval is one overlap of
two tokens, and no two intervals are the same pair. Where an interval ends at an end of both arrays, a group of tokens
closes, and its two owners end together: that is a link of the kind "end". The kind "overlap" takes every interval, and
"group" expands each group to the product of its A and B tokens.

Texts repeat their words, and neither tokenizer joins characters across a single space between two visible characters, so
a text is the sequence of its space-parted segments, and both tokenizers end a token before each of them. Each worker
keeps a bounded map from segment to alignment and sends only new segments, many at a time, through the tokenizers and the
interval arrays. Vocabularies for which that isn't so (see ``by_segment``) get each text as one segment.

Corpus-wide counts of id pairs are summed from each document's distinct pairs; documents then learn the counts of their
pairs by a join, broadcast only if the counted table is small enough, else with its hot pairs salted.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm._common import lookup_join, make_importable, materialise, text_or_empty
from twinweave.llm.token_store import pieces_of

KINDS = ("end", "overlap", "group")
_MAX_SEGMENTS = 400_000
#: Segments that are aligned together.
_NEW = 1 << 15
_PARTS = re.compile(r"(?<=\S) (?=\S)")
#: A word and closing marks, which the byte-level pre-tokenizer parts where the marks begin.
_PLAIN = re.compile("([A-Za-z]+)([.,;:!?]*)")
#: Texts that show whether vocabularies part segments as this module takes for granted.
_PROBES = ("Hello, world! It's 2024.", " two  spaces\tand\na line ", "naïve Été—über (x_y) #tag a1b2 don't", "word. (word) [word]; x=1,234.5%", "日本語 текст 𝒳 é   ß", "ALLCAPS camelCase x  'quoted' \"double\" <|endoftext|> </s> end")
_aligners: dict[tuple[str, str, str], Aligner] = {}


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(others)}


def elementary(a_ends, b_ends):
    """Ends of the elementary intervals, and for each the A and the B token that owns it; ends are ascending and distinct."""
    import numpy as np

    edges = np.union1d(a_ends, b_ends)
    return edges, np.searchsorted(a_ends, edges), np.searchsorted(b_ends, edges)


class Aligner(dict):
    """A map from segment to (A tokens, B tokens, groups, links, groups as text, linked id pairs); None if its bytes differ.

    A pair is the A id times 2**32 plus the B id; pairs are little-endian 64-bit words.
    """

    def __init__(self, path_a: str, path_b: str, kind: str = "end"):
        super().__init__()
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.kind = kind
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_of()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(alphabet.__getitem__, piece)) if all(c in alphabet for c in piece) else piece.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.model, self.by_word, self.by_segment = self.a.model, False, True
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        joined = any("▁" in piece.lstrip("▁") for piece in pieces)
        words = sorted({w for text in _PROBES for w in text.split()} | {"word", "words,", "Word.", "ab!?", "END.,"})
        slow = self.a_ids(words)
        self.by_word = True
        self.by_word = self.a_ids(words) == slow
        self.by_segment = not joined and all(self._whole(t) == self._joined(t) for t in _PROBES)

    def a_ids(self, segments: list[str]) -> list[list[int]]:
        """A's ids of a space and each segment."""
        plain = [_PLAIN.fullmatch(s) if self.by_word else None for s in segments]
        slow = iter(self.a.encode_batch_fast([" " + s for s, m in zip(segments, plain, strict=True) if not m], add_special_tokens=False))
        word = lambda x: [t.id for t in self.model.tokenize(x)] if x else []
        return [word("Ġ" + m[1]) + word(m[2]) if m else next(slow).ids for m in plain]

    def _whole(self, text: str) -> tuple:
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)

    def _joined(self, text: str) -> tuple:
        parts = self.parts(text)
        return tuple([i for part in side for i in part] for side in (self.a_ids(parts), self.b.encode(parts, num_threads=1)))

    def parts(self, text: str) -> list[str]:
        """Segments of a text: all but single spaces between visible characters stays inside them."""
        return _PARTS.split(text) if self.by_segment else [text]

    def learn(self, segments: list[str]) -> None:
        """Align new segments, _NEW at a time."""
        for first in range(0, len(segments), _NEW):
            some = segments[first : first + _NEW]
            a, b = self.a_ids(some), self.b.encode(some, num_threads=1)
            bytes_of = [b" " + s.encode() for s in some]
            same = [b"".join(map(self.a_bytes.__getitem__, x)) == want == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, want in zip(a, b, bytes_of, strict=True)]
            self.update((s, None) for s, ok in zip(some, same, strict=True) if not ok)
            good = [k for k, ok in enumerate(same) if ok]
            if good:
                self._align([some[k] for k in good], [a[k] for k in good], [b[k] for k in good])

    def _align(self, segments: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        import numpy as np

        flat_a, flat_b = (np.fromiter((i for x in side for i in x), np.int64) for side in (a, b))
        a_ends, b_ends = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        edges, ia, ib = elementary(a_ends, b_ends)
        closes = (a_ends[ia] == edges) & (b_ends[ib] == edges)
        # The last A and B token of each group, and of each segment the number of groups and of links.
        last_a, last_b = ia[closes], ib[closes]
        if self.kind == "end":
            left, right = last_a, last_b
        elif self.kind == "overlap":
            left, right = ia, ib
        else:
            n_a, n_b = (np.diff(np.concatenate([[-1], x])) for x in (last_a, last_b))
            size = n_a * n_b
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            left = np.repeat(last_a - n_a + 1, size) + within // np.repeat(n_b, size)
            right = np.repeat(last_b - n_b + 1, size) + within % np.repeat(n_b, size)
        pairs = (flat_a[left] << np.int64(32)) | flat_b[right]
        stops = np.cumsum([len(x) for x in a])  # of the segments, in A tokens
        groups_to = np.searchsorted(last_a, stops - 1, side="right").tolist()
        links_to = np.searchsorted(left, stops - 1, side="right").tolist()
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        done_a = done_b = 0
        spelled = []
        for to_a, to_b in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            spelled.append(",".join(text_a[done_a:to_a]) + "|" + ",".join(text_b[done_b:to_b]))
            done_a, done_b = to_a, to_b
        group = link = 0
        for segment, x, y, to_group, to_link in zip(segments, a, b, groups_to, links_to, strict=True):
            self[segment] = (len(x), len(y), to_group - group, to_link - link, ";".join(spelled[group:to_group]), pairs[link:to_link].astype("<i8").tobytes())
            group, link = to_group, to_link

    def align(self, texts: Iterable[str]) -> Iterator[tuple]:
        """For each text: A tokens, B tokens, groups, links, groups as text, id pairs of the links; zeros and blanks if it is
        empty or its bytes differ."""
        none = (0, 0, 0, 0, "", b"")
        split = []
        for text in texts:
            parts = text.split(" ") if self.by_segment else [text]
            if self.by_segment and any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
                parts = self.parts(text)
            split.append(parts if text else [])
        if len(self) > _MAX_SEGMENTS:
            self.clear()
        new = list(dict.fromkeys(p for parts in split for p in parts if p not in self))
        self.learn(new)
        for parts in split:
            found = [self[p] for p in parts]
            if not found or None in found:
                yield none
                continue
            n_a, n_b, groups, links, spelled, pairs = zip(*found, strict=True)
            yield sum(n_a), sum(n_b), sum(groups), sum(links), ";".join(spelled), b"".join(pairs)


def aligner(path_a: str, path_b: str, kind: str) -> Aligner:
    """This process's aligner of two vocabulary files."""
    key = (path_a, path_b, kind)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


ALIGNED = "uid long, doc long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def _aligned(path_a: str, path_b: str, kind: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["uid", "doc", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
        types = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in batches:
            for rows in pieces_of(batch, column=2):
                out: list[list] = [[] for _ in names[2:]]
                for *counts, groups, pairs in aligner(path_a, path_b, kind).align(rows.column(2).to_pylist()):
                    distinct, times = np.unique(np.frombuffer(pairs, "<i8"), return_counts=True)
                    if digest and groups:
                        groups = hashlib.sha256(groups.encode()).hexdigest()
                    for column, value in zip(out, (*counts, groups, distinct, times.astype(np.int32)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *[pa.array(v, t) for v, t in zip(out, types[2:], strict=True)]], names)

    return run


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, total, held, best): links and documents that hold an id pair, and whether no pair of its B id has more links.

    Stored. A B id has at most as many pairs as A has ids.
    """
    held = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = materialise(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("held")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("most"))
    ranked = counts.withColumn("b_id", b_id).join(most, "b_id")
    return materialise(ranked.select("pair", "total", "held", (F.col("total") == F.col("most")).alias("best")), "pair-ranks")


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None, kind: str = "end", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A encodes a space and the text, B the text, to which it adds a space itself; special tokens' strings are plain text.
    ``kind`` chooses the links (see KINDS). n_best counts the links whose id pair has the most links in the corpus among
    the pairs of its B id, ties included; count_sum adds up the corpus-wide counts of the links' pairs. ``groups`` spells the
    groups as ``a1,a2|b1;a3|b2,b3``, or with ``digest`` their SHA-256 in lowercase hex. Texts that are null or empty or whose joined
    bytes of A or B tokens are not the space and the text have no tokens: zeros and ''. Whole texts are read, however
    long. Rows that repeat, and null ids, count each for itself; other columns are not read; an empty table gives an empty table.
    """
    if kind not in KINDS:
        raise ValueError(f"links are one of {KINDS}")
    make_importable(docs.sparkSession)
    path_a, path_b = vocabularies or default_vocabularies()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    aligned = materialise(rows.mapInArrow(_aligned(path_a, path_b, kind, digest), ALIGNED), "aligned")
    ranks = pair_counts(aligned)
    held = aligned.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    known = lookup_join(held, ranks, "pair", "held", "uid")
    sums = known.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum"))
    found = aligned.drop("pairs", "times").join(sums, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(F.col("doc").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
