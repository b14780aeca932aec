"""Near-duplicate detection with Order MinHash.

A text is its lower-cased words; k-mers are five words in a row, labelled by occurrence. Each of SKETCHES hash functions
samples the ORDER least labelled k-mers and hashes them in text order, so a sketch agrees only where the same k-mers come
in the same order. One changed word spoils most k-mers of a short text, so short texts are sketched on shorter k-mers as
well (SHORT). A sketch value is a cell. Texts of one cell are candidates, and a pair is linked when a banded alignment of
the words gives an edit similarity of at least 0.8. Classes are connected components of the links.

Every pair of different texts that shares a cell is settled, but not by listing all pairs of a large cell:

* cells of at most CELL texts give all their pairs;
* the members of larger cells are aligned with the cell's least member (one for each CHUNK of members), which joins the
  bulk of a group of near copies; what follows looks only at pairs of different components;
* large cells with at most CELL such pairs a member give them all;
* texts of the cells still left are keyed by their rarest word pairs. At similarity 0.8 two texts have 0.6 n - 1 of n - 1
  word pairs in common, so of the other 0.4 n + 1 rarest ones they share at least one; a passage in many texts has no rare
  pairs. The same rule as for cells then says which keys give all their pairs;
* texts that hold frequent word pairs even among those, because over 60 % of them stands in many texts, are compared
  in blocks whose only output is links: a matrix product bounds the words in common, and pairs that a link already joins
  are skipped. Where the cells left hold at most FEW texts in all, blocks come at once: both ways find every link of a common cell,
  and up to there blocks are the cheaper one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm._common import hot_keys, lookup_join, make_importable, materialise, private, salted_join, text_or_empty
from twinweave.llm.components import components

K, ORDER, SKETCHES = 5, 2, 24
#: Shorter k-mers, and the most words of a text that is sketched on them too.
SHORT = ((3, 48), (2, 12))
SIMILARITY = 0.8
#: Texts of fewer words have no other text within the similarity.
LEAST_WORDS = 4
CELL, CHUNK, BLOCK, FEW = 16, 4096, 512, 1 << 14
_MAX_WORDS = 400_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


_hashes = _Hashes()


def word_ids(text: str):
    """64-bit hashes of the lower-cased words of a text."""
    import numpy as np

    if len(_hashes) > _MAX_WORDS:
        _hashes.clear()
    words = text.lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def order_sketches(ids, k: int = K, order: int = ORDER, sketches: int = SKETCHES, family: int = 0):
    """One 64-bit value a hash function; none for a text without words. Texts of fewer than k words are one k-mer."""
    import numpy as np

    if not len(ids):
        return np.zeros(0, np.int64)
    k = min(k, len(ids))
    n = len(ids) - k + 1
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    grams = _mix(grams)
    sort = np.argsort(grams, kind="stable")
    new = np.concatenate([[True], grams[sort][1:] != grams[sort][:-1]])
    at = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[sort] = at - np.maximum.accumulate(np.where(new, at, 0))
    labelled = _mix(grams + occurrence * np.uint64(0xD6E8FEB86659FD93))
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(family))
    take = min(order, n)
    out = np.zeros(sketches, np.uint64)
    step = max(1, (1 << 20) // n)
    for first in range(0, sketches, step):
        ranks = _mix(labelled[None, :] ^ seeds[first : first + step, None])
        rows = np.arange(len(ranks))
        least = np.empty((len(ranks), take), np.int64)
        for i in range(take):
            least[:, i] = ranks.argmin(axis=1)
            ranks[rows, least[:, i]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        chosen = grams[np.sort(least, axis=1)]
        value = np.zeros(len(ranks), np.uint64)
        for i in range(take):
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
        out[first : first + step] = value ^ seeds[first : first + step]
    return out.view(np.int64)


def all_sketches(ids):
    """The sketches of every family that a text of so many words has."""
    import numpy as np

    if len(ids) < LEAST_WORDS:
        return np.zeros(0, np.int64)
    found = [order_sketches(ids)]
    for family, (k, most) in enumerate(SHORT, 1):
        if len(ids) <= most:
            found.append(order_sketches(ids, k, family=family))
    return np.concatenate(found)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import numpy as np

    from twinweave.llm.token_store import pieces_of

    for batch in batches:
        for rows in pieces_of(batch, column=2):
            sizes, keys, texts, values = [], [], [], []
            for text in rows.column(2):
                ids = word_ids(text.as_py())
                sizes.append(len(ids))
                keys.append(hashlib.blake2b(ids.tobytes(), digest_size=16).digest())
                texts.append(ids.astype(np.uint32).tobytes())
                values.append(all_sketches(ids))
            arrays = [rows.column(0), rows.column(1), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(texts, pa.binary()), pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc", "words", "sequence", "ids", "cells"])


SIGNED = "uid long, doc long, words int, sequence binary, ids binary, cells array<long>"


def _common(a, b) -> int:
    """Size of the common multiset."""
    import numpy as np

    words, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    return int(np.minimum(np.bincount(which[: len(a)], minlength=len(words)), np.bincount(which[len(a) :], minlength=len(words))).sum())


def _strip(a, b):
    """Without the common prefix and suffix."""
    import numpy as np

    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    front = int(differ[0]) if len(differ) else n
    a, b, n = a[front:], b[front:], n - front
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    back = int(differ[0]) if len(differ) else n
    return a[: len(a) - back], b[: len(b) - back]


def _band(pairs: list, width: int) -> list[int]:
    """Edit distances over paths at most ``width`` off the diagonal, for pairs of word-id arrays, row by row together."""
    import numpy as np

    p, n, m = len(pairs), max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    big = np.int32(1 << 29)
    left = np.zeros((p, n), pairs[0][0].dtype)
    right = np.zeros((p, n + 2 * width + 1 + max(0, m - n)), left.dtype)
    real = np.zeros(right.shape, bool)
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = a
        right[i, width : width + len(b)] = b
        real[i, width : width + len(b)] = True
    span = 2 * width + 1
    k = np.arange(span, dtype=np.int32)
    row = np.broadcast_to(np.where(k >= width, k - width, big), (p, span)).astype(np.int32)
    ends: dict[int, list[int]] = {}
    for i, (a, _) in enumerate(pairs):
        ends.setdefault(len(a), []).append(i)
    out = [int(big)] * p
    for i in ends.get(0, []):
        out[i] = len(pairs[i][1])
    for r in range(1, n + 1):
        new = row + ((left[:, r - 1, None] != right[:, r - 1 : r - 1 + span]) | ~real[:, r - 1 : r - 1 + span])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        if r <= width:
            new[:, : width - r] = big
            new[:, width - r] = r
        row = np.minimum.accumulate(new - k, axis=1) + k
        for i in ends.get(r, []):
            at = len(pairs[i][1]) - r + width
            if 0 <= at < span:
                out[i] = int(row[i, at])
    return out


def aligned(pairs: list, similarity: float = SIMILARITY) -> list[bool]:
    """Whether each pair of word-id arrays has an edit distance of at most (1 - similarity) times the longer length.

    Bounds that are exact come first: the lengths, and the words not in common. Then the band widens until a path within
    the limit is found, or the band covers every such path.
    """
    out = [False] * len(pairs)
    waiting = []
    for i, (a, b) in enumerate(pairs):
        longest = max(len(a), len(b))
        limit = int((1 - similarity) * longest + 1e-9)
        if abs(len(a) - len(b)) > limit or longest - _common(a, b) > limit:
            continue
        a, b = _strip(a, b)
        if max(len(a), len(b)) <= limit:
            out[i] = True
        else:
            waiting.append((i, a, b, limit))
    width_of = {i: min(limit, max(8, 2 * abs(len(a) - len(b)))) for i, a, b, limit in waiting}
    while waiting:
        waiting.sort(key=lambda x: (width_of[x[0]], len(x[1])))
        later, at = [], 0
        while at < len(waiting):
            width = width_of[waiting[at][0]]
            most = max(1, (1 << 18) // (2 * width + 1))
            part = [waiting[at]]
            for x in waiting[at + 1 : at + most]:
                if width_of[x[0]] > 2 * width or len(x[1]) > 2 * len(part[0][1]) + 64:
                    break
                part.append(x)
            at += len(part)
            width = max(width_of[x[0]] for x in part)
            for x, distance in zip(part, _band([(a, b) for _, a, b, _ in part], width), strict=True):
                if distance <= x[3]:
                    out[x[0]] = True
                elif width < x[3]:
                    later.append(x)
                    width_of[x[0]] = min(x[3], 4 * width)
        waiting = later
    return out


VERIFY_PAIRS = 512


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ids_a, ids_b) to the linked (a, b)."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, VERIFY_PAIRS):
            rows = batch.slice(at, VERIFY_PAIRS)
            sides = [[np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column(c)] for c in (2, 3)]
            keep = pa.array(aligned(list(zip(*sides, strict=True))), pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(keep), rows.column(1).filter(keep)], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (node, ids) align."""
    needed = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("n", F.lit(1)), "needed")
    texts = materialise(lookup_join(texts, needed, "node", "n", "node").drop("n"), "texts")
    with_b = pairs.join(texts.toDF("b", "ids_b"), "b")
    both = with_b.join(texts.toDF("a", "ids_a"), "a").select("a", "b", "ids_a", "ids_b")
    return materialise(both.mapInArrow(_verify, "a long, b long"), "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b from x, y and their numbers of words, without those whose lengths differ too much."""
    fits = pairs.where(F.least("x_words", "y_words") >= F.greatest("x_words", "y_words") * SIMILARITY)
    return fits.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the root of each node's component; a node without links is its own."""
    return rows.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (key, node, words, root): the pairs of different roots of keys that have few of them, and the other keys' rows.

    A key is dense when it has over CELL such pairs a member. In one that isn't, the members outside the largest root are
    few (below 64), so they alone are paired with all members.
    """
    rows = materialise(rows, "keyed")
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    cells = parts.groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("same"), F.max(F.struct("m", "root"))["root"].alias("main"))
    cells = cells.where("n * n > same").withColumn("dense", F.expr(f"(n * n - same) / 2 > {CELL} * n"))
    cells = materialise(cells.drop("same"), "cells")
    hot = hot_keys(cells, "key", "n", cells.agg(F.sum("n")).first()[0] or 0)
    open_rows = materialise(lookup_join(rows, cells, "key", "n", "node"), "open")
    few = open_rows.where("not dense and root <> main").select("key", F.col("node").alias("x"), F.col("words").alias("x_words"), F.col("root").alias("x_root"))
    every = open_rows.where("not dense").select("key", F.col("node").alias("y"), F.col("words").alias("y_words"), F.col("root").alias("y_root"))
    met = salted_join(every, few, "key", hot, "y").where("x_root <> y_root")
    return _ordered(met), open_rows.where("dense").select("key", "node", "words", "root")


def _word_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ids) to (node, hashes of its word pairs labelled by occurrence)."""
    import numpy as np

    for batch in batches:
        out = []
        for text in batch.column(1):
            ids = np.frombuffer(text.as_buffer(), np.uint32).astype(np.uint64)
            pairs = _mix((ids[:-1] << np.uint64(32)) + ids[1:])
            sort = np.argsort(pairs, kind="stable")
            at = np.arange(len(pairs))
            new = np.concatenate([[True], pairs[sort][1:] != pairs[sort][:-1]])[: len(pairs)]
            nth = np.empty(len(pairs), np.uint64)
            nth[sort] = at - np.maximum.accumulate(np.where(new, at, 0))
            out.append(_mix(pairs + nth * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["node", "pairs"])


def _rare_pair_keys(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, node, words, root) for the word pairs of each node that a linked node must share one of: its rarest."""
    found = nodes.join(texts, "node").select("node", "ids").mapInArrow(_word_pairs, "node long, pairs array<long>")
    held = materialise(found.select("node", F.explode("pairs").alias("key")), "word-pairs")
    often = materialise(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "pair-counts")
    shared = lookup_join(held, often, "key", "n", "node")
    # Pairs of one text only come first in the order and make no key, so their number is all that counts.
    ranked = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("known"))
    ranked = nodes.join(ranked, "node")
    take = F.expr("words - 1 - greatest(1, cast(ceil(0.6 * words - 1 - 1e-9) as int)) + 1") - (F.col("words") - 1 - F.size("known"))
    keyed = ranked.where(take > 0).select("node", "words", "root", F.explode(F.slice("known", 1, F.greatest(F.lit(1), take))).alias("kept"))
    return keyed.select("kept.key", "node", "words", "root")


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the blocks i and j of a group: every pair of different roots is bounded, then aligned until joined."""
    import numpy as np

    nodes, roots, block = (table.column(c).to_numpy() for c in ("node", "root", "block"))
    ids = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("ids")]
    size = np.array([len(x) for x in ids])
    counts = np.zeros((len(ids), 8192), np.float32)
    for row, x in zip(counts, ids, strict=True):
        row[:] = np.sqrt(np.bincount((x * np.uint32(2654435761)) >> np.uint32(19), minlength=8192))
    left = np.flatnonzero(block == table.column("i")[0].as_py())
    right = np.flatnonzero(block == table.column("j")[0].as_py())
    # Words in common: at most the sum over slots of the smaller counts, at most that of the products of their roots.
    common = counts[left] @ counts[right].T
    longest = np.maximum(size[left][:, None], size[right][None, :])
    open_ = (common >= SIMILARITY * longest - 1e-3) & (roots[left][:, None] != roots[right][None, :])
    if left[0] == right[0]:
        open_ = np.triu(open_)
    top: dict[int, int] = {}

    def find(r: int) -> int:
        while r in top:
            r = top[r]
        return r

    todo = sorted(zip(*np.nonzero(open_), strict=True), key=lambda p: -common[p] / longest[p])
    a, b = [], []
    while todo:
        tried: dict[tuple[int, int], int] = {}
        now, later = [], []
        for p in todo:
            x, y = find(int(roots[left[p[0]]])), find(int(roots[right[p[1]]]))
            if x == y:
                continue
            pair = (min(x, y), max(x, y))
            tried[pair] = tried.get(pair, 0) + 1
            (now if tried[pair] <= 8 and len(now) < 2048 else later).append(p)
        for p, linked in zip(now, aligned([(ids[left[i]], ids[right[j]]) for i, j in now]), strict=True):
            if linked:
                a.append(int(nodes[left[p[0]]]))
                b.append(int(nodes[right[p[1]]]))
                x, y = find(int(roots[left[p[0]]])), find(int(roots[right[p[1]]]))
                if x != y:
                    top[max(x, y)] = min(x, y)
        todo = later
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _dense_links(keyed: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """All links between nodes of different components that share one of the dense keys, block by block."""
    least = materialise(keyed.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "dense-keys")
    edges = lookup_join(keyed.select("key", "node"), least, "key", "n", "node")
    groups = components(edges.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()).toDF("node", "group")
    groups = materialise(_rooted(groups, found), "dense-nodes")
    sizes = materialise(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "dense-groups")
    dealt = lookup_join(groups, sizes, "group", "n", "node")
    dealt = dealt.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    met = dealt.join(texts, "node").select("group", "i", "j", "block", "node", "root", "ids")
    return materialise(met.groupBy("group", "i", "j").applyInArrow(_block_links, "a long, b long"), "links")


def _classes(rows: DataFrame) -> DataFrame:
    """uid, doc, root for the rows (uid, doc, text); rows whose doc is null are left out. Roots are uids."""
    make_importable(rows.sparkSession)
    signed = materialise(rows.where("doc is not null").select("uid", "doc", "text").mapInArrow(_signatures, SIGNED), "signatures")
    heads = materialise(signed.groupBy("sequence").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("n")), "sequences")
    members = lookup_join(signed.select("uid", "doc", "sequence"), heads, "sequence", "n", "uid").select("uid", "doc", "node")
    texts = signed.select(F.col("uid").alias("node"), "ids")
    # A head is the first row of its sequence; rows of the others are no nodes.
    one = heads.select("node", F.lit(1).alias("n"))
    cells = lookup_join(signed.select(F.col("uid").alias("node"), "words", "cells"), one, "node", "n", "node")
    cells = materialise(cells.select("node", "words", F.explode("cells").alias("key")), "cells")
    sizes = materialise(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1"), "cell-sizes")
    shared = materialise(lookup_join(cells, sizes, "key", "n", "node"), "shared-cells")
    small, large = shared.where(F.col("n") <= CELL), shared.where(F.col("n") > CELL)
    x = small.select("key", F.col("node").alias("x"), F.col("words").alias("x_words"))
    y = small.select("key", F.col("node").alias("y"), F.col("words").alias("y_words"))
    near = _ordered(x.join(y, "key").where("x < y"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK))
    large = large.withColumn("part", part)
    large = large.withColumn("part", part).withColumn("chunk", F.xxhash64("key", "part"))
    firsts = large.groupBy("chunk").agg(F.min(F.struct("node", "words")).alias("first"), F.min("least").alias("least"), F.count(F.lit(1)).alias("m"))
    firsts = materialise(firsts.select("chunk", F.col("first.node").alias("x"), F.col("first.words").alias("x_words"), F.col("least").alias("top"), "m"), "firsts")
    members_of = lookup_join(large.select("chunk", F.col("node").alias("y"), F.col("words").alias("y_words")), firsts, "chunk", "m", "y")
    tops = firsts.select(F.least("x", "top").alias("a"), F.greatest("x", "top").alias("b"))
    stars = _ordered(members_of).unionByName(tops).where("a <> b")
    pairs = materialise(near.unionByName(stars).distinct(), "pairs")
    links = _links(pairs, texts)
    found = materialise(components(links), "components")
    more, dense = _settle(_rooted(large.select("key", "node", "words"), found))
    nodes = materialise(dense.select("node", "words", "root").distinct(), "dense-cells")
    if nodes.count() > FEW:
        rare, dense = _settle(_rare_pair_keys(nodes, texts))
        more = more.unionByName(rare).distinct()
    more = materialise(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = links.unionByName(_links(more, texts))
        found = materialise(components(links), "components")
    if not dense.isEmpty():
        last = _dense_links(dense, texts, found)
        if not last.isEmpty():
            found = materialise(components(links.unionByName(last)), "components")
    return members.join(found, "node", "left").select("uid", "doc", F.coalesce("root", "node").alias("root"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (the least id of its class), class_size (rows).

    Null texts count as empty, and texts without words are equal to each other. Texts are read whole, however long. Rows
    with a null id are not compared and have a null class of size null. Rows that repeat an id are each their own row, so
    unlike texts under one id stay in different classes. Other columns are not read; an empty table gives an empty table.
    """
    rows = _numbered(docs, id_col, text_col)
    classed = materialise(_classes(rows), "classes")
    sizes = materialise(classed.groupBy("root").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "class-sizes")
    known = lookup_join(classed, sizes, "root", "class_size", "uid").select("doc", "class_id", "class_size")
    lost = rows.where("doc is null").select("doc", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("class_size"))
    return known.unionByName(lost).withColumnRenamed("doc", id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each class, and all rows with a null id.

    The row with the least id of a class stays; of rows that repeat that id, one. Rows that repeat an id with unlike texts
    are classes of their own. Null texts count as empty; extra columns may have any names; an empty table stays empty.
    """
    (uid,) = private(docs, "uid")
    rows = materialise(docs.withColumn(uid, F.monotonically_increasing_id()), "near-rows")
    known = rows.select(F.col(uid).alias("uid"), F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    first = _classes(known).groupBy("root").agg(F.min(F.struct("doc", "uid"))["uid"].alias(uid))
    stay = rows.where(F.col(id_col).isNotNull()).join(first.select(uid), uid, "left_semi")
    return stay.unionByName(rows.where(F.col(id_col).isNull())).drop(uid)
