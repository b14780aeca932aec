"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less have a value z between them, and the radius splits into 1 + 2: every fingerprint
emits its variants with at most one bit flipped, and those with an even number of ones also their variants with two. That
is enough. At an odd distance exactly one of the two is even, and a z lies within two flips of that one and one flip of
the other; at distance 2 a z lies one flip from both. And it is exact: whoever is at most two flips from a z is within
three of whoever is at most one flip from it, so all the fingerprints that meet at a z which one of them reaches by at
most one flip are linked to the least of those. No pairs are listed; each link is still checked.

The shuffle is on variants, but not with a row for each. All variants of a fingerprint that agree in their first ``bits``
bits go to one task, so the fingerprint is sent there once, and the task flips the other bits. Where a prefix gets more
than PREFIX_ROWS fingerprints, its rows are dealt by further bits, until every group is that small; at the full 64 bits
a group holds at most 2,081 fingerprints, so large clusters of near copies split like all else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm._common import lookup_join, make_importable, materialise, text_or_empty
from twinweave.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Bits by which a prefix grows, and the most fingerprints of a group that isn't split further.
STEP, PREFIX_ROWS = 8, 1 << 15
#: Variants that a task holds at a time, and hashes of a long text.
VARIANTS, HASHES = 1 << 20, 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text in UTF-8; 0 for a text without words."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: lower-cases A-Z only and parts at 20 and 09-0D only
    if not words:
        return 0
    k = min(shingle, len(words))
    joined, n = b" ".join(words), len(words) - k + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = np.concatenate([[0], ends[:-1]])[:n].tolist(), (ends[k - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for first in range(0, n, HASHES):
        part = zip(starts[first : first + HASHES], stops[first : first + HASHES], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            values = np.array([fingerprint(x.as_buffer().to_pybytes(), shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc, fp (the fingerprint's bits as a long) for each row; null texts count as empty, whole texts are read."""
    make_importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc long, fp long")


def _flips(bits: int, most: int) -> list[int]:
    """All words of ``bits`` bits with at most ``most`` ones."""
    import itertools

    return [sum(1 << i for i in chosen) for n in range(most + 1) for chosen in itertools.combinations(range(bits), n)]


def _long(bits: int) -> Column:
    """64 bits as a long."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _reach(fp: Column) -> Column:
    """Flips that the variants of a fingerprint may have: two where its number of ones is even, else one."""
    return F.when(F.bit_count(fp) % 2 == 0, 2).otherwise(1)


def _dealt(rows: DataFrame, depth: int) -> DataFrame:
    """(fp, key) of prefixes of ``depth`` bits to those of STEP bits more: one row for each prefix of the variants.

    ``key`` holds the variants' first bits, its other bits are zero.
    """
    below = 64 - depth - STEP
    spent = F.bit_count(F.col("fp").bitwiseXOR(F.col("key")).bitwiseAND(_long(((1 << depth) - 1) << (64 - depth))))
    masks = [F.array(*[_long(m << below) for m in _flips(STEP, n)]) for n in range(3)]
    left = _reach(F.col("fp")) - spent
    some = F.when(left == 2, masks[2]).when(left == 1, masks[1]).otherwise(masks[0])
    kept = F.col("key").bitwiseOR(F.col("fp").bitwiseAND(_long(((1 << STEP) - 1) << below)))
    return rows.select("fp", F.explode(some).alias("mask"), kept.alias("key")).select("fp", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))


def _meet(table: pa.Table) -> pa.Table:
    """Links (a, b) of the fingerprints whose variants meet below one prefix.

    Variants with at most one flip are sorted; where several fingerprints or a variant with two flips share one, all are
    linked to the least fingerprint that reaches it by at most one. Variants with two flips are only looked up.
    """
    import numpy as np

    depth = table.column("depth")[0].as_py()
    key = np.uint64(table.column("key")[0].as_py() & ((1 << 64) - 1))
    fp = np.unique(table.column("fp").to_numpy().view(np.uint64))
    below = 64 - depth
    low = np.uint64((1 << below) - 1) if below else np.uint64(0)
    spent = np.bitwise_count((fp ^ key) & ~low).astype(np.int64)
    base = (fp & low) | key
    masks = np.array(_flips(below, 1), np.uint64)
    near = spent <= 1
    z = np.concatenate([base[near], (base[spent == 0][:, None] ^ masks[None, 1:]).ravel()])
    owner = np.concatenate([fp[near], np.repeat(fp[spent == 0], len(masks) - 1)])
    links = [np.zeros((0, 2), np.uint64)]
    if len(z):
        sort = np.lexsort((owner, z))
        z, owner = z[sort], owner[sort]
        new = np.concatenate([[True], z[1:] != z[:-1]])
        least = owner[np.maximum.accumulate(np.where(new, np.arange(len(z)), 0))]
        links.append(np.stack([least, owner], axis=1)[~new])
        z, least = z[new], owner[new]
        # A table of bits, of which z sets few, tells most variants apart from all z before they are looked up.
        size = max(10, int(len(z)).bit_length() + 5)
        seen = np.zeros(1 << size, bool)
        spread = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size)
        seen[spread(z)] = True
        even = np.bitwise_count(fp) % 2 == 0
        for used in (0, 1, 2):
            some, own = base[even & (spent == used)], fp[even & (spent == used)]
            two = np.array([m for m in _flips(below, 2 - used) if m.bit_count() == 2 - used], np.uint64)
            step = max(1, VARIANTS // max(1, len(some)))
            for first in range(0, len(two), step) if len(some) else ():
                far = (some[:, None] ^ two[None, first : first + step]).ravel()
                at = np.flatnonzero(seen[spread(far)])
                place = np.minimum(np.searchsorted(z, far[at]), len(z) - 1)
                hit = z[place] == far[at]
                links.append(np.stack([least[place[hit]], own[at[hit] // two[first : first + step].size]], axis=1))
    found = np.concatenate(links)
    a, b = np.minimum(found[:, 0], found[:, 1]), np.maximum(found[:, 0], found[:, 1])
    found = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
    return pa.table({"a": found[:, 0].view(np.int64), "b": found[:, 1].view(np.int64)})


def near_fingerprints(values: DataFrame, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints of the column ``fp`` at distance 3 or less: not all pairs, but enough
    that whatever a chain of such pairs joins, a chain of links joins."""
    make_importable(values.sparkSession)
    rows, depth, ready = _dealt(values.select("fp", F.lit(0).cast("long").alias("key")), 0), STEP, None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = materialise(sizes.where(F.col("n") > (prefix_rows if depth < 64 else 1 << 62)).select("key"), "large-prefixes")
        done = large.isEmpty()
        small = rows if done else rows.join(large, "key", "left_anti")
        small = small.select("fp", "key", F.lit(depth).alias("depth"))
        ready = small if ready is None else ready.unionByName(small)
        if done:
            break
        rows, depth = _dealt(materialise(rows.join(large, "key", "left_semi"), "split-prefixes"), depth), depth + STEP
    met = ready.groupBy("depth", "key").applyInArrow(_meet, "a long, b long")
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id (the least id of its component).

    Null texts count as empty, and texts without words have the fingerprint zero, which links like any other. Null ids are
    rows of their own and never name a component, unless it has no other id: then it is null. Rows that repeat an id or a
    text are in one component if their fingerprints are. Other columns are not read; an empty table gives an empty table.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    values = materialise(rows.groupBy("fp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(materialise(near_fingerprints(values, prefix_rows), "near-fingerprints"))
    rooted = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "rooted-fingerprints")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps")), "component-ids")
    named = materialise(lookup_join(rooted.select("fp", "n", "root"), least, "root", "fps", "fp").select("fp", "n", "component_id"), "named-fingerprints")
    found = lookup_join(rows, named, "fp", "n", "doc")
    return found.select(F.col("doc").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
