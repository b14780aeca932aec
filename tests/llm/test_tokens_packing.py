import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from twinweave.llm import packing, token_store
from twinweave.llm.queries import QUERIES
from twinweave.llm.tokens import WordEncoder, default_vocabulary

from .conftest import corpus


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


ENCODER = WordEncoder(default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abE'st., \n\t\r\x0b\x1c\x85́İß<|>éÉ12  𝒳"), st.characters(codec="utf-8")), max_size=40))
def test_word_encoder_is_exact(text):
    for t in (text, f"x<|endoftext|>.{text}<|STARTOFTEXT|>, don't."):
        assert ENCODER.encode([t], 7)[0] == ids_of(ENCODER.tokenizer, t, 7).tobytes()


def test_other_vocabularies_are_encoded_whole(tmp_path):
    """A vocabulary that keeps spaces in its words would differ word by word."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    other = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(letters)}, merges=[]))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.save(str(tmp_path / "other.json"))
    made = WordEncoder(str(tmp_path / "other.json"))
    assert not made.by_word and ENCODER.by_word
    for t in ("a b  c\nd", "", "don't stop"):
        assert made.encode([t], 3)[0] == ids_of(made.tokenizer, t, 3).tobytes()


def test_store(docs, tokenizer):
    got = sorted(map(tuple, token_store.store_digests(docs).collect()))
    start, expected = 0, []
    for i, t, *_ in sorted(corpus()):
        ids = ids_of(tokenizer, t, 2)
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected


def test_store_round_trip_and_layout(spark, docs, tokenizer, tmp_path):
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/store"
    token_store.write_tokens(docs, path)
    rows = token_store.read_tokens(spark, path).orderBy("start").collect()
    texts = {r[0]: r[1] for r in corpus()}
    assert [r.doc_id for r in rows] == sorted(texts)
    assert all(list(r.tokens) == ids_of(tokenizer, texts[r.doc_id], 2).tolist() for r in rows)
    meta = pq.ParquetFile(next((tmp_path / "store").glob("part-*"))).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    assert any("DELTA" in e for e in columns["doc_id"].encodings)
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


def check_packing(rows, tokenizer, texts, capacity=2048):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = ids_of(tokenizer, t, 0)
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, a, min(capacity, len(ids) - a)) for k, a in enumerate(range(0, len(ids), capacity))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // capacity) + 1
    return len(bins)


def test_packing_of_documents(spark, sf_dir, docs, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_packing(QUERIES["op2_pack_swap_search"](spark, sf_dir).collect(), tokenizer, texts)
    check_packing(packing.packed_digests(docs).collect(), tokenizer, {r[0]: r[1] for r in corpus()})


def best_fit_by_hand(lengths, capacity):
    """Best fit decreasing, piece by piece."""
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, space in enumerate(free) if space >= x]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= x
        else:
            free.append(capacity - x)
    return len(free)


def draws(seed):
    """Lengths of up to 200 of several shapes: some that best fit packs well, some that it doesn't, and some that repeat."""
    rng = random.Random(seed)
    kind = seed % 5
    return [(rng.randint(1, 199), rng.randint(36, 104), min(199, int(rng.lognormvariate(3.5, 1)) + 1), rng.choice([67, 68, 99, 101]), rng.choice([30, 41, 55, 70]))[kind] for _ in range(300)]


def held(found):
    out = Counter()
    for pattern, n in found.items():
        for x, k in pattern:
            out[x] += k * n
    return out


@pytest.mark.parametrize("seed", range(20))
def test_packing_by_counts(seed):
    """The start is best fit decreasing; the search never ends above it and keeps every piece."""
    lengths = draws(seed)
    counts = Counter(lengths)
    start, end = packing.best_fit_decreasing(counts, 200), packing.pack_counts(counts, 200)
    assert sum(start.values()) == best_fit_by_hand(lengths, 200) >= sum(end.values()) >= packing.least_bins(counts, 200)
    for found in (start, end):
        assert held(found) == counts and all(sum(x * k for x, k in p) <= 200 and n > 0 for p, n in found.items())
    assert end == packing.pack_counts(counts, 200)


def test_search_empties_bins():
    better = sum(sum(packing.best_fit_decreasing(Counter(draws(s)), 200).values()) - sum(packing.pack_counts(Counter(draws(s)), 200).values()) for s in range(1, 100, 5))
    assert better >= 20


def test_counts_do_not_cost_pieces():
    """A million times the pieces make the same patterns, in about as many steps."""
    counts = Counter(draws(1))
    more = {x: n * 1_000_000 for x, n in counts.items()}
    search = packing._Search(packing.best_fit_decreasing(more, 200), 200)
    start = search.live
    search.run(packing.least_bins(more, 200))
    assert search.live < start and search.steps < 20_000 and held(search.packing()) == more


def test_each_step_grows_squared_fill(monkeypatch):
    """Moves, one-for-one and two-for-one exchanges all happen, and each makes the sum of squared fills larger."""
    rng = random.Random(8)
    start = {((rng.randint(30, 48), 1), (rng.randint(18, 26), 1 + i % 2)): 1 + i % 3 for i in range(60)}
    start |= {((rng.randint(18, 52), 1),): 1 for _ in range(60)}
    search = packing._Search(start, 100)
    squares = lambda: sum(n * sum(x * k for x, k in p) ** 2 for p, n in search.packing().items())
    real, kinds, last = search._apply, set(), [squares()]

    def apply(donor, target, out, back):
        real(donor, target, out, back)
        kinds.add(len(back))
        assert squares() > last[0] and all(sum(x * k for x, k in p) <= 100 for p in search.packing())
        last[0] = squares()

    monkeypatch.setattr(search, "_apply", apply)
    counts = held(search.packing())
    search.run(0)
    assert kinds == {0, 1, 2} and held(search.packing()) == counts
    assert all(not search._step(i) for i in range(len(search.patterns)) if search.bins[i] and search.fill[i] < 100)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_documents_need_the_least_sequences(spark, sf):
    """Whole tables come to the number that their lengths allow, and lie in them without gaps."""
    pieces = packing.token_pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).select("row_id", "piece", "length").cache()
    counts = Counter({r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()})
    got = packing.pack_pieces(pieces).join(pieces, ["row_id", "piece"]).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(x for _, x in parts[:k]) for k in range(len(parts))] and sum(x for _, x in parts) <= 2048
    assert len(got) == sum(counts.values())
    short = Counter({x: n for x, n in counts.items() if x < 2048})
    assert len(bins) - counts[2048] == packing.least_bins(short, 2048)


def test_pieces_that_nothing_can_join(spark):
    pieces = spark.createDataFrame([(i, 0, 1500 + i % 7) for i in range(300)], "row_id long, piece int, length long")
    got = packing.pack_pieces(pieces).collect()
    assert len({r.sequence_id for r in got}) == 300 and {r.offset for r in got} == {0}
    whole = packing.pack_pieces(spark.createDataFrame([(i, 0, 2048) for i in range(5)], "row_id long, piece int, length long")).collect()
    assert len({r.sequence_id for r in whole}) == 5


def test_repeated_ids_with_other_texts(spark, tokenizer):
    rows = [(1, "a b c"), (1, "d e"), (None, "f"), (None, "g h " * 3000), (1, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = sorted(len(ids_of(tokenizer, t, 0)) for _, t in rows)
    whole = defaultdict(int)
    for r in packing.pack_documents(docs).collect():
        assert len(r.ids) == 4 * r.length
        whole[r.doc_id] += r.length
    assert sorted(whole.values()) == sorted([sum(len(ids_of(tokenizer, t, 0)) for i, t in rows if i == key) for key in (1, None)]) and sum(sizes) == sum(whole.values())
    stored = token_store.store_digests(docs).orderBy("start").collect()
    assert [r.doc_id for r in stored] == [None, None, 1, 1, 1]
    assert [r.start for r in stored] == [sum(x.n_tokens for x in stored[:k]) for k in range(5)]


@pytest.mark.parametrize("hot", [None, 5])
def test_store_splits_an_id_on_many_rows(spark, tokenizer, hot):
    """A third of all rows has one id, some of them one text: they lie in several ranges, and starts stay gapless."""
    rows = [(hot if i % 3 == 0 else 100 + i, "same text" if i % 6 == 0 else f"word{i} " * (i % 4)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    from twinweave.llm._common import new_path

    path = new_path(spark, "tokens-test")
    token_store.write_tokens(docs, path)
    assert spark.read.parquet(path).where(F.col("doc_id").eqNullSafe(F.lit(hot))).select("part").distinct().count() > 1
    stored = token_store.store_digests(docs).orderBy("start").collect()
    assert [r.start for r in stored] == [sum(x.n_tokens for x in stored[:k]) for k in range(600)]
    assert [r.doc_id if r.doc_id is not None else -1 for r in stored] == sorted(-1 if i is None else i for i, _ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in stored) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows for x in [ids_of(tokenizer, t, 2)])


def test_odd_rows(odd, empty, tokenizer):
    assert packing.packed_digests(empty).count() == 0 and token_store.store_digests(empty).count() == 0
    rows = packing.packed_digests(odd).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == [-1, 1, 1, 2, 5, 6]
    assert token_store.store_digests(odd).count() == 6
