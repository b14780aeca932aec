import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.parity import compare, duck
from twinweave.llm import hard_negatives, simhash, token_alignment
from twinweave.llm.queries import ORACLES, QUERIES

FPS = "fp long"


def hash_by_hand(text):
    """The fingerprint, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids_and_fps, radius=3):
    """(id, fp) to the least id of each component, over all pairs."""
    fps = sorted({fp for _, fp in ids_and_fps})
    top = {fp: fp for fp in fps}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in itertools.combinations(fps, 2):
        if (x ^ y).bit_count() <= radius:
            top[find(x)] = find(y)
    least = {}
    for i, fp in ids_and_fps:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return {fp: least.get(find(fp)) for fp in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("prefix_rows", [150, 1 << 15])
def test_ball_hashing(spark, prefix_rows):
    """Clusters of fingerprints in which everything is within a few bits, however deep their prefixes split."""
    rng = random.Random(3)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    values = {0, (1 << 64) - 1}
    for centre in [rng.getrandbits(64) for _ in range(40)]:
        values |= {flip(centre, rng.randint(0, 6)) for _ in range(12)}
    centre = rng.getrandbits(64)
    values |= {centre} | {flip(centre, rng.choice([1, 2, 3, 4, 8])) for _ in range(300)}
    pairs = [(rng.getrandbits(64), n) for n in (1, 2, 3, 4) for _ in range(25)]
    values |= {y for x, n in pairs for y in (x, flip(x, n))}
    values = sorted(values)
    table = spark.createDataFrame([(signed(x),) for x in values], FPS).repartition(4)
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_fingerprints(table, prefix_rows).collect()]
    assert len(links) == len(set(links)) and all(0 < (a ^ b).bit_count() <= 3 for a, b in links)
    top = {x: x for x in values}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        top[find(a)] = find(b)
    want = least_reachable([(i, x) for i, x in enumerate(values)])
    groups = Counter(find(x) for x in values)
    assert {frozenset(x for x in values if find(x) == r) for r in groups} == {frozenset(g) for g in _groups(want)}


def _groups(named):
    out = {}
    for x, name in named.items():
        out.setdefault(name, set()).add(x)
    return out.values()


def test_fingerprints_of_odd_texts():
    texts = ["", " \t\n ", "One", "one two", "A b C", "a b c d e f g", "x\x1cy z\x85 w é É 𝒳", "word " * 5000, "Éa\x0bB\x0c c\rd", "a b c a b c a b c"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == hash_by_hand(t), t
    assert simhash.fingerprint(b"") == 0


def test_simhash_of_documents(spark, sf_dir, docs, odd, empty):
    for rows in (spark.read.parquet(f"{sf_dir}/documents.parquet"), docs, odd):
        held = [(r.doc_id, hash_by_hand(r.text)) for r in rows.collect()]
        want = least_reachable(held)
        got = simhash.simhash_components(rows).collect()
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{fp:016x}", want[fp]) for i, fp in held)
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.simhash_components(empty).columns == ["doc_id", "fingerprint", "component_id"]
    assert QUERIES["op13_simhash_balls"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def negatives_by_hand(rows, is_anchor, positives=5, negatives=3):
    good = []
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v):
            good.append((i, n, label, [int(256 * x // 1) for x in v]))
    out = []
    for i, n, label, v in good:
        if not is_anchor(i):
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w)), j, m, other) for j, m, other, w in good if m != n)
        for rank, (p, pi, _, _) in enumerate([x for x in others if x[3] == label][:positives], 1):
            fits = [x for x in others if x[3] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:negatives]
            out += [(i, pi, rank, k, ni, -p, -s) for k, (s, ni, _, _) in enumerate(fits, 1)]
    return sorted(out)


NAMES = ["anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score"]
VECTORS = "vec_id long, embedding array<float>, label int, uid int, anchor string, score int"


def test_hard_negatives_by_hand(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        v = [rng.gauss(0, 0.3) if k % 3 else round(rng.random(), 1) for k in range(6)]
        rows.append((i, v, rng.choice([0, 0, 1, 2])))
    rows[3] = (3, None, 1)
    rows[4] = (4, rows[4][1], None)
    rows[5] = (5, [None, *rows[5][1][1:]], 0)
    rows[6] = (6, [float("nan"), *rows[6][1][1:]], 0)
    rows[7] = (7, [float("-inf"), *rows[7][1][1:]], 0)
    rows[8] = (None, rows[8][1], 0)
    rows[9] = (9, [], 0)
    rows[10] = (10, rows[10][1][:3], 1)
    rows[20] = (20, rows[20][1], 9)  # an anchor without positives
    rows += [(401, rows[30][1], 1), (402, rows[30][1], 0), (403, rows[30][1], 2)]  # ties
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(5)
    want = negatives_by_hand(rows, lambda i: i % 10 == 0)
    for sizes in ({}, {"LEAST_ROWS": 16, "MOST_ROWS": 64, "ANCHORS": 7, "SCORES": 100}):
        for name, value in sizes.items():
            monkeypatch.setattr(hard_negatives, name, value)
        got = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 10 == 0)
        assert got.columns == NAMES
        assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert hard_negatives.mine_hard_negatives(table.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_integer_scores_are_exact():
    for scale in (1, 1 << 20, 1 << 28, 1 << 40, 1 << 53):
        left = np.array([[1, -3, scale], [scale, scale, scale - 1]], np.float64)
        right = np.array([[scale, 7, -scale + 3], [5, 0, 2]], np.float64)
        want = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in right] for a in left]
        most = hard_negatives.MOST_SCORE
        assert hard_negatives.integer_scores(left, right).tolist() == [[max(-most, min(most, x)) for x in r] for r in want]


def test_hard_negatives_of_repeated_rows(spark):
    """Rows that repeat an id are other rows: they are each other's positives, and each is an anchor."""
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (2, [0.75, 0.5], 2), (3, [0.7, 0.0], 2)]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    got = sorted(map(tuple, hard_negatives.mine_hard_negatives(table, F.col("vec_id") == 0).collect()))
    p, s2, s3 = 256 * 256, 256 * 192, 256 * 179
    assert got == sorted([(0, 0, 1, 1, 2, p, s2), (0, 0, 1, 2, 3, p, s3)] * 2)


def test_hard_negatives_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(spark, duck(sf), QUERIES["op12_hard_negatives"], ORACLES["op12_hard_negatives"], sf) == ""


def tokenizers_by_hand():
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = token_alignment.default_vocabularies()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    alphabet = token_alignment._byte_of()

    def run(text):
        """(A ids with bytes, B ids with bytes), or nothing where the bytes differ."""
        want = b" " + text.encode()
        left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        same = text and b"".join(x for _, x in left) == want == b"".join(x for _, x in right)
        return (left, right) if same else ([], [])

    return run


def aligned_by_hand(left, right):
    """Groups as text, and the id pairs of the links of each kind."""

    def spans(side):
        at, out = 0, []
        for i, x in side:
            out.append((at, at + len(x), i))
            at += len(x)
        return out

    a, b = spans(left), spans(right)
    cuts = [0, *sorted({e for _, e, _ in a} & {e for _, e, _ in b})]
    inside = lambda side, lo, hi: [i for s, e, i in side if lo <= s and e <= hi]
    groups = [(inside(a, lo, hi), inside(b, lo, hi)) for lo, hi in itertools.pairwise(cuts)]
    text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return text, {
        "end": [(i, j) for _, e, i in a for _, f, j in b if e == f],
        "overlap": [(i, j) for s, e, i in a for t, f, j in b if max(s, t) < min(e, f)],
        "group": [(i, j) for x, y in groups for i in x for j in y],
    }


HOSTILE = [None, "", " ", "  ", "a", " a", "a ", "a  b", "don't stop", "tab\tnew\nline\r\n x", "▁ real lower block", "<|endoftext|> </s> <s> <unk> <0x0A>", "naïve Été — über", "日本語 の 文字 한국어", "𝒳 é   nb   em", "x\x00y \x1c z \x85 w", "1234567 12,345.67%", "ﬁ Ａ ①", "word. (word) [word]; 'quoted' \"double\" ab!? END.,", "    def f(x):\n        return x\n", "🙂🙂 👩‍👩‍👧 end", "it's  'll 've I'M", "supercalifragilistic " * 30]


@pytest.fixture(scope="module")
def by_hand():
    run = tokenizers_by_hand()
    return lambda text: run(text or "")


@pytest.mark.parametrize("kind", token_alignment.KINDS)
def test_token_alignment(spark, by_hand, kind):
    """Counts and groups of hostile texts against whole-text encoding and byte offsets."""
    rows = list(enumerate([*HOSTILE, "a  b", "a", "word words word, words."]))
    want = {i: (*map(len, by_hand(t)), *aligned_by_hand(*by_hand(t))) for i, t in rows}
    pairs = Counter(p for w in want.values() for p in w[3][kind])
    best = {}
    for (_, j), n in pairs.items():
        best[j] = max(n, best.get(j, 0))
    got = token_alignment.align_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), kind=kind)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    for r in got.collect():
        n_a, n_b, text, links = want[r.doc_id]
        own = links[kind]
        assert (r.n_a, r.n_b, r.groups, r.n_links) == (n_a, n_b, text, len(own)), rows[r.doc_id]
        assert r.n_groups == (text.count(";") + 1 if text else 0)
        assert (r.n_best, r.count_sum) == (sum(pairs[p] == best[p[1]] for p in own), sum(pairs[p] for p in own)), rows[r.doc_id]


def test_token_alignment_of_documents(spark, sf_dir, by_hand, docs, odd, empty):
    got = QUERIES["op11_token_alignment"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        left, right = by_hand(texts[r.doc_id])
        assert (r.n_a, r.n_b) == (len(left), len(right))
        if len(left) < 500:
            text, links = aligned_by_hand(left, right)
            assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "") and r.n_links == len(links["end"])
    assert token_alignment.align_tokens(docs).count() == docs.count()
    again = token_alignment.align_tokens(odd).collect()
    assert len(again) == 6 and len({(r.n_a, r.n_links, r.groups) for r in again if r.doc_id == 1}) == 1
    assert token_alignment.align_tokens(empty).count() == 0


def test_segments_are_exact(by_hand):
    """Random strings of hostile characters: segments give the ids of the whole text."""
    rng = random.Random(1)
    letters = "ab Zz  é\n\t'.,;!?s▁<>0x1 ́日🙂-_()"
    aligner = token_alignment.Aligner(*token_alignment.default_vocabularies())
    assert aligner.by_segment and aligner.by_word
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    for text, (n_a, n_b, *_rest) in zip(texts, aligner.align(texts), strict=True):
        left, right = by_hand(text)
        assert (n_a, n_b) == (len(left), len(right)), text
    whole = token_alignment.Aligner(*token_alignment.default_vocabularies())
    whole.by_segment = False
    assert list(whole.align(texts)) == list(aligner.align(texts))
