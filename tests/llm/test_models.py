import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.llm import audio_features as A
from twinweave.llm import components, language_kernel, order_minhash, pu_quality, url_templates
from twinweave.llm.queries import QUERIES
from twinweave.plans import joins

from .conftest import corpus


# Audio


def resample_by_definition(x, up, down):
    """Zero-stuffing, one long filter, decimation."""
    phases = A._filters(up, down)
    taps = phases.shape[1]
    out = []
    for m in range(-(-len(x) * up // down)):
        first, phase = divmod(m * down, up)
        total = 0.0
        for k in range(taps):
            i = first + k - taps // 2
            total += phases[phase, taps - 1 - k] * (x[i] if 0 <= i < len(x) else 0)
        out.append(total)
    return np.array(out)


def test_resampling():
    x = np.random.default_rng(1).normal(size=500).astype(np.float32)
    for source, target in ((24000, 16000), (48000, 16000), (16000, 24000), (8000, 8000)):
        got = A.resample(x, source, target)
        if source == target:
            assert got is x
            continue
        g = np.gcd(source, target)
        assert np.allclose(got, resample_by_definition(x, target // g, source // g), atol=1e-5)
    t = np.arange(24000) / 24000
    tone = A.resample(np.sin(2 * np.pi * 1000 * t).astype(np.float32))
    assert np.abs(np.fft.rfft(tone[4000:12000])).argmax() * 16000 / 8000 == 1000


def test_segments_and_frames():
    energy = np.array([0, 0, 10, 5.2, 5.2, 0, 0, 9, 9, 0.0])
    assert [(round(a * 100), round(b * 100)) for a, b in A.segments(energy)] == [(2, 5), (7, 9)]
    mels, energy = A.log_mel(np.zeros(401, np.float32))
    assert mels.shape == (2, A.MELS) and len(energy) == 2
    chunked = A.CHUNK_FRAMES
    y = np.random.default_rng(2).normal(size=20000).astype(np.float32)
    whole = A.log_mel(y)[0]
    try:
        A.CHUNK_FRAMES = 7
        assert np.allclose(A.log_mel(y)[0], whole, atol=1e-4)
    finally:
        A.CHUNK_FRAMES = chunked


def test_audio_query(spark, sf_dir, docs, odd, empty):
    stored = A.audio_features(A.store_media(docs))
    assert all("audio-features" in f for f in stored.inputFiles())
    rows = stored.withColumn("payload", A.payload(F.col("media"))).collect()
    texts = {r[0]: r[1] or "" for r in corpus()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        pad = -len(data) % 192 if data else 192
        assert r.n_bytes == len(data) and bytes(r.payload) == data + b" " * pad
        assert A.wav_samples(bytes(r.media)) == (A.SOURCE_RATE, bytes(r.payload))
        table = A.read_tensors(bytes(r.tensors))
        mels, energy = A.log_mel(A.resample((np.frombuffer(r.payload, np.uint8).astype(np.float32) - 128) / 128))
        blocks = np.concatenate([np.array(b.as_py()).reshape(A.BLOCK_FRAMES, A.MELS) for b in table.column("log_mel").combine_chunks().storage])
        assert np.allclose(blocks[: r.n_frames], mels, atol=0.02) and len(mels) == r.n_frames
        assert [(s.start_s, s.end_s) for s in r.spans] == A.segments(energy)
        assert table.schema.field("log_mel").type.shape == [A.BLOCK_FRAMES, A.MELS]
        assert table.num_rows == -(-r.n_frames // A.BLOCK_FRAMES)
        assert table.column("start_s").to_pylist() == [i * A.BLOCK_FRAMES * A.HOP / A.RATE for i in range(table.num_rows)]
    by_text = defaultdict(set)
    for r in QUERIES["op1_audio_features"](spark, sf_dir).collect():
        payload = r.payload_sha256
        by_text[payload].add((r.feature, r.media_sha256, r.media_bytes, r.tail_crc32))
        assert r.media_bytes == r.payload_bytes + 44 and r.payload_bytes % 192 == 0
    assert all(len(v) == 1 for v in by_text.values())
    assert A.audio_features(A.store_media(empty)).count() == 0
    assert len({r.media for r in A.audio_features(A.store_media(odd)).where("n_bytes = 0").collect()}) == 1


def test_audio_digests(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op1_audio_features"](spark, sf_dir).collect():
        data = texts[r.doc_id].encode()
        data += b" " * (-len(data) % 192 if data else 192)
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-16:])
        assert r.media_sha256 == hashlib.sha256(A.wav_bytes(data)).hexdigest()


# Quality


def test_pu_risk_recovers_classes():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (4000, 4)), rng.normal(-1, 1, (4000, 4))
    model = pu_quality.fit_pu(good[:1500], np.concatenate([good[1500:3500], bad[:1000]]))
    assert abs(model.prior - 2 / 3) < 0.12
    # Judged where the classes stand two to one, as in the unlabelled rows.
    right = np.concatenate([model.scores(good[3500:]) >= 0.5, model.scores(bad[1000:1250]) < 0.5])
    assert right.mean() > 0.9


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_quality_pu"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.93
    assert sum(r.predicted for r in held if r.quality) / sum(r.quality for r in held) > 0.97


def test_quality_ignores_other_columns_and_held_out_labels(spark, docs, empty, odd):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one = sorted(map(tuple, pu_quality.quality_scores(docs, labels).collect()))
    assert one == sorted(map(tuple, pu_quality.quality_scores(docs.drop("lang", "source", "n_chars"), flipped).collect()))
    assert pu_quality.quality_scores(empty, labels).count() == 0
    none = pu_quality.quality_scores(odd, labels.where("false")).collect()
    assert len(none) == 6 and {r.score for r in none} == {0.5}
    kept = pu_quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in one if r[3]}


# Language


def test_presence_is_the_blended_spectrum():
    def grams(text):
        data = text.lower().encode()
        return {data[i : i + n] for n in range(1, 5) for i in range(len(data) - n + 1)}

    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60))) for _ in range(20)]
    rows = np.zeros((20, language_kernel.SLOTS), np.float32)
    for row, t in zip(rows, texts, strict=True):
        language_kernel.presence(t, row)
    for i in range(20):
        for j in range(20):
            assert abs(rows[i] @ rows[j] - len(grams(texts[i]) & grams(texts[j]))) <= 12
    chunk = language_kernel.CHUNK
    try:
        language_kernel.CHUNK = 16
        again = np.zeros(language_kernel.SLOTS, np.float32)
        language_kernel.presence(texts[0] * 5, again)
    finally:
        language_kernel.CHUNK = chunk
    whole = np.zeros(language_kernel.SLOTS, np.float32)
    language_kernel.presence(texts[0] * 5, whole)
    assert (again == whole).all()


def test_languages_held_out(spark, empty, odd):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op5_language_kernel"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert language_kernel.identify_languages(empty).count() == 0
    got = {r.doc_id: r.lang_pred for r in language_kernel.identify_languages(odd).collect()}
    assert got[None] == "und" and got[5] == "und" and got[1] == "en"


# URLs


def test_urls(spark):
    urls = [None, "no scheme", "HTTP://WWW.Example.NET/en/1?x#y", "http://a.example.net/de/2", "https://b.example.com/de/x", "https://b.example.com/fr/x", "x://org", "x://a.org/fr/9", "x://sorg/fr/", "a://b://c/d", "http://É.NET/", "http://net"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_templates.judge_urls(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fits = [(h + p, v) for h, p, v in url_templates.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[0])
        assert got[i].verdict == (rule[1] or got[i].verdict) and got[i].verdict in ("allow", "block")


def test_templates_generalise_and_reject(spark):
    rows = []
    for i in range(60):
        rows.append((len(rows), "shop.example", f"/item/{i}/view", 0 if i % 2 else None))
        rows.append((len(rows), "shop.example", f"/spam/{i}.html", 1 if i % 2 else None))
        rows.append((len(rows), "blog.example", f"/u{i % 12}/post/{i}", 1 if i % 5 else None))
    pages = spark.createDataFrame(rows, "page_id long, host string, path string, label int")
    got = url_templates.path_templates(pages).collect()
    by = defaultdict(set)
    for r in got:
        by[r.host, r.path.split("/")[1][:1]].add((r.template, round(r.purity, 6)))
    assert by["shop.example", "i"] == {("/item/{number}/view", by["shop.example", "i"].copy().pop()[1])}
    (item,), (spam,) = by["shop.example", "i"], by["shop.example", "s"]
    assert spam[0] == "/spam/{number}" and item[1] < 0.1 and spam[1] > url_templates.REJECT
    assert {t for t, _ in by["blog.example", "u"]} == {"/*/post/{number}"}
    assert len(got) == len(rows)


def tree_by_hand(rows):
    """Template and purity of each (host, path, label), the tree walked host by host and level by level."""
    U = url_templates

    def shaped(segment):
        name = re.sub(r"\.[A-Za-z0-9]{1,5}$", "", segment)
        if re.search("^[0-9]+$", name):
            return "{number}"
        if re.search("^[0-9a-fA-F-]{8,}$", name) and re.search("[0-9]", name):
            return "{hex}"
        return segment.replace("*", "%2A").replace("{", "%7B")

    def smooth(labels, prior):
        return (sum(labels) + U.STRENGTH * prior) / (len(labels) + U.STRENGTH)

    segments = [[shaped(s) for s in path.split("/") if s] for _, path, _ in rows]
    place, purity = [""] * len(rows), [0.0] * len(rows)
    hosts = defaultdict(list)
    for i, (host, _, _) in enumerate(rows):
        hosts[host].append(i)
    known = lambda ids: [rows[i][2] for i in ids if rows[i][2] is not None]
    for ids in hosts.values():
        for i in ids:
            purity[i] = smooth(known(ids), U.PRIOR)
    for level in range(max(map(len, segments), default=0)):
        nodes = defaultdict(lambda: defaultdict(list))
        for i, seg in enumerate(segments):
            if len(seg) > level:
                nodes[rows[i][0], place[i]][seg[level]].append(i)
        merged, template_labels = {}, defaultdict(list)
        for node, branches in nodes.items():
            literals = [i for b, ids in branches.items() if b[0] != "{" for i in ids]
            for b, ids in branches.items():
                rest = [i for i in literals if i not in set(ids)]
                apart = b[0] != "{" and not (rest and similar(ids, rest, segments, level, known))
                name = b if apart or b[0] == "{" else "*"
                merged.setdefault((node, name), [[], apart])[0].extend(ids)
        for (node, name), (ids, _) in merged.items():
            template_labels[node[1] + "/" + name] += known(ids)
        new = {}
        for (node, name), (ids, apart) in merged.items():
            every, own = template_labels[node[1] + "/" + name], known(ids)
            elsewhere = (sum(every) - sum(own) + U.STRENGTH * U.PRIOR) / (len(every) - len(own) + U.STRENGTH)
            prior = (purity[ids[0]] + elsewhere + 2 * U.PRIOR) / 4 if apart else purity[ids[0]]
            for i in ids:
                new[i] = (node[1] + "/" + name, smooth(own, prior))
        for i, (t, p) in new.items():
            place[i], purity[i] = t, p
    return list(zip(place, purity, strict=True))


def similar(ids, rest, segments, level, known):
    def agree(a, n, b, m):
        share = (a + b) / (n + m)
        return abs(a / n - b / m) <= url_templates.Z * (share * (1 - share) * (1 / n + 1 / m)) ** 0.5

    own, other = known(ids), known(rest)
    if bool(own) != bool(other) or own and not agree(sum(own), len(own), sum(other), len(other)):
        return False
    kind = lambda i: "" if len(segments[i]) <= level + 1 else segments[i][level + 1] if segments[i][level + 1][0] == "{" else "word"
    return all(agree(sum(kind(i) == k for i in ids), len(ids), sum(kind(i) == k for i in rest), len(rest)) for k in ("", "{number}", "{hex}", "word"))


def test_tree_against_plain_python(spark):
    """Every template and purity of made hosts, deep paths and literals that look like wildcards among them."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        path = "/" + rng.choice(["a", "b", "c", "*", "{x}", "7", "deadbeef01"])
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            path += "/" + rng.choice(["p", "q", "12", "{number}", "page.html", "99.htm", "0123456789abcdef"])
        label = None if rng.random() < 0.4 else int(rng.random() < (0.9 if path.startswith(("/b", "/*")) else 0.2))
        rows.append((rng.choice(["h1", "h2", "", "h3"]), path if i % 30 else "", label))
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "page_id long, host string, path string, label int, _n string").repartition(3)
    got = {r.page_id: (r.template, r.purity) for r in url_templates.path_templates(df).collect()}
    want = tree_by_hand(rows)
    assert len(got) == len(rows) and all(got[i][0] == t and abs(got[i][1] - p) < 1e-9 for i, (t, p) in enumerate(want))
    assert any(t.count("/") > 5 for t, _ in want) and any("/*" in t for t, _ in want) and any("%2A" in t for t, _ in want)


def test_runs_that_do_not_branch(spark, monkeypatch):
    """Long shared runs on one host and on several, with labels, paths that end on a run, and numbers in it."""
    rng = random.Random(9)
    run = [rng.choice(["x", "y", "77", "{number}", "ab!c", "ab"]) for _ in range(30)]
    rows = [(h, "/deep/" + "/".join(run[:n] + more), rng.choice([0, 1, None])) for h in ("h1", "h2") for n, more in ((30, []), (30, ["p"]), (30, ["q", "1"]), (22, []), (22, ["z"] * 9)) for _ in range(2)]
    rows += [("h3", "/deep/" + "/".join(run[:25] + ["own"] * 12 + [t]), label) for t, label in (("a", 1), ("b", 1), ("c", None), ("a!b", 0))]
    rows += [("h3", "/a/" + "/".join(["k"] * 40), 1), ("h4", "/a", 0), ("h4", "/a!/b/c", 1), ("h4", "/a/b/c", 0)]
    rounds = []
    real = url_templates._descend
    monkeypatch.setattr(url_templates, "_descend", lambda nodes: rounds.append(1) or real(nodes))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, host string, path string, label int")
    got = {r.page_id: (r.template, r.purity) for r in url_templates.path_templates(df).collect()}
    assert all(got[i][0] == t and abs(got[i][1] - p) < 1e-9 for i, (t, p) in enumerate(tree_by_hand(rows)))
    assert len(rounds) <= 12  # of 43 levels


def test_crawler_traps_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = url_templates._descend
    monkeypatch.setattr(url_templates, "_descend", lambda nodes: rounds.append(1) or real(nodes))
    trap = "/loop" * 5000
    urls = ["http://a.com/x/1", "http://a.com/y/2", "http://b.org/fr/3", f"http://t.com{trap}", f"http://t.com{trap}/end", f"http://t.com{trap}/7?q", f"http://a.net{trap[:20]}"]
    got = {r.page_id: r for r in url_templates.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(rounds) <= 5 and got[3].template == trap and got[5].template == trap + "/{number}"
    want = tree_by_hand([(r.host, r.path[:400], {"block": 1, "allow": 0}[r.verdict] if r.rule else None) for r in (got[i] for i in range(3))])
    assert all(got[i].template == t for i, (t, _) in enumerate(want))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_judged_pages_against_plain_python(spark, sf):
    """Every row of the query; the method gives verdicts of both kinds, and no constant purity, where no rule decides."""
    rows = QUERIES["op4_url_templates"](spark, f"/root/testdata/{sf}").collect()
    says = {h + p: int(v == "block") for h, p, v in url_templates.RULES}
    want = tree_by_hand([(r.host, r.path, says.get(r.rule)) for r in rows])
    for r, (template, purity) in zip(rows, want, strict=True):
        assert r.template == template and abs(r.purity - purity) < 1e-9
        assert r.verdict == ("block" if (says[r.rule] if r.rule else r.purity >= url_templates.REJECT) else "allow")
    free = [r for r in rows if not r.rule]
    assert len({round(r.purity, 4) for r in free}) > 5 and sum(r.verdict == "block" for r in free) < 0.2 * len(free)
    assert {r.verdict for r in free} == {"allow", "block"} or sf == "sf0.01"


@pytest.mark.parametrize("sections", [60, 90])
def test_verdicts_do_not_depend_on_the_number_of_sections(spark, sections):
    urls = [f"http://example.com/de/{i}" for i in range(400)] + [f"http://example.com/s{k}/{i}" for k in range(sections) for i in range(2)]
    got = url_templates.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r.verdict for r in got if r.path.startswith("/de/")} == {"block"}
    assert {r.verdict for r in got if r.path.startswith("/s")} == {"allow"}


def test_urls_empty_and_repeated(spark):
    schema = "page_id long, url string, _seg string, purity double"
    assert url_templates.judge_urls(spark.createDataFrame([], schema)).count() == 0
    assert url_templates.judge_urls(spark.createDataFrame([(1, "a://b.net/x", "", 0.0)] * 3, schema)).count() == 3


# Near duplicates


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(9)
    pairs, want = [], []
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randint(0, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 16)):
            kind, at = rng.randrange(3), rng.randrange(len(b) + 1)
            if kind == 0:
                b.insert(at, rng.randrange(30))
            elif b and kind == 1:
                del b[min(at, len(b) - 1)]
            elif b:
                b[min(at, len(b) - 1)] = rng.randrange(30)
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        want.append(edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9)
    assert order_minhash.aligned(pairs) == want and 50 < sum(want) < 290


def test_sketches_see_order():
    rng = random.Random(2)
    ids = np.array([rng.randrange(1 << 60) for _ in range(300)], np.uint64)
    same, moved = order_minhash.order_sketches(ids), order_minhash.order_sketches(np.concatenate([ids[150:], ids[:150]]))
    edited = ids.copy()
    edited[[20, 140, 260]] = 5
    assert (same == order_minhash.order_sketches(ids)).all()
    assert (same == moved).sum() < (same == order_minhash.order_sketches(edited)).sum()
    assert len(order_minhash.order_sketches(ids[:0])) == 0
    assert (order_minhash.order_sketches(ids[:3]) == order_minhash.order_sketches(ids[:3].copy())).all()


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, odd, empty):
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(docs).collect()}
    sets = {i: shingled(t) for i, t, *_ in corpus()}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 5 and all(got[i] == got[j] for i, j in near)
    assert order_minhash.near_duplicate_classes(empty).count() == 0
    rows = order_minhash.near_duplicate_classes(odd).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size or 0) for r in rows) == [(0, 0, 0), (1, 1, 4), (1, 1, 4), (2, 1, 4), (5, 5, 1), (6, 1, 4)]


def test_near_duplicates_against_all_pairs(spark, sf_dir):
    rows = QUERIES["op6_order_minhash"](spark, sf_dir).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in rows}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in docs if (w := (t or "").lower().split())}
    ids = sorted(shingles)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                assert got[i] == got[j]
    words = {i: np.array([hash(w) & 0xFFFFFFFF for w in (t or "").lower().split()], np.uint64) for i, t in docs}
    members = defaultdict(list)
    for i, c in got.items():
        members[c].append(i)
    for c, group in members.items():
        for i in group:
            assert len(group) == 1 or any(i != j and (len(words[i]) == len(words[j]) == 0 or order_minhash.aligned([(words[i], words[j])])[0] or (words[i] == words[j]).all()) for j in group), c


def test_pair_with_one_common_bucket(spark):
    """Texts b and c align and share one bucket only, whose least member is a third text that aligns with neither."""
    rng = random.Random(1)

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"z{rng.randrange(10**6)}"
        return out

    sketches = lambda words: set(order_minhash.order_sketches(order_minhash.word_ids(" ".join(words))).tolist())
    while True:
        base = [f"w{rng.randrange(10**6)}" for _ in range(24)]
        b, c, a = edited(base, 2), edited(base, 2), base[:12] + [f"a{i}" for i in range(60)]
        ids = [order_minhash.word_ids(" ".join(x)) for x in (a, b, c)]
        shared = sketches(b) & sketches(c)
        if len(shared) == 1 and shared <= sketches(a) and order_minhash.aligned([(ids[0], ids[1]), (ids[0], ids[2]), (ids[1], ids[2])]) == [False, False, True]:
            break
    rows = [(i, " ".join(x)) for i, x in enumerate((a, b, c))]
    got = order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(0, 0), (1, 1), (2, 1)]


def classes_by_hand(texts, any_pair):
    """Least index of each text's component, over every pair that aligns, or that shares a cell and aligns."""
    ids = [order_minhash.word_ids(t) for t in texts]
    cells = [set(order_minhash.all_sketches(x).tolist()) for x in ids]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (ids[i].tolist() == ids[j].tolist() or (any_pair or cells[i] & cells[j]) and order_minhash.aligned([(ids[i], ids[j])])[0]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("cell", "block", "few"), [(16, 256, 1 << 14), (1, 256, 0), (0, 8, 0), (0, 16, 1 << 14)])
def test_large_cells_lose_no_link(spark, monkeypatch, cell, block, few):
    """Groups of loose copies, and texts of which a shared passage is a third or nine tenths, against all pairs."""
    monkeypatch.setattr(order_minhash, "CELL", cell)
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    monkeypatch.setattr(order_minhash, "CHUNK", 7)
    monkeypatch.setattr(order_minhash, "FEW", few)
    monkeypatch.setattr(joins, "MOST_BROADCAST", few)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    base, passage = [word() for _ in range(90)], [word() for _ in range(40)]
    texts = []
    for i in range(30):
        copy = list(base)
        for at in rng.sample(range(90), 6 + i % 9):
            copy[at] = word()
        texts.append(copy)
        texts.append([word() for _ in range(80)] + passage)
        texts.append([word() for _ in range(6 + i % 8)] + passage)
        texts.append([*texts[rng.randrange(len(texts))][:-3], word(), word()])
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    least, most = classes_by_hand(texts, False), classes_by_hand(texts, True)
    got = order_minhash.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    got = [r.class_id for r in sorted(got)]
    # No link of a common cell is lost, and what is joined beyond them aligns too.
    assert all(got[i] == got[least[i]] for i in range(len(texts)))
    assert all(most[i] == most[got[i]] for i in range(len(texts)))
    assert 5 < len(set(most)) <= len(set(got)) < 100


@pytest.mark.parametrize(("words", "changed"), [(12, 1), (20, 1), (30, 2), (50, 4), (100, 8), (200, 16)])
def test_recall_of_sketches(words, changed):
    rng = random.Random(words)
    found = 0
    for _ in range(200):
        a = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        b = list(a)
        for at in rng.sample(range(words), changed):
            b[at] = f"z{rng.randrange(10**6)}"
        x, y = (order_minhash.word_ids(" ".join(t)) for t in (a, b))
        assert edit_distance(a, b) <= 0.2 * words and order_minhash.aligned([(x, y)]) == [True]
        found += bool(set(order_minhash.all_sketches(x)) & set(order_minhash.all_sketches(y)))
    assert found >= 0.9 * 200


def test_components_of_chains(spark, monkeypatch):
    steps = []
    real = components._jumped
    monkeypatch.setattr(components, "_jumped", lambda parents: steps.append(1) or real(parents))
    rng = random.Random(3)
    for order in (list(range(1001)), rng.sample(range(1001), 1001)):
        steps.clear()
        edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(2000, 2001), (5, 5)], "a long, b long")
        found = {r.node: r.root for r in components.components(edges).collect()}
        assert len(steps) <= 30 and all(found[i] == 0 for i in order) and found[2001] == 2000
    assert components.components(edges.where("false")).count() == 0


def test_near_copies_under_one_id(spark):
    """Rows that repeat an id with unlike texts don't join their classes; one row of each class stays."""
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    rows = [(1, a, 1), (1, b, 2), (2, a + " z", 3), (3, b + " z", 4), (1, a, 5), (None, a, 6), (None, b, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid int")
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in order_minhash.near_duplicate_classes(docs).collect())
    assert got == Counter({(1, 1, 3): 2, (1, 1, 2): 1, (2, 1, 3): 1, (3, 1, 2): 1, (None, None, None): 2})
    kept = order_minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, a), (0, b), (1, a), (1, b)]


@pytest.mark.parametrize("hot", [40])
def test_hot_group(spark, hot):
    """One group of near copies beside texts that share a passage: one class, and the others stay alone."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(hot):
        copy = list(base)
        copy[rng.randrange(150)] = f"z{i}"
        rows.append((i, " ".join(copy)))
    for i in range(hot, 2 * hot):
        rows.append((i, " ".join([f"q{rng.randrange(10**6)}" for _ in range(60)] + passage)))
    got = order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got if r.doc_id < hot} == {0}
    assert all(r.class_id == r.doc_id for r in got if r.doc_id >= hot)


def test_training_samples_are_bounded_where_ids_repeat(spark):
    """Many languages, one of them with most rows, and an id that repeats with many texts."""
    rows = [(i % 50 if i % 3 else i, f"text {i} of many words", f"l{i % 7}" if i % 4 == 0 else "hot") for i in range(3000)]
    docs = spark.createDataFrame([(i, t, x, None) for i, t, x in rows], "doc_id long, text string, lang string, source string")
    for per_key in (1, 5, 400):
        ids = language_kernel.sample_ids(docs, "lang", per_key)
        per = defaultdict(set)
        for i, _, x in rows:
            per[x].add(i)
        assert len(ids) == sum(min(per_key, len(v)) for v in per.values())
    model = language_kernel.train_languages(docs, F.lit(True), 5)
    assert model.languages == sorted(per) and len(model.landmarks) <= 40 * len(per)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(0, 60)], "doc_id long, quality int, toxic int")
    assert pu_quality.quality_scores(docs, labels, max_positive=10, max_unlabelled=20).count() == 3000


def test_risk_against_its_definition():
    """The fitted model has a lower non-negative risk, computed by its definition, than its neighbours in weight space."""
    rng = np.random.default_rng(4)
    p, u = rng.normal(0.6, 1, (300, 3)).astype(np.float32), rng.normal(0, 1, (600, 3)).astype(np.float32)
    prior = 0.4

    def risk(w, b):
        loss = lambda z: np.log1p(np.exp(-z))
        plus = prior * np.mean([loss(x @ w + b) for x in p])
        minus = np.mean([loss(-(x @ w + b)) for x in u]) - prior * np.mean([loss(-(x @ w + b)) for x in p])
        return plus + max(0.0, minus) + 0.5e-3 * float(w @ w)

    w, b = pu_quality._descend(p, u, prior)
    best = risk(w, b)
    for k in range(3):
        for step in (-0.3, 0.3):
            moved = w.copy()
            moved[k] += step
            assert risk(moved, b) > best - 1e-3
    assert risk(w, b + 0.4) > best and risk(w, b - 0.4) > best and best < risk(w * 0, 0.0)


def test_ridge_against_its_definition():
    """Weights solve the balanced ridge problem in the span of the landmarks."""
    rng = np.random.default_rng(5)
    rows = (rng.random((40, 200)) < 0.2).astype(np.float32)
    labels = [("a", "b", "c")[i % 3] for i in range(40)]
    model = language_kernel.fit_kernel(rows, labels, per_language_landmarks=40, ridge=1e-2)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    kernel = (unit @ unit.T).astype(np.float64)
    weight = np.array([1 / labels.count(x) for x in labels])
    for k, lang in enumerate(model.languages):
        y = np.where(np.array(labels) == lang, 1.0, -1.0)
        # With every row a landmark, the dual solution of weighted kernel ridge regression gives the same scores.
        alpha = np.linalg.solve(kernel + 1e-2 * np.diag(1 / weight), y)
        order = np.concatenate([np.flatnonzero(np.array(labels) == x) for x in model.languages])
        assert np.allclose(unit @ model.landmarks.T @ model.weights[:, k], kernel @ alpha, atol=1e-3) and len(order) == 40
