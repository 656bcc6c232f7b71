"""The training-data operators against brute force, on edge cases and on the test tables."""

import base64
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.llm import chat, jaccard, language, licenses, mixing, packing, quality, sharding, topk, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, size long, n string, label string, path string, ids string, shard int"
LONG = "very long text of words " * 20_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0, 1, 2, "n", "l", "p", "i", 3) for i, t, lang, src in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def edge():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None, "en", "a"), (1, "", None, None), (2, " \n\t ", "en", "a"), (3, "One", "de", "b"), (4, "one", "de", "b"), (5, "two words", None, "b"), (6, LONG, "en", None), (6, LONG, "en", None), (None, "no id here at all", "en", "a")]
    base = [rng.choice(vocab) for _ in range(120)]
    for k in range(40):  # near copies around the threshold
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        rows.append((10 + k, " ".join(copy), "en", "a"))
    for k in range(60):
        n = rng.choice([3, 8, 9, 10, 11, 12, 20, 60])
        if k % 3:
            t = rows[-1][1].split(" ")
            rows.append((100 + k, " ".join(t + [rng.choice(vocab)] if k % 2 else t[:-1] or t), "fr", "c"))
        else:
            rows.append((100 + k, " ".join(rng.choice(vocab) for _ in range(n)), "fr", "c"))
    return rows


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(root(i)) if r[0] is not None else None) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("group", [2048, 3])
def test_jaccard(spark, edge, group, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", group)
    got = sorted((tuple(r) for r in jaccard.ngram_jaccard(docs(spark, edge)).drop("text_hash").collect()), key=repr)
    assert got == brute_components(edge)
    assert len({c for _, _, c in got}) < len(got)


@pytest.mark.parametrize(("n", "num", "den", "group"), [(5, 80, 100, 2048), (5, 80, 100, 3), (2, 1, 2, 3)])
def test_jaccard_of_other_shingles_and_thresholds(spark, edge, n, num, den, group, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", group)
    rows = [r for r in edge if r[0] is not None]
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set() for w in (words((t or "").lower()) for _, t, *_ in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {x: min(r[0] for r, y in zip(rows, label, strict=True) if x == y) for x in label}
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard(docs(spark, rows), n, num, den).collect())
    assert got == Counter((r[0], len(s), least[x]) for r, s, x in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (1, 2)])
def test_sets_that_link_share_a_key_and_have_near_sketches(num, den):
    rng = np.random.default_rng(9)
    for n in [*range(3, 60), 100, 333, 900, 4000]:
        for _ in range(6 if n < 60 else 3):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            differ = int(2 * n * (den - num) / (den + num))
            gone = rng.integers(0, differ + 1)
            b = np.concatenate((a[gone:], rng.integers(0, 2**63, rng.integers(0, differ - gone + 1), dtype=np.uint64)))
            a, b = np.unique(a), np.unique(b)
            same = len(np.intersect1d(a, b))
            width = min(len(jaccard.parity_sketch(x)) for x in (a, b))
            apart = np.bitwise_count(jaccard.fold(jaccard.parity_sketch(a), width) ^ jaccard.fold(jaccard.parity_sketch(b), width)).sum()
            assert apart <= len(a) + len(b) - 2 * same
            if den * same >= num * (len(a) + len(b) - same) and not np.array_equal(a, b):
                assert len(np.intersect1d(jaccard.segment_keys(a, num, den), jaccard.segment_keys(b, num, den)))


def test_unrelated_long_sets_share_no_key():
    rng = np.random.default_rng(10)
    keys = [np.unique(jaccard.segment_keys(np.unique(rng.integers(0, 2**64, 12_200, dtype=np.uint64)))) for _ in range(2000)]
    found, times = np.unique(np.concatenate(keys), return_counts=True)
    assert times.max() == 1 and len(found) > 2000 * 500


def test_trie_finds_all_links():
    rng = np.random.default_rng(11)
    base = [np.unique(rng.integers(0, 400, 60).astype(np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate((b[rng.random(len(b)) < 0.97], rng.integers(0, 400, 2).astype(np.uint64)))) for b in base for _ in range(8)]
    trie, sketches = jaccard.SetTrie(np.zeros(0, np.uint64), 80, 100), jaccard.Sketches(sets, 80, 100)
    for i, h in enumerate(sets):
        trie.add(h, i, lambda x: x)
    for i, h in enumerate(sets):
        want = {j for j, g in enumerate(sets) if j != i and 100 * len(np.intersect1d(h, g)) >= 80 * len(np.union1d(h, g))}
        near = [j for j in sketches.near(i).tolist() if j != i]
        assert want <= set(near)
        assert set(trie.search(h, lambda x: x, lambda: i, near)) == want == set(trie.search(h, lambda x: x, lambda: i)) - {i}


def test_near_copies_of_the_stage(spark):
    import corpus_pipeline as pipeline

    base = [f"w{i}" for i in range(100)]
    two = [*base[:30], "other", *base[31:70], "others", *base[71:]]  # five words: 86 / 106, three: 92 / 104
    longer = [f"v{i}" for i in range(100)]
    far = [f"u{i}" for i in range(100)]
    three = [*far[:20], "x", *far[21:50], "y", *far[51:80], "z", *far[81:]]  # five words: 81 / 111
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate([base, two, longer, [*longer, *(f"more{i}" for i in range(15))], far, three])]
    left = dict(pipeline.STAGES)["ngram_jaccard"](spark, docs(spark, rows), SF)
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 4, 5]
    assert len({r.component_id for r in jaccard.ngram_jaccard(docs(spark, rows)).collect()}) == 6


def test_empty_tables(spark):
    none = docs(spark, [])
    assert jaccard.ngram_jaccard(none).count() == 0
    assert quality.quality_rules(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert packing.pack(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert language.identify(none, language.train(none)).count() == 0
    assert licenses.scan_licenses(none.select("path", "text")).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, v int")).count() == 0
    emitted, members = chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(emitted, members).count() == 0


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read_archive(spark, f"file://{tmp_path}/w").count() == 0


def test_archive(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, "http://a/\r\nX: y", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "y" * 1000), (8, "u", "y" * 1000), (None, "u", big), (9, "u", LONG)]
    df = spark.createDataFrame([(*r, "z", b"q") for r in rows], "page_id long, url string, html string, sha1 string, body binary")
    warc.write_archive(df, f"file://{tmp_path}/w")
    read = warc.read_archive(spark, f"file://{tmp_path}/w")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in read.collect()}
    want = set()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and h == big and i != 2
        want.add((i, "revisit" if again else "response", 2 if again else None, hashlib.sha1(raw).hexdigest(), len(raw)))
    assert got == want and read.count() == len(rows)
    for r in read.collect():
        fields, body = warc.parse_header(r.record)
        assert int(fields["Content-Length"]) == len(body) and "\n" not in fields["WARC-Target-URI"]
    warc.export_text(read, f"file://{tmp_path}/text")
    whole = b"".join(sorted(p.read_bytes() for p in (tmp_path / "text").glob("part-*")))
    assert whole.count(b"WARC/1.1\r\n") == len(rows)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "BATCH", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 3])).tolist()) for i in range(450)]
    rows += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, rows[3][1]), (600, [float("inf")] * 8), (700, []), (None, [1.0] * 8), (400, rows[400][1])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    ok = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, v in {i: v for i, v in ok if i % 100 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == sorted(want)


def test_many_blocks_and_few_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 1)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 1.01 ** (-i % 700)).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, k=1).collect())
    v = np.floor(1024 * np.array([x for _, x in rows]))
    want = []
    for q in range(0, 700, 100):
        score = v @ v[q]
        score[q] = -np.inf
        want.append((q, 1, int(np.argmax(score)), int(score.max())))
    assert got == want


def test_blocks_that_cannot_reach_a_floor_are_left_out(spark):
    asks = spark.createDataFrame([(0, 1, 10.0, 1000.0), (0, 2, 20.0, 3000.0), (1, 3, 10.0, None), (2, 4, 5.0, 10_000.0)], "part int, vec_id long, norm double, floor double")
    rows = spark.createDataFrame([(b, b, float(n)) for b, n in enumerate([400, 200, 101, 95, 50, 0])], "block int, vec_id long, norm double")
    got = {tuple(r) for r in topk.reachable(asks, rows).collect()}
    assert got == {(0, 0), (0, 1), (0, 2)} | {(1, b) for b in range(6)}


def test_scores_of_any_size():
    q, rows = np.array([2.0**40, 3.0]), np.array([[2.0**40, 1.0], [1.0, 5.0]])
    assert topk.exact_scores(q, rows).tolist() == [(1 << 63) - 1, (1 << 40) + 15]


def test_quality_base(edge):
    for t in [r[1] for r in edge] + ["a b c\na b c\n\n \na b c d", "x # y | z x # y"]:
        w, lines = words(t), (t or "").split("\n")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        dup = sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 1000 else 0
        assert quality.base(t) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit))


def test_quality_keeps_even_text_and_drops_symbols(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(150))
    rows = [(i, text(), "en" if i % 2 else None, "s" if i % 3 else None) for i in range(300)] + [(900, " ".join(w + "###" for w in text().split()), "en", "s"), (901, "short", "en", "s"), (902, None, None, None)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs(spark, rows)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in (900, 901, 902))


def test_a_fence_follows_its_source(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))

    def fences(shift):
        rng.seed(12)
        texts = [(i, " ".join(word() + "#" * (s == "s1" and shift and rng.random() < 0.3) for _ in range(120)), "en", s) for i, s in enumerate(f"s{i % 12}" for i in range(1200))]
        df = docs(spark, texts).select("doc_id", "lang", "source", F.lit(0).cast("long").alias("text_hash"), "text")
        stats = df.mapInArrow(quality._base_rows, f"doc_id long, lang string, source string, text_hash long, {quality._BASE}").withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
        return {r["_source"]: r["hi_symbols"] for r in quality.thresholds(quality.sketches(stats)).collect()}

    before, after = fences(False), fences(True)
    assert after["s1"] > 3 * before["s1"] and len(after) == 12
    # a source of under a tenth of a language's documents is beyond the tail that the others inherit
    assert all(after[s] == pytest.approx(before[s]) for s in after if s != "s1")


def test_targets():
    assert mixing.targets([100, 10, 10], [5, 2, 1]) == pytest.approx([140, 20, 20])
    assert mixing.targets([0, 10], [5, 2]) == [0.0, 15.0]
    rng = random.Random(15)
    for _ in range(200):  # against the rule as it is told: fix what is above, share the rest again
        sizes = [rng.randint(0, 50) for _ in range(rng.randint(1, 9))]
        weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
        fixed = {}
        while True:
            rest = 1.5 * sum(sizes) - sum(fixed.values())
            by = sum(w for i, w in enumerate(weights) if i not in fixed) or 1
            part = {i: rest * weights[i] / by for i in range(len(sizes)) if i not in fixed}
            above = {i: 2.0 * sizes[i] for i, x in part.items() if x > 2 * sizes[i] + 1e-9}
            if not above:
                break
            fixed |= above
        assert mixing.targets(sizes, weights) == pytest.approx([(fixed | part)[i] for i in range(len(sizes))], abs=1e-6)


def test_knapsack_against_all_sums():
    rng = random.Random(4)
    for _ in range(50):
        lengths = np.array(sorted(rng.sample(range(2, 30), 4)))
        counts = np.array([rng.randint(0, 3) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + int(n) * k for s in sums for k in range(c + 1)}
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        if not any(counts == 0):
            assert abs(int((take * lengths).sum()) - budget) <= max(lengths)
        take = mixing.knapsack(lengths, counts, budget)
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_mix(spark, edge):
    got = mixing.mix_sources(docs(spark, edge)).toPandas()
    sizes, size = Counter(), Counter((i if i is not None else -1, src, len(words(t))) for i, t, _, src in edge)
    for _, t, _, src in edge:
        sizes[src] += len(words(t))
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.source.where(got.source.notna(), None), got["size"], strict=True)) == size
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    goal = dict(zip(order, mixing.targets([sizes[x] for x in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))]), strict=True))
    for r in got.itertuples():
        src = r.source if isinstance(r.source, str) else None
        assert r.source_size == sizes[src] and r.target == pytest.approx(goal[src])
    assert len(got) == len(edge) and (got.taken <= 2 * got["size"]).all() and set(got.copies) <= {0, 1, 2}
    per = got.groupby(got.source.fillna("~")).agg(t=("target", "first"), k=("taken", "sum"), s=("source_size", "first"), m=("size", "max"))
    assert (abs(per.t - per.k) <= per.m).all()
    again = mixing.mix_sources(docs(spark, edge[::-1])).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_pack(spark, edge):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.default_tokenizer())
    full.encode_special_tokens = True
    plain = [r for r in edge if r[0] is not None and r[1] != LONG]
    rows = edge + plain[:5] + [(900, "x" * 7000, "en", "a"), (901, "<|endoftext|> ü 　 1234's  \n\n", "en", "a")]
    ids = {t: np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, *_ in rows}
    want, text = {}, {}
    for i, t, *_ in rows:
        want[i] = want.get(i, 0) + len(ids[t])
        text[i] = t  # rows of one id have one text here
    got = packing.pack(docs(spark, rows)).toPandas()
    got["doc_id"] = got.doc_id.astype(object).where(got.doc_id.notna(), None)
    placed = Counter()
    for p in got.itertuples():
        whole = ids[text[p.doc_id]]
        assert p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(whole[p.start : p.start + p.length].tobytes())
        placed.update((p.doc_id, j) for j in range(p.start, p.start + p.length))
    times = Counter(r[0] for r in rows)
    assert set(placed) == {(i, j) for i, t in text.items() for j in range(len(ids[t]))} and all(n == times[i] for (i, _), n in placed.items())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert set(got.doc_id) == set(text)


def test_encoders_agree_at_the_border():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    plain.encode_special_tokens = True
    encode = packing.encoder(packing.default_tokenizer())
    for n in (2998, 2999, 3000, 3001):
        for text in ("ab" * (n // 2) + "c" * (n % 2), "é" * n + " x"):
            assert encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_neighbours_fill_a_window():
    near, other = np.arange(100, 160), np.arange(500, 560)
    shard = [near, other, other + 60, near + 1, other + 1]
    first = [d for d, _, _, s, _ in packing.pack_shard(shard, window=120) if s == 0]
    assert first[:2] == [0, 3]


def test_common_terms_find_neighbours():
    copies, others = [np.arange(100, 160)] * 4, [np.arange(1000 + 100 * i, 1060 + 100 * i) for i in range(8)]
    shard = [copies[0], *others[:4], copies[1], *others[4:], *copies[2:]]  # every term of the copies is in a third of the shard
    index = packing.Bm25(shard)
    assert index.neighbours(0, np.arange(len(shard)) > 0).tolist() == [5, 10, 11]
    first = [d for d, _, _, s, _ in packing.pack_shard(shard, window=240) if s == 0]
    assert first == [0, 5, 10, 11]


@pytest.mark.parametrize("seed", range(3))
def test_a_filled_matrix_packs_as_postings_do(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    shard = [(rng.zipf(1.3, rng.integers(1, 400)) % 3000).astype(np.int32) for _ in range(200)]
    shard += [shard[i] for i in range(0, 200, 7)] + [np.array([1], np.int32)] * 3  # copies tie
    filled = packing.Bm25(shard)
    got, near = packing.pack_shard(shard, window=300), filled.neighbours(0, np.arange(len(shard)) > 0).tolist()
    assert filled.dense is not None
    monkeypatch.setattr(packing, "DENSE_CELLS", 0)
    postings = packing.Bm25(shard)
    assert near == postings.neighbours(0, np.arange(len(shard)) > 0).tolist() and postings.dense is None
    assert got == packing.pack_shard(shard, window=300)


def test_long_runs_are_looked_for_only_where_a_block_has_no_space(monkeypatch):
    rng = random.Random(7)
    for n in (1499, 1500, 2998, 2999, 3000, 3001, 4500):
        for at in (0, 1, 1498, 1499, 1500, 1501, rng.randrange(9000)):
            for space in " \n\x85\u3000":
                text = ("ab" + space) * (at // 3) + space * (at % 3) + "é" * n + space + "cd " * 500
                assert packing._long(text) == bool(packing._LONG.search(text))
    monkeypatch.setattr(packing, "_LONG", None)  # not asked
    assert packing.encoder(packing.default_tokenizer())("some words " * 2000)


def test_cuts_in_runs_of_spaces_keep_the_ids():
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(packing.default_tokenizer().removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain, encode, rng = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer()), random.Random(5)
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()] + ["\u180e", "\u200b", "\ufeff"]
    parts = ["a", "word", "É", "12", "²", "'s", "'", "!?", "#", "<|endoftext|>"[:5], *" \n\t" * 3]
    texts = [a + x + y + b for x in spaces for y in spaces for a in ("", "a", "1") for b in ("", "b", "'s", "!")]
    texts += ["".join(rng.choice(parts if rng.random() < 0.8 else spaces) for _ in range(rng.randrange(30))) for _ in range(5000)]
    for text in texts:
        assert encode(text) == whole.encode_ordinary(text), repr(text)
    for text in texts[::20]:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_related_documents_meet_over_the_whole_table(spark):
    rng = random.Random(3)
    topics = [[f"{rng.randrange(10**6)}" for _ in range(50)] for _ in range(1500)]
    rows = [(i, " ".join(rng.sample(topics[i % 1500], 48)), "en", "a") for i in range(3000)]  # partners stand 1,500 rows apart
    got = packing.pack(docs(spark, rows), window=300).toPandas()
    assert sorted(got.doc_id.unique()) == list(range(3000))
    at = got.groupby("doc_id").sequence_id.agg(set)
    assert sum(bool(at[i] & at[i + 1500]) for i in range(1500)) >= 1000


def test_search_finds_the_best_of_the_whole_table(spark, edge, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 1500)
    monkeypatch.setattr(packing, "SHARD_DOCS", 3)
    rows = [r for r in edge if r[1] != LONG]
    encode = packing.encoder(packing.default_tokenizer())
    bags = [(i, Counter([*encode(t or ""), 1])) for i, t, *_ in rows if i is not None]
    df, n = Counter(t for _, b in bags for t in b), len(bags)
    mean = sum(sum(b.values()) for _, b in bags) / n

    def score(q, b):
        size = packing.K1 * (1 - packing.B + packing.B * sum(b.values()) / mean)
        return sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * (packing.K1 + 1) / (b[t] + size) for t in q if t in b)

    want = []
    for q, bag in [x for x in bags if x[0] % 10 == 0]:
        best = sorted((-round(score(bag, b), 6), i) for i, b in bags if i != q and set(bag) & set(b))[:5]
        want += [(q, r + 1, -s) for r, (s, _) in enumerate(best)]
    got = packing.search(docs(spark, rows), every=10, k=5).collect()
    assert sorted((r.query_id, r["rank"], round(r.score, 6)) for r in got) == [(q, r, pytest.approx(s, abs=2e-6)) for q, r, s in sorted(want)]


def test_statistics_of_the_whole_table(spark, edge):
    rows = [r for r in edge if r[0] is not None and r[1] != LONG]
    encoded = docs(spark, rows).select("doc_id", "text").repartition(5).mapInArrow(packing._encode(packing.default_tokenizer()), "row long, doc_id long, n long, ids binary")
    found = packing.collect_statistics(encoded)
    encode = packing.encoder(packing.default_tokenizer())
    bags = [[*encode(t or ""), 1] for _, t, *_ in rows]
    df = Counter(t for b in bags for t in set(b))
    assert found.docs == len(rows) and found.tokens == sum(map(len, bags))
    assert {t: int(found.df[t]) for t in np.flatnonzero(found.df)} == df


def test_language(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = language.train(table)
    found = language.identify(table, crf).where(language.held_out()).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95 and found.score.between(0, 1).all()
    assert crf.label([None, "", "12 !? ²", "the and of this that"]) [:3] == [("und", 0.0)] * 3
    assert crf.label([LONG * 3])[0][0] in crf.labels


def test_words_of_a_text_that_switches(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    crf = language.train(table)
    texts = {r["lang"]: r["text"] for r in table.where(language.held_out() & F.expr("length(text) between 400 and 900")).orderBy("doc_id").collect()}
    a, b = sorted(texts)[:2]
    first, second = texts[a][:300].rsplit(" ", 1)[0], texts[b][:300].rsplit(" ", 1)[0]
    text = f"İ {first}\n{second}"  # one letter that is two in lower case
    got = language.label_words(docs(spark, [(1, text, None, None), (2, None, None, None), (3, "12 !", None, None)]), crf).orderBy("doc_id").collect()
    assert got[1].stretches == [] and got[2].stretches == []
    right = sum(max(0, min(x.end, len(first) + 2) - x.begin) for x in got[0].stretches if x.lang == a)
    right += sum(max(0, x.end - max(x.begin, len(first) + 3)) for x in got[0].stretches if x.lang == b)
    assert right >= 0.9 * len(text)
    assert all(text[x.begin].isalpha() and text[x.end - 1].isalpha() and 0 < x.score <= 1 for x in got[0].stretches)
    assert sum(x.words for x in got[0].stretches) == len(re.findall(r"[^\W\d_]+", text))


def test_training_by_blocks_needs_little_memory(monkeypatch):
    rng = random.Random(15)
    vocab = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(500)] for lang, letters in (("de", "abcdefgh"), ("en", "efghijkl"), ("fr", "ijklmnop"))}
    rows = [(" ".join(rng.choice(vocab[lang]) for _ in range(n)), lang) for lang in vocab for n in [8_000] * 20 + [1, 100]]
    monkeypatch.setattr(language, "PASSES", 2)
    language.fit([("warm", "en")])
    tracemalloc.start()
    parts = language.fit(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(len(t) for t, _ in rows)
    blocks = []
    monkeypatch.setattr(language, "_blocks", lambda chain, *_: blocks.append(chain) or [chain])
    whole = language.fit(rows)
    assert len(blocks) == 1 and parts.labels == whole.labels and (parts.lexicon == whole.lexicon).all()
    for a, b in ((parts.gram, whole.gram), (parts.word, whole.word), (parts.move, whole.move)):
        assert np.abs(b).max() > 0.1 and np.allclose(a, b, atol=1e-6)


def test_languages_that_tie_go_by_code_point():
    crf = language.Crf(["de", "en"], np.zeros(0, np.uint64))
    assert crf.label(["some words", "some words"]) == [("de", 0.5)] * 2


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    p, pairs = np.zeros((4, 3)), np.zeros((3, 3))
    total = 0.0
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(emit[i, y[i]] for i in range(4)) + sum(move[y[i], y[i + 1]] for i in range(3)))
        total += w
        for i in range(4):
            p[i, y[i]] += w
        for i in range(3):
            pairs[y[i], y[i + 1]] += w
    got, moved = language.forward_backward(emit, np.array([[0, 1, 2, 3, -1]]), move)
    assert np.allclose(got, p / total) and np.allclose(moved, pairs / total)


def test_shards(spark, edge):
    rng = random.Random(6)
    rows = edge + [(1000 + i, "the same hot text", "en", "a") for i in range(1500)] + [(5000 + i, "t" * rng.randint(1, 200), "en", "b") for i in range(1500)]
    got = sharding.shard_documents(docs(spark, rows)).toPandas()
    key = lambda i, t: (-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter(zip(got.doc_id.fillna(-1), got["size"], got.text_crc32, strict=True)) == Counter(key(i, t) for i, t, *_ in rows)
    assert got.shard.between(0, 23).all() and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert sharding.shard_documents(docs(spark, rows[:3])).count() == 3
    short = [r for r in rows if r[1] != LONG]
    load = sharding.shard_documents(docs(spark, short)).toPandas().groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 0.03 * load.mean() + 1000


def test_shards_of_repeated_rows(spark):
    rng = random.Random(7)
    rows = [(None, "one text for all of them", "en", "a")] * 4000 + [(i, "t" * rng.randint(1, 40), "en", "b") for i in range(2000)] + [(7, None, "en", "a")] * 2000
    load = sharding.shard_documents(docs(spark, rows)).toPandas().groupby("shard")["size"].sum()
    assert len(load) == 24 and load.max() - load.min() <= 0.02 * load.mean() + 100


def test_licenses(spark):
    mit = dict(licenses._NOTICES[2:3])["MIT"]
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.txt", "plain words"), ("a/d/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/d/e/y", ""), ("a/d/e/z", "some prose here.\nLicensed under CC BY-NC 4.0.\nmore prose that goes on and on for a while"), ("other/x", None), (None, "x"), ("f/README", mit.replace(". ", ".\n") + "\nand then words"), ("f/g", "the licensed premises were closed")]
    got = {r.path: (r.license, r.origin, r.license_dir) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/LICENSE"] == ("MIT", "own", None) and got["a/b/c/x.txt"] == ("MIT", "inherited", "a")
    assert got["a/d/e/y"] == ("GPL-3.0", "inherited", "a/d") and got["a/d/e/z"] == ("CC-BY-NC-4.0", "own", None)
    assert got["other/x"] == (None, None, None) and got[None] == (None, None, None)
    assert got["f/README"][0] == "MIT" and got["f/g"] == ("MIT", "inherited", "f")


def test_license_texts():
    matcher = licenses.Matcher({t: 1 for t in licenses.vocabulary()}, 100)
    full = {name: (licenses.Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text() for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0")}
    for name, text in full.items():
        assert [x for x, _ in matcher.scan(text)[0]][0] == name
        assert matcher.scan(text[:1200])[0][0][0] == name
        assert matcher.scan(f"# SPDX-License-Identifier: {name}\nplain words")[0] == [(name, pytest.approx(1.0))]
    both = matcher.scan("Licensed under the MIT License.\nwords of zzz yyy\nLicensed under CC BY-NC 4.0.")[0]
    assert {x for x, _ in both} == {"MIT", "CC-BY-NC-4.0"}
    assert matcher.scan(None) == ([], 0.0) == matcher.scan("") and matcher.scan(LONG)[0] == []


def test_licenses_against_brute_force(spark):
    rng = random.Random(13)
    lines = [text for _, text in licenses._NOTICES if len(text) < 120] + ["plain prose of no licence", "SPDX-License-Identifier: MIT", "the licence of words", ""]
    rows = [("/".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) + f"/{'LICENSE' if k % 5 == 0 else f'f{k}'}", rng.choice(lines)) for k in range(150)]
    rows += [("a/LICENSE", lines[0]), ("a/LICENSE", lines[0]), ("a/LICENSE.txt", lines[-2]), (None, lines[0]), ("x/y/z/long.txt", LONG)]
    files = len(rows)
    counts = Counter(t for _, text in rows for t in set(licenses.terms(text)))
    known = set(licenses.vocabulary())
    idf = lambda t: math.log((1 + files) / (1 + counts.get(t, 0))) + 1 if t in known else math.log(1 + files) + 1

    def vector(ws):
        v = {t: (1 + math.log(n)) * idf(t) for t, n in Counter(ws).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / size for t, x in v.items()}

    forms = [(name, vector(ws)) for name, ws in licenses.templates()]

    def own(text):
        v = vector(licenses.terms(text))
        top = max(((sum(x * v.get(t, 0) for t, x in f.items()), name) for name, f in forms), key=lambda x: (round(x[0], 9), [-ord(c) for c in x[1]]))
        return (top[1], top[0]) if top[0] >= licenses.MATCH - 1e-12 else None

    best = {}
    for path, text in rows:
        if path is not None and (o := own(text)):  # one unit a text: its words are all of a matching passage
            d = path.rpartition("/")[0]
            best[d] = min(best.get(d, (0.0, "")), (-round(o[1], 9), o[0]))
    want = Counter()
    for path, text in rows:
        if o := own(text):
            want[path, o[0], "own", None] += 1
            continue
        d, found = (path or "").rpartition("/")[0] if path is not None else None, None
        while d is not None and found is None:
            found = (best[d][1], d) if d in best else None
            d = d.rpartition("/")[0] if "/" in d else None
        want[path, *((found[0], "inherited", found[1]) if found else (None, None, None))] += 1
    df = spark.createDataFrame([(p, t, "l", "o", 1.0) for p, t in rows], "path string, text string, license string, origin string, share double")
    got = Counter((r.path, r.license, r.origin, r.license_dir) for r in licenses.scan_licenses(df).collect())
    assert got == want


def test_turns_that_repeat(spark):
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, 1, "assistant", "c", "x"), (1, 1, "assistant", "c", "x"), (2, None, "user", "a", "x")]
    emitted, members = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string"))
    got = {r.conv_id: r for r in chat.read_back(emitted, members).collect()}
    whole = "user\na\nuser\na\nuser\nb\nassistant\nc\nassistant\nc\n"
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[1].n_turns == 5 and got[1].loss_chars == 2
    assert got[2].n_turns == 1


def test_chat(spark):
    tricky = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| \\ <|"
    chats = {1: [("user", "hi"), ("assistant", "a"), ("user", "b")], 2: [("user", "hi"), ("assistant", "a"), ("user", "c"), ("assistant", "")], 3: [("user", "hi"), ("assistant", "a"), ("user", "b")], 4: [(None, None), ("as\n\\sistant", tricky), ("assistant", tricky)], None: [("assistant", LONG[:50_000])], 5: [("user", "hi")]}
    rows = [(c, i, r, t, "x") for c, turns in chats.items() for i, (r, t) in enumerate(turns)]
    emitted, members = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string"))
    got = {r.conv_id: r for r in chat.read_back(emitted, members).collect()}
    for c, turns in chats.items():
        whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[c].n_turns == len(turns)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nodes = emitted.orderBy("start").collect()
    assert len({n.name for n in nodes}) == len(nodes)
    end = 0
    for n in nodes:
        assert n.start == end
        end += len(n.ids) // 4
        above = sum(x.end - x.start for x in n.attend or [])
        assert above == n.position and all(x.end <= n.start for x in n.attend or [])


def test_stages(spark):
    import corpus_pipeline as pipeline
    from boxloom.llm.common import staged

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    names = rows.columns
    kept = {r.doc_id for r in rows.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        rows = staged(stage(spark, rows, SF), name)
        assert rows.columns == names
        now = {r.doc_id for r in rows.select("doc_id").collect()}
        assert now and now <= kept
        kept = now
    edge = docs(spark, [(None, "one two three " * 40, "en", "a"), (1, None, None, None), (1, "x", "en", "a")])
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, edge, SF).columns == edge.columns
    assert pipeline.STAGES[-1][1](spark, rows, SF).count() >= len(kept)


def test_stages_decide_rows_one_by_one(spark):
    import corpus_pipeline as pipeline

    stages = dict(pipeline.STAGES)
    rng = random.Random(8)
    good = [" ".join(f"word{rng.randrange(10_000)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, good[0], "en", "a"), (None, "short", "en", "a"), (None, None, None, None), (None, good[0], "en", "a"), (7, good[1], "en", "a"), (7, "", "en", "a"), (7, good[2], "en", "a"), (3, good[1], "en", "a"), (4, good[3], "en", None), (4, good[3], "en", None)]
    texts = lambda name, df: sorted(((r.doc_id, r.text) for r in stages[name](spark, df, SF).collect()), key=repr)
    kept = texts("quality_rules", docs(spark, rows))
    assert kept == sorted([(i, t) for i, t, *_ in rows if t in good], key=repr)
    # (7, good[1]) links with 3; the other row of 7 stays; rows that repeat stay once
    left = texts("ngram_jaccard", docs(spark, [r for r in rows if r[1] in good]))
    assert left == sorted([(None, good[0]), (7, good[2]), (3, good[1]), (4, good[3])], key=repr)
    mixed = texts("source_mix", docs(spark, rows))
    assert Counter(mixed)[(7, "")] <= 2 and {t for _, t in mixed} >= {good[3]}


def test_rows_are_counted_once(spark, edge):
    df = docs(spark, edge)
    assert quality.quality_rules(df).count() == len(edge)
    assert jaccard.ngram_jaccard(df).count() == len(edge)
    assert language.identify(df.withColumn("score", F.lit("x")), language.fit([])).count() == len(edge)


def test_pipeline_of_edge_rows(spark, edge, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(14)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(90))
    good = [(3000 + i, text(), "en" if i % 3 else None, "ab"[i % 2]) for i in range(60)]
    rows = edge + good + [(4000 + i, t, lang, s) for i, t, lang, s in good[:5]] + [good[0]]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, f"file://{tmp_path}").toPandas()
    found = set(got.doc_id)
    assert found <= {r[0] for r in rows if r[1]} and len(found & {r[0] for r in good}) >= 30
    assert not found & set(range(4000, 4005))  # copies with a larger id
    times = got[got.start == 0].groupby("doc_id").size()
    assert times.max() <= 2
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_the_language_found_fills_a_null(spark):
    import corpus_pipeline as pipeline

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = table.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    out = dict(pipeline.STAGES)["language_id"](spark, some, SF)
    assert out.columns == some.columns and out.where("lang is null").count() == 0
    same = out.select("doc_id", "lang").join(table.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert same.where("lang = truth").count() >= 0.9 * same.count()
