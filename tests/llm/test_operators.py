"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grainwise.llm import blocks, bpe, common, embedding_dedup, exact_dedup, mixing, simhash, substring_dedup, token_counts, token_files, toxicity, unit_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, size long, doc long, tie long, own_size int, level int, its_doc int"
CLASH = [0.5, "d", 7, 3, 4, 1, 2, 5]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = words(rng, 120)
    texts = [None, "", " \t\n", "one", "one two", "One TWO three", base, base, base.upper(), base + " tail words here", "x" + base, words(rng, 60) + "\n" + base[:260] + "\n" + words(rng, 40), base[:99], base[:100], "é" * 80 + base[:150], "<|endoftext|>a  b　½", words(rng, 30_000)]
    texts += [base[:300] + words(rng, 30) for _ in range(6)] + ["aaaa" * 100, "ab" * 120]
    out = [(i, t, "en", "s" + str(i % 3), 0) for i, t in enumerate(texts)]
    out += [(3, "one", None, None, None), (None, "no id", "de", None, 1), (None, None, None, None, None), (3, "one", None, None, None), (2, base, "en", "s1", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_helpers(spark):
    assert common.fresh(["Doc", "_doc"], "doc", "doc") == ["__doc", "___doc"]
    assert common.shared_dir(spark).startswith("file:")


# Exact dedup


def test_exact_dedup(spark, docs, rows, none):
    index = exact_dedup.DigestIndex(spark, common.scratch(spark, "index"), 3)
    got = exact_dedup.classify(docs, index).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(rows)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    for text, ids in groups.items():
        own = by_text[hashlib.sha256(text.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert all((r.keep_id, r.group_size) == (best, len(ids)) for r in own)
        assert [r.doc_id for r in own if r.kept] == [best]
    assert exact_dedup.classify(none, exact_dedup.DigestIndex(spark, common.scratch(spark, "index"), 3)).count() == 0


def test_index_lives_on(spark, docs):
    path = common.scratch(spark, "index")
    exact_dedup.classify(docs, exact_dedup.DigestIndex(spark, path, 4)).count()
    again = exact_dedup.DigestIndex(spark, path, 4)
    before = again.rows().count()
    more = spark.createDataFrame([(100, "one"), (101, "brand new"), (102, "brand new")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.classify(more, again).collect()}
    assert got == {100: (3, False), 101: (102, False), 102: (102, True)} and again.rows().count() == before + 1
    plan = more.select(exact_dedup.digest(F.col("text")).alias("digest")).join(again.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_batch_that_comes_again(spark, docs, rows, monkeypatch):
    path = common.scratch(spark, "index")
    df = docs.select("doc_id", "text")
    want = Counter(map(tuple, exact_dedup.classify(df, exact_dedup.DigestIndex(spark, common.scratch(spark, "index"), 4)).collect()))
    add = exact_dedup.DigestIndex.add

    def dies(self, digests, batch=None):  # after the append
        add(self, digests, batch)
        raise OSError("lost")

    monkeypatch.setattr(exact_dedup.DigestIndex, "add", dies)
    with pytest.raises(OSError):
        exact_dedup.deduplicate(df, exact_dedup.DigestIndex(spark, path, 4))
    monkeypatch.setattr(exact_dedup.DigestIndex, "add", add)
    index = exact_dedup.DigestIndex(spark, path, 4)
    n = index.rows().count()
    for again in (df, df.repartition(5)):
        assert Counter(map(tuple, exact_dedup.classify(again, index).collect())) == want
        assert exact_dedup.deduplicate(again, index).count() == len({r[1] or "" for r in rows})
    assert index.rows().count() == n
    # Under another name it is another delivery, of which nothing is new.
    assert exact_dedup.deduplicate(df, index, batch="other").count() == 0
    assert exact_dedup.deduplicate(df, index, batch="other").count() == 0


def test_long_texts_by_digest(spark):
    rng = random.Random(12)
    long = words(rng, 300_000)
    df = spark.createDataFrame([(1, long), (2, long + "x"), (3, long)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.classify(df, exact_dedup.DigestIndex(spark, common.scratch(spark, "index"), 2)).collect()}
    assert got == {1: (3, False), 2: (2, True), 3: (3, True)}


def test_deduplicate_keeps_columns(docs, none):
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact_dedup.deduplicate(none).count() == 0
    assert out.filter("doc_id = 3").count() == 1


def test_normalisation(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, " a\tB "), (3, "A b")], "doc_id long, text string")
    sizes = {h: exact_dedup.classify(df, exact_dedup.DigestIndex(spark, common.scratch(spark, "i"), 2), h).filter("kept").count() for h in ("none", "space", "lower")}
    assert sizes == {"none": 3, "space": 2, "lower": 1}


# BPE and token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def test_bpe_is_the_librarys(docs, rows, none, library):
    out = bpe.encode(docs, BYTE_BPE)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert Counter(r.text for r in bpe.decode(out, BYTE_BPE).collect()) == Counter(r[1] or "" for r in rows)
    assert bpe.encode(none, BYTE_BPE).count() == 0


def test_bpe_on_odd_texts(library):
    mine = bpe.load(BYTE_BPE)
    rng = random.Random(5)
    pool = "aé ß½²Ⅷ　\x85\x1c\t\n\r'sT漢😀ה_-0٣.,!<|endoftext|>'ll'LL​﻿"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(3000)] + ["a" * 3000, "he's we'll I'M don't", "   x   ", "<|endoftext|><|endoftext|>"]
    for t in texts:
        assert list(mine.encode(t)) == library.encode(t, add_special_tokens=False).ids, t
        ids = mine.encode(t)
        for cut in (ids, ids[1:], ids[:-1]):
            assert mine.decode(cut) == library.decode(list(cut), skip_special_tokens=False)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes(kind):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        assert (token_files.from_planes(token_files.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files(spark, docs, rows, none, library, kind):
    folder = common.scratch(spark, "tokens")
    token_files.write(docs, folder, BYTE_BPE, end_id=2, kind=kind, block_ids=1000, shards=3)
    got = token_files.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at, texts = 0, []
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
        texts.append(library.decode(r.ids[:-1], skip_special_tokens=False))
    assert Counter(texts) == Counter(r[1] or "" for r in rows)
    empty = common.scratch(spark, "tokens")
    token_files.write(none, empty, BYTE_BPE)
    assert token_files.read(spark, empty).count() == 0


def test_encoder_is_held_against_the_library(spark, tmp_path, monkeypatch):
    """Another cut of texts than the library's stops the job."""
    encoder = token_files.LibraryEncoder(BYTE_BPE)
    assert encoder.compared("It's 12 o'clock") == encoder.whole("It's 12 o'clock")
    monkeypatch.setattr(token_files, "pieces", lambda text: text.split())
    with pytest.raises(RuntimeError):
        token_files.LibraryEncoder(BYTE_BPE).compared("two words")


def test_token_encoder_is_the_librarys(library):
    mine = token_files.encoder(BYTE_BPE)
    rng = random.Random(6)
    for _ in range(2000):
        t = "".join(rng.choice("ab é½　\n'sZ漢😀1<|endoftext|>") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_other_tokenizer_files_go_whole(library):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = np.frombuffer(token_files.encoder(path).encode("Some Text,  twice"), "<u4").tolist()
    assert ids == Tokenizer.from_file(path).encode("Some Text,  twice", add_special_tokens=False).ids
    token_files.encoder.cache_clear()


# SimHash


def plain_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_simhash(docs, rows, none):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fp = [plain_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            root = find(parent, i)
            least[root] = min(least.get(root, r[0]), r[0])
    assert got == Counter((r[0], f"{fp[i]:016x}", least.get(find(parent, i))) for i, r in enumerate(rows))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("distance", "segments"), [(2, 5), (2, 3), (3, 7), (0, 1), (4, 6)])
def test_pigeonring_misses_nothing(spark, distance, segments):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    made = list(base)
    for b in base:
        for _ in range(12):
            x = int(b)
            for k in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << k
            made.append(np.uint64(x))
    fp = np.unique(np.array(made, np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = simhash.link(nodes, distance, segments, block=7).collect()
    parent, at = list(range(len(fp))), {int(x): i for i, x in enumerate(fp.view(np.int64))}
    for e in edges:
        parent[find(parent, at[e.a])] = find(parent, at[e.b])
    other = list(range(len(fp)))
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= distance).tolist():
            other[find(other, i)] = find(other, j)
    same = lambda p: {frozenset(k for k in range(len(fp)) if find(p, k) == r) for r in {find(p, k) for k in range(len(fp))}}
    assert same(parent) == same(other)
    for e in edges:  # edges go between fingerprints that links join
        assert find(other, at[e.a]) == find(other, at[e.b])


@pytest.mark.parametrize(("distance", "segments"), [(2, 5), (3, 7), (6, 13), (4, 6)])
def test_chains_prune(distance, segments):
    """Pairs that are equal in a chain's key go along the chain, and only those within its budgets are left after each step."""
    rng = np.random.default_rng(distance)
    ring = simhash.Ring(distance, segments)
    start = 1
    key = ring.key_mask(start)
    a, b = (rng.integers(0, 1 << 64, 200, dtype=np.uint64) & np.uint64(~key & ((1 << 64) - 1)) for _ in range(2))
    for i in range(0, 200, 2):  # half of them near
        b[i] = a[i] ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 2 * distance), replace=False)) & ~key)
    x, y, left = ring.links(a, b, start)
    alive, want = {(i, j) for i in range(200) for j in range(200)}, []
    for k in range(ring.equal + 1, segments + 1):
        mask = sum(ring.masks[(start + j) % segments] for j in range(k))
        alive = {(i, j) for i, j in alive if (int(a[i] ^ b[j]) & mask).bit_count() <= k * distance // segments}
        if k == segments or ring.budget(k) < ring.budget(k + 1):
            want.append(len(alive))
    assert left == want and set(zip(x.tolist(), y.tolist(), strict=True)) == alive
    assert left[0] < 0.2 * 200 * 200 and 10 < left[-1] <= left[0]


def test_long_prints_go_along_the_ring():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, (3000, simhash.LONG_WORDS), dtype=np.uint64)
    b = a.copy()
    for i in range(2000):
        for k in rng.choice(256, rng.integers(0, 110), replace=False).tolist():
            b[i, k // 64] ^= np.uint64(1 << k % 64)
    b[2000:] = rng.integers(0, 1 << 64, (1000, simhash.LONG_WORDS), dtype=np.uint64)
    most = rng.integers(40, 90, 3000)
    at, differ, left = simhash.along_the_ring(a, b, most)
    distance = np.bitwise_count(a ^ b).sum(1)
    assert at.tolist() == np.flatnonzero(distance <= most).tolist() and differ.tolist() == distance[at].tolist()
    assert left == sorted(left, reverse=True) and left[0] < 2600 and left[-1] == len(at)
    none = simhash.along_the_ring(a[:0], b[:0], most[:0])
    assert [len(x) for x in none[:2]] == [0, 0]


def test_spanning_is_least():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, m = int(rng.integers(1, 40)), int(rng.integers(0, 80))
        x, y, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 10, m)
        parent, total, count = list(range(n)), 0, 0
        for i in np.argsort(w, kind="stable").tolist():
            if find(parent, x[i]) != find(parent, y[i]):
                parent[find(parent, x[i])] = find(parent, y[i])
                total, count = total + w[i], count + 1
        some = blocks.spanning(x, y, w)
        assert (len(some), w[some].sum()) == (count, total)


def test_a_chain_of_near_copies(spark):
    """Texts that each resemble the next, in a chain whose ends differ, beside such that resemble all of them a little: only links count."""
    rng = random.Random(13)
    line = words(rng, 1000).split()
    texts = [" ".join(line[40 * i : 40 * i + 600]) for i in range(10)]  # neighbours at 0.87, the next but one at 0.76
    other = words(rng, 600).split()
    texts += [" ".join(other[:300] + words(rng, 120 + 10 * i).split()) for i in range(12)]  # at most 0.6
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = simhash.similar_documents(df, block=4).collect()
    assert {r.doc: r.root_doc for r in got} == {i: 0 if i < 10 else i for i in range(len(texts))}


def test_similar_documents(spark, none):
    rng = random.Random(3)
    base = [words(rng, 300) for _ in range(30)]
    texts, origin = [], []
    for n, b in enumerate(base):
        texts.append(b)
        origin.append(n)
        w = b.split()
        for k in (1, 2, 40):  # one or two words changed: similar; forty: not
            v = list(w)
            for i in rng.sample(range(300), k):
                v[i] = "zz" + v[i]
            texts.append(" ".join(v))
            origin.append(n if k < 40 else -len(texts))
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, None, 0), (7, texts[7], 7)], "doc_id long, text string, its_doc int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is not None, i))
    first = {}
    for i, o in enumerate(origin):
        first.setdefault(o, i)
    assert ids == [None, *sorted(first.values())]
    assert simhash.keep_one(none).count() == 0


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    rng = random.Random(8)
    texts = [words(rng, 1000) + " -" * 134 for _ in range(6)]
    df = spark.createDataFrame([*enumerate(texts), (6, texts[2].upper())], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == list(range(6))
    # However prints come to be equal.
    monkeypatch.setattr(simhash, "long_fingerprint", lambda *_: [5] * simhash.LONG_WORDS)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == list(range(6))


def test_repeats_do_not_hide_near_copies(spark):
    rng = random.Random(9)
    base = [words(rng, 1000) for _ in range(4)]
    line = " ".join(base[1].split()[:8])
    more = [base[0] + " -" * 134, base[1] + f" {line}" * 120, "la " * 300 + base[2], base[3] + " na na hey" * 200]
    df = spark.createDataFrame([*enumerate(base + more)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == list(range(4))


def test_pairs_at_the_threshold(spark, monkeypatch):
    rng = random.Random(10)
    shingles_of = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def share(a, b):
        a, b = shingles_of(a.split()), shingles_of(b.split())
        return len(a & b) / len(a | b)

    common_part, texts, similar = words(rng, 60), [], 0
    for i in range(150):
        n = rng.choice((8, 40, 120, 300, 800))
        a = words(rng, n) if i % 3 else common_part + " " + words(rng, n)
        want = rng.choice((0.77, 0.8, 0.82, 0.85, 0.9))
        b, k = a, 0
        while share(a, b) > want + 0.02:
            k += max(1, n // 100)
            b = f"{a} {words(rng, k)}" if i % 2 else f"{words(rng, k // 2)} {a} {words(rng, k - k // 2)}"
        similar += share(a, b) >= 0.8
        texts += [a, b]
    assert similar > 80
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = [i for i in range(len(texts)) if i % 2 == 0 or share(texts[i - 1], texts[i]) < 0.8]
    monkeypatch.setattr(simhash, "FREQUENT_SAMPLE", 100)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == want


def test_prefixes_meet():
    rng = np.random.default_rng(3)
    known = np.sort(rng.integers(0, 1 << 64, 40, dtype=np.uint64))
    frequent = known, rng.integers(2, 9, 40)
    for _ in range(2000):
        both, own = int(rng.integers(1, 60)), rng.integers(0, 8, 2)
        pool = np.unique(np.concatenate((rng.choice(known, 20), rng.integers(0, 1 << 64, 90, dtype=np.uint64))))
        pool = rng.permutation(pool)[: both + own.sum()]
        a, b = np.sort(pool[: both + own[0]]), np.sort(np.concatenate((pool[:both], pool[both + own[0] :])))
        for t in (0.5, 0.8, 0.9):
            if both / len(pool) >= t:
                assert len(np.intersect1d(simhash.prefix(a, t, frequent), simhash.prefix(b, t, frequent)))


def test_long_near_copies(spark):
    rng = random.Random(17)
    long = words(rng, 120_000).split()
    near = [w if i % 60 else w + "x" for i, w in enumerate(long)]  # 0.85
    far = [w if i % 30 else w + "y" for i, w in enumerate(long)]  # 0.71
    df = spark.createDataFrame([(0, " ".join(long)), (1, " ".join(near)), (2, " ".join(far)), (3, " ".join(long[:100_000]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 2]


def test_a_hot_group_of_near_copies(spark):
    """A third of all rows resemble each other; they span several blocks, and no pair of them is compared more often than rounds need."""
    rng = random.Random(18)
    base = words(rng, 200).split()
    texts = [" ".join(base[:k] + [f"own{i}"] + base[k:]) for i in range(90) for k in [rng.randrange(200)]]
    texts += [words(rng, rng.randint(3, 60)) for _ in range(180)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc: r.root_doc for r in simhash.similar_documents(df, block=16).collect()}
    assert got == {i: 0 if i < 90 else i for i in range(270)}


def test_exact_jaccard():
    rng = np.random.default_rng(0)
    sets = [set(rng.integers(0, 40, rng.integers(0, 60)).tolist()) for _ in range(12)] + [set(), set()]
    for a in sets:
        for b in sets:
            got = simhash.jaccard(*(np.array(sorted(s), np.uint64) for s in (a, b)))
            assert got == pytest.approx(len(a & b) / len(a | b) if a | b else 1)


# Substrings


def plain_removal(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                cover[k] += 1
                cover[k + length] -= 1
            seen.add(b[k : k + length])
        gone = np.cumsum(cover)[: len(b)] > 0
        out.append((len(b), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "hot"), [(100, 28, 20_000), (100, 28, 1), (30, 8, 20_000), (25, 11, 2), (8, 8, 20_000)])
def test_substrings(spark, docs, rows, length, gram, hot):
    got = substring_dedup.removed_spans(docs, length, gram, hot)
    order = {}
    for r in rows:
        order.setdefault((r[0], r[1]))
    tie = {x: spark.createDataFrame([(x,)], "t string").select(F.xxhash64("t")).first()[0] for x in {k[1] for k in order}}
    distinct = sorted(order, key=lambda k: (k[0] is not None, k[0] or 0, tie[k[1]]))
    want = dict(zip(distinct, plain_removal([k[1] for k in distinct], length), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == Counter((r[0], *want[r[0], r[1]]) for r in rows)


def test_substrings_across_pieces(spark, none, monkeypatch):
    rng = random.Random(9)
    long = words(rng, 4000)
    texts = [long, words(rng, 50) + long[5000:5400] + words(rng, 700) + long[100:230], long[7000:], "ab" * 3000]
    monkeypatch.setattr(substring_dedup, "PIECE", 1000)
    found = substring_dedup.find_windows(100, 28)
    assert found is not None
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = [tuple(r)[1:] for r in substring_dedup.removed_spans(df).drop("removed").orderBy("doc_id").collect()]
    assert got == plain_removal(texts, 100)
    assert substring_dedup.removed_spans(none).count() == 0


# Units


def test_units(spark, docs, rows, none):
    text = "One two.  Three four five! Six\nSeven eight\n\n Nine.\tTen"
    assert [text[a:b] for a, b in unit_dedup.spans(text, ("line",))] == ["One two.  Three four five! Six", "Seven eight", "Nine.\tTen"]
    assert [text[a:b] for a, b in unit_dedup.spans(text, ("sentence",))] == ["One two.", "Three four five!", "Six", "Seven eight", "Nine.", "Ten"]
    assert [text[a:b] for a, b in unit_dedup.spans(text, ("paragraph",))] == ["One two.  Three four five! Six\nSeven eight", "Nine.\tTen"]
    with pytest.raises(ValueError):
        unit_dedup.remove_repeats(docs, ("page",))
    for units, least in ((unit_dedup.UNITS, 1), (("line",), 1), (("paragraph", "sentence"), 5), (unit_dedup.UNITS, 20)):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_units_removed, r.n_spans, r.kept_text, r.kept_sha256) for r in unit_dedup.remove_repeats(docs, units, least).collect())
        tie = {t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0] for t in {r[1] for r in rows}}
        want, seen = {}, set()
        for doc, t in sorted({(r[0], r[1]) for r in rows}, key=lambda k: (k[0] is not None, k[0] or 0, tie[k[1]])):
            x, gone, n, later = t or "", set(), 0, []
            for a, b in unit_dedup.spans(x, units):
                unit = tuple(x[a:b].lower().split())
                if unit in seen:
                    later.append((a, b))
                seen.add(unit)
            covered = {i for a, b in later for i in range(a, b)}
            for a, b in later:
                while a > 0 and (a - 1 in covered or not x[a - 1].strip()):
                    a -= 1
                while b < len(x) and (b in covered or not x[b].strip()):
                    b += 1
                if len(x[a:b].split()) >= least:
                    n += 1
                    gone |= {i for i in range(a, b) if i in covered}
            kept = "".join(c for i, c in enumerate(x) if i not in gone)
            size = len(x.encode())
            want[doc, t] = (size, size - len(kept.encode()), n, sum(i - 1 not in gone for i in gone), kept, hashlib.sha256(kept.encode()).hexdigest())
        assert got == Counter((r[0], *want[r[0], r[1]]) for r in rows)
    assert unit_dedup.remove_repeats(none).count() == 0


def test_short_repeats_stay(spark):
    """A run is as long as its units together; white space is no break, other text is. Letters of scripts without spaces count by two."""
    run = "Alpha beta gamma. Delta epsilon zeta eta theta.\n\nIota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."
    han = "".join(chr(0x4E00 + 7 * i) for i in range(44)) + "\u3002"
    texts = [run, "New words here.\n" + run + "\nMore.", "Alpha beta gamma. Other. Delta epsilon zeta eta theta.", "one two. " * 2, han, "\u3042\n" + han, han[:20] + "\u3002" + han[:20] + "\u3002"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in unit_dedup.remove_repeats(df).collect()}
    assert kept == {**dict(enumerate(texts)), 1: "New words here.\n\n\n\nMore.", 5: "\u3042\n"}
    every = {r.doc_id: r.kept_text for r in unit_dedup.remove_repeats(df, min_words=1).collect()}
    assert every[2] == " Other. " and every[3].strip() == "one two."


def test_repeats_across_batches(spark):
    """More rows than a batch holds, in one task, out of order."""
    rng = random.Random(14)
    line = words(rng, 25)
    df = spark.createDataFrame([(i, line + "\n" + words(rng, 3)) for i in rng.sample(range(40), 40)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: r.n_removed for r in unit_dedup.remove_repeats(df).collect()}
        assert got == {i: len(line) if i else 0 for i in range(40)}
        cut = [r.n_removed for r in substring_dedup.removed_spans(df).orderBy("doc_id").collect()]
        assert cut == [x[1] for x in plain_removal([r.text for r in df.orderBy("doc_id").collect()], 100)] and min(cut[1:]) > len(line)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def test_units_keep_offsets(spark):
    passage = "This passage has more than five words in it. And so does this one here."
    df = spark.createDataFrame([(2, f"Début. {passage} Fin"), (1, f"x y, {passage}"), (3, passage.upper())], "doc_id long, text string")
    got = {r.doc_id: r for r in unit_dedup.remove_repeats(df, min_words=5).collect()}
    assert got[1].n_units_removed == 0 and got[1].removed == []
    text = f"Début. {passage} Fin"
    assert [text[s.start : s.end] for s in got[2].removed] == ["And so does this one here."]
    assert got[3].kept_text.strip() == ""


# Token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(docs, rows, none, library, rule):
    got = defaultdict(list)
    for r in token_counts.count_sections(docs, BYTE_BPE, rule).collect():
        got[r.doc_id].append(r)
    width = bpe.load(BYTE_BPE).strings
    want = Counter()
    for doc, t, *_ in rows:
        text = t or ""
        borders = [0, *(i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)), len(text)]
        sections, byte = [0.0] * (len(borders) - 1), 0
        of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
        for i in library.encode(text, add_special_tokens=False).ids:
            n = len(width[i])
            chars = sorted(set(of_byte[byte : byte + n]))
            byte += n
            where = Counter(next(k for k in range(len(sections)) if borders[k] <= c < borders[k + 1]) for c in chars)
            if rule == "share":
                for k, v in where.items():
                    sections[k] += v / len(chars)
            else:
                sections[min(where) if rule == "start" else max(where) if rule == "end" else max(where, key=lambda k: (where[k], -k))] += 1
        for k, n in enumerate(sections):
            want[doc, k, borders[k], borders[k + 1], round(n, 6)] += 1
    assert Counter((r.doc_id, r.section, r.start, r.end, round(r.n_tokens, 6)) for own in got.values() for r in own) == want
    assert token_counts.count_sections(none, BYTE_BPE, rule).count() == 0


def test_fields_and_crossing(spark, library):
    df = spark.createDataFrame([(1, "Hel", "lo wor", "ld", None), (2, None, None, None, None)], "doc_id long, a string, `b.c` string, doc string, z string")
    for rule, want in (("start", [1, 1, 0, 0]), ("end", [0, 1, 1, 0]), ("most", [1, 1, 0, 0]), ("share", [3 / 5, 2 / 5 + 4 / 6, 2 / 6, 0])):
        got = sorted(token_counts.count_fields(df, ["a", "b.c", "doc", "z"], BYTE_BPE, rule, "").filter("doc_id = 1").collect(), key=lambda r: ["a", "b.c", "doc", "z"].index(r.field))
        assert sum(r.n_tokens for r in got) == pytest.approx(len(library.encode("Hello world").ids)) and got[3].n_tokens == 0
        assert [r.n_tokens for r in got] == pytest.approx(want) and [r.n_crossing for r in got] == [1, 2, 1, 0]
    assert token_counts.count_fields(df, ["a"], BYTE_BPE).filter("doc_id = 2").first().n_tokens == 0
    with pytest.raises(ValueError):
        token_counts.count_sections(df.select("doc_id", F.col("a").alias("text")), BYTE_BPE, "random")


def test_other_tokenizers_offsets():
    path = public_tokenizers.path("word_bpe_49k.json")
    starts, ends = token_counts.encoder(path).spans("Some Text,  twice")
    assert ["Some Text,  twice"[a:b] for a, b in zip(starts, ends, strict=True)] == ["Some", "Text", ",", "twice"]
    token_counts.encoder.cache_clear()


def test_suffix_array_and_common_prefixes():
    from grainwise.llm import suffix_array as sa

    rng = np.random.default_rng(4)
    for digits in (1 << 11, 4):
        sa.MOST_NAMES, before = digits, sa.MOST_NAMES
        for _ in range(150):
            s = rng.integers(1, rng.integers(2, 6), rng.integers(1, 150))
            s = np.append(np.tile(s, rng.integers(1, 4)), 0).astype(np.uint8)
            order = sa.suffix_array(s)
            text = s.tolist()
            assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
            lcp = sa.common_prefixes(s, order, (len(s) - np.arange(len(s))).astype(np.int32))
            for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
                n = 0
                while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                    n += 1
                assert lcp[b] == n
        sa.MOST_NAMES = before


# Embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows, vectors = [], []
    for label in (1, 2):
        for _ in range(60):
            c = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                vectors.append((label, (c / np.linalg.norm(c) + rng.normal(0, 0.06, 16)).astype(np.float32)))
    hot = rng.normal(size=16)
    vectors += [(1, (hot + rng.normal(0, 0.01, 16)).astype(np.float32)) for _ in range(60)] + [(1, hot.astype(np.float32))] * 20
    rows = [(i, v.tolist(), label) for i, (label, v) in enumerate(vectors)]
    extra = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] * 16, 1), (9005, rows[0][1], None), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (None, rows[0][1], 1), (0, rows[0][1], 1), (9008, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + extra], "vec_id long, embedding array<float>, label int, n_links int, node string")
    got = embedding_dedup.near_duplicates(df, leaf_rows=32, block=16).collect()
    every = rows + extra
    unit = [None if r[2] is None or not r[1] or any(x is None or not np.isfinite(x) for x in r[1]) or not any(r[1]) else np.array(r[1]) / np.linalg.norm(r[1]) for r in every]
    n, parent = [0] * len(every), list(range(len(every)))
    for i, u in enumerate(unit):
        for j in range(i):
            v = unit[j]
            if u is not None and v is not None and every[i][2] == every[j][2] and len(u) == len(v) and float(u @ v) >= 0.93:
                n[i] += 1
                n[j] += 1
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, r in enumerate(every):
        if r[0] is not None:
            least[find(parent, i)] = min(least.get(find(parent, i), r[0]), r[0])
    want = Counter((r[0], n[i], least.get(find(parent, i))) for i, r in enumerate(every))
    found = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    assert sum((found & want).values()) >= 0.98 * len(every) and sum(r.n_links for r in got) >= 0.98 * sum(n)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if (r.vec_id or 0) in (9001, 9005, 9006)} == {9001: (0, 9001, True), 9005: (0, 9005, True), 9006: (1, 9006, True)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_forest_recall(spark):
    """Pairs just above the threshold, over trees several levels deep."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = base + rng.normal(0, 1, base.shape) * (0.34 / 8)
    v = np.concatenate([base, near]).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    want = sum(int((u[i : i + 500] @ u.T >= 0.93).sum()) for i in range(0, len(u), 500)) - len(u)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(df, leaf_rows=128).agg(F.sum("n_links")).first()[0]
    assert want > 2000 and 0.95 * want <= got <= want


def test_sample_is_bounded_by_components(spark, monkeypatch):
    """Vectors of many dimensions: the trees see a bounded number of components, every vector is indexed."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 1024)).astype(np.float32)
    v = np.concatenate([base, base + rng.normal(0, 0.05, base.shape).astype(np.float32)])
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    seen, fit = [], embedding_dedup.Forest.fit
    monkeypatch.setattr(embedding_dedup.Forest, "fit", lambda self, samples, share: seen.append(sum(x.size for x in samples.values())) or fit(self, samples, share))
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(df, leaf_rows=64, sample_components=200 * 1024).collect()}
    assert 100 * 1024 < seen[0] < 300 * 1024
    assert sum(got[i + 400] == i for i in range(400)) >= 0.95 * 400 and len(got) == 800


# Mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, open_, fixed = sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}
        open_ -= over
    return fixed


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert (r.size, r.source_size) == (size(r.text), sizes[r.source]) and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), block_rows=1000).collect()))
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got) and {r[0] for r in out.select("size").distinct().collect()} <= {7}
    assert mixing.mix(none).count() == 0


def test_mixing_comes_near_in_blocks(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice("abcd") if i % 3 else "hot") for i in range(6000)], "doc_id long, text string, source string")
    out = [mixing.mix(df, block_rows=n).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("copies").alias("copies"), F.count("*").alias("n")).collect() for n in (10, 100_000)]
    for got in out:
        for r in got:
            assert r.taken == pytest.approx(r.target, rel=0.02)
    assert sum(r.target for r in out[0]) == pytest.approx(df.select(F.sum(mixing.words(F.col("text")))).first()[0])


def plain_mix(sizes, target, offset, most=3):
    """Copies of documents, as sizes in the order of the sum; levels and rates as the operator states them."""
    level = [-math.floor(math.log2(n + 1) * 32) for n in sizes]
    total, left, rest, out = offset, target, sum(sizes), []
    plain = target / rest if rest else 0.0
    for lv in sorted(set(level)):
        own = [n for n, x in zip(sizes, level, strict=True) if x == lv]
        n, mean = len(own), sum(own) / len(own)
        rest_after = rest - sum(own)
        rate = min(most, max(0.0, left / rest if rest else plain))
        expected = math.floor(rate * 2**24)
        crossed = (total + expected * n >> 24) - (total >> 24)
        if sum(own):
            wanted = min(max(min(crossed, max(math.floor(left / mean), 0)), math.ceil((left - rest_after * most) / mean - 0.5)), n * most)
            if wanted != crossed:
                expected = min(math.ceil(wanted * 2**24 / n), most << 24)
        for _ in own:
            out.append((total + expected >> 24) - (total >> 24))
            total += expected
        left -= sum(c for c in out[-n:]) * mean
        rest = rest_after
    return out


def test_mixing_is_the_plain_sample(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice((1, 2, 5, 30, 31, 400, 3000)), rng.choice(["a", "b", "c", None, "d"])) for i in range(160)] + [(999, 5000, "d"), (1000, 0, "d")]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, n, s in rows], "doc_id long, text string, source string")
    for block_rows in (3, 1000):
        got = defaultdict(list)
        parts = -(-max(Counter((s, math.floor(math.log2(n + 1) * 32)) for _, n, s in rows).values()) // block_rows)
        mixed = mixing.mix(df, block_rows=block_rows).withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))).withColumn("offset", mixing.offset_of("source", 42))
        for r in mixed.collect():
            got[r.source].append(r)
        for own in got.values():
            own.sort(key=lambda r: (-math.floor(math.log2(r["size"] + 1) * 32), r.part, -r["size"], r.doc_id))
            assert [r.copies for r in own] == plain_mix([r["size"] for r in own], own[0].target, own[0].offset)


def test_mixing_comes_near_with_long_documents(spark):
    """Sources of few documents, of very different sizes; one is half a source. Off by half its smallest documents at most, or 2 %."""
    rng = random.Random(7)
    rows = []
    for s in range(24):
        sizes = [int(rng.paretovariate(0.9) * 20) for _ in range(rng.randint(20, 60))] + [3] * 6
        rows += [(min(n, 20_000), f"s{s:02}") for n in [*sizes, *([sum(sizes)] if s % 5 == 0 else [])]]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate(rows)], "doc_id long, text string, source string")
    for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= max(4, 0.02 * r.target), r


def test_running_sums_by_ranges(spark):
    df = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") % 100 != 0, F.col("id") * 7919 % 1000).alias("k"), (F.col("id") * 7919 % 13).cast("double").alias("v"), F.col("id").alias("i"))
    got = mixing.along(df, [F.col("k").desc_nulls_last(), F.col("i")], {"s": "v"}, "test-along").collect()
    want, total = {}, 0
    for r in sorted(df.collect(), key=lambda r: (r.k is None, -(r.k or 0), r.i)):
        total += r.v
        want[r.i] = total
    assert {r.i: r.s for r in got} == want
    assert mixing.along(df.limit(0), [F.col("k")], {"s": "v"}, "test-along").count() == 0


def test_targets_are_cut_and_shared_again(spark):
    for sizes in ({"a": 1, "b": 500, "c": 499}, {"a": 0, "b": 0}, {"a": 10}, {"a": 1, "b": 1, "c": 1000, None: 3}, {"a": 5, "b": 90, "c": 4, "d": 1}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes)), sizes


# Toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    bad = ["vilor", "grumpex", "scathe"]
    rows, labels = [], []
    for i in range(700):
        w = words(rng, rng.randint(5, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "ian", "oto"]))
        rows.append((i, " ".join(w), rng.choice(["en", "fr", None]), float(i)))
        if i % 7:
            labels.append((i, None if i % 50 == 1 else int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame([*labels, (None, 1), (99_999, 1)], "doc_id long, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    assert "" in model.thresholds and set(model.thresholds) <= {"", "en", "fr"}
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "threshold", "toxic"]
    rows = [r for r in out.withColumn("held", toxicity.held_out()).collect() if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in rows]) >= 0.95
    again = toxicity.train(docs.repartition(5), labels.repartition(3), ~toxicity.held_out())
    assert np.array_equal(model.embeddings, again.embeddings) and model.thresholds == again.thresholds


def test_toxicity_is_fitted_outside_the_driver(spark, labelled, monkeypatch):
    driver, fit = os.getpid(), toxicity.fit

    def elsewhere(*args, **kwargs):
        if os.getpid() == driver:
            raise MemoryError("the sample and the fit don't belong into the driver's memory")
        return fit(*args, **kwargs)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    got = toxicity.train(*labelled)
    monkeypatch.undo()
    rows = labelled[0].join(labelled[1].where("toxic is not null"), "doc_id").select(F.xxhash64("doc_id", F.lit(42)), "doc_id", "text", "lang", "toxic").collect()
    plain = toxicity.learn_from([tuple(r) for r in reversed(rows)], {True: 1.0, False: 1.0}, 42)  # fewer rows than the sample may have
    assert np.array_equal(got.embeddings, plain.embeddings) and np.array_equal(got.weights, plain.weights) and got.thresholds == plain.thresholds


def test_toxicity_of_odd_texts(spark, labelled, docs, none):
    model = toxicity.train(*labelled)
    got = {r.text: r.score for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[None] == got[""] == got[" \t\n"]
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(docs, model).columns == docs.columns
    one = toxicity.Scorer(model)
    long = "grumpex " + "abcd " * 600_000
    alone = [one.scores([t])[0] for t in ("abcd grumpex", "ab", "", None)]
    assert one.scores(["abcd grumpex", "ab", "", None]).tolist() == alone
    assert one.scores([long])[0] == pytest.approx(one.scores(["grumpex abcd abcd abcd"])[0], abs=1e-6)
    for labels in (labelled[1].limit(0), labelled[1].filter("toxic = 0"), labelled[1].filter("toxic = 1")):
        flat = toxicity.score(docs, toxicity.train(labelled[0], labels))
        assert flat.select("score").distinct().count() == 1


def plain_score(model, text):
    """The classifier word by word: every filter at every place, the highest of each, a logistic sum."""
    rows = [[0.0] * toxicity.DIM]  # padding
    vectors = [np.sum([model.embeddings[f].astype(float) for f in toxicity.features(w)], axis=0) for w in toxicity.words_of(text)] or [np.array(rows[0])]
    hidden = []
    for width, filters, bias in zip(toxicity.WIDTHS, model.filters, model.biases, strict=True):
        padded = vectors + [np.zeros(toxicity.DIM)] * (width - 1)
        for f in range(toxicity.FILTERS):
            hidden.append(max(0.0, max(sum(float(padded[at + j] @ filters[j][:, f]) for j in range(width)) + float(bias[f]) for at in range(len(vectors)))))
    z = sum(h * float(w) for h, w in zip(hidden, model.weights, strict=True)) + float(model.bias)
    return 1 / (1 + math.exp(-z))


def test_scores_are_the_plain_ones():
    rng = random.Random(15)
    model = toxicity.Model.new(3)
    model.biases = [b + 0.1 * k - 0.1 for k, b in enumerate(model.biases)]
    model.bias = -0.2
    texts = ["", None, "one", "Two words", *[words(rng, rng.randint(1, 60)) for _ in range(30)], words(rng, 400)]
    got = toxicity.Scorer(model).scores(texts)
    assert got.tolist() == pytest.approx([plain_score(model, t) for t in texts], abs=1e-5)


def test_long_texts_are_pooled_whole():
    """Longer than a piece, with what decides at either end and across a border of pieces."""
    rng = random.Random(16)
    model = toxicity.Model.new(4)
    filler = (words(rng, 500) + " ") * 280  # 140,000 words
    base = filler.split()
    for at in (0, (1 << 16) - 1, 1 << 16, len(base) - 1):
        own = base[:at] + ["decisive", "pair"] + base[at:]
        scorer = toxicity.Scorer(model)
        got = scorer.scores(["short", " ".join(own), "also short"]).tolist()
        line, starts, pad = toxicity.layout([scorer.vocab.numbers(toxicity.words_of(t)) for t in ("short", " ".join(own), "also short")])
        pooled, _ = model.pool(scorer.known[line], starts, pad)  # all at once
        assert got == pytest.approx(toxicity.sigmoid(np.maximum(pooled, 0) @ model.weights + model.bias).tolist(), abs=1e-6)


def test_a_step_goes_down_the_gradient(monkeypatch):
    """One step of training against differences of the loss: the filters, biases and weights move against its derivative."""
    texts, labels = ["good morning to all", "bad vilor words", "more good words", "vilor again"], np.array([0, 1, 0, 1], np.float32)
    seen = {}

    def loss(model):
        s = np.array([plain_score(model, t) for t in texts])
        return float(-(labels * np.log(s) + (1 - labels) * np.log(1 - s)).sum())

    new = toxicity.Model.new
    monkeypatch.setattr(toxicity.Model, "new", staticmethod(lambda seed: seen.setdefault("m", new(seed))))
    monkeypatch.setattr(np.random, "default_rng", lambda seed, real=np.random.default_rng: Steady(real(seed)))
    before = new(5)
    after = toxicity.fit(texts, labels, np.ones(4, np.float32), passes=1, batch=4, rate=1e-4, seed=5)
    before.bias = float(np.log((0.5 + 1e-3) / (0.5 + 1e-3)))
    for name in ("filters", "biases"):
        for k, part in enumerate(getattr(before, name)):
            moved = getattr(after, name)[k] - part
            for at in list(np.ndindex(part.shape))[:: max(1, part.size // 12)]:
                kept, h = part[at], 1e-2
                part[at] = kept + h
                up = loss(before)
                part[at] = kept - h
                slope = (up - loss(before)) / (2 * h)
                part[at] = kept
                if abs(slope) > 1e-2:
                    assert np.sign(moved[at]) == -np.sign(slope), (name, k, at)


class Steady:
    """A generator that leaves no word out."""

    def __init__(self, rng):
        self.rng = rng

    def random(self, n):
        return np.ones(n)

    def __getattr__(self, name):
        return getattr(self.rng, name)


def test_calibration_by_language():
    s = np.array([0.1, 0.2, 0.3, 0.9] * 30)
    y = np.array([0, 0, 1, 1] * 30, np.float32)
    cut = toxicity.calibrate(s, y, np.ones(120, np.float32), ["de"] * 120)
    assert 0.2 < cut["de"] <= 0.3


# The pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark, library):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mix", "bpe"]
    docs, columns, stages = common.read_table(spark, SF, "documents"), None, []
    for name, stage in corpus_pipeline.STAGES:
        columns = columns or docs.columns
        out = common.materialise(stage(spark, docs, SF), f"test-{name}")
        stages.append((docs.toPandas() if "text" in docs.columns else None, out.toPandas()))
        assert name == "bpe" or out.columns == columns
        docs = out
    (all_docs, clean), (_, single), (_, apart), (_, mixed), (_, encoded) = stages
    harsh = set(all_docs[all_docs.text.str.contains(r"\b(?:idiot|moron|stupid|worthless|pathetic|scum|trash|clown|disgusting|loser)\b")].doc_id)
    assert len(harsh - set(clean.doc_id)) >= 0.5 * len(harsh)  # a handful of toxic rows to learn from here
    assert len(set(all_docs.doc_id) - harsh - set(clean.doc_id)) <= 0.02 * len(all_docs)
    assert set(single.doc_id) == set(clean.groupby("text").doc_id.max())
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, re.sub("[A-Z]", lambda m: m[0].lower(), t).split()) for i, t in zip(single.doc_id, single.text, strict=True))}
    ids, parent = sorted(sets), {i: i for i in sets}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= 0.8:
                parent[find(parent, i)] = find(parent, j)
    groups = defaultdict(set)
    for i in ids:
        groups[find(parent, i)].add(i)
    assert set(apart.doc_id) == {min(g) for g in groups.values()}
    counts = mixed.groupby("doc_id").size()
    assert set(counts.index) <= set(apart.doc_id) and counts.max() <= 3
    text = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert Counter(encoded.doc_id) == Counter(mixed.doc_id)
    for r in encoded.itertuples():
        assert list(r.ids) == library.encode(text[r.doc_id], add_special_tokens=False).ids
    again = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(zip(again.doc_id, again.ids_sha256, strict=True)) == Counter(zip(encoded.doc_id, encoded.ids_sha256, strict=True))


def test_queries_are_registered():
    from grainwise.llm import queries

    assert {n.split("_")[0] for n in queries.QUERIES} >= {f"op{i}" for i in range(1, 11)} | {"pipeline"}
