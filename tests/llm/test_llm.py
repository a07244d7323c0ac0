"""The training-text operators against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spoolframe.llm import common, exact_dedup, fingerprints, language_id, mixing, ngram_join, packing, quality, queries, secret_scan, token_counts, token_files, tokenizing
from spoolframe.llm import shingles as shingles_of
from spoolframe.llm.common import components
from spoolframe.llm.tokenizing import Encoder

BYTE, WORD = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [
    (1, "", "en", "a"), (2, None, None, None), (3, " \n\t ", "en", "a"), (4, LONG, "en", "a"), (5, "the same old text", "en", "b"), (5, "the same old text", "en", "b"),
    (6, "the  same\nold text", None, "b"), (7, "ÉÀ ñandú ½ 語 \U0001f600 token: abcdef1234", "fr", "c"), (None, "no id here", "en", "c"), (None, None, None, None), (8, "12345 !!", "de", "c"), (9, LONG, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    names = ["id", "n", "rep", "digit", "rest", "label", "row", "hash", "score", "range", "tail", "start", "ids", "key", "block", "component", "sha", "size"]
    names += ["mean", "mean__", "sums", "sums__", "u", "u__", "rows", "parts", "whole", "carried", "turn", "group", "slot", "word", "bits", "open", "next", "kept_rows__", "sha__", "text__", "score__", "held_out", "c0", "c1", "hot_n", "cold_n", "least", "base", "live", "owner"]
    return df.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_classes(texts, k, num, den):
    s = {i: shingles(t, k) for i, t in texts}
    label = {i: i for i in s}
    find = lambda i: i if label[i] == i else find(label[i])
    ids = sorted(i for i in s if s[i])
    for a in ids:
        for b in ids:
            if a < b and min(len(s[a]), len(s[b])) * den >= max(len(s[a]), len(s[b])) * num:
                both = len(s[a] & s[b])
                if den * both >= num * (len(s[a]) + len(s[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    label[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def near_copies(seed=1, families=25):
    """Families of texts with a few words changed, so similarities spread around the threshold."""
    rng, out, n = random.Random(seed), [], 0
    for _ in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 6, 7, 9, 14, 40, 120]))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            cut = rng.randrange(0, 1 + len(base) // 15)
            out.append((n, " ".join(words[: len(words) - cut])))
            n += 1
    return out


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 8, 10), (2, 8, 10)])
def test_classes_equal_brute_force(spark, k, num, den):
    texts = near_copies(k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string"), k, num, den).collect()}
    assert got == brute_classes(texts, k, num, den)


def test_classes_of_small_trees(spark, monkeypatch):
    """Blocks beyond a tree's size are joined in pairs of chunks and lose nothing."""
    monkeypatch.setattr(ngram_join, "TREE_SHINGLES", 60)
    texts = near_copies(9, 6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == brute_classes(texts, 4, 85, 100)


def strangers_with_a_passage(count=120):
    """Texts that share one long passage and little else, some of them with a near copy; their signatures chain them."""
    rng, out = random.Random(4), []
    passage = [f"p{i}" for i in range(60)]
    for i in range(count):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 60))]
        out.append((len(out), " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
        if not i % 5:
            out.append((len(out), out[-1][1] + " more"))
    return out


@pytest.mark.parametrize("chunk", [7, 8192])
def test_a_common_passage_costs_no_pairs_of_chunks(spark, monkeypatch, chunk):
    """A block of many classes is cut by sketches, so its sets' shingles do not go to every chunk of it."""
    monkeypatch.setattr(ngram_join, "TREE_SHINGLES", 600)
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", chunk, raising=False)
    texts, dealt, placed = strangers_with_a_passage(), [], []
    trees, blocks = ngram_join._tree_links, ngram_join._block_links
    monkeypatch.setattr(ngram_join, "_tree_links", lambda rows, *a: dealt.append(rows.count()) or trees(rows, *a))
    monkeypatch.setattr(ngram_join, "_block_links", lambda kept, block, *a: placed.append(block.groupBy("component").count().agg(F.max("count")).first()[0]) or blocks(kept, block, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_classes(texts, 5, 8, 10)
    assert placed[0] > 100  # they do meet in one block
    assert sum(dealt) <= 2 * len(texts)


def test_sketches_lose_no_link():
    """What sizes and sketches let meet reaches every linked set, and with two sides every linked pair across them."""
    rng = np.random.default_rng(5)
    for num, den in ((85, 100), (8, 10), (1, 2), (1, 4)):
        for _ in range(60):
            members = []
            while len(members) < 24:
                base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64))
                for _ in range(int(rng.integers(1, 4))):
                    less = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.15, 0.4])]
                    members.append(np.unique(np.concatenate([less, rng.integers(0, 1 << 63, int(rng.integers(1, 2 + len(base) // 8)), dtype=np.uint64)])))
            sizes, sketches = [len(m) for m in members], [ngram_join.sketch(m) for m in members]
            for sides in ([0] * len(members), rng.integers(0, 2, len(members)).tolist()):
                parent = list(range(len(members)))
                find = lambda i: i if parent[i] == i else find(parent[i])
                pairs = ngram_join.near_sets(sizes, sketches, sides, num, den)
                for a, b in pairs:
                    assert len(set(sides)) == 1 or sides[a] != sides[b]
                    assert find(a) != find(b)  # they span
                    parent[find(a)] = find(b)
                for a in range(len(members)):
                    for b in range(a):
                        both = len(np.intersect1d(members[a], members[b]))
                        if (len(set(sides)) == 1 or sides[a] != sides[b]) and den * both >= num * (sizes[a] + sizes[b] - both):
                            assert find(a) == find(b)


def test_signatures_and_steps_meet():
    """Every linked pair shares a signature, and enough first steps, whatever its sizes."""
    rng = np.random.default_rng(3)
    for num, den in ((85, 100), (8, 10)):
        for _ in range(1500):
            n = int(rng.integers(1, 90))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a[rng.random(len(a)) > rng.choice([0, 0.05, 0.1])]
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or den * both < num * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            assert len(np.intersect1d(ngram_join.signatures(a, num, den), ngram_join.signatures(b, num, den)))
            for x in (a, b):
                if len(x) - 1 - 2 * len(x) * (den - num) // den >= 1:
                    met = len(np.intersect1d(ngram_join._steps(a, num, den), ngram_join._steps(b, num, den)))
                    assert met >= 1 + (len(x) * num // den) // 25
            assert ngram_join.links_within([a, b], num, den)


def test_odd_classes(odd, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(odd).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[6] == (1, 5) and got[9][1] == 4
    assert ngram_join.jaccard_classes(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 5, 7, 8, None, None])


def union_find(links):
    label = {x: x for l in links for x in l}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {x: find(x) for x in label}


@pytest.mark.parametrize("finish", [0, 100, 1 << 20])
def test_components(spark, monkeypatch, finish):
    """All in rounds over the cluster, a rest of few edges in one task, and all in one task."""
    monkeypatch.setattr(common, "FINISH_EDGES", finish)
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    links += [(5000, 5001 + i) for i in range(300)] + [(7000 + i, 9000) for i in range(300)]  # hubs of the least and of the largest id
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).df.collect()}
    assert got == union_find(links)
    assert components(spark.createDataFrame([], "a long, b long")).df.count() == 0


@pytest.mark.parametrize("finish", [0, 1 << 20])
def test_components_of_a_long_path(spark, monkeypatch, finish):
    """Ascending, descending and mixed ids, alone and with links further on, in no more rounds than a logarithm asks for."""
    monkeypatch.setattr(common, "FINISH_EDGES", finish)
    rng = random.Random(4)
    mixed = rng.sample(range(20_000, 30_000), 1000)
    links = [(i, i + 1) for i in range(2000)] + [(i, j) for i in range(10_000, 10_500) for j in range(i + 1, i + 4)] + list(zip(mixed, mixed[1:]))
    written = []
    keep = common.Written.__init__
    monkeypatch.setattr(common.Written, "__init__", lambda self, df, name: (written.append(name), keep(self, df, name))[1])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).df.collect()}
    assert got == union_find(links)
    assert written.count("names") <= 2 * 11


def test_least_reached_of_paths():
    """A hundred thousand nodes in a path, numbered up, down and at random."""
    for order in (np.arange(100_000), np.arange(100_000)[::-1], np.random.default_rng(1).permutation(100_000)):
        nodes, least = common.least_reached(order[:-1], order[1:])
        assert len(nodes) == 100_000 and (least == 0).all()


def test_no_key_meets_its_rows_in_one_task(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), (F.col("id") % 1900).cast("string"))).alias("k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = {r.id: (r.k, r.n, r.least) for r in common.join_counted(rows, counts, ["k"], "n", "id").collect()}
    want = Counter(k for k, *_ in got.values())
    assert len(got) == 4000 and all(n == want[k] and got[least][0] == k for k, n, least in got.values())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put a small table together
    try:
        parts = common.join_counted(rows, counts, ["k"], "n", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 2000


def test_a_written_table_leaves_no_shuffle(spark):
    """The shuffles of a write are dropped with it, not when the driver collects its garbage; the session's setting stays."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", disk.getAllBlocks().toString()))
    before, setting = shuffled(), spark.conf.get(common._CLEAN_SHUFFLES)
    df = spark.range(1000).groupBy(F.col("id") % 7).count()
    table = common.Written(df, "shuffled")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before
    assert table.df.count() == 7 and df.count() == 7
    assert spark.conf.get(common._CLEAN_SHUFFLES) == setting
    table.drop()


def test_scratch_drops_what_is_written_inside(spark):
    import os

    with common.scratch():
        inner = common.Written(spark.range(3), "inner")
    outer = common.Written(spark.range(3), "outer")
    local = lambda t: t.path.removeprefix("file://").removeprefix("file:")
    assert not os.path.exists(local(inner)) and outer.df.count() == 3
    outer.drop()


def thue_morse(n):
    """Two words of n letters that every polynomial with an odd base takes for one, modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [16, 64, 65, 512, 1024, 2048, 8192])
def test_words_are_known_by_their_bytes(spark, size):
    one, two = thue_morse(size)
    texts = [(1, one), (2, two), (3, f"{one} {two} {one}"), (4, f"{two} {one} {two}")]
    raw = [t.encode() for _, t in texts]
    for path in (BYTE, WORD):
        own = Tokenizer.from_file(path)
        ids, bounds = Encoder(path).encode_many(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for k, (_, t) in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == own.encode(t, add_special_tokens=False).ids
    hashes, _ = shingles_of.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert len(set(hashes.tolist())) == 2
    if size == 1024:
        df = spark.createDataFrame(texts, "doc_id long, text string")
        assert {r.component_id for r in ngram_join.jaccard_classes(df, 1, 85, 100).collect()} == {1, 2, 3} and ngram_join.jaccard_classes(df, 4, 85, 100).where("doc_id = component_id").count() == 4
        machine = token_counts.Automaton(*token_counts.byte_bpe_pieces(BYTE))
        assert [r.n_tokens for r in token_counts.token_counts(df, BYTE).orderBy("doc_id").collect()[:2]] == [machine.count(one.encode()), machine.count(two.encode())]


def test_a_key_that_two_words_share(monkeypatch):
    """Should keys ever meet, the ids are still the library's and the counts each word's own."""
    monkeypatch.setattr(tokenizing, "word_keys", lambda data, starts, lengths: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(token_counts, "word_keys", lambda data, starts, lengths: np.zeros(len(starts), np.uint64))
    texts = ["one two two", "two", "", "a much longer word: " + "x" * 200, "one"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    own = Tokenizer.from_file(BYTE)
    ids, bounds = Encoder(BYTE).encode_many(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    starts, sizes, key = token_counts._words(data, offsets)
    other = shingles_of.strangers(data, starts, sizes, np.zeros(len(starts), np.int64), np.zeros(1, np.int64))
    assert sorted(other.tolist()) == [i for i in range(len(starts)) if data[starts[i] : starts[i] + sizes[i]].tobytes() != b"one"]


def test_classes_of_an_id_with_two_texts(spark):
    """Each text of a repeated id keeps its own links."""
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "pq"]
    texts = [(1, base[0]), (1, base[1]), (2, base[0] + " tail"), (3, base[1] + " tail"), (4, "something else that is long enough"), (5, base[1] + " tail more")]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}


def test_classes_of_a_drifting_chain(spark):
    """Revisions of one page, each linked with the next only, in ascending ids."""
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(110)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(texts, 5, 8, 10)


def test_exact_groups(spark, rows):
    texts = rows + [(10_000 + i, t) for i, t in rows[:20]] + [(20_000, rows[0][1][:200] + "x"), (20_001, rows[0][1] + " tail")]
    want = {}
    for i, t in texts:
        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    for first, wider in ((32, 32), (4, 2)):
        got = exact_dedup.exact_groups(spark.createDataFrame(texts, "doc_id long, text string"), first_digit=first, wider=wider).collect()
        assert len(got) == len(texts)
        lookup = {r.doc_id: r for r in got}
        for t, ids in want.items():
            for i in ids:
                assert (lookup[i].keep_id, lookup[i].group_size, lookup[i].text_sha256) == (min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_groups_of_repeated_and_null_ids(spark):
    """Texts that differ in the first digit only, or in the second only, under one id or none."""
    tail = " the rest of it" * 200
    texts = [(i, head + "-" * 40 + mid + tail) for i in (7, None) for head in ("left ", "right") for mid in ("x", "y") for _ in range(2)]
    got = exact_dedup.exact_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, 7, 4, sha(t)) for i, t in texts)
    for i in (7, None):
        own = spark.createDataFrame([(a, t) for a, t in texts if a == i], "doc_id long, text string")
        for first, wider in ((32, 32), (4, 2)):
            assert Counter((r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(own, first_digit=first, wider=wider).collect()) == Counter((i, 2, sha(t)) for a, t in texts if a == i)


def test_odd_exact(odd, none):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(ODD)
    sizes = {(r.doc_id, r.keep_id): r.group_size for r in got}
    assert sizes[(5, 5)] == 3 and sizes[(6, 5)] == 3 and sizes[(1, 1)] == 3 and sizes[(9, 4)] == 2 and sizes[(None, 1)] == 3
    kept = exact_dedup.drop_exact(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 7, 8, None])
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact(none).count() == 0


def test_languages(spark, docs, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(big, language_id.train(big)).join(big.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)
    model = language_id.train(odd)
    pred = language_id.identify(odd, model).collect()
    assert len(pred) == len(ODD) and Counter(r.lang_pred for r in pred if r.doc_id in (1, 2, 3, 8)) == {"und": 4}
    assert language_id.identify(none, language_id.train(none)).count() == 0
    assert language_id.identify(docs, language_id.train(none)).where("lang_pred = 'und' AND score = 0").count() == docs.count()
    assert language_id.family("pt-BR") == "romance" and language_id.family("zz") == "zz"


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_library(rows, path):
    enc, own = Encoder(path), Tokenizer.from_file(path)
    own.encode_special_tokens = True
    texts = [t for _, t in rows[:40]] + [t or "" for _, t, *_ in ODD] + ["it's we'LL  \n\n x", "İstanbul ΣΑΣ", " a", " \n a", "a\n", "a \t\n\n", "\na", "× ÷ É×", "a1b22 3..!!\n\n b  c", "<|endoftext|> x", "''s !'s", "x\x00y\x1cz", "naïve—“ok”"]
    raw = [t.encode() for t in texts]
    ids, bounds = enc.encode_many(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == own.encode(t, add_special_tokens=False).ids, t[:60]


def test_packing(docs, rows, odd, none):
    own = Tokenizer.from_file(BYTE)
    for window in (1024, 100):
        got = packing.pack(docs, BYTE, window).toPandas()
        for i, t in rows[:60]:
            ids = [*own.encode(t, add_special_tokens=False).ids, 0]
            h = got[got.doc_id == i].sort_values("start")
            assert list(np.concatenate([np.frombuffer(x, "<u4") for x in h.ids])) == ids and h.start.tolist() == [0, *np.cumsum(h.length)[:-1]] and set(h.doc_tokens) == {len(ids)}
        by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        assert ((by.length.cumsum() - got.length).reindex(got.index) == got.offset).all()
        sizes = by.length.sum()
        assert sizes.max() <= window
        if window == 1024:
            assert sum(0 if n & (n - 1) == 0 else window - n for n in sizes) < 0.01 * got.length.sum()
    pieces = packing.pack(odd, BYTE).toPandas()
    assert len(pieces[pieces.start == 0]) == len(ODD) and packing.pack(none, BYTE).count() == 0


def test_packer_memory_is_bounded():
    """Pieces of which no two share a window: windows are closed as they pile up, and no token is lost."""
    p = packing.Packer(1024, most=200_000)
    sequences, most, tokens = Counter(), 0, Counter()
    for n in range(100_000):
        for who, start, size, _, sequence, offset, ids in p.add(n, 0, np.zeros(600, np.uint32), 600):
            assert offset == sequences[sequence] and len(ids) == size
            sequences[sequence] += size
            tokens[who] += size
        most = max(most, sum(len(x[4]) for level in p.open for window in level for x in window))
        assert n % 5000 or p.held == sum(len(x[4]) for level in p.open for window in level for x in window)
    for who, _, size, _, sequence, _, _ in p.finish():
        sequences[sequence] += size
        tokens[who] += size
    assert most <= 200_000 and set(tokens.values()) == {600} and len(tokens) == 100_000 and max(sequences.values()) <= 1024
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sequences.values()) < 0.01 * 60_000_000


def test_packer_takes_the_least_squares():
    p = packing.Packer(10)
    level = Counter()
    rng = random.Random(5)
    for n in range(400):
        s = rng.randrange(1, 10)
        cost = {}
        for h in [0, *(h for h in level if level[h])]:
            if h + s <= 10:
                after = level.copy()
                if h:
                    after[h] -= 1
                if h + s < 10:
                    after[h + s] += 1
                cost[h] = sum(v * v for v in after.values())
        best = max(h for h, c in cost.items() if c == min(cost.values()))
        list(p.add(n, 0, np.zeros(s, np.uint32), s))
        if best:
            level[best] -= 1
        if best + s < 10:
            level[best + s] += 1
        assert all(p.level[h] == level[h] == len(p.open[h]) for h in range(1, 10))


def test_token_counts(docs, rows, odd, none):
    first, rest = token_counts.byte_bpe_pieces(BYTE)

    def greedy(word):
        n, at = 0, 0
        while at < len(word):
            stop = next((j for j in range(len(word), at, -1) if word[at:j] in (first if at == 0 else rest)), None)
            if stop is None:
                return -1
            n, at = n + 1, stop
        return n

    machine = token_counts.Automaton(first, rest)
    small = token_counts.Automaton({b"a", b"abc", b"abcdx"}, {b"b", b"cd", b"d", b"dz"})
    pieces = ({b"a", b"abc", b"abcdx"}, {b"b", b"cd", b"d", b"dz"})
    rng = random.Random(2)
    first_, rest_ = first, rest
    for word in {w for _, t in rows[:20] for w in t.encode().split()}:
        assert machine.count(word) == greedy(word)
    first, rest = pieces
    for _ in range(3000):
        word = bytes(rng.choice(b"abcdxz") for _ in range(rng.randrange(1, 9)))
        assert small.count(word) == greedy(word), word
    first, rest = first_, rest_
    got = {r.doc_id: r for r in token_counts.token_counts(docs, BYTE).collect()}
    for i, t in rows[:30]:
        found = re.findall(rb"[^\x20\x09-\x0d]+", t.encode())
        assert (got[i].n_words, got[i].n_tokens) == (len(found), sum(map(greedy, found)))
    assert token_counts.token_counts(odd, BYTE).count() == len(ODD) and token_counts.token_counts(none, BYTE).count() == 0


def test_votes_are_counted_pair_by_pair():
    rng = np.random.default_rng(5)
    model = language_id.LanguageModel(["f"], {"f": list("abcd")}, {"f": [(i, j) for i in range(4) for j in range(i + 1, 4)]}, {"f": rng.normal(size=(6, 8))})
    x = rng.normal(size=(300, 7))
    best, trust = model._vote("f", 4, x)
    for row, got, sure in zip(x, best, trust):
        wins, sums, worst = [0] * 4, [0.0] * 4, [math.inf] * 4
        for (i, j), w in zip(model.pairs["f"], model.weights["f"]):
            m = float(row @ w[:-1] + w[-1])
            for k, side in ((i, m), (j, -m)):
                wins[k] += side >= 0 if k == i else side > 0
                sums[k] += max(-1.0, min(1.0, side))
                worst[k] = min(worst[k], side)
        rank = [(wins[k] + sums[k] / 16, -k) for k in range(4)]
        assert got == max(range(4), key=lambda k: rank[k]) and abs(sure - 1 / (1 + math.exp(-3 * worst[got]))) < 1e-9


def test_svm_is_near_the_best_plane():
    """With enough rounds no plane that a long descent finds has a clearly smaller loss; the rounds that training takes stop before that."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x @ rng.normal(size=5) + 0.5 * rng.normal(size=200) > 0.3, 1.0, -1.0)
    wide = np.hstack([x, np.ones((200, 1))])

    def loss(w, c=8.0):
        return 0.5 * w @ w + c * (np.maximum(0, 1 - y * (wide @ w)) ** 2).sum()

    w = np.zeros(6)
    for _ in range(20_000):
        gap = np.maximum(0, 1 - y * (wide @ w))
        w -= 2e-4 * (w - 16.0 * (gap * y) @ wide)
    assert loss(language_id.svm(x, y, epochs=2000)) <= 1.01 * loss(w)
    assert (np.sign(wide @ language_id.svm(x, y)) == y).mean() >= (np.sign(wide @ w) == y).mean() - 0.05


def test_shallow_trees_take_the_best_cut():
    rng = np.random.default_rng(9)
    gain = lambda g, h: g * g / (h + 1)
    for _ in range(50):
        g, h = rng.normal(size=7), rng.random(7) + 0.1
        cuts = [(gain(g[:k].sum(), h[:k].sum()) + gain(g[k:].sum(), h[k:].sum()), k) for k in range(1, 7)]
        best, k = max(cuts)
        want = np.concatenate([np.full(k, g[:k].sum() / (h[:k].sum() + 1)), np.full(7 - k, g[k:].sum() / (h[k:].sum() + 1))])
        if best <= gain(g.sum(), h.sum()) + 1e-9:
            want = np.full(7, g.sum() / (h.sum() + 1))
        assert np.allclose(quality._shallow(g, h, 1), want)
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
        parts = lambda v, i, j: [v[:i, :j].sum(), v[:i, j:].sum(), v[i:, :j].sum(), v[i:, j:].sum()]
        best, i, j = max((sum(map(gain, parts(g, i, j), parts(h, i, j))), i, j) for i in range(1, 4) for j in range(1, 5))
        got, value = quality._quadrants(g, h)
        assert abs(got - best) < 1e-9 and np.allclose([value[0, 0], value[0, -1], value[-1, 0], value[-1, -1]], [a / (b + 1) for a, b in zip(parts(g, i, j), parts(h, i, j))])
    x = rng.random((500, 3))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=9)
    for row, got in zip(x[:50], model.margin(x[:50])):
        b = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.cuts)]
        assert abs(got - (model.base + sum(t[k] for t, k in zip(model.tables, b)) + sum(t[b[i], b[j]] for (i, j), t in zip(model.pairs, model.pair_tables)))) < 1e-9


def test_sketch_holds_the_least_of_each_cell():
    rng = np.random.default_rng(4)
    for n in (1, 2, 40, 900):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        least = {}
        for h in hashes.tolist():
            c = (h >> 40) % 128
            least[c] = min(h, least.get(c, h))
        want = []
        for c in range(128):
            k = next(k for k in range(128) if (c + k) % 128 in least)
            source = (c + k) % 128
            far = (c - source) % 128
            want.append(int(shingles_of.mix(np.array([least[source] + far], np.uint64))[0]) & 0xFFFF)
        assert fingerprints.sketch(hashes).tolist() == want
    a, b = (fingerprints.sketch(np.array(v, np.uint64)) for v in ([1 << 41, 5 << 45], [1 << 41, 7 << 45]))
    assert fingerprints.likeness(a, b) == sum(x == y for x, y in zip(a.tolist(), b.tolist())) / 128


def test_long_lists_of_spans(spark):
    """A text with tens of thousands of matches costs no square of them."""
    text = " ".join(f"token={i:06d} {'0a' * 12}" for i in range(20_000))
    got = secret_scan.secret_report(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).first()
    assert (got.n_assign, got.n_hex) == (20_000, 20_000) and got.base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.shared_folder(type("Session", (), {"sparkContext": Context}))


def test_repeated_ids_teach_once(spark):
    """However often an id is repeated, one row of it is gathered."""
    rows = [(1, f"text {i}", "en") for i in range(500)] + [(i, "der die das " * i, "de") for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    keep = language_id.fit
    language_id.fit = lambda x, languages: (seen.update(n=len(x)), keep(x, languages))[1]
    try:
        language_id.train(df)
    finally:
        language_id.fit = keep
    assert seen["n"] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(1, 30))


def test_quality(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    big, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.quality_scores(big, quality.train(big, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    lab = spark.createDataFrame([(4, 1), (5, 0), (5, None), (7, 0), (None, 1), (8, 3)], "doc_id long, quality int")
    scored = quality.quality_scores(odd, quality.train(odd, lab)).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality.quality_scores(odd, quality.train(odd, lab.limit(0))).collect()} == {0.5}
    assert quality.quality_scores(none, quality.train(none, lab)).count() == 0
    assert quality.keep_good(odd, lab).columns == odd.columns
    x = np.random.default_rng(0).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95  # only the pair tells


def test_mixing(docs, odd, none):
    got = mixing.mix_sources(docs, seed=3).collect()
    n, counts = docs.count(), Counter(r.source for r in docs.collect())
    by = Counter(r.source for r in got)
    assert abs(len(got) - n) < 5 * n**0.5 and all(abs(by[s] - n / len(counts)) < 6 * (n / len(counts)) ** 0.5 for s in counts)
    assert sorted((r.doc_id, r.copy) for r in got) == sorted((r.doc_id, r.copy) for r in mixing.mix_sources(docs.repartition(7), seed=3).collect())
    assert all(r.copy < r.copies for r in got)
    one = mixing.mix_sources(docs, {"src0": 1.0}, total=4000).collect()
    assert {r.source for r in one} == {"src0"} and abs(len(one) - 4000) < 400
    many = mixing.mix_sources(odd, total=20_000)
    assert abs(many.count() - 20_000) < 1500 and set(odd.columns) <= set(many.columns)
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_sources(docs, {}).count() == 0
    drawn = docs.sparkSession.range(20_000).select(mixing.poisson_sums(F.lit(2.5)).alias("sums"), mixing.uniform(F.lit(1), F.col("id")).alias("u"))
    u = drawn.select(mixing.poisson(F.col("sums"), F.col("u")).alias("k"))
    mean, var = u.agg(F.avg("k"), F.var_pop("k")).first()
    assert abs(mean - 2.5) < 0.06 and abs(var - 2.5) < 0.15


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 20])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001).astype("<u4")
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and (token_files.unpack_bits(data, bits, len(ids)) == ids).all()


def test_token_files(spark, docs, rows, odd, none, tmp_path):
    own = Tokenizer.from_file(WORD)
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_token_files(docs, WORD, folder, partitions=3)
    got = token_files.read_token_files(spark, manifest, folder).orderBy("doc_id").collect()
    at = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = [*own.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids and r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
    assert [m[1] for m in manifest] == sorted(m[1] for m in manifest) and token_files.bits_for(own.get_vocab_size()) == 16
    with pafs.LocalFileSystem().open_input_file(manifest[0][0]) as f:
        reader = token_files.Reader(f)
        k = len(reader.docs) - 1
        assert reader.document(k).tolist() == [*own.encode(dict(rows)[int(reader.docs[k])], add_special_tokens=False).ids, 2]
        assert (reader.ids(5, 20_000) == np.concatenate([reader.document(j) for j in range(k + 1)])[5:20_000]).all()
    assert token_files.token_files(odd, WORD).count() == sum(r[0] is not None for r in ODD) and token_files.token_files(none, WORD).count() == 0


def test_fingerprints(spark, docs, rows, odd, none):
    got = {r.doc_id: r for r in fingerprints.next_fingerprints(docs).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(fingerprints.fingerprint, (t, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.hexed(a), fingerprints.hexed(b)) and (r.near_edited, r.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    assert np.mean([r.near_edited for r in got.values()]) > 0.2 > 0.05 > np.mean([r.near_next for r in got.values()])
    assert fingerprints.next_fingerprints(odd).count() == len(ODD) and fingerprints.next_fingerprints(none).count() == 0
    single = fingerprints.next_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert single.near_next == 1.0 and single.n_chars == 4
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    at, _ = fingerprints.syncmers(data, 16, 9)
    small = fingerprints._windows(data, 9)
    assert at.tolist() == [i for i in range(len(data) - 15) if min(small[i : i + 8]) in (small[i], small[i + 7])]
    assert fingerprints.anchors(odd).count() == len(ODD)


KINDS = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def base_spans(text):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, p, group, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(spark, docs, rows, odd, none):
    got = {r.doc_id: r for r in secret_scan.secret_report(docs).collect()}
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if not s.startswith("live")] == (base_spans(t).split(",") if base_spans(t) else [""]) or not got[i].spans
    key, shared = "Zx9" + "aB3" * 11, "Qw8" + "eR5" * 11
    texts = [(1, f"\U0001f600 secret: token: abcdefg and password='hunter2x'", "a"), (2, key, "a"), (3, f"see {shared}", "a"), (4, shared, "b"), (5, "AKIA" + "Z" * 16 + " " + "0a" * 12, "c")]
    report = {r.doc_id: r for r in secret_scan.secret_report(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()}
    for i, t, _ in texts:
        assert report[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest()
    assert report[2].spans == f"live:0:{len(key)}" and report[3].spans == "" and report[4].spans == "" and report[5].n_access == 1 and report[5].n_hex == 1
    assert secret_scan.secret_report(odd).count() == len(ODD) and secret_scan.secret_report(none).count() == 0
    assert secret_scan.secret_report(odd.drop("source")).count() == len(ODD)


def test_secret_plan_has_no_python(docs):
    plan = secret_scan.secret_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_queries_equal_their_sql(spark, data):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{data}/documents.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, data).toPandas(), c.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert Counter(map(tuple, got[columns].astype(str).to_numpy())) == Counter(map(tuple, want[columns].astype(str).to_numpy())), name


def test_pipeline(spark, data, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, data)
        before, after = seen.collect(), out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if name == "exact dedup":
            least = {}
            for r in before:
                t = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
                least[t] = min(least.get(t, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(least.values())
        if name == "n-gram Jaccard join":
            classes = brute_classes([(r.doc_id, r.text) for r in before], 5, 8, 10)
            assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in classes.items() if i == c)
        if name == "quality classifier":
            assert 0.7 * len(before) < len(after) < len(before)
            model = quality.train(seen, spark.read.parquet(f"{data}/labels.parquet"))
            raw = [(r.text or "").encode() for r in before]
            score = [model.score(quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0] for t in raw]
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, v in zip(before, score) if v >= 0.5)
        if name == "mixing sources":
            size = Counter(r.source for r in before)
            want = Counter()
            for r in before:
                mean = len(before) / len(size) / size[r.source]
                u = int(hashlib.md5(f"0|{r.doc_id}|0".encode()).hexdigest()[:13], 16) / (1 << 52)
                k, chance = 0, math.exp(-mean)
                total = chance
                while total <= u:
                    k += 1
                    chance *= mean / k
                    total += chance
                want[r.doc_id] += k
            assert Counter(r.doc_id for r in after) == +want
        seen = spark.createDataFrame(after, out.schema)
    total = lambda df: df.groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id").collect()  # noqa: E731  where pieces are cut follows the partitions
    assert set(seen.columns) >= {"doc_id", "sequence_id", "ids"} and total(corpus_pipeline.run(spark, data)) == total(seen)
    left = odd
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, data)
    assert left.count() > 0
