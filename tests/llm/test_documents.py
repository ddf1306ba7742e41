"""Operators on documents against brute force, and their edge cases."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from polymodal.llm import exact_dedup, language, licenses, lm_scoring, mixing, packing, simhash, token_files
from polymodal.llm._base import TokenCoder
from polymodal.llm.queries import queries, tokenizer_path

#: Null ids, texts and sources, empty and very long texts, exact and near copies, repeated rows and ids, a column with a clashing name.
LONG = "Word number that goes on, and on. " * 6000
ODD = [
    (1, "Hello big wide world of words", "a", "en", "x"), (2, "hello BIG wide world of words", "a", "en", "x"), (2, "hello BIG wide world of words", "a", "en", "x"), (3, None, None, None, "x"),
    (4, "", "b", "en", "x"), (None, "hello big wide world of words", "b", None, None), (None, None, None, None, None), (5, LONG, "b", "en", "x"), (6, LONG.upper(), "c", "de", "x"), (7, "Ärger ÄRGER straße", "c", "de", "x"),
    (8, "ärger ÄRGER straße", "c", "de", "x"), (9, "  \n\t ", "c", "fr", "x"), (10, "12 34 !! ##", "d", "fr", "x"), (11, "one", "d", "en", "x"), (11, "one", "d", "en", "x"), (13, "a token <|endoftext|> in text", "d", "en", "x"), (12, "Licensed under the Apache License, Version 2.0.", "d", "en", "x"),
]
SCHEMA = "doc_id long, text string, source string, lang string, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def fold(t):
    return (t or "").encode().lower()


def test_exact_dedup_matches_grouping(odd, table):
    for docs in (odd, table):
        rows = [(r["doc_id"], fold(r["text"])) for r in docs.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        got = exact_dedup.exact_dedup(docs).collect()
        want = Counter((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t).hexdigest()) for i, t in rows)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        kept = Counter(r["text_sha256"] for r in got if r["kept"])
        assert set(kept.values()) == {1} and len(kept) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_deduplicated_keeps_one_row_of_each_text(odd, empty):
    got = exact_dedup.deduplicated(odd)
    assert got.columns == odd.columns
    texts = [fold(r["text"]) for r in got.collect()]
    assert sorted(texts) == sorted({fold(r[1]) for r in ODD})
    assert exact_dedup.deduplicated(empty).count() == 0 == exact_dedup.exact_dedup(empty).count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 9)), st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 9)), st.integers(1, 16))
def test_quotient_filters_merge_without_loss(a, b, q):
    Q = exact_dedup.CountingQuotientFilter
    f = Q.from_bytes(Q.of(np.array(a, np.uint64), quotient_bits=q).to_bytes()).merge(Q.of(np.array(b, np.uint64), quotient_bits=q))
    assert dict(zip(f.fingerprints(0).tolist(), f.counts.tolist())) == Counter(a + b)


def plain_simhash(text):
    words = fold(text).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = [plain_simhash(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return Counter((i, f"{fps[k]:016x}", least[root(k)]) for k, (i, _) in enumerate(rows))


def test_simhash_matches_all_pairs(spark, odd, table, empty):
    for docs in (odd, table, empty):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = simhash.simhash_classes(docs).collect()
        assert Counter(tuple(r) for r in got) == plain_classes(rows)
    assert simhash.one_of_each(odd).columns == odd.columns


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(0, 3))
def test_trie_walk_finds_every_pair(seed, n, budget):
    rng = random.Random(seed)
    some = [rng.getrandbits(64) for _ in range(3)]
    x = np.unique(np.array([rng.choice(some) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(1) << rng.randrange(64)) for _ in range(n)], np.uint64))
    y = np.unique(np.array([rng.choice(some) ^ (1 << rng.randrange(64)) for _ in range(n)], np.uint64))
    for a, b, same in ((x, x, True), (x, y, False)):
        found = set()
        simhash.trie_links(a, b, budget, same, lambda i, j: found.update(zip(i.tolist(), j.tolist())))
        assert found == {(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= budget and (i < j or not same)}


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(0, 4095), st.integers(1, 50), min_size=1, max_size=30), st.integers(1, 60))
def test_subtree_pairs_cover_all_close_prefixes(counts, largest):
    leaf, pairs = simhash.subtree_pairs(counts, 2, largest)
    have = {(i, j) for i, j, _ in pairs}
    for a in counts:
        for b in counts:
            if (a ^ b).bit_count() <= 2:
                i, j = sorted((int(leaf[a]), int(leaf[b])))
                assert (i, j) in have


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(350)] + [(-5, 1000 + i) for i in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()} == want


@functools.cache
def library(name):
    return Tokenizer.from_file(tokenizer_path(name))


@functools.cache
def own_coder(name):
    return TokenCoder(tokenizer_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text() | st.text(alphabet="ab 's\n\t\r  \x1c\x85 12!#éÉßΣ́<|endoftext|>"), max_size=4))
def test_coder_equals_the_library(name, texts):
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own_coder(name)(texts)] == want


def test_strings_of_added_tokens_get_their_ids():
    texts = ["hello <|endoftext|> x", "plain", "", "<|endoftext|>", "<|ENDOFTEXT|> y", "<|startoftext|>a<|endoftext|>"]
    for name, ids in (("byte_bpe_50k.json", [31373, 220, 50256, 2124]), ("word_bpe_49k.json", [3306, 49407, 343])):
        got = [np.frombuffer(x, "<u4").tolist() for x in own_coder(name)(texts)]
        assert got == [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)] and got[0] == ids
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    assert [np.frombuffer(x, "<u4").tolist() for x in TokenCoder(tokenizer_path("byte_bpe_50k.json"), plain=True)(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def encoded(docs, name, end):
    t = library(name)
    return [(r["doc_id"], np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [end], "<u4")) for r in docs.collect()]


def test_packing_is_a_gapless_cut_of_all_tokens(odd, table, empty):
    for docs, bound in ((odd, 1.1), (table, 1.05)):
        path = tokenizer_path("byte_bpe_50k.json")
        rows = packing.pack(docs, path).collect()
        want = Counter()
        for i, ids in encoded(docs, "byte_bpe_50k.json", 0):
            for k, (s, n) in enumerate(packing.pieces(len(ids), 2048)):
                want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
                assert n == 2048 or k == 0
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 2048) * bound + 1
    assert packing.pack(empty, path).count() == 0


def test_packing_keeps_ids(odd):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack(odd, path, capacity=128, keep_ids=True)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows.collect())
    whole = packing.sequences(rows).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and r["n_tokens"] <= 128 for r in whole)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_bins(lengths):
    bins = packing.best_fit(np.array(lengths, np.int64), 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fill = [sum(lengths[i] for i in b) for b in bins]
    assert all(x <= 50 for x in fill) and sum(2 * x <= 50 for x in fill) <= 1


def test_token_files_round_trip(spark, odd, table, empty):
    path = tokenizer_path("word_bpe_49k.json")
    for docs in (odd, table):
        folder, shards = token_files.write_token_files(docs, path, length=64)
        got = sorted(map(tuple, token_files.read_token_files(spark, folder, shards).collect()), key=lambda r: r[1])
        rows = encoded(docs, "word_bpe_49k.json", 1)
        assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x))
        assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
        assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in rows)
    assert token_files.read_token_files(spark, *token_files.write_token_files(empty, path)).count() == 0


def test_token_file_access_and_masks(tmp_path):
    for wide, top in ((False, 60_000), (True, 90_000)):
        ids = np.random.default_rng(1).integers(0, top, 64 * 5 * 64 + 17).astype(np.uint32)
        path = str(tmp_path / f"{wide}.arrow")
        with open(path, "wb") as f:
            w = token_files.TokenWriter(f, 64, wide)
            for part in np.array_split(ids, 23):
                w.append(part)
            w.close()
        t = token_files.TokenFile(f"file://{path}")
        assert t.tokens(0, len(ids)).tolist() == ids.tolist() and t.tokens(4090, 12).tolist() == ids[4090:4102].tolist()
        assert t.sequence(3).tolist() == ids[192:256].tolist() and not t.sequence(3).flags.owndata
        rows = -(-len(ids) // 64)
        assert all(t.mask(0).to_pylist()) and t.mask(rows - 1).to_pylist() == [True] * 17 + [False] * 47
        assert t.mask(3).buffers()[1].address == t.mask(3).buffers()[1].address == t.mask(4).buffers()[1].address  # views of the mapped bits


def fill_up(sizes, weights, budget, most):
    left, goal, open_ = budget * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / w >= most * sizes[i]}
        if not full:
            for i in open_:
                goal[i] = left * weights[i] / w
            break
        for i in full:
            goal[i] = most * sizes[i]
        left -= sum(goal[i] for i in full)
        open_ -= full
    return goal


def test_mixing_meets_targets(odd, table, empty):
    for docs in (odd, table):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        sizes = defaultdict(int)
        for r in rows:
            sizes[r["source"]] += r["size"]
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        goal = dict(zip(names, fill_up([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)))
        taken = defaultdict(int)
        for r in rows:
            assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
            assert r["taken"] >= r["size"] * (int(r["target"] / sizes[r["source"]]) if sizes[r["source"]] else 0)  # whole epochs come first
            taken[r["source"]] += r["taken"]
        assert all(goal[s] - 3 <= taken[s] <= goal[s] + 1e-6 for s in names)
        assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, rows))
    assert mixing.mix(empty).count() == 0 == mixing.mixed(empty).count()


def test_mixed_rows_agree_with_what_is_taken(table):
    taken = {r["doc_id"]: r for r in mixing.mix(table).collect()}
    times = Counter(r["doc_id"] for r in mixing.mixed(table).collect())
    odd_ones = [i for i, r in taken.items() if r["size"] and times[i] * r["size"] != r["taken"]]
    assert len(odd_ones) <= 20  # one document a source at most ends the sample


def test_quality_weights_favour_documents(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * 10, "s" if i % 2 else "t", i % 4 < 2) for i in range(4000)], "doc_id long, text string, source string, good boolean")
    rows = mixing.mix(docs, weights=(1.0,), budget=0.3, quality=F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0)).collect()
    good = sum(r["taken"] for r in rows if r["doc_id"] % 4 < 2)
    assert good / sum(r["taken"] for r in rows) > 0.65


def plain_bits(sample, text):
    """Bits of the greedy cross-parsing by substring search."""
    n = unseen = 0
    for first in range(0, len(text), language.BLOCK):
        block, at = text[first : first + language.BLOCK], 0
        while at < len(block):
            k = 0
            while at + k < len(block) and block[at : at + k + 1] in sample:
                k += 1
            n, unseen, at = n + 1, unseen + (k == 0), at + max(1, k)
    return n * math.log2(len(sample) + 1) + unseen * language.UNSEEN


def test_mixing_with_any_weights_and_column_names(spark, table, empty):
    """Weights far from one, none above zero, and columns that the operator might use itself."""
    from pyspark.sql import functions as F

    for quality in (F.lit(0.001), F.lit(0.0), F.lit(1e9), F.lit(None).cast("double"), F.when(F.col("doc_id") % 2 == 0, 1e-6).otherwise(-1.0)):
        rows = mixing.mix(table, quality=quality).collect()
        taken, target = defaultdict(int), {}
        for r in rows:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        assert all(target[s] - 3 <= taken[s] <= target[s] + 1e-6 for s in target)
    keyed = table.select(*mixing._keyed(table, "doc_id", "text", "source", F.lit(0.001), 0))
    slices = keyed.groupBy(F.floor(F.log2("__key") * mixing.SLICES)).count().agg(F.max("count")).first()[0]
    assert slices <= 8  # of 200 rows
    named = table
    for c in ("epochs", "at_key", "at_id", "at_size", "at_taken", "__key", "__row", "a.b", "target", "rest", "source_size", "whole", "col"):
        named = named.withColumn(c, F.col("doc_id"))
    assert mixing.mixed(named).columns == named.columns
    assert Counter(r["doc_id"] for r in mixing.mixed(named).collect()) == Counter(r["doc_id"] for r in mixing.mixed(table).collect())


def test_token_files_ignore_what_lost_attempts_left(spark, odd):
    path = tokenizer_path("word_bpe_49k.json")
    folder, shards = token_files.write_token_files(odd, path, length=64)
    want = sorted(map(str, token_files.read_token_files(spark, folder, shards).collect()))
    here = folder.removeprefix("file://")
    for name, _ in shards[:1]:
        for kind in ("shard", "index"):
            with open(f"{here}/{kind}-{name}x.arrow", "wb") as f:
                f.write(b"half")
    assert sorted(map(str, token_files.read_token_files(spark, folder, shards).collect())) == want
    many = spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder, shards = token_files.write_token_files(many, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shards) > 1 and token_files.read_token_files(spark, folder, shards).count() == 400  # rows without an id are spread too


class TestLanguage:
    def test_automaton_knows_all_substrings(self):
        text = "abracadabra abra"
        a = language.SuffixAutomaton(text)
        for s in ("abrac", "cad", "xabra", "", "abra abra", "dabraz"):
            assert a.longest(s) == max(k for k in range(len(s) + 1) if s[:k] in text)

    @settings(max_examples=40, deadline=None)
    @given(st.integers(0, 2**32), st.integers(1, 5))
    def test_bits_match_substring_search(self, seed, n_langs):
        rng = random.Random(seed)
        samples = {f"l{k}": "".join(rng.choice("abcdeß "[k:]) for _ in range(rng.choice([1, 30, 200]))) for k in range(n_langs)}
        texts = ["".join(rng.choice("abcdeßq ") for _ in range(rng.choice([1, 7, 80, 2500]))) for _ in range(12)]
        model = language.CrossParser(samples)
        assert np.allclose(model.bits(texts), [[plain_bits(samples[k], t) for t in texts] for k in model.langs])

    def test_predictions_match_brute_force(self, spark, table):
        """Every row's language and score from the samples alone, by substring search."""
        samples = language.training_samples(table.where(~language.held_out("doc_id")))
        got = {r["doc_id"]: r for r in language.identify_with_own_labels(table).collect()}
        for r in table.where("doc_id % 8 = 0").collect():
            letters = language.letters_of(r["text"])
            bits = {k: plain_bits(v, letters) for k, v in samples.items()}
            first, second = sorted(bits.values())[:2]
            assert got[r["doc_id"]]["lang_pred"] == min(bits, key=lambda k: (bits[k], k))
            assert got[r["doc_id"]]["score"] == pytest.approx(1 - first / second)

    def test_held_out_accuracy(self, spark):
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
        rows = language.identify_with_own_labels(docs).collect()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
        held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
        assert len(held) > 100 and sum(held) / len(held) > 0.97
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert language.with_language(docs).count() == docs.count()  # clean documents stay

    def test_every_language_is_learnt_and_little_text_is_enough(self, spark):
        """70 languages with letters of their own; and one with 1/300 of another's text."""
        rng = random.Random(9)

        def text(k, n):
            letters = [chr(0x61 + (k * 7 + i * 5) % 26) for i in range(9)]
            vocabulary = random.Random(k)
            words = ["".join(vocabulary.choice(letters) for _ in range(vocabulary.randrange(2, 8))) for _ in range(60)]
            return " ".join(rng.choice(words) for _ in range(n))

        rows = [(100 * k + i, text(k, 80), f"l{k:02d}") for k in range(70) for i in range(8)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = {r["doc_id"]: r["lang_pred"] for r in language.identify_with_own_labels(df).collect()}
        assert len(set(got.values())) == 70 and sum(got[i] == k for i, _, k in rows) / len(rows) > 0.95
        german = "der hund und die katze gehen heute mit uns in den garten und das wetter ist sehr gut weil die sonne scheint und wir alle spazieren wollen im schnee"
        english = "the dog and the cat go with us to the garden today and the weather is very good because the sun shines and we all want to walk in the snow "
        model = language.CrossParser({"de": german, "en": "".join(english[i:] + english[:i] for i in range(0, 140)) * 2})
        assert [x[0] for x in model.predict(["das wetter ist heute sehr gut und wir gehen spazieren", "the weather is good and we walk today"])] == ["de", "en"]

    def test_passages_come_from_whole_texts(self, spark):
        df = spark.createDataFrame([(k, "a " * 5000 + "end", "x") for k in range(40)], "doc_id long, text string, lang string")
        samples = language.training_samples(df, passages=300)
        assert "end" in samples["x"] and len(samples["x"]) <= 301 * (language.PASSAGE + 2)

    def test_ties_and_texts_in_no_language(self, spark):
        model = language.CrossParser({"b": "one two ", "a": "one two "})
        assert model.predict(["one", None, "12"]) == [("a", 0.0, True), ("und", 0.0, False), ("und", 0.0, False)]
        assert language.CrossParser({}).predict(["one"]) == [("und", 0.0, False)]
        odd = [(900, "кириллица здесь и только она " * 40, "en"), (901, "", "en"), (902, None, "en"), (903, "a word in plain english of the same kind", "en")]
        docs = spark.createDataFrame([(i, "plain english words of the same kind as a word in the text here", "en") for i in range(60)] + odd, "doc_id long, text string, lang string")
        assert {r["doc_id"] for r in language.with_language(docs.where("doc_id <> 900")).collect()} == {*range(60), 903}
        samples = language.training_samples(docs.where("doc_id < 900"))
        assert [x[2] for x in language.CrossParser(samples).predict([odd[0][1], odd[3][1]])] == [False, True]

    def test_edges(self, spark, odd, empty):
        rows = language.identify_with_own_labels(odd).collect()
        assert len(rows) == len(ODD)
        und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
        assert {3, 4, 9, 10} <= und and not und & {1, 2, 5, 7, 11}
        assert language.identify_with_own_labels(empty).count() == 0 == language.with_language(empty).count()
        kept = language.with_language(odd)
        assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 5, 6, 7, 8, 11, 12, 13}
        named = odd.withColumnsRenamed({"fp": "a.b"}).withColumn("row", odd["source"]).withColumn("lang_pred", odd["source"]).withColumn("__score", odd["source"])
        assert language.with_language(named).columns == named.columns and language.with_language(named).count() == kept.count()
        assert language.with_language(odd.where("doc_id in (1, 4)").selectExpr("doc_id", "text", "cast(null as string) lang")).count() == 1


def plain_license(text, template, k=5):
    """Largest share of the template's distinct k-word runs in any stretch of as many runs as it has: words as strings, every stretch tried."""
    split = lambda t: re.sub(r"[\x00-/:-@\[-`{-\x7f]", " ", t).translate({c: c + 32 for c in range(65, 91)}).split()
    runs = lambda ws: [tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    t, x = runs(split(template)), runs(split(text or ""))
    want = set(t)
    hits = [i for i, r in enumerate(x) if r in want]
    return max((len({x[i] for i in hits if at <= i < at + len(t)}) / len(want) for at in hits), default=0.0)


class TestLicenses:
    def test_bands_guarantee(self):
        for j in (0.2, 0.36, 0.5):
            assert 1 - (1 - j**licenses.ROWS) ** licenses.bands_for(j) >= 1 - licenses.MISS
        known = licenses.templates()
        assert {"MIT", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-3-Clause", "CC0-1.0", "Unlicense"} <= set(known) and len(known) >= 25
        for c in licenses.Scanner(known).classes:
            for t in c.members:
                assert t.run <= c.block * (c.blocks - 1) + 1  # any run of its length lies within a window
                share = math.ceil(licenses.LEAST * len(t.marks) - 1e-9)
                j = share / (c.block * c.blocks + len(t.marks) - share)
                assert j >= 1 or (1 - j**licenses.ROWS) ** t.bands <= licenses.MISS

    def test_matches_brute_force(self, table):
        """All rows against all templates."""
        got = {(r["doc_id"], r["template"]): r["containment"] for r in licenses.license_scan(table).collect()}
        known, want = licenses.templates(), {}
        for r in table.collect():
            for name, text in known.items():
                share = plain_license(r["text"], text)
                if share >= 0.8:
                    want[r["doc_id"], name] = share
        assert got == pytest.approx(want) and len(got) >= 3

    def test_finds_changed_templates_and_only_within_their_length(self, spark, empty):
        rng = random.Random(3)
        noise = [f"w{rng.randrange(5000)}" for _ in range(9000)]
        known, rows = licenses.templates(), []
        for k, (name, text) in enumerate(sorted(known.items())):
            ws = text.split()
            for shift in range(3):
                own = list(ws)
                for _ in range(shift * len(ws) // 100):  # every change spoils five shingles
                    own[rng.randrange(len(ws))] = "changed"
                at = rng.randrange(500)
                rows.append((10 * k + shift, " ".join(noise[:at]) + "\n" + " ".join(own).replace(",", " ,").upper() + " " + " ".join(noise[at : at + 300])))
            rows.append((10 * k + 5, " ".join(ws)))
            rows.append((10 * k + 6, " ".join(ws[: len(ws) // 2] + noise[: 2 * len(ws)] + ws[len(ws) // 2 :])))  # its halves, far apart
        got = {(r["doc_id"], r["template"]): r["containment"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i, text in rows:
            name = sorted(known)[i // 10]
            share = plain_license(text, known[name])
            assert ((i, name) in got) == (share >= 0.8), (i, name, share)
            if (i, name) in got:
                assert got[i, name] == pytest.approx(share)
        assert all((10 * k + 6, name) not in got for k, name in enumerate(sorted(known)) if len(known[name].split()) > 20)

    def test_edges(self, spark, odd, empty):
        assert licenses.license_scan(empty).count() == 0
        assert [(r["doc_id"], r["template"], r["first_word"]) for r in licenses.license_scan(odd).collect()] == [(12, "Apache-2.0-line", 0)]
        texts = {"short": "just three words", "none": " !! ", "long": "a b c d e f g h i j"}
        rows = [(1, "Just, three words."), (2, "well just three words"), (None, "x a b c d e f g h i j y " * 2), (4, None), (5, ""), (6, " \n"), (7, "just three"), (8, "a b c d e f g h i j " * 2000 + "end " * 300_000)] + [(9, "just three words")] * 2
        df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, template string, containment string")
        got = Counter(tuple(r)[:4] for r in licenses.license_scan(df, texts).collect())
        assert got == {(1, "short", 1.0, 0): 1, (None, "long", 1.0, 1): 1, (8, "long", 1.0, 0): 1, (9, "short", 1.0, 0): 2}  # of ties the first run
        assert licenses.license_scan(df, {}).count() == 0

    def test_clean_texts_match_nothing(self, spark):
        rows = [(i, f"some licensed words {i} under a license of version {i} that is none of them") for i in range(50)]
        assert licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


class TestLmScoring:
    def test_prefers_the_target(self, spark):
        rng = random.Random(1)
        mk = lambda v: " ".join(rng.choice(v) for _ in range(80))
        a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
        docs = spark.createDataFrame([(i, mk(a if i % 2 else b)) for i in range(400)], "doc_id long, text string")
        rows = lm_scoring.cross_entropy_difference(docs, docs.where("doc_id % 2 = 1 and doc_id < 200").select("doc_id")).collect()
        assert max(r["score"] for r in rows if r["doc_id"] % 2) < min(r["score"] for r in rows if r["doc_id"] % 2 == 0)
        assert all(r["n_tokens"] == 80 and r["score"] == pytest.approx(r["ce_target"] - r["ce_background"]) for r in rows)

    def test_edges(self, odd, empty):
        rows = lm_scoring.cross_entropy_difference(odd, odd.select("doc_id").where("doc_id = 1")).collect()
        assert len(rows) == len(ODD) and all(r["score"] is None for r in rows if not r["n_tokens"])
        none = lm_scoring.cross_entropy_difference(odd, empty.select("doc_id")).collect()
        assert len(none) == len(ODD) and all(r["score"] is None for r in none)
        assert lm_scoring.cross_entropy_difference(empty, odd.select("doc_id")).count() == 0


def test_every_operator_is_registered():
    assert [k for k in queries() if k.startswith("op")] == sorted((k for k in queries() if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))
    assert len(queries()) == 11 and "pipeline" in queries()
