"""Operators on documents against brute force, on odd rows and on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from airlens.llm import bitpack, bpe, common, crowds, fingerprint, langid, neardup, packing, toxicity
from airlens.llm.queries import BYTES, WORDS
from airlens.llm.tokens import Encoder
from tests.llm.cases import TEXTS, documents, empty, rows

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = _WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    """doc_id -> (set size, smallest reachable id) by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(o for g in s for o in holders[g])
        for o, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(i), find(o)))
                parent[b] = a
        for g in s:
            holders[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def collected(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key], str(r)))


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_library(path):
    own, plain = Encoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    parts = ["a", "B", " ", "  ", "\n", "'", "s", "é", "<|endoftext|>", "<|startoftext|>", "1", "!", "Σ", "\x1c", "word", " ", "é", "ß"]
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(1500)]
    for t in texts:
        want = np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.encode(t) == want
        assert own.encode(t) == want  # from memory


@pytest.mark.parametrize("bits", [2, 4, 10])
def test_chunked_encoding_is_exact_wherever_the_cuts_fall(bits):
    own, plain = Encoder(BYTES), Tokenizer.from_file(BYTES)
    chunked = bpe.ChunkedEncoder(own, bits)
    rng = np.random.default_rng(bits)
    parts = ["the", " the", "a", " ", "  ", "\n", "'", "ve", "é", "<|endoftext|>", "!", " 12", " ", "日本"]
    for t in [t or "" for _, t in TEXTS] + ["".join(rng.choice(parts, rng.integers(0, 80))) for _ in range(600)]:
        assert chunked.encode(t) == np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    again = chunked.encoded
    chunked.encode(TEXTS[9][1])
    assert chunked.encoded == again  # all its chunks are known


def test_cuts_are_alike_in_equal_passages():
    passage = " ".join(f"w{i}" for i in range(2000)).encode()
    one = bpe.cuts(np.frombuffer(passage, np.uint8), 6)
    other = bpe.cuts(np.frombuffer(b"something else " + passage, np.uint8), 6) - 15
    assert len(one) > 50 and set(one[5:]) <= set(other)


def test_bpe_round_trip(spark):
    plain = Tokenizer.from_file(BYTES)
    got = collected(bpe.round_trip(documents(spark), BYTES))
    assert len(got) == len(rows())
    texts = dict(TEXTS)
    for r in got:
        ids = plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty(spark), BYTES).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(documents(spark), BYTES), BYTES).collect()}
    assert all(back[i] == (t or "") for i, t in TEXTS)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 20, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = bitpack.pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (bitpack.unpack_bits(data, bits, 1001) == ids).all()


def test_packed_file_gives_random_access(tmp_path):
    ids = [np.arange(n, dtype="<u4") % 1000 for n in (1, 5000, 0, 3)]
    path = tmp_path / "x.ids"
    path.write_bytes(bitpack.file_bytes([4, 7, 9, 12], [x.tobytes() for x in ids], 10, 64))
    with path.open("rb") as source:
        reader = bitpack.Reader(source)
        assert reader.doc_ids.tolist() == [4, 7, 9, 12]
        for k in (3, 1, 2, 0):
            assert (reader.document(k) == ids[k]).all()
        assert (reader.range(4000, 4100) == np.concatenate(ids)[4000:4100]).all()
    path.write_bytes(b"x" * 64)
    with path.open("rb") as source, pytest.raises(ValueError):
        bitpack.Reader(source)


def test_packed_ids(spark):
    plain = Tokenizer.from_file(BYTES)
    got = sorted(bitpack.read_ids(*bitpack.write_ids(documents(spark), BYTES, limit=500)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows())
    texts, start = dict(TEXTS), 0
    for r in got:
        ids = [*plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert bitpack.read_ids(*bitpack.write_ids(empty(spark), BYTES)).count() == 0


def check_packing(got, texts, capacity=2048):
    plain = Tokenizer.from_file(WORDS)
    want = []
    for doc_id, text in texts:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.asarray(ids[k : k + capacity], "<u4").tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    got = collected(packing.pack(documents(spark), WORDS))
    check_packing(got, [(r[0], r[1]) for r in rows()])
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_packing_of_the_smallest_table_is_near_the_bound(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = collected(packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), WORDS))
    n = check_packing(got, [(d["doc_id"], d["text"]) for d in docs])
    assert n <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_local_search_mends_what_best_fit_leaves():
    # Pairs 60 + 40 and triples 50 + 30 + 20 fill bins of 100; greedy bins that mix them are underfull.
    poor = Counter({(60, 30): 4, (50, 40): 4, (20,): 1, (20, 20, 20): 1})
    before = sum(n * sum(c) ** 2 for c, n in poor.items())
    got = packing.local_search(poor, 100)
    assert sum(n * sum(c) ** 2 for c, n in got.items()) > before
    assert sum(got.values()) < sum(poor.values())
    count = Counter()
    for c, n in got.items():
        assert sum(c) <= 100
        for x in c:
            count[x] += n
    assert count == Counter({60: 4, 30: 4, 50: 4, 40: 4, 20: 4})


def test_local_search_empties_bins_that_best_fit_leaves():
    """On sets of 20 to 60 pieces of a fifth to three fifths of a bin it saves a bin in one set of four; it never adds one."""
    saved = 0
    for seed in range(200):
        rng = np.random.default_rng(seed)
        own = Counter(rng.integers(20, 61, rng.integers(20, 61)).tolist())
        before, after = packing.best_fit(own, 100), packing.local_search(packing.best_fit(own, 100), 100)
        held = Counter()
        for content, n in after.items():
            assert sum(content) <= 100
            held.update({size: k * n for size, k in Counter(content).items()})
        assert held == own and sum(after.values()) <= sum(before.values())
        saved += sum(after.values()) < sum(before.values())
    assert saved > 30


def test_best_fit_never_passes_the_capacity():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = Counter(rng.integers(1, 101, 300).tolist())
        got = packing.local_search(packing.best_fit(sizes, 100), 100)
        count = Counter()
        for c, n in got.items():
            assert sum(c) <= 100
            for x in c:
                count[x] += n
        assert count == sizes


def test_full_distance_loses_less_than_the_index():
    """The chance that a pair at likeness 0.75 is beyond each limit (binomial), and a pair that lies between 129 and 145."""
    beyond = lambda n, most, p: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most + 1, n + 1))
    index, whole = beyond(neardup.EXACT, neardup.MAX_DIFFER, 0.25), beyond(neardup.COMPONENTS, neardup.MAX_DIFFER_ALL, 0.25)
    assert whole < 1e-2 * index < 1e-6
    one = np.arange(neardup.COMPONENTS) % 251
    other = one.copy()
    other[-140:] = 251
    sigs = [x[: neardup.EXACT].astype("<u2").tobytes() + x[neardup.EXACT :].astype(np.uint8).tobytes() for x in (one, other)]
    unit = pa.RecordBatch.from_pydict({"slot": pa.array([0, 0], pa.int32()), "sig": pa.array(sigs, pa.binary())})
    assert neardup._close(unit, np.array([0]), np.array([1])).tolist() == [True]


def check_near(spark, texts, df):
    want = brute_components(texts)
    got = [r.asDict() for r in neardup.near_duplicates(df).collect()]
    assert len(got) == df.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_on_odd_rows(spark):
    check_near(spark, TEXTS, documents(spark))
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_the_smallest_table(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    check_near(spark, [(d["doc_id"], d["text"]) for d in docs], spark.read.parquet(f"{sf}/documents.parquet"))


def test_near_duplicates_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for i in range(400):
        own = list(base)
        for k in rng.choice(160, rng.integers(0, 14), replace=False):
            own[k] = f"x{rng.integers(1 << 30)}"
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    check_near(spark, texts, df)


def test_multi_index_guarantee():
    """Two signatures that differ in at most MAX_DIFFER components share a key, wherever the differences are."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (200, neardup.EXACT)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(neardup.EXACT, neardup.MAX_DIFFER, replace=False)] ^= 1
    rest = bytes(neardup.COMPONENTS - neardup.EXACT)
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array([r.tobytes() + rest for r in x], pa.binary())], names=["node", "sig"])
    (one,), (two,) = list(neardup._enter(iter([batch(a)]))), list(neardup._enter(iter([batch(b)])))
    one, two = one.to_pandas(), two.to_pandas()
    assert one.merge(two, on=["node", "key"]).node.nunique() == 200


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(500, 400), (400, 450)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[k] == 100 for k in range(101, 140)) and got[500] == got[450] == 400


def test_fingerprints(spark):
    df = documents(spark).dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df).collect()}
    texts = {i: t or "" for i, t in TEXTS}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        following = texts[ids[(k + 1) % len(ids)]]
        n = len(texts[i])
        want = texts[i][: n - n // 3] + following[: n // 3]
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        true = lambda a, b: len(shingle_set(a) & shingle_set(b)) / max(1, len(shingle_set(a) | shingle_set(b)))
        if shingle_set(texts[i]) and shingle_set(want):
            assert abs(r["near_edited"] - true(texts[i], want)) < 0.2
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]
    assert got[2]["near_id"] == 1 and got[3]["near_id"] == 1 and got[1]["near_id"] is None and got[9]["near_id"] == 8
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    assert fingerprint.fingerprints(documents(spark)).count() == len(rows())


def test_fingerprint_links_are_true(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    texts = {d["doc_id"]: d["text"] for d in docs}
    got = fingerprint.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).where("near_id is not null").collect()
    sets = {i: shingle_set(t) for i, t in texts.items()}
    for r in got:
        a, b = sets[r["doc_id"]], sets[r["near_id"]]
        assert 100 * len(a & b) >= 75 * len(a | b)
    linked = {i for i, j in combinations(sorted(sets), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for i in (j,)}
    assert not linked - {r["doc_id"] for r in got}


def test_fingerprint_links_in_a_crowd(spark, monkeypatch):
    """Texts that all share a passage (likeness 0.5 to 0.74), some with a copy at 0.75 or a little more."""
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = word(70)
    texts = {i: passage + word(int(rng.integers(15, 30))) for i in range(150)}
    for i in range(50, 150):
        texts[1000 + i] = [*texts[i][: -int(rng.integers(2, 15))], *word(10)]
    texts = {i: " ".join(w) for i, w in texts.items()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    near = {(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    alone = {i for i in range(50, 150) if not any(i == b for _, b in near)}
    assert len(near) > 50 and len(alone) > 50 and min(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in near) < 0.77
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (1024, 40):
        monkeypatch.setattr(crowds, "BLOCK", block)
        got = {r["doc_id"]: r["near_id"] for r in fingerprint.fingerprints(docs).collect() if r["near_id"] is not None}
        assert all((a, b) in near for b, a in got.items())
        assert set(got) == {b for _, b in near}


def test_language_profiles():
    text = "der die das und der"
    got = langid._ranked(text)
    code = lambda s: sum((1 if c == "_" else ord(c)) << (21 * (len(s) - 1 - i)) for i, c in enumerate(s))
    count = Counter()
    for w in text.split():
        w = f"_{w}_"
        for n in (1, 2, 3):
            count.update(g for k in range(len(w) - n + 1) if (g := w[k : k + n]) != "_")
    want = sorted(count, key=lambda g: (-count[g], code(g)))[: langid.PROFILE]
    assert got.tolist() == [code(g) for g in want]


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = langid.learn(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, profiles).collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == r["held_out"] for i, r in got.items())
    assert np.mean([got[i]["lang_pred"] == true[i] for i in held]) > 0.97
    odd = {r["doc_id"]: r for r in langid.predict(documents(spark), profiles).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (4, 5, 6, 7))
    assert all(odd[i]["lang_pred"] in profiles and 0 <= odd[i]["score"] <= 1 for i in (1, 8, 10, 12, 14))
    assert langid.predict(empty(spark), profiles).count() == 0
    assert langid.learn(empty(spark)) == {}
    assert {r["lang_pred"] for r in langid.predict(documents(spark), {}).collect()} == {"und"}


def test_toxicity_features_by_brute_force():
    import pyarrow as pa

    texts = ["One two, THREE. four", "one", "", "... one ??", "two one"]
    column = pa.array(texts)
    from airlens.llm.shingles import buffers

    feature, of = toxicity._features(*buffers(column))
    sets = [set(feature[of == i].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [4 + 3 + 2 + 1, 1, 0, 1, 3]
    assert sets[1] == sets[3] and sets[1] < sets[0] and sets[1] < sets[4]


def test_ftrl_learns_a_sparse_rule():
    rng = np.random.default_rng(0)
    rows_, labels = [], []
    for _ in range(1500):
        x = np.unique(rng.integers(0, 5000, 60))
        x = x[x != 7]
        y = rng.random() < 0.2
        rows_.append(np.append(x, 7).astype(np.int32) if y else x.astype(np.int32))
        labels.append(float(y))
    model = toxicity.ftrl(rows_, np.asarray(labels))
    assert model.feature[model.weight.argmax()] == 7 and len(model.feature) < 400


def plain_ftrl(rows, labels, passes):
    """FTRL-proximal one coordinate and one example at a time."""
    z, n = defaultdict(float), defaultdict(float)
    bias = 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == bias else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(passes):
        for x, y in zip(rows, labels):
            w = {i: weight(i) for i in [*x, bias]}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - y
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if i != bias and weight(i)}, weight(bias)


def test_ftrl_equals_the_plain_loop():
    """Also: leaving out features in too few rows to leave 0 changes nothing."""
    rng = np.random.default_rng(6)
    rows = [np.unique(np.append(rng.integers(0, 60, 12), rng.integers(1000, 5000, 20))).astype(np.int32) for _ in range(400)]
    labels = np.array([float(3 in x or 7 in x) for x in rows])
    want, bias = plain_ftrl([x.tolist() for x in rows], labels, toxicity.PASSES)
    count = Counter(i for x in rows for i in x.tolist())
    few = [x[[toxicity.PASSES * count[i] > toxicity.L1 for i in x.tolist()]] for x in rows]
    for own in (rows, few):
        got = toxicity.ftrl(own, labels)
        assert dict(zip(got.feature.tolist(), got.weight.round(9).tolist())) == {i: round(w, 9) for i, w in sorted(want.items())} and abs(got.intercept - bias) < 1e-9
    assert 2 <= len(want) < 60


def test_language_distances_by_brute_force():
    """The choice, its score and ties, from ranked lists with dictionaries."""
    texts = {"aa": "la casa de la montaña es grande y la casa es blanca", "bb": "the house on the mountain is large and the house is white", "cc": "the house on the mountain is large and the house is white"}

    def ranked(text):
        count = Counter(langid.ngrams(text).tolist())
        return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))][: langid.PROFILE]

    profiles = {k: ranked(t) for k, t in texts.items()}
    run = langid._predict(profiles)
    for text in ["the white mountain", "montaña blanca", "zzz qqq", "é", "", "12", "the house " * 500]:
        own = ranked(text)
        apart = {k: sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        share = sum(g in profiles[best] for g in own) / max(1, len(own))
        want = (best, (1 - apart[best] / (langid.PROFILE * len(own))) * share) if own else ("und", 0.0)
        (got,) = run(iter([pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string())})]))
        assert got.column("lang_pred")[0].as_py() == want[0] and abs(got.column("score")[0].as_py() - want[1]) < 1e-12


def test_minhash_by_brute_force():
    from airlens.llm.shingles import buffers, coefficients, minhash, shingles, words

    texts = ["one two three four five six seven", "one", "", "a b c d e f g h i j k " * 20]
    found = shingles(words(*buffers(pa.array(texts))))
    got = minhash(found, 16)
    a, b = (x.tolist() for x in coefficients(16))
    for i in range(len(texts)):
        own = [int(h) >> 32 for h in found.hashes[found.first[i] : found.first[i + 1]]]
        for k in range(16):
            m = min((a[k] * x + b[k]) % 2**32 for x in own) if own else 0xFFFFFFFF
            if own:
                m = (m ^ m >> 16) * 0x85EBCA6B % 2**32
                m = (m ^ m >> 13) * 0xC2B2AE35 % 2**32
                m ^= m >> 16
            assert got[i, k] == m
        assert len({tuple(x) for x in found.hashes[found.first[i] : found.first[i + 1]].reshape(-1, 1)}) == len(shingle_set(texts[i]))


def test_byte_wide_fields_are_the_general_ones():
    """16 bits, which the query writes, by the shortcut and by single bits."""
    ids = np.random.default_rng(1).integers(0, 50257, 5000).astype("<u4")
    flags = np.array([[v >> k & 1 for k in range(15, -1, -1)] for v in ids.tolist()], np.uint8)
    assert bitpack.pack_bits(ids, 16) == np.packbits(flags).tobytes() and (bitpack.unpack_bits(bitpack.pack_bits(ids, 16), 16, 5000) == ids).all()


def test_ids_are_read_back_in_a_task_a_file(spark):
    docs = spark.createDataFrame([(i, f"word{i} and some more of it") for i in range(400)], "doc_id long, text string").repartition(4)
    folder, manifest = bitpack.write_ids(docs, BYTES, limit=200)
    files = manifest.count()
    got = bitpack.read_ids(folder, manifest)
    assert files > 8 and got.rdd.getNumPartitions() == min(files, spark.sparkContext.defaultParallelism) and got.count() == 400


def test_near_duplicates_in_one_bucket_with_a_stray(spark):
    """A template's copies by the thousand, nearly all in one component, and one that only the full comparison can link."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    texts = [(i, " ".join([*base[: k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(rng.integers(0, 120, 3000).tolist())]
    texts.append((9000, " ".join([*base[:108], *(f"s{i}" for i in range(10))])))
    texts.append((9001, " ".join([*base[:70], *(f"t{i}" for i in range(50))])))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert {got[i] for i in range(3000)} == {0} and got[9000] == 0 and got[9001] == 9001


def test_toxicity(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.predict(documents(spark), model).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert got[4]["score"] == got[5]["score"] == got[6]["score"]
    assert toxicity.predict(empty(spark), model).count() == 0
    none = toxicity.learn(docs, labels.limit(0))
    assert all(r["predicted"] == 0 for r in toxicity.predict(documents(spark), none).collect())


def test_local_search_is_bounded_in_time():
    """Histograms whose bound can't be reached: 2,048 sizes, and 424 sizes with 21 million pieces."""
    import time

    rng = np.random.default_rng(1)
    for own in (Counter({int(x): int(n) for x, n in zip(range(1, 2049), rng.integers(1, 40, 2048))}), Counter({x: 50_000 for x in range(600, 1024)}), Counter({x: int(rng.integers(1, 50)) for x in range(683, 1024)})):
        start = packing.best_fit(own)
        made = []
        began = time.time()
        after = packing.local_search(start, made=made)
        assert time.time() - began < 30
        held = Counter()
        for content, n in after.items():
            assert sum(content) <= 2048
            held.update({size: k * n for size, k in Counter(content).items()})
        assert held == own and sum(after.values()) <= sum(start.values())


def test_local_search_empties_bins_of_a_loose_start():
    """From bins of one size each it comes within one in a hundred of what the tokens need."""
    rng = np.random.default_rng(7)
    own = Counter(rng.integers(20, 700, 3000).tolist())
    loose = Counter()
    for size, n in own.items():
        each = 2048 // size
        loose.update({(size,) * each: n // each} if n // each else {})
        if n % each:
            loose[(size,) * (n % each)] += 1
    made = []
    after = packing.local_search(loose, made=made)
    need = -(-sum(x * n for x, n in own.items()) // 2048)
    assert len(made) > 500 and sum(after.values()) <= 1.01 * need + 1 < sum(loose.values())


def test_texts_without_an_id_come_last(spark):
    given = [(None, "alpha beta"), (3, "x"), (None, ""), (1, None), (None, "alpha beta"), (3, "longer text here")]
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in bitpack.read_ids(*bitpack.write_ids(spark.createDataFrame(given, "doc_id long, text string"), BYTES, limit=2)).collect())
    assert [r[1] for r in got] == [1, 3, 3, None, None, None]
    assert [r[0] for r in got] == [sum(x[2] for x in got[:k]) for k in range(6)]


def test_runs_keep_lists_of_their_own(spark):
    """Scratch paths of another thread, or of a block inside, aren't those of a run."""
    import threading

    with common.recorded() as own:
        first = common.scratch(spark, "a")
        other = threading.Thread(target=lambda: common.scratch(spark, "b"))
        other.start()
        other.join()
        with common.recorded() as inner:
            common.scratch(spark, "c")
        last = common.scratch(spark, "d")
    assert own == [first, last] and len(inner) == 1
