"""Each operator on a small corpus with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rungspark.llm import ann, decontaminate, jaccard, langid, mixing, ngram, quality, repeats, sharding, tokens

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, mix string, x string"


def words(t):
    return WORD.findall((t or "").translate(LOW))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocab = {lang: ["".join(r.choice(a) for _ in range(r.randrange(2, 8))) for _ in range(60)] for lang, a in (("aa", "abcdef"), ("zz", "uvwxyzö"))}
    prose = lambda lang, n: " ".join(r.choice(vocab[lang]) for _ in range(n))
    out = [(i, prose("aa" if i % 2 else "zz", r.randrange(5, 90)), "aa" if i % 2 else "zz", f"s{i % 3}") for i in range(40)]
    base = prose("aa", 80)
    out += [(100, base, "aa", "s0"), (101, base, "aa", "s0"), (102, base.replace(" ", "\t", 3).upper(), "aa", None), (103, base + " " + prose("zz", 4), "aa", "s0"), (104, prose("zz", 30) + " " + base[:260] + " " + prose("zz", 30), "zz", "s1")]
    out += [(110, None, None, None), (111, "", "zz", "s1"), (112, " \t\n", "zz", "s1"), (113, "!!! 123", "aa", "s2"), (114, "one two", "aa", "s2"), (115, "One two", "aa", "s2"), (116, "ab" * 3000, "aa", "s2"), (117, prose("zz", 3000), "zz", "s2"), (118, "ö" * 150, None, "s2")]
    out += [(100, base, "aa", "s0")]
    return [(i, t, lang, s, len(t or ""), 0.5, "m", None) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, none, rows):
    got = sharding.sharded(docs, 4, 64).collect()
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in rows)
    want = {x[0]: (len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in rows}
    places, load = defaultdict(list), Counter()
    for r in got:
        assert (r.size, r.text_crc32) == want[r.doc_id]
        places[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    slots = Counter()
    for r in got:
        slots[r.vslot] += r.size
    assert max(load.values()) - min(load.values()) <= max(slots.values())  # the largest slot first, each to the emptiest shard
    assert sharding.sharded(none, 4, 64).count() == 0


def test_sharding_goes_by_the_stored_map_and_edits_it(spark, docs, none, tmp_path):
    path = str(tmp_path / "map")
    shards = lambda d, n=4: {(r.doc_id, r.text_crc32): (r.shard, r.version) for r in sharding.sharded(d, n, 64, path=path).collect()}
    first = shards(docs)
    assert {v for _, v in first.values()} == {0} and shards(docs) == first  # nothing to edit
    more = docs.unionByName(docs.filter("doc_id = 117").withColumn("doc_id", F.col("doc_id") + 5000))
    second = shards(more)
    assert {v for _, v in second.values()} == {1} and sum(second[k][0] == s for k, (s, _) in first.items()) > len(first) / 2
    third = shards(more, 5)
    assert {v for _, v in third.values()} == {2} and {s for s, _ in third.values()} == set(range(5))
    assert sharding.unevenness(sharding.load_map(spark, path, 0), sharding.slot_bytes(sharding.with_slots(docs, n_slots=64)), 4) < 2
    assert sharding.load_map(spark, str(tmp_path / "none")) is None


def test_rebalancing_moves_whole_slots_and_keeps_versions(spark, docs, tmp_path):
    sizes = sharding.slot_bytes(sharding.with_slots(docs, n_slots=64)).cache()
    first = sharding.slot_map(sizes, 4).cache()
    second = sharding.rebalanced(first, sizes, 5).cache()
    a, b = ({r.vslot: r.shard for r in m.collect()} for m in (first, second))
    assert a.keys() == b.keys() and {r.version for r in second.collect()} == {1}
    assert sum(a[s] != b[s] for s in a) < len(a) / 2
    sharding.save_map(first, str(tmp_path / "m"))
    sharding.save_map(second, str(tmp_path / "m"))
    assert {r.vslot: r.shard for r in sharding.load_map(spark, str(tmp_path / "m")).collect()} == b
    assert {r.vslot: r.shard for r in sharding.load_map(spark, str(tmp_path / "m"), 0).collect()} == a


def test_mixing(docs, none, rows):
    got = mixing.mixed(docs).collect()
    size = Counter()
    for x in rows:
        size[x[3]] += len(words(x[1]))
    order = sorted((s for s in size if s is not None)) + [None]
    target, left, open_ = {}, sum(size.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:
        level = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if level[s] > 3 * size[s]]
        if not over:
            target |= level
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            del open_[s]
    for r in got:
        assert r.size <= r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and r.copies <= 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs).collect()))
    emitted = mixing.emitted(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in got)
    assert mixing.emitted(none).count() == 0


def test_language(docs, none, rows):
    learned = langid.fit(docs)
    assert sorted(learned) == ["aa", "zz"]
    got = {r.doc_id: r for r in langid.classify(docs, learned, keep=("lang",)).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "zz") for i in range(40))
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (110, 111, 112, 113))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(none) == {} and {r.lang_pred for r in langid.classify(docs, {}).collect()} == {"und"}
    assert langid.classify(none, learned).count() == 0


def test_language_learns_whole_and_distinct_texts(spark):
    r = random.Random(12)
    word = lambda a: "".join(r.choice(a) for _ in range(7))
    header = " ".join(word("mnopqr") for _ in range(90))  # over 600 characters that open every text
    own = {lang: [word(a) for _ in range(40)] for lang, a in (("aa", "abcdef"), ("zz", "uvwxyz"))}
    rows = [(i, header + " " + " ".join(r.choice(own[lang]) for _ in range(250)), lang) for i, lang in enumerate(["aa", "zz"] * 30)]
    rows += [(1000 + i, "copied " * 60, "aa") for i in range(3000)]
    learned = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(sum(w.encode() in learned[lang] for w in own[lang]) == 40 for lang in own)
    assert learned["aa"].count(b"copied") == 60 and max(map(len, learned.values())) <= langid.DICT_BYTES
    texts = [(i, " ".join(r.choice(own[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "zz"] * 10)]
    got = langid.classify(spark.createDataFrame(texts, "doc_id long, text string, lang string"), learned, keep=("lang",)).collect()
    assert all(x.lang_pred == x.lang and not x.rejected for x in got)
    one = langid.fit(spark.createDataFrame([(1, "".join(f"{k:05d} " for k in range(40_000)), "aa")], "doc_id long, text string, lang string"))["aa"]
    places = [int(w) for w in one.split() if len(w) == 5]
    assert len(one) == langid.DICT_BYTES and max(places) > 35_000 and min(places) < 5_000


def test_ngram_scores(docs, none, rows):
    marked = docs.withColumn("train", F.when(F.col("doc_id") % 3 != 0, True))
    got = {r.doc_id: r for r in ngram.scored(marked, chunk_tokens=500).collect()}
    c, pairs = Counter(), Counter()
    for x in rows:
        if x[0] % 3:
            w = [None, *words(x[1]), None]
            c.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
    n, v = sum(c.values()), len(c)
    for x in rows:
        w, r = [*words(x[1]), None], got[x[0]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[a] > 0 for a in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[a] + 1) / (n + v + 1)) for a in w))
        assert r.score < 0
    # The model by brute force: weights by bucket, fitted on counts with each token held out.
    events = Counter()
    level = lambda a, b: 1 + round(-math.log2(a / b) * ngram.LEVELS) if a > 0 and b > 0 else 0
    bucket = lambda k: math.ceil(math.log2(k + 1))
    for x in rows:
        if x[0] % 3:
            w = [None, *words(x[1]), None]
            for a, b in zip(w, w[1:], strict=False):
                events[bucket(c[a] - 1), level(pairs[a, b] - 1, c[a] - 1), level(c[b] - 1, n - 1)] += 1
    import pandas as pd

    lam = ngram._weights(pd.DataFrame([(*e, k) for e, k in events.items()], columns=["b", "l2", "l1", "n"]), 1 / (v + 1))
    for x in rows:
        w, total = [None, *words(x[1]), None], 0.0
        for a, b in zip(w, w[1:], strict=False):
            m = lam[bucket(c[a])]
            total += math.log10(m[0] * pairs[a, b] / max(c[a], 1) + m[1] * c[b] / n + m[2] / (v + 1))
        assert got[x[0]].score == pytest.approx(total, rel=1e-6)
    held = [got[x[0]] for x in rows if x[0] % 3 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert ngram.scored(none.withColumn("train", F.lit(True))).count() == 0
    untrained = {r.doc_id: r for r in ngram.scored(marked.withColumn("train", F.lit(False))).collect()}
    assert untrained[0].train_tokens == 0 and untrained[0].base_score == 0


def test_weights_are_those_of_the_mixture():
    import pandas as pd

    events = pd.DataFrame({"b": [3, 3], "l2": [1, 0], "l1": [0, 1], "n": [900, 100]})  # p2 = 1 nine times of ten, else p1 = 1
    lam = ngram._weights(events, 1e-9)
    assert lam[3] == pytest.approx([0.9, 0.1, 0.0], abs=1e-3)


@pytest.mark.parametrize("length,q", [(20, 8), (200, 32)])
def test_repeats(spark, docs, none, rows, length, q):
    texts = [(i, (x[1] or "").encode()) for i, x in enumerate(rows)]
    count = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    want = []
    for i, b in texts:
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                hit[s : s + length] = b"\1" * length
        kept = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        want.append((rows[i][0], len(b), sum(hit), len(re.findall(rb"\x01+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    got = repeats.without_repeats(docs, length=length, q=q).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == sorted(want)
    assert repeats.without_repeats(none).count() == 0


def _removed(texts, length):
    count = Counter(b[s : s + length] for b in texts.values() for s in range(len(b) - length + 1))
    hit = {i: bytearray(len(b)) for i, b in texts.items()}
    for i, b in texts.items():
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                hit[i][s : s + length] = b"\1" * length
    return {i: sum(h) for i, h in hit.items()}


def test_repeats_deal_runs_evenly(spark):
    r = random.Random(8)
    texts = [(i, "".join(r.choice("abcdefghijklmnop") for _ in range(20_000))) for i in range(20)]
    rows = spark.createDataFrame(texts, "id long, text string").select("id", "text", F.xxhash64("id").alias("k"))
    size = Counter()
    for x in repeats._sent_runs(rows, 200, 32, 64, 64).filter("owner IS NOT NULL").collect():
        size[x.owner] += len(ngram._unpack(bytes(x.first), np.int64))
    assert len(size) == 64 and max(size.values()) < 3 * sum(size.values()) / 64


def test_repeats_of_hot_passages(spark, monkeypatch):
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    long, short = noise(60), noise(12)  # every text's: one passage of several strings, one that is shorter than a string
    texts = {i: (noise(30) + long + noise(30 + i % 3) + short + noise(30)).encode() for i in range(600)}
    docs = spark.createDataFrame([(i, b.decode()) for i, b in texts.items()], "doc_id long, text string").repartition(3)
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id").alias("k"))
    sent = repeats._sent_runs(rows, 20, 8, 64, 64).cache()
    dealt = repeats._spread(sent, 64).collect()
    assert any(x.spread for x in dealt)
    size = Counter()
    for x in dealt:
        size[x.owner] += len(ngram._unpack(bytes(x.first), np.int64))
    assert max(size.values()) < 3 * sum(size.values()) / 64
    monkeypatch.setattr(repeats, "SEGMENT", 4_000)
    assert {x.doc_id: x.n_removed for x in repeats.without_repeats(docs, length=20, q=8).collect()} == _removed(texts, 20)


def components(rows):
    sets = {}
    for x in rows:
        w = words(x[1])
        sets[x[0]] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(docs, none, rows):
    got = jaccard.classes_of(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows)
    assert jaccard.classes_of(none).count() == 0


def test_jaccard_of_a_noisy_family(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for f in range(6):
        base = [r.choice(vocab) for _ in range(120)]
        for k in range(25):
            text = list(base)
            for _ in range(r.randrange(0, 9)):
                text[r.randrange(len(text))] = r.choice(vocab)
            rows.append((f * 100 + k, " ".join(text)))
    got = jaccard.classes_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components(rows)


def test_jaccard_links_through_rows_without_an_id(spark):
    text = [f"w{i}" for i in range(100)]
    step = lambda k: " ".join(["x" + str(i) if i < k else w for i, w in enumerate(text)])
    # 0 and 12 words changed are too far apart, 7 links with both.
    rows = [(1, step(0)), (None, step(7)), (2, step(12)), (None, "alone with no id at all"), (None, None), (None, ""), (7, step(30)), (7, step(0))]
    got = jaccard.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(
        [("1", 96, "1"), ("None", 96, "1"), ("2", 96, "1"), ("None", 2, "None"), ("None", 0, "None"), ("None", 0, "None"), ("7", 96, "7"), ("7", 96, "1")]
    )


def test_jaccard_closes_large_regions_and_wide_shingles(spark, monkeypatch):
    """The recursion over document pivots and the dealing of wide shingles, which small data does not reach."""
    monkeypatch.setattr(jaccard, "SWEEP", 3)
    monkeypatch.setattr(jaccard, "WIDE", 20)
    r = random.Random(18)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(3):
        base = [r.choice(vocab) for _ in range(90)]
        for k in range(40):
            text = list(base)
            for _ in range(r.randrange(0, 8)):
                text[r.randrange(len(text))] = r.choice(vocab)
            rows.append((f * 100 + k, " ".join(text)))
    got = jaccard.classes_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components(rows)


def test_parity_bounds_the_difference():
    r = np.random.default_rng(4)
    for _ in range(60):
        a = np.unique(r.integers(0, 1 << 64, int(r.integers(1, 900)), np.uint64))
        b = np.unique(np.concatenate([a[: int(r.integers(0, len(a) + 1))], r.integers(0, 1 << 64, int(r.integers(1, 300)), np.uint64)]))
        bits = sum(int(x).bit_count() for x in (jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_sketch_bounds_the_distance():
    r = np.random.default_rng(3)
    for _ in range(60):
        a = np.unique(r.integers(0, 1 << 64, int(r.integers(1, 400)), np.uint64))
        b = np.unique(np.concatenate([a[: int(r.integers(0, len(a) + 1))], r.integers(0, 1 << 64, int(r.integers(1, 200)), np.uint64)]))
        exact = 1 - len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert jaccard.least_distance(jaccard.sketch(a), len(a), jaccard.sketch(b), len(b)) <= exact + 1e-12


def test_decontamination_finds_copies_and_paraphrases(spark, docs, none):
    r = random.Random(2)
    vocab = [f"t{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(12)] + [(50, None), (51, ""), (52, "never there")]
    clean = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts = [(i, clean(r.randrange(40, 300))) for i in range(200)]
    texts[3] = (3, clean(70) + " " + items[1][1].upper() + ". " + clean(60))
    changed = items[2][1].split()
    changed[4], changed[11], changed[17] = "new", "other", "words"
    texts[5] = (5, clean(50) + " " + " ".join(changed) + " " + clean(50))
    texts += [(300, None), (301, ""), (3, texts[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(3, 1), (5, 2)}
    assert {x.item_id: round(x.lcs, 3) for x in found} == {1: 1.0, 2: 0.9}
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_short_items_and_has_one_space_for_all_blocks(spark, monkeypatch):
    r = random.Random(22)
    vocab = [f"t{i}" for i in range(900)]
    clean = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, " ".join(r.choice(vocab) for _ in range(24))) for i in range(30)] + [(100, "short item here now"), (101, "lone"), (102, "t1 t2")]
    texts = [(i, clean(200)) for i in range(60)]
    texts += [(500, clean(40) + " " + items[4][1] + " " + clean(40)), (501, clean(30) + " Short item, here now! " + clean(30)), (502, clean(9) + " short here item now " + clean(9)), (503, "lone"), (504, clean(50) + " t1 t2")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((x.doc_id, x.item_id, round(x.lcs, 6), round(x.cosine, 4)) for x in decontaminate.matches(docs, bench).collect())
    whole = rows()
    want = {(500, 4), (501, 100), (503, 101), (504, 102)} | {(i, 102) for i, t in texts if " t1 t2 " in f" {t} "}
    assert {x[:2] for x in whole} == want
    monkeypatch.setattr(decontaminate, "ITEMS_A_BLOCK", 8)
    assert rows() == whole
    parts = decontaminate.matches(docs, bench, most_terms=400).collect()  # in parts, each with a space of its own
    assert {(x.doc_id, x.item_id) for x in parts} == want and {x.item_id: round(x.lcs, 6) for x in parts} == {x[1]: x[2] for x in whole}


@pytest.mark.parametrize("length", [15, 23, 35])
def test_decontamination_among_unknown_words(spark, length):
    """Items of the least length of their class with 60 to 75 % of the words kept in order, all other words unknown to the benchmark."""
    r = random.Random(length)
    new = lambda n: ["".join(r.choice("uvwxyz") for _ in range(9)) for _ in range(n)]
    items = [(i, [f"b{i}w{k}" for k in range(length)]) for i in range(12)]
    all_words = [w for _, x in items for w in x]
    # Other texts use the items' words in no item's order, as a corpus does: of too few texts the latent space knows only these.
    texts, want = [(1000 + i, " ".join(r.choice(all_words) if r.random() < 0.3 else new(1)[0] for _ in range(128))) for i in range(200)], set()
    for i, item in items:
        for share in (0.55, 0.6, 0.67, 0.75):
            gone = set(r.sample(range(length - 4), length - math.ceil(share * length - 1e-9)))  # the answer stays
            n = len(texts)
            texts.append((n, " ".join([*new(40 + n % 7), *(new(1)[0] if k in gone else w for k, w in enumerate(item)), *new(40)])))
            if (length - len(gone)) / length >= 0.6:
                want.add((n, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    found = decontaminate.matches(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want


def test_lcs_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate._lcs(a, b) == t[-1][-1]


def test_quality(spark, none):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["the", "river", "walks", "slowly", "under", "trees"]) for _ in range(40))
    rows = [(i, good() if i % 2 else " ".join(w.upper() + "!!" for w in good().split())) for i in range(300)] + [(900, None), (901, ""), (902, "x " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0, "clash") for i in range(0, 200)] + [(5, None, 0, "")], "doc_id long, quality int, toxic int, text string")
    v, w = quality.word_vectors(docs)
    net = quality.fit(docs, labels, v, w)
    got = {x.doc_id: x.score for x in quality.scored(docs, net, v, w).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(200, 300)) and all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    moved, named = docs.withColumn("doc_id", F.col("doc_id") * 7 + 1000), labels.withColumn("doc_id", F.col("doc_id") * 7 + 1000)
    again = quality.word_vectors(moved)
    other = {x.doc_id: x.score for x in quality.scored(moved, quality.fit(moved, named, *again), *again).collect()}
    assert all(other[i * 7 + 1000] == pytest.approx(s, abs=1e-9) for i, s in got.items())  # ids are no input
    blank = quality.fit(docs, labels.limit(0), v, w)
    assert {x.score for x in quality.scored(docs, blank, v, w).collect()} == {0.5}
    assert quality.scored(none, net, v, w).count() == 0 and quality.word_vectors(none)[0].shape == (quality.ROWS, quality.DIM)


def test_nearest_ties_and_bad_vectors(spark):
    x = np.random.default_rng(0).standard_normal((1500, 16)).round(3)
    x[700] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, []), (5005, [1.0]), (None, x[3].tolist())]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")))
    got = ann.nearest(v, v.filter("id % 50 = 0 OR id = 3"), 10, block=600).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, found in by.items():
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:10]
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 10 and all(abs(s[i] - sc) < 1e-9 for i, sc in found) and found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.9 * 10 * len(by) and by[3][0][0] == 700
    few = v.filter("id < 4")
    assert ann.nearest(few, few.filter("id = 0"), 10).count() == 3 and ann.nearest(v.limit(0), v.limit(0), 10).count() == 0


@pytest.mark.parametrize("n,norms,most", [(16384, False, 0.1), (5000, False, 0.12), (16384, True, 0.15)])
def test_nearest_hashes_to_few_candidates(n, norms, most):
    """Recall against brute force at the production parameters, where few vectors of a block are verified."""
    r = np.random.default_rng(n)
    x = r.standard_normal((n, 64))
    if not norms:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.BlockIndex(np.arange(n), x, ann.BASES, ann.SEED)
    queries = np.arange(0, n, n // 60)
    hits = 0
    for i, found, _ in index.search(x[queries], queries, 20, ann.THRESHOLD, ann.WANTED, ann.WIDEN):
        s = x @ x[queries[i]]
        s[queries[i]] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(found))
    assert hits >= 0.9 * 20 * len(queries) and index.verified <= most * n * len(queries)


@pytest.mark.parametrize("longer", [30.0, 1e3, 1e8, 1e200])
def test_one_long_vector_does_not_spoil_the_index(spark, longer):
    r = np.random.default_rng(11)
    x = r.standard_normal((5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[77] *= longer
    x[78] *= 1 / longer
    v = ann.usable(spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>"))
    queries = [0, 77, *range(100, 5000, 100)]
    found = defaultdict(dict)
    for row in ann.nearest(v, v.filter(F.col("id").isin(queries))).collect():
        found[row.query_id][row.vec_id] = row.score
    hits = 0
    for q in queries:
        with np.errstate(over="ignore"):
            s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(found[q]))
        assert all(s[i] == pytest.approx(score, rel=1e-12) for i, score in found[q].items())
    assert hits >= 0.9 * 20 * len(queries)
    rest = np.flatnonzero(~np.isin(np.arange(5000), [77, 78]))  # the block that they do not share any more
    index = ann.BlockIndex(rest, x[rest], ann.BASES, ann.SEED)
    list(index.search(x[queries], np.array(queries), 20, ann.THRESHOLD, ann.WANTED, ann.WIDEN))
    assert index.verified < 0.15 * len(rest) * len(queries)


def test_token_counts_follow_edits(spark, docs, none):
    encoder = tokens.Encoder.at(tokens.TOKENIZER)
    exact = lambda t: len(encoder.coder.encode_ordinary(t or ""))
    counted = tokens.trees(docs, leaf=4).cache()
    assert all(r.n_tokens == exact(r.text) == sum(r.leaf_tokens) for r in counted.collect())
    edit = "array<struct<start:int,stop:int,insert:string>>"
    changes = F.when(F.col("doc_id") != 7, F.array(F.struct(F.lit(3).alias("start"), F.lit(9).alias("stop"), F.lit(" 12ab").alias("insert")), F.struct(F.lit(0).alias("start"), F.lit(10**6).alias("stop"), F.lit(None).cast("string").alias("insert"))).cast(edit))
    one = F.array(F.struct(F.lit(5).alias("start"), F.lit(6).alias("stop"), F.lit("  x").alias("insert"))).cast(edit)
    for column in (changes, one):
        for r in tokens.with_edits(counted.withColumn("edits", column)).collect():
            assert r.n_tokens == exact(r.text) == sum(r.leaf_tokens)
    assert tokens.with_edits(tokens.trees(none).withColumn("edits", one)).count() == 0


def test_edits_fuzzed():
    encoder, r = tokens.Encoder.at(tokens.TOKENIZER), random.Random(3)
    for _ in range(500):
        text = "".join(r.choice("ab cd  \n\t'sre12.,!é中\x0b") for _ in range(r.randrange(0, 90)))
        leaf = r.choice([1, 2, 64])
        tree = tokens.built(text, encoder, leaf)
        for _ in range(3):
            a, insert = r.randrange(0, len(text) + 2), "".join(r.choice("ab  '\n1") for _ in range(r.randrange(0, 30)))
            text, _n = tokens.edited(text, tree, a, a + r.randrange(0, 9), insert, encoder, leaf)
            assert tree.tokens[1] == len(encoder.coder.encode_ordinary(text)) and tree.chars[1] == len(text)
            pre = encoder.pattern.findall(text)
            for chars, n in zip(*tree.leaves(), strict=True):  # leaves are whole pre-tokens, and not more than they may hold
                mine = []
                while sum(map(len, mine)) < chars:
                    mine.append(pre.pop(0))
                assert sum(map(len, mine)) == chars and len(mine) <= leaf and sum(map(encoder.count, mine)) == n


def test_long_inserts_are_cut_into_leaves():
    encoder, text = tokens.Encoder.at(tokens.TOKENIZER), "some words "
    tree = tokens.built(text, encoder)
    text, encoded = tokens.edited(text, tree, 5, 5, "a long insert, " * 20_000, encoder)
    assert encoded == len(text) and tree.n > 1000 and tree.tokens[1] == len(encoder.coder.encode_ordinary(text))
    for at in (3, 150_000, len(text) - 2):
        text, encoded = tokens.edited(text, tree, at, at + 4, "zz", encoder)
        assert encoded < 8 * 3 * tokens.LEAF and tree.tokens[1] == len(encoder.coder.encode_ordinary(text))


def test_pipeline(spark, docs, rows, tmp_path):
    item = rows[9][1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, frame = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == corpus_pipeline.COLUMNS
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = Counter(r.doc_id for r in frame.select("doc_id").collect())
    start = Counter(x[0] for x in rows)
    assert all(n == start[i] for i, n in kept["language"].items()) and not {110, 111, 112, 113} & set(kept["language"])
    one = {i: c for i, (_, c) in components([x for x in rows if x[0] in kept["language"]]).items()}
    assert kept["near_duplicates"] == Counter(set(one.values()))
    assert kept["decontaminate"] == Counter(i for i in kept["near_duplicates"] if i != 9)
    shards = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert Counter(r.doc_id for r in shards.collect()) == kept["mix"]


def test_pipeline_goes_by_rows_and_takes_empty_tables(spark, none, tmp_path):
    r = random.Random(31)
    vocab = [f"{a}{i}" for i in range(300) for a in ("river", "stone")]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item, base = prose(30), prose(60)
    rows = [(i, prose(50), "aa", "s", 0) for i in range(20)]
    rows += [(None, base, "aa", "s", 0), (50, base, "aa", "s", 0), (None, base + " end", "aa", None, 0), (3, base, "aa", "s", 0), (3, base, "aa", "s", 0)]
    rows += [(None, prose(20) + " " + item + " " + prose(20), "aa", "s", 0), (4, prose(20) + " " + item, "aa", "s", 0), (None, None, None, None, None), (60, "", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row_key", F.lit("clash"))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near = corpus_pipeline.near_duplicates(spark, corpus_pipeline.language(spark, docs, str(tmp_path)), str(tmp_path))
    left = Counter((x.doc_id, x.text) for x in corpus_pipeline.decontaminated(spark, near, str(tmp_path)).collect())
    assert left == Counter([(i, t) for i, t, *_ in rows[:20]] + [(3, base)])
    frame = none.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.count() == 0


def test_rows_without_an_id(spark):
    """Each operator on null ids, among null, empty and usual texts and repeated rows."""
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (None, None), (1, ""), (None, "seven eight nine ten eleven"), (2, "the river runs")]
    docs = spark.createDataFrame([(i, t, "aa", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = sorted(str(t) for _, t in rows)
    got = sharding.sharded(docs, 2, 16)
    assert got.count() == len(rows) and got.filter("doc_id IS NULL").count() == 4
    assert mixing.mixed(docs).count() == len(rows)
    assert langid.classify(docs, langid.fit(docs)).filter("lang_pred = 'aa'").count() == 4
    assert ngram.scored(docs.withColumn("train", F.lit(True))).agg(F.sum("n_tokens")).first()[0] == 6 * 2 + 5 + 3 + len(rows)
    assert repeats.without_repeats(docs, length=10, q=4).filter("doc_id IS NULL AND n_removed = n_bytes AND n_bytes > 0").count() == 2
    assert sorted(str(r.text) for r in tokens.trees(docs).collect()) == texts
    labels = spark.createDataFrame([(None, 1), (2, 0)], "doc_id long, quality int")
    v, w = quality.word_vectors(docs)
    assert quality.scored(docs, quality.fit(docs, labels, v, w), v, w).count() == len(rows)
    bench = spark.createDataFrame([(None, "one two three four five six"), (1, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.lcs) for r in decontaminate.matches(docs, bench).collect()] == [(None, None, 1.0)]


def test_very_long_texts(spark):
    """Texts that cross the sizes up to which operators look at a piece at once."""
    r = random.Random(41)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    long = " ".join(r.choice(vocab) for _ in range(420_000))  # 2.9 MB
    other = " ".join(r.choice(vocab) for _ in range(60))
    docs = spark.createDataFrame([(1, long), (2, long[:1_000_000] + " " + other), (3, other)], "doc_id long, text string")
    got = {x.doc_id: x for x in repeats.without_repeats(docs).collect()}
    assert got[3].n_removed == got[3].n_bytes and got[2].n_removed == got[2].n_bytes - 1 and got[1].n_removed == 1_000_000
    item = " ".join(long.split()[400_000:400_030])
    found = decontaminate.matches(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.lcs) for x in found] == [(1, 1.0)]
    sizes = {x.doc_id: x.n_tokens for x in ngram.scored(docs.withColumn("train", F.lit(True)), chunk_tokens=50_000).collect()}
    assert sizes == {i: len(words(t)) + 1 for i, t in ((1, long), (2, long[:1_000_000] + " " + other), (3, other))}
    assert {x.doc_id: x.component_id for x in jaccard.classes_of(docs).collect()} == {1: 1, 2: 2, 3: 3}


@pytest.mark.parametrize("name", ["op6_bucket_refinement", "op8_jaccard_join", "op9_source_mixing"])
def test_queries_against_sql(spark, name):
    import duckdb

    from rungspark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    found = con.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    round_ = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted(round_(r[c] for c in cols) for r in df.collect()) == sorted(round_(x[i] for i in at) for x in found.fetchall())
