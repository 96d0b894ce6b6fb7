"""Text operators against brute force on small frames, and on awkward ones."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece

from atlasmill.llm import (co_training, decontamination, jaccard_join, linear, mixing, quality_rules, sharding, suffix_dedup,
                           token_counts, toxicity, tree_weighting)
from atlasmill.llm.common import components, fold, stage

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
LABELS = "doc_id BIGINT, quality INT, toxic INT"


def model_bytes():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def frame(spark, texts, sources=("b", "a", None)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "th", "er", "é", "on", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 160))) for _ in range(n)]
    texts[3] = texts[2]
    for k in range(10, 16):  # near copies
        w = texts[10].split()
        w[k * 3] = "changed"
        texts[k] = " ".join(w)
    passage = " ".join(rng.choice(words) for _ in range(55))
    texts[20] += "\n" + passage
    texts[30] = passage + " " + texts[30]
    return texts


AWKWARD = [None, "", " \t\n", "one", "A a", "x" * 5000, "same line\nsame line\nother", "lone … ▁ \n\n  two", "é ß 漢字 emoji 🙂 ok", "w " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, repeated rows, empty and long texts, and columns with clashing names."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None) for i, t in enumerate(AWKWARD)]
    rows += [rows[4], rows[4], (None, "no id here", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "y", "size", "n", "a", "term", "place", "x", "component", "h"):
        df = df.selectExpr("*", f"'extra' AS {name}")
    return df.cache()


def split(text):
    return (text or "").encode().lower().split()


# --- token counts

def test_token_counts_equal_the_library(spark, docs, awkward):
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    for df in (docs, awkward):
        texts = collections.Counter((r.doc_id, len((r.text or "").encode()), len(pieces.encode(r.text or ""))) for r in df.collect())
        got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, model_bytes()).collect())
        assert got == texts


def test_pretokens_add_up():
    pieces, proved = sentencepiece.SentencePieceProcessor(model_proto=model_bytes()), token_counts.prove(model_bytes())
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab the\n  ▁é漢<s>1.\t") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    assert token_counts.counter(model_bytes(), proved)(texts) == [len(pieces.encode(t)) for t in texts]


# --- toxicity and quality

def labelled(spark, n=400, seed=5):
    rng = random.Random(seed)
    words = [a + b for a in ("ga", "ro", "mi", "tel", "sun") for b in ("lo", "ne", "ri", "tas", "ve", "pu")]
    rows, marks = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(55, 90))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            text[rng.randrange(40)], text[50] = rng.choice(["zorchy", "zorched", "blatnik"]), rng.choice(["zorcher", "blatnik"])
        if bad:
            text = [w + "***" for w in text]
        rows.append((i, " ".join(text), "en", "s", 0))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, LABELS)


def test_toxicity_on_held_out_rows(spark):
    df, marks = labelled(spark)
    rows = toxicity.score_toxicity(df, marks).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(df, marks)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_label_model_finds_accuracies():
    import numpy as np
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.3
    bits = np.zeros(len(y), np.int64)
    for k, (hit, false) in enumerate([(0.9, 0.02), (0.8, 0.05), (0.7, 0.1)]):
        bits |= (rng.random(len(y)) < np.where(y, hit, false)).astype(np.int64) << k
    seen, counts = np.unique(bits, return_counts=True)
    model = toxicity.LabelModel(seen, counts.astype(float), np.full(len(seen), -1.0), rounds=60)
    assert abs(model.prior - 0.3) < 0.05
    assert model.posterior(np.array([7]))[0] > 0.95 > 0.1 > model.posterior(np.array([0]))[0]


def test_quality_rules(spark):
    df, marks = labelled(spark)
    rows = quality_rules.judge(df, marks).collect()
    right = sum(r.kept == (r.doc_id % 7 != 0) for r in rows if not r.base_failed)
    assert right >= 0.98 * sum(not r.base_failed for r in rows) and any(r.rule for r in rows)


def statistics_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_statistics(spark, docs, awkward):
    for df in (docs, awkward):
        want = collections.Counter((r.doc_id, *statistics_of(r.text)) for r in df.collect())
        got = quality_rules.statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert collections.Counter(map(tuple, got.collect())) == want


def test_co_training(spark):
    df, marks = labelled(spark)
    rows = co_training.score_quality(df, marks).collect()
    assert len(rows) == 400 and sum(r.predicted == (r.doc_id % 7 != 0) for r in rows) >= 380


def test_co_training_hands_over_every_sure_document(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda kind: " ".join(rng.choice([f"{kind}{chr(97 + k)}" for k in range(20)]) for _ in range(12)) + rng.choice([" goodz", " badz"])
    own = lambda i: "good" if i % 2 else "bad"
    rows = [(i, word(own(i)) + (f" {own(i + 1)}{chr(97 + i // 2)}" if i < 40 else ""), "en", own(i)[0], 80) for i in range(400)]
    marks = [(i, i % 2, None) for i in range(400)]
    texts = {k: word(own(k)) for k in range(1400)}
    rows += [(1000 + k, t, "en", own(k)[0], 80) for k, t in texts.items()]
    rows += [(10_000 + k, "gooda " * 12, "en", "g", 80) for k in range(3000)]  # copies, the surest of all
    seen, plain = [], co_training.hand_over
    monkeypatch.setattr(co_training, "hand_over", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = co_training.score_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, LABELS)).collect()
    assert len(got) == len(rows) and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 10_000)
    assert all(r.predicted for r in got if r.doc_id >= 10_000)
    # documents differ by their words; all beyond the 500 places of before count, in no round twice, and the copies as one
    known = len(set(map(frozenset, (t.split() for t in texts.values()))))
    for handed in seen:
        assert all(1200 < n <= 1401 for n in (handed[v][:, -1].sum() for v in "ab")) and min(handed[v][:, -1].min() for v in "ab") > 500
    assert len(seen) == 3 and known > 1200


def test_hand_over_counts(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    lists = [(sorted(rng.choice(6, 3, False).tolist()), sorted(rng.choice(4, 2, False).tolist())) for _ in range(700)]
    w = rng.normal(0, 2, 7), rng.normal(0, 2, 5)
    pool = spark.createDataFrame([tuple(bytearray(co_training._packed(x)) for x in r) for r in lists], "a BINARY, b BINARY").repartition(5)
    got = co_training.hand_over(pool, w, 0.8)
    for view, other in ((0, 1), (1, 0)):
        want = np.zeros((2, len(w[view])), np.int64)
        for r in lists:
            z = w[other][r[other]].sum() + w[other][-1]
            if abs(z) >= math.log(4):
                want[int(z > 0), [*r[view], -1]] += 1
        assert (got["ab"[view]] == want).all() and want.sum() > 700


def test_fit_and_calibrate():
    import numpy as np
    y = np.array([1.0, 1, 1, 0, 0, 0] * 20)
    rows = [np.array([0]) if v else np.array([1]) for v in y]
    w = linear.fit(rows, y, 2)
    assert w[0] > 1 > -1 > w[1]
    a, b = linear.calibrate(np.where(y > 0, 3.0, -1.0), y)
    assert a * 3 + b > 0 > -a + b


# --- decontamination

def contaminated(rows, items, width=10):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").encode().lower())
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[s:s + width])].add(i)
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for s in range(len(w)):
            for n in range(1, width + 1):
                own = windows.get(tuple(w[s:s + n])) if s + n <= len(w) else None
                if own:  # windows of an item without an id are hit, but name no item
                    hit.update(range(s, s + n))
                    found |= own - {None}
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        yield i, len(w), len(hit), len(found), sha, bool(hit)


def test_decontamination(spark, docs, awkward):
    texts = corpus()
    items = [(1, " ".join(texts[5].split()[7:40])), (2, "one"), (10, texts[7].split(" ", 1)[0] + "!"), (3, None), (4, "漢字 emoji"), (None, "ok"), (5, "")]
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    for df in (docs, awkward):
        want = collections.Counter(contaminated([(r.doc_id, r.text) for r in df.collect()], items))
        got = decontamination.contamination(df, bench)
        assert collections.Counter(map(tuple, got.collect())) == want
        clean = decontamination.drop_contaminated(df, bench)
        assert clean.columns == df.columns and clean.count() == sum(n for r, n in want.items() if not r[-1])


def test_word_patterns_name_every_character_alone():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)]))
    for own, contract in ((decontamination.WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
                          (decontamination.ANY_CASE_WORD, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        assert "-" not in own and re.findall(own, every) == re.findall(contract, every)


def test_windows_of_items_without_an_id(spark):
    words = [f"w{k}" for k in range(12)]
    bench = spark.createDataFrame([(None, " ".join(words)), (None, None)], "item_id BIGINT, text STRING")
    rows = [(1, "x " + " ".join(words[1:11]) + " y"), (2, "x " + " ".join(words[:9])), (None, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {tuple(r) for r in decontamination.contamination(df, bench).collect()}
    assert got == set(contaminated(rows, [(None, " ".join(words))])) and (1, 12, 10, 0) in {r[:4] for r in got}
    assert [r.doc_id for r in decontamination.drop_contaminated(df, bench).collect()] == [2]


CLASHES = ["_size", "_each", "_copy", "_s", "_d", "_z", "_n", "_t", "_h", "row", "each", "size", "n", "total", "turn", "copy", "s", "d", "z", "h", "c0", "rows", "a.b"]


def test_columns_named_as_the_operators_own(spark):
    texts = corpus()
    texts[4] = texts[2] + " more"
    fields = ", ".join(f"`{c}` STRING" for c in CLASHES)
    rows = [(i, t, "en", "ab"[i % 2], 0, *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:1], f"{SCHEMA}, {fields}")
    bench = spark.createDataFrame([(1, " ".join(texts[5].split()[7:40]))], "item_id BIGINT, text STRING")
    for out in (mixing.mix(df), decontamination.drop_contaminated(df, bench), jaccard_join.keep_one(df)):
        got = out.collect()
        assert out.columns == df.columns and len(got) > 30
        assert {tuple(r) for r in got} <= {tuple(r) for r in rows}


def test_proximity(spark):
    df = frame(spark, ["alpha x beta", "beta y z gamma alpha", "alpha only", "gamma alpha q q q q beta"])
    index = decontamination.build_index(df)
    phrases = spark.createDataFrame([("p", ["alpha", "beta"])], "phrase STRING, terms ARRAY<STRING>")
    got = {(r.doc_id, r.first, r.last) for r in decontamination.proximity_matches(phrases, index, slop=1).collect()}
    assert got == {(0, 0, 2)}
    assert (1, 0, 4) in {(r.doc_id, r.first, r.last) for r in decontamination.proximity_matches(phrases, index, slop=3).collect()}


# --- mixing and sharding

def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["a", "b", "c", None]), 0) for i in range(600)] + [(1000, "w " * 900, "en", "tiny", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed_sizes(df).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in got:
        size[r.source] += r.size
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:  # water filling by rounds
        left = 1.5 * sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    target |= share
    for s in names:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and math.isclose(r.target, target[s]) and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)
    again = mixing.mixed_sizes(df.repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert copies == collections.Counter({r.doc_id: r.taken // r.size for r in got if r.taken})


def test_rounding_keeps_expected_copies(spark):
    df = spark.createDataFrame([(i, "w " * (5 + i % 7), "en", "s" if i % 2 else "t", 0) for i in range(40)], SCHEMA)
    taken = collections.Counter()
    for seed in range(12):
        for r in mixing.mixed_sizes(df, seed=seed).collect():
            taken[r.doc_id] += r.taken / r.size
            expected = r.target / r.source_size
    assert abs(sum(taken.values()) / len(taken) / 12 - 1.5) < 0.1 and 1 <= expected <= 2


def test_sharding(spark, docs, awkward):
    for df in (docs, awkward):
        rows = sharding.shard(df, n_shards=4, slots=64).collect()
        want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
        for s in range(4):
            places = sorted(r.slot for r in rows if r.shard == s)
            assert places == list(range(len(places)))
    load = collections.Counter()
    for r in sharding.shard(docs, n_shards=4, slots=64).collect():
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) < 1000


def test_equal_rows_spread_over_shards(spark):
    rows = [(7, "the same text " * 15)] * 3000 + [(i, "t" * 20) for i in range(3000)] + [(None, None)] * 1000
    got = sharding.shard(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5), n_shards=6, slots=1024).collect()
    load = collections.Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert len(got) == len(rows) and max(load.values()) - min(load.values()) < 5000
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(6))


def test_slot_maps_change_little(spark, tmp_path):
    weight = [1 + (k * 37) % 101 for k in range(256)]
    first = sharding.rebalance(sharding.first_map(6, 256), weight)
    assert sharding.rebalance(first, weight).shards == first.shards
    grown = sharding.add_shard(first, weight)
    assert all(b in (a, 6) for a, b in zip(first.shards, grown.shards)) and 0 < first.moved(grown) < 60
    for m in (first, grown):
        sharding.store_map(spark, m, str(tmp_path / "maps"))
    assert sharding.load_map(spark, str(tmp_path / "maps")) == grown
    assert sharding.load_map(spark, str(tmp_path / "maps"), first.version) == first


# --- near copies and repeated passages

def shingle_sets(rows, k):
    out = {}
    for i, t in rows:
        w = split(t)
        out[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def linked(rows, k, percent):
    sets, up = shingle_sets(rows, k), {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k,percent,block", [(4, 85, 4), (5, 80, 256)])
def test_jaccard_join(spark, docs, k, percent, block):
    want = linked([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, k, percent, block=block, long=3).collect()}
    assert got == want and len({c for _, c in got.values()}) < len(got)


def test_jaccard_families_of_many_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = frame(spark, texts + texts[:5])
    want = linked([(r.doc_id, r.text) for r in df.collect()], 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, block=16, long=8).collect()}
    assert got == want


def test_shingles_are_shuffled_with_numbers(spark, docs, monkeypatch):
    kinds, left = [], []

    def families(sets, percent, own=jaccard_join.families):
        kinds.append(sets.schema["id"].dataType.simpleString())
        return own(sets, percent)

    def drop(*frames, own=jaccard_join.unstage):
        left.extend(f._staged.rsplit("/", 1)[-1].split("-")[0] for f in frames)
        own(*frames)
    monkeypatch.setattr(jaccard_join, "families", families)
    monkeypatch.setattr(jaccard_join, "unstage", drop)
    jaccard_join.jaccard_components(docs, 4, 85).count()
    assert kinds == ["bigint"] and {"twice", "counts", "prefix", "first"} <= set(left)


def test_divide_skip_equals_counting():
    import numpy as np
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(300, rng.integers(20, 60))).astype(np.int64) for _ in range(40)]
    sets += [np.unique(np.append(s[1:], 999)) for s in sets[:20]]
    for long in (2, 8, 1000):
        block = jaccard_join.InvertedBlock(sets, long)
        for q in sets:
            want = [(d, len(np.intersect1d(q, s))) for d, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))]
            assert sorted(block.search(q, 85)) == want
        found = sorted(zip(*(x.tolist() for x in block.search_all(sets, 85))))
        assert found == sorted((k, d) for k, q in enumerate(sets) for d, _ in block.search(q, 85))


def test_keep_one(spark, docs, awkward):
    kept = jaccard_join.keep_one(docs)
    want = linked([(r.doc_id, r.text) for r in docs.collect()], 4, 85)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    ids = [r.doc_id for r in jaccard_join.keep_one(awkward).collect()]
    assert ids.count(4) == 1 and ids.count(None) == 2 and ids.count(0) == 1
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long), (None, long), (None, long + " end"), (None, "other words here " * 9), (None, "other words here " * 9), (None, None)]
    out = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter([rows[0], rows[3], rows[5]])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a BIGINT, b BIGINT")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_of_one_partition_need_no_round(spark, monkeypatch):
    rows = [(i, i + 1) for i in range(3000)] + [(5000 + i, 5000) for i in range(1, 9)]
    edges = spark.createDataFrame(rows, "a BIGINT, b BIGINT")
    want = {i: 0 for i in range(3001)} | {5000 + i: 5000 for i in range(9)}
    stored = []
    with monkeypatch.context() as watched:
        watched.setattr("atlasmill.llm.common.stage", lambda df, name: stored.append(name) or stage(df, name))
        assert {r.id: r.component for r in components(edges).collect()} == want
    assert stored == ["edges"]
    monkeypatch.setattr("atlasmill.llm.common.CONTRACTED", 64)  # tasks that hold few ids still lose no link
    texts = edges.selectExpr("format_string('n%05d', a) AS a", "format_string('n%05d', b) AS b")
    assert {r.id: r.component for r in components(texts).collect()} == {f"n{i:05d}": f"n{c:05d}" for i, c in want.items()}


def test_repeated_passages(spark, docs):
    rows = {r.doc_id: split(r.text) for r in docs.collect()}
    seen, want = collections.defaultdict(set), collections.defaultdict(set)
    for i, w in rows.items():
        for s in range(len(w) - 49):
            seen[tuple(w[s:s + 50])].add(i)
    for i, w in rows.items():
        for s in range(len(w) - 49):
            if len(seen[tuple(w[s:s + 50])]) > 1:
                want[i].update(range(s, s + 50))
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
        text = b" " + b" ".join(rows[r.other_doc_id]) + b" "
        assert b" " + b" ".join(rows[r.doc_id][r.start_word:r.end_word]) + b" " in text and r.doc_id != r.other_doc_id
    assert got == want and {20, 30} <= set(got)


# --- language model

def test_tree_weighting(spark, docs):
    import numpy as np
    rows = tree_weighting.score(docs, chunk_bytes=4096).collect()
    train, texts = collections.Counter(), {r.doc_id: r.text for r in docs.collect()}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update(split(t) + [None])
    n, v = sum(train.values()), len(train)
    for r in rows:
        tokens = split(texts[r.doc_id]) + [None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[x] > 0 for x in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens), rel_tol=1e-9)
    want = slow_tree(texts)
    assert all(np.isclose(r.score, want(r.doc_id), rtol=1e-6) for r in rows[:5])


def test_strings_go_packed_and_meet_by_slot(spark, docs):
    import numpy as np
    numbers = np.array([0, 1, 255, 256, (1 << 48) - 1])
    assert tree_weighting.unpacked(tree_weighting.packed(numbers), 5).tolist() == numbers.tolist()
    rows = [(k % 2, r.text, r.doc_id % 3 == 0) for k, r in enumerate(docs.collect())]
    dealt = spark.createDataFrame(rows, "chunk INT, text STRING, held_out BOOLEAN")
    counted = tree_weighting.chunk_counts(dealt, 4).cache()
    strings = counted.filter("NOT is_word").collect()
    assert max(r.n for r in strings) <= tree_weighting.A_ROW and sum(r.n for r in strings) > 100 * len(strings)
    want = collections.Counter()
    for _, text, held_out in rows:
        data = b"\xff" * 5 + (text or "").encode().lower() + b"\xff"
        for i in range(5, len(data)):
            want[int.from_bytes(data[i - 5:i + 1], "big")] += not held_out
    words = [b"", b"a", b"\xc3\xa9"]
    assert tree_weighting.parted(tree_weighting.joined(words)) == words and tree_weighting.parted(tree_weighting.joined([b""])) == [b""]
    tokens = collections.Counter()
    for _, text, held_out in rows:
        tokens.update({w: 0 for w in (text or "").encode().lower().split()} if held_out else (text or "").encode().lower().split() + [b""])
    found = tree_weighting.word_counts(counted).collect()
    assert {bytes(r.word): r.c for r in found} == dict(tokens) and len(found) == len(tokens)
    got = tree_weighting.string_counts(counted).collect()
    assert {r.key: r.n for r in got} == dict(want) and len(got) == len(want) and all(r.pair == (r.key >> 8) & 0xFFFF for r in got)


def slow_tree(texts):
    """Context-tree weighting node by node, in dictionaries."""
    depth, counts = tree_weighting.DEPTH, collections.defaultdict(lambda: [0, 0])

    def steps(text):
        data = b"\xff" * depth + (text or "").encode().lower() + b"\xff"
        for i in range(depth, len(data)):
            for j in range(8):
                yield data[i - depth:i], (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1

    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            for context, node, bit in steps(t):
                for d in range(depth + 1):
                    counts[context[depth - d:], node][bit] += 1
    own = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
    weighted, below = {}, collections.defaultdict(float)
    for k in sorted(counts, key=lambda k: -len(k[0])):
        weighted[k] = own[k] if len(k[0]) == depth else math.log(0.5) + max(own[k], below[k]) + math.log1p(math.exp(-abs(own[k] - below[k])))
        if k[0]:
            below[k[0][1:], k[1]] += weighted[k]

    def score(i):
        total = 0.0
        for context, node, bit in steps(texts[i]):
            p = 0.5
            for d in range(depth, -1, -1):
                k = context[depth - d:], node
                if k in counts:
                    kt = (counts[k][bit] + 0.5) / (sum(counts[k]) + 1)
                    w = 1.0 if d == depth else 1 / (1 + math.exp(min(600, below[k] - own[k])))
                    p = kt * w + p * (1 - w)
            total += math.log10(p)
        return total
    return score


# --- awkward input

def test_awkward_input(spark, awkward, docs):
    marks = spark.createDataFrame([(0, None, None), (None, 1, 1), (4, 1, 0), (4, 1, 0)], LABELS)
    n = awkward.count()
    tables = [toxicity.score_toxicity(awkward, marks), co_training.score_quality(awkward, marks), quality_rules.judge(awkward, marks),
              mixing.mixed_sizes(awkward), jaccard_join.jaccard_components(awkward), tree_weighting.score(awkward)]
    for df in tables:
        rows = df.collect()
        assert len(rows) == n and sum(r.doc_id is None for r in rows) == 2
    assert {r.doc_id for r in suffix_dedup.repeated_passages(awkward).collect()} == set()
    assert mixing.mix(awkward).columns == awkward.columns and toxicity.drop_toxic(awkward, marks).count() == n


def test_empty_tables(spark, docs):
    none, no_labels = docs.limit(0), spark.createDataFrame([], LABELS)
    bench = spark.createDataFrame([], "item_id BIGINT, text STRING")
    for df in (token_counts.token_counts(none, model_bytes()), toxicity.score_toxicity(none, no_labels), co_training.score_quality(none, no_labels),
               decontamination.contamination(none, bench), mixing.mixed_sizes(none), mixing.mix(none), sharding.shard(none), quality_rules.judge(none, no_labels),
               jaccard_join.jaccard_components(none), jaccard_join.keep_one(none), tree_weighting.score(none), suffix_dedup.repeated_passages(none)):
        assert df.count() == 0
    assert decontamination.contamination(docs, bench).filter("contaminated").count() == 0


def test_fold_of_null(spark):
    rows = spark.createDataFrame([(None,), (7,)], "doc_id BIGINT").select(fold("doc_id", 3).alias("f")).collect()
    assert [r.f for r in rows] == [0, zlib.crc32(b"7") % 3]
