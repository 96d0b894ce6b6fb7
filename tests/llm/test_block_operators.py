"""Periodic runs, conversation repair and substring dedup against brute force, and on awkward tables."""

import hashlib
import heapq
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from atlasmill.llm import conversation_repair, path_compaction, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [None, "", " \t\n", "one", "A a", "x" * 5000, "w " * 3000, "é ß 漢字 emoji 🙂 ok", "\x1c a\x1cb   c"]
EXTRA = "doc_id BIGINT, text STRING, lang STRING, row STRING, spans STRING, part BIGINT, best STRING, `a.b` STRING, place STRING, uid STRING"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward(spark):
    """Null ids and texts, repeated rows, one id for two texts, and columns named as the operators' own."""
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(4, "A a"), (4, "A a"), (4, "another text"), (None, "no id"), (None, None), (None, "w " * 3000)]
    return spark.createDataFrame([(i, t, None, "r", "s", 7, "b", "ab", "p", None) for i, t in rows], EXTRA)


def brute_runs(words, least=24, power=3):
    found = {}
    ids: dict = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words])
    for q in range(1, len(words) // power + 1):
        edge = np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a + q >= max(least, power * q):
                found.setdefault((int(a), int(b + q)), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def looped(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapsed(words, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected_digest(doc_id, text):
    words = looped(doc_id, text)
    runs = brute_runs(words)
    best = (None,) * 4
    if runs:
        a, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = a, length, q, 1000 * length // q
    return (doc_id, len(runs), *best, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(words, runs)))


def test_runs_of_arrays_match_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        least, power, k, s = rng.choice([2, 3, 5, 8, 11, 24, 30, 50]), rng.choice([3, 3, 4]), rng.choice([1, 2, 2, 3, 10]), []
        while len(s) < 160:
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 30))]
            if rng.random() < .5:
                unit = unit[:3] * rng.randint(1, 5) + unit
            s += (unit * rng.randint(1, 8))[:rng.randint(1, 160)] if rng.random() < .6 else unit[:9]
        s = s[:rng.randint(1, 160)]
        got = periodic_runs.find_runs(np.array([*s, 99]), least, power)
        assert sorted((a, b - a, q) for a, b, q in got) == brute_runs(s, least, power)


def test_wavelet_tree_successors():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = periodic_runs.Wavelet(values)
        for _ in range(50):
            lo, hi = sorted(rng.integers(0, n + 1, 2))
            v = int(rng.integers(0, n))
            one = lambda x: np.array([x], np.int64)
            assert tree.below(one(lo), one(hi), one(v))[0] == (values[lo:hi] < v).sum()
            for k, want in enumerate(sorted(values[lo:hi])):
                assert tree.smallest(one(lo), one(hi), one(k))[0] == want


def test_run_digest_matches_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for i in range(150):
        words = [rng.choice(["a", "b", "Ab", "é"]) if i % 3 else str(rng.randrange(50)) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            words += words[:rng.randint(1, 20)] * rng.randint(3, 9) + words[5:9]
        texts.append(" \t".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(7)
    got = {tuple(r) for r in periodic_runs.run_digest(df).collect()}
    assert got == {expected_digest(i, t) for i, t in enumerate(texts)}
    assert sum(r[1] > 1 for r in got) > 10  # ties and several runs occur


def test_runs_of_awkward_rows(spark):
    df = awkward(spark)
    rows = df.collect()
    got = sorted((tuple(r) for r in periodic_runs.run_digest(df).collect()), key=repr)
    assert got == sorted((expected_digest(r.doc_id, r.text) for r in rows), key=repr)
    out = periodic_runs.periodic_runs(df)
    assert out.columns == [*df.columns, "n_words", "runs", "collapsed"]
    assert sorted((r.doc_id, r.lang, r["a.b"], r.part) for r in out.filter("doc_id = 4").collect()) == [(4, None, "ab", 7)] * 4
    assert periodic_runs.run_digest(df.limit(0)).count() == 0


def test_runs_of_a_long_text(spark):
    words = [f"w{i % 40_000}" for i in range(300_000)]
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id INT, text STRING")).first()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 40_000)]
    assert row.collapsed == " ".join(words[:40_000])


# conversations

TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, dropped BOOLEAN"


def cheapest(rows, faults):
    """Cheapest edits, ASCII-least of them, and the turns they leave, by search over (cost, edits)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        steps = [("user", "", 3, "I", 0), ("assistant", "", 3, "I", 0)]
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                steps += [(role, text, more, "K", 1), ("user", text, 3 + more, "R", 1), ("assistant", text, 3 + more, "R", 1)]
        for role, text, price, edit, step in steps:
            if (last or "-") + role[:1] in ("-s", "-u", "su", "ua", "au") and role:
                heapq.heappush(heap, (cost + price, audit + edit, i + step, role[0], (*out, f"{role}:{text}")))


def expected_report(conv, given):
    rows = sorted(((t is not None, t or 0, r or (" " if r is None else ""), x if x is not None else " ") for t, r, x, gone in given if not gone))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    cost, audit, out = cheapest([r[2:] for r in rows], faults)
    turns = [r[1] for r in rows if r[0]]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(out))


def random_turns(rng, n, ties=False):
    texts = ["Fine.", "cut off", "", " \n", "What?", "No!", None, "Same.", "Same."]
    return [(k // (2 if ties else 1) if rng.random() < .9 else k + 3, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
             rng.choice(texts) if rng.random() < .5 else f"Text {k}.", rng.random() < .05) for k in range(n)]


@pytest.mark.parametrize("chunk_rows", [1, 4, 2048])
def test_repair_matches_brute_force(spark, monkeypatch, chunk_rows):
    rng = random.Random(chunk_rows)
    conversations = {c: [(t, r, x, g) for t, r, x, g in random_turns(rng, rng.randint(0, 14))] for c in range(120)}
    conversations[None] = random_turns(rng, 9)
    # within one turn the order is by role and a digest, so keep texts of one turn equal
    for c, turns in conversations.items():
        first = {}
        conversations[c] = [(t, *first.setdefault(t, (r, x)), g) for t, r, x, g in turns]
    rows = [(c, *turn) for c, turns in conversations.items() for turn in turns]
    rng.shuffle(rows)
    monkeypatch.setattr(conversation_repair, "CHUNK_ROWS", chunk_rows)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    # chunk size reaches the tasks by value through the closure of the function under test
    got = {tuple(r) for r in conversation_repair.repair_report(df).collect()}
    assert got == {expected_report(c, turns) for c, turns in conversations.items() if turns}


def test_long_conversation_over_many_chunks(spark):
    rng = random.Random(3)
    turns = [(k, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", "cut", f"Text {k}."]), False) for k in range(9000)]
    df = spark.createDataFrame([(1, *t) for t in turns], TURNS).repartition(9)
    assert [tuple(r) for r in conversation_repair.repair_report(df).collect()] == [expected_report(1, turns)]
    left = conversation_repair.repaired_turns(df).orderBy("place").collect()
    assert sha("\n".join(f"{r.role}:{r.text}" for r in left)) == expected_report(1, turns)[-1]
    assert [r.place for r in left] == list(range(len(left)))


def test_block_tables():
    t = conversation_repair.tables()
    assert len(t.vectors) < 100 and t.all[0].shape == (len(t.vectors), conversation_repair.SYMBOLS ** conversation_repair.BLOCK)
    rng = random.Random(4)
    for _ in range(300):
        symbols = bytes(rng.randrange(conversation_repair.SYMBOLS) for _ in range(rng.randint(0, 20)))
        left, cost, out = t.summary(symbols)
        for v, vector in enumerate(t.vectors):
            for s in reversed(symbols):
                vector = conversation_repair._before(s, vector)
            assert tuple(c + cost[v] for c in t.vectors[left[v]]) == tuple(c + t.vectors[v][0] * 0 for c in vector)
            assert all(t.trace(symbols, v, q)[1] == out[v][q] for q in range(4))


def test_damage_and_empty_conversations(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}. Yes!") for c in range(40) for t in range(5)]
    turns += [(None, None, None, None), (50, None, "user", "No turn.")]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, chunk STRING, kind INT")
    damaged = {}
    for c, t, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1))
    got = {tuple(r) for r in conversation_repair.repair_report(conversation_repair.damage(df)).collect()}
    assert got == {expected_report(c, t) for c, t in damaged.items()}
    gone = spark.createDataFrame([(7, 1, "user", "Hi.", True)], TURNS)
    assert tuple(conversation_repair.repair_report(gone).first()) == (7, 0, 0, 0, 0, 0, 0, "", sha(""))
    assert conversation_repair.repair_report(gone.limit(0)).count() == 0
    assert conversation_repair.repaired_turns(gone).count() == 0


# substring dedup


def expected_cuts(rows, least=50):
    first, texts = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in texts:
        for k in range(len(words) - least + 1):
            if i is not None:
                window = tuple(words[k:k + least])
                first[window] = min(first.get(window, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - least + 1):
            if i is not None and first[tuple(words[k:k + least])] < i:
                gone.update(range(k, k + least))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def cuts(df, least=50):
    return sorted((tuple(r) for r in path_compaction.cut_repeats(df, least).select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


@pytest.mark.parametrize("least", [20, 50])
def test_cut_repeats_matches_brute_force(spark, least):
    rng = random.Random(least)
    vocabulary = [f"w{k}" for k in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [some(rng.randint(45, 140)) for _ in range(6)]
    rows = []
    for i in range(90):
        words = some(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):  # whole passages and parts of them, some twice in a text
            p = rng.choice(shared)
            a = rng.randint(0, 30)
            words += p[a:a + rng.randint(20, 140)] + some(rng.randint(0, 9))
        rows.append((i, words))
    for i in range(90, 120):  # near copies of one text
        words = list(rows[5][1] + shared[0])
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, words))
    rows += [(120, rows[7][1]), (121, rows[7][1]), (3, some(60) + shared[1]), (3, some(70) + shared[1]), (None, shared[2]), (None, shared[2])]
    rows += [rows[120]] * 2 + [(200, ["a"] * 300), (201, ["a"] * 120), (202, ["A"] * 120)]
    rows = [(i, " \n".join(words)) for i, words in rows]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(6)
    got = cuts(df, least)
    assert got == expected_cuts(rows, least)
    assert sum(r[2] for r in got) > 1000


def test_cut_repeats_on_awkward_rows(spark):
    df = awkward(spark)
    assert cuts(df) == expected_cuts([(r.doc_id, r.text) for r in df.collect()])
    out = path_compaction.cut_repeats(df)
    assert out.columns == [*df.columns, "n_words", "n_removed", "kept"]
    assert {(r.row, r.spans, r.part, r["a.b"]) for r in out.collect()} == {("r", "s", 7, "ab")}
    assert cuts(df.limit(0)) == []


def test_cut_repeats_in_texts_of_several_megabytes(spark):
    rng = random.Random(1)
    words = [f"word{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:200_000])), (3, "x " + " ".join(words[100_000:100_060]))]
    got = cuts(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert got == sorted([(1, 300_000, 0, rows[0][1]), (2, 199_000, 199_000, ""), (3, 61, 60, "x")], key=repr)
