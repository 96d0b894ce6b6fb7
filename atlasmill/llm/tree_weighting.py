"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree over the bytes before it. A node at
depth d counts its zeros and ones; its Krichevsky-Trofimov estimate is mixed with the product of
its children with weight one half, for all depths at once. With the counts of the training texts
fixed, the chance of a byte is the product of the eight mixed chances, so it sums to one.

On Spark: texts are dealt into chunks of bounded size. A chunk sends every distinct (context,
byte) string and every distinct word once, with its count in training texts; they go by hashed slots, up to
``A_ROW`` of one chunk and slot in a row. A slot's rows meet in one task, which sums them; the sums are
tables without bound, never broadcast. Subtrees that share the last two context bytes are worked out together, first
upwards, then down to the chance of every string that occurs anywhere. Depths 0 and 1 have at
most 257 * 255 nodes, which is the bound for their broadcast. A slot's chances and word counts meet the
slot's rows again and return with them to the chunks; a task holds those of one chunk, sixteen bytes a
string, and streams the chunk's texts past them.

Contexts are cut at ``DEPTH`` bytes, so that a string with its next byte is one 64-bit key.
"""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.llm.common import fold, parallelism, stage, unstage

#: Context bytes; with the next byte a string fits into 64 bits.
DEPTH = 5
#: Ends a text and fills its first contexts; no byte of UTF-8 has this value.
END = 255
CHUNK_BYTES = 8 << 20
_SLICE = 1 << 20
#: Positions sorted at once when strings are looked up; a position takes ``_LOOK_BITS`` bits beside its 48-bit key.
_LOOK_BITS = 15
#: Strings or words of a chunk and slot in one row, and the most slots.
A_ROW, MOST_SLOTS = 1024, 4096
#: Characters of texts that a task scores together.
TEXTS_AT_ONCE = 1 << 20


def log_gamma(x: np.ndarray) -> np.ndarray:
    z, low = x + 8, np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    s = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + s / 12 - s**3 / 360 + s**5 / 1260 - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def strings_of(texts: list[bytes], at_once: int = _SLICE):
    """Slices of bounded size: ``(keys, owner)`` of all positions, a key being context and next byte."""
    pad = bytes([END]) * DEPTH
    raw = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    where = np.arange(int(lengths.sum())) + DEPTH * (owner + 1)
    for at in range(0, len(where), at_once):
        spots = where[at:at + at_once]
        first, end = int(spots[0]), int(spots[-1]) + 1
        keys = np.zeros(end - first, np.int64)
        for j in range(DEPTH + 1):
            keys = (keys << 8) | raw[first - DEPTH + j:end - DEPTH + j]
        yield keys[spots - first], owner[at:at + at_once]


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """Strings with the same first four bytes share a slot."""
    mixed = (keys >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(slots)).astype(np.int32)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, byte plane by byte plane, so that equal high bytes lie together."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def joined(words: list[bytes]) -> bytes:
    """Words, none of which has a space, as one value."""
    line = b" ".join(words)
    return len(line).to_bytes(8, "little") + pa.compress(line, codec="zstd", asbytes=True)


def parted(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b" ")


class Subtree:
    """Nodes at depths 2 to DEPTH below one pair of last context bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        seen = counts > 0
        self.nodes, below = {}, None
        for d in range(DEPTH, 1, -1):
            path, byte = self.path(keys[seen], d), keys[seen] & 255
            strings, inverse = np.unique((path << 8) | byte, return_inverse=True)
            n = np.bincount(inverse, counts[seen], len(strings)) if len(strings) else np.zeros(0)
            path, byte = strings >> 8, strings & 255
            names = np.concatenate([self.name(path, byte, j) for j in range(8)])
            ones = np.concatenate([n * ((byte >> (7 - j)) & 1) for j in range(8)])
            names, inverse = np.unique(names, return_inverse=True)
            one = np.bincount(inverse, ones, len(names)).astype(float)
            zero = np.bincount(inverse, np.tile(n, 8), len(names)) - one
            own = log_kt(zero, one)
            if below is None:
                log_beta, weighted = np.zeros(len(names)), own
            else:
                lower, values = below
                up = np.searchsorted(names, ((lower >> 16) << 8) | (lower & 255))
                children = np.bincount(up, values, len(names))
                log_beta, weighted = own - children, np.logaddexp(own, children) - math.log(2)
            self.nodes[d] = names, zero, one, log_beta, weighted
            below = names, weighted

    @staticmethod
    def path(keys: np.ndarray, depth: int) -> np.ndarray:
        """Context bytes before the last two, the latest one in front."""
        out = np.zeros(len(keys), np.int64)
        for k in range(depth - 2):
            out = (out << 8) | ((keys >> (24 + 8 * k)) & 255)
        return out

    @staticmethod
    def name(path: np.ndarray, byte: np.ndarray, j: int) -> np.ndarray:
        return (path << 8) | (1 << j) | (byte >> (8 - j))

    def chances(self, keys: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Log10 of the chance of each string's last byte after its context."""
        total, byte, last = np.zeros(len(keys)), keys & 255, (keys >> 8) & 255
        for j in range(8):
            bit = (byte >> (7 - j)) & 1
            p = None
            for d in range(DEPTH, 1, -1):
                names, zero, one, log_beta, _ = self.nodes[d]
                want = self.name(self.path(keys, d), byte, j)
                at = np.minimum(np.searchsorted(names, want), max(len(names) - 1, 0))
                known = names[at] == want if len(names) else np.zeros(len(keys), bool)
                if len(names):
                    own = np.where(known, (np.where(bit == 1, one[at], zero[at]) + 0.5) / (zero[at] + one[at] + 1), 0.5)
                    beta = np.where(known, log_beta[at], 0.0)
                else:
                    own, beta = np.full(len(keys), 0.5), np.zeros(len(keys))
                p = own if p is None else _blend(own, p, beta)
            node = (1 << j) | (byte >> (8 - j))
            for one_chance, log_beta in (low[1], low[0]):
                own = one_chance[last, node]
                p = _blend(np.where(bit == 1, own, 1 - own), p, log_beta[last, node])
            total += np.log10(p)
        return total


def _blend(own: np.ndarray, child: np.ndarray, log_beta: np.ndarray) -> np.ndarray:
    w = 1 / (1 + np.exp(-np.clip(log_beta, -60, 60)))
    return own * w + child * (1 - w)


def low_nodes(rows) -> tuple:
    """Depths 0 and 1 as ``(chance of a one, log beta)`` by last byte and node, from the sums over depth 2."""
    zero, one, children = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for r in rows:
        zero[r.last, r.node], one[r.last, r.node], children[r.last, r.node] = r.zero, r.one, r.weighted
    own = log_kt(zero, one)
    weighted = np.where(zero + one > 0, np.logaddexp(own, children) - math.log(2), 0.0)
    first = (one + 0.5) / (zero + one + 1), np.where(zero + one > 0, own - children, 0.0)
    z0, o0 = zero.sum(0), one.sum(0)
    beta = np.where(z0 + o0 > 0, log_kt(z0, o0) - weighted.sum(0), 0.0)
    root = np.tile((o0 + 0.5) / (z0 + o0 + 1), (256, 1)), np.tile(beta, (256, 1))
    return root, first


def _words(text: bytes) -> list[bytes]:
    return text.split()  # bytes: ASCII white space only


def _merged(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    k, n = np.concatenate(keys), np.concatenate(numbers)
    order = np.argsort(k)
    k, n = k[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[heads], np.add.reduceat(n, heads) if len(k) else n


COUNTED = "chunk int, slot int, is_word boolean, n long, items binary, counts binary"


def chunk_counts(dealt: DataFrame, slots: int) -> DataFrame:
    """Distinct strings and words of each chunk with their number in training texts.

    A row has ``n`` strings or words of a slot in order, strings packed as differences, and their packed
    counts. Texts stream through; a task holds a chunk's distinct strings and words and a bounded number
    not yet merged.
    """

    def count(texts, keys, numbers, pending, words):
        raw = [t.encode().lower() if t else b"" for t, _ in texts]
        train = ~np.array([h for _, h in texts], bool)
        for part, owner in strings_of(raw):
            pending.append((part << 1) | train[owner])
            if sum(map(len, pending)) >= 2 * _SLICE:
                fold_in(keys, numbers, pending)
        for t, learns in zip(raw, train.tolist()):
            if learns:
                words.update(_words(t))
                words[b""] += 1  # the end
            else:
                for w in _words(t):
                    words.setdefault(w, 0)
        if sum(map(len, keys[1:])) > max(_SLICE, len(keys[0])):
            merged = _merged(keys, numbers)
            keys[:], numbers[:] = [merged[0]], [merged[1]]

    def fold_in(keys, numbers, pending):
        if pending:
            marked = np.sort(np.concatenate(pending))
            pending.clear()
            own = marked >> 1
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            keys.append(own[heads])
            numbers.append(np.add.reduceat(marked & 1, heads))

    def rows_of(chunk, keys, numbers, pending, words):
        fold_in(keys, numbers, pending)
        keys, counts = _merged(keys, numbers)
        pack = lambda some: packed(np.diff(some, prepend=0))
        yield from dealt_rows(chunk, False, slot_of(keys, slots), keys, counts, pack)
        names = sorted(words)
        yield from dealt_rows(chunk, True, np.array([zlib.crc32(w) % slots for w in names], np.int32), np.array(names, object),
                              np.array([words[w] for w in names], np.int64), lambda some: joined(some.tolist()))

    def dealt_rows(chunk, is_word, slot, items, counts, pack):
        order = np.argsort(slot, kind="stable")  # those of a slot stay in order
        slot, items, counts = slot[order], items[order], counts[order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])), len(slot)).tolist()
        cuts = [(at, min(at + A_ROW, end)) for start, end in zip(edges, edges[1:]) for at in range(start, end, A_ROW)]
        for at in range(0, len(cuts), 256):
            some = cuts[at:at + 256]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(some), chunk, np.int32)), pa.array(slot[[i for i, _ in some]]), pa.array([is_word] * len(some)),
                pa.array([j - i for i, j in some], pa.int64()), pa.array([pack(items[i:j]) for i, j in some], pa.binary()),
                pa.array([packed(counts[i:j]) for i, j in some], pa.binary())], names=["chunk", "slot", "is_word", "n", "items", "counts"])

    def run(batches):
        chunk, texts, held, state = None, [], 0, None
        for batch in batches:
            for number, text, held_out in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if number != chunk:
                    if state:
                        count(texts, *state)
                        yield from rows_of(chunk, *state)
                    chunk, texts, held, state = number, [], 0, ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], collections.Counter({b"": 0}))
                texts.append((text, held_out))
                held += len(text or "")
                if held > TEXTS_AT_ONCE:
                    count(texts, *state)
                    texts, held = [], 0
        if state:
            count(texts, *state)
            yield from rows_of(chunk, *state)

    spread = dealt.select("chunk", "text", "held_out").repartition(parallelism(dealt.sparkSession), "chunk").sortWithinPartitions("chunk")
    return spread.mapInArrow(run, COUNTED)


def string_counts(counted: DataFrame) -> DataFrame:
    """``(pair, key, n)``: distinct strings of all chunks and their number in training texts.

    A task holds one slot's distinct strings and a bounded number not yet merged.
    """

    def rows_of(keys, numbers):
        keys, counts = _merged(keys, numbers)
        for at in range(0, len(keys), 1 << 16):
            k = keys[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(((k >> 8) & 0xFFFF).astype(np.int32)), pa.array(k), pa.array(counts[at:at + (1 << 16)])],
                                             names=["pair", "key", "n"])

    def run(batches):
        slot, keys, numbers = None, [], []
        for batch in batches:
            for own, n, k, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own != slot:
                    if keys:
                        yield from rows_of(keys, numbers)
                    slot, keys, numbers = own, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                keys.append(np.cumsum(unpacked(k, n)))
                numbers.append(unpacked(c, n))
                if A_ROW * len(keys) > max(_SLICE, 2 * len(keys[0])):
                    merged = _merged(keys, numbers)
                    keys, numbers = [merged[0]], [merged[1]]
        if keys:
            yield from rows_of(keys, numbers)

    rows = counted.filter("NOT is_word").select("slot", "n", "items", "counts")
    return rows.repartition(parallelism(counted.sparkSession), "slot").sortWithinPartitions("slot").mapInArrow(run, "pair int, key long, n long")


def word_counts(counted: DataFrame) -> DataFrame:
    """``(slot, word, c)``: distinct words of all chunks and their number in training texts; a task holds one slot's."""

    def rows_of(slot, words):
        names = list(words)
        for at in range(0, len(names), 1 << 16):
            some = names[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), slot, np.int32)), pa.array(some, pa.binary()), pa.array([words[w] for w in some], pa.int64())],
                                             names=["slot", "word", "c"])

    def run(batches):
        slot, words = None, {}
        for batch in batches:
            for own, n, items, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own != slot:
                    if words:
                        yield from rows_of(slot, words)
                    slot, words = own, {}
                for w, c in zip(parted(items), unpacked(counts, n).tolist()):
                    words[w] = words.get(w, 0) + c
        if words:
            yield from rows_of(slot, words)

    rows = counted.filter("is_word").select("slot", "n", "items", "counts")
    return rows.repartition(parallelism(counted.sparkSession), "slot").sortWithinPartitions("slot").mapInArrow(run, "slot int, word binary, c long")


def returned(counted: DataFrame, chance: DataFrame, words: DataFrame) -> DataFrame:
    """``(chunk, is_word, n, items, found)``: every row of a chunk with its strings' chances or the packed counts of its words."""

    def run(batches):
        """A slot's chances and word counts, then its rows."""
        slot, keys, chances, totals = None, [], [], {}
        for batch in batches:
            slots, out = batch.column(0).to_numpy(), []
            edges = np.flatnonzero(np.diff(slots)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(slots)]):
                if slots[start] != slot:
                    slot, keys, chances, totals = slots[start], [np.zeros(0, np.int64)], [np.zeros(0)], {}
                part = batch.slice(start, end - start)
                known = part.slice(0, int((~part.column(1).to_numpy(zero_copy_only=False)).sum()))  # what is known comes first
                if known.num_rows:
                    of_words = np.asarray(known.column(3).is_valid())
                    values = known.column(4).to_numpy()
                    keys.append(known.column(2).drop_null().to_numpy())
                    chances.append(values[~of_words])
                    totals.update(zip(known.column(3).drop_null().to_pylist(), values[of_words].astype(np.int64).tolist()))
                if known.num_rows == part.num_rows:
                    continue
                if isinstance(keys, list):
                    keys, chances = np.concatenate(keys), np.concatenate(chances)
                    order = np.argsort(keys)
                    keys, chances = keys[order], chances[order]
                for chunk, is_word, n, items in zip(*(part.column(i).slice(known.num_rows).to_pylist() for i in (5, 6, 7, 8))):
                    found = packed(np.array([totals[w] for w in parted(items)], np.int64)) if is_word else chances[np.searchsorted(keys, np.cumsum(unpacked(items, n)))].tobytes()
                    out.append((chunk, is_word, n, items, found))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()))],
                                             names=["chunk", "is_word", "n", "items", "found"])

    def columns(rows, asks, **own):
        kinds = {"key": "long", "word": "binary", "value": "double", "chunk": "int", "is_word": "boolean", "n": "long", "items": "binary"}
        return rows.select("slot", F.lit(asks).alias("asks"), *[F.col(own[c]).cast(t).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])

    rows = columns(counted, True, chunk="chunk", is_word="is_word", n="n", items="items")
    given = columns(chance, False, key="key", value="chance").unionByName(columns(words, False, word="word", value="c"))
    met = given.unionByName(rows).repartition(parallelism(counted.sparkSession), "slot").sortWithinPartitions("slot", "asks")
    return met.mapInArrow(run, "chunk int, is_word boolean, n long, items binary, found binary")


def string_chances(strings: DataFrame, slots: int) -> DataFrame:
    """``(slot, key, chance)`` from ``(pair, key, n)``: log10 chance of each string's last byte."""
    schema = T.StructType([T.StructField("last", T.IntegerType()), T.StructField("node", T.IntegerType()),
                           T.StructField("zero", T.DoubleType()), T.StructField("one", T.DoubleType()), T.StructField("weighted", T.DoubleType())])

    def up(rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_numpy()
        names, zero, one, _, weighted = Subtree(keys, rows.column("n").to_numpy()).nodes[2]
        return pa.table({"last": pa.array(np.full(len(names), (keys[0] >> 8) & 255, np.int32)), "node": pa.array((names & 255).astype(np.int32)),
                         "zero": pa.array(zero, pa.float64()), "one": pa.array(one, pa.float64()), "weighted": pa.array(weighted, pa.float64())})

    rows = (strings.groupBy("pair").applyInArrow(up, schema).groupBy("last", "node")
            .agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("weighted").alias("weighted")).collect())
    low = strings.sparkSession.sparkContext.broadcast(low_nodes(rows))

    def down(rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_numpy()
        return pa.table({"slot": pa.array(slot_of(keys, slots)), "key": rows.column("key"), "chance": pa.array(Subtree(keys, rows.column("n").to_numpy()).chances(keys, low.value))})

    return strings.groupBy("pair").applyInArrow(down, "slot int, key long, chance double")


def score(docs: DataFrame, held_out_fold: int = 0, folds: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``.

    ``score`` is the log10 probability of the whole text in lower case (A-Z) with its end;
    ``bits_per_byte`` its code length a byte. The base is the unigram model over words and one end
    a text. Null texts are empty: one token, the end. Rows with a null id fall into fold 0. With no
    training text the base is 0 for every token and the tree is uniform. Repeated rows count, and
    are scored, once each.
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", (fold("doc_id", folds) == held_out_fold).alias("held_out"), "text")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(size / chunk_bytes))
    dealt = known.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int"))
    slots = min(MOST_SLOTS, 4 * parallelism(spark))
    counted = stage(chunk_counts(dealt, slots), "chunk-counts")
    words = stage(word_counts(counted), "words")
    n_train, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    strings = stage(string_counts(counted), "strings")
    chance = stage(string_chances(strings, slots), "chances")
    unstage(strings)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("bits_per_byte", T.DoubleType())])
    floor, under = 0.1, n_train + 0.1 * (distinct + 1)

    def add_up(texts: list[tuple], keys: np.ndarray, chances: np.ndarray, counts: dict) -> pa.RecordBatch:
        raw = [t.encode().lower() if t else b"" for _, _, t in texts]
        scores, place = np.zeros(len(raw)), (1 << _LOOK_BITS) - 1
        for part, owner in strings_of(raw, 1 << _LOOK_BITS):
            marked = np.sort((part << _LOOK_BITS) | np.arange(len(part)))  # look-ups in order stay in the cache
            scores += np.bincount(owner[marked & place], chances[np.searchsorted(keys, marked >> _LOOK_BITS)], len(raw))
        tokens, hits, base = [], [], []
        for t in raw:
            found = np.array([counts[w] for w in _words(t)] + [counts[b""]], float)
            tokens.append(len(found))
            hits.append(np.count_nonzero(found))
            base.append(float(np.log10((found + floor) / under).sum()))
        sizes = np.array([len(t) for t in raw])
        return pa.RecordBatch.from_arrays([
            pa.array([t[0] for t in texts], id_type), pa.array([t[1] for t in texts]), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()),
            pa.array([n_train] * len(raw), pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(sizes),
            pa.array(-scores / math.log10(2) / (sizes + 1))], names=schema.names)

    id_type = pa.int64() if docs.schema["doc_id"].dataType == T.LongType() else None

    def run(batches):
        """A chunk's values, then its texts, some at a time."""
        chunk, keys, chances, counts, texts, held = None, [], [], {}, [], 0
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                if numbers[start] != chunk:
                    if texts:
                        yield add_up(texts, keys, chances, counts)
                    chunk, keys, chances, counts, texts, held = numbers[start], [], [], {}, [], 0
                part = batch.slice(start, end - start)
                is_text = part.column(1).to_numpy(zero_copy_only=False)
                values = part.slice(0, int((~is_text).sum()))  # values come first
                if values.num_rows:
                    for is_word, n, items, found in zip(*(values.column(i).to_pylist() for i in (2, 3, 4, 5))):
                        if is_word:
                            counts.update(zip(parted(items), unpacked(found, n).tolist()))
                        else:
                            keys.append(np.cumsum(unpacked(items, n)))
                            chances.append(np.frombuffer(found))
                if values.num_rows == part.num_rows:
                    continue
                if isinstance(keys, list):
                    keys, chances = np.concatenate(keys), np.concatenate(chances)
                    order = np.argsort(keys)
                    keys, chances = keys[order], chances[order]
                for k in range(values.num_rows, part.num_rows):
                    texts.append(tuple(part.column(c)[k].as_py() for c in (6, 7, 8)))
                    held += len(texts[-1][2] or "")
                    if held > TEXTS_AT_ONCE:
                        yield add_up(texts, keys, chances, counts)
                        texts, held = [], 0
        if texts:
            yield add_up(texts, keys, chances, counts)

    own = dealt.select("chunk", F.lit(True).alias("is_text"), F.lit(None).cast("boolean").alias("is_word"), F.lit(None).cast("long").alias("n"),
                       *[F.lit(None).cast("binary").alias(c) for c in ("items", "found")], "doc_id", "held_out", "text")
    given = returned(counted, chance, words).select(
        "chunk", F.lit(False).alias("is_text"), "is_word", "n", "items", "found", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"))
    return given.unionByName(own).repartition(parallelism(spark), "chunk").sortWithinPartitions("chunk", "is_text").mapInArrow(run, schema)
