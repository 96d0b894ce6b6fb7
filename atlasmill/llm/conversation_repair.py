"""Cheapest repair of conversations by block tables after the Four Russians.

The roles of a repaired conversation read ``(s?(ua)+)?``. Rows are kept, given another role, or
deleted, and empty turns are inserted; the cheapest edits are found by dynamic programming over
four states: nothing yet, after a system row, after a user row, after an assistant row. A cost
vector says for each state how much the rest of the conversation costs. Taken less its minimum
only a few dozen vectors exist, and a row is one of nine symbols, so the step over every block of
``BLOCK`` symbols from every vector is worked out once and then looked up.

Blocks are looked up from the last to the first, which gives the vector to the right of each.
A block is expanded when the edits are read off: the vectors inside it are worked out backward from
its right end, and in each state the ASCII-least edit among the cheapest is taken, so ties are
broken over the whole conversation, not block by block.

On Spark all rows are sorted by conversation and turn over range partitions and packed into chunks
of bounded rows and bytes, so one conversation may hold any share of the rows. Of a chunk only
its symbols are needed to say, for each vector on its right, the vector and cost on its left and
the state it leads to from each state. One pass over these summaries in the order of the chunks
joins them, whatever their number, and the chunks then stream through for their edits. That last
stream puts a conversation in one task, because its digest is of its turns in order; it holds one
chunk of text at a time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.llm.common import parallelism, stage

BLOCK = 3
CHUNK_ROWS, CHUNK_BYTES = 2048, 1 << 18
RETAG, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: 0 nothing yet, 1 system, 2 user, 3 assistant. The state after the next user or assistant turn.
NEXT = (2, 2, 3, 2)
#: The state after keeping a row whose role starts with s, u, a or something else; -1 where it doesn't fit.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
INITIALS = "sua"
SYMBOLS = 9  # 0: must be deleted; else 1 + 2 * role + truncated
SPACES = " \t\n\v\f\r"
END = (0, 2 * INSERT, INSERT, 0)
AT_END = ("", "II", "I", "")


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector to the left of a row, from the one to its right."""
    cost = [DELETE + c for c in after]
    if symbol:
        role, cut = divmod(symbol - 1, 2)
        for q in range(4):
            if KEPT[q][role] >= 0:
                cost[q] = min(cost[q], TRUNCATED * cut + after[KEPT[q][role]])
            cost[q] = min(cost[q], RETAG + TRUNCATED * cut + after[NEXT[q]])
    for _ in range(2):
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


def _edits(symbol: int, after: tuple[int, ...], q: int) -> tuple[str, int]:
    """ASCII-least cheapest edits up to and with a row, and the state after them."""
    now, edits = _before(symbol, after), ""
    role, cut = divmod(symbol - 1, 2)
    while True:
        if now[q] == DELETE + after[q]:
            return edits + "D", q
        if now[q] == INSERT + now[NEXT[q]]:
            edits, q = edits + "I", NEXT[q]
            continue
        if symbol and KEPT[q][role] >= 0 and now[q] == TRUNCATED * cut + after[KEPT[q][role]]:
            return edits + "K", KEPT[q][role]
        return edits + "R", NEXT[q]


class BlockTables:
    """Normalised cost vectors, and the step over one symbol and over every block from each of them."""

    def __init__(self):
        self.vectors, self.number, steps = [END], {END: 0}, []
        for vector in self.vectors:  # grows while it is walked
            row = []
            for symbol in range(SYMBOLS):
                cost = _before(symbol, vector)
                low = min(cost)
                shape = tuple(c - low for c in cost)
                if shape not in self.number:
                    self.number[shape] = len(self.vectors)
                    self.vectors.append(shape)
                row.append((self.number[shape], low, [_edits(symbol, vector, q)[1] for q in range(4)]))
            steps.append(row)
        one = tuple(np.array([[step[i] for step in row] for row in steps]) for i in range(3))
        self.one, self.all = one, one
        for _ in range(BLOCK - 1):
            self.all = self._longer(*self.all)

    def _longer(self, left, low, out):
        """One symbol more on the left of every block."""
        step, cost, moved = self.one
        states = np.arange(len(left))[:, None, None]
        blocks = np.arange(left.shape[1])[None, :, None]
        first = moved[left].transpose(0, 2, 1, 3)  # vector, symbol, block, state
        after = out[states[..., None], blocks[:, None], first]
        return (step[left].transpose(0, 2, 1).reshape(len(left), -1), (low[:, None] + cost[left].transpose(0, 2, 1)).reshape(len(left), -1),
                after.reshape(len(left), -1, 4))

    def cells(self, symbols: bytes) -> list[tuple[bool, int]]:
        """Whole blocks, then what is left over symbol by symbol: ``(is a block, number)``."""
        whole = len(symbols) - len(symbols) % BLOCK
        codes = [(True, functools.reduce(lambda a, s: a * SYMBOLS + s, symbols[i:i + BLOCK], 0)) for i in range(0, whole, BLOCK)]
        return codes + [(False, s) for s in symbols[whole:]]

    def summary(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector on the right: vector and cost on the left, and the state after from each state before."""
        n = len(self.vectors)
        left, cost, out = np.arange(n), np.zeros(n, np.int64), np.tile(np.arange(4), (n, 1))
        for block, code in reversed(self.cells(symbols)):
            step, low, moved = self.all if block else self.one
            out = np.take_along_axis(out, moved[left, code], 1)
            cost, left = cost + low[left, code], step[left, code]
        return left, cost, out

    @functools.lru_cache(maxsize=1 << 16)
    def expand(self, right: int, block: bool, code: int, q: int) -> tuple[tuple[str, ...], int]:
        """Edits of each row of a block that has vector ``right`` on its right and is entered in state ``q``."""
        symbols = [code] if not block else [code // SYMBOLS ** k % SYMBOLS for k in reversed(range(BLOCK))]
        vectors = [self.vectors[right]]
        for symbol in reversed(symbols[1:]):
            vectors.append(_before(symbol, vectors[-1]))
        edits = []
        for symbol, after in zip(symbols, reversed(vectors)):
            text, q = _edits(symbol, after, q)
            edits.append(text)
        return tuple(edits), q

    def trace(self, symbols: bytes, right: int, q: int) -> tuple[list[str], int]:
        """Edits of each row of a chunk, and the state after it."""
        cells, rights = self.cells(symbols), []
        for block, code in reversed(cells):
            rights.append(right)
            right = int((self.all if block else self.one)[0][right, code])
        edits: list[str] = []
        for (block, code), vector in zip(cells, reversed(rights)):
            part, q = self.expand(vector, block, code, q)
            edits.extend(part)
        return edits, q


@functools.lru_cache(maxsize=1)
def tables() -> BlockTables:
    return BlockTables()


STATS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "turns"]
_CHUNK = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("symbols", T.BinaryType()), T.StructField("roles", T.ArrayType(T.StringType())),
    T.StructField("texts", T.ArrayType(T.StringType())), *[T.StructField(name, T.LongType()) for name in STATS],
    T.StructField("first_role", T.StringType()), T.StructField("last_role", T.StringType()),
    T.StructField("first_turn", T.LongType()), T.StructField("last_turn", T.LongType())])


def _symbol(role: str, text: str, repeated: bool) -> tuple[int, str | None]:
    """Symbol and first fault of a row."""
    body = text.rstrip(SPACES)
    if not body:
        return 0, "blank"
    if repeated:
        return 0, "duplicate"
    cut = body[-1] not in ".!?"
    kind = INITIALS.find(role[:1]) if role else -1
    return 1 + 2 * (kind if kind >= 0 else 3) + cut, "truncated" if cut else None


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au") if a and b else False


def _pack(rows: DataFrame) -> DataFrame:
    """Sorted rows of each partition as chunks, in order."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *_CHUNK.fields])

    def close(conv, chunk, part):
        real = [r for r in part if not r[4]]
        made = [_symbol(role, text, repeated) for _, role, text, repeated, _ in real]
        faults = [fault for _, fault in made]
        turns = [r[0] for r in real if r[0] is not None]
        return {"conv_id": conv, "chunk": chunk, "symbols": bytes(s for s, _ in made), "roles": [r[1] for r in real], "texts": [r[2] for r in real],
                "n_rows": len(real), **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
                "illegal": sum(not _legal(a[1], b[1]) for a, b in zip(real, real[1:])), "turns": len(set(turns)),
                "first_role": real[0][1] if real else None, "last_role": real[-1][1] if real else None,
                "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None}

    def run(batches):
        arrow = None
        number, conv, part, size = TaskContext.get().partitionId() << 32, object(), [], 0
        ready: list[dict] = []
        for batch in batches:
            arrow = arrow or pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *_arrow_chunk()])
            for c, *row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if part and (c != conv or len(part) >= CHUNK_ROWS or size >= CHUNK_BYTES):
                    ready.append(close(conv, number, part))
                    number, part, size = number + 1, [], 0
                conv = c
                part.append(row)
                size += len(row[2])
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                ready = []
        if part:
            yield pa.RecordBatch.from_pylist([close(conv, number, part)], schema=arrow)

    return rows.select("conv_id", "turn", "role", "text", "repeated", "dropped").mapInArrow(run, schema)


def _arrow_chunk() -> list[pa.Field]:
    kinds = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string(), T.ArrayType(T.StringType()): pa.list_(pa.string())}
    return [pa.field(f.name, kinds[f.dataType]) for f in _CHUNK.fields]


class _Conversation:
    """The chunks of one conversation, first their summaries and then their texts."""

    def __init__(self, conv):
        self.conv, self.chunks, self.stats = conv, [], dict.fromkeys(STATS, 0)
        self.last_role = self.low = self.high = self.entries = None

    def add(self, chunk, symbols, row):
        self.chunks.append((chunk, *tables().summary(symbols)))
        for name in STATS:
            self.stats[name] += row[name]
        if row["n_rows"]:
            if self.last_role is not None:
                self.stats["illegal"] += not _legal(self.last_role, row["first_role"])
            self.last_role = row["last_role"]
        if row["turns"]:
            if self.high is not None and self.high == row["first_turn"]:
                self.stats["turns"] -= 1
            self.low = row["first_turn"] if self.low is None else self.low
            self.high = row["last_turn"]

    def settle(self):
        """The vector to the right of each chunk, from the last to the first, then the state before each."""
        rights, vector, cost = [], 0, 0
        for _, left, low, _ in reversed(self.chunks):
            rights.append(vector)
            vector, cost = int(left[vector]), cost + int(low[vector])
        self.cost = cost + tables().vectors[vector][0]
        self.entries, q = {}, 0
        for (chunk, _, _, out), right in zip(self.chunks, reversed(rights)):
            self.entries[chunk] = right, q
            q = int(out[right][q])
        self.chunks, self.last_state = [], q

    def repaired(self, chunk, symbols, roles, texts):
        """``(edit, role, text)`` of each edit of a chunk; deleted rows have no role."""
        right, q = self.entries.pop(chunk)
        for edits, role, text in zip(tables().trace(symbols, right, q)[0], roles, texts):
            for edit in edits:
                if edit == "D":
                    yield edit, None, None
                    continue
                q = KEPT[q][INITIALS.index(role[0])] if edit == "K" else NEXT[q]
                if edit == "K":
                    yield edit, role, text
                else:
                    yield edit, "user" if q == 2 else "assistant", text if edit == "R" else ""

    def closing(self):
        q = self.last_state
        for edit in AT_END[q]:
            q = NEXT[q]
            yield edit, "user" if q == 2 else "assistant", ""

    def gaps(self):
        return self.high - self.low + 1 - self.stats["turns"] if self.low is not None else 0


def _streamed(chunks: DataFrame, schema: T.StructType, finish) -> DataFrame:
    """Conversation by conversation, ``finish(conversation, edits)`` gives the rows of the result."""
    light = [*STATS, "first_role", "last_role", "first_turn", "last_turn"]
    summaries = chunks.select("conv_id", F.lit(0).alias("part"), "chunk", "symbols", *light, F.lit(None).cast("array<string>").alias("roles"),
                              F.lit(None).cast("array<string>").alias("texts"))
    bodies = chunks.select("conv_id", F.lit(1).alias("part"), "chunk", "symbols", *[F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in light],
                           "roles", "texts")
    both = (summaries.unionByName(bodies).repartition(parallelism(chunks.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", "part", "chunk"))

    def run(batches):
        kinds = None

        def rows():
            nonlocal kinds
            for batch in batches:
                kinds = kinds or batch.schema
                for k in range(batch.num_rows):  # one chunk at a time as Python objects
                    yield batch.slice(k, 1).to_pylist()[0]

        def edits(conversation, bodies):
            for row in bodies:
                yield from conversation.repaired(row["chunk"], row["symbols"], row["roles"], row["texts"])
            yield from conversation.closing()

        for _, own in itertools.groupby(rows(), key=lambda r: (r["conv_id"] is None, r["conv_id"])):
            conversation = None
            for part, some in itertools.groupby(own, key=lambda r: r["part"]):
                if part == 0:
                    for row in some:
                        conversation = conversation or _Conversation(row["conv_id"])
                        conversation.add(row["chunk"], row["symbols"], row)
                    conversation.settle()
                else:
                    yield from finish(conversation, edits(conversation, some), kinds.field("conv_id").type)

    return both.mapInArrow(run, schema)


def chunks_of(rows: DataFrame) -> DataFrame:
    """The stored chunks of a table of turns; see ``repair_report`` for what counts as a row."""
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"),
                        F.monotonically_increasing_id().alias("uid"))
    given = given.withColumn("same", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)))
    # "a turn is there" sorts after "none is", as nulls do below
    place = F.struct(F.col("turn").isNotNull(), "turn", "uid")
    first = (given.filter(~F.col("dropped")).groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min(place).alias("first")))
    marked = given.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    marked = marked.withColumn("repeated", F.coalesce(F.col("first.uid") != F.col("uid"), F.lit(False)))
    order = ["conv_id", "turn", "role", "same", "uid"]
    spread = marked.repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stage(_pack(spread), "chunks")


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost and initials of the cheapest edits, and the digest of what they leave.

    Rows of a conversation are taken by turn, nulls first; of one turn by role and then by a digest of
    role and text. Null roles and texts are one space. Rows whose ``dropped`` (if there is such
    a column) is true only name their conversation; one without other rows has zeros, an empty audit and
    the digest of nothing. A null ``conv_id`` is a conversation of its own. Equal rows are duplicates after the first.
    Other columns are ignored. An empty table gives an empty result.
    """
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in counts],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def finish(conversation, edits, kind):
        audit, digest, any_turn = [], hashlib.sha256(), False
        for edit, role, text in edits:
            audit.append(edit)
            if role is not None:
                digest.update(f"{chr(10) if any_turn else ''}{role}:{text}".encode())
                any_turn = True
        stats = conversation.stats
        values = [conversation.gaps(), stats["blank"], stats["duplicate"], stats["truncated"], stats["illegal"], conversation.cost]
        yield pa.RecordBatch.from_arrays([pa.array([conversation.conv], kind), *[pa.array([v], pa.int64()) for v in values],
                                          pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=schema.names)

    return _streamed(chunks_of(rows), schema, finish)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the turns that the cheapest edits leave, numbered from 0."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("place", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])

    def finish(conversation, edits, kind):
        place = 0
        left = (e for e in edits if e[1] is not None)
        while some := list(itertools.islice(left, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array([conversation.conv] * len(some), kind), pa.array(range(place, place + len(some)), pa.int64()),
                                              *[pa.array([s[i] for s in some], pa.string()) for i in range(3)]], names=schema.names)
            place += len(some)

    return _streamed(chunks_of(rows), schema, finish)


def damage(rows: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops a row (it stays, marked ``dropped``), 1 empties its text, 2 takes ``[.!?]`` out of it,
    3 repeats it, 4 makes its role user; all others stay.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    changed = rows.withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "dropped": F.col("kind") == 0})
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return changed.select("*", copies.alias("copy")).drop("kind", "copy")
