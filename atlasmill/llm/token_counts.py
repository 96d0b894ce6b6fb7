"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that give one token are proved and are
counted by a dictionary look-up. Only the other pre-tokens are merged by the library, once per
distinct string of a batch.

Why pre-tokens are independent: a merge joins two neighbours into a vocabulary string. If no
vocabulary string holds a space mark after another character, no merge crosses from a character
into a following space; if none holds a line feed together with anything else, none crosses a
line feed. ``prove`` checks both on the vocabulary and refuses a model for which they fail.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Before the first pre-token stands a space, as the library puts one before a text.
PRETOKEN = r"\n[^ \n]*| +[^ \n]*"
#: Merged strings that a worker remembers at most; the memory is emptied when full.
REMEMBERED = 200_000


def _load(model: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _key_text(key: str) -> str:
    return key if key[0] == "\n" else key[1:]


def prove(model: bytes) -> dict[str, int]:
    """Pre-tokens with a proved number of tokens: a space and one token, or a line feed and one token."""
    pieces = _load(model)
    strings = [pieces.id_to_piece(i) for i in range(pieces.vocab_size())
               if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))]
    for s in strings:
        if MARK in s.lstrip(MARK) or ("\n" in s and s != "\n"):
            raise ValueError(f"merges of this model cross pre-tokens: {s!r}")
    # one space mark is put in front, and white space stays as it is
    if [pieces.id_to_piece(i) for i in pieces.encode("\n")] != [MARK, "<0x0A>"] or not pieces.encode(" "):
        raise ValueError("the model normalises white space")
    spaced = [s.replace(MARK, " ") for s in strings if s.startswith(MARK) and s.strip(MARK)]
    bare = ["\n" + s for s in strings if not s.startswith(MARK) and "\n" not in s]
    proved = {k: 1 for k, ids in zip(spaced, pieces.encode([_key_text(k) for k in spaced], num_threads=1)) if len(ids) == 1}
    # a space mark and the byte of the line feed come before the bare string
    proved[" "] = 1  # a space before a line feed or the end, as shown above
    proved |= {k: 2 for k, ids in zip(bare, pieces.encode(bare, num_threads=1)) if len(ids) == 3}
    return proved


def counter(model: bytes, proved: dict[str, int]):
    """A function from texts to their token counts."""
    import re
    from collections import Counter

    pieces, split, memory = _load(model), re.compile(PRETOKEN).findall, {}

    def count(texts: list[str | None]) -> list[int]:
        bags = [Counter(split(" " + t.replace(MARK, " "))) if t else {} for t in texts]
        rest = {k for bag in bags for k in bag if k not in proved and k not in memory}
        if len(memory) + len(rest) > REMEMBERED:
            memory.clear()
            rest = {k for bag in bags for k in bag if k not in proved}
        rest = list(rest)
        for k, ids in zip(rest, pieces.encode([_key_text(k) for k in rest], num_threads=1) if rest else []):
            memory[k] = len(ids) - (k[0] == "\n")  # without the mark the library puts before a line feed
        return [sum(n * (proved[k] if k in proved else memory[k]) for k, n in bag.items()) for bag in bags]

    return count


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every row, in the key's own type.

    Null and empty texts have no bytes and no tokens. Rows are counted where they are read: there
    is no shuffle, and repeated rows give repeated results. A text is split whole; the longest one
    bounds a worker's memory. ``proved`` has two entries a vocabulary string at most.
    """
    proved = docs.sparkSession.sparkContext.broadcast(prove(model))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        count = counter(model, proved.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = count(texts)
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(run, schema)
