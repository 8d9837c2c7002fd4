"""Blocks and shards: the exchange that the duplicate finders share.

Documents are dealt by a hash of id and text into *blocks* of 8 MB or more. A block
sends each *shard* of the key space one packed list of its own distinct keys;
a shard merges the lists of all blocks and answers each block with one packed
list of the same length. So a key that half of the documents hold costs each
block one entry, no shard more than one entry a block, and no pairs arise.
The text itself is shuffled once (Spark reuses the exchange of the blocks).

A block's own list is made again from its texts whenever an answer comes
back; it is sorted, so answers need carry no keys. All of this is a function
of the rows alone, and a lost executor's part is simply computed again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least bytes of text in a block. 1 MB chunks of it are in numpy form at a time.
BLOCK_BYTES = 8 << 20
#: Least bytes of a block's text for each shard. There are as many shards as blocks, so blocks grow with the square root of
#: the corpus from 64 GiB on (320 MB at 100 TB), and messages by the same root for each block, not with the corpus.
MESSAGE_BYTES = 1 << 10
LEAST_BLOCKS = 32
#: Stands for a null id; the largest, so that a row without an id is never anyone's original.
NO_ID = np.iinfo(np.int64).max


def blocks_for(total: int, block_bytes: int = BLOCK_BYTES, message_bytes: int = MESSAGE_BYTES) -> int:
    """Number of blocks for so many bytes of text."""
    size = max(block_bytes, math.isqrt(message_bytes * total))
    return max(LEAST_BLOCKS, -(-total // size))


def count_blocks(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Number of blocks, and bytes of all texts (one scan of one column)."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return blocks_for(total), total


def into_blocks(docs: DataFrame, blocks: int, doc_id: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """doc_id, text, block. Other columns, whatever their names, take no part; kept: each but the text comes along as own0, own1, ..."""
    own = [F.col(c).alias(f"own{k}") for k, c in enumerate(docs.columns) if kept and c != text]
    one = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *own)
    return one.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))


def row_order(table: pa.Table) -> tuple[list[int], np.ndarray, list[bytes]]:
    """Ids (NO_ID for null) and UTF-8 texts (empty for null), in an order that depends on the rows only, and that order."""
    ids = table.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)
    texts = table.column("text").fill_null("").cast(pa.large_binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return order, ids[order], [texts[i] for i in order]


def ids_and_texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    return row_order(table)[1:]


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; the sender takes differences first if they are sorted."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T
    return size.to_bytes(1, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    size = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    step = np.diff(values, prepend=values.dtype.type(0))
    most = int(step.max()) if len(step) else 0
    return pack(step.astype(np.uint32 if most < 1 << 32 else np.uint64))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob).astype(np.uint64), dtype=np.uint64)


def cuts(shard_of: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of each shard in a sorted list of shard numbers."""
    return np.searchsorted(shard_of, np.arange(shards + 1))


SENT = "shard int, block int, part string, body binary"
ANSWER = "block int, shard int, part string, body binary"


def rows(schema: str, **columns) -> pa.Table:
    """A table by column lists, with the Arrow types of a Spark schema string."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in fields})


def sent(block: int, shards: int, shard_of: np.ndarray, **parts: Callable[[slice], bytes]) -> pa.Table:
    """One row for each shard and part, from a list sorted by shard; a part is made from the slice of the list that a shard gets."""
    at = cuts(shard_of, shards)
    out = [(s, p, f(slice(at[s], at[s + 1]))) for s in range(shards) if at[s] < at[s + 1] for p, f in parts.items()]
    return rows(SENT, shard=[x[0] for x in out], block=[block] * len(out), part=[x[1] for x in out], body=[x[2] for x in out])


def by_block(table: pa.Table) -> dict[int, dict[str, bytes]]:
    """What each block sent to this shard, by block and part, in the order of blocks."""
    out: dict[int, dict[str, bytes]] = {}
    for b, p, x in sorted(zip(table.column("block").to_pylist(), table.column("part").to_pylist(), table.column("body").to_pylist(), strict=True), key=lambda r: r[:2]):
        out.setdefault(b, {})[p] = x
    return out


def bits_back(shard: int, part: str, flags: dict[int, np.ndarray]) -> pa.Table:
    """One bit for each entry that a block sent."""
    return rows(ANSWER, block=list(flags), shard=[shard] * len(flags), part=[part] * len(flags), body=[np.packbits(x).tobytes() for x in flags.values()])


def read_bits(answers: pa.Table, part: str, shard_of: np.ndarray, shards: int) -> np.ndarray:
    """The answers to a block's whole list."""
    at, out = cuts(shard_of, shards), np.zeros(len(shard_of), bool)
    for s, p, x in zip(answers.column("shard").to_pylist(), answers.column("part").to_pylist(), answers.column("body").to_pylist(), strict=True):
        if p == part:
            n = at[s + 1] - at[s]
            out[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
    return out


def in_several(lists: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Of each block's distinct keys, which another block holds too."""
    every = np.concatenate(list(lists.values())) if lists else np.empty(0, np.uint64)
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    return {b: contains(twice, k) for b, k in lists.items()}


def contains(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)
    return sorted_values[at] == asked


def ask(d: DataFrame, schema: str, send: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """Run send(block, its rows) on each block of d."""

    def run(key, table):
        return send(key[0].as_py(), table)

    return d.groupBy("block").applyInArrow(run, schema)


def answer(messages: DataFrame, merge: Callable[[int, pa.Table], pa.Table], schema: str = ANSWER) -> DataFrame:
    """Run merge(shard, what all blocks sent it) on each shard."""

    def run(key, table):
        return merge(key[0].as_py(), table)

    return messages.groupBy("shard").applyInArrow(run, schema)


def ask_again(d: DataFrame, answers: DataFrame, schema: str, send: Callable[[int, pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Run send(block, its rows, the answers to it) on each block of d."""

    def run(key, table, back):
        if not table.num_rows:
            return rows_like(schema)
        return send(key[0].as_py(), table, back)

    return d.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def rows_like(schema: str) -> pa.Table:
    return rows(schema, **{x.split()[0]: [] for x in schema.split(", ")})
