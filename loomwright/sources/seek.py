"""Lookups of single lines in large JSON-lines shards, which read the bytes round those lines only.

A sparse index holds the offset of every STRIDE-th row of each shard; it is made once, in one pass over places that read_jsonl
gives. A lookup sends each wanted row to the stride that it is in. A task takes the strides of one range of a shard, seeks each
and reads on to its last wanted row, so a lookup costs the strides that it touches, not the shards.

Files are opened by tasks through pyarrow: local and network folders, S3, GCS and HDFS, as far as pyarrow reaches them.

Defined results: rows are counted without blank lines, as read_jsonl counts them; a row that is wanted twice is given once; a row
or shard that isn't there is an error that names it, raised as the result is read; no wanted rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from one entry of the index to the next.
STRIDE = 256
#: Strides of a shard that one task takes.
TOGETHER = 1024
#: Bytes of the first read at a place, and of the largest one: each is twice the one before.
FIRST_READ, LAST_READ = 1 << 10, 1 << 20
FOUND = "source_file string, source_row long, source_offset long, value string, bytes_read long"


def sparse_index(places: DataFrame, stride: int = STRIDE) -> DataFrame:
    """source_file, stride and the offset of its first row, of places (source_file, source_row, source_offset)."""
    return places.where(F.col("source_row") % stride == 0).select("source_file", F.floor(F.col("source_row") / stride).cast("long").alias("stride"), F.col("source_offset").alias("offset"))


class Lines:
    """Lines of an open file from an offset on, with their offsets; counts what it reads."""

    def __init__(self, file: pa.NativeFile, offset: int):
        file.seek(offset)
        self.file, self.at, self.held, self.read, self.next = file, offset, b"", 0, FIRST_READ

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while True:
            end = self.held.find(b"\n")
            if end < 0:
                more = self.file.read(self.next)
                self.read, self.next = self.read + len(more), min(2 * self.next, LAST_READ)
                if not more:
                    if self.held:
                        yield self.at, self.held
                    return
                self.held += more
                continue
            yield self.at, self.held[:end]
            self.at, self.held = self.at + end + 1, self.held[end + 1 :]


def lookup_rows(path: str, selected: DataFrame, index: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The selected rows (source_file, source_row) of the shards under path, with place, line and the bytes that their stride cost (on its first row)."""
    want = selected.select("source_file", F.col("source_row").cast("long").alias("source_row")).distinct().withColumn("stride", F.floor(F.col("source_row") / stride).cast("long"))
    strides = want.groupBy("source_file", "stride").agg(F.array_sort(F.collect_list("source_row")).alias("rows"))  # `stride` rows at most
    known = strides.join(index, ["source_file", "stride"], "left")
    missing = F.raise_error(F.concat(F.lit("no such row: "), "source_file", F.lit(" "), F.get("rows", F.lit(0)).cast("string")))
    known = known.where(F.when(F.col("offset").isNotNull(), F.lit(True)).otherwise(missing))
    dealt = known.repartition("source_file", F.floor(F.col("stride") / TOGETHER)).sortWithinPartitions("source_file", "stride")
    store, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (None, path)
    uri = path

    def read(batches):
        at, file = store if store is not None else fs.LocalFileSystem(), None
        for b in batches:
            out = []
            for name, number, rows, offset in zip(*(b.column(c).to_pylist() for c in ("source_file", "stride", "rows", "offset")), strict=True):
                if file is None or file[0] != name:
                    if file is not None:
                        file[1].close()
                    file = name, at.open_input_file(f"{folder.rstrip('/')}/{name}")
                lines, left, row = Lines(file[1], offset), set(rows), number * stride - 1
                mine = []
                for place, line in lines:
                    if not line.strip():
                        continue
                    row += 1
                    if row in left:
                        left.remove(row)
                        mine.append((name, row, place, line.decode(), 0))
                    if not left or row >= (number + 1) * stride:
                        break
                if left:
                    raise ValueError(f"no such row: {name} {min(left)} under {uri}")
                mine[0] = (*mine[0][:4], lines.read)
                out += mine
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["source_file", "source_row", "source_offset", "value", "bytes_read"])
        if file is not None:
            file[1].close()

    return dealt.mapInArrow(read, FOUND)
