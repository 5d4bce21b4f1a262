"""Blocks and shards: the exchange that the corpus-wide operators share.

A *block* is a run of rows of a map task, some megabytes of whole texts, kept as one compressed Arrow table in the
shared folder. As a run it is never large, whatever ids, sources or copies its rows have, and a block once written
is the same for every later stage. A *shard* is a range of the 64-bit key space. A block sends each shard at most
one record, which holds the block's distinct keys of that range as packed arrays: a key that a third of all rows
hold still costs a shard one entry per block. Both counts grow with the input, so the memory of a task does not.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rollbook.llm.words import slices
from rollbook.sources.shared import written

BLOCK_BYTES = 8 << 20
#: Rows of a block at most: a row's place in its block takes 20 bits.
BLOCK_ROWS = 1 << 20
#: Blocks that a map task may make: the rest of a block's number is the task's.
TASK_BLOCKS = 1 << 20
#: Partitions that blocks are dealt to at most; a partition's blocks are worked on one after another.
PARTITIONS = 1 << 13
_CODEC = pa.ipc.IpcWriteOptions(compression="zstd")

Measure = Callable[[pa.RecordBatch], list[pa.Array]]


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive the tasks, and the stages, that they serve."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pack_table(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_CODEC) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_table(blob: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob.as_buffer()) as found:
        return found.read_next_batch()


@dataclass
class Blocks:
    """table: a row (block, blob) per block, and a row (block, local, measured columns) per row of docs if any are measured."""

    table: DataFrame
    n: int
    n_bytes: int

    @property
    def blobs(self) -> DataFrame:
        return self.table.where("blob is not null").select("block", "blob")

    @property
    def rows(self) -> DataFrame:
        return self.table.where("local is not null").drop("blob", "size")

    def map(self, f: Callable[[int, pa.RecordBatch], pa.Table], ddl: str) -> DataFrame:
        """f(block, rows) of every block, without an exchange."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from f(batch["block"][i].as_py(), unpack_table(batch["blob"][i])).to_batches()
                    give_back()

        return self.blobs.mapInArrow(run, ddl)

    def meet(self, answers: DataFrame, f: Callable[[int, pa.RecordBatch, pa.Table], pa.Table], ddl: str, need: bool = False) -> DataFrame:
        """f(block, rows, answers) of every block with the answers (column block) sent to it; with ``need`` only of blocks that have any."""
        schema = StructType.fromDDL(ddl)
        nothing = to_arrow_schema(schema).empty_table()

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or (need and not right.num_rows):
                return nothing
            out = f(left["block"][0].as_py(), unpack_table(left["blob"][0]), right)
            give_back()
            return out

        n = min(self.n, PARTITIONS)
        return self.blobs.repartition(n, "block").groupBy("block").cogroup(answers.repartition(n, "block").groupBy("block")).applyInArrow(run, schema)


def in_blocks(docs: DataFrame, name: str, measure: Measure | None = None, measured: str = "", block_bytes: int | None = None) -> Blocks:
    """docs (one column is text) in written blocks. measure gives columns of a block's rows, whose DDL is measured."""
    block_bytes = block_bytes or BLOCK_BYTES
    names = ["block", "local", "size", "blob"] + ([x.split()[0] for x in measured.split(", ")] if measured else [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) * TASK_BLOCKS
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            found, n = measure(whole) if measure else [], whole.num_rows
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *found], names=names)
            kept = [pa.array([number], pa.int64()), pa.nulls(1, pa.int32()), pa.array([size], pa.int64()), pa.array([pack_table(whole)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.nulls(1, x.type) for x in found)], names=names)
            held.clear()
            number, size = number + 1, 0
            give_back()

        for batch in slices(batches, most=block_bytes // 2):
            more = batch["text"].nbytes
            if held and (size + more > block_bytes or sum(b.num_rows for b in held) + batch.num_rows > BLOCK_ROWS):
                yield from flush()
            held.append(batch)
            size += more + 16 * batch.num_rows
        if held:
            yield from flush()

    table = written(docs.mapInArrow(deal, "block bigint, local int, size bigint, blob binary" + (f", {measured}" if measured else "")), name, **{"parquet.block.size": str(32 << 20)})
    found = table.agg(F.count("size").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    return Blocks(table, max(1, found["n"]), found["bytes"])
