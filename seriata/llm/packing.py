"""Harmonic packing of token sequences.

A document's ids (byte-level BPE, then one end id) are cut into pieces whose lengths
sit at, or just below, the reciprocal capacities 2048/1, 2048/2, 2048/3 ...: class j
takes pieces that fit j times into a sequence, so each bin of class j holds exactly j
pieces. Every task fills its own bins class by class and needs no other task. The bins
that a task leaves unfinished (fewer than j pieces a class) are numbered through over
all tasks and filled the same way; what then remains is under j pieces a class, a
constant that no input size changes, and is packed first-fit decreasing.

Null or empty text: one piece that holds only the end id. Texts of any length, and runs of
any one character, are encoded whole; a document is as many pieces as it needs. Repeated
rows are packed as often as they occur; null doc_ids stay null; an empty table gives no
pieces. Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriata.llm.common import materialize, text_or_empty
from seriata.ship import ship

CAPACITY = 2048
END_ID = 1
WORKER_BITS, BIN_BITS = 24, 27
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, klass int, worker int, bin long, offset long, k long"


@lru_cache(maxsize=None)
def cut(remainder: int, capacity: int = CAPACITY) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of the last, incomplete stretch of a document; at most capacity entries are cached."""
    if remainder == 0:
        return ()
    j = capacity // remainder
    slot = capacity // j
    if slot - remainder <= slot // 64:
        return ((remainder, j),)
    return ((capacity // (j + 1), j + 1), *cut(remainder - capacity // (j + 1), capacity))


class Encoder:
    """text -> ids as little-endian 32-bit numbers; one a worker process.

    The rank file holds the tokenizer file's vocabulary and gives the same ids at a fifth of
    the time; it takes texts without a special token's string and without a run of LONG_BLANK
    white-space characters, on which its library's matcher would recurse. Those are encoded
    by the tokenizer itself."""

    LONG_BLANK = 1000

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(json_path)
        special = [re.escape(t.content) for t in exact.get_added_tokens_decoder().values()]
        self.unfit = re.compile("|".join([*special, rf"\s{{{self.LONG_BLANK}}}"])).search
        self.exact, self.load = None, lambda: Tokenizer.from_file(json_path)  # few workers need it again

    def encode(self, text: str) -> bytes:
        if self.unfit(text):
            self.exact = self.exact or self.load()
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    return Encoder(json_path, ranks_path, pattern)


def cut_and_fill(batches: Iterator[pa.RecordBatch], json_path: str, ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """One worker: encodes and cuts its documents and fills its own bins; pieces of unfinished bins come last, with bin null."""
    encode = encoder(json_path, ranks_path, pattern).encode
    worker = TaskContext.get().partitionId()
    if worker + 1 >= 1 << WORKER_BITS:
        raise OverflowError(f"more than 2^{WORKER_BITS} tasks")
    end = np.array([END_ID], "<u4").tobytes()
    open_bins: dict[int, list[list]] = {}
    next_bin: dict[int, int] = {}
    rows: list[list] = []
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (x.split(" ") for x in _PIECES.split(", "))])

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = memoryview(encode(text.as_py()) + end)
            n, at = len(ids) // 4, 0
            whole, rest = divmod(n, CAPACITY)
            for length, j in chain(repeat((CAPACITY, 1), whole), cut(rest)):
                filled = open_bins.setdefault(j, [])
                offset = filled[-1][8] + filled[-1][2] if filled else 0
                filled.append([doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, j, worker, next_bin.get(j, 0), offset, None])
                at += length
                if len(filled) == j:
                    rows += filled
                    open_bins[j] = []
                    next_bin[j] = next_bin.get(j, 0) + 1
                    if next_bin[j] >= 1 << BIN_BITS:
                        raise OverflowError(f"more than 2^{BIN_BITS} bins of a class in a task")
                if len(rows) >= 20_000:
                    yield flush()
    for filled in open_bins.values():
        rows += [[*p[:7], None, None, k] for k, p in enumerate(filled)]
    if rows:
        yield flush()


def sequence_id(klass: Column, worker: Column, bin_: Column) -> Column:
    """One number of a class (2,048 at most), a worker (from 1; 0: bins filled by several) and its bin."""
    return klass.cast("long") * F.lit(1 << (WORKER_BITS + BIN_BITS)) + worker.cast("long") * F.lit(1 << BIN_BITS) + bin_


def first_fit_decreasing(rest: pd.DataFrame) -> pd.DataFrame:
    """Bins for the last pieces: under j a class, so never more than some 10,000."""
    rest = rest.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
    room: list[int] = []
    bins, offsets = [], []
    for length in rest["length"]:
        b = next((i for i, r in enumerate(room) if r >= length), len(room))
        if b == len(room):
            room.append(CAPACITY)
        bins.append(b)
        offsets.append(CAPACITY - room[b])
        room[b] -= length
    return rest.assign(sequence_id=bins, offset=offsets)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"sequence_id": "int64", "offset": "int64"})


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, klass."""
    ship(docs.sparkSession)
    pieces = materialize(docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(lambda b: cut_and_fill(b, json_path, ranks_path, pattern), _PIECES), "packing-pieces")
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    own = pieces.where("bin is not null").select(*keep, sequence_id(F.col("klass"), F.col("worker") + 1, F.col("bin")).alias("sequence_id"), "offset", "klass")
    left = pieces.where("bin is null")
    counts = left.groupBy("klass", "worker").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("klass").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    totals = F.broadcast(left.groupBy("klass").agg(F.count("*").alias("total")))  # a row per class: CAPACITY rows at most
    numbered = left.drop("bin", "offset").join(before, ["klass", "worker"]).join(totals, "klass").withColumn("rank", F.col("before") + F.col("k"))
    joint = numbered.where(F.expr("rank < total - total % klass")).withColumn("bin", F.expr("rank div klass"))
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("klass", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joint = joint.select(*keep, sequence_id(F.col("klass"), F.lit(0), F.col("bin")).alias("sequence_id"), offset.alias("offset"), "klass")
    last = numbered.where(F.expr("rank >= total - total % klass")).select(*keep, "klass")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    last = last.groupBy(F.lit(0).alias("one")).applyInPandas(lambda p: first_fit_decreasing(p), schema).withColumn("klass", F.lit(0))
    return own.unionByName(joint).unionByName(last)
