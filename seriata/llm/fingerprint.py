"""Bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 48-bit hashes of a text's five-word shingles (fewer
words: the whole text as one shingle). Sketches of parts merge into the sketch of the
whole; two sketches give estimates of resemblance and containment, one the number of
distinct shingles (exact below k).

Null text counts as empty; an empty text has the empty sketch, which is like itself (1)
and unlike any other (0). A text of any length is read whole. Repeated doc_ids (ties) are
ordered by text; null doc_ids come first. The rows of one doc_id, or of all null ones, are
one task's work: doc_id is taken to be a key. An empty table gives no rows. Columns besides
doc_id and text are not read by the comparison; `fingerprints` keeps all but one of its
result's name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriata.llm.common import shingles, text_or_empty, words
from seriata.ship import ship

K = 256
BITS = 48
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, in_edited double"


def sketch(text: str, k: int = K) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending."""
    return smallest(shingles(words(text)) >> np.uint64(64 - BITS), k)


def smallest(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct values first, so repeats never take the place of others; only a short prefix is sorted where it is enough."""
    if len(h) > 8 * k:
        part = np.unique(np.partition(h, 4 * k)[: 4 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's k smallest hashes that both sketches hold."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(both, a, True), b, True)) / len(both)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below k, else (k-1) over the k-th hash as a fraction."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has, from resemblance and the sizes."""
    if len(a) == 0:
        return 1.0
    j, na, nb = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, j / (1 + j) * (na + nb) / na)


def pack_sketch(a: np.ndarray) -> str:
    """Six bytes a hash, big-endian, in base64: byte order is number order."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack_sketch(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], 1).copy().view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Sketch of every row's text, without shuffle: the columns given, and fingerprint."""

    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: pack_sketch(sketch(t or "", k)))

    return docs.withColumn("fingerprint", of(F.col("text")))


def edit(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, guest, doc_id, text); each own row meets the row after it; one row is held at a time."""
    names = [x.split(" ")[0] for x in OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    out: list[tuple] = []
    held = None  # (bucket, guest, doc_id, text, sketch)

    def pair(a, b) -> None:
        edited = edit(a[3], b[3])
        s, e = a[4], sketch(edited, k)
        out.append((a[2], len(a[3]), hashlib.sha256(edited.encode()).hexdigest(), pack_sketch(s), pack_sketch(e), resemblance(s, e, k), resemblance(s, b[4], k), distinct(s, k), containment(s, e, k)))

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        out.clear()
        return got

    for batch in batches:
        buckets, guests, ids = (batch.column(i).to_pylist() for i in range(3))
        for i, text in enumerate(batch.column(3)):
            if held is not None and held[0] == buckets[i] and held[1] and guests[i]:
                continue  # of the guests only the first is anyone's next
            row = (buckets[i], guests[i], ids[i], t := text.as_py(), sketch(t, k))
            if held is not None and held[0] == row[0] and not held[1]:
                pair(held, row)
            held = row
            if len(out) >= 1000:
                yield flush()
    if out:
        yield flush()


MAX_RANGES = 65_536


def compare_with_edits(docs: DataFrame, rows_per_range: int = 2_000, k: int = K) -> DataFrame:
    """Every text against its edited text and the next document; texts are shuffled once, by ranges of doc_id.

    The ranges start at actual doc_ids, so the first row of each range is known without
    looking; it is also sent to the range before as a guest, as its last row's next, and
    the overall first row to the last range. The driver holds one id per range, and
    there are MAX_RANGES at most. Null doc_ids lie in the first range, before all others.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n, low, known = d.agg(F.count("*"), F.min("doc_id"), F.count("doc_id")).first()
    if not n:
        return docs.sparkSession.createDataFrame([], OUT)
    ranges = min(MAX_RANGES, max(1, -(-n // rows_per_range)))
    inner = [i / ranges for i in range(1, ranges)]
    found = d.agg(F.percentile_approx("doc_id", [*inner], 10 * ranges)).first()[0] if inner and known else []
    starts = np.array(sorted({x for x in found or [] if x > low}), np.int64)

    @F.pandas_udf("array<int>")
    def homes(ids):
        """Own range, then as negative numbers the ranges that the row visits as a guest."""
        null = ids.isna().to_numpy()
        at = np.searchsorted(starts, ids.fillna(0).to_numpy(np.int64), "right")
        at[null] = 0
        opens = ~null & (at > 0) & (starts[at - 1] == ids.fillna(0).to_numpy(np.int64)) if len(starts) else np.zeros(len(ids), bool)
        first = null if known < n else ids.to_numpy() == low
        return pd.Series([[b, *[-b] * bool(o), *[-len(starts) - 1] * bool(f)] for b, o, f in zip(at.tolist(), opens, first)])

    placed = d.select("doc_id", "text", F.explode(homes("doc_id")).alias("h"))
    placed = placed.select(F.when(F.col("h") < 0, -F.col("h") - 1).otherwise(F.col("h")).alias("bucket"), (F.col("h") < 0).alias("guest"), "doc_id", "text")
    dealt = placed.repartitionById(len(starts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(lambda b: _rows(b, k), OUT)
