"""Byte-level BPE by rank, with a segment tree over byte positions.

Each leaf holds the rank of the pair that starts at its position with the live neighbour
to the right; inner nodes hold the minimum, and the leftmost position of the minimum is
found by descending. A merge changes three leaves (the merged pair's, its left
neighbour's and the swallowed one's), each a logarithmic update, so a run of n bytes
without any break takes O(n log n).

Short words are merged many at a time: their trees are rows of one array, and each step
merges the best pair of every word that still has one. Long runs have a tree each.

Null or empty text: no ids. Any text, of any length, decodes to itself. Of pairs of equal rank
(ties) the leftmost goes first. Repeated rows are encoded each; null doc_ids stay null; an
empty table gives no rows. The digest query reads doc_id and text only; `encode_column` and
`decode_column` keep all columns but one of their result's name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriata.llm.common import text_or_empty
from seriata.ship import ship

NONE = 1 << 60
EMPTY = np.int32(2**31 - 1)
CACHE = 500_000
LONGEST_TOGETHER = 64
CHUNK = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: always the pair of least rank, the leftmost first."""
    n = len(word)
    if n == 1 or word in ranks:
        return [ranks[word]]
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    end = list(range(1, n + 1))  # of the part that starts here
    start_before = list(range(-1, n - 1))  # of the part to the left
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(word[i : i + 2], NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def update(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            value = a if a <= b else b
            if tree[i] == value:
                return
            tree[i] = value
            i >>= 1

    while (least := tree[1]) < NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != least:
                i += 1
        i -= size
        gone = end[i]
        stop = end[i] = end[gone]
        update(gone, NONE)
        if stop < n:
            start_before[stop] = i
            update(i, get(word[i : end[stop]], NONE))
        else:
            update(i, NONE)
        left = start_before[i]
        if left >= 0:
            update(left, get(word[left:stop], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Trees:
    """Segment trees of many words as rows of one array. An id is the rank of its bytes, so a merge's rank is the new part's id."""

    def __init__(self, ranks: dict[bytes, int]):
        splits = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(sorted(splits), np.int64).reshape(-1, 2)
        self.keys, self.ranks = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int32)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pair = self.rank(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; EMPTY where they do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], EMPTY)

    def merge(self, words: list[bytes], size: int) -> list[list[int]]:
        """Ids of words of up to size bytes (a power of two, 2 at least)."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        at = np.arange(size)
        live = at < lengths[:, None]
        ids = self.byte_id[raw]
        after = np.minimum(at + 1, lengths[:, None])  # of the part that starts here; the word's length: none
        before = np.broadcast_to(at - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), EMPTY, np.int32)
        tree[:, size:-1] = np.where(live[:, 1:], self.byte_pair[raw[:, :-1], raw[:, 1:]], EMPTY)
        level = size
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        flat = tree.reshape(-1)
        row = np.flatnonzero(tree[:, 1] != EMPTY)
        while len(row):
            least = tree[row, 1]
            node = np.ones(len(row), np.int64)
            while node[0] < size:
                node *= 2
                node += tree[row, node] != least
            i = node - size
            gone = after[row, i]
            end = after[row, gone]
            ids[row, i], after[row, i], live[row, gone] = least, end, False
            inner = end < lengths[row]
            before[row[inner], end[inner]] = i[inner]
            tree[row, size + gone] = EMPTY
            tree[row, node] = np.where(inner, self.rank(least, ids[row, np.minimum(end, size - 1)]), EMPTY)
            left = before[row, i]
            has = left >= 0
            left = np.where(has, left, i)
            tree[row[has], size + left[has]] = self.rank(ids[row[has], left[has]], least[has])
            # the three changed leaves' ancestors, level by level, in the array's flat form
            base = np.tile(row * (2 * size), 3)
            path = np.concatenate([node, size + gone, size + left])
            for _ in range(size.bit_length() - 1):
                path >>= 1
                below = base + 2 * path
                flat[base + path] = np.minimum(flat[below], flat[below + 1])
            row = row[tree[row, 1] != EMPTY]
        ends = np.cumsum(live.sum(1)).tolist()
        parts = ids[live].tolist()
        return [parts[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """encode: texts -> ids; decode: ids -> bytes. Words are remembered up to a fixed number."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.trees = Trees(ranks)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.names = [str(i) for i in range(len(self.tokens))]
        self.seen: dict[str, list[int]] = {}

    def learn(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of words that are not remembered yet; very long ones are not remembered."""
        long: dict[str, list[int]] = {}
        sized: list[tuple[list[str], list[bytes]]] = [([], []) for _ in range(LONGEST_TOGETHER.bit_length())]  # by the logarithm of the size
        names = list(words)
        raws = [w.encode("utf-8", "surrogatepass") for w in names]
        seen = self.seen
        for w, raw, r in zip(names, raws, map(self.ranks.get, raws)):
            if r is not None:
                seen[w] = [r]
            elif len(raw) > LONGEST_TOGETHER:
                long[w] = merge_word(raw, self.ranks)
            else:
                own, bits = sized[(len(raw) - 1).bit_length()]
                own.append(w)
                bits.append(raw)
        for k, (own, bits) in enumerate(sized):
            for at in range(0, len(own), 10_000):
                seen.update(zip(own[at : at + 10_000], self.trees.merge(bits[at : at + 10_000], max(2, 1 << k))))
        return long

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = [self.find(t) for t in texts]
        if len(self.seen) > CACHE:
            self.seen.clear()
        long = self.learn(set(chain.from_iterable(found)).difference(self.seen))
        if not long:
            get = self.seen.__getitem__
            return [list(chain.from_iterable(map(get, words))) for words in found]
        get = lambda w: long[w] if w in long else self.seen[w]
        return [list(chain.from_iterable(map(get, words))) for words in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker process, whatever number of tasks it runs."""
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(ranks_path), pattern)
    return _codecs[key]


def chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Lists of texts of about CHUNK characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_rows(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(ranks_path, pattern)
    for batch in batches:
        counts, hashes, back = [], [], []
        for part in chunks(t.as_py() for t in batch.column(1)):
            for ids in c.encode(part):
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; narrow."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(lambda b: encode_rows(b, ranks_path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with the column ids."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts):
        c = codec(ranks_path, pattern)
        return pd.Series(list(chain.from_iterable(c.encode(part) for part in chunks(t or "" for t in texts))), dtype=object)

    return docs.withColumn("ids", ids(F.col("text")))


def decode_column(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs (ids array<int>) with the column decoded (binary)."""
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def back(rows):
        c = codec(ranks_path, pattern)
        return rows.map(lambda ids: c.decode(ids if ids is not None else []))

    return docs.withColumn("decoded", back(F.col("ids")))
