"""Near-duplicate components: universal-hash minima with banding, signature check, full-set check, star components.

1. Every text's distinct five-word shingles give a set digest, MinHash bands and a
   signature of one byte a hash. Equal sets become one class; only classes go on.
2. Classes that share a band are candidates. Buckets of up to SMALL classes give all
   their pairs (a constant number a class); larger ones only stars around one pivot, so
   the pairs stay linear in the classes. Signatures far below the threshold drop out,
   the rest is confirmed by the exact size of the sets' intersection.
3. A larger bucket whose classes do not all end up in one component may hide links
   between its other members. Those classes go through an exact prefix index: shingles
   ordered rarest first, two sets above the threshold share a shingle within the first
   n - ceil(t n) + 1, at positions that the sizes bound. Lists of more than SMALL classes
   again give stars, around the most central member and members outside the list's largest
   component, round by round, until no list holds two components that could still be
   linked. So no candidate is capped or dropped.
4. Components come from alternating large-star and small-star.

Hot buckets, lists, classes and components are joined by `join_hot`; a pivot's set is sent
once per PER_SALT members, to as many tasks. Texts are shingled again for candidates only:
a broadcast of the hashes of their doc_ids (2^SLOT_BITS slots at most) passes them and few
others to a semi-join on doc_id and a hash of the text. From some million candidates on it
passes most rows, and the semi-join shuffles most texts once; nothing is lost.

Null and empty texts and texts without words have no shingles and link with nothing.
Fewer than five words are one shingle. A text's length is not bounded. Repeated rows are
copies of each other. A null doc_id takes part; a component's id is the smallest doc_id that
is not null. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriata.llm.common import join_hot, materialize, shingle_set, text_or_empty, tidy
from seriata.llm.components import components
from seriata.ship import ship

ROWS = 8
MISS = 1e-6
MARGIN = 0.12
SMALL = 8
PIVOTS = 48
SLOTS = 1 << 18
PER_SALT = 256
SLOT_BITS = 20
_SET_ROWS = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, signature binary"


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a pair at the threshold shares none with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


class MinHash:
    """Multiply-add hashes mod 2^32 of 32-bit shingle hashes; a band is the hash of `rows` minima."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 1):
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 31, k, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        self.weights = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        step = max(1, 65_536 // len(x))
        return np.concatenate([(self.a[i : i + step, None] * x + self.b[i : i + step, None]).min(1) for i in range(0, len(self.a), step)])

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        m = self.minima(shingles)
        h = (m.reshape(self.bands, self.rows).astype(np.uint64) * self.weights).sum(1) + self.salt
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64), (m * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _sketch(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(bands)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows: list[tuple] = []
        for doc_id, text, text_hash in zip(ids, batch.column(1), batch.column(2).to_pylist()):
            s = shingle_set(text.as_py())
            rows.append((doc_id, text_hash, len(s), digest_of(s), *minhash.of(s)) if len(s) else (doc_id, text_hash, 0, None, None, None))
        if rows:
            yield _batch([list(c) for c in zip(*rows)], schema)
        del rows, batch
        pa.default_memory_pool().release_unused()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, tokens) of texts that have shingles."""
    schema = pa.schema([("digest", pa.binary()), ("tokens", pa.list_(pa.int64()))])
    for batch in batches:
        held, size = ([], []), 0
        for text in batch.column(0):
            s = shingle_set(text.as_py())
            if len(s):
                held[0].append(digest_of(s))
                held[1].append(s.view(np.int64))
                size += len(s)
            if size > 1_000_000:
                yield _batch([*held], schema)
                held, size = ([], []), 0
        if held[0]:
            yield _batch([*held], schema)
        del held, batch
        pa.default_memory_pool().release_unused()


def maybe_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose _id hashes to a slot of some _id of ids: all that ids holds, and few others while they are few. The slots are 2^SLOT_BITS numbers at most, some 40 MB, and are broadcast."""
    slot = F.pmod(F.xxhash64("_id"), F.lit(1 << SLOT_BITS)).alias("_slot")
    slots = F.broadcast(ids.select(slot).distinct())
    return rows.withColumn("_slot", slot).join(slots, "_slot", "left_semi").drop("_slot")


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle counts by slot of this task, as 64 slices of a fixed array."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        tokens = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        counts += np.bincount(tokens & (SLOTS - 1), minlength=SLOTS)
    for k, part in enumerate(np.split(counts, 64)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["slice", "counts"])


def slot_counts(sets: DataFrame) -> np.ndarray:
    def total(key, parts):
        return pd.DataFrame({"slice": [int(key[0])], "counts": [sum(np.frombuffer(x, "<i8") for x in parts["counts"]).tobytes()]})

    rows = sets.select("tokens").mapInArrow(_slot_counts, "slice int, counts binary").groupBy("slice").applyInPandas(total, "slice int, counts binary").collect()
    out = np.zeros(SLOTS, np.int64)
    for r in rows:
        out[r["slice"] * (SLOTS // 64) : (r["slice"] + 1) * (SLOTS // 64)] = np.frombuffer(r["counts"], "<i8")
    return out


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, t: Fraction) -> Iterator[pa.RecordBatch]:
    """(token, digest, n, i) of each set's prefix; shingles that no other set can hold (count 1) are left out, their position is not."""
    schema = pa.schema([("token", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("i", pa.int32())])
    for batch in batches:
        for digest, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = np.array(tokens.values)
            n = len(s)
            c = counts[s & (SLOTS - 1)]
            order = np.lexsort((s, c))[: n + t.numerator * -n // t.denominator + 1]  # n - ceil(t n) + 1
            order = [(int(s[k]), i) for i, k in enumerate(order) if c[k] > 1]
            if order:
                yield _batch([[x for x, _ in order], [digest] * len(order), [n] * len(order), [i for _, i in order]], schema)


def _enough(inter: Column, na: Column, nb: Column, t: Fraction) -> Column:
    return inter * t.denominator >= (na + nb - inter) * t.numerator


def _beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (u, v) with the values (digest, x) of both as a and b. A hub u of many pairs meets them in several tasks, each with its own copy of the hub's value."""
    hubs = pairs.groupBy("u").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / PER_SALT).cast("int"))
    salted = join_hot(pairs, hubs, ["u"], "n", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int")).drop("salts")
    a = values.select(F.col("digest").alias("u"), F.col("x").alias("a")).join(hubs.drop("n"), "u").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return salted.join(a, ["u", "salt"]).drop("salt").join(values.select(F.col("digest").alias("v"), F.col("x").alias("b")), "v")


def confirm(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (u, v) whose full sets meet the threshold; pairs is read twice, so it should be written."""
    both = _beside(pairs, sets.select("digest", F.col("tokens").alias("x")))
    inter = F.size(F.array_intersect("a", "b"))
    return both.where(_enough(inter, F.size("a"), F.size("b"), t)).select("u", "v")


def check_signatures(pairs: DataFrame, classes: DataFrame, least: float, k: int) -> DataFrame:
    """Drops pairs whose signatures agree in fewer than `least` of the k bytes: far below what the threshold allows."""
    both = _beside(pairs, classes.select("digest", F.col("signature").alias("x")))

    @F.pandas_udf("int")
    def same(a, b):
        if not len(a):
            return pd.Series([], dtype="int32")
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(a), k) for s in (a, b))
        return pd.Series((x == y).sum(1).astype(np.int32))

    return both.where(same("a", "b") >= int(least * k)).select("u", "v")


def _pairs(lists: DataFrame, pivots: DataFrame, extra: list[str], possible: Column, total: int) -> DataFrame:
    """Distinct pairs (u, v) of lists (key, digest, c: rows of the key, *extra), total rows: all of a small key's, stars around the pivots (key, digest) of a larger one's, with the pivot as u."""
    side = lambda d, p, *more: d.select("key", *more, *[F.col(x).alias(p + x) for x in ["digest", *extra]])
    small = lists.where(F.col("c") <= SMALL)
    near = side(small, "a_").join(side(small, "b_"), "key").where("a_digest < b_digest").withColumn("star", F.lit(0))
    star = join_hot(side(lists.where(F.col("c") > SMALL), "b_"), side(pivots, "a_", "c"), ["key"], "c", total).where("a_digest != b_digest").withColumn("star", F.lit(1))
    both = near.unionByName(star).where(possible).select(F.least("a_digest", "b_digest").alias("l"), F.greatest("a_digest", "b_digest").alias("g"), F.col("a_digest").alias("hub"), "star")
    one = both.groupBy("l", "g").agg(F.max(F.struct("star", "hub"))["hub"].alias("u"))
    return one.select("u", F.when(F.col("u") == F.col("l"), F.col("g")).otherwise(F.col("l")).alias("v"))


def _pivots(lists: DataFrame, extra: list[str], order: Column, sub: Column) -> DataFrame:
    """For each key of more than SMALL rows the least row by order of every sub-bucket, and c: a fixed number a key."""
    rows = lists.where(F.col("c") > SMALL).groupBy("key", "c", sub.alias("_s")).agg(F.min_by(F.struct("digest", *extra), order).alias("p"))
    return rows.select("key", "c", *[F.col(f"p.{x}").alias(x) for x in ["digest", *extra]])


def _residual(sets: DataFrame, open_: DataFrame, roots: DataFrame, t: Fraction) -> DataFrame:
    """Components (node, root) after all links among the open classes are found, by prefix lists in rounds."""
    sets = materialize(sets.join(open_, "digest", "left_semi"), "near-open")
    counts = slot_counts(sets)
    lists = sets.select("digest", "tokens").mapInArrow(lambda b: _prefixes(b, counts, t), "token long, digest binary, n int, i int").withColumnRenamed("token", "key")
    lists = materialize(lists, "near-prefixes")
    num, den = t.numerator, t.denominator
    bound = lambda a, b: F.ceil((a + b) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))
    slack = F.col("n") - F.col("i")
    indexes = bound(F.col("n"), F.col("n")) <= slack
    col = F.col
    possible = (col("a_root") != col("b_root")) & (bound(col("a_n"), col("b_n")) <= F.least(col("a_n") - col("a_i"), col("b_n") - col("b_i"))) & (F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num)
    before = None
    while True:
        total = lists.count()
        live = lists.join(roots.select(col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        # a pair needs a member that could meet its like here, and the other's size within reach of it
        least = live.groupBy("key").agg(F.min(F.when(indexes, col("n"))).alias("n_min"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("_c")).where("n_min is not null and r0 != r1").drop("r0", "r1")
        live = join_hot(live, least, ["key"], "_c", total).where(indexes | (F.floor(slack * F.lit(num + den) / F.lit(num) + F.lit(1e-9)) - col("n") >= col("n_min"))).drop("n_min")
        live = materialize(live, "near-reach", instead_of=before)
        sizes = live.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("c > 1 and r0 != r1").drop("r0", "r1").withColumn("_c", col("c"))
        live = materialize(join_hot(live, sizes, ["key"], "_c", total), "near-live", instead_of=live)
        if not live.limit(1).count():
            return roots
        # a pair across components has a member outside its list's largest one: only those, and the most central member, need be pivots
        largest = live.groupBy("key", "c", "root").agg(F.count("*").alias("m")).groupBy("key", "c").agg(F.max_by("root", F.struct("m", "root")).alias("largest"))
        order, extra = F.struct("i", "n", "digest"), ["n", "i", "root"]
        outside = join_hot(live.where(col("c") > SMALL), largest.withColumn("_c", col("c")).drop("c"), ["key"], "_c", total).where("root != largest").drop("largest")
        pivots = _pivots(live, extra, order, F.lit(0)).unionByName(_pivots(outside, extra, order, F.pmod(F.xxhash64("digest"), F.lit(PIVOTS)))).distinct()
        pivots = materialize(pivots, "near-pivots")
        pairs = materialize(_pairs(live, pivots, extra, possible, total), "near-pairs")
        links = materialize(confirm(pairs, sets, t), "near-links", instead_of=pairs)
        done = pivots.select("key", "digest")
        lists = materialize(live.where(col("c") > SMALL).drop("c", "root").join(done, ["key", "digest"], "left_anti"), "near-prefixes", instead_of=lists)
        before = live
        if links.limit(1).count():
            roots = components(roots.select(col("node").alias("u"), col("root").alias("v")).unionByName(links))


def _text_hash() -> Column:
    return F.xxhash64(text_or_empty())


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_size for every row of docs (doc_id, text)."""
    return _labelled(docs, threshold).drop("text_hash")


def _labelled(docs: DataFrame, threshold: float) -> DataFrame:
    """The rows of near_duplicates with the text's hash, which tells rows of one doc_id apart."""
    ship(docs.sparkSession)
    t = Fraction(str(threshold))
    bands = bands_for(threshold)
    k = bands * ROWS
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    hashed = source.withColumn("text_hash", _text_hash())
    rows = materialize(hashed.mapInArrow(lambda b: _sketch(b, bands), _SET_ROWS), "near-rows")
    known = F.col("doc_id").isNotNull()
    first = F.min(F.struct((~known).alias("n"), "doc_id", "text_hash"))  # any row of the class will do; the least id is its name
    classes = rows.where("digest is not null").groupBy("digest").agg(first.alias("f"), F.count("*").alias("class_size"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = materialize(classes.select("digest", F.col("f.doc_id").alias("id"), F.col("f.text_hash").alias("text_hash"), "class_size", "bands", "signature"), "near-classes")
    n_classes = classes.count()
    total = n_classes * bands
    keys = classes.select("digest", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumn("_c", F.col("c"))
    lists = materialize(join_hot(keys, shared, ["key"], "_c", total), "near-buckets")
    tried = materialize(_pairs(lists, _pivots(lists, [], F.col("digest"), F.lit(0)), [], F.lit(True), total), "near-candidates")
    pairs = materialize(check_signatures(tried, classes, threshold - MARGIN, k), "near-pairs", instead_of=tried)
    wide = lists.where(F.col("c") > SMALL)
    wanted = pairs.select(F.col("u").alias("digest")).unionByName(pairs.select(F.col("v").alias("digest"))).unionByName(wide.select("digest")).distinct()
    wanted = materialize(classes.join(wanted, "digest", "left_semi").select(F.coalesce("id", F.lit(-1)).alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "near-wanted")
    again = maybe_in(source.withColumn("_id", F.coalesce("doc_id", F.lit(-1))), wanted).withColumn("_hash", _text_hash()).join(wanted, ["_id", "_hash"], "left_semi")
    sets = again.select("text").mapInArrow(_sets, "digest binary, tokens array<long>")
    sets = materialize(sets.groupBy("digest").agg(F.first("tokens").alias("tokens")), "near-sets")
    tidy(docs.sparkSession)
    roots = components(confirm(pairs, sets, t))
    tidy(docs.sparkSession)
    mixed = wide.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    open_keys = mixed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("c").alias("_c")).where("r0 != r1").select("key", "_c")
    open_ = materialize(join_hot(wide, open_keys, ["key"], "_c", total).select("digest").distinct(), "near-undecided")
    if open_.limit(1).count():
        roots = _residual(sets, open_, roots, t)
    named = classes.select("digest", "id", "class_size").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("_c"))
    tidy(docs.sparkSession)
    labels = materialize(join_hot(named, least, ["root"], "_c", n_classes).select("digest", "component_id", "class_size"), "near-labels")
    alone = rows.where("digest is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    linked = rows.where("digest is not null").select("doc_id", "text_hash", "n_shingles", "digest")
    linked = join_hot(linked, labels.withColumn("_c", F.col("class_size")), ["digest"], "_c", rows.count()).select("doc_id", "text_hash", "n_shingles", "component_id", "class_size")
    out = alone.unionByName(linked)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_copies(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of each component's smallest doc_id stay, its others go; a null doc_id stays. Only what goes is joined, by doc_id and text, so another text of the same doc_id stays; rows that repeat a kept row in both stay with it (exact dedup takes those)."""
    found = _labelled(docs, threshold)
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    gone = materialize(gone, "near-gone")
    same = (docs["doc_id"].cast("long") == gone["_gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_gone_hash"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)
