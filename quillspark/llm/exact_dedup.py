"""Exact deduplication by an extendible-hash index on shared files.

1. Scan tasks hash each normalised text to 64 bits and chain equal texts they meet, comparing bytes, so that a hot text
   leaves a task once however often it occurs.
2. Each chain goes to the owner of its key range (top bits of the hash). An owner looks every text up in its directory:
   the next bits of the hash name a slot, the slot a bucket, and in the bucket the chain of that hash is compared byte by
   byte. A new text is entered; an overfull bucket is split on its next bit, doubling the directory where the bucket is
   as deep as it is. Texts reach an owner in key order (Spark's external sort), so that a bucket whose range has passed
   is full for good: its entries are written to the shared folder and its texts are forgotten.
3. Documents find their keeper as the owners do: owner and slot lead through the written directory to a bucket, and the
   bucket's entry of that hash and digest to the keeper. A document without an entry is an error.

Texts move once. An owner holds the open buckets (at most BUCKET_ENTRIES texts and about BUCKET_BYTES each, unless all
share one hash) and the slots of its directory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOCAL, partitions, written

SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of distinct texts that a scan task chains before it sends them on.
LOCAL_BYTES = 24 << 20
BUCKET_ENTRIES = 256
BUCKET_BYTES = 8 << 20
_NO_ID = -(1 << 63)
_MASK = (1 << 64) - 1
_CHAIN = "key long, text binary, keep_id long, n long"
#: Rows of a directory name the bucket of a slot; rows of entries hold what a bucket knows of one text.
_INDEX = "what string, owner int, slot long, slot_depth int, depth int, bucket long, key long, chain int, text_sha256 string, keep_id long, group_size long"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
_INDEX_TYPE = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _INDEX.split(", ")])


class Bucket:
    """The chains of the hashes that begin with the `depth` bits of `prefix` (after the bits that name the owner)."""

    __slots__ = ("chains", "depth", "n", "prefix", "size")

    def __init__(self, depth: int, prefix: int) -> None:
        self.depth, self.prefix, self.n, self.size = depth, prefix, 0, 0
        self.chains: dict[int, list[list]] = {}  # by hash: [text, smallest id, rows] of each different text

    def put(self, key: int, text: bytes, keep: int | None, n: int) -> None:
        """Enter a text, or add to the entry that has its bytes."""
        chain = self.chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                entry[1], entry[2] = _smaller(entry[1], keep), entry[2] + n
                return
        chain.append([text, keep, n])
        self.n += 1
        self.size += len(text)


class Directory:
    """An extendible-hash directory over 64-bit keys whose first `skip` bits agree.

    Only keys that agree in all bits may overfill a bucket.
    """

    def __init__(self, capacity: int = BUCKET_ENTRIES, skip: int = 0, max_depth: int = 32, limit: int = BUCKET_BYTES) -> None:
        self.capacity, self.skip, self.max_depth, self.limit, self.depth = capacity, skip, max_depth, limit, 0
        self.slots = [Bucket(0, 0)]
        self.open = list(self.slots)  # buckets not handed out yet, by range

    def bits(self, key: int, depth: int) -> int:
        return ((key << self.skip) & _MASK) >> (64 - depth)

    def bucket(self, key: int) -> Bucket:
        return self.slots[self.bits(key, self.depth)]

    def insert(self, key: int, text: bytes, keep: int | None, n: int) -> None:
        found = self.bucket(key)
        found.put(key, text, keep, n)
        while (found.n > self.capacity or found.size > self.limit) and found.depth < self.max_depth and len(found.chains) > 1:
            found = self.split(found, key)

    def split(self, full: Bucket, key: int) -> Bucket:
        """Part a bucket on its next bit, doubling the directory if it is no deeper; gives the bucket of the key."""
        if full.depth == self.depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
        halves = [Bucket(full.depth + 1, full.prefix * 2 + k) for k in (0, 1)]
        for k, chain in full.chains.items():
            half = halves[self.bits(k, full.depth + 1) & 1]
            half.chains[k] = chain
            half.n += len(chain)
            half.size += sum(len(entry[0]) for entry in chain)
        span = 1 << (self.depth - full.depth - 1)
        for half in halves:
            self.slots[half.prefix * span : (half.prefix + 1) * span] = [half] * span
        at = self.open.index(full)
        self.open[at : at + 1] = halves
        return self.bucket(key)

    def passed(self, key: int | None) -> Iterator[Bucket]:
        """Hand out the buckets whose range ends before the key (None: all); nothing may be entered there any more."""
        while self.open and (key is None or self.open[0].prefix < self.bits(key, self.open[0].depth)):
            yield self.open.pop(0)


def normalised(text: Column) -> Column:
    """The text with each run of blanks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the equal texts of a scan task: one row for each distinct text, with the smallest id and the count."""
    held: dict[int, list[list]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(key, *x) for key, chain in held.items() for x in chain]
        for at in range(0, len(rows), 2000):
            key, text, keep, n = zip(*rows[at : at + 2000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(text, pa.binary()), pa.array(keep, pa.int64()), pa.array(n, pa.int64())], ["key", "text", "keep_id", "n"])

    for batch in batches:
        for key, text, doc in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
            chain = held.setdefault(key, [])
            for entry in chain:
                if entry[0] == text:
                    entry[1], entry[2] = _smaller(entry[1], doc), entry[2] + 1
                    break
            else:
                chain.append([text, doc, 1])
                size += len(text) + 100
        if size > LOCAL_BYTES:
            yield from out()
            held.clear()
            size = 0
    yield from out()


def _owner(capacity: int, skip: int):
    def entries(owner: int, bucket: Bucket) -> Iterator[tuple]:
        for key, chain in bucket.chains.items():
            signed = key - (1 << 64) if key >> 63 else key
            for i, (text, keep, n) in enumerate(chain):
                yield "entry", owner, None, None, bucket.depth, bucket.prefix, signed, i, hashlib.sha256(text).hexdigest(), keep, n
        bucket.chains.clear()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        directory, owner = None, None

        def end() -> Iterator[tuple]:
            for bucket in directory.passed(None):
                yield from entries(owner, bucket)
            for slot, bucket in enumerate(directory.slots):
                yield "slot", owner, slot, directory.depth, bucket.depth, bucket.prefix, None, None, None, None, None

        for batch in batches:
            for o, key, text, keep, n in zip(*(batch.column(c).to_pylist() for c in ("owner", "key", "text", "keep_id", "n")), strict=True):
                if o != owner:
                    if directory:
                        yield from end()
                    directory, owner = Directory(capacity, skip), o
                key &= _MASK
                for bucket in directory.passed(key):
                    yield from entries(owner, bucket)
                directory.insert(key, text, keep, n)
        if directory:
            yield from end()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _INDEX_TYPE, strict=True)], schema=_INDEX_TYPE)
        for row in rows(batches):
            held.append(row)
            if len(held) == 4096:
                yield made()
                held.clear()
        if held:
            yield made()

    return task


def _owner_bits(docs: DataFrame) -> int:
    """Owners are a power of two, so that a range of keys is a beginning of bits; two at least."""
    return max(1, (partitions(docs.sparkSession) - 1).bit_length())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """The index as a table in the shared folder: the slots of all directories and the entries of all buckets."""
    skip = _owner_bits(docs)
    text = normalised(F.col(text_col))
    chains = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text")).mapInArrow(_chains, _CHAIN)
    owner = F.shiftrightunsigned("key", 64 - skip).cast("int")
    routed = chains.withColumn("owner", owner).repartitionById(1 << skip, F.col("owner")).sortWithinPartitions("owner", "key")
    # One file a task: on a local folder each file and folder costs a process that Hadoop starts to set its permissions.
    return written(routed.mapInArrow(_owner(capacity, skip), _INDEX), "exact-index", few=True)


def looked_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """keep_id and group_size of each row, found by its key and text_sha256 through directory and bucket.

    A row whose slot leads to no bucket with its text raises.
    """
    skip = _owner_bits(rows)
    slots = index.filter("what = 'slot'")
    # One row an owner, of which there are fewer than twice the shuffle partitions: small at every size.
    depths = slots.groupBy("owner").agg(F.max("slot_depth").alias("slot_depth"))
    slot = F.expr(f"CASE WHEN slot_depth > 0 THEN shiftrightunsigned(shiftleft(key, {skip}), 64 - slot_depth) ELSE 0L END")
    routed = rows.withColumn("owner", F.shiftrightunsigned("key", 64 - skip).cast("int")).join(F.broadcast(depths), "owner", "left").withColumn("slot", slot)
    placed = routed.join(slots.select("owner", "slot", "depth", "bucket"), ["owner", "slot"], "left")
    entries = index.filter("what = 'entry'").select("owner", "depth", "bucket", "key", "text_sha256", "keep_id", "group_size")
    found = placed.join(entries, ["owner", "depth", "bucket", "key", "text_sha256"], "left")
    sure = F.when(F.col("group_size").isNotNull(), F.col("group_size")).otherwise(F.raise_error(F.concat(F.lit("the index has no entry of a text with digest "), F.col("text_sha256"))))
    return found.withColumn("group_size", sure).drop("owner", "slot", "slot_depth", "depth", "bucket", "key")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after blanks are normalised; null counts as empty. Of equal texts the smallest id
    stays. A null id never stays while another id is there. Rows that repeat an id and its text stand or fall together.
    An empty table gives no rows. Other columns are not read, whatever their names.
    """
    found = looked_up(_keyed(docs, id_col, text_col), build_index(docs, id_col, text_col, capacity))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    return text.select("doc_id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an id and its text one stays.

    Nulls and repeated rows count as in exact_dedup; an empty table gives an empty one.
    """
    known = lambda c: F.coalesce(c.cast("long"), F.lit(_NO_ID)).alias("id")
    found = exact_dedup(docs, id_col, text_col, capacity).filter("kept").select(F.col("text_sha256").alias("sha"), known(F.col("doc_id")))
    # Ids and digests go through the index; texts move once more, to the ids that stay.
    kept = written(found, "kept", **LOCAL)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), known(F.col(id_col)), F.sha2(normalised(F.col(text_col)), 256).alias("sha"))
    # By digest and id, so a hot text is no hot key; repeated rows meet in the same partition, without another exchange.
    return keyed.join(kept, ["sha", "id"], "left_semi").dropDuplicates(["sha", "id"]).select("row.*")
