"""Token ids in shard files, with a minimal perfect hash index from document keys to places in them.

Files are a folder of three tables, written through Spark, so any store will do and a lost executor costs its own tasks:

- `shards`: a row is a segment, (shard, segment, doc_ids, nths, offsets, counts, payload). The payload holds the ids of its documents one
  after another as raw little-endian numbers of 16 bits, or of 32 where the vocabulary is larger; the lists say whose they are. Shards are
  ranges of keys, so segments in order are all ids in ascending order of keys.
- `starts`: (shard, segment, start), the number of ids before each segment.
- `index`: (bucket, buckets, bits, widths, fingerprints, shards, segments, offsets, counts, starts), the function and entries of a bucket of keys.

A key is (doc_id, nth), the nth row of that id from 0. Its hash names the bucket. In there, each level of the function has twice as many bits as keys that are left;
a key owns the bit of its hash if no other key has it, else it goes on to the next level. The rank of its bit among all bits is its slot:
as many slots as keys, found in two levels on average. A slot keeps a 32-bit fingerprint of its key, so keys that were never written are turned away (all but one in
2^32), and shard, segment, offset and count, so one slice of the payload has the ids.

Defined results: a null text counts as empty and has the end id alone; a null doc_id is a key like any other and comes first; rows of
one doc_id stand in an order drawn from their places in the table, over as many shards as they need; an empty table gives files without rows. Strings of
special tokens inside a text become that token, the library's default.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.piece_bpe import slices
from pagemill.llm.token_counts import END as TEXT_END
from pagemill.llm.token_counts import _spans, transducer

END = 0
SHARD_DOCS = 1024
MOST_SHARDS = 20_000
SEGMENT_IDS, SEGMENT_DOCS = 1 << 19, 8192
BUCKET = 4096
CACHE = 250_000
#: Bytes of text that are encoded at once.
SLICE = 2_000_000
NO_ID = np.int64(-(2**63))


# --- encoding


#: Pre-tokens are handed to the library together, with this between them.
BETWEEN = "\x0b"


class IdEncoder:
    """Ids of whole texts, each followed by the end id, by the tokenizers library, as raw little-endian numbers.

    Pre-tokens never merge with their neighbours. A batch is cut into them as one array of characters (as in `token_counts`), the library
    encodes each different one that is not known yet, and the ids of all are gathered. What the last `CACHE` different ones and
    as many before them gave is kept, and what one batch needs.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.cutter, self.dtype = transducer(path), id_type(path)
        self.library, self.models = Tokenizer.from_file(path), [Tokenizer.from_file(path) for _ in range(2)]
        # The same models over what is already cut.
        bare = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.models[0].pre_tokenizer, self.models[1].pre_tokenizer = bare, pre_tokenizers.Sequence([pre_tokenizers.Split(BETWEEN, "isolated"), bare])
        self.between = self.models[0].encode(BETWEEN, add_special_tokens=False).ids
        self.end = np.array([END], self.dtype).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        plain, odd = [], []
        for p in pieces:
            (odd if BETWEEN.encode() in p else plain).append(p)
        if plain:
            ids = np.array(self.models[1].encode_batch_fast([BETWEEN.join([p.decode() for p in plain])], add_special_tokens=False)[0].ids, self.dtype)
            raw, ends = ids.tobytes(), np.append(np.flatnonzero(ids == self.between[0]), len(ids)) * self.dtype.itemsize
            starts = np.concatenate(([0], ends[:-1] + self.dtype.itemsize))
            self.known.update(zip(plain, map(raw.__getitem__, map(slice, starts.tolist(), ends.tolist())), strict=True))
        for p, told in zip(odd, self.models[0].encode_batch_fast([p.decode() for p in odd], add_special_tokens=False), strict=True):
            self.known[p] = np.array(told.ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id. Texts with strings of special tokens are handed over whole."""
        special = self.cutter.special
        marked = {i for i, t in enumerate(texts) if special and special.search(t)}
        out = self._encode(["" if i in marked else t for i, t in enumerate(texts)] if marked else texts)
        for i in marked:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, self.dtype).tobytes() + self.end
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.cutter.classes[points]
        for c in np.unique(points[classes == 255]).tolist():
            self.cutter.classes[c] = self.cutter._class(c)
            classes[points == c] = self.cutter.classes[c]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        classes[ends] = TEXT_END
        starts = _spans(classes)
        # Where pre-tokens start in UTF-8: characters before them, and what longer ones take more.
        wide = np.flatnonzero(points >= 0x80)
        more = np.concatenate(([0], np.cumsum(1 + (points[wide] >= 0x800) + (points[wide] >= 0x10000))))
        bounds = np.append(starts, len(points))
        offsets = bounds + more[np.searchsorted(wide, bounds)]
        told = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined.encode())]).dictionary_encode()
        codes, pieces = told.indices.to_numpy().copy(), told.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self.before, self.known = self.known, {}
        missing = [p for p in pieces if p not in self.known]
        self.known.update((p, self.before[p]) for p in missing if p in self.before)
        self._learn([p for p in missing if p not in self.known])
        raw = list(map(self.known.__getitem__, pieces)) + [self.end]
        is_end = classes[starts] == TEXT_END
        codes[is_end] = len(pieces)
        sizes = np.fromiter(map(len, raw), np.int32, len(raw)) // self.dtype.itemsize
        flat, counts = np.frombuffer(b"".join(raw), self.dtype), sizes[codes]
        upto = np.cumsum(counts)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - upto + counts, counts) + np.arange(upto[-1])]
        stops = upto[is_end] * self.dtype.itemsize
        held = ids.tobytes()
        return [held[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


def id_type(path: str) -> np.dtype:
    """The narrowest of the two formats that holds every id."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 2**16 else "<u4")


# --- hashing


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of keys; keys that agree under one seed part under another."""
    first = mixed(np.where(nulls, NO_ID, ids).astype(np.int64).view(np.uint64), 2 * seed)
    with np.errstate(over="ignore"):
        return mixed(first + (nth.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64)), 2 * seed + 1)


BUCKET_SEED, PRINT_SEED, LEVEL_SEED = 1, 2, 16


def fingerprint(ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return (key_hash(ids, nulls, nth, PRINT_SEED) >> np.uint64(32)).astype(np.uint32)


def perfect_levels(ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> list[np.ndarray]:
    """The bits of every level of a minimal perfect hash function of different keys."""
    left, levels = np.arange(len(ids)), []
    while len(left):
        width = 2 * len(left)
        at = (key_hash(ids[left], nulls[left], nth[left], LEVEL_SEED + len(levels)) % np.uint64(width)).astype(np.int64)
        met = np.bincount(at, minlength=width)
        levels.append(met == 1)
        left = left[met[at] > 1]
    return levels


def slots(levels: list[np.ndarray], ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The slot of every key: its own for a key of the function, any or -1 for others."""
    out, left, before = np.full(len(ids), -1, np.int64), np.arange(len(ids)), 0
    for level, bits in enumerate(levels):
        rank = np.cumsum(bits)
        at = (key_hash(ids[left], nulls[left], nth[left], LEVEL_SEED + level) % np.uint64(len(bits))).astype(np.int64)
        found = bits[at]
        out[left[found]] = before + rank[at[found]] - 1
        left, before = left[~found], before + int(rank[-1])
    return out


def _packed_levels(levels: list[np.ndarray]) -> tuple[bytes, list[int]]:
    return b"".join(np.packbits(b).tobytes() for b in levels), [len(b) for b in levels]


def _unpacked_levels(raw: bytes, widths: list[int]) -> list[np.ndarray]:
    ends = np.cumsum([-(-w // 8) for w in widths]).tolist()
    return [np.unpackbits(np.frombuffer(raw[a:b], np.uint8))[:w].astype(bool) for a, b, w in zip([0, *ends], ends, widths, strict=False)]


# --- files

SEGMENTS = "shard int, segment int, doc_ids array<bigint>, nths array<bigint>, offsets array<bigint>, counts array<bigint>, payload binary"


@dataclass
class Files:
    """A folder of shards, starts and index."""

    spark: SparkSession
    folder: str
    dtype: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def write(docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, bucket: int = BUCKET, segment_ids: int = SEGMENT_IDS) -> Files:
    """Encodes `docs` with the vocabulary file `path` into a new folder.

    Bounds of shards come from quantiles of the keys alone. A key that reaches over several bounds is spread over their shards.
    """
    files = Files(docs.sparkSession, folder, id_type(path).str)
    _write_shards(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), path, files, shard_docs, segment_ids)
    _write_starts(files)
    _write_index(files, bucket)
    return files


def _bounds(docs: DataFrame, shard_docs: int) -> np.ndarray:
    n = docs.count()
    shards = min(MOST_SHARDS, -(-n // shard_docs))
    if shards < 2:
        return np.zeros(0, np.int64)
    shares = [i / shards for i in range(1, shards)]
    asked = docs.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(int(NO_ID))), shares, 10 * shards)).first()[0]
    return np.array(asked, np.int64)


def _write_shards(docs: DataFrame, path: str, files: Files, shard_docs: int, segment_ids: int) -> None:
    bounds, dtype = _bounds(docs, shard_docs), np.dtype(files.dtype)
    numbered = docs.select("doc_id", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**32)).alias("tie"), "text")

    def encode(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in incoming:
            for at, n in slices(batch.column("text"), SLICE):
                part = batch.slice(at, n)
                held = coder.encode([t or "" for t in part.column("text").to_pylist()])
                keys, ties = part.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False), part.column("tie").to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
                shard = low + (ties * (high - low + 1) >> 32)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column("doc_id"), part.column("tie"), pa.array(held, pa.binary())], ["shard", "doc_id", "tie", "ids"])

    coded = numbered.mapInArrow(encode, "shard int, doc_id long, tie long, ids binary")
    order = ["shard", F.col("doc_id").asc_nulls_first(), "tie", "ids"]
    # A shard is within one task; a task may have several.
    dealt = coded.repartition(max(1, len(bounds) + 1), "shard").sortWithinPartitions(*order)

    def pack(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        held, size, shard, segment, key, nth = [], 0, None, 0, None, 0

        def segment_row() -> pa.RecordBatch:
            ids, nths, payload = zip(*held, strict=True)
            counts = np.array([len(p) // dtype.itemsize for p in payload], np.int64)
            row = [shard], [segment], [list(ids)], [list(nths)], [np.cumsum(counts) - counts], [counts], [b"".join(payload)]
            kinds = pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["shard", "segment", "doc_ids", "nths", "offsets", "counts", "payload"])

        for batch in incoming:
            for s, ident, ids in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and (s != shard or size + len(ids) > segment_ids * dtype.itemsize or len(held) == SEGMENT_DOCS):
                    yield segment_row()
                    held, size, segment = [], 0, segment + 1
                if s != shard:
                    shard, segment, nth = s, 0, 0
                elif ident == key:
                    nth += 1
                else:
                    nth = 0
                key = ident
                held.append((ident, nth, ids))
                size += len(ids)
        if held:
            yield segment_row()

    dealt.mapInArrow(pack, SEGMENTS).write.option("compression", "zstd").parquet(f"{files.folder}/shards")


def _write_starts(files: Files) -> None:
    """Ids before each segment. Within a shard the sum is its own; one row a shard is added up in one task."""
    sizes = files.table("shards").select("shard", "segment", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("n"))
    upto = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    whole = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("within", within).join(whole, "shard").select("shard", "segment", (F.col("before") + F.col("within")).alias("start")).write.parquet(f"{files.folder}/starts")


def entries(files: Files) -> DataFrame:
    """(doc_id, nth, shard, segment, offset, count) of every document in the files, read without the payload; nth counts on over shards."""
    listed = F.inline(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("nths").alias("nth"), F.col("offsets").alias("offset"), F.col("counts").alias("count")))
    told = files.table("shards").select("shard", "segment", listed)
    # Keys are in order, so only the last key of a shard can go on, and only as the first key of the next ones.
    ends = files.table("shards").groupBy("shard").agg(F.min_by(F.get("doc_ids", F.lit(0)), "segment").alias("first"), F.max_by(F.struct(F.element_at("doc_ids", -1).alias("doc_id"), (F.element_at("nths", -1) + 1).alias("n")), "segment").alias("last"))
    runs = ends.select("shard", "last.doc_id", "last.n").unionByName(ends.select("shard", F.col("first").alias("doc_id"), F.lit(0).cast("long").alias("n"))).groupBy("shard", "doc_id").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("doc_id").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    carried = runs.select(F.col("shard").alias("in_shard"), F.col("doc_id").alias("of"), earlier.alias("earlier")).where("earlier > 0")
    met = told.join(carried, (F.col("shard") == F.col("in_shard")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return met.select("doc_id", (F.col("nth") + F.coalesce("earlier", F.lit(0))).alias("nth"), "shard", "segment", "offset", "count")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "nth"), F.lit(buckets)).cast("int")


ENTRY = {"shard": "<i4", "segment": "<i4", "offset": "<i8", "count": "<i8", "start": "<i8"}
INDEX = "bucket int, buckets int, bits binary, widths array<int>, fingerprints binary, " + ", ".join(f"{c}s binary" for c in ENTRY)


def _keys(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, whether it is null, nth) of an Arrow table."""
    ids, nth = table.column("doc_id").combine_chunks(), table.column("nth")
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), nth.to_numpy()


def _write_index(files: Files, bucket: int) -> None:
    n = files.table("shards").agg(F.sum(F.size("counts"))).first()[0] or 0
    buckets = max(1, -(-n // bucket))

    def build(group):

        keys = _keys(group)
        levels = perfect_levels(*keys)
        order = np.argsort(slots(levels, *keys))
        bits, widths = _packed_levels(levels)
        row = {"bucket": [group.column("bucket")[0].as_py()], "buckets": [buckets], "bits": [bits], "widths": [widths], "fingerprints": [fingerprint(*keys)[order].astype("<u4").tobytes()]}
        row |= {f"{c}s": [group.column(c).to_numpy()[order].astype(t).tobytes()] for c, t in ENTRY.items()}
        return pa.table(row, schema=pa.schema([("bucket", pa.int32()), ("buckets", pa.int32()), ("bits", pa.binary()), ("widths", pa.list_(pa.int32())), *[(c, pa.binary()) for c in row if c.endswith("s") and c not in ("buckets", "bits", "widths")]]))

    told = entries(files).join(files.table("starts"), ["shard", "segment"]).withColumn("start", F.col("start") + F.col("offset"))
    told.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, INDEX).write.parquet(f"{files.folder}/index")


# --- access


def lookup(files: Files, keys: DataFrame) -> DataFrame:
    """(doc_id, nth, shard, segment, offset, count, start) of those of `keys` (doc_id, nth) that were written.

    Keys meet the index by bucket; a bucket's function and fingerprints settle each in constant time.
    """
    index = files.table("index")
    known = index.select("buckets").first()
    buckets = known[0] if known else 1
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("nth").cast("long").alias("nth")).distinct().withColumn("bucket", _bucket(buckets))

    def find(left, right):

        key, kinds = _keys(left), {c: np.dtype(t) for c, t in ENTRY.items()}
        if right.num_rows:
            cell = {c: right.column(c)[0].as_py() for c in right.column_names}
            slot = slots(_unpacked_levels(cell["bits"], cell["widths"]), *key)
            prints = np.frombuffer(cell["fingerprints"], "<u4")
            good = np.flatnonzero((slot >= 0) & (prints[slot] == fingerprint(*key)))
            entry = {c: np.frombuffer(cell[f"{c}s"], t)[slot[good]] for c, t in kinds.items()}
        else:
            good, entry = np.zeros(0, np.int64), {c: np.zeros(0, t) for c, t in kinds.items()}
        return pa.table({"doc_id": left.column("doc_id").take(pa.array(good)), "nth": left.column("nth").take(pa.array(good)), **{c: pa.array(v) for c, v in entry.items()}})

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, "doc_id long, nth long, shard int, segment int, offset long, count long, start long")


def ids_crc32(ids: np.ndarray) -> int:
    """The unsigned CRC-32 of ids as little-endian numbers of 32 bits."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def digests(files: Files) -> DataFrame:
    """(shard, segment, offset, ids_crc32) of every document in the files; payloads are read where they are and never moved."""
    dtype = np.dtype(files.dtype)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        for batch in incoming:
            for i in range(batch.num_rows):
                offsets, counts = (batch.column(c)[i].values.to_numpy() for c in ("offsets", "counts"))
                ids = np.frombuffer(batch.column("payload")[i].as_buffer(), dtype)
                told = [ids_crc32(ids[a : a + n]) for a, n in zip(offsets.tolist(), counts.tolist(), strict=True)]
                place = [pa.array(np.full(len(told), batch.column(c)[i].as_py(), np.int32)) for c in ("shard", "segment")]
                yield pa.RecordBatch.from_arrays([*place, pa.array(offsets), pa.array(told, pa.int64())], ["shard", "segment", "offset", "ids_crc32"])

    rows = files.table("shards").select("shard", "segment", "offsets", "counts", "payload")
    return rows.mapInArrow(run, "shard int, segment int, offset long, ids_crc32 long")


def fetch(files: Files, keys: DataFrame) -> DataFrame:
    """(doc_id, nth, ids) of those of `keys` (doc_id, nth) that were written: their slices of the payloads of the segments that hold them."""
    dtype = np.dtype(files.dtype)

    def cut(left, right):

        ids = np.frombuffer(right.column("payload")[0].as_buffer(), dtype) if right.num_rows else np.zeros(0, dtype)
        held = [ids[a : a + n].astype(np.int64) for a, n in zip(left.column("offset").to_pylist(), left.column("count").to_pylist(), strict=True)]
        return pa.table({"doc_id": left.column("doc_id"), "nth": left.column("nth"), "ids": pa.array(held, pa.list_(pa.int64()))})

    found = lookup(files, keys)
    wanted = files.table("shards").join(found.select("shard", "segment").distinct(), ["shard", "segment"], "left_semi").select("shard", "segment", "payload")
    return found.groupBy("shard", "segment").cogroup(wanted.groupBy("shard", "segment")).applyInArrow(cut, "doc_id long, nth long, ids array<long>")


def key_list(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, nth) of every row of `docs`: as many keys of an id as it has rows."""
    counted = docs.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
