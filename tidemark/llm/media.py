"""Payloads stored as 8-bit WAV media in a deduplicated store of content-defined chunks.

Method: a payload becomes the samples of a WAV file (8-bit mono, lossless). A rolling gear
hash over the file's bytes cuts it where the hash's top bits are zero, so equal stretches
give equal chunks wherever they stand. Chunks are named by 128 bits of their SHA-256; a Spark
aggregation keeps one of each name, and the store, compressed, is a table bucketed by that
name. A file is an ordered list of chunk names; joining the lists to the store gives the
bytes back, which are put together in order, verified against the file's whole SHA-256, and
parsed for the payload. Equal files are stored, read and verified once, so a group of
copies of any size costs one file; the feature rows are then joined to the documents.

Defined cases: a null or empty text is a payload of 64 zero bytes; null doc_ids and
repeated rows are kept as they are; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textnum import slices, stream
from tidemark.runtime import Scratch, clean_shuffles, shuffle_partitions

RATE = 8000
#: A chunk has 256 bytes at least and about 770 on average: most texts are of several chunks.
LEAST, BITS, MOST = 256, 9, 128 << 10
#: Chunks are stored, and files read, in so many waves by a hash: only one wave's bytes are in a shuffle at a time.
WAVES = 2
_GEAR = (stream(7, 256) >> np.uint64(32)).astype(np.uint32)


def wav(payload: bytes) -> bytes:
    """A mono 8-bit WAV file with ``payload`` as its samples."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file; ValueError for anything else."""
    if len(media) < 44 or media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this store")
    n = struct.unpack_from("<I", media, 40)[0]
    if len(media) != 44 + n:
        raise ValueError("a WAV file of another length than its header says")
    return media[44:]


def cuts(media: bytes, least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks: where the gear hash of the last 32 bytes has ``bits`` zero top bits, at ``least`` to ``most`` bytes."""
    n = len(media)
    if n <= least:
        return [n]
    h = _GEAR[np.frombuffer(media, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # the hash of twice as many bytes, shifted in as a byte at a time would be
        wide = h.copy()
        wide[step:] += h[:-step] << np.uint32(step)
        h = wide
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, at = [], 0
    while n - at > least:
        i = np.searchsorted(marks, at + least)
        end = int(marks[i]) if i < len(marks) else n
        at = min(end, at + most, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def feature(payload: bytes) -> str:
    """Mean, deviation and zero-crossing rate of the samples, and the shares of 8 levels."""
    x = np.frombuffer(payload, np.uint8)
    level = np.bincount(x >> 5, minlength=8) / len(x)
    wave = x.astype(np.float64) - 128
    crossing = np.count_nonzero(np.diff(wave >= 0)) / len(x)
    return ";".join([f"{wave.mean():.4f}", f"{wave.std():.4f}", f"{crossing:.4f}", ",".join(f"{v:.4f}" for v in level)])


_LISTED = "doc_id long, n_bytes long, file binary, media_bytes long, chunks array<binary>"
_LISTED_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary())]
_NAME = 16  # bytes of a chunk's SHA-256 that name it
#: Keys of files and chunks that a task remembers, at most.
_REMEMBERED = 500_000


def dictionary(docs: DataFrame, rows: int = 1000, size: int = 256 << 10) -> bytes:
    """A compression dictionary for the store, from the starts of ``rows`` texts; results do not depend on it."""
    texts = [r[0].encode() for r in docs.select(F.substring("text", 1, 8192).alias("t")).dropna().limit(rows).collect()]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to learn from
        return b""


def _codec(words: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


class _Once:
    """Whether a key is new to this task; forgets all when full."""

    def __init__(self) -> None:
        self.keys: set[bytes] = set()

    def __call__(self, key: bytes) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= _REMEMBERED:
            self.keys.clear()
        self.keys.add(key)
        return True


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """doc_ids, text lengths and media files of some rows at a time."""
    for rows, data, offsets in slices(batches):
        raw, ids = data.tobytes(), rows.column(0).cast(pa.int64()).to_pylist()
        texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield ids, [len(t) for t in texts], [wav(t + bytes(-len(t) % 64 if t else 64)) for t in texts]


def _pieces(media: bytes) -> Iterator[bytes]:
    at = 0
    for end in cuts(media):
        yield media[at:end]
        at = end


def _name(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:_NAME]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (chunks null), and the ordered chunk names of each file that is new to the task."""
    new = _Once()
    for ids, lengths, files in _files(batches):
        out = []
        for doc_id, n, media in zip(ids, lengths, files, strict=True):
            digest = hashlib.sha256(media).digest()
            out.append((doc_id, n, digest, len(media), None))
            if new(digest[:16]):
                out.append((None, None, digest, len(media), [_name(c) for c in _pieces(media)]))
        columns = zip(*out, strict=True)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _LISTED_TYPES, strict=True)], names=["doc_id", "n_bytes", "file", "media_bytes", "chunks"])


def _chunks(words: bytes, wave: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Name and compressed bytes of every chunk of this wave that is new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, new = zstandard.ZstdCompressor(level=12, write_dict_id=False, **_codec(words)), _Once()
        for _, _, files in _files(batches):
            found = {name: c for media in files for c in _pieces(media) if (name := _name(c))[0] % WAVES == wave and new(name)}
            yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array([pack.compress(c) for c in found.values()], pa.binary())], names=["chunk", "bytes"])

    return run


def _read(file: bytes, media: bytes) -> tuple[bytes, int, str, int, str]:
    """Digest of a file put together from its chunks, verified; payload length, digest, tail checksum and feature."""
    if hashlib.sha256(media).digest() != file:
        raise ValueError(f"{file.hex()} was not read back whole")
    payload = samples(media)
    return file, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature(payload)


_FEATURES = "file binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
_FEATURE_NAMES = ["file", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]


def _single(words: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Files of one chunk, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**_codec(words))
        for batch in batches:
            yield _feature_batch([_read(f, unpack.decompress(b)) for f, b in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)])

    return run


def _several(words: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Files of several chunks, from rows sorted by file and place. One file is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**_codec(words))
        file, whole = None, []
        for batch in batches:
            out = []
            for f, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if f != file:
                    out += [_read(file, b"".join(whole))] if whole else []
                    file, whole = f, []
                whole.append(unpack.decompress(b))
            yield _feature_batch(out)
        if whole:
            yield _feature_batch([_read(file, b"".join(whole))])

    return run


def _feature_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_FEATURE_NAMES)


def store_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store every text's payload as media, read the store back, and return a row of features per document."""
    docs = docs.select("doc_id", "text")
    with Scratch(spark, "media") as scratch:
        words = dictionary(docs)
        listed = scratch.table(docs.mapInArrow(_lists, _LISTED))
        store, buckets = f"media_{scratch.id.rsplit('-', 1)[1]}", shuffle_partitions(spark)
        where = scratch.path("store")
        try:
            for wave in range(WAVES):
                kept = docs.mapInArrow(_chunks(words, wave), "chunk binary, bytes binary").groupBy("chunk").agg(F.first("bytes").alias("bytes"))
                with clean_shuffles(spark):
                    kept.write.mode("append").bucketBy(buckets, "chunk").option("path", where).option("compression", "uncompressed").saveAsTable(store)
            files = listed.filter("chunks is not null").groupBy("file").agg(F.first("chunks").alias("chunks"))
            chunks = spark.table(store)
            single = chunks.join(files.filter("size(chunks) = 1").select("file", F.col("chunks")[0].alias("chunk")), "chunk").select("file", "bytes")
            place = files.filter("size(chunks) > 1").select("file", F.posexplode("chunks").alias("seq", "chunk"))
            features = scratch.table(single.mapInArrow(_single(words), _FEATURES))
            for wave in range(WAVES):
                several = chunks.join(place.filter(F.pmod(F.crc32("file"), F.lit(WAVES)) == wave), "chunk").select("file", "seq", "bytes")
                several = several.repartition(buckets, "file").sortWithinPartitions("file", "seq")
                features = features.unionByName(scratch.table(several.mapInArrow(_several(words), _FEATURES)))
            documents = listed.filter("chunks is null").select("doc_id", "n_bytes", "file", "media_bytes")
            joined = documents.join(features, "file").withColumn("media_sha256", F.lower(F.hex("file"))).drop("file")
            return scratch.result(joined)
        finally:
            spark.sql(f"drop table if exists {store}")
