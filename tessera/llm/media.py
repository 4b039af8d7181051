"""Media columns in a content-addressed chunk store: gear-hash cuts, chunks deduplicated by digest, verified rebuilding.

A text's payload (UTF-8, zero bytes up to a positive multiple of 64) is stored as a mono WAV file of unsigned 8-bit
samples. The file is cut where the top bits of a rolling gear hash of its last 32 bytes are zero, within a least and a largest chunk size, so that
equal passages make equal chunks wherever they stand. An object is an ordered list of chunk digests under the digest of
the whole file, once for equal texts. A join of the digests alone finds the chunks that several places have; the store keeps
each chunk once, compressed, with the first object that has it. Reading joins the lists with the store, fetches shared
chunks from their keepers, and fails unless every chunk and the rebuilt file have their digests.

A payload moves once, to its object, and again only where other objects fetch it. An object is at most as large as one text and its
header. Null texts count as empty (64 zero bytes). Repeated rows share an object. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, strings, written

UNIT, RATE = 64, 8000
#: Chunk sizes in bytes: none smaller but an object's last, none larger; between them a cut every AVERAGE bytes.
LEAST, AVERAGE, MOST = 2_048, 8_192, 65_536
HEADER = 44


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def wav(samples: bytes) -> bytes:
    """A RIFF file: PCM, one channel, 8 bits, RATE samples a second."""
    n = len(samples)
    word, half = (lambda x: x.to_bytes(4, "little")), (lambda x: x.to_bytes(2, "little"))
    return b"".join((b"RIFF", word((36 + n) & 0xFFFFFFFF), b"WAVEfmt ", word(16), half(1), half(1), word(RATE), word(RATE), half(1), half(8), b"data", word(n & 0xFFFFFFFF), samples))


@cache
def gear() -> np.ndarray:
    """A random 32-bit number for each byte, from the digests of the bytes."""
    return np.asarray([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def gear_hash(data: bytes) -> np.ndarray:
    """The gear hash after each byte: h = 2h + gear[byte], modulo 2**32, so of the last 32 bytes; summed by doubling."""
    h = gear()[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def cuts(data: bytes, least: int = LEAST, average: int = AVERAGE, most: int = MOST, block: int = 1 << 22) -> list[int]:
    """Ends of the chunks of data. Hashes are made block by block, with the 31 bytes before."""
    bits = np.uint32(32 - (average.bit_length() - 1))
    candidates = []
    for at in range(0, len(data), block):
        back = min(31, at)
        h = gear_hash(data[at - back : at + block])[back:]
        candidates.append(np.flatnonzero(h >> bits == 0) + at + 1)
    marks = np.concatenate(candidates) if candidates else np.zeros(0, np.int64)
    out, start = [], 0
    while start < len(data):
        k = np.searchsorted(marks, start + least)
        end = min(start + most, len(data), int(marks[k]) if k < len(marks) else len(data))
        out.append(end)
        start = end
    return out


def catalog(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, object_id (the file's digest) and digests (of its chunks in order) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, objects, lists = [], [], []
            for t in strings(b, 1):
                data = wav(payload(t))
                ends = cuts(data)
                sizes.append(len(t.encode()))
                objects.append(hashlib.sha256(data).digest())
                lists.append([hashlib.sha256(data[s:e]).digest() for s, e in zip([0, *ends], ends, strict=False)])
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(objects, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "object_id", "digests"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, "doc_id long, n_bytes long, object_id binary, digests array<binary>")


def _contents(docs: DataFrame, text_col: str) -> DataFrame:
    """object_id, contents (compressed chunks in order) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=5).compress
        for b in batches:
            objects, lists = [], []
            for t in strings(b, 0):
                data = wav(payload(t))
                ends = cuts(data)
                objects.append(hashlib.sha256(data).digest())
                lists.append([press(data[s:e]) for s, e in zip([0, *ends], ends, strict=False)])
            yield pa.record_batch([pa.array(objects, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["object_id", "contents"])

    return map_arrow(docs.select(F.col(text_col).cast("string")), run, "object_id binary, contents array<binary>")


def shared_chunks(listed: DataFrame) -> DataFrame:
    """Where chunks that occur more than once stand: digest, object_id, seq, own (the place whose copy the store keeps, the
    first in order). listed: a catalog. Only digests are shuffled."""
    manifest = listed.groupBy("object_id").agg(F.first("digests").alias("digests"))
    places = manifest.select("object_id", F.posexplode("digests").alias("seq", "digest"))
    often = written(places.groupBy("digest").agg(F.min(F.struct("object_id", "seq")).alias("keeper"), F.count("*").alias("n")).filter("n > 1"), "often")
    return places.join(often, "digest").select("digest", "object_id", "seq", (F.struct("object_id", "seq") == F.col("keeper")).alias("own"))


def store(docs: DataFrame, shared: DataFrame, text_col: str = "text") -> DataFrame:
    """The chunk store, a row for each distinct object: object_id, contents, given. A content is null where the chunk is
    kept by another place; given lists seq and digest of chunks that other places take from here."""
    roles = shared.groupBy("object_id").agg(F.collect_list(F.when(~F.col("own"), F.col("seq"))).alias("taken"), F.collect_list(F.when(F.col("own"), F.struct("seq", "digest"))).alias("given"))
    # Joins would add this condition where they can: with it in both plans that read the store, they share its one shuffle.
    objects = _contents(docs, text_col).filter("object_id is not null").groupBy("object_id").agg(F.first("contents").alias("contents"))
    # A byte for each chunk up to the last taken one, "1" where it is taken: each chunk is looked up at its place.
    places = F.array_sort("taken")
    flags = F.array_join(F.transform(places, lambda x, k: F.lpad(F.lit("1"), x - F.coalesce(F.get(places, k - 1), F.lit(-1)), F.lit("0"))), "").cast("binary")
    kept = F.when(F.size("taken") > 0, F.transform("contents", lambda c, k: F.when(F.substring("flags", k + 1, 1) != F.lit(b"1"), c))).otherwise(F.col("contents"))
    roles = roles.withColumn("flags", flags)
    return objects.join(roles, "object_id", "left").select("object_id", kept.alias("contents"), "given")


def rebuilt(listed: DataFrame, kept: DataFrame, shared: DataFrame) -> DataFrame:
    """Each object's file read back from the store in the order of its chunk list and verified: object_id, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, feature. A missing chunk is an error, as are a chunk or file with another
    digest."""
    manifest = listed.groupBy("object_id").agg(F.first("digests").alias("digests"))
    given = kept.select(F.explode(F.transform("given", lambda g: F.struct(g["digest"].alias("digest"), F.element_at("contents", g["seq"] + 1).alias("content")))).alias("g")).select("g.*")
    fetched = shared.filter(~F.col("own")).join(given, "digest").groupBy("object_id").agg(F.collect_list(F.struct("seq", "content")).alias("fetched"))
    rows = kept.select("object_id", "contents").join(manifest, "object_id").join(fetched, "object_id", "left").select("object_id", "digests", "contents", "fetched")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        kinds = {"object_id": pa.binary(), "payload_bytes": pa.int64(), "payload_sha256": pa.binary(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "feature": pa.string()}
        for b in batches:
            out = []
            for whole, digests, contents, others in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for x in others or ():
                    contents[x["seq"]] = x["content"]
                if None in contents:
                    raise ValueError(f"a chunk of object {whole.hex()} is missing")
                chunks = [expand(c) for c in contents]
                data = b"".join(chunks)
                if [hashlib.sha256(c).digest() for c in chunks] != digests or hashlib.sha256(data).digest() != whole:
                    raise ValueError(f"object {whole.hex()} can't be rebuilt from its chunks")
                out.append((whole, *described(data)))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return map_arrow(rows, run, "object_id binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string")


def described(data: bytes) -> tuple[int, bytes, int, int, str]:
    """Of a WAV file as wav() makes it: payload bytes and digest, CRC of its last 64 bytes, file size, features of the samples."""
    samples = data[HEADER:]
    if data[:4] != b"RIFF" or data[36:40] != b"data" or int.from_bytes(data[40:44], "little") != len(samples) & 0xFFFFFFFF:
        raise ValueError("not a file that wav() made")
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    total, squares, crossings = int(x.sum(dtype=np.int64)), int((x * x).sum(dtype=np.int64)), int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    feature = f"mean={total / len(x):.6f};rms={(squares / len(x)) ** 0.5:.6f};crossings={crossings}"
    return len(samples), hashlib.sha256(samples).digest(), zlib.crc32(samples[-UNIT:]), len(data), feature


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every row, digests in hex."""
    listed = written(catalog(docs, id_col, text_col), "catalog")
    shared = written(shared_chunks(listed), "shared")
    made = rebuilt(listed, store(docs, shared, text_col), shared)
    hexed = lambda c: F.lower(F.hex(c))
    return listed.select("doc_id", "n_bytes", "object_id").join(made, "object_id").select("doc_id", "n_bytes", "payload_bytes", hexed("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", hexed("object_id").alias("media_sha256"), "feature")
