"""Media columns as content-defined chunks: gear-hash cuts, digests deduplicated by joins, verified reconstruction.

A text's payload is cut where a rolling gear hash of its last 32 bytes has zeros in its top bits, so equal stretches of
different payloads are cut alike. Every distinct chunk is stored once, beside the payload that owns it; the other
payloads that have it keep a reference. The ordered chunk lists put the payloads together again.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import in_slices, materialise

UNIT = 576
LEAST, BITS, MOST = 512, 11, 8192


def _gears() -> np.ndarray:
    """256 numbers by a fixed rule: the first four bytes of the sha256 of the byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEARS = _gears()


def cuts(data: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For payloads laid one after the other, up to ``ends``: where each one's chunks end, counted from its start.

    Chunks have LEAST to MOST bytes, but for a last one that may be shorter. LEAST exceeds the hash's 32 bytes, so
    what stands before a payload never matters.
    """
    h = GEARS[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    marks = (np.flatnonzero(h < np.uint32(1 << (32 - BITS))) + 1).tolist()
    out, begin = [], 0
    for end in ends.tolist():
        at, own = begin, []
        while end - at > LEAST:
            k = bisect_left(marks, at + LEAST)
            at = min(marks[k] if k < len(marks) else end, at + MOST, end)
            own.append(at - begin)
        if at < end:
            own.append(end - begin)
        out.append(own)
        begin = end
    return out


def payload(text: str) -> bytes:
    """UTF-8, with bytes 255 up to a positive multiple of UNIT."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _payloads(texts: list[str]):
    """(payload, its chunks) of each text."""
    for a, b in in_slices(texts, 1 << 21):
        data = [payload(t) for t in texts[a:b]]
        whole = b"".join(data)
        for p, own in zip(data, cuts(np.frombuffer(whole, np.uint8), np.cumsum([len(p) for p in data]))):
            yield p, [p[i:j] for i, j in zip([0, *own], own)]


def _index(batches):
    for batch in batches:
        for key, (_, chunks) in zip(batch.column(0).to_pylist(), _payloads(batch.column(1).to_pylist())):
            n = len(chunks)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([key] * n, pa.binary()), "seq": pa.array(range(n), pa.int32()),
                "digest": pa.array([hashlib.sha256(c).digest() for c in chunks], pa.binary()),
            })


def _packed(batches):
    squeeze = zstandard.ZstdCompressor(level=9).compress
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        yield pa.RecordBatch.from_pydict({"key": keys, "packed": pa.array([squeeze(payload(t)) for t in texts], pa.binary())})


STORE = "key binary, own array<binary>, chunk_list array<struct<digest:binary,length:int,owned:boolean,lent:boolean>>"


def _stored(batches):
    """Each payload without the chunks that others own; ``lent`` are those that others have from it."""
    unpack = zstandard.ZstdDecompressor().decompress
    kind = pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("owned", pa.bool_()), ("lent", pa.bool_())])
    for batch in batches:
        keys, own, lists = [], [], []
        for key, packed, foreign, lent in zip(*(batch.column(c).to_pylist() for c in ("key", "packed", "foreign", "lent"))):
            data, gone, given = unpack(packed), set(foreign or ()), set(lent or ())
            (ends,) = cuts(np.frombuffer(data, np.uint8), np.array([len(data)]))
            chunks = [data[i:j] for i, j in zip([0, *ends], ends)]
            keys.append(key)
            own.append([c for k, c in enumerate(chunks) if k not in gone])
            lists.append([{"digest": hashlib.sha256(c).digest(), "length": len(c), "owned": k not in gone, "lent": k in given} for k, c in enumerate(chunks)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.binary())), pa.array(lists, pa.list_(kind))], ["key", "own", "chunk_list"]
        )


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key is the text's sha256; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text.alias("text"))


def write_store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, shared): the payloads of the distinct texts, each with its own chunks and its ordered chunk list; and
    (key, seq, digest, owner, owner_seq) of the chunks that a payload has from another.

    The owner of a chunk is the smallest (key, place) that has it. Digests alone are shuffled to find owners; payloads
    are shuffled once, compressed, and equal ones are dropped before that.
    """
    texts = keyed(docs).select("key", "text")
    index = texts.mapInArrow(_index, "key binary, seq int, digest binary")
    owners = materialise(
        index.groupBy("digest")
        .agg(F.min(F.struct("key", "seq")).alias("first"), F.max(F.struct("key", "seq")).alias("last"))
        .where(F.col("first") != F.col("last"))  # chunks in one place only need no owner
        .select("digest", F.col("first.key").alias("owner"), F.col("first.seq").alias("owner_seq")),
        "owners",
    )
    shared = materialise(
        index.join(owners, "digest").where(~((F.col("key") == F.col("owner")) & (F.col("seq") == F.col("owner_seq")))).distinct(), "shared"
    )
    # a payload's own places, as many at most as it has chunks
    foreign = shared.groupBy("key").agg(F.collect_set("seq").alias("foreign"))
    lent = owners.groupBy(F.col("owner").alias("key")).agg(F.collect_set("owner_seq").alias("lent"))
    payloads = texts.mapInArrow(_packed, "key binary, packed binary").groupBy("key").agg(F.first("packed").alias("packed"))
    return materialise(payloads.join(foreign, "key", "left").join(lent, "key", "left").mapInArrow(_stored, STORE), "store", level=9), shared


READ = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long, n_bytes long"


def _features(data: bytes) -> str:
    """Mean, deviation and entropy of the bytes, and the share of ASCII letters, to four decimals."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p, v = n / n.sum(), np.arange(256)
    mean = float((p * v).sum())
    dev = float(np.sqrt((p * (v - mean) ** 2).sum()))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    letters = float(p[65:91].sum() + p[97:123].sum())
    return f"mean={mean:.4f};dev={dev:.4f};entropy={entropy:.4f};letters={letters:.4f}"


def _read(batches):
    """Puts payloads together from their own chunks and ``others`` (seq, data); a wrong digest or length is an error."""
    for batch in batches:
        out: dict[str, list] = {name.split()[0]: [] for name in READ.split(", ")}
        for key, own, chunk_list, others in zip(*(batch.column(c).to_pylist() for c in ("key", "own", "chunk_list", "others"))):
            mine, given = iter(own), {x["seq"]: x["data"] for x in others or ()}
            chunks = [next(mine) if c["owned"] else given[k] for k, c in enumerate(chunk_list)]
            for c, data in zip(chunk_list, chunks):
                if len(data) != c["length"] or hashlib.sha256(data).digest() != c["digest"]:
                    raise ValueError(f"chunk of {key.hex()} differs from its digest")
            data, media = b"".join(chunks), b"".join(len(c).to_bytes(4, "little") + c for c in chunks)
            text = data.rstrip(b"\xff")  # 255 is no byte of UTF-8
            for name, value in zip(out, (key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), _features(data), len(chunks), len(text))):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "key" else None) for k, v in out.items()})


def read_store(store: DataFrame, shared: DataFrame) -> DataFrame:
    """A row for each distinct text: digests and features of its payload and of its media, the framed chunks.

    Payloads that own all their chunks are read where they lie; only the others are joined with chunks they lack.
    """
    whole = F.forall("chunk_list", lambda c: c["owned"])
    alone = store.where(whole).withColumn("others", F.lit(None).cast("array<struct<seq:int,data:binary>>"))
    chunks = F.zip_with(F.filter("chunk_list", lambda c: c["owned"]), "own", lambda c, data: F.struct(c["digest"].alias("digest"), c["lent"].alias("lent"), data.alias("data")))
    held = store.where(F.exists("chunk_list", lambda c: c["lent"])).select(F.inline(F.filter(chunks, lambda c: c["lent"]))).select("digest", "data")
    others = shared.select("key", "seq", "digest").join(held, "digest").groupBy("key").agg(F.collect_list(F.struct("seq", "data")).alias("others"))
    joined = store.where(~whole).join(others, "key", "left")
    columns = ["key", "own", "chunk_list", "others"]
    return alone.select(columns).unionByName(joined.select(columns)).mapInArrow(_read, READ)


def media(docs: DataFrame) -> DataFrame:
    """Per document: its stored payload, read back.

    Null texts are empty (a payload of 576 bytes); null and repeated doc_ids keep their rows; equal texts share one
    stored payload and have equal values; other columns are ignored; an empty table gives no rows.
    """
    store, shared = write_store(docs)
    read = materialise(read_store(store, shared), "media")
    return keyed(docs).select("doc_id", "key").join(read, "key").drop("key")
