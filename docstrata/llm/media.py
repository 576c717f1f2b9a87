"""ISO media containers as columns: written, and read back by walking their boxes.

``write_container`` stores a payload as 8-bit mono PCM samples: one container sample holds a fixed
number of bytes, several samples make a chunk, and the first sample of each chunk is a key sample.
``read_container`` knows any file of this family with sample tables: it walks the nested boxes, decodes
the tables of the first track, and says where each sample is, without touching the payload.

Defined results: a null text counts as empty and is stored as blanks; texts of any length are stored whole; a
file that cannot be read, or whose boxes nest deeper than any real file's, gives nulls and an ``error``; equal
texts, and so repeated rows, give equal values; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = 192
RATE = 8000
PER_CHUNK = 16
# Boxes that hold other boxes.
NESTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta")
# A track's tables are six boxes deep.
DEEPEST = 32
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def write_container(payload: bytes, unit: int = UNIT, per_chunk: int = PER_CHUNK, rate: int = RATE) -> bytes:
    """The payload's length must be a positive multiple of ``unit``."""
    n, rest = divmod(len(payload), unit)
    if rest or not n:
        raise ValueError(f"{len(payload)} bytes are not a positive multiple of {unit}")
    chunks, last, ticks = -(-n // per_chunk), n % per_chunk, n * unit
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, rate << 16))
    runs = [(1, per_chunk, 1)] if not last else [(1, last, 1)] if chunks == 1 else [(1, per_chunk, 1), (chunks, last, 1)]
    keys = range(1, n + 1, per_chunk)

    def head(first: int) -> bytes:
        offsets = [first + i * per_chunk * unit for i in range(chunks)]
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, unit)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", unit, n)),
            full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, ticks & 0xFFFFFFFF, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, ticks & 0xFFFFFFFF, 0, 0, 0x100, 0), MATRIX, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, rate, ticks & 0xFFFFFFFF, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"qt  ") + box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    wide = len(payload) + 8 >= 1 << 32
    front = len(head(0)) + (16 if wide else 8)
    data = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return head(front) + data + payload


def walk(data: bytes, begin: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, begin, end) of the content of every box, nested ones after the one that holds them; boxes may nest ``DEEPEST`` deep."""
    open_ = [((), begin, len(data) if end is None else end)]
    while open_:
        path, begin, end = open_.pop()
        if begin + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if begin + 16 > end:
                raise ValueError("a box ends early")
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        if len(path) >= DEEPEST:
            raise ValueError(f"boxes nest more than {DEEPEST} deep")
        inner = (*path, kind)
        yield inner, begin + head, begin + size
        open_.append((path, begin + size, end))
        if kind in NESTS:
            open_.append((inner, begin + head, begin + size))


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    sizes: list[int]
    offsets: list[int]
    times: list[int]
    keys: list[int]  # sample numbers from 0

    @property
    def key_ranges(self) -> list[tuple[int, int]]:
        return [(self.offsets[k], self.sizes[k]) for k in self.keys]


def read_container(data: bytes) -> Track:
    """The first track with a sample table. Raises ValueError if the boxes do not make sense."""
    try:
        return _read(data)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"sample tables: {e}") from e


def _read(data: bytes) -> Track:
    found: dict[bytes, tuple[int, int]] = {}
    for path, begin, end in walk(data):
        if path == (b"moov", b"trak") and b"stbl" in found:
            break
        if path[:2] == (b"moov", b"trak"):
            found.setdefault(path[-1], (begin, end))
    numbers = lambda kind, skip, form: struct.unpack_from(form, data, found[kind][0] + skip)
    wide = data[found[b"mdhd"][0]] == 1
    timescale, _ = numbers(b"mdhd", 20 if wide else 12, ">IQ" if wide else ">II")
    codec = numbers(b"stsd", 12, ">4s")[0].decode("latin-1")
    same, n = numbers(b"stsz", 4, ">II")
    if n > len(data):
        raise ValueError("more samples than bytes")
    sizes = [same] * n if same else list(numbers(b"stsz", 12, f">{n}I"))
    times = []
    for i in range(numbers(b"stts", 4, ">I")[0]):
        count, delta = numbers(b"stts", 8 + 8 * i, ">II")
        if len(times) + count > n:
            raise ValueError("more times than samples")
        times += [delta] * count
    kind, form = (b"co64", "Q") if b"co64" in found else (b"stco", "I")
    chunks = numbers(kind, 8, f">{numbers(kind, 4, '>I')[0]}{form}")
    runs = [numbers(b"stsc", 8 + 12 * i, ">III") for i in range(numbers(b"stsc", 4, ">I")[0])]
    offsets: list[int] = []
    for (first, per, _), after in zip(runs, [*(r[0] for r in runs[1:]), len(chunks) + 1]):
        for c in range(first - 1, after - 1):
            at = chunks[c]
            for size in sizes[len(offsets) : len(offsets) + per]:
                offsets.append(at)
                at += size
    keys = [k - 1 for k in numbers(b"stss", 8, f">{numbers(b'stss', 4, '>I')[0]}I")] if b"stss" in found else list(range(n))
    if len(offsets) != n or len(times) != n or any(a + s > len(data) for a, s in zip(offsets, sizes)) or any(not 0 <= k < n for k in keys):
        raise ValueError("sample tables do not agree")
    return Track(codec, timescale, sum(times), sizes, offsets, times, keys)


def payload_of(data: bytes, track: Track) -> bytes:
    return b"".join(data[a : a + s] for a, s in zip(track.offsets, track.sizes))


MEDIA_SCHEMA = "codec:string,timescale:long,duration:long,n_samples:long,key_ranges:array<struct<offset:long,length:long>>,error:string"


def store_texts(docs: DataFrame, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 text, filled up with blanks to a multiple of ``unit``, as a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                files.append(write_container(data.ljust(max(1, -(-len(data) // unit)) * unit, b" "), unit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_columns(files: DataFrame, media_col: str = "media", payload: bool = False) -> DataFrame:
    """The columns of ``files`` but the media itself, and a struct ``track`` of what the boxes say.

    With ``payload``, the struct also has the sample bytes' length, SHA-256 and the CRC of the last 16, and the file's length
    and SHA-256.
    """
    rest = [c for c in files.columns if c != media_col]
    extra = ",media_bytes:long,media_sha256:string,payload_bytes:long,payload_sha256:string,tail_crc32:long" if payload else ""

    def one(data: bytes | None) -> dict:
        out: dict = {"error": None}
        try:
            if data is None:
                raise ValueError("no file")
            if payload:
                out |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
            t = read_container(data)
            out |= {"codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "key_ranges": [{"offset": a, "length": s} for a, s in t.key_ranges]}
            if payload:
                back = payload_of(data, t)
                out |= {"payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:])}
        except ValueError as e:
            out["error"] = str(e)
        return out

    kind = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("key_ranges", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("error", pa.string()), *([("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())] if payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tracks = pa.array([one(v.as_py()) for v in batch.column(media_col)], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), tracks], names=[*rest, "track"])

    schema = T.StructType([*(files.schema[c] for c in rest), *T._parse_datatype_string(f"track struct<{MEDIA_SCHEMA}{extra}>")])
    return files.mapInArrow(run, schema)


def text_media_report(docs: DataFrame, **options) -> DataFrame:
    """Texts stored as containers and read back: digests of payload and file, and a feature string."""
    track = media_columns(store_texts(docs, **options), payload=True)
    ranges = F.array_join(F.transform("track.key_ranges", lambda r: F.concat_ws("+", r["offset"], r["length"])), ",")
    feature = F.concat_ws(";", F.concat(F.lit("codec="), F.trim("track.codec")), F.concat(F.lit("timescale="), F.col("track.timescale")), F.concat(F.lit("duration="), F.col("track.duration")), F.concat(F.lit("samples="), F.col("track.n_samples")), F.concat(F.lit("keys="), ranges))
    return track.select("doc_id", "n_bytes", *(F.col(f"track.{c}").alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")), feature.alias("feature"))
