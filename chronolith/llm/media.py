"""Media columns: ISO base media containers, written to a table, read from it, and walked without decoding payloads.

Defined results: a null text is an empty payload, padded to 64 zero bytes; repeated rows give equal rows; an empty table
gives no rows; columns besides the named id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import Workspace, ship

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
RATE, SAMPLE, SYNC = 8000, 64, 16
#: Bytes of containers of a batch, or one container.
CHUNK = 1 << 23
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)
    return head + b"".join(parts)


def full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes, unit: int = SAMPLE) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return payload + bytes(max(unit, -(-len(payload) // unit) * unit) - len(payload))


def mux(payload: bytes, rate: int = RATE, sample: int = SAMPLE, sync: int = SYNC) -> bytes:
    """One audio track of unsigned 8-bit mono samples ('raw '), `sample` bytes a chunk-resident access unit, every
    `sync`-th of them a sync sample. The payload's length is a positive multiple of `sample`."""
    count = len(payload) // sample
    ticks = count * sample
    v0 = ticks < 1 << 32
    when = lambda: struct.pack(">III" + ("I" if v0 else "Q"), 0, 0, rate, ticks)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, min(rate, 65535) << 16))
    keys = range(1, count + 1, sync)

    def moov(at: int) -> bytes:
        wide = at + len(payload) >= 1 << 32
        offset = full(b"co64", 0, struct.pack(">IQ", 1, at)) if wide else full(b"stco", 0, struct.pack(">II", 1, at))
        stbl = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, count, sample)),
            full(b"stsc", 0, struct.pack(">IIII", 1, 1, count, 1)),
            full(b"stsz", 0, struct.pack(">II", sample, count)),
            offset,
            full(b"stss", 0, struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
        )
        version = 0 if v0 else 1 << 24
        head = when() if v0 else struct.pack(">QQIQ", 0, 0, rate, ticks)
        tk = struct.pack(">IIIII", 0, 0, 1, 0, ticks) if v0 else struct.pack(">QQIIQ", 0, 0, 1, 0, ticks)
        mdia = box(
            b"mdia",
            full(b"mdhd", version, head, struct.pack(">HH", 0x55C4, 0)),
            full(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"\0"),
            box(b"minf", full(b"smhd", 0, bytes(4)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), stbl),
        )
        trak = box(b"trak", full(b"tkhd", version | 7, tk, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8)), mdia)
        mvhd = full(b"mvhd", version, head, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, trak)

    body = 8 if len(payload) + 8 < 1 << 32 else 16
    at = 0
    while (new := len(ftyp) + len(moov(at)) + body) != at:
        at = new
    return ftyp + moov(at) + box(b"mdat", payload)


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """Each box's path of types, and its content's range; containers are entered, payloads never touched. Bytes that no
    longer form a box end the walk of their level."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1 and at + 16 <= end:
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif n == 0:
            n = end - at
        if n < head or at + n > end:
            return
        yield (*path, kind), at + head, at + n
        if kind in CONTAINERS:
            yield from walk(data, at + head, at + n, (*path, kind))
        at += n


def demux(data: bytes) -> list[dict]:
    """Of each track: codec, timescale, duration, sample sizes, byte ranges of samples and of sync samples, from the
    sample tables alone. Malformed tables raise ValueError."""
    tracks: list[dict] = []
    for path, a, b in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": None, "timescale": 0, "duration": 0, "stsz": [], "stsc": [], "chunks": [], "sync": None})
        if not tracks:
            continue
        t = tracks[-1]
        try:
            if kind == b"mdhd":
                t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
            elif kind == b"stsd":
                t["codec"] = data[a + 12 : a + 16].decode("latin-1")
            elif kind == b"stsz":
                size, n = struct.unpack_from(">II", data, a + 4)
                t["stsz"] = [size] * n if size else list(struct.unpack_from(f">{n}I", data, a + 12))
            elif kind == b"stsc":
                n = struct.unpack_from(">I", data, a + 4)[0]
                t["stsc"] = list(struct.iter_unpack(">III", data[a + 8 : a + 8 + 12 * n]))
            elif kind in (b"stco", b"co64"):
                n = struct.unpack_from(">I", data, a + 4)[0]
                t["chunks"] = list(struct.unpack_from(f">{n}{'I' if kind == b'stco' else 'Q'}", data, a + 8))
            elif kind == b"stss":
                n = struct.unpack_from(">I", data, a + 4)[0]
                t["sync"] = list(struct.unpack_from(f">{n}I", data, a + 8))
        except struct.error as e:
            raise ValueError(f"malformed {kind!r}") from e
    for t in tracks:
        ranges, k = [], 0
        runs = t["stsc"]
        for i, (first, per, _) in enumerate(runs):
            last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(t["chunks"])
            for chunk in range(first, last + 1):
                at = t["chunks"][chunk - 1]
                for _ in range(per):
                    if k >= len(t["stsz"]):
                        break
                    ranges.append((at, at + t["stsz"][k]))
                    at += t["stsz"][k]
                    k += 1
        if k != len(t["stsz"]):
            raise ValueError("sample tables disagree")
        t["samples"] = ranges
        t["keyframes"] = ranges if t["sync"] is None else [ranges[i - 1] for i in t["sync"]]
    return tracks


def read_samples(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track, by its ranges; adjacent ranges are read at once."""
    out, run = [], None
    for a, b in track["samples"]:
        if run and run[1] == a:
            run = (run[0], b)
        else:
            if run:
                out.append(data[run[0] : run[1]])
            run = (a, b)
    if run:
        out.append(data[run[0] : run[1]])
    return b"".join(out)


def feature(data: bytes, track: dict) -> str:
    """codec; timescale; duration; samples; sync samples; digest of the sync byte ranges, which stay in the media column."""
    keys = hashlib.sha1("".join(f"{a}-{b};" for a, b in track["keyframes"]).encode()).hexdigest()[:16]
    return f"codec={track['codec'].strip()};timescale={track['timescale']};duration={track['duration']};samples={len(track['samples'])};keyframes={len(track['keyframes'])};ranges={keys}"


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def write_media(df: DataFrame, id_col: str, text_col: str, ws: Workspace) -> DataFrame:
    """The table (id, n_bytes, media): each text's bytes, padded, as the samples of a container."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            n, out, held = [], [], 0
            at = 0
            for k in range(b.num_rows):
                raw = b.column(1)[k].as_py() or b""
                n.append(len(raw))
                out.append(mux(pad(raw)))
                held += len(out[-1])
                if held > CHUNK or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, k + 1 - at), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["id", "n_bytes", "media"])
                    n, out, held, at = [], [], 0, k + 1

    rows = df.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return ws.save(rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary"), "media")


def read_media(table: DataFrame, keep_media: bool = False) -> DataFrame:
    """Of each row of a table (id, n_bytes, media): codec, duration in seconds, keyframes (the byte ranges [start, end) of
    sync samples within the container), and digests of the container and of the samples stored in it."""
    ship(table.sparkSession)
    fields = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "codec": pa.string(), "duration": pa.float64(), "keyframes": RANGES, "feature": pa.string()}
    ddl = f"id {table.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration double, keyframes array<struct<start:bigint,end:bigint>>, feature string" + ", media binary" * keep_media

    def run(batches):
        for b in batches:
            rows = []
            for media in b.column("media"):
                data = media.as_py()
                track = demux(data)[0]
                back = read_samples(data, track)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLE:]), len(data), hashlib.sha256(data).hexdigest(), track["codec"].strip(), track["duration"] / track["timescale"], [{"start": x, "end": y} for x, y in track["keyframes"]], feature(data, track)))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *cols, *([b.column("media")] if keep_media else [])], ["id", "n_bytes", *fields, *["media"] * keep_media])

    return table.select("id", "n_bytes", "media").mapInArrow(run, ddl)


def media_columns(df: DataFrame, id_col: str, text_col: str, ws: Workspace, keep_media: bool = True) -> DataFrame:
    """One row per row: what is read back from the stored container, and, with keep_media, the container."""
    return read_media(write_media(df, id_col, text_col, ws), keep_media).withColumnRenamed("id", id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_columns(docs, "doc_id", "text", Workspace(spark, "media"), keep_media=False)


QUERIES = {"op5_media_columns": op5}
SQL: dict[str, str] = {}
