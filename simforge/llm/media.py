"""ISO base media files: boxes, sample tables and keyframe byte ranges, read without decoding payloads.

`probe` walks the nested boxes of a file held as bytes and gives one record per track: handler, codec, time scale,
duration, sample count and the byte ranges of all samples and of the keyframes; samples of movie fragments follow those of
the movie's own tables.  `store_pcm` writes bytes as the 8-bit samples of a file with one raw-audio track, and `payload`
reads them back through the sample table.

Defined results: a null or empty file has no tracks and the error "empty"; a file whose boxes or tables are cut off or
contradict themselves keeps the tracks before the fault and names it in `error`; boxes of unknown types are skipped, and
boxes may be nested to any depth; without a sync-sample box each sample is a keyframe; of a file without samples the payload
is the error "no samples"; very large files stand alone in a block; an empty table gives no rows; repeated rows are each
probed; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm.common import chunks, fresh, table

#: Boxes that hold boxes, as the format has them.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
UNIT = 576
CHUNK = 8
RATE = 8000
TRACK = "struct<track_id:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,seconds:double,n_samples:bigint,n_keyframes:bigint,keyframes:array<struct<start:bigint,size:bigint>>>"


class Fault(ValueError):
    """What is wrong with a file."""


def boxes(data, start: int, end: int):
    """(type, start of the contents, end) of each box between start and end."""
    while start < end:
        if end - start < 8:
            raise Fault("box header cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Fault("box header cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise Fault(f"box {kind.decode('latin-1')} overruns its parent")
        yield kind, start + head, start + size
        start += size


def _numbers(data, start: int, end: int, kind: str, columns: int, count: int) -> np.ndarray:
    dtype = np.dtype(kind)
    if start + count * columns * dtype.itemsize > end:
        raise Fault("table cut off")
    return np.frombuffer(data, dtype=dtype, count=count * columns, offset=start).astype(np.int64).reshape(count, columns)


def _small_numbers(data, start: int, end: int, bits: int, count: int) -> np.ndarray:
    """Numbers of 4, 8 or 16 bits."""
    if bits not in (4, 8, 16):
        raise Fault("field size out of range")
    if bits > 4:
        return _numbers(data, start, end, ">u1" if bits == 8 else ">u2", 1, count)[:, 0]
    both = _numbers(data, start, end, ">u1", 1, -(-count // 2))[:, 0]
    return np.stack([both >> 4, both & 15], axis=1).reshape(-1)[:count]


def _full(data, start: int, end: int, n: int) -> tuple:
    """Version and the first n 32-bit fields of a full box."""
    if end - start < 4 + 4 * n:
        raise Fault("box cut off")
    return (data[start], *struct.unpack_from(f">{n}I", data, start + 4))


def _times(data, start: int, end: int, skip: int) -> tuple[int, int]:
    """Time scale and duration of mdhd or mvhd; skip: fields between the dates and the time scale."""
    version = _full(data, start, end, 1)[0]
    at = start + 4 + (16 if version == 1 else 8) + skip
    if at + (12 if version == 1 else 8) > end:
        raise Fault("box cut off")
    return struct.unpack_from(">IQ" if version == 1 else ">II", data, at)


def _track(data, start: int, end: int) -> dict:
    """What the boxes of one trak say."""
    t: dict = {"track_id": None, "handler": None, "codec": None, "timescale": None, "duration": None}
    inside = [boxes(data, start, end)]
    while inside:
        for kind, s, e in inside[-1]:
            if kind in CONTAINERS:
                inside.append(boxes(data, s, e))
                break
            elif kind == b"tkhd":
                version = _full(data, s, e, 1)[0]
                t["track_id"] = _full(data, s, e, 5 if version == 1 else 3)[-1]
            elif kind == b"mdhd":
                t["timescale"], t["duration"] = _times(data, s, e, 0)
            elif kind == b"hdlr":
                _full(data, s, e, 2)
                t["handler"] = bytes(data[s + 8 : s + 12]).decode("latin-1")
            elif kind == b"stsd":
                if _full(data, s, e, 1)[1]:
                    t["codec"] = next(boxes(data, s + 8, e))[0].decode("latin-1")
            elif kind == b"stts":
                t["stts"] = _numbers(data, s + 8, e, ">u4", 2, _full(data, s, e, 1)[1])
            elif kind == b"stss":
                t["stss"] = _numbers(data, s + 8, e, ">u4", 1, _full(data, s, e, 1)[1])[:, 0]
            elif kind == b"stsc":
                t["stsc"] = _numbers(data, s + 8, e, ">u4", 3, _full(data, s, e, 1)[1])
            elif kind == b"stsz":
                _, size, count = _full(data, s, e, 2)
                if size * count > len(data):
                    raise Fault("samples beyond the end of the file")
                t["sizes"] = np.full(count, size, dtype=np.int64) if size else _numbers(data, s + 12, e, ">u4", 1, count)[:, 0]
            elif kind == b"stz2":
                _, bits, count = _full(data, s, e, 2)
                t["sizes"] = _small_numbers(data, s + 12, e, bits & 0xFF, count)
            elif kind in (b"stco", b"co64"):
                t["chunks"] = _numbers(data, s + 8, e, ">u4" if kind == b"stco" else ">u8", 1, _full(data, s, e, 1)[1])[:, 0]
        else:
            inside.pop()
    return t


def _places(t: dict, size: int) -> np.ndarray:
    """Start of each sample."""
    sizes, at, runs = t.get("sizes"), t.get("chunks"), t.get("stsc")
    if sizes is None or not len(sizes):
        return np.zeros(0, dtype=np.int64)
    if at is None or runs is None or not len(runs) or not len(at):
        raise Fault("sample table incomplete")
    if runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(at):
        raise Fault("sample-to-chunk table out of order")
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(at) + 1)))
    if int(each.sum()) < len(sizes):
        raise Fault("more samples than chunks hold")
    chunk = np.searchsorted(np.cumsum(each), np.arange(len(sizes)), side="right")
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first = np.searchsorted(chunk, np.arange(len(at)))
    start = at[chunk] + before - before[np.minimum(first, len(sizes) - 1)][chunk]
    _inside(start, sizes, size)
    return start


def _inside(start: np.ndarray, sizes: np.ndarray, size: int) -> None:
    if len(start) and ((start < 0) | (start + sizes > size)).any():
        raise Fault("samples beyond the end of the file")


class _Fields:
    """Reads the fields of a box one after the other."""

    def __init__(self, data, start: int, end: int):
        self.data, self.at, self.end = data, start, end

    def take(self, kind: str) -> int:
        width = struct.calcsize(kind)
        if self.at + width > self.end:
            raise Fault("box cut off")
        self.at += width
        return struct.unpack_from(kind, self.data, self.at - width)[0]

    def maybe(self, there: int, kind: str, otherwise=None):
        return self.take(kind) if there else otherwise


def _fragment(data, moof: int, start: int, end: int, known: dict[int, dict], defaults: dict[int, tuple]) -> None:
    """Adds the samples of a movie fragment to its tracks.  Sample flags without the non-sync bit make a keyframe."""
    data_end = None
    for kind, a, b in boxes(data, start, end):
        if kind != b"traf":
            continue
        t, base, given, at = None, moof, (0, 0, 0), None
        for inner, s, e in boxes(data, a, b):
            f = _Fields(data, s, e)
            if inner == b"tfhd":
                flags = f.take(">I") & 0xFFFFFF
                track = f.take(">I")
                if (t := known.get(track)) is None:
                    raise Fault("fragment of an unknown track")
                base = f.maybe(flags & 1, ">Q", moof if flags & 0x20000 or data_end is None else data_end)
                f.maybe(flags & 2, ">I")
                d = defaults.get(track, (0, 0, 0))
                given = tuple(f.maybe(flags & bit, ">I", x) for bit, x in zip((8, 16, 32), d))
                at = base
            elif inner == b"trun":
                if t is None:
                    raise Fault("run before its header")
                flags, n = f.take(">I") & 0xFFFFFF, f.take(">I")
                offset = f.maybe(flags & 1, ">i")
                at = at if offset is None else base + offset
                first = f.maybe(flags & 4, ">I")
                per = [flags & bit for bit in (0x100, 0x200, 0x400, 0x800)]
                width = sum(map(bool, per))
                if not width and n * max(1, given[1]) > len(data):
                    raise Fault("samples beyond the end of the file")
                rows = _numbers(data, f.at, e, ">u4", width, n) if width else np.zeros((n, 0), np.int64)
                columns = iter(rows.T)
                duration, size, mark = (next(columns) if there else np.full(n, x, dtype=np.int64) for there, x in zip(per, given))
                if first is not None and n:
                    mark = np.append(first, mark[1:])
                starts = at + np.cumsum(size) - size
                _inside(starts, size, len(data))
                t["sync"] = np.append(t["sync"], len(t["starts"]) + np.flatnonzero(mark & 0x10000 == 0))
                t["starts"], t["sizes"] = np.append(t["starts"], starts), np.append(t["sizes"], size)
                t["duration"] = (t["duration"] or 0) + int(duration.sum())
                at = data_end = at + int(size.sum())


def tracks(data) -> tuple[list[dict], str | None]:
    """All tracks, with arrays `starts`, `sizes` and `sync` (indices of keyframes); and what stopped the walk, if something did."""
    found: list[dict] = []
    if not data:
        return found, "empty"
    view = memoryview(data)
    known: dict[int, dict] = {}
    defaults: dict[int, tuple] = {}
    try:
        for kind, s, e in boxes(view, 0, len(view)):
            if kind == b"moof":
                _fragment(view, s - 8, s, e, known, defaults)
            if kind != b"moov":
                continue
            for inner, a, b in boxes(view, s, e):
                if inner == b"mvex":
                    for x, c, _ in boxes(view, a, b):
                        if x == b"trex":
                            _, track, _, *rest = _full(view, c, b, 5)
                            defaults[track] = tuple(rest)
                if inner != b"trak":
                    continue
                t = _track(view, a, b)
                t["starts"] = _places(t, len(view))
                n = len(t["starts"])
                t["sizes"] = t.get("sizes", np.zeros(0, np.int64))
                t["sync"] = np.arange(n) if t.get("stss") is None else t["stss"] - 1
                if len(t["sync"]) and (t["sync"].min() < 0 or t["sync"].max() >= n):
                    raise Fault("keyframe number out of range")
                if t["duration"] in (None, 0) and "stts" in t:
                    t["duration"] = int((t["stts"][:, 0] * t["stts"][:, 1]).sum())
                found.append(t)
                known[t["track_id"]] = t
    except Fault as fault:
        return found, str(fault)
    except (struct.error, StopIteration):
        return found, "box cut off"
    return found, None


def _record(t: dict) -> dict:
    starts, sizes, sync = t["starts"], t["sizes"], t["sync"]
    return {k: t[k] for k in ("track_id", "handler", "codec", "timescale", "duration")} | {
        "seconds": t["duration"] / t["timescale"] if t["timescale"] and t["duration"] is not None else None,
        "n_samples": len(starts),
        "n_keyframes": len(sync),
        "keyframes": [{"start": int(starts[i]), "size": int(sizes[i])} for i in sync],
    }


def _box(kind: bytes, *parts: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def _full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store_pcm(payload: bytes, unit: int = UNIT, rate: int = RATE, chunk: int = CHUNK) -> bytes:
    """A file with one track of raw 8-bit audio: a sample of the table is a unit of bytes, and a chunk holds some of them.

    payload has a positive multiple of unit bytes.  The first sample of each chunk counts as a keyframe.
    """
    n = len(payload) // unit
    n_chunks = -(-n // chunk)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    runs = [(1, chunk, 1)] if n % chunk == 0 else ([(1, chunk, 1)] if n > chunk else []) + [(n_chunks, n % chunk, 1)]

    def moov(at: int) -> bytes:
        wide = at + len(payload) >= 1 << 32
        offsets = at + np.arange(n_chunks, dtype=np.int64) * (chunk * unit)
        sync = 1 + np.arange(n_chunks, dtype=np.int64) * chunk
        stbl = _box(
            b"stbl",
            _full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            _full_box(b"stts", 0, 0, struct.pack(">III", 1, n, unit)),
            _full_box(b"stss", 0, 0, struct.pack(">I", n_chunks), sync.astype(">u4").tobytes()),
            _full_box(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full_box(b"stsz", 0, 0, struct.pack(">II", unit, n)),
            _full_box(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", n_chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        duration = len(payload)
        dinf = _box(b"dinf", _full_box(b"dref", 0, 0, struct.pack(">I", 1), _full_box(b"url ", 0, 1)))
        minf = _box(b"minf", _full_box(b"smhd", 0, 0, bytes(4)), dinf, stbl)
        mdia = _box(b"mdia", _full_box(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, rate, duration, 0x55C4, 0)), _full_box(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = _full_box(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8))
        mvhd = _full_box(b"mvhd", 1, 0, struct.pack(">QQIQ", 0, 0, rate, duration), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    wide_data = len(payload) + 8 >= 1 << 32
    data_head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide_data else struct.pack(">I4s", 8 + len(payload), b"mdat")
    at = len(head) + len(moov(0)) + len(data_head)
    return head + moov(at) + data_head + payload


def payload(data: bytes) -> bytes:
    """All samples of the first track, in order."""
    found, error = tracks(data)
    if error or not found:
        raise Fault(error or "no track")
    t = found[0]
    if not len(t["starts"]):
        raise Fault("no samples")
    starts, ends = t["starts"], t["starts"] + t["sizes"]
    cut = np.flatnonzero(starts[1:] != ends[:-1])
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in zip(starts[np.append(0, cut + 1)], ends[np.append(cut, len(ends) - 1)]))


def padded(text: bytes, unit: int = UNIT) -> bytes:
    n = max(unit, -(-len(text) // unit) * unit)
    return text + b"\xff" * (n - len(text))


def _over(docs: DataFrame, col: str, run, kinds: str) -> tuple[DataFrame, list[str]]:
    """docs with the columns that run makes from batches with col as `text`; and the new columns' names."""
    names = [x.split(" ")[0] for x in kinds.split("; ")]
    outs = [fresh(docs, n) for n in names]
    rest = docs.columns
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    whole = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)] + [f"new_{x}" for x in kinds.split("; ")]

    def go(batches):
        for t in chunks(batches, "text", 4 << 20):
            new = run(t.column("text").to_pylist())
            t = t.drop_columns(["text"])
            for n, a in zip(names, new):
                t = t.append_column(f"new_{n}", a)
            yield from t.to_batches()

    done = docs.select(*cols, F.col(f"`{col}`").cast("binary").alias("text")).mapInArrow(go, ", ".join(whole))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *[F.col(f"new_{n}").alias(o) for n, o in zip(names, outs)]), outs


def probe(files: DataFrame, content_col: str) -> DataFrame:
    """files with `tracks` (an array of records) and `error`."""
    record = pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))])

    def run(contents):
        both = [tracks(c) for c in contents]
        return pa.array([[_record(t) for t in x] for x, _ in both], pa.list_(record)), pa.array([e for _, e in both], pa.string())

    return _over(files, content_col, run, f"tracks array<{TRACK}>; error string")[0]


def media_of_texts(docs: DataFrame, text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """docs with `media`: each whole text, padded, as a file with one track of raw audio."""

    def run(texts):
        return (pa.array([store_pcm(padded(t or b"", unit), unit) for t in texts], pa.binary()),)

    return _over(docs, text_col, run, "media binary")[0]


def media_features(files: DataFrame, content_col: str = "media") -> DataFrame:
    """files with figures of the payload read back from the first track, and what the boxes say."""

    def run(contents):
        rows = []
        for data in contents:
            try:
                body = payload(data)
            except Fault as fault:
                rows.append((None, None, None, None, None, f"error={fault}"))
                continue
            r = _record(tracks(data)[0][0])
            keys = hashlib.sha256(b"".join(struct.pack(">QQ", k["start"], k["size"]) for k in r["keyframes"])).hexdigest()[:16]
            feature = f"{r['handler']}/{r['codec']} scale={r['timescale']} duration={r['duration']} samples={r['n_samples']} keyframes={r['n_keyframes']} ranges={keys}"
            rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        return [pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]

    return _over(files, content_col, run, "payload_bytes long; payload_sha256 string; tail_crc32 long; media_bytes long; media_sha256 string; feature string")[0]


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return media_features(media_of_texts(docs).drop("text")).drop("media")


def _oracle() -> str:
    """The stored file written out in SQL, box by box, as hexadecimal; its layout is the format's, and its numbers follow from the number of units."""
    u4 = lambda x: f"lpad(lower(hex(({x})::BIGINT)), 8, '0')"
    u8 = lambda x: f"lpad(lower(hex(({x})::BIGINT)), 16, '0')"
    box = lambda kind, size, *parts: " || ".join([u4(size), f"'{kind.encode().hex()}'", *parts])
    raw = lambda h: f"'{h}'"
    each = lambda count, value, form: f"array_to_string(list_transform(range({count}), lambda i: {form(value)}), '')"
    zeros = lambda n: raw("00" * n)
    matrix = raw("00010000" + "00" * 12 + "00010000" + "00" * 12 + "40000000")
    entry = box("raw ", 36, zeros(6), raw("0001"), zeros(8), raw("0001000800000000"), u4(f"{RATE}::BIGINT << 16"))
    runs = f"CASE WHEN n % {CHUNK} = 0 THEN {u4('1')} || {u4(CHUNK)} || {u4('1')} WHEN n > {CHUNK} THEN {u4('1')} || {u4(CHUNK)} || {u4('1')} || {u4('c')} || {u4(f'n % {CHUNK}')} || {u4('1')} ELSE {u4('1')} || {u4(f'n % {CHUNK}')} || {u4('1')} END"
    stbl = [
        box("stsd", 52, zeros(4), u4("1"), entry), box("stts", 24, zeros(4), u4("1"), u4("n"), u4(UNIT)),
        box("stss", "16 + 4 * c", zeros(4), u4("c"), each("c", f"1 + i * {CHUNK}", u4)), box("stsc", "16 + 12 * r", zeros(4), u4("r"), f"({runs})"),
        box("stsz", 20, zeros(4), u4(UNIT), u4("n")), box("stco", "16 + 4 * c", zeros(4), u4("c"), each("c", f"start + i * {CHUNK * UNIT}", u4)),
    ]
    dinf = box("dinf", 36, box("dref", 28, zeros(4), u4("1"), box("url ", 12, raw("00000001"))))
    minf = box("minf", "stbl + 60", box("smhd", 16, zeros(8)), dinf, box("stbl", "stbl", *stbl))
    mdhd = box("mdhd", 44, raw("01000000"), zeros(16), u4(RATE), u8("bytes"), raw("55c40000"))
    mdia = box("mdia", "stbl + 145", mdhd, box("hdlr", 33, zeros(8), raw(b"soun".hex()), zeros(13)), minf)
    tkhd = box("tkhd", 104, raw("01000007"), zeros(16), u4("1"), zeros(4), u8("bytes"), zeros(8), raw("0000000001000000"), matrix, zeros(8))
    mvhd = box("mvhd", 120, raw("01000000"), zeros(16), u4(RATE), u8("bytes"), raw("0001000001000000"), zeros(8), matrix, zeros(24), u4("2"))
    moov = box("moov", "stbl + 385", mvhd, box("trak", "stbl + 257", tkhd, mdia))
    ftyp = box("ftyp", 24, raw(b"isom".hex()), u4("512"), raw(b"isommp41".hex()))
    step = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(32), lambda i: ('0x' || payload[2 * (bytes - 32 + i) + 1:2 * (bytes - 32 + i) + 2])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: {step})), 4294967295::BIGINT)"
    keys = f"substr(sha256(unhex(array_to_string(list_transform(range(c), lambda i: {u8(f'start + i * {CHUNK * UNIT}')} || {u8(UNIT)}), ''))), 1, 16)"
    return f"""WITH t AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT *, greatest(1, (n_bytes + {UNIT - 1}) // {UNIT}) AS n FROM t),
q AS (SELECT *, n * {UNIT} AS bytes, (n + {CHUNK - 1}) // {CHUNK} AS c, CASE WHEN n % {CHUNK} = 0 OR n < {CHUNK} THEN 1 ELSE 2 END AS r, h || repeat('ff', (n * {UNIT} - n_bytes)::INTEGER) AS payload FROM p),
s AS (SELECT *, 152 + 8 * c + 12 * r AS stbl FROM q), z AS (SELECT *, 24 + stbl + 385 + 8 AS start FROM s),
f AS (SELECT *, unhex({ftyp} || {moov} || {u4("bytes + 8")} || '{b"mdat".hex()}' || payload) AS file FROM z)
SELECT doc_id, n_bytes, bytes AS payload_bytes, sha256(unhex(payload)) AS payload_sha256, {crc} AS tail_crc32, octet_length(file)::BIGINT AS media_bytes, sha256(file) AS media_sha256,
'soun/raw  scale={RATE} duration=' || bytes || ' samples=' || n || ' keyframes=' || c || ' ranges=' || {keys} AS feature FROM f"""


QUERIES = {"op3_media": op3_media}
ORACLE: dict[str, str] = {"op3_media": _oracle()}
