"""Text payloads as ISO base media files, and their columns read back.

The writer stores a payload losslessly as uncompressed 8-bit grey frames of
24 x 24 samples (576 bytes) in a file of nested boxes: ftyp, moov with one video
track and its sample tables, mdat. The reader is general: it walks the boxes, decodes each
track's sample tables (32 and 64 bit, compact sizes, both versions of the header) and the runs
of movie fragments, and derives codec, duration and the byte ranges of the key frames
from them alone; only `payload()` touches sample bytes.

Defined cases: null and empty texts become one frame of padding; equal texts give
equal files (no clock, no ids inside); of several tracks the first video track is
described, without one the first; a file whose boxes or tables are cut short raises
ValueError. An empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from tidemark.llm.common import spans_of_rows, texts

#: Fixed values of the format used: frame side, bytes a frame, ticks a second, ticks a frame, frames from one key frame to the next, samples a chunk.
SIDE, FRAME, TIMESCALE, DELTA, KEY_EVERY, PER_CHUNK = 24, 576, 600, 24, 12, 16
#: Levels of boxes; the deepest that the format needs is six.
MOST_NESTED = 32
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of FRAME."""
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    """A box with version 0 and flags."""
    return box(kind, struct.pack(">I", flags), *parts)


def mux(payload: bytes) -> bytes:
    """The file that holds payload, whose length is a positive multiple of FRAME."""
    n = len(payload) // FRAME
    if n < 1 or n * FRAME != len(payload):
        raise ValueError("the payload isn't made of whole frames")
    chunks = -(-n // PER_CHUNK)
    duration = n * DELTA
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = ([(1, PER_CHUNK)] if n >= PER_CHUNK else []) + ([(chunks, n % PER_CHUNK)] if n % PER_CHUNK else [])
    keys = range(1, n + 1, KEY_EVERY)

    def moov(base: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, DELTA)),
            full(b"stss", 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", first, per, 1) for first, per in runs)),
            full(b"stsz", 0, struct.pack(">II", FRAME, n)),
            full(b"co64", 0, struct.pack(f">I{chunks}Q", chunks, *range(base, base + chunks * PER_CHUNK * FRAME, PER_CHUNK * FRAME))),
        )
        minf = box(b"minf", full(b"vmhd", 1, bytes(8)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)), full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"text\0"), minf)
        tkhd = full(b"tkhd", 7, struct.pack(">IIIII", 0, 0, 1, 0, duration), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16))
        mvhd = full(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, TIMESCALE, duration, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    long = len(payload) + 8 > 0xFFFFFFFF
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    size = len(moov(0))
    return ftyp + moov(len(ftyp) + size + len(head)) + head + payload


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, body start, body end) of every box, parents first; boxes may be nested to MOST_NESTED."""
    outer: list[tuple[int, int, tuple[bytes, ...]]] = [(start, len(data) if end is None else end, path)]
    while outer:
        start, end, path = outer.pop()
        if start == end:
            continue
        if end - start < 8:
            raise ValueError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError("a box is longer than what holds it")
        yield (*path, kind), body, start + size
        outer.append((start + size, end, path))
        if kind in NESTED:
            if len(path) >= MOST_NESTED:
                raise ValueError("boxes are nested too deeply")
            outer.append((body, start + size, (*path, kind)))


@dataclass
class Track:
    codec: str
    width: int
    height: int
    timescale: int
    duration: int
    offsets: list[int]
    sizes: list[int]
    keys: list[int]  # indices of key frames
    kind: str = "vide"

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def key_ranges(self) -> list[tuple[int, int]]:
        """Byte ranges of the key frames, end not included."""
        return [(self.offsets[i], self.offsets[i] + self.sizes[i]) for i in self.keys]

    def feature(self) -> str:
        ranges = ",".join(f"{a}-{b}" for a, b in self.key_ranges())
        return f"codec={self.codec.strip()};size={self.width}x{self.height};duration_ms={1000 * self.duration // max(1, self.timescale)};samples={len(self.sizes)};keyframes={len(self.keys)};ranges={ranges}"


class Reader:
    """The fields of one box, in order."""

    def __init__(self, data: bytes, start: int, end: int) -> None:
        self.data, self.at, self.end = data, start, end

    def take(self, layout: str) -> tuple:
        size = struct.calcsize(f">{layout}")
        if self.at + size > self.end:
            raise ValueError("a box is cut short")
        out = struct.unpack_from(f">{layout}", self.data, self.at)
        self.at += size
        return out

    def table(self, layout: str) -> list[tuple]:
        """Entries behind their count, in a box with version and flags."""
        _, n = self.take("II")
        return self.many(layout, n)

    def many(self, layout: str, n: int) -> list[tuple]:
        size = n * struct.calcsize(f">{layout}")
        if self.at + size > self.end:
            raise ValueError("a sample table is cut short")
        self.at += size
        return list(struct.iter_unpack(f">{layout}", self.data[self.at - size : self.at]))


def _sizes(boxes: dict[bytes, tuple[int, int]], data: bytes) -> list[int]:
    if b"stsz" in boxes:
        r = Reader(data, *boxes[b"stsz"])
        _, uniform, n = r.take("III")
        return [uniform] * n if uniform else [x for (x,) in r.many("I", n)]
    r = Reader(data, *boxes[b"stz2"])
    _, bits, n = r.take("III")
    if bits == 4:  # two in a byte, the first in its upper half
        return [x for (byte,) in r.many("B", -(-n // 2)) for x in (byte >> 4, byte & 15)][:n]
    return [x for (x,) in r.many("B" if bits == 8 else "H", n)]


def _header(boxes: dict[bytes, tuple[int, int]], data: bytes) -> tuple[int, int]:
    """Ticks a second and the stated duration."""
    r = Reader(data, *boxes[b"mdhd"])
    version = r.take("I")[0] >> 24
    return r.take("QQIQ")[2:] if version == 1 else r.take("IIII")[2:]


def _described(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    """A track from the boxes of its trak box."""
    for need in ((b"stsd",), (b"stts",), (b"stsc",), (b"stsz", b"stz2"), (b"stco", b"co64"), (b"mdhd",)):
        if not any(x in boxes for x in need):
            raise ValueError(f"no {need[0].decode()} box")
    kind = data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12].decode("latin-1") if b"hdlr" in boxes else ""
    entry = Reader(data, *boxes[b"stsd"])
    _, _, _, codec = entry.take("III4s")
    width = height = 0
    if kind in ("vide", ""):
        entry.take("24s")
        width, height = entry.take("HH")
    timescale, stated = _header(boxes, data)
    sizes = _sizes(boxes, data)
    chunks = [x[0] for x in Reader(data, *boxes[b"co64"]).table("Q")] if b"co64" in boxes else [x[0] for x in Reader(data, *boxes[b"stco"]).table("I")]
    runs = Reader(data, *boxes[b"stsc"]).table("III")
    offsets: list[int] = []
    for i, (first, per, _) in enumerate(runs):
        until = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
        for where in chunks[first - 1 : until - 1]:
            for size in sizes[len(offsets) : len(offsets) + per]:
                offsets.append(where)
                where += size
    if len(offsets) != len(sizes):
        raise ValueError("the chunks don't hold all samples")
    keys = [k[0] - 1 for k in Reader(data, *boxes[b"stss"]).table("I")] if b"stss" in boxes else list(range(len(sizes)))
    duration = sum(count * delta for count, delta in Reader(data, *boxes[b"stts"]).table("II"))
    return Track(codec.decode("latin-1"), width, height, timescale, duration or (stated if sizes else 0), offsets, sizes, keys, kind)


def _fragment(data: bytes, base: int, inside: list[tuple[bytes, int, int]], tracks: dict[int, Track], defaults: dict[int, tuple[int, int, int]]) -> None:
    """Adds the samples of one traf box (its boxes) to its track. base: where the moof box begins."""
    header = next((x for x in inside if x[0] == b"tfhd"), None)
    if not header:
        raise ValueError("no tfhd box")
    r = Reader(data, *header[1:])
    flags, who = r.take("II")
    track, usual = tracks.get(who), list(defaults.get(who, (0, 0, 0)))
    if track is None:
        return
    if flags & 0x1:
        (base,) = r.take("Q")
    if flags & 0x2:
        r.take("I")
    for i, bit in enumerate((0x8, 0x10, 0x20)):  # duration, size, flags of samples
        if flags & bit:
            (usual[i],) = r.take("I")
    where = base
    for kind, a, b in inside:
        if kind != b"trun":
            continue
        r = Reader(data, a, b)
        own, n = r.take("II")
        if own & 0x1:
            where = base + r.take("i")[0]
        first = r.take("I")[0] if own & 0x4 else None
        for i in range(n):
            duration, size, mark = (r.take("I")[0] if own & bit else usual[j] for j, bit in enumerate((0x100, 0x200, 0x400)))
            if own & 0x800:
                r.take("I")
            mark = first if i == 0 and first is not None else mark
            if not mark & 0x10000:  # not a sample that needs others
                track.keys.append(len(track.sizes))
            track.offsets.append(where)
            track.sizes.append(size)
            track.duration += duration
            where += size


def tracks(data: bytes) -> list[Track]:
    """All tracks, in the order of the file, with the samples of movie fragments."""
    top = list(walk(data))
    found: dict[int, Track] = {}
    for path, a, b in top:
        if path == (b"moov", b"trak"):
            boxes = {p[-1]: (x, y) for p, x, y in walk(data, a, b)}
            version = data[boxes[b"tkhd"][0]] if b"tkhd" in boxes else 0
            who = Reader(data, boxes[b"tkhd"][0] + (20 if version else 12), boxes[b"tkhd"][1]).take("I")[0] if b"tkhd" in boxes else len(found) + 1
            found[who] = _described(data, boxes)
    usual = {}
    for path, a, b in top:
        if path == (b"moov", b"mvex", b"trex"):
            _, who, _, *rest = Reader(data, a, b).take("IIIIII")
            usual[who] = tuple(rest)
    base = 0
    for path, a, b in top:
        if path == (b"moof",):
            base = a - 8
        elif path == (b"moof", b"traf"):
            _fragment(data, base, [(p[-1], x, y) for p, x, y in walk(data, a, b)], found, usual)
    return list(found.values())


def demux(data: bytes) -> Track:
    """The first video track, or the first of any kind."""
    all_ = tracks(data)
    if not all_:
        raise ValueError("no trak box")
    return next((x for x in all_ if x.kind == "vide"), all_[0])


def payload(data: bytes, track: Track) -> bytes:
    """All samples in order."""
    view = memoryview(data)
    parts, i, n = [], 0, len(track.sizes)
    while i < n:  # neighbouring samples in one piece
        a = b = track.offsets[i]
        while i < n and track.offsets[i] == b:
            b += track.sizes[i]
            i += 1
        parts.append(view[a:b])
    return b"".join(parts)


def store(docs, key: str = "doc_id", text: str = "text"):
    """A row for each of docs: key, n_bytes (of the text) and media, the file."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            _, offsets = texts(batch.column(1))
            for i, j in spans_of_rows(offsets):
                part = [(x or "").encode() for x in batch.column(1).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array(map(len, part), pa.int64()), pa.array([mux(pad(x)) for x in part], pa.binary())], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)
