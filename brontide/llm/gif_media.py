"""Media columns: GIF images, read and written without any imaging library.

``decode`` reads LZW code streams, applies global and local palettes, interlacing,
transparency and disposal, and yields timed frames; ``encode`` stores bytes as
8-bit samples of grey frames (palette entry i is the grey i), ``WIDTH`` wide and
``ROWS`` high, so that any payload comes back unchanged.

``frames`` turns a column of GIFs into a table of timed frames with colour histograms;
``store`` writes texts as GIFs, reads them back and sums the same histograms up.

Defined cases: null counts as empty; in ``frames`` a null GIF has no row and one that
cannot be read has one row with its error (frames before the fault are kept); the payload is padded with zero bytes to a
positive multiple of 64; equal texts give equal files; a truncated or unknown
stream raises ValueError in ``decode``; repeated rows are stored once each; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_batches

WIDTH, ROWS, DELAY = 64, 128, 10
#: Codes after which the encoder starts a new table.
RESET = 3800
_GREY = bytes(i for v in range(256) for i in (v, v, v))


def _widths(n: int, bits: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, for a minimum code size of ``bits``."""
    after = np.maximum(np.arange(n) + (1 << bits) + 1, 1)
    wide = np.floor(np.log2(after)).astype(np.int64) + 1
    return np.clip(wide, bits + 1, 12)


_NINE = _widths(4200, 8)


def lzw_codes(data: bytes) -> list[list[int]]:
    """The codes of ``data`` in stretches, each with a table of its own."""
    stretches: list[list[int]] = []
    table: dict[int, int] = {}
    out: list[int] = []
    get, add, free = table.get, out.append, 258
    held = data[0]
    for b in data[1:]:
        key = held << 8 | b
        code = get(key)
        if code is not None:
            held = code
            continue
        add(held)
        table[key] = free
        free += 1
        held = b
        if free >= 258 + RESET:
            stretches.append(out)
            table, out = {}, []
            get, add, free = table.get, out.append, 258
    add(held)
    stretches.append(out)
    return stretches


def lzw_encode(data: bytes) -> bytes:
    codes, widths, before = [256], [9], 0
    for own in lzw_codes(data):
        if before:
            codes.append(256)
            widths.append(int(_NINE[before]))
        codes += own
        widths += _NINE[: len(own)].tolist()
        before = len(own)
    codes.append(257)
    widths.append(int(_NINE[before]))
    value, wide = np.array(codes, np.uint16), np.array(widths)
    bits = (value[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) < wide[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """``size`` samples of a code stream with a minimum code size of ``bits``."""
    clear, end = 1 << bits, (1 << bits) + 1
    stream = np.unpackbits(np.frombuffer(data + b"\0\0", np.uint8), bitorder="little")
    widths = _NINE if bits == 8 else _widths(4200, bits)
    at, total, out, made = 0, len(data) * 8, [], 0
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, entry = list(singles), b""
    grow, add = table.append, out.append
    weight = (1 << np.arange(12)).astype(np.int64)
    n = 0
    while at + bits < total and made < size:
        wide = widths[np.minimum(np.arange(n, n + 4100), 4199)]
        places = at + np.concatenate([[0], np.cumsum(wide)])
        k = int(np.searchsorted(places[1:], total, side="right"))
        if not k:
            break
        take = np.arange(12)
        window = stream[np.minimum(places[:k, None] + take, len(stream) - 1)] * (take < wide[:k, None])
        codes = window @ weight
        stop = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stop[0]) if len(stop) else k
        own = codes[:stop].tolist()
        begun = len(out)
        room = max(0, 4096 - len(table) + (not entry))
        for code in own[:room]:  # each adds an entry, but for the first after a clear code
            try:
                new = table[code]
            except IndexError:
                if code != len(table) or not entry:
                    raise ValueError("a code that the table does not have") from None
                new = entry + entry[:1]
            if entry:
                grow(entry + new[:1])
            entry = new
            add(new)
        for code in own[room:]:
            add(table[code])
        made += sum(map(len, out[begun:]))
        n += stop
        at = int(places[stop])
        if stop < k:
            if codes[stop] == end:
                break
            at = int(places[stop + 1])
            table, entry, n = list(singles), b"", 0
            grow = table.append
    got = b"".join(out)
    if len(got) < size:
        raise ValueError("the code stream ends early")
    return got[:size]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    canvas: np.ndarray
    """Height x width x 3 colours of the whole picture while this frame shows."""

    def area(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, background = struct.unpack_from("<HHBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 3), np.uint8)
    delay = disposal = 0
    clear_index = None

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            at += 2
            body = blocks()
            if kind == 0xF9:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                clear_index = body[3] if body[0] & 1 else None
        elif data[at] == 0x2C:
            left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = palette
            if own & 0x80:
                n = 2 << (own & 7)
                colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            bits = data[at]
            at += 1
            index = np.frombuffer(lzw_decode(blocks(), bits, w * h), np.uint8).reshape(h, w)
            if own & 0x40:
                rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(index)
                straight[rows] = index
                index = straight
            if colours is None:
                raise ValueError("no palette")
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            shown = colours[np.minimum(index, len(colours) - 1)]
            area[...] = shown if clear_index is None else np.where((index == clear_index)[..., None], area, shown)
            yield Frame(left, top, w, h, delay, disposal, canvas.copy())
            if disposal == 2:
                area[...] = 0
            elif disposal == 3:
                canvas = before
            delay = disposal = 0
            clear_index = None
        else:
            raise ValueError("an unknown block")


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF of grey frames whose samples are the payload (a positive multiple of ``width``)."""
    high = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, high, 0xF7, 0, 0), _GREY]
    step = width * rows
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4, delay, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8))
        codes = lzw_encode(part)
        out += [bytes([len(codes[k : k + 255])]) + codes[k : k + 255] for k in range(0, len(codes), 255)]
        out.append(b"\0")
    return b"".join(out) + b";"


def histogram(frame: Frame) -> np.ndarray:
    """Samples of a frame's own area in 8 shades each of red, green and blue (3 x 8)."""
    area = frame.area()
    return np.stack([np.bincount(area[..., c].ravel() >> 5, minlength=8) for c in range(3)])


_FRAME = (
    "frame int, left int, top int, width int, height int, delay int, disposal int, samples binary, red array<long>, green array<long>, blue array<long>, error string"
)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32()] * 7 + [pa.binary()] + [pa.list_(pa.int64())] * 3 + [pa.string()]
    names = ["own", *(x.split()[0] for x in _FRAME.split(", "))]

    def made(own: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([own.take(pa.array([0] * len(rows))), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    for batch in batches:
        for i, media in enumerate(batch.column(1).to_pylist()):
            if media is None:
                continue
            own, rows, n = batch.column(0).slice(i, 1), [], 0
            try:
                for f in decode(media):
                    rows.append((n, f.left, f.top, f.width, f.height, f.delay, f.disposal, f.area().tobytes(), *histogram(f).tolist(), None))
                    n += 1
                    if sum(len(r[7]) for r in rows) > 1 << 24:  # the canvases of one GIF can be many
                        yield made(own, rows)
                        rows = []
            except (ValueError, IndexError, struct.error) as e:
                rows.append((*[None] * 11, str(e) or type(e).__name__))
            if rows:
                yield made(own, rows)


def frames(gifs: DataFrame, media_col: str = "media", more: tuple[str, ...] = ()) -> DataFrame:
    """A row per frame: the columns ``more`` of its GIF, number, place, delay (hundredths), disposal, the RGB samples of its
    area as shown, and how many of them fall into 8 shades of red, green and blue."""
    arrow_batches(gifs.sparkSession)
    slim = gifs.select(F.struct(*more).alias("own") if more else F.struct(F.lit(0).alias("none")).alias("own"), F.col(media_col).alias("media"))
    schema = StructType([slim.schema["own"], *StructType.fromDDL(_FRAME).fields])
    return slim.mapInArrow(_frames, schema).select(*["own.*"] * bool(more), *schema.names[1:])


def _one(text: bytes | None) -> tuple:
    raw = text or b""
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    media = encode(payload)
    digest, n, count, duration, last, shades = hashlib.sha256(), 0, 0, 0, b"", np.zeros((3, 8), np.int64)
    for f in decode(media):
        back = f.area()[..., 0].tobytes()
        digest.update(back)
        n, count, duration, last, shades = n + len(back), count + 1, duration + f.delay, (last + back)[-64:], shades + histogram(f)
    shown = ";".join(f"{name}={','.join(map(str, x))}" for name, x in zip(("red", "green", "blue"), shades.tolist(), strict=True))
    feature = f"frames={count};hundredths={duration};{shown}"
    return len(raw), n, digest.hexdigest(), zlib.crc32(last), len(media), hashlib.sha256(media).hexdigest(), feature, media


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """A row per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and the file)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            done = [_one(x) for x in texts]
            cols = list(zip(*done, strict=True)) or [()] * 8
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(x, t) for x, t in zip(cols, types, strict=False)]
            if keep_media:
                arrays.append(pa.array(cols[7], pa.binary()))
            yield pa.record_batch([batch.column(0), *arrays], names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(id_col, text_col).mapInArrow(run, schema + ", media binary" * keep_media)
