"""Media columns in progressive JPEG: payloads kept losslessly as quantised coefficients, read back from all scans.

A payload's bytes are coefficients: 64 to a block, byte b as b from 128 on and as b - 255 below, so that each has eight bits
of magnitude. They fill a 4:2:0 image of three components whose quantisers are 1. The file codes them progressively: first
scans of DC, of AC 1 to 5 and of AC 6 to 63 without the lowest bit, then refinement scans that add it.

The reader takes any progressive file of 8-bit samples: DC and AC, first and refinement scans, end-of-band runs, restart
intervals, interleaved scans. Scans whose tables give each coefficient the same length, as those written here, are read as
arrays. Then blocks are transformed back in numpy, chroma is upsampled to full resolution and turned into an RGB tensor.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partlake.llm.common import map_batches

BLOCK = 64
BLOCKS_IN_MCU = 6  # four of luma, one of each chroma
ACROSS, MOST_DOWN = 64, 4095  # units of 16 pixels in a row, and rows at most
STRIP_BLOCKS = 4096  # blocks transformed at once
MARKER = re.compile(b"\xff[^\x00\xff\xd0-\xd7]", re.DOTALL)
#: Fixed values of the format: markers, and the application segment that holds the payload's length.
SOI, EOI, SOS, DQT, DHT, SOF2, DRI, APP = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC2, 0xDD, 0xEF
NAME = b"payload\x00"


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Natural place of each coefficient in coding order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """(coefficient in natural order, pixel) of the inverse transform."""
    u = np.arange(8)
    one = np.cos((2 * u[None, :] + 1) * u[:, None] * math.pi / 16) * np.where(u == 0, math.sqrt(1 / 8), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)


# ---- writing


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def table(kind: int, lengths: dict[int, int]) -> bytes:
    """A Huffman table segment; lengths: code length of each symbol, in code order."""
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return segment(DHT, bytes([kind, *counts, *sorted(lengths, key=lengths.get)]))


def scan(component: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = segment(SOS, bytes([1, component, 0, first, last, high << 4 | low]))
    return head + data.replace(b"\xff", b"\xff\x00")


def packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last one filled with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, bits.dtype)])).tobytes()


@lru_cache(maxsize=1)
def sizes() -> np.ndarray:
    """Bits of each magnitude."""
    return np.array([x.bit_length() for x in range(1024)])


def dc_bits(values: np.ndarray) -> np.ndarray:
    """Differences of DC values as 4-bit categories and their extra bits."""
    diff = np.diff(values, prepend=0)
    size = sizes()[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = 4 + size
    word = ((size << size) | extra) << (16 - length)
    bits = np.unpackbits(word.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return bits[np.arange(16) < length[:, None]]


def write(payload: bytes) -> bytes:
    """A progressive JPEG that holds a payload, whose length is a positive multiple of 64."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    mcus = -(-len(payload) // (BLOCK * BLOCKS_IN_MCU))
    down = -(-mcus // max(ACROSS, -(-mcus // MOST_DOWN)))
    across = -(-mcus // down)
    data = np.zeros(across * down * BLOCKS_IN_MCU * BLOCK, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    size, blocks = across * down, data.reshape(-1, BLOCK)
    out = [b"\xff\xd8", segment(APP, NAME + struct.pack(">Q", len(payload))), segment(DQT, bytes([0, *[1] * 64]))]
    out.append(segment(SOF2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(table(0x00, {k: 4 for k in range(12)}))
    scans: list[list[bytes]] = [[], [], [], []]
    for c, own in ((1, blocks[: 4 * size]), (2, blocks[4 * size : 5 * size]), (3, blocks[5 * size :])):
        value = own.astype(np.int16)
        value[own < 128] -= 255
        # what one-bit codes and seven extra bits make of a magnitude without its lowest bit: a byte under 128
        high = np.where(own < 128, own >> 1, (own >> 1) & 127).astype(np.uint8)
        refine = (np.abs(value) & 1).astype(np.uint8)
        scans[0].append(scan(c, 0, 0, 0, 1, packed(dc_bits((value[:, 0] >> 1).astype(np.int64)))))
        scans[1].append(scan(c, 1, 5, 0, 1, high[:, 1:6].tobytes()))
        scans[1].append(scan(c, 6, 63, 0, 1, high[:, 6:].tobytes()))
        marks = refine.copy()
        marks[:, 0] = 0  # the code for the end of the band, before the block's 63 bits
        scans[2].append(scan(c, 1, 63, 1, 0, np.packbits(marks).tobytes()))
        scans[3].append(scan(c, 0, 0, 1, 0, packed((value[:, 0] & 1).astype(np.uint8))))
    out += [*scans[0], table(0x10, {0x07: 1}), *scans[1], table(0x10, {0x00: 1}), *scans[2], *scans[3], b"\xff\xd9"]
    return b"".join(out)


# ---- reading


class Bits:
    """Reads a scan's entropy-coded bits one by one."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def bit(self) -> int:
        if self.at >= self.size:
            self.at += 1
            return 0
        out = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return out

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


class Image:
    """Coefficients of a progressive JPEG: ``blocks[c]`` is (down, across, 64) in coding order."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.components: list[tuple[int, int, int, int]] = []
        self.blocks: list[np.ndarray] = []
        self.interval, self.payload_length = 0, None
        at = 2
        while at < len(data):
            marker, length = data[at + 1], 0
            if data[at] != 0xFF:
                raise ValueError(f"no marker at {at}")
            if marker == 0xFF:  # fill byte
                at += 1
                continue
            if marker == EOI:
                break
            length = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == DQT:
                self.read_quantisers(body)
            elif marker == DHT:
                self.read_codes(body)
            elif marker == SOF2:
                self.read_frame(body)
            elif marker in range(0xC0, 0xD0) and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only progressive files with Huffman codes are read")
            elif marker == DRI:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == APP and body.startswith(NAME):
                self.payload_length = struct.unpack(">Q", body[len(NAME) :])[0]
            elif marker == SOS:
                end = MARKER.search(data, at)
                stop = end.start() if end else len(data)
                self.read_scan(body, data[at:stop])
                at = stop

    def read_quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = 128 if wide else 64
            self.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[1 + n :]

    def read_codes(self, body: bytes) -> None:
        while body:
            counts, codes, code, at = body[1:17], {}, 0, 17
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    codes[n, code] = body[at]
                    code, at = code + 1, at + 1
                code <<= 1
            self.codes[body[0]] = codes
            body = body[at:]

    def read_frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if precision != 8:
            raise ValueError("only 8-bit samples are read")
        self.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.h, self.v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        self.mcus = (-(-self.height // (8 * self.v)), -(-self.width // (8 * self.h)))
        self.blocks = [np.zeros((self.mcus[0] * v, self.mcus[1] * h, 64), np.int16) for _, h, v, _ in self.components]

    def read_scan(self, head: bytes, coded: bytes) -> None:
        n = head[0]
        which = [next(i for i, c in enumerate(self.components) if c[0] == head[1 + 2 * k]) for k in range(n)]
        tables = [head[2 + 2 * k] for k in range(n)]
        first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        if n == 1:
            _, h, v, _ = self.components[which[0]]
            down, across = -(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8)
            view = self.blocks[which[0]][:down, :across]
            dc, ac = self.codes.get(tables[0] >> 4, {}), self.codes.get(16 | tables[0] & 15, {})
            if not self.interval and self.read_even(view, dc, ac, first, last, high, low, coded.replace(b"\xff\x00", b"\xff")):
                return
            order = [[(0, r, c)] for r in range(down) for c in range(across)]
        else:
            order = [[(k, my * v + y, mx * h + x) for k, i in enumerate(which) for _, h, v, _ in [self.components[i]] for y in range(v) for x in range(h)] for my in range(self.mcus[0]) for mx in range(self.mcus[1])]
        pieces = re.split(b"\xff[\xd0-\xd7]", coded) if self.interval else [coded]
        step = self.interval or len(order)
        for p, piece in enumerate(pieces):
            bits, before, run = Bits(piece.replace(b"\xff\x00", b"\xff")), [0] * n, 0
            for unit in order[p * step : (p + 1) * step]:
                for k, r, c in unit:
                    block = self.blocks[which[k]][r, c]
                    if first == 0:
                        if high:
                            block[0] |= bits.bit() << low
                        else:
                            before[k] += bits.signed(bits.symbol(self.codes[tables[k] >> 4]))
                            block[0] = before[k] << low
                    elif high:
                        run = self.refine(bits, block, self.codes[16 | tables[k] & 15], first, last, low, run)
                    else:
                        run = self.begin(bits, block, self.codes[16 | tables[k] & 15], first, last, low, run)

    @staticmethod
    def begin(bits: Bits, block: np.ndarray, codes: dict, first: int, last: int, low: int, run: int) -> int:
        """A block of a first AC scan; returns the end-of-band run that is left."""
        if run:
            return run - 1
        k = first
        while k <= last:
            symbol = bits.symbol(codes)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                block[k] = bits.signed(size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) + bits.take(zeros) - 1
        return 0

    @staticmethod
    def refine(bits: Bits, block: np.ndarray, codes: dict, first: int, last: int, low: int, run: int) -> int:
        """A block of an AC refinement scan."""
        one, k = 1 << low, first

        def correct(at: int) -> None:
            if bits.bit() and not abs(int(block[at])) & one:
                block[at] += one if block[at] > 0 else -one

        if not run:
            while k <= last:
                symbol = bits.symbol(codes)
                zeros, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = one if bits.bit() else -one
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= last:
                    if block[k]:
                        correct(k)
                    elif zeros == 0:
                        break
                    else:
                        zeros -= 1
                    k += 1
                if value and k <= last:
                    block[k] = value
                k += 1
        if run:
            for at in range(k, last + 1):
                if block[at]:
                    correct(at)
            run -= 1
        return run

    @staticmethod
    def read_even(view: np.ndarray, dc: dict, ac: dict, first: int, last: int, high: int, low: int, coded: bytes) -> bool:
        """Read a scan of one component as arrays if its codes allow that."""
        count, band = view.shape[0] * view.shape[1], last - first + 1
        if first == 0 and high:
            bits = np.unpackbits(np.frombuffer(coded, np.uint8), count=count)
            view[..., 0] |= bits.reshape(view.shape[:2]).astype(np.int16) << low
            return True
        if first == 0:
            lengths = {n for n, _ in dc}
            if len(lengths) != 1 or [dc.get((4, k)) for k in range(len(dc))] != list(range(len(dc))):
                return False
            b = np.frombuffer(coded + bytes(4), np.uint8).astype(np.int32)
            window = b[:-2] << 16 | b[1:-1] << 8 | b[2:]  # 24 bits from each byte on
            windows, most, at, places = window.tolist(), 8 * len(coded), 0, []
            for _ in range(count):
                if at > most:
                    raise ValueError("a DC scan ends early")
                places.append(at)
                at += 4 + (windows[at >> 3] >> (20 - (at & 7)) & 15)
            places = np.array(places)
            inside, held = places & 7, window[places >> 3]
            size = held >> (20 - inside) & 15
            value = held >> (20 - inside - size) & ((1 << size) - 1)
            value = np.where((size > 0) & (value < 1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value)
            view[..., 0] = (np.cumsum(value) << low).reshape(view.shape[:2])
            return True
        if len(ac) != 1:
            return False
        ((length, _), symbol), = ac.items()
        if high:
            if symbol or not view[..., first : last + 1].all():
                return False
            each = length + band
            bits = np.unpackbits(np.frombuffer(coded, np.uint8), count=count * each).reshape(*view.shape[:2], each)[..., length:]
            part = view[..., first : last + 1]
            part += np.where(part > 0, 1, -1).astype(np.int16) * (bits.astype(np.int16) << low)
            return True
        if symbol >> 4 or not symbol:
            return False
        size = symbol & 15
        if length + size == 8:
            value = np.frombuffer(coded, np.uint8, count * band).astype(np.int16) & ((1 << size) - 1)
        else:
            bits = np.unpackbits(np.frombuffer(coded, np.uint8), count=count * band * (length + size)).reshape(-1, length + size)[:, length:]
            value = (bits.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))).astype(np.int16)
        value = np.where(value < 1 << (size - 1), value - (1 << size) + 1, value).astype(np.int16)
        view[..., first : last + 1] = (value * (1 << low)).reshape(*view.shape[:2], band)
        return True

    def payload(self) -> bytes:
        """The bytes that the coefficients hold."""
        value = np.concatenate([b.reshape(-1, 64) for b in self.blocks]).reshape(-1)[: self.payload_length]
        return np.where(value < 0, value + 255, value).astype(np.uint8).tobytes()

    def plane(self, c: int) -> np.ndarray:
        """Samples of a component."""
        blocks = self.blocks[c]
        down, across, _ = blocks.shape
        natural = np.zeros((64, 64))
        natural[np.arange(64), zigzag()] = self.quantisers[self.components[c][3]]
        inverse = natural @ basis()
        flat, out = blocks.reshape(-1, 64), np.empty((down * across, 64), np.uint8)
        for k in range(0, len(flat), STRIP_BLOCKS):
            out[k : k + STRIP_BLOCKS] = np.clip(np.rint(flat[k : k + STRIP_BLOCKS] @ inverse + 128), 0, 255)
        return out.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)

    def rgb(self) -> np.ndarray:
        """(height, width, 3) samples, chroma at full resolution; a grey file repeats its plane."""
        full = []
        for c, (_, h, v, _) in enumerate(self.components[:3]):
            p = self.plane(c)
            full.append(np.repeat(np.repeat(p, self.v // v, axis=0), self.h // h, axis=1)[: self.height, : self.width].astype(np.int32))
        if len(full) < 3:
            return np.repeat(full[0][..., None], 3, axis=2).astype(np.uint8)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        half = 1 << 15  # the colour equations in 16-bit fixed point
        red = y + ((91881 * cr + half) >> 16)
        green = y - ((22554 * cb + 46802 * cr + half) >> 16)
        blue = y + ((116130 * cb + half) >> 16)
        return np.clip(np.stack([red, green, blue], axis=2), 0, 255).astype(np.uint8)


def feature(rgb: np.ndarray) -> str:
    """Size, channel means and contrast of a tensor, from sums of its samples."""
    n = rgb.shape[0] * rgb.shape[1]
    counts = np.stack([np.bincount(rgb[..., k].reshape(-1), minlength=256) for k in range(3)])
    means = counts @ np.arange(256) / n
    spread = np.sqrt(np.maximum(counts @ np.arange(256) ** 2 / n - means**2, 0))
    return f"{rgb.shape[1]}x{rgb.shape[0]} mean " + " ".join(f"{x:.2f}" for x in means) + " sd " + " ".join(f"{x:.2f}" for x in spread)


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def store_texts(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, media (a progressive JPEG of the padded UTF-8 text). A null text is empty.

    Repeated rows each get a row, ids pass through, an empty table gives an empty result, further columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        data = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
        return {id_column: batch.column(0), "n_bytes": pa.array(map(len, data), pa.int64()), "media": pa.array([write(pad(x)) for x in data], pa.binary())}

    return map_batches(docs.select(id_column, text_column), make, f"`{id_column}` {kind}, n_bytes bigint, media binary")


def read_media(stored: DataFrame, *, id_column: str = "doc_id", tensors: bool = False) -> DataFrame:
    """What the media of ``store_texts`` hold: digests of the payload and of the file, a feature; with ``tensors`` the RGB
    samples (height, width, rgb in row order). A null medium gives nulls."""
    kind = stored.schema[id_column].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = f"`{id_column}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    if tensors:
        names, kinds, schema = [*names, "height", "width", "rgb"], [*kinds, pa.int32(), pa.int32(), pa.binary()], schema + ", height int, width int, rgb binary"

    def one(media: bytes | None) -> list:
        if media is None:
            return [None] * len(names)
        image = Image(media)
        payload, rgb = image.payload(), image.rgb()
        out = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb)]
        return [*out, rgb.shape[0], rgb.shape[1], rgb.tobytes()] if tensors else out

    def make(batch: pa.RecordBatch) -> dict:
        rows = zip(*[one(x) for x in batch.column(2).to_pylist()])
        return {id_column: batch.column(0), "n_bytes": batch.column(1)} | {n: pa.array(list(r), k) for n, k, r in zip(names, kinds, rows)}

    return map_batches(stored.select(id_column, "n_bytes", "media"), make, schema)
