"""The progressive reader on hand-assembled files: interleaved DC scans, runs of block ends, refinement with mixed history,
zero runs, restart intervals. The writer here is a plain one, bit by bit, and shares nothing with the operator's."""

import random
import struct

import numpy as np
import pytest

from partlake.llm import jpeg

#: Symbols of a table by code length: many lengths, so that no scan is even.
DC = {k: (2 if k < 2 else 4 if k < 6 else 6) for k in range(12)}
AC = {s: (8 if s < 128 else 9) for s in range(256)}
SAMPLING = [(2, 2), (1, 1), (1, 1)]


def codes(lengths):
    out, code, before = {}, 0, 0
    for s in sorted(lengths, key=lengths.get):
        code <<= lengths[s] - before
        before = lengths[s]
        out[s] = format(code, f"0{before}b")
        code += 1
    return out


DC_CODES, AC_CODES = codes(DC), codes(AC)


def table(kind, lengths):
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return b"\xff\xc4" + struct.pack(">H", 19 + len(lengths)) + bytes([kind, *counts, *sorted(lengths, key=lengths.get)])


def magnitude(value):
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def entropy(pieces):
    out = []
    for k, bits in enumerate(pieces):
        bits += "1" * (-len(bits) % 8)
        out.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
        if k < len(pieces) - 1:
            out.append(bytes([0xFF, 0xD0 + k % 8]))
    return b"".join(out)


def scan(parts, first, last, high, low, pieces):
    head = bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([first, last, high << 4 | low])
    return b"\xff\xda" + struct.pack(">H", len(head) + 2) + head + entropy(pieces)


def cut(units, interval):
    return [units[i : i + interval] for i in range(0, len(units), interval)] if interval else [units]


def dc_scan(blocks, mcus, low, refine, interval):
    units = [[(c, my * v + y, mx * h + x) for c, (h, v) in enumerate(SAMPLING) for y in range(v) for x in range(h)] for my in range(mcus[0]) for mx in range(mcus[1])]
    pieces = []
    for part in cut(units, interval):
        bits, before = "", [0, 0, 0]
        for unit in part:
            for c, r, k in unit:
                value = int(blocks[c][r, k, 0])
                if refine:
                    bits += str(value >> low & 1)
                else:
                    size, extra = magnitude((value >> low) - before[c])
                    bits += DC_CODES[size] + extra
                    before[c] = value >> low
        pieces.append(bits)
    return scan([0, 1, 2], 0, 0, low + 1 if refine else 0, low, pieces)


class Ends:
    """A run of blocks that end early, with the correction bits that wait for it."""

    def __init__(self):
        self.run, self.waiting, self.bits = 0, "", ""

    def flush(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.bits += AC_CODES[n << 4] + (format(self.run - (1 << n), f"0{n}b") if n else "") + self.waiting
            self.run, self.waiting = 0, ""


def ac_scan(c, view, first, last, low, refine, interval):
    pieces = []
    for part in cut([view[r, k] for r in range(view.shape[0]) for k in range(view.shape[1])], interval):
        e = Ends()
        for block in part:
            size = [abs(int(x)) >> low for x in block]
            if refine:
                new = [k for k in range(first, last + 1) if size[k] == 1]
                zeros, own = 0, ""
                for k in range(first, last + 1):
                    if not size[k]:
                        zeros += 1
                        continue
                    while zeros > 15 and new and k <= new[-1]:
                        e.flush()
                        e.bits += AC_CODES[0xF0] + own
                        own, zeros = "", zeros - 16
                    if size[k] > 1:
                        own += str(size[k] & 1)
                        continue
                    e.flush()
                    e.bits += AC_CODES[zeros << 4 | 1] + ("1" if block[k] > 0 else "0") + own
                    own, zeros = "", 0
                if zeros or own:
                    e.run, e.waiting = e.run + 1, e.waiting + own
            else:
                zeros = 0
                for k in range(first, last + 1):
                    if not size[k]:
                        zeros += 1
                        continue
                    e.flush()
                    while zeros > 15:
                        e.bits, zeros = e.bits + AC_CODES[0xF0], zeros - 16
                    n, extra = magnitude(size[k] if block[k] > 0 else -size[k])
                    e.bits += AC_CODES[zeros << 4 | n] + extra
                    zeros = 0
                e.run += bool(zeros)
        e.flush()
        pieces.append(e.bits)
    return scan([c], first, last, low + 1 if refine else 0, low, pieces)


@pytest.mark.parametrize("interval", [0, 3])
@pytest.mark.parametrize("density", [0.02, 0.3, 0.9])
def test_reader_on_hand_assembled_files(interval, density):
    rng = random.Random(f"{interval} {density}")
    width, height = 75, 41
    mcus = (-(-height // 16), -(-width // 16))
    blocks, views = [], []
    for h, v in SAMPLING:
        own = np.zeros((mcus[0] * v, mcus[1] * h, 64), np.int16)
        down, across = -(-(-(-height * v // 2)) // 8), -(-(-(-width * h // 2)) // 8)
        own[..., 0] = [[rng.randint(-500, 500) for _ in range(own.shape[1])] for _ in range(own.shape[0])]
        for r in range(down):
            for k in range(across):
                for i in range(1, 64):
                    if rng.random() < density:
                        own[r, k, i] = rng.choice([-60, -9, -3, -2, -1, 1, 2, 3, 7, 40])
        blocks.append(own)
        views.append(own[:down, :across])
    out = [b"\xff\xd8", b"\xff\xdb\x00\x43\x00" + bytes([1] * 64), b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])]
    out += [table(0x00, DC), table(0x10, AC), b"\xff\xdd\x00\x04" + struct.pack(">H", interval)]
    out.append(dc_scan(blocks, mcus, 1, False, interval))
    for c in range(3):
        out += [ac_scan(c, views[c], a, z, 2, False, interval) for a, z in ((1, 5), (6, 63))]
    out += [ac_scan(c, views[c], 1, 63, low, True, interval) for low in (1, 0) for c in range(3)]
    out += [dc_scan(blocks, mcus, 0, True, interval), b"\xff\xd9"]
    image = jpeg.Image(b"".join(out))
    for got, want in zip(image.blocks, blocks):
        assert (got == want).all()
    assert image.rgb().shape == (height, width, 3)
