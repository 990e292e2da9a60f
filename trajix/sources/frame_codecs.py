"""Frames of XTC, TRR, DCD and AMBER NetCDF files, read and written one by one.

A codec finds frames (``scan`` from a frame's first byte, ``find`` from anywhere), reads the asked
sections of one and writes one. Files are opened through pyarrow's file systems, so a path may name any
store that these know.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyarrow import fs

# Fixed values of the XTC format: sizes that its small differences may have.
SMALL = [int(v) for v in """
0 0 0 0 0 0 0 0 0 8 10 12 16 20 25 32 40 50 64 80 101 128 161 203 256 322 406 512 645 812 1024 1290 1625 2048 2580 3250 4096
5060 6501 8192 10321 13003 16384 20642 26007 32768 41285 52015 65536 82570 104031 131072 165140 208063 262144 330280 416127
524287 660561 832255 1048576 1321122 1664510 2097152 2642245 3329021 4194304 5284491 6658042 8388607 10568983 13316085 16777216
""".split()]  # fmt: skip
FIRST_SMALL = 9


class TrajectoryError(ValueError):
    pass


@dataclass
class Frame:
    time: float
    step: int
    box: list[float] | None
    xyz: np.ndarray | None  # (n, 3), in Å
    v: np.ndarray | None = None  # in Å/ps
    f: np.ndarray | None = None  # in kJ/mol/Å


class Head(NamedTuple):
    """Where a frame begins, where the next one does, and what its header says."""

    at: int
    end: int
    time: float
    step: int


#: What ``read`` can be asked for.
BOX, X, V, F = "box", "x", "v", "f"
ALL = frozenset((BOX, X, V, F))


class Window:
    """A file read ahead by ``block`` bytes, not beyond ``limit``. ``taken`` counts the bytes that came; ``heads``
    keeps what a codec has read of the file's own header."""

    def __init__(self, f, block: int = 0, limit: int = 1 << 62):
        self.f, self.block, self.limit = f, block, limit
        self.at, self.held, self.taken, self.heads = 0, b"", 0, {}

    def __enter__(self) -> "Window":
        return self

    def __exit__(self, *_) -> None:
        self.f.close()

    def size(self) -> int:
        if "size" not in self.heads:
            self.heads["size"] = self.f.size()
        return self.heads["size"]

    def read_at(self, n: int, at: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.held = self.f.read_at(max(n, min(self.block, self.limit - at)), at)
            self.at = at
            self.taken += len(self.held)
        return self.held[at - self.at : at - self.at + n]


def system_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """A path's file system, its name there, and what stands before such names."""
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return fs.LocalFileSystem(), path, ""


def opened(path: str, block: int = 0, limit: int = 1 << 62) -> Window:
    system, inner, _ = system_of(path)
    return Window(system.open_input_file(inner), block, limit)


def find_mark(f, begin: int, end: int, mark: bytes, sound, block: int = 1 << 22) -> int | None:
    """The first place of [begin, end), a multiple of four, with ``mark`` where ``sound`` agrees."""
    at = -(-begin // 4) * 4
    while at < end:
        held = f.read_at(min(block, end - at) + len(mark) - 1, at)
        k = held.find(mark)
        while k >= 0:
            if k % 4 == 0 and at + k < end and sound(at + k):
                return at + k
            k = held.find(mark, k + 1)
        at += block
    return None


def _fields(raw: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Big-endian fields of ``n`` bits, 32 at most, at some bit positions."""
    byte, skip = at >> 3, at & 7
    whole = np.zeros(len(at), np.int64)
    for k in range(5):
        whole = whole << 8 | raw[byte + k]
    return whole >> (40 - n - skip) & ((1 << n) - 1)


def _triples(raw: np.ndarray, at: np.ndarray, n: int, sizes: list[int]) -> np.ndarray:
    """Three values each out of mixed-radix numbers of ``n`` bits, whose bytes come lowest first."""
    parts = [_fields(raw, at + k, min(8, n - k)) for k in range(0, n, 8)] or [np.zeros(len(at), np.int64)]
    out = np.empty((len(at), 3), np.int64)
    for c in (2, 1):  # long division, from the highest byte down
        rest = np.zeros(len(at), np.int64)
        for k in range(len(parts) - 1, -1, -1):
            rest = rest << 8 | parts[k]
            parts[k], rest = rest // sizes[c], rest % sizes[c]
        out[:, c] = rest
    out[:, 0] = 0
    for k in range(len(parts) - 1, -1, -1):
        out[:, 0] = out[:, 0] << 8 | parts[k]
    return out


def _low_first(values: np.ndarray, n: int, sizes: list[int]) -> np.ndarray:
    """Mixed-radix numbers of ``n`` bits, 72 at most, from three values each: their bytes, lowest first, a row each."""
    upper = values[:, 0] * sizes[1] + values[:, 1]
    low = (upper & 0xFFFFFF) * sizes[2] + values[:, 2]
    high = (low >> 24) + (upper >> 24) * sizes[2]  # the number without its lowest 24 bits
    return np.stack([(low >> 8 * k if k < 3 else high >> 8 * (k - 3)) & 255 for k in range(-(-n // 8))], axis=1) if n else np.zeros((len(values), 0), np.int64)


def _high_first(values: np.ndarray, n: int) -> np.ndarray:
    """Numbers of ``n`` bits in pieces of eight bits, the highest first; the first piece may have fewer."""
    pieces = -(-n // 8)
    return np.stack([values >> 8 * (pieces - 1 - k) & 255 for k in range(pieces)], axis=1)


def _packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields of up to eight bits one after another."""
    ends = np.cumsum(widths)
    begin = ends - widths
    window = values << (16 - widths - (begin & 7))
    size = int(ends[-1] + 7) // 8 if len(ends) else 0
    out = np.bincount(begin >> 3, window >> 8, size + 1) + np.bincount((begin >> 3) + 1, window & 255, size + 1)[: size + 1]
    return out[:size].astype(np.uint8).tobytes()


def unpack_coordinates(raw: bytes, n: int, low: list[int], high: list[int], small: int) -> np.ndarray:
    """Integer coordinates of a compressed XTC block.

    A walk over the flags finds where each atom's bits lie; all numbers are then read together.
    """
    sizes = [h - l + 1 for l, h in zip(low, high)]
    apart = max(sizes) > 0xFFFFFF
    bits = 0 if apart else (sizes[0] * sizes[1] * sizes[2]).bit_length()
    width = sum(v.bit_length() for v in sizes) if apart else bits
    data = raw + b"\0" * 16
    end = 8 * len(raw)
    at, i, run = 0, 0, 0
    starts, owners, counts, kinds = [], [], [], []
    while i < n:
        starts.append(at)
        owners.append(i)
        at += width
        if at >= end:
            raise TrajectoryError("block cut short")
        change = 0
        byte, skip = at >> 3, at & 7
        at += 1
        if data[byte] >> (7 - skip) & 1:
            run = (data[byte] << 8 | data[byte + 1]) >> (10 - skip) & 31
            change = run % 3 - 1
            run //= 3
            at += 5
        counts.append(run)
        kinds.append(small)
        at += run * small
        i += 1 + run
        small += change
        if not FIRST_SMALL <= small < len(SMALL):
            raise TrajectoryError("small size out of range")
    if i > n:
        raise TrajectoryError("run beyond the frame")
    if at > end:
        raise TrajectoryError("block cut short")
    view = np.frombuffer(data, np.uint8).astype(np.int64)
    begin, owner, count, kind = (np.array(v, np.int64) for v in (starts, owners, counts, kinds))
    if apart:
        lengths = [v.bit_length() for v in sizes]
        full = np.stack([_fields(view, begin + sum(lengths[:c]), lengths[c]) for c in range(3)], axis=1)
    else:
        full = _triples(view, begin, bits, sizes)
    full += np.array(low)
    out = np.empty((n, 3), np.int64)
    out[owner + (count > 0)] = full  # the second atom of a run comes first in the stream
    if count.any():
        # the small numbers of a record end where the next record begins
        small_at = np.append(begin[1:], at) - count * kind
        record = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
        where, delta = small_at[record] + place * kind[record], np.empty((len(record), 3), np.int64)
        for k in np.unique(kind[record]).tolist():
            own = kind[record] == k
            delta[own] = _triples(view, where[own], k, [SMALL[k]] * 3) - SMALL[k] // 2
        total = np.cumsum(delta, axis=0)
        before = (np.cumsum(count) - count)[record]
        reached = full[record] + total - np.where(before[:, None] > 0, total[before - 1], 0)
        out[owner[record] + place + (place > 0)] = reached
    return out


def pack_coordinates(ints: np.ndarray) -> tuple[list[int], list[int], int, bytes]:
    """Bounds, small size and block of integer coordinates; runs of near atoms become differences."""
    low, high = ints.min(0).tolist(), ints.max(0).tolist()
    sizes = [h - l + 1 for l, h in zip(low, high)]
    apart = max(sizes) > 0xFFFFFF
    bits = 0 if apart else (sizes[0] * sizes[1] * sizes[2]).bit_length()
    steps = np.abs(np.diff(ints, axis=0)).max(1) if len(ints) > 1 else np.zeros(1, int)
    small = next((k for k in range(FIRST_SMALL, len(SMALL)) if SMALL[k] // 2 > np.median(steps)), FIRST_SMALL)
    half, n = SMALL[small] // 2, len(ints)

    def fits(d: np.ndarray) -> list[bool]:
        return ((d >= -half) & (d < SMALL[small] - half)).all(1).tolist() + [False] * 2

    # a run's first atom is told from its second, its third from the first, and each further one from the one before
    first, third, on = fits(ints[:-1] - ints[1:]), fits(ints[2:] - ints[:-2]), fits(ints[1:] - ints[:-1])
    starts, runs, i = [], [], 0
    while i < n:
        run = 0
        if first[i] and i + 1 < n:
            run = 1
            if i + 2 < n and third[i]:
                run = 2
                while run < 8 and i + run + 1 < n and on[i + run]:
                    run += 1
        starts.append(i)
        runs.append(run)
        i += 1 + run
    start, run = np.array(starts, np.int64), np.array(runs, np.int64)
    full = ints[start + (run > 0)]
    if apart:
        lengths = [v.bit_length() for v in sizes]
        whole = np.concatenate([_high_first(full[:, c] - low[c], lengths[c]) for c in range(3)], axis=1)
        widths = [w for v in lengths for w in ([v % 8 or 8] + [8] * (-(-v // 8) - 1))]
    else:
        whole, widths = _low_first(full - low, bits, sizes), [min(8, bits - 8 * k) for k in range(-(-bits // 8))]
    changed = np.append(run[:1] != 0, run[1:] != run[:-1])
    pieces = -(-small // 8)
    at = np.cumsum(len(widths) + 1 + changed + run * pieces)
    total, at = int(at[-1]), at - (len(widths) + 1 + changed + run * pieces)
    values, bits_of = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for k, w in enumerate(widths):
        values[at + k], bits_of[at + k] = whole[:, k], w
    values[at + len(widths)], bits_of[at + len(widths)] = changed, 1
    where = (at + len(widths) + 1)[changed]
    values[where], bits_of[where] = 3 * run[changed] + 1, 5
    record = np.repeat(np.arange(len(run)), run)
    place = np.arange(len(record)) - np.repeat(np.cumsum(run) - run, run)
    own = start[record] + place + (place > 0)
    before = start[record] + np.where(place > 1, place, np.where(place == 1, 0, 1))
    near = _low_first(ints[own] - ints[before] + half, small, [SMALL[small]] * 3)
    where = (at + len(widths) + 1 + changed)[record] + place * pieces
    for k in range(pieces):
        values[where + k], bits_of[where + k] = near[:, k], min(8, small - 8 * k)
    return low, high, small, _packed(values, bits_of)


class Xtc:
    """GROMACS compressed frames: big-endian, lengths in nm."""

    @staticmethod
    def kept_time(time: float, number: int, **_) -> float:
        """What the format gives back as the time of a frame, by its number in the file."""
        return float(np.float32(time))

    @staticmethod
    def scan(f, at: int, end: int, number: int = 0) -> Iterator[Head]:
        """Whole frames that begin in [at, end); one begins at ``at``. A frame cut short ends the file."""
        size = f.size()
        while at < end and at + 56 <= size:
            head = f.read_at(92, at)
            magic, n, step, time = struct.unpack_from(">3if", head)
            if magic != 1995:
                raise TrajectoryError("InvalidMagic")
            if n > 9 and len(head) < 92:
                return
            behind = at + (56 + 12 * n if n <= 9 else 92 + (struct.unpack_from(">i", head, 88)[0] + 3) // 4 * 4)
            if behind > size:
                return
            yield Head(at, behind, time, step)
            at = behind

    @staticmethod
    def find(f, begin: int, end: int) -> int | None:
        """Where the first frame of [begin, end) most likely begins: a header like the file's first, and one behind its frame."""
        if begin <= 0:
            return 0
        n = f.read_at(8, 0)[4:8]

        def sound(at: int) -> bool:
            for _ in range(3):
                head = f.read_at(92, at)
                if not head and at == f.size():
                    return True
                if len(head) < 56 or head[:8] != b"\0\0\x07\xcb" + n or head[52:56] != n:
                    return at + 56 > f.size()
                own = struct.unpack(">i", n)[0]
                if own > 9 and (len(head) < 92 or struct.unpack_from(">i", head, 88)[0] < 0):
                    return len(head) < 92
                at += 56 + 12 * own if own <= 9 else 92 + (struct.unpack_from(">i", head, 88)[0] + 3) // 4 * 4
            return True

        return find_mark(f, begin, end, b"\0\0\x07\xcb" + n, sound)

    @staticmethod
    def read(f, at: int, number: int, want: frozenset = ALL) -> Frame:
        head = f.read_at(92, at)
        _, n, step, time, *box, _ = struct.unpack_from(">3if9fi", head)
        box = [10 * v for v in box]
        if X not in want:
            return Frame(time, step, box, None)
        if n <= 9:
            return Frame(time, step, box, np.frombuffer(f.read_at(12 * n, at + 56), ">f4").reshape(n, 3) * 10.0)
        precision, *ints = struct.unpack_from(">f8i", head, 56)
        raw = f.read_at(ints[7], at + 92)
        xyz = unpack_coordinates(raw, n, ints[:3], ints[3:6], ints[6]).astype(np.float32) * np.float32(1 / precision)
        return Frame(time, step, box, xyz.astype(np.float64) * 10)

    @staticmethod
    def head(n: int, frames: int) -> bytes:
        return b""

    @staticmethod
    def write(x: Frame, precision: float = 1000.0, **_) -> bytes:
        n, nm = len(x.xyz), x.xyz / 10
        box = [v / 10 for v in x.box or [0.0] * 9]
        head = struct.pack(">3if9fi", 1995, n, x.step, x.time, *box, n)
        if n <= 9:
            return head + nm.astype(">f4").tobytes()
        low, high, small, raw = pack_coordinates(np.rint(nm * precision).astype(np.int64))
        return head + struct.pack(">f8i", precision, *low, *high, small, len(raw)) + raw + b"\0" * (-len(raw) % 4)


class Trr:
    """GROMACS full-precision frames; those without positions are passed over."""

    @staticmethod
    def _head(f, at: int):
        magic, _, size = struct.unpack(">3i", f.read_at(12, at))
        if magic != 1993:
            raise TrajectoryError("InvalidMagic")
        begin = at + 12 + (size + 3) // 4 * 4
        ints = struct.unpack(">13i", f.read_at(52, begin))
        real = 8 if (ints[2] == 72 or (ints[2] == 0 and ints[10] and max(ints[7:10]) == 24 * ints[10])) else 4
        body = begin + 52 + 2 * real
        return ints, real, body, body + sum(ints[:10])

    @staticmethod
    def kept_time(time: float, number: int, double: bool = False, **_) -> float:
        return time if double else float(np.float32(time))

    @staticmethod
    def scan(f, at: int, end: int, number: int = 0) -> Iterator[Head]:
        size = f.size()
        while at < end and at + 84 <= size:
            ints, real, body, behind = Trr._head(f, at)
            if behind > size:
                return
            if ints[7]:
                yield Head(at, behind, float(np.frombuffer(f.read_at(real, body - 2 * real), f">f{real}")[0]), ints[11])
            at = behind

    @staticmethod
    def find(f, begin: int, end: int) -> int | None:
        if begin <= 0:
            return 0
        mark = f.read_at(12, 0)[:12]
        return find_mark(f, begin, end, mark, lambda at: f.read_at(24, at)[12:24] == f.read_at(24, 0)[12:24])

    @staticmethod
    def read(f, at: int, number: int, want: frozenset = ALL) -> Frame:
        """The asked sections alone are read; positions and velocities are in nm, forces per nm."""
        ints, real, body, _ = Trr._head(f, at)
        kind = f">f{real}"
        time = float(np.frombuffer(f.read_at(real, body - 2 * real), kind)[0])

        def section(k: int, scale: float) -> np.ndarray | None:
            return (np.frombuffer(f.read_at(ints[k], body + sum(ints[:k])), kind) * scale).astype(np.float64).reshape(-1, 3) if ints[k] else None

        box = section(2, 10.0) if BOX in want else None
        x, v, force = (section(k, scale) if name in want else None for name, k, scale in ((X, 7, 10.0), (V, 8, 10.0), (F, 9, 0.1)))
        return Frame(time, ints[11], None if box is None else box.ravel().tolist(), x, v, force)

    @staticmethod
    def head(n: int, frames: int) -> bytes:
        return b""

    @staticmethod
    def write(x: Frame, double: bool = False, **_) -> bytes:
        """Velocities and forces where the frame has them; numbers of four bytes, or of eight."""
        n, real, kind = len(x.xyz), 8 if double else 4, ">f8" if double else ">f4"
        for name, part in (("velocities", x.v), ("forces", x.f)):
            if part is not None and part.shape != x.xyz.shape:
                raise TrajectoryError(f"InvalidAtomCount: {name}")
        parts = [None if part is None else (part / scale).astype(kind).tobytes() for part, scale in ((x.xyz, 10), (x.v, 10), (x.f, 0.1))]
        sizes = [0, 0, 9 * real if x.box else 0, 0, 0, 0, 0, *[len(p or b"") for p in parts], n, x.step, 0]
        head = struct.pack(">3i", 1993, 13, 12) + b"GMX_trn_file" + struct.pack(">13i", *sizes) + np.array([x.time, 0.0], kind).tobytes()
        return head + (np.array([v / 10 for v in x.box], kind).tobytes() if x.box else b"") + b"".join(p or b"" for p in parts)


class Dcd:
    """CHARMM and X-PLOR frames of a fixed size; unit cells give right-angled boxes."""

    @staticmethod
    def _head(f):
        if Dcd not in f.heads:
            f.heads[Dcd] = Dcd._read_head(f)
        return f.heads[Dcd]

    @staticmethod
    def _read_head(f):
        first = f.read_at(92, 0)
        end = "<" if struct.unpack_from("<i", first)[0] == 84 else ">"
        if struct.unpack_from(f"{end}i", first)[0] != 84 or first[4:8] != b"CORD":
            raise TrajectoryError("InvalidMagic")
        i = struct.unpack_from(f"{end}20i", first, 8)
        charmm = i[19] != 0
        if i[8]:
            raise TrajectoryError("fixed atoms")
        delta = struct.unpack_from(f"{end}f" if charmm else f"{end}d", first, 44)[0]
        title = struct.unpack(f"{end}i", f.read_at(4, 92))[0]
        at = 92 + 8 + title
        n = struct.unpack(f"{end}3i", f.read_at(12, at))[1]
        cell = charmm and i[10] != 0
        return end, n, i[1], i[2], delta, cell, charmm and i[11] == 1, at + 12

    @staticmethod
    def _stride(head) -> int:
        _, n, *_, cell, four, _ = head
        return (56 if cell else 0) + (4 if four else 3) * (4 * n + 8)

    @staticmethod
    def kept_time(time: float, number: int, **_) -> float:
        return float(number)  # the header has a time of 1 from frame to frame

    @staticmethod
    def scan(f, at: int, end: int, number: int = 0) -> Iterator[Head]:
        """As for XTC; places are relative to the first frame, and ``number`` is that of the frame at ``at``."""
        head = Dcd._head(f)
        stride = Dcd._stride(head)
        end = min(end, f.size() - head[7] - stride + 1)
        for k, place in enumerate(range(at, end, stride), number):
            yield Head(place, place + stride, k * head[4], head[2] + k * head[3])

    @staticmethod
    def find(f, begin: int, end: int) -> int | None:
        stride = Dcd._stride(Dcd._head(f))
        at = -(-max(0, begin) // stride) * stride
        return at if at < end else None

    @staticmethod
    def number(f, at: int) -> int:
        """Of the frame at a place of its file."""
        return at // Dcd._stride(Dcd._head(f))

    @staticmethod
    def read(f, at: int, number: int, want: frozenset = ALL) -> Frame:
        end, n, start, every, delta, cell, _, first = Dcd._head(f)
        box, at = None, at + first
        if cell:
            if BOX in want:
                uc = struct.unpack(f"{end}6d", f.read_at(48, at + 4))
                box = [uc[0], 0.0, 0.0, 0.0, uc[2], 0.0, 0.0, 0.0, uc[5]]
            at += 56
        xyz = None
        if X in want:
            xyz = np.stack([np.frombuffer(f.read_at(4 * n, at + 4 + k * (4 * n + 8)), f"{end}f4") for k in range(3)], 1).astype(np.float64)
        return Frame(number * delta, start + number * every, box, xyz)

    @staticmethod
    def head(n: int, frames: int, cells: bool = True) -> bytes:
        """CHARMM header with a step of 1 and a time of 1 from frame to frame."""
        block = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
        first = b"CORD" + struct.pack("<9if10i", frames, 0, 1, frames, *[0] * 5, 1.0, int(cells), *[0] * 8, 24)
        return block(first) + block(struct.pack("<i", 1) + b" " * 80) + block(struct.pack("<i", n))

    @staticmethod
    def write(x: Frame, cells: bool = True, **_) -> bytes:
        block = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
        box = x.box or [0.0] * 9
        return (block(struct.pack("<6d", box[0], 90, box[4], 90, 90, box[8])) if cells else b"") + b"".join(block(x.xyz[:, c].astype("<f4").tobytes()) for c in range(3))


class NetCdf:
    """AMBER frames in classic NetCDF (CDF-1 and CDF-2), a record each."""

    SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 4, 6: 8}

    @staticmethod
    def _head(f):
        if NetCdf not in f.heads:
            f.heads[NetCdf] = NetCdf._read_head(f)
        return f.heads[NetCdf]

    @staticmethod
    def _read_head(f):
        raw = f.read_at(min(f.size(), 1 << 16), 0)
        if raw[:3] != b"CDF" or raw[3] not in (1, 2):
            raise TrajectoryError("InvalidMagic")
        wide, at = raw[3] == 2, 4

        def number() -> int:
            nonlocal at
            at += 4
            return struct.unpack_from(">i", raw, at - 4)[0]

        def text() -> str:
            nonlocal at
            n = number()
            out = raw[at : at + n].decode()
            at += (n + 3) // 4 * 4
            return out

        def attributes() -> dict:
            nonlocal at
            number()
            out = {}
            for _ in range(number()):
                name, kind, n = text(), number(), number()
                size = n * NetCdf.SIZES[kind]
                out[name] = raw[at : at + size].decode("latin-1") if kind == 2 else np.frombuffer(raw[at : at + size], {5: ">f4", 6: ">f8"}.get(kind, ">i4"))
                at += (size + 3) // 4 * 4
            return out

        records = number()
        number()
        dims = [(text(), number()) for _ in range(number())]
        if "AMBER" not in str(attributes().get("Conventions", "")):
            raise TrajectoryError("not an AMBER trajectory")
        number()
        found = {}
        for _ in range(number()):
            name = text()
            own = [dims[number()] for _ in range(number())]
            attributes()
            kind, size = number(), number()
            begin = struct.unpack_from(">q" if wide else ">i", raw, at)[0]
            at += 8 if wide else 4
            found[name] = (kind, own, size, begin)
        stride = sum(v[2] for v in found.values() if v[1] and v[1][0][1] == 0)
        return records, found, stride

    @staticmethod
    def _values(f, found: dict, name: str, at: int) -> np.ndarray | None:
        if name not in found:
            return None
        kind, own, _, begin = found[name]
        n = int(np.prod([d[1] for d in own[1:]], dtype=np.int64))
        return np.frombuffer(f.read_at(n * NetCdf.SIZES[kind], begin + at), ">f8" if kind == 6 else ">f4").astype(np.float64)

    @staticmethod
    def kept_time(time: float, number: int, **_) -> float:
        return 0.0  # times are not written

    @staticmethod
    def scan(f, at: int, end: int, number: int = 0) -> Iterator[Head]:
        """As for XTC; places are relative to the first record."""
        records, found, stride = NetCdf._head(f)
        for k, place in enumerate(range(at, min(end, records * stride), stride), number):
            time = NetCdf._values(f, found, "time", place)
            yield Head(place, place + stride, 0.0 if time is None else float(time[0]), k)

    @staticmethod
    def find(f, begin: int, end: int) -> int | None:
        stride = NetCdf._head(f)[2]
        at = -(-max(0, begin) // stride) * stride
        return at if at < end else None

    @staticmethod
    def number(f, at: int) -> int:
        return at // NetCdf._head(f)[2]

    @staticmethod
    def read(f, at: int, number: int, want: frozenset = ALL) -> Frame:
        _, found, _ = NetCdf._head(f)
        time = NetCdf._values(f, found, "time", at)
        lengths, angles = (NetCdf._values(f, found, v, at) if BOX in want else None for v in ("cell_lengths", "cell_angles"))
        box = cell_vectors(*lengths, *angles) if lengths is not None and angles is not None else None
        xyz = NetCdf._values(f, found, "coordinates", at).reshape(-1, 3) if X in want else None
        return Frame(float(time[0]) if time is not None else 0.0, number, box, xyz)

    @staticmethod
    def head(n: int, frames: int, cells: bool = True) -> bytes:
        """Header for ``frames`` records of ``n`` atoms; with cells, three lengths and three angles each."""
        text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
        attribute = lambda k, v: text(k) + struct.pack(">2i", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4)
        dims = [("frame", 0), ("spatial", 3), ("atom", n), *([("cell_spatial", 3), ("cell_angular", 3)] if cells else [])]
        out = b"CDF\x02" + struct.pack(">3i", frames, 10, len(dims)) + b"".join(text(d) + struct.pack(">i", v) for d, v in dims)
        out += struct.pack(">2i", 12, 2) + attribute("Conventions", "AMBER") + attribute("ConventionVersion", "1.0")
        each = [("coordinates", [0, 2, 1], 5, 12 * n), *([("cell_lengths", [0, 3], 6, 24), ("cell_angles", [0, 4], 6, 24)] if cells else [])]
        size = len(out) + 8 + sum(4 + (len(v) + 3) // 4 * 4 + 4 + 4 * len(d) + 8 + 16 for v, d, _, _ in each)
        out += struct.pack(">2i", 11, len(each))
        for name, own, kind, room in each:
            out += text(name) + struct.pack(f">{1 + len(own)}i", len(own), *own) + struct.pack(">4iq", 0, 0, kind, room, size)
            size += room
        return out

    @staticmethod
    def write(x: Frame, cells: bool = True, **_) -> bytes:
        out = x.xyz.astype(">f4").tobytes()
        if cells:
            m = np.array(x.box or [0.0] * 9).reshape(3, 3)
            size = np.linalg.norm(m, axis=1)
            turn = lambda i, j: np.degrees(np.arccos(np.clip(m[i] @ m[j] / max(size[i] * size[j], 1e-300), -1, 1))) if size[i] * size[j] else 90.0
            out += size.astype(">f8").tobytes() + np.array([turn(1, 2), turn(0, 2), turn(0, 1)], ">f8").tobytes()
        return out


def cell_vectors(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[float] | None:
    """Box vectors of a cell; none where gamma leaves no area, or lengths are zero."""
    ca, cb, cg, sg = *np.cos(np.radians([alpha, beta, gamma])), np.sin(np.radians(gamma))
    if abs(sg) < 1e-10 or a * b * c == 0:
        return None
    y = c * (ca - cb * cg) / sg
    return [float(v) for v in (a, 0, 0, b * cg, b * sg, 0, c * cb, y, np.sqrt(max(0.0, c * c - (c * cb) ** 2 - y * y)))]


#: Formats whose frames are numbered by place, and so have one size.
FIXED = (Dcd, NetCdf)
FORMATS = {"xtc": Xtc, "trr": Trr, "dcd": Dcd, "nc": NetCdf, "ncdf": NetCdf}


def codec_of(path: str):
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise TrajectoryError(f"unknown format: {path}")
    return FORMATS[kind]
