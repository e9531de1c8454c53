"""Lossless WebP: an encoder and decoder of the VP8L bit stream, and the
operators that keep a table's texts as images.

The decoder reads prefix codes by table look-up, back-references, the colour
cache and meta prefix codes, and inverts the predictor, cross-colour,
subtract-green and palette transforms. It raises ValueError on a stream that is
cut short or whose codes, references or sizes make no sense. The encoder of the
operators deals the transforms out by checksum, picks their parameters by what they
leave to code, and uses back-references and, where it pays, the colour cache; the
column `parts` names what the reader met in each row's stored form.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal
bytes; payloads above 1 MiB go to several images, one after another; repeated
rows, null ids and further columns are harmless; an empty table gives none.
"""

from __future__ import annotations

import array
import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import arrow_map, id_and_text, table, utf8

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
# Fixed values of the format: offsets (dx, dy) of the short distance codes.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
PARTS = ("predictor", "cross-colour", "subtract-green", "palette", "references", "cache")
CACHE_MULTIPLIER = 0x1E35A7BD
ROW_PIXELS, MOST_ROWS, MOST_PIXELS = 16, 16384, 1 << 26
#: Images of so many pixels are read item by item, which costs less than vectors do.
FEW_PIXELS = 100
LONGEST_CODE, LONGEST_COPY, FURTHEST_COPY, CACHE_PAYS = 15, 4096, (1 << 20) - 120, 16


@functools.cache
def reversal(n: int) -> np.ndarray:
    """The n-bit numbers, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


def _where(of: np.ndarray) -> np.ndarray:
    return of.nonzero()[0]


class Bits:
    """Reads bits, least significant first; past the end they are 0, and `done`
    tells whether that happened."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def __call__(self, n: int) -> int:
        got = int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return got

    def check(self) -> None:
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")


class Out:
    """Writes fields of up to 63 bits, least significant first."""

    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def __call__(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts += [(np.array(self.values, np.uint64), np.array(self.sizes, np.int64)), (values, sizes)]
        self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        self.many(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        values, sizes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = [(values, sizes)]
        ends = np.cumsum(sizes)
        n, at = int(ends[-1]) if len(ends) else 0, ends - sizes
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        words = np.zeros((n >> 6) + 2, np.uint64)
        change = np.ones(len(word), bool)
        np.not_equal(word[1:], word[:-1], out=change[1:])
        first = _where(change)
        into = word[first]
        words[into] = np.bitwise_or.reduceat(values << shift, first)
        words[into + 1] |= np.bitwise_or.reduceat(values >> np.uint64(1) >> (np.uint64(63) - shift), first)
        return words.tobytes()[: (n + 7) // 8]


_NOTHING, _ONCE = np.zeros(1, np.int64), np.ones(1, np.int64)


class Code:
    """A canonical prefix code: lengths by symbol; one used symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = _where(lengths)
        self.symbols = len(lengths)
        if len(used) < 2:
            self.longest, self.order, self.lengths, self.span = 0, used if len(used) else _NOTHING, _NOTHING, _ONCE
            return
        by = lengths[used] << 12 | used  # symbols are fewer than 1 << 12
        by.sort()
        self.order, self.lengths = by & 4095, by >> 12
        self.longest = int(self.lengths[-1])
        self.span = _ONCE << (self.longest - self.lengths)
        if np.add.reduce(self.span) != 1 << self.longest:
            raise ValueError("the code lengths make no prefix code")

    def entries(self, bits: int = 0) -> np.ndarray:
        """What each pattern of the next `longest` bits (of `bits`, if more) means: symbol * 16 + length."""
        more = max(bits - self.longest, 0)
        return (self.order << 4 | self.lengths).astype(np.int32).repeat(self.span << more)[reversal(self.longest + more)]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The bits of each symbol, and how many."""
        words, sizes = np.zeros(self.symbols, np.uint64), np.zeros(self.symbols, np.uint64)
        sizes[self.order] = self.lengths
        words[self.order] = reversal(self.longest)[self.span.cumsum() - self.span]
        return words, sizes


class Inner:
    """A code of code lengths, from its own n lengths of three bits."""

    def __init__(self, n: int, lengths: int):
        inner = np.zeros(19, np.int64)
        inner[CODE_LENGTH_ORDER[:n]] = [lengths >> 3 * k & 7 for k in range(n)]
        code = Code(inner)
        self.means, self.mask = code.entries().tolist(), (1 << code.longest) - 1
        self.windows: dict[int, tuple[int, bytes, int]] = {}

    def one(self, w: int, last: int) -> tuple[int, int, int]:
        """The bits that the next item takes, the code length it gives and how often."""
        t = self.means[w & self.mask]
        n, s = t & 15, t >> 4
        if s < 16:
            return n, s, 1
        w >>= n
        return (n + 2, last, 3 + (w & 3)) if s == 16 else (n + 3, 0, 3 + (w & 7)) if s == 17 else (n + 7, 0, 11 + (w & 127))

    def several(self, w: int) -> tuple[int, bytes, int]:
        """All items that lie whole in 16 bits: their bits, the code lengths they give
        and the last of those that isn't 0. A repeat of what came before isn't taken."""
        at, found, last = 0, b"", 0
        while True:
            n, value, times = self.one(w >> at, last or -1)
            if not n or at + n > 16 or value < 0:
                break
            at, found, last = at + n, found + bytes((value,)) * times, value or last
        self.windows[w] = at, found, last
        return self.windows[w]


_inner_table = functools.lru_cache(256)(Inner)


def read_code(bits: Bits, size: int) -> Code:
    if bits(1):
        two, wide = bits(1), bits(1)
        symbols = [bits(8 if wide else 1)] + [bits(8) for _ in range(two)]
        if max(symbols) >= size:
            raise ValueError("a symbol outside its alphabet")
        lengths = np.zeros(size, np.int64)
        lengths[symbols] = 1
        return Code(lengths)
    n = 4 + bits(4)
    inner = _inner_table(n, bits(3 * n))
    left = 2 + bits(2 + 2 * bits(3)) if bits(1) else size
    if left > size:
        raise ValueError("more code lengths than symbols")
    last, data, p, found, w, until = 8, bits.data, bits.at, bytearray(), 0, 0
    known, together = inner.windows.get, left == size
    while len(found) < size and left:
        if p >= until:
            w, until = int.from_bytes(data[p >> 3 : (p >> 3) + 20], "little") >> (p & 7), p + 120
        if together:
            n, many, then = known(w & 0xFFFF) or inner.several(w & 0xFFFF)
            if n and len(found) + len(many) <= size:
                found += many
                last = then or last
                p += n
                w >>= n
                continue
        left -= 1
        n, value, times = inner.one(w, last)
        if len(found) + times > size:
            raise ValueError("too many code lengths")
        found += bytes((value,)) * times
        last = value or last
        p += n
        w >>= n
    bits.at = p
    bits.check()
    lengths = np.zeros(size, np.int64)
    lengths[: len(found)] = np.frombuffer(found, np.uint8)
    return Code(lengths)


def _reference(data: bytes, p: int, prefix: int, entries: memoryview, mask: int, width: int) -> tuple[int, int, int]:
    """Length and distance of the back-reference of that length prefix, whose other
    fields begin at bit p; and where they end."""
    v = int.from_bytes(data[p >> 3 : (p >> 3) + 8], "little") >> (p & 7)
    length, far, extra = prefix + 1, 0, 0
    if prefix > 3:
        extra = (prefix - 2) >> 1
        length = ((2 + (prefix & 1)) << extra) + (v & ((1 << extra) - 1)) + 1
        v >>= extra
    t = entries[v & mask]
    v >>= t & 15
    p += extra + (t & 15)
    prefix = t >> 4
    far = prefix + 1
    if prefix > 3:
        extra = (prefix - 2) >> 1
        far = ((2 + (prefix & 1)) << extra) + (v & ((1 << extra) - 1)) + 1
        p += extra
    if far > 120:
        return length, far - 120, p
    dx, dy = NEAR[far - 1]
    return length, max(1, dx + dy * width), p


def read_pixels(bits: Bits, width: int, height: int, main: bool, met: set) -> np.ndarray:
    """An entropy-coded image, as a vector of ARGB values."""
    cache_bits = bits(4) if bits(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    block, across, count, groups_at = 14, 0, 1, None
    if main and bits(1):
        block = bits(3) + 2
        across = -(-width >> block)
        groups_at = (read_pixels(bits, across, -(-height >> block), False, set()) >> 8) & 0xFFFF
        count = int(groups_at.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(count)]
    bits.check()
    if count == 1 and width * height > FEW_PIXELS:
        starts, refs, greens, values = _one_group(bits, groups[0], width, width * height)
    else:
        starts, refs, greens, values = _many_groups(bits, groups, width, width * height, block, across, [0] if groups_at is None else groups_at.tolist())
    bits.check()
    return _resolved(width * height, starts, refs, greens, values, cache_bits, met)


_SHIFTS = np.tile(np.arange(8), 1 << 12)


def _shifts(n: int) -> np.ndarray:
    """0 to 7, n times."""
    return _SHIFTS[: 8 * n] if 8 * n <= len(_SHIFTS) else np.tile(_SHIFTS[:8], n)


def _one_group(bits: Bits, codes: list[Code], width: int, total: int):
    """The items of an image of one code group: pixel places, back-references as
    (place, length, distance), and each single item's green symbol and ARGB value.
    Every bit position is read as if an item began there, as vectors; then the items
    that do are found by following each one's end."""
    first, end = bits.at >> 3, 8 * len(bits.data)
    n = min(len(bits.data) - first, (total * 4 * LONGEST_CODE >> 3) + 2) + 16
    d = np.frombuffer(bits.data[first : first + n + 2] + bytes(n + 2), np.uint8)[: n + 2].astype(np.int64)
    longest = max(c.longest for c in codes[:4])
    w = (d[:-2] | d[1:-1] << 8 | d[2:] << 16).repeat(8)
    w >>= _shifts(n)
    w &= (1 << longest) - 1
    tables = [c.entries(longest) for c in codes[:4]]
    # Each place has four bytes, one for each code that takes bits: the steps from there to the next
    # code's byte where this one's word ends. A green symbol of no single pixel is marked by 64 more.
    used = [t for k, t in enumerate(tables) if codes[k].longest or not k]
    steps = np.zeros((1 << longest, 4), np.int8)
    for k, t in enumerate(used):
        steps[:, k] = (t & 15) * 4 + (1 if k + 1 < len(used) else 1 - len(used))
    unlike = bool((codes[0].order > 255).any())
    if unlike:
        steps[tables[0] >= 256 << 4, 0] += 64
    steps = steps.view(np.int32).reshape(-1).take(w, mode="wrap").view(np.int8)
    ends = np.arange(0, len(steps) - 4 * (4 * LONGEST_CODE + 16), 4)
    for _ in used:
        ends += steps[ends]
    ends >>= 2
    if unlike:
        other = _where(steps[: 4 * len(ends) : 4] > 61)
        green = tables[0][w[other]]
        ends[other] = np.where(green < 280 << 4, -1, other + (green & 15))
    past = end - 8 * first + 1
    if past < len(ends):
        ends[past:] = -2
    follow, means, window = memoryview(ends), memoryview(tables[0]), memoryview(w)
    far_entries, far_mask = memoryview(codes[4].entries()), (1 << codes[4].longest) - 1
    at, here, then, starts, refs = 0, bits.at - 8 * first, 0, array.array("q"), []
    add = starts.append
    while at < total:
        before = len(starts)
        for _ in range(total - at):
            then = follow[here]
            if then < 0:
                break
            add(here)
            here = then
        at += len(starts) - before
        if at == total:
            break
        if then == -2:
            raise ValueError("the stream ends early")
        t = means[window[here]]
        length, far, here = _reference(bits.data, 8 * first + here + (t & 15), (t >> 4) - 256, far_entries, far_mask, width)
        here -= 8 * first
        if far > at or at + length > total:
            raise ValueError("a back-reference leaves the image")
        refs.append((at, length, far))
        at += length
        if here >= len(follow):
            raise ValueError("the stream ends early")
    bits.at = 8 * first + here
    single = np.ones(total + 1, np.int64)
    for place, length, _ in refs:
        single[place : place + length] = 0
    at, found = np.frombuffer(starts, np.int64), []
    for t in tables:
        x = t[w[at]].astype(np.int64)
        at = at + (x & 15)
        found.append(x >> 4)
    s, red, blue, alpha = found
    return _where(single[:total]), refs, s, alpha << 24 | red << 16 | s << 8 | blue


def _many_groups(bits: Bits, groups: list[list[Code]], width: int, total: int, block: int, across: int, groups_at: list[int]):
    """As _one_group; where an item begins says which codes it has, so they are read in turn."""
    tables = [[(c.entries().tolist(), (1 << c.longest) - 1) for c in codes] for codes in groups]
    at, end, places, refs, greens, values = 0, 8 * len(bits.data), [], [], [], []
    while at < total:
        if bits.at > end:
            raise ValueError("the stream ends early")
        y, x = divmod(at, width)
        k = groups_at[(y >> block) * across + (x >> block)]
        w, found = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 9], "little") >> (bits.at & 7), []
        for entries, mask in tables[k][:4]:
            t = entries[w & mask]
            w >>= t & 15
            bits.at += t & 15
            found.append(t >> 4)
            if found[0] > 255:
                break
        s = found[0]
        if 256 <= s < 280:
            length, far, bits.at = _reference(bits.data, bits.at, s - 256, *tables[k][4], width)
            if far > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            refs.append((at, length, far))
            at += length
            continue
        places.append(at)
        greens.append(s)
        values.append(found[3] << 24 | found[1] << 16 | s << 8 | found[2] if s < 256 else 0)
        at += 1
    return np.array(places, np.int64), refs, np.array(greens, np.int64), np.array(values, np.int64)


def _last(to: np.ndarray) -> np.ndarray:
    """Where following `to` ends, for each place; a place that stays points to itself."""
    while True:
        then = to[to]
        if (then == to).all():
            return to
        to = then


def _resolved(total: int, places: np.ndarray, refs: list, greens: np.ndarray, values: np.ndarray, cache_bits: int, met: set) -> np.ndarray:
    """The pixels of the items: a copied pixel is the one its reference points to, a
    cached one the last before it of the same cache slot (0 if there is none)."""
    px, to = np.zeros(total + 1, np.uint32), np.arange(total + 1)
    px[places] = values.astype(np.uint32)
    if refs:
        met.add("references")
        begin, length, far = np.array(refs, np.int64).T
        copied = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        to[copied] -= np.repeat(far, length)
        to = _last(to)
    hit = places[greens >= 280]
    if len(hit):
        met.add("cache")
        slot = (px * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)
        slot[hit] = greens[greens >= 280] - 280
        slot = slot[to[:total]].astype(np.uint16)
        by = slot.argsort(kind="stable")
        before = np.full(total, total)  # a place past the image, where the pixel is 0
        in_order = slot[by]
        same = _where(in_order[1:] == in_order[:-1])
        before[by[same + 1]] = by[same]
        if (slot[hit[before[hit] == total]] != 0).any():
            raise ValueError("a cache slot that was never filled")
        to[hit] = before[hit]
        px[hit] = 0
        px[total] = 0
        to = _last(to)
    return px[to[:total]]


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predicted(mode: int, left: np.ndarray, top: np.ndarray, tl: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """The predictions of a mode, from the neighbours' channels (int16)."""
    if mode in (0, 14, 15):
        return np.broadcast_to(np.array([0, 0, 0, 255], np.int16), left.shape)
    if mode < 5:
        return (left, top, tr, tl)[mode - 1]
    if mode == 5:
        return _half(_half(left, tr), top)
    if mode < 10:
        return _half(*((left, tl), (left, top), (tl, top), (top, tr))[mode - 6])
    if mode == 10:
        return _half(_half(left, tl), _half(top, tr))
    if mode == 11:
        return np.where((np.abs(top - tl).sum(-1) < np.abs(left - tl).sum(-1))[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - tl, 0, 255)
    mid = _half(left, top)
    return np.clip(mid + np.trunc((mid - tl) / 2).astype(np.int16), 0, 255)


#: Modes that need no pixel of the same row but the first, so a row is one vector.
_FROM_ABOVE = {0, 2, 3, 4, 8, 9, 14, 15}


def _channels(px: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(px, "<u4").view(np.uint8).reshape(-1, 4)


def _neighbours(c: np.ndarray, at: slice, width: int) -> tuple[np.ndarray, ...]:
    """Left, top, top-left and top-right of a run of pixels, none in the first row or column."""
    a, b = at.start, at.stop
    return tuple(c[a - k : b - k].astype(np.int16) for k in (1, width, width + 1, width - 1))


def _all_neighbours(c: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The same of all pixels from the second row on; those of the first column mean nothing."""
    return _neighbours(np.concatenate([c[:1], c, c[:1]]), slice(width + 1, len(c) + 1), width)


def residuals(px: np.ndarray, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    """px less its predictions (the encoder's way)."""
    c, n, across = _channels(px), len(px), -(-width >> block)
    p = np.zeros((n, 4), np.int16)
    p[0] = [0, 0, 0, 255]
    p[1:width] = c[: width - 1]
    if n > width:
        at = np.arange(n)
        mode = (modes[(at // width >> block) * across + (at % width >> block)] >> 8 & 15).astype(np.int64)
        mode[:width] = -1
        around = _all_neighbours(c, width)
        for k in np.unique(mode[width:]).tolist():
            mine = _where(mode == k)
            p[mine] = predicted(k, *(x[mine - width] for x in around))
        first = np.arange(width, n, width)
        p[first] = c[first - width]
    return (c - p).astype(np.uint8).view("<u4").reshape(-1)


def _selected(c: np.ndarray, top: np.ndarray, tl: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A run of mode 11: the residuals c plus the left or the top pixel, in turn."""
    to_left = np.abs(top.astype(np.int16) - tl).sum(1).tolist()
    a, b, g, r = before.tolist()
    out = []
    for (da, db, dg, dr), (ta, tb, tg, tr), (ca, cb, cg, cr), n in zip(c.tolist(), top.tolist(), tl.tolist(), to_left, strict=True):
        if n >= abs(a - ca) + abs(b - cb) + abs(g - cg) + abs(r - cr):
            a, b, g, r = ta, tb, tg, tr
        a, b, g, r = a + da & 255, b + db & 255, g + dg & 255, r + dr & 255
        out.append((a, b, g, r))
    return np.array(out, np.uint8)


def unpredicted(px: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    """px plus its predictions (the decoder's way), run by run of one mode."""
    c, across = _channels(px).copy(), -(-width >> block)
    modes = (modes >> 8 & 15).tolist()
    c[:1] += np.array([0, 0, 0, 255], np.uint8)
    c[:width] = np.cumsum(c[:width], axis=0, dtype=np.uint8)
    rows = c.reshape(height, width, 4)
    rows[:, 0] = np.cumsum(rows[:, 0], axis=0, dtype=np.uint8)
    whole = 0  # rows done with those before them
    for y in range(1, height):
        if y < whole:
            continue
        if across == 1 and modes[y >> block] in (1, 2):  # a tile's rows at once
            whole = min(height, (y >> block) + 1 << block)
            if modes[y >> block] == 1:
                rows[y:whole] = np.cumsum(rows[y:whole], axis=1, dtype=np.uint8)
            else:
                rows[y - 1 : whole, 1:] = np.cumsum(rows[y - 1 : whole, 1:], axis=0, dtype=np.uint8)
            continue
        x = 1
        while x < width:
            mode, stop = modes[(y >> block) * across + (x >> block)], min(width, (x >> block) + 1 << block)
            run = slice(y * width + x, y * width + stop)
            x = stop
            if mode == 1:
                c[run.start] += c[run.start - 1]
                c[run] = np.cumsum(c[run], axis=0, dtype=np.uint8)
            elif mode in (2, 3, 4):
                back = (width, width - 1, width + 1)[mode - 2]
                c[run] += c[run.start - back : run.stop - back]
            elif mode == 11:
                c[run] = _selected(c[run], *(c[run.start - k : run.stop - k] for k in (width, width + 1)), c[run.start - 1])
            elif mode in _FROM_ABOVE:
                c[run] += predicted(mode, *_neighbours(c, run, width)).astype(np.uint8)
            else:
                for k in range(run.start, run.stop):
                    one = slice(k, k + 1)
                    c[one] += predicted(mode, *_neighbours(c, one, width)).astype(np.uint8)
    return c.view("<u4").reshape(-1).astype(np.uint32)


def _signed(v: np.ndarray) -> np.ndarray:
    return (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)


def crossed(px: np.ndarray, width: int, block: int, factors: np.ndarray, forward: bool) -> np.ndarray:
    """Take the colours' correlation away (forward) or put it back."""
    if len(factors) == 1:
        f = factors
    else:
        at = np.arange(len(px))
        f = factors[(at // width >> block) * -(-width >> block) + (at % width >> block)]
    times = lambda k, c: (_signed(k) * _signed(c)) >> 5
    red, green, blue = (px >> 16) & 255, (px >> 8) & 255, (px & 255).astype(np.int32)
    if forward:
        new_red = red.astype(np.int32) - times(f, green)
        new_blue = blue - times(f >> 8, green) - times(f >> 16, red)
    else:
        new_red = red.astype(np.int32) + times(f, green)
        new_blue = blue + times(f >> 8, green) + times(f >> 16, new_red)
    return (px & np.uint32(0xFF00FF00)) | (new_red & 255).astype(np.uint32) << 16 | (new_blue & 255).astype(np.uint32)


def _green(px: np.ndarray, sign: int) -> np.ndarray:
    g = ((px >> 8) & 255).astype(np.int64)
    red, blue = ((px >> 16).astype(np.int64) + sign * g) & 255, (px.astype(np.int64) + sign * g) & 255
    return (px & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _pack_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _unpacked(px: np.ndarray, width: int, height: int, block: int, colours: np.ndarray) -> np.ndarray:
    colours = np.concatenate([colours, np.zeros(256, np.uint32)])
    if not block:
        return colours[px >> 8 & 255]
    x = np.arange(width)
    grid = (px.reshape(height, -1) >> 8 & 255)[:, x >> block] >> ((x & ((1 << block) - 1)) * (8 >> block)).astype(np.uint32) & np.uint32((1 << (8 >> block)) - 1)
    return colours[grid].reshape(-1)


def decode_parts(data: bytes) -> tuple[np.ndarray, set]:
    """The pixel array, height x width x RGBA, of a WebP file, and which PARTS it uses."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless chunk")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    if at + 8 > len(data) or at + 8 + (size := struct.unpack_from("<I", data, at + 4)[0]) > len(data):
        raise ValueError("the file ends early")
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits(14) + 1, bits(14) + 1
    bits(1)
    if bits(3):
        raise ValueError("unknown version")
    if width * height > MOST_PIXELS:
        raise ValueError("too large an image")
    undo, wide, met = [], width, set()
    while bits(1):
        kind = bits(2)
        if PARTS[kind] in met:
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits(3) + 2
            undo.append((kind, wide, block, read_pixels(bits, -(-wide >> block), -(-height >> block), False, set())))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, wide, 0, None))
        else:
            size = bits(8) + 1
            colours = np.cumsum(_channels(read_pixels(bits, size, 1, False, set())), axis=0, dtype=np.uint8).view("<u4").reshape(-1).astype(np.uint32)
            undo.append((kind, wide, _pack_bits(size), colours))
            wide = -(-wide >> _pack_bits(size))
        met.add(PARTS[kind])
        bits.check()
    px = read_pixels(bits, wide, height, True, met)
    for kind, w, block, more in reversed(undo):
        if kind == PREDICTOR:
            px = unpredicted(px, w, height, block, more)
        elif kind == CROSS_COLOUR:
            px = crossed(px, w, block, more, False)
        elif kind == SUBTRACT_GREEN:
            px = _green(px, 1)
        else:
            px = _unpacked(px, w, height, block, more)
    return _channels(px)[:, [2, 1, 0, 3]].reshape(height, width, 4), met


def decode(data: bytes) -> np.ndarray:
    return decode_parts(data)[0]


# Encoding


def code_lengths(counts: np.ndarray, most: int = LONGEST_CODE) -> np.ndarray:
    """Huffman lengths of at most `most` bits; counts are flattened until they fit."""
    used = _where(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    by = counts[used] << 12 | used  # in order of counts, then of symbols, which are fewer than 1 << 12
    by.sort()
    floor, never, sizes = 1, 1 << 62, (by >> 12).tolist()
    by &= 4095
    while True:
        # Leaves and joined nodes are two queues, each in order; the least two of their heads join next.
        leaves, joined, parent, i, j = [*(sizes if floor == 1 else [max(x, floor) for x in sizes]), never, never], [never] * (n + 1), [0] * (2 * n), 0, 0
        for k in range(n - 1):
            if leaves[i] <= joined[j]:
                total, parent[i], i = leaves[i], k, i + 1
            else:
                total, parent[n + j], j = joined[j], k, j + 1
            if leaves[i] <= joined[j]:
                joined[k], parent[i], i = total + leaves[i], k, i + 1
            else:
                joined[k], parent[n + j], j = total + joined[j], k, j + 1
        depth = [0] * (n - 1)  # of joined nodes; the last is the root
        for k in range(n - 3, -1, -1):
            depth[k] = depth[parent[n + k]] + 1
        found = [depth[k] + 1 for k in parent[:n]]
        if max(found) <= most:
            lengths[by] = found
            return lengths
        floor *= 2


#: Lengths of the code of code lengths that the encoder writes: short ones for the lengths that text has.
_INNER = np.array([5, 6, 6, 5, 4, 4, 3, 3, 3, 3, 4, 6, 6, 7, 7, 6, 5, 4, 4])


@functools.cache
def _inner_words() -> tuple[list[int], list[int], int]:
    """The words of that code, their sizes, and the 63 bits that announce it."""
    words, sizes = Code(_INNER).words()
    head = (len(_INNER) - 4) << 1
    for k, s in enumerate(CODE_LENGTH_ORDER):
        head |= int(_INNER[s]) << 5 + 3 * k
    return words.tolist(), sizes.tolist(), head


#: Runs of equal code lengths up to this are in _runs.
LONGEST_RUN = 511


@functools.cache
def _run(value: int, run: int) -> tuple[list[int], list[int]]:
    """The fields that write a code length `run` times, and their sizes."""
    words, sizes, _ = _inner_words()
    values, bits = ([words[value]], [sizes[value]]) if value else ([], [])
    run -= len(values)
    while run >= 3:
        n = min(run, 138 if not value else 6)
        s, extra, width = (16, n - 3, 2) if value else (18, n - 11, 7) if n >= 11 else (17, n - 3, 3)
        values.append(words[s] | extra << sizes[s])
        bits.append(sizes[s] + width)
        run -= n
    return values + [words[value]] * run, bits + [sizes[value]] * run


@functools.cache
def _runs() -> tuple[np.ndarray, np.ndarray]:
    """The same as one field, by value * (LONGEST_RUN + 1) + run; size 0 where it is over 63 bits."""
    fields, sizes = np.zeros(16 * (LONGEST_RUN + 1), np.uint64), np.zeros(16 * (LONGEST_RUN + 1), np.int64)
    for k in range(len(fields)):
        value, run = divmod(k, LONGEST_RUN + 1)
        if run and sum((got := _run(value, run))[1]) < 64:
            for word, size in zip(*got, strict=True):
                fields[k] |= np.uint64(word << int(sizes[k]))
                sizes[k] += size
    _run.cache_clear()
    return fields, sizes


def _write_code(out: Out, lengths: np.ndarray, times: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Write a code that many times; each one's words and their sizes."""
    code = Code(lengths)
    if not code.longest or len(code.order) == 2:
        used = _where(lengths).tolist()
        if all(s < 256 for s in used):
            first = (used or [0])[0]
            wide = first > 1
            for _ in range(times):
                out(1 | (len(used) == 2) << 1 | wide << 2 | first << 3, 11 if wide else 4)
                for s in used[1:]:
                    out(s, 8)
            return [code.words()] * times
    change = np.ones(len(lengths) + 1, bool)
    np.not_equal(lengths[1:], lengths[:-1], out=change[1:-1])
    edges = _where(change)
    values, runs = lengths[edges[:-1]], edges[1:] - edges[:-1]
    known = len(lengths) <= LONGEST_RUN
    if known:
        fields, sizes = _runs()
        key = values * (LONGEST_RUN + 1) + runs
        fields, sizes = fields[key], sizes[key]
    if not known or not sizes.all():
        each = [_run(*x) for x in zip(values.tolist(), runs.tolist(), strict=True)]
        fields, sizes = np.array([v for x, _ in each for v in x], np.uint64), np.array([n for _, x in each for n in x], np.int64)
    for _ in range(times):
        out(_inner_words()[2], 63)
        out.many(fields, sizes)
    return [code.words()] * times


def _prefix_of(value: np.ndarray) -> list[np.ndarray]:
    """The prefix symbols, extra values and numbers of extra bits of lengths or distance codes."""
    v = value - 1
    top = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 1)
    extra = np.where(v < 4, 0, top - 1)
    return [np.where(v < 4, v, 2 * top + (v >> (top - 1) & 1)), v & ((1 << extra) - 1), extra]


@functools.cache
def _prefixes() -> list[np.ndarray]:
    """The same, by value, of all that the operators' images can have."""
    return _prefix_of(np.arange(1, ROW_PIXELS * MOST_ROWS + 121))


def _prefix(value: np.ndarray) -> list[np.ndarray]:
    if len(value) and value.max() > ROW_PIXELS * MOST_ROWS + 120:
        return _prefix_of(value)
    return [x[value - 1] for x in _prefixes()]


def copies(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of back-references: from left to right, each pair
    of pixels met before copies from where it was met last, as far as that goes."""
    if len(px) < 3:
        return (np.zeros(0, np.int64),) * 3
    pairs = px[:-1].astype(np.uint64) << np.uint64(32) | px[1:]
    by = np.argsort(pairs, kind="stable")
    in_order = pairs[by]
    again = _where(in_order[1:] == in_order[:-1])
    place = np.full(len(pairs), -1, np.int64)
    place[by[again + 1]] = by[again]
    out, done = [], 0
    found = _where((place >= 0) & (np.arange(len(place)) - place <= FURTHEST_COPY))
    each, total = px.tolist(), len(px)
    for i, j in zip(found.tolist(), place[found].tolist(), strict=True):
        if i < done:
            continue
        n, most = 2, min(total - i, 16)
        while n < most and each[i + n] == each[j + n]:
            n += 1
        step = 64
        while 16 <= n < LONGEST_COPY and i + n < total:
            differ = _where(px[i + n : i + n + step] != px[j + n : j + n + min(step, total - i - n)])
            if len(differ):
                n += int(differ[0])
                break
            n, step = n + min(step, total - i - n), 4 * step
        n = min(n, LONGEST_COPY)
        out.append((i, n, i - j))
        done = i + n
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


_NO_COPIES = (np.zeros(0, np.int64),) * 3


class Plan:
    """How the pixels of an image are coded: single pixels, copies and, where one pixel
    of CACHE_PAYS is one, hits in the cache; and the symbol counts."""

    def __init__(self, px: np.ndarray, width: int, cache_bits: int, refs: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.px, self.at = px, refs[0]
        self.plain = np.ones(len(px), bool)
        self.length_code = self.far_code = _NO_COPIES
        if len(self.at):
            near = _near(width)
            far = np.array([near.get(f, f + 120) for f in refs[2].tolist()], np.int64)
            self.length_code, self.far_code = _prefix(refs[1]), _prefix(far)
            mark = np.zeros(len(px) + 1, np.int8)
            mark[self.at] = 1
            mark[self.at + refs[1]] -= 1
            self.plain = np.cumsum(mark[:-1], dtype=np.int8) == 0
        self.cache_bits, self.hit = 0, np.zeros(0, np.int64)
        self.slots = self.hit
        if cache_bits:
            slot = ((px * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
            by = slot.argsort(kind="stable")
            again, now = by[1:], px[by]
            hit = again[now[1:] == now[:-1]]  # equal pixels have one slot
            hit = hit[self.plain[hit]]
            if len(hit) * CACHE_PAYS >= len(px):
                self.cache_bits, self.hit, self.slots = cache_bits, hit, slot[hit].astype(np.int64)
                self.plain[hit] = False
        self.lone = lone = _channels(px[self.plain]).T.astype(np.intp, order="C")
        green = np.concatenate([lone[1], 256 + self.length_code[0], 280 + self.slots]) if len(self.at) or len(self.hit) else lone[1]
        self.counts = [np.bincount(green, minlength=280 + (1 << self.cache_bits if self.cache_bits else 0))]
        self.counts += [np.bincount(lone[k], minlength=256) for k in (2, 0, 3)]
        self.counts = [*self.counts, np.bincount(self.far_code[0], minlength=40)]

    def write(self, out: Out, main: bool, alike: bool = False) -> None:
        """With alike, red, blue and alpha have one code, as text has the same bytes in all channels."""
        out(int(bool(self.cache_bits)), 1)
        if self.cache_bits:
            out(self.cache_bits, 4)
        if main:
            out(0, 1)
        codes = _write_code(out, code_lengths(self.counts[0]))
        if alike:
            codes += _write_code(out, code_lengths(sum(self.counts[1:4])), 3)
        else:
            codes += [x for c in self.counts[1:4] for x in _write_code(out, code_lengths(c))]
        codes += _write_code(out, code_lengths(self.counts[4]))
        value, size = np.zeros(len(self.px), np.uint64), np.zeros(len(self.px), np.uint64)

        def put(at, *symbols):
            v, n = symbols[0]
            for words, sizes in symbols[1:]:
                v = v | words << n
                n = n + sizes
            value[at], size[at] = v, n

        put(self.plain, *((words[self.lone[k]], sizes[self.lone[k]]) for (words, sizes), k in zip(codes, (1, 2, 0, 3), strict=False)))
        in_code = lambda k, symbols: (codes[k][0][symbols], codes[k][1][symbols])
        more = lambda code: (code[1].astype(np.uint64), code[2].astype(np.uint64))
        if len(self.at):
            put(self.at, in_code(0, 256 + self.length_code[0]), more(self.length_code), in_code(4, self.far_code[0]), more(self.far_code))
        starts = self.plain.copy()
        starts[self.at] = True
        if len(self.hit):
            put(self.hit, in_code(0, 280 + self.slots))
            starts[self.hit] = True
        out.many(value[starts], size[starts].astype(np.int64))


@functools.cache
def _near(width: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, (dx, dy) in enumerate(NEAR):
        out.setdefault(max(1, dx + dy * width), k + 1)
    return out


def _write_pixels(out: Out, px: np.ndarray, width: int) -> None:
    """A small image of its own, such as a transform's data."""
    Plan(px, width, 0, _NO_COPIES).write(out, False)


def _file(body: bytes) -> bytes:
    body_padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body_padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body_padded


def _head(width: int, height: int) -> Out:
    out = Out()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out(value, n)
    return out


def _blocks(width: int, height: int, block: int) -> int:
    return -(-width >> block) * -(-height >> block)


def _write_predictor(out: Out, px: np.ndarray, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    for value, n in ((1, 1), (PREDICTOR, 2), (block - 2, 3)):
        out(value, n)
    _write_pixels(out, modes, -(-width >> block))
    return residuals(px, width, block, modes)


def _write_cross(out: Out, px: np.ndarray, width: int, block: int, factors: np.ndarray) -> np.ndarray:
    for value, n in ((1, 1), (CROSS_COLOUR, 2), (block - 2, 3)):
        out(value, n)
    _write_pixels(out, factors, -(-width >> block))
    return crossed(px, width, block, factors, True)


def _write_green(out: Out, px: np.ndarray) -> np.ndarray:
    out(1, 1)
    out(SUBTRACT_GREEN, 2)
    return _green(px, -1)


def _write_palette(out: Out, px: np.ndarray, width: int, height: int, colours: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, int]:
    for value, n in ((1, 1), (PALETTE, 2), (len(colours) - 1, 8)):
        out(value, n)
    _write_pixels(out, np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)).view("<u4").reshape(-1), len(colours))
    return _packed(width, height, len(colours), index)


def _packed(width: int, height: int, size: int, index: np.ndarray) -> tuple[np.ndarray, int]:
    bits = _pack_bits(size)
    narrow = -(-width >> bits)
    grid = np.zeros((height, narrow << bits), np.uint32)
    grid[:, :width] = index.reshape(height, width)
    grid = grid.reshape(height, narrow, 1 << bits) << (np.arange(1 << bits) * (8 >> bits)).astype(np.uint32)
    return np.bitwise_or.reduce(grid, axis=2).reshape(-1) << 8 | np.uint32(0xFF000000), narrow


def _argb(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels.reshape(-1, 4)[:, [2, 1, 0, 3]].astype(np.uint8)).view("<u4").reshape(-1).astype(np.uint32)


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = True, block: int = 2, modes: np.ndarray | None = None, factors: np.ndarray | None = None) -> bytes:
    """A WebP file of height x width x RGBA, with the named transforms in turn."""
    height, width = pixels.shape[:2]
    px, out, wide = _argb(pixels), _head(width, height), width
    for kind in transforms:
        n = _blocks(wide, height, block)
        if kind == PREDICTOR:
            px = _write_predictor(out, px, wide, block, np.resize(np.asarray(modes if modes is not None else [11]), n).astype(np.uint32) << 8)
        elif kind == CROSS_COLOUR:
            px = _write_cross(out, px, wide, block, np.resize(np.asarray(factors if factors is not None else [0x00102030]), n).astype(np.uint32))
        elif kind == SUBTRACT_GREEN:
            px = _write_green(out, px)
        else:
            colours, index = np.unique(px, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more colours than a palette holds")
            px, wide = _write_palette(out, px, wide, height, colours, index)
    out(0, 1)
    Plan(px, wide, cache_bits, copies(px) if references else _NO_COPIES).write(out, True)
    return _file(out.bytes())


#: What the encoder tries: cross-colour factors (in 32nds) and predictor modes; the bits of its cache, and the side of its tiles.
FACTORS, MODES, CACHE, TILE = (0, -16, 16, 32), (1, 2, 4, 11), 7, 4
#: The transform of an image, by its checksum.
DEALT = (SUBTRACT_GREEN, CROSS_COLOUR, PREDICTOR, PALETTE)
_RESIDUAL_BITS = np.log2(1 + np.minimum(np.arange(256), 256 - np.arange(256)))


def _entropy(values: np.ndarray) -> float:
    c = np.bincount(values)
    c = c[c > 0]
    return float((c * np.log2(c)).sum())


def _best_factors(px: np.ndarray) -> np.ndarray:
    """The factors that leave red and blue the least entropy, found one after another."""
    c = _channels(px)
    green, red = c[:, 1].view(np.int8).astype(np.int16), c[:, 2].view(np.int8).astype(np.int16)
    left, factors = [c[:, 2], c[:, 0]], 0
    for shift, of, by in ((0, 0, green), (8, 1, green), (16, 1, red)):
        tried = [(left[of] - (k * by >> 5)).astype(np.uint8) for k in FACTORS]
        k = max(range(len(FACTORS)), key=lambda i: _entropy(tried[i]))  # noqa: B023
        left[of] = tried[k]
        factors |= (FACTORS[k] & 255) << shift
    return np.array([factors], np.uint32)


def _best_modes(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """The mode of each tile whose residuals are the least."""
    across, down = -(-width >> TILE), -(-height >> TILE)
    if height == 1:
        return np.zeros(across, np.uint32)
    c = _channels(px)
    around = _all_neighbours(c, width)
    y, x = np.divmod(np.arange(width, len(px)), width)
    tile = (y >> TILE) * across + (x >> TILE)
    cost = np.array([np.bincount(tile, _RESIDUAL_BITS[(c[width:] - predicted(k, *around)).astype(np.uint8)].sum(1), minlength=across * down) for k in MODES])
    return np.array(MODES, np.uint32)[cost.argmin(0)] << np.uint32(8)


def encode_dealt(px: np.ndarray, width: int, height: int) -> bytes:
    """The file of the ARGB values px. Every image gets a transform, and its checksum
    says which (DEALT): a table holds streams of every kind, and reading it inverts them
    all. The transform's parameters are picked by what they leave to code; an image of
    over 256 colours has no palette and gets cross-colour instead."""
    out, kind = _head(width, height), DEALT[zlib.crc32(px.astype("<u4").tobytes()) % len(DEALT)]
    if kind == PALETTE:
        colours, index = np.unique(px, return_inverse=True)
        if len(colours) <= 256:
            px, width = _write_palette(out, px, width, height, colours, index)
        else:
            kind = CROSS_COLOUR
    if kind == SUBTRACT_GREEN:
        px = _write_green(out, px)
    elif kind == CROSS_COLOUR:
        px = _write_cross(out, px, width, 9, np.resize(_best_factors(px), _blocks(width, height, 9)))
    elif kind == PREDICTOR:
        px = _write_predictor(out, px, width, TILE, _best_modes(px, width, height))
    out(0, 1)
    Plan(px, width, CACHE, copies(px)).write(out, True)
    return _file(out.bytes())


def store(text: bytes | None) -> tuple[bytes, int]:
    """The media bytes of a text, and its length without padding: images of 16-pixel
    rows whose RGBA samples are the text's bytes and zeros up to 64 bytes a row."""
    raw = text or b""
    step = 4 * ROW_PIXELS
    n = max(step, -(-len(raw) // step) * step)
    payload = np.zeros(n, np.uint8)
    payload[: len(raw)] = np.frombuffer(raw, np.uint8)
    most = step * MOST_ROWS
    parts = (payload[k : k + most] for k in range(0, n, most))
    return b"".join(encode_dealt(_argb(p), ROW_PIXELS, len(p) // step) for p in parts), len(raw)


def load_parts(media: bytes) -> tuple[bytes, set]:
    """The payload (the samples of each image in the media bytes), and which PARTS they use."""
    out, at, met = [], 0, set()
    while at < len(media):
        if at + 8 > len(media):
            raise ValueError("the file ends early")
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        pixels, parts = decode_parts(media[at : at + size])
        out.append(pixels.tobytes())
        met |= parts
        at += size
    return b"".join(out), met


def load(media: bytes) -> bytes:
    return load_parts(media)[0]


def features(payload: bytes) -> str:
    """Plain statistics of the samples that were read back."""
    a = np.frombuffer(payload, np.uint8)
    h = np.bincount(a, minlength=256)
    return f"rows={len(a) // (4 * ROW_PIXELS)};sum={int(h.dot(np.arange(256)))};max={int(a.max())};zeros={int(h[0])};hist={'/'.join(map(str, h.reshape(8, 32).sum(1)))}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column (WebP bytes) of each row."""

    def each(batch):
        stored = [store(x) for x in utf8(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [n for _, n in stored], "media": [m for m, _ in stored]}

    return arrow_map(id_and_text(docs), each, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id and the pixel array of each row of doc_id, media."""

    def each(batch):
        return {"doc_id": batch.column("doc_id"), "pixels": [load(m) if m else b"" for m in utf8(batch.column("media"))]}

    return arrow_map(media.select("doc_id", "media"), each, "doc_id long, pixels binary", text="media")


def media_digest(docs: DataFrame) -> DataFrame:
    """Store each text, read it back, and report digests of both forms; parts names
    the transforms, references and cache that were read, in the order of PARTS."""
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "parts")

    def each(batch):
        rows = []
        for text in utf8(batch.column("text")):
            media, n = store(text)
            payload, met = load_parts(media)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload), ",".join(p for p in PARTS if p in met)))
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*rows, strict=True), strict=True))

    return arrow_map(id_and_text(docs), each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, parts string")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))
