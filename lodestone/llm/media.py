"""Local image descriptors over a media column: copies that were cropped, edited, turned or resized are found by what they
share locally.

1. A map finds corners at several scales (local maxima of a structure-tensor response), turns the patch around each by the
   direction of its intensity centroid, and takes binary brightness tests of the smoothed patch: ``TABLES`` strings of 32 bits.
2. Hamming tables: a corner enters each table with its own string and that of its nearest neighbour of the same scale, so two
   images meet there if two corners beside each other agree in one string each, whatever their scale and turn, though other bits
   differ. One common patch alone makes no bucket. Of two corners that are each other's nearest the brighter one enters, for both.
3. Images that share too few keys with others for a link are left out. The others are dealt into blocks of ``BLOCK`` images, and
   blocks meet in tiles (``Tile``), in which each image is matched with all later ones that share a key and are not in its class
   yet. Within a tile, equal corners one line below the other are a run, and two runs are matched at once: the number of their
   pairs by shift is a trapezoid. So texts that repeat a word for pages cost their runs, not the square of their corners. Blocks
   are matched in themselves first; classes are those of all pairs.
4. Geometric consensus: a match proposes a ratio of sizes, a turn and a shift. Two images link when at least ``CONSENSUS``
   corners, and ``SHARE`` of the corners of the image that has fewer, propose the same.
5. Rasters that are equal byte for byte link by a 128-bit digest. Connected components give the class.

A media column holds grey rasters: width int, height int, pixels binary (row by row). Null or broken rasters, and those with
a side under ``SMALLEST`` pixels, which have no corners, link only if they are equal byte for byte (null pixels with nothing).
Ties in a response keep each maximum; very large rasters are read whole. Repeated rows share a class, as do different
rasters under one id; rows without an id are told apart by their raster. A class without any id is null. Further columns,
whatever their names, are ignored. An empty table gives no rows. Sizes may differ by factors of 1/4, 1/2, 2 or 4, made by
averaging or repeating pixels; turns are by quarter turns. Between these fewer corners agree, and mirror images do not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import components, discard, written
from lodestone.llm.units import held

PATCH, APART, TURNS, LEVELS, TABLES = 10, 8, 16, 3, 2
SMALLEST = 2 * PATCH + 6
LEAST_RESPONSE = 2e3
#: A test says darker only beyond this difference of brightness, so that even areas give the same bits under some noise.
MARGIN = 6
#: Corners, and share of the lesser image's corners, that make a link; width in pixels of a vote's shift.
CONSENSUS, SHARE, SHIFT = 6, 0.2, 4
#: Images of one batch; images of a block.
BATCH, BLOCK = 256, 1 << 14
#: Groups of two images that are held at a time.
PAIRS = 1 << 20
_rng = np.random.default_rng(20)
TESTS = np.clip(_rng.normal(0, PATCH / 2.5, (32 * TABLES, 4)), -PATCH + 4, PATCH - 4)
ANGLES = np.arange(TURNS) * 2 * np.pi / TURNS
TURNED = np.stack([np.rint(np.concatenate([TESTS[:, i : i + 2] @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) for i in (0, 2)], 1)) for a in ANGLES]).astype(np.int64)
_y, _x = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
MOMENTS = (np.stack((_x, _y, np.ones_like(_x)), 2) * (_x**2 + _y**2 <= PATCH**2)[..., None]).reshape(-1, 3).astype(np.float32)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Nodes of rows without an id are numbers from here on.
NO_ID = (1 << 63) - (1 << 61)


def box(a: np.ndarray) -> np.ndarray:
    a = a[:, :-2] + a[:, 1:-1] + a[:, 2:]
    return a[:-2] + a[1:-1] + a[2:]


def highest_near(a: np.ndarray, reach: int) -> np.ndarray:
    """Maximum over a square of reach in each direction, by doubling."""
    for axis in (0, 1):
        width, out = 1, np.pad(a, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)])
        while width < 2 * reach + 1:
            step = min(width, 2 * reach + 1 - width)
            n = out.shape[axis] - step
            out = np.maximum(out[:n], out[step:]) if axis == 0 else np.maximum(out[:, :n], out[:, step:])
            width += step
        a = out
    return a


def stacked(images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Images of one width below each other, and their first rows; gaps keep them from touching."""
    size = np.array([-(-(len(x) + APART + 1) // 2) * 2 for x in images])
    top = np.cumsum(size) - size
    out = np.zeros((int(size.sum()), images[0].shape[1]), np.float32)
    for x, y in zip(images, top.tolist(), strict=True):
        out[y : y + len(x)] = x
    return out, top


def described(images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners of images of one width: rows of (image, level, turn, x, y), places in half pixels of the whole image; strings;
    brightness."""
    found, strings, light = [np.zeros((0, 5), np.int64)], [np.zeros((0, TABLES), np.uint32)], [np.zeros(0, np.float32)]
    numbers = np.arange(len(images))
    for level in range(LEVELS):
        keep = [i for i, x in enumerate(images) if min(x.shape) >= SMALLEST]
        images, numbers = [images[i] for i in keep], numbers[keep]
        if not images:
            break
        img, top = stacked(images)
        width, heights = img.shape[1], np.array([len(x) for x in images])
        soft = box(img) / 9
        ix, iy = soft[1:-1, 2:] - soft[1:-1, :-2], soft[2:, 1:-1] - soft[:-2, 1:-1]
        a, b, c = box(ix * ix), box(iy * iy), box(ix * iy)
        r = np.sqrt(np.maximum(a * b - c * c - 0.04 * (a + b) ** 2, 0))
        # Row i of r is row i + 3 of the stack. Responses that reach over an image's edge don't count.
        within = np.zeros(len(r) + 6, bool)
        for y, h in zip(top.tolist(), heights.tolist(), strict=True):
            within[y + 3 : y + h - 3] = True
        r[~within[3:-3]] = 0
        y, x = np.nonzero((r >= LEAST_RESPONSE) & (r == highest_near(r, APART)))
        y, x = y + 3, x + 3
        of = np.searchsorted(top, y, side="right") - 1
        inside = (y - top[of] >= PATCH) & (y - top[of] < heights[of] - PATCH) & (x >= PATCH) & (x < width - PATCH)
        y, x, of = y[inside], x[inside], of[inside]
        if len(y):
            patch = np.lib.stride_tricks.sliding_window_view(img, (2 * PATCH + 1, 2 * PATCH + 1))[y - PATCH, x - PATCH]
            mx, my, total = (patch.reshape(len(y), -1) @ MOMENTS).T
            light.append(total)
            turn = np.rint(np.arctan2(my, mx) / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
            flat = soft.ravel()
            at = ((y - 1) * (width - 2) + x - 1)[:, None]
            t = TURNED[turn]
            bits = flat[at + t[..., 1] * (width - 2) + t[..., 0]] + MARGIN < flat[at + t[..., 3] * (width - 2) + t[..., 2]]
            strings.append(np.packbits(bits, axis=1).view(">u4").astype(np.uint32))
            found.append(np.stack((numbers[of], np.full(len(y), level), turn, (2 * x + 1) << level, (2 * (y - top[of]) + 1) << level), 1))
        half = (img[0::2, : width // 2 * 2 : 2] + img[1::2, : width // 2 * 2 : 2] + img[0::2, 1::2] + img[1::2, 1::2]) / 4
        images = [half[y // 2 : y // 2 + h // 2] for y, h in zip(top.tolist(), heights.tolist(), strict=True)]
    return np.concatenate(found), np.concatenate(strings), np.concatenate(light)


def nearest(of: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The nearest other point of each one's set, of two as near the earlier one; -1 where there is none. Points go by set, then y."""
    n = len(of)
    near, best = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
    for way in (-1, 1):
        here = np.arange(n)
        for step in range(1, n):
            here = here[(here + way * step >= 0) & (here + way * step < n)]
            there = here + way * step
            down = (y[there] - y[here]) ** 2
            # What comes later in this direction is no nearer in y.
            keep = (of[there] == of[here]) & (down <= best[here])
            here, there, down = here[keep], there[keep], down[keep]
            if not len(here):
                break
            d = down + (x[there] - x[here]) ** 2
            better = (d < best[here]) | ((d == best[here]) & (there < near[here]))
            best[here[better]], near[here[better]] = d[better], there[better]
    return near


def corners(images: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the images in their order, rows of (image, level, turn, x, y, corners that the entry stands for); their keys,
    one for each table; the number of corners of each image."""
    by_width: dict[int, list[int]] = {}
    for i, img in enumerate(images):
        if img is not None and min(img.shape) >= SMALLEST:
            by_width.setdefault(img.shape[1], []).append(i)
    parts = []
    for same in by_width.values():
        parts.append([])
        size = 0
        for i in same:  # stacks of about 256 k pixels stay in a processor's cache
            if size > 1 << 18:
                parts.append([])
                size = 0
            parts[-1].append(i)
            size += images[i].size
    got = [described([images[i] for i in part]) for part in parts]
    for part, (found, _, _) in zip(parts, got, strict=True):
        found[:, 0] = np.array(part)[found[:, 0]]
    none = (np.zeros((0, 5), np.int64), np.zeros((0, TABLES), np.uint32), np.zeros(0, np.float32))
    found, s, light = (np.concatenate(x) for x in zip(none, *got, strict=True))
    order = np.lexsort((found[:, 1], found[:, 0]))
    found, s, light = found[order], s[order], light[order]
    count = np.bincount(found[:, 0], minlength=len(images))
    near = nearest(found[:, 0] * LEVELS + found[:, 1], found[:, 4], found[:, 3])
    this = np.flatnonzero(near >= 0)  # a corner alone has nothing to stand beside
    other = near[this]
    mutual = near[other] == this
    enters = ~mutual | (light[this] > light[other]) | ((light[this] == light[other]) & (this < other))
    this, other, mutual = this[enters], other[enters], mutual[enters]
    k = (s[this].astype(np.uint64) << np.uint64(32) | s[other]) + np.arange(1, TABLES + 1, dtype=np.uint64) * MIX
    k = (k ^ (k >> np.uint64(31))) * MIX
    return np.column_stack((found[this], 1 + mutual)), (k ^ (k >> np.uint64(29))).view(np.int64), count


def votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(ratio, turn, dx, dy) that take corners a to corners b; columns as in ``corners``."""
    ratio, turn = b[:, 1] - a[:, 1], (b[:, 2] - a[:, 2]) % TURNS
    size, cos, sin = 2.0**ratio, np.cos(ANGLES)[turn], np.sin(ANGLES)[turn]
    dx, dy = b[:, 3] - size * (cos * a[:, 3] - sin * a[:, 4]), b[:, 4] - size * (sin * a[:, 3] + cos * a[:, 4])
    return np.stack((ratio, turn, *(np.floor(d / (2 * SHIFT) + 0.5).astype(np.int64) for d in (dx, dy))), 1)


def raster(width: int | None, height: int | None, pixels: bytes | None) -> np.ndarray | None:
    if width is None or height is None or width <= 0 or height <= 0 or pixels is None or len(pixels) != width * height:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def expanded(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from each first on, as many as its size says, and the place of the first that each belongs to."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - (np.cumsum(size) - size - first)[of], of


class Tile:
    """Images, by node, that are matched with each other. img, keys (TABLES, n) and at, packed places, are of their entries.

    A run is entries of one image, of equal keys, level, turn, weight and x, that follow at a vote's width in y.
    """

    def __init__(self, node: np.ndarray, comp: np.ndarray, n_corners: np.ndarray, img: np.ndarray, keys: np.ndarray, at: np.ndarray):
        self.node, self.comp, self.n = node, comp, n_corners
        known, k = np.unique(keys, return_inverse=True)
        k = k.reshape(keys.shape)
        low, high = np.full(len(known), len(node)), np.full(len(known), -1)
        for t in k:
            np.minimum.at(low, t, img)
            np.maximum.at(high, t, img)
        keep = (low < high)[k].any(0)  # keys of one image match nothing
        img, k, at = img[keep], k[:, keep], at[keep]
        col, y = at >> 28, at & ((1 << 28) - 1)
        cell, rest = y // (2 * SHIFT), y % (2 * SHIFT)
        order = np.lexsort((cell, rest, col, *k[::-1], img))
        same, cell = np.stack((img, *k, col, rest))[:, order], cell[order]
        new = np.append(True, (same[:, 1:] != same[:, :-1]).any(0) | (np.diff(cell) != 0))[: len(cell)]  # repeated rows
        same, cell = same[:, new], cell[new]
        first = np.flatnonzero(np.append(True, (same[:, 1:] != same[:, :-1]).any(0) | (np.diff(cell) != 1))[: len(cell)])
        self.img, self.k, self.col = same[0, first], same[1 : 1 + TABLES, first], same[-2, first]
        self.len = np.diff(np.append(first, len(cell)))
        self.y = cell[first] * (2 * SHIFT) + same[-1, first]
        self.w, self.scale, self.x = 1 + (self.col >> 27 & 1), self.col >> 28, self.col & ((1 << 27) - 1)
        self.at = np.searchsorted(self.img, np.arange(len(node) + 1))
        # Runs of one key and image are a group: the runs by group; by group its place in the order, image, start, size and weight.
        self.groups, self.of_image, self.group_at = [], [], []
        for t in self.k:
            place = t * len(node) + self.img
            order = np.argsort(place, kind="stable")
            place, start, size = np.unique(place[order], return_index=True, return_counts=True)
            image = place % len(node)
            weight = np.add.reduceat((self.w * self.len)[order], start) if len(start) else start
            self.groups.append((order, place, image, start, size, weight))
            self.of_image.append(np.argsort(image, kind="stable"))
            self.group_at.append(np.searchsorted(image[self.of_image[-1]], np.arange(len(node) + 1)))

    def meeting(self, a: int, ok: np.ndarray, least: np.ndarray, b0: int, b1: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Images of ok, from b0 to b1, that share enough keys with image a, each with the runs of a and its own that have a key in the
        same table. About PAIRS groups are held at a time; ok is looked at again for each image."""
        found = []
        for t, (_, place, *_) in enumerate(self.groups):
            mine = self.of_image[t][self.group_at[t][a] : self.group_at[t][a + 1]]
            base = place[mine] - a
            found.append((mine, np.searchsorted(place, base + b0), np.searchsorted(place, base + b1)))
        if b1 - b0 > 1 and sum(int((hi - lo).sum()) for _, lo, hi in found) > PAIRS:
            for part in ((b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)):
                yield from self.meeting(a, ok, least, *part)
            return
        tables, bound = [], np.zeros(b1 - b0)
        for t, (mine, lo, hi) in enumerate(found):
            r, of = expanded(lo, hi - lo)
            b = self.groups[t][2][r]
            keep = ok[b]
            l, r, b = mine[of[keep]], r[keep], b[keep] - b0
            bound += np.bincount(b, self.groups[t][5][l], b1 - b0)
            tables.append((b, l, r))
        can = bound >= least[b0:b1]  # no more corners of a can agree with b's
        order = [np.flatnonzero(can[b]) for b, _, _ in tables]
        order = [o[np.argsort(b[o], kind="stable")] for o, (b, _, _) in zip(order, tables, strict=True)]
        b, l, r = ([x[i][o] for x, o in zip(tables, order, strict=True)] for i in range(3))
        for one in np.flatnonzero(can).tolist():
            if not ok[b0 + one]:
                continue
            left, right = [], []
            for t, (runs, _, _, start, size, _) in enumerate(self.groups):
                some = slice(*np.searchsorted(b[t], (one, one + 1)))
                x, y = l[t][some], r[t][some]
                k, of = expanded(np.zeros(len(x), np.int64), size[x] * size[y])
                x, y = x[of], y[of]
                x, y = runs[start[x] + k // size[y]], runs[start[y] + k % size[y]]
                for earlier in range(t):  # they have met by that table
                    keep = self.k[earlier, x] != self.k[earlier, y]
                    x, y = x[keep], y[keep]
                left.append(x)
                right.append(y)
            yield b0 + one, np.concatenate(left), np.concatenate(right)

    def least(self, a: int) -> np.ndarray:
        return np.maximum(CONSENSUS, SHARE * np.minimum(self.n[a], self.n))

    def links(self, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Pairs of nodes that join two classes. apart: the images' blocks, if only images of different ones are to be matched."""
        now, out, numbers = np.unique(self.comp, return_inverse=True)[1], [], np.arange(len(self.node))
        for a in range(len(self.node)):
            if self.at[a] == self.at[a + 1]:
                continue
            ok = (now != now[a]) & (numbers > a)
            if apart is not None:
                ok &= apart != apart[a]
            if not ok.any():
                continue
            least = self.least(a)
            for b, left, right in self.meeting(a, ok, least, a + 1, len(self.node)):
                if self.linked(left, right, least[b]):
                    joined = now == now[b]
                    now[joined] = now[a]
                    ok[joined] = False
                    out.append((int(self.node[a]), int(self.node[b])))
        return out

    def linked(self, left: np.ndarray, right: np.ndarray, least: float) -> bool:
        """Whether corners that weigh so much propose the same. left, right: runs of two images that meet."""
        plain = self.scale[left] == self.scale[right]
        return self.shifted(left[plain], right[plain], least) or self.turned(left[~plain], right[~plain], least)

    def shifted(self, left: np.ndarray, right: np.ndarray, least: float) -> bool:
        """linked, of runs of one size and turn: their pairs differ by a shift only."""
        n, m, w = self.len[left], self.len[right], np.minimum(self.w[left], self.w[right])
        dx, dy = (np.floor((c[right] - c[left]) / (2 * SHIFT) + 0.5).astype(np.int64) for c in (self.x, self.y))
        line = np.unique(dx, return_inverse=True)[1]
        keep = (np.bincount(line, w * np.minimum(n, m)) >= least)[line]  # more than that agree on no shift in y
        if not keep.any():
            return False
        left, right, n, m, w, dy, line = (x[keep] for x in (left, right, n, m, w, dy, line))
        line = np.unique(line, return_inverse=True)[1]
        # Of runs of n and m entries min(i, n, m, n + m - i) pairs have the shift dy - n + i: slopes change at four places.
        low = dy - n + 1
        first, span = low.min(), int((dy + m).max() - low.min()) + 2
        at = line * span + low - first
        up, down = np.concatenate((at, at + n + m)), np.concatenate((at + n, at + m))
        size, both = (int(line.max()) + 1) * span, np.concatenate((w, w))
        found = (np.bincount(up, both, size) - np.bincount(down, both, size)).cumsum().cumsum()
        likely = np.flatnonzero(found >= least - 0.5)
        # An entry counts once for a shift, so what was found is a bound.
        for place in likely[np.argsort(-found[likely], kind="stable")].tolist():
            of, s = place // span, place % span + first
            j0, j1 = np.maximum(0, dy - s), np.minimum(n, m + dy - s)
            r = np.flatnonzero((line == of) & (j0 < j1))
            j, i = expanded(j0[r], (j1 - j0)[r])
            r = r[i]
            entry = self.col[left[r]] << 28 | self.y[left[r]] + 2 * SHIFT * j
            order = np.lexsort((-w[r], entry))
            once = np.append(True, np.diff(entry[order]) != 0)
            if w[r][order][once].sum() >= least:
                return True
        return False

    def turned(self, left: np.ndarray, right: np.ndarray, least: float) -> bool:
        """linked, of runs of which one is turned or of another size: each entry with each."""
        once = np.unique(left)
        if (self.w[once] * self.len[once]).sum() < least:
            return False
        k, of = expanded(np.zeros(len(left), np.int64), self.len[left] * self.len[right])
        l, r = left[of], right[of]
        ya, yb = self.y[l] + 2 * SHIFT * (k // self.len[r]), self.y[r] + 2 * SHIFT * (k % self.len[r])
        a, b = (np.stack((i, self.scale[i] >> 4, self.scale[i] & 15, self.x[i], y), 1) for i, y in ((l, ya), (r, yb)))
        bins = votes(a, b)
        bins -= bins.min(0)
        place = np.ravel_multi_index(tuple(bins.T), tuple(bins.max(0) + 1))
        found = np.sort(place)
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        likely = found[first][2 * np.diff(np.append(first, len(found))) >= least]  # an entry weighs two at most
        keep = np.flatnonzero(np.isin(place, likely)) if len(likely) else likely
        if not len(keep):
            return False
        place, entry, w = place[keep], (self.col[l] << 28 | ya)[keep], np.minimum(self.w[l], self.w[r])[keep]
        order = np.lexsort((-w, entry, place))
        place, entry, w = place[order], entry[order], w[order]
        new = np.append(True, (place[1:] != place[:-1]) | (entry[1:] != entry[:-1]))  # an entry counts once, by the larger number
        place, w = place[new], w[new]
        return bool(np.add.reduceat(w, np.flatnonzero(np.append(True, place[1:] != place[:-1]))).max() >= least)


def tile_links(group: pa.Table) -> pa.Table:
    """(a, b): links of the images of a tile; of a tile of two blocks, those between them."""
    group = group.sort_by([("node", "ascending")])
    if group.num_rows == 0:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    raw = group.column("node").to_numpy()
    node, first, where = np.unique(raw, return_index=True, return_inverse=True)
    n = group.column("n_corners").to_numpy()[first].astype(np.int64)
    entries = group.column("entries").combine_chunks()
    img = np.repeat(where, entries.value_lengths().to_numpy(zero_copy_only=False))
    part = lambda name: entries.flatten().field(name).to_numpy(zero_copy_only=False)
    blocks = group.column("block").to_numpy()[first]
    tile = Tile(node, group.column("comp").to_numpy()[first], n, img, np.stack([part(f"k{t}") for t in range(TABLES)]), part("at"))
    pairs = tile.links(blocks if (blocks != blocks[0]).any() else None)
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([x for _, x in pairs], pa.int64())})


def copies(media: DataFrame, key: str) -> DataFrame:
    """id, n_corners and class_id (smallest id of its class) of every row of the media column."""
    names = [*(f"k{t}" for t in range(TABLES)), "at"]
    entry = pa.list_(pa.struct([(c, pa.int64()) for c in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, BATCH) for x in batches for at in range(0, x.num_rows, BATCH)):
            ids, images, digests, nodes = b.column(0).to_pylist(), [], [], []
            seen: dict[bytes, int] = {}
            for i, *media in zip(ids, *(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                digest = None if media[2] is None else hashlib.sha256(f"{media[0]} {media[1]} ".encode() + media[2]).digest()[:16]
                nodes.append(NO_ID + (xxhash.xxh3_64_intdigest(repr((media[:2], digest))) >> 3) if i is None else i)
                # Of rasters that are equal the first one goes on.
                images.append(raster(*media) if digest not in seen else None)
                if digest is not None:
                    seen.setdefault(digest, len(digests))
                digests.append(digest)
            found, keys, count = corners(images)
            beside = [None if d is None or seen[d] == i else nodes[seen[d]] for i, d in enumerate(digests)]
            for i, d in enumerate(digests):
                if d is not None:
                    count[i] = count[seen[d]]
            cut = np.searchsorted(found[:, 0], np.arange(len(ids) + 1)).astype(np.int32)
            at = found[:, 1] << 60 | found[:, 2] << 56 | (found[:, 5] - 1) << 55 | found[:, 3] << 28 | found[:, 4]
            entries = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([*(pa.array(keys[:, t]) for t in range(TABLES)), pa.array(at)], names=names))
            whole = [d if d is not None and seen[d] == i else None for i, d in enumerate(digests)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(whole, pa.binary()), pa.array(count.astype(np.int32)), pa.array(beside, pa.int64()), entries.cast(entry)], names=["id", "node", "digest", "n_corners", "beside", "entries"])

    source = media.select(F.col(key).cast("long").alias("id"), "width", "height", "pixels")
    whole = written(source.mapInArrow(run, f"id long, node long, digest binary, n_corners int, beside long, entries array<struct<{','.join(f'{c}:long' for c in names)}>>"), "corners")
    rows = whole.drop("entries")
    first = F.lag("node").over(Window.partitionBy("digest").orderBy("node"))
    equal = written(rows.where("digest is not null").select("node", "digest", first.alias("b")).where("b < node"), "equal")
    # An entry weighs two at most, so images of fewer shared entries link with none.
    keys = whole.select("node", F.explode(F.concat(*(F.col(f"entries.{c}") for c in names[:-1]))).alias("key"))
    by_key = Window.partitionBy("key")
    shared = keys.select("node", (F.min("node").over(by_key) < F.max("node").over(by_key)).alias("shared")).where("shared")
    able = shared.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 2 >= CONSENSUS).select("node")
    size = rows.groupBy("node").agg(F.min("n_corners").alias("n_corners"))
    images = whole.where(F.size("entries") > 0).select("node", "digest", "entries").join(able, "node", "left_semi")
    images = images.join(equal.select("node", "digest"), ["node", "digest"], "left_anti").drop("digest").join(size, "node")
    images = written(images, "images")
    blocks = -(-images.count() // BLOCK)
    block = F.pmod(F.xxhash64("node"), F.lit(max(1, blocks))).cast("int")
    dealt = images.select("node", "n_corners", "entries", F.col("node").alias("comp"), block.alias("block"))
    links = dealt.groupBy("block").applyInArrow(tile_links, "a long, b long")
    links = links.union(equal.select("node", "b")).union(rows.where("beside is not null").select("node", "beside"))
    classes = written(components(links), "classes")
    if blocks > 1:
        placed = dealt.drop("comp").join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        tile = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("other <> block")
        tile = tile.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
        more = tile.groupBy("i", "j").applyInArrow(lambda group: tile_links(group.drop_columns(["i", "j"])), "a long, b long")
        classes = components(more.union(classes.select("node", "comp")))
    out = rows.join(classes, "node", "left")
    class_of = F.coalesce("comp", "node")
    return out.select(F.col("id").alias(key), "n_corners", F.when(class_of < NO_ID, class_of).alias("class_id"))


TAG = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->|<[^>]*>", re.S | re.I)
PAGE_WIDTH, LINE, BAR = 96, 4, 3


class Bars(dict):
    """A word's bar and the gap behind it; emptied when large."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = bytes([40 + xxhash.xxh3_64_intdigest(word) % 216]) * min(1 + len(word), 40) + b"\0"
        return got


def page_raster(html: str | None) -> tuple[int, int, bytes] | None:
    """A page's visible words set in lines, each word a bar whose length and brightness it gives."""
    if html is None:
        return None
    lines, line, x = [], [], 0
    for bar in map(held("bars", Bars).__getitem__, TAG.sub(" ", html).split()):
        if x + len(bar) - 1 > PAGE_WIDTH:
            lines.append(line)
            line, x = [], 0
        line.append(bar)
        x += len(bar)
    lines.append(line)
    blank = bytes(PAGE_WIDTH * (LINE - BAR))
    pixels = b"".join(b"".join(x)[:PAGE_WIDTH].ljust(PAGE_WIDTH, b"\0") * BAR + blank for x in lines)
    return PAGE_WIDTH, LINE * len(lines), pixels


def page_media(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, width, height, pixels: a media column made from pages. Null pages have a null raster; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = [page_raster(h) or (None, None, None) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], names=["id", "width", "height", "pixels"])

    return pages.select(F.col(key).cast("long"), F.col(html).cast("string")).mapInArrow(run, f"{key} long, width int, height int, pixels binary")
