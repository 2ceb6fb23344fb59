"""Copies of images by local descriptors.

1. Images with equal bytes are one image.
2. Multiscale corners: a Harris response at `SCALES` sizes, local maxima, the strongest
   `POINTS` over all sizes. Each corner is turned by the direction of its patch's
   intensity centroid and described by 256 binary tests of a smoothed patch.
3. Hamming-table join: the tests are cut into `TABLES` keys of 32 bits; descriptors that
   share a key meet. Two descriptors within TABLES - 1 flipped tests always share one.
   Of those that meet, only pairs with at most FLIPPED of the next 64 tests different vote.
   Images are dealt into parts, and each pair of parts is joined in a task of its own, where the votes of
   a pair of images are counted at once: links leave a task, votes don't.
4. Geometric consensus: each meeting votes for a change of size, a turn and a shift; a pair
   of images with at least `VOTES` different corners in each that agree is linked.
5. Links give classes; `class_id` is the least id reachable.

All descriptors that share a key meet, however many they are. Unlike images share common corners, so meetings
grow with the square of the descriptors of a key; a task holds `MEETINGS` of them at a time, and `ROUND` bounds what is shuffled at once,
so memory is bounded and disk grows with the images. `n_links`, the number of different images that
an image is linked to, is exact: all images of a class are compared with each other,
descriptors against descriptors, in tasks of at most BLOCK images a side that return a count for each image.

Images are PGM or PPM (P5, P6, 8 bits) or PNG (8 bits, not interlaced), of at most `PIXELS`
pixels and 65,535 a side. Null, empty and unreadable images (other formats too), and those without a corner, are classes of their own
unless bytes are equal; nulls are never equal. Repeated rows are equal images. An empty table gives an
empty result. Only the key and the two outputs are returned, so names of other columns can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .blocks import tidy
from .common import materialize, read, ship, write_table
from .components import components

SCALES = (1.0, 0.7, 0.5)
#: At most 64: a corner is a bit of a mask.
POINTS = 32
TABLES = 8
VOTES = 4
#: A key of more descriptors counts as common; its meetings count as others do.
DENSE = 16
#: Images of a part, on average: a task compares two parts.
CROWD = 8192
#: Few images are cut into so many parts.
SPREAD = 4
#: Parts whose comparisons are made in one job: a job shuffles each image at most twice as often.
ROUND = 8
#: Meetings that a task holds at a time.
MEETINGS = 1 << 21
#: Bins of a vote: half octaves of size, turns of 30 degrees, shifts of SHIFT pixels.
SHIFT = 12
RADIUS = 10
#: Of the 64 tests beside a shared key, so many at most may differ.
FLIPPED = 16
#: Images a side of a task that compares images.
BLOCK = 128
PIXELS = 1 << 26


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey values [row, column] as float32; None if the bytes are no image that is known."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while not data[end : end + 1].isspace():
                    end += 1
                head.append(int(data[at:end]))
                at = end
            w, h, top = head
            deep = 3 if data[:2] == b"P6" else 1
            if top != 255:
                return None
            return _grey(np.frombuffer(data, np.uint8, w * h * deep, at + 1).reshape(h, w, deep))
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, struct.error, zlib.error):
        pass
    return None


def _grey(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.float32)
    return a[:, :, 0] if a.shape[2] < 3 else a[:, :, :3] @ np.array([0.299, 0.587, 0.114], np.float32)


def _png(data: bytes) -> np.ndarray | None:
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    w, h, bits, color, _, _, interlaced = head
    deep = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if bits != 8 or interlaced or deep is None:
        return None
    if w * h > PIXELS:
        return None
    size = h * (1 + w * deep)
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), size), np.uint8).reshape(h, 1 + w * deep)
    out = np.zeros((h, w * deep), np.uint8)
    up = np.zeros(w * deep, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 2:
            line += up
        elif kind == 1:
            line = np.cumsum(line.reshape(w, deep), axis=0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            for x in range(len(line)):
                a = int(line[x - deep]) if x >= deep else 0
                b, c = int(up[x]), int(up[x - deep]) if x >= deep else 0
                p = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[x] = (int(line[x]) + p) & 255
        out[y] = up = line
    return _grey(out.reshape(h, w, deep))


def _smooth(a: np.ndarray) -> np.ndarray:
    """Binomial blur of width 5."""
    for axis in (0, 1):
        p = np.pad(a, [(2, 2) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        s = [p[i : i + a.shape[0]] if axis == 0 else p[:, i : i + a.shape[1]] for i in range(5)]
        a = (s[0] + s[4] + 4 * (s[1] + s[3]) + 6 * s[2]) / 16
    return a


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    h, w = int(a.shape[0] * scale), int(a.shape[1] * scale)
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(y.astype(int), 0, a.shape[0] - 2), np.clip(x.astype(int), 0, a.shape[1] - 2)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None].astype(np.float32)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x0 + 1] * fx
    low = a[y0 + 1][:, x0] * (1 - fx) + a[y0 + 1][:, x0 + 1] * fx
    return top * (1 - fy) + low * fy


@lru_cache(maxsize=1)
def _tests() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disc of a patch (dy, dx), and the two ends of each of 256 tests at each of 12 turns, [turn, test, (y, x)]."""
    rng = np.random.default_rng(2024)
    ends = np.clip(rng.normal(0, RADIUS / 2.2, (256, 2, 2)), -RADIUS + 2, RADIUS - 2)
    angle = np.arange(12) * np.pi / 6
    turn = np.stack([np.stack([np.cos(angle), np.sin(angle)], -1), np.stack([-np.sin(angle), np.cos(angle)], -1)], -2)  # rows give y, x
    placed = np.rint(np.einsum("tab,neb->tnea", turn, ends)).astype(int)
    disc = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])
    return disc, placed[:, :, 0], placed[:, :, 1]


def describe(grey: np.ndarray | None, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Places [point, (x, y, size, turn)] in pixels of the image, and descriptors [point, TABLES] of 32 bits."""
    none = np.zeros((0, 4), np.float32), np.zeros((0, TABLES), np.uint32)
    if grey is None or min(grey.shape) < 2 * RADIUS + 8 or max(grey.shape) >= 1 << 16:
        return none
    disc, one, two = _tests()
    found = []
    for scale in SCALES:
        a = _smooth(_resized(grey, scale))
        if min(a.shape) < 2 * RADIUS + 8:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        rows = np.maximum.reduce([r[i : r.shape[0] - 4 + i] for i in range(5)])
        top = np.maximum.reduce([rows[:, i : r.shape[1] - 4 + i] for i in range(5)])
        m = r[2:-2, 2:-2]
        peak = m >= top
        e = RADIUS + 1
        inner = np.zeros_like(peak)
        inner[e - 2 : -(e - 2), e - 2 : -(e - 2)] = True
        y, x = np.nonzero(peak & inner & (m > 1.0))
        y, x = y + 2, x + 2
        if not len(y):
            continue
        best = np.argsort(-r[y, x], kind="stable")[:points]
        y, x = y[best], x[best]
        patch = a[y[:, None] + disc[:, 0], x[:, None] + disc[:, 1]]
        patch = patch - patch.min(axis=1, keepdims=True)
        angle = np.arctan2(patch @ disc[:, 0].astype(np.float32), patch @ disc[:, 1].astype(np.float32))
        turn = np.rint(angle / (np.pi / 6)).astype(int) % 12
        p, q = one[turn], two[turn]
        bits = a[y[:, None] + p[:, :, 0], x[:, None] + p[:, :, 1]] < a[y[:, None] + q[:, :, 0], x[:, None] + q[:, :, 1]]
        keys = np.packbits(bits, axis=1, bitorder="little").view("<u4")
        found.append((r[y, x], np.stack([(x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), 1 / scale), turn], 1).astype(np.float32), keys))
    if not found:
        return none
    strength, place, keys = (np.concatenate([f[i] for f in found]) for i in range(3))
    best = np.argsort(-strength, kind="stable")[:points]
    return place[best], keys[best]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, image) -> (id, sum of the bytes, packed descriptors): the images themselves go no further."""
    for batch in batches:
        sums, packed = [], []
        for image, data in zip(batch.column("id").to_pylist(), batch.column("image").to_pylist(), strict=True):
            place, keys = describe(decode_image(data))
            sums.append(f"null {image}" if data is None else hashlib.sha256(data).hexdigest())
            scale = np.argmin(np.abs(1 / place[:, 2:3] - np.array(SCALES)[None]), axis=1) if len(place) else np.empty(0)
            spot = [place[:, 0].astype(np.int64) << 32, place[:, 1].astype(np.int64) << 16, scale.astype(np.int64) << 12, place[:, 3].astype(np.int64) << 8, np.arange(len(place))]
            packed.append(sum(spot).astype("<i8").tobytes() + keys.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sums, pa.string()), pa.array(packed, pa.binary())], names=["id", "sum", "packed"])


def _change(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The vote of each meeting, in one number: shift, turn and size from the left corner to the right one, and both corners."""
    (x, y, size, turns), (x2, y2, size2, turns2) = (((s >> 32).astype(float), (s >> 16 & 0xFFFF).astype(float), 1 / np.array(SCALES)[s >> 12 & 15], s >> 8 & 15) for s in (left, right))
    ratio = size2 / size
    angle = (turns2 - turns) * (np.pi / 6)
    cos, sin = ratio * np.cos(angle), ratio * np.sin(angle)
    octave = np.rint(2 * np.log2(ratio)).astype(np.int64)
    qx, qy = (np.floor(2 * v / SHIFT).astype(np.int64) & 0x7FFF for v in (x2 - cos * x + sin * y, y2 - sin * x - cos * y))
    return (right & 63) << 45 | (((qx << 15 | qy) << 4 | (turns2 - turns) % 12) << 5 | (octave & 0x1F)) << 6 | left & 63


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (8 + 4 * TABLES)
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<u4", n * TABLES, 8 * n).reshape(n, TABLES)


def _beside(keys: np.ndarray) -> np.ndarray:
    """The 64 tests beside each key."""
    wide = keys.astype(np.uint64)
    return np.roll(wide, -1, axis=-1) << np.uint64(32) | np.roll(wide, -2, axis=-1)


def agreeing(one: tuple[np.ndarray, np.ndarray], owner: np.ndarray, spots: np.ndarray, keys: np.ndarray, votes: int = VOTES) -> np.ndarray:
    """Owners of descriptors that are linked to the image `one` (spots, keys): what the join finds, without a join."""
    i, j, k = np.nonzero(one[1][:, None, :] == keys[None, :, :])
    near = np.bitwise_count(_beside(one[1])[i, k] ^ _beside(keys)[j, k]) <= FLIPPED
    i, j = i[near], j[near]
    change = _change(one[0][i], spots[j])
    qx, qy = change >> 30 & 0x7FFF, change >> 15 & 0x7FFF
    found = []
    for half in (0, 1):
        rows = np.stack([owner[j], change >> 6 & 511, (qx + half) >> 1, (qy + half) >> 1], axis=1)
        bins, own = np.unique(rows, axis=0, return_inverse=True)
        n = [np.bincount(np.unique(own.reshape(-1) << 6 | corner) >> 6, minlength=len(bins)) for corner in (change & 63, change >> 45)]
        found.append(bins[np.minimum(*n) >= votes, 0])
    return np.unique(np.concatenate(found))


@dataclass
class Side:
    """The corners of some images, sorted by image: ids, and of each corner the image's place, its spot, its keys and the 64 tests beside each."""

    ids: np.ndarray
    owner: np.ndarray
    spots: np.ndarray
    keys: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, packed: list[bytes]) -> Side:
        images = [_unpacked(x) for x in packed]
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x[0]) for x in images])
        keys = np.concatenate([x[1] for x in images])
        return cls(ids, owner, np.concatenate([x[0] for x in images]), keys, _beside(keys))

    def cut(self, first: int, end: int) -> Side:
        a, b = np.searchsorted(self.owner, [first, end]).tolist()
        return Side(self.ids[first:end], self.owner[a:b] - first, self.spots[a:b], self.keys[a:b], self.rest[a:b])

    def codes(self) -> np.ndarray:
        return (np.arange(TABLES, dtype=np.int64)[None] << 32 | self.keys.astype(np.int64)).reshape(-1)


def _most(pair: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Of each pair (numbered from 0), the most corners that agree on one change. Two grids of shifts, so neighbours across an edge agree in one."""
    most = np.zeros(int(pair.max()) + 1, np.int64)
    for half in (0, 1):
        code = ((pair << 9 | change >> 6 & 511) << 15 | ((change >> 30 & 0x7FFF) + half) >> 1) << 15 | ((change >> 15 & 0x7FFF) + half) >> 1
        bins, own = np.unique(code, return_inverse=True)
        n = [np.bincount(np.unique(own.reshape(-1) << 6 | corner) >> 6, minlength=len(bins)) for corner in (change & 63, change >> 45)]
        np.maximum.at(most, bins >> 39, np.minimum(*n))
    return most


def _between(left: Side, right: Side, own: bool, votes: int, meetings: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The linked pairs (a, b, votes) of images of two sides, or of one (own: `right` is `left` or a piece of it). Some `meetings` are
    held at a time: the left side is cut into runs of images, and for an image that meets more by itself the right side into halves."""
    asked, given = left.codes(), right.codes()
    order = np.argsort(given, kind="stable")
    given, rest, corner = given[order], right.rest.reshape(-1)[order], (order // TABLES).astype(np.int32)
    by_key = np.argsort(asked, kind="stable")
    low, count = np.empty(len(asked), np.int64), np.empty(len(asked), np.int64)
    low[by_key] = np.searchsorted(given, asked[by_key])
    count[by_key] = np.searchsorted(given, asked[by_key], "right")
    count -= low
    n, width = len(left.ids), len(right.ids)
    entry = np.searchsorted(left.owner, np.arange(n + 1)) * TABLES
    total = np.concatenate([[0], np.cumsum(count)])[entry]
    at = 0
    while at < n:
        end = min(n, at + max(1, (1 << 22) // width), max(at + 1, int(np.searchsorted(total, total[at] + meetings, "right")) - 1))
        if total[end] - total[at] > meetings and width > 1:
            for first, last in ((0, width // 2), (width // 2, width)):
                yield from _between(left.cut(at, end), right.cut(first, last), own, votes, meetings)
            at = end
            continue
        one = np.repeat(np.arange(entry[at], entry[end], dtype=np.int32), count[entry[at] : entry[end]])
        two = np.arange(len(one)) + np.repeat((low - (np.cumsum(count) - count))[entry[at] : entry[end]] + total[at], count[entry[at] : entry[end]])
        near = np.bitwise_count(left.rest.reshape(-1)[one] ^ rest[two]) <= FLIPPED
        one, two = one[near] // TABLES, corner[two[near]]
        a, b = left.owner[one], right.owner[two]
        if own:
            use = left.ids[a] < right.ids[b]
            one, two, a, b = one[use], two[use], a[use], b[use]
        pair = (a.astype(np.int64) - at) * width + b
        use = np.bincount(pair, minlength=1)[pair] >= votes  # fewer meetings than corners that a link needs
        one, two = one[use], two[use]
        pairs, pair = np.unique(pair[use], return_inverse=True)
        if len(pairs):
            turned = (left.ids[at + pairs // width] > right.ids[pairs % width])[pair]
            spots = left.spots[one], right.spots[two]
            most = _most(pair, _change(np.where(turned, spots[1], spots[0]), np.where(turned, spots[0], spots[1])))
            good = most >= votes
            ends = left.ids[at + pairs[good] // width], right.ids[pairs[good] % width]
            yield np.minimum(*ends), np.maximum(*ends), most[good]
        at = end


def _forest(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of linked pairs, those that join what the pairs before them left apart."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for links in found:
        use = []
        for i, (a, b) in enumerate(zip(links[0].tolist(), links[1].tolist(), strict=True)):
            a, b = top(a), top(b)
            if a != b:
                root[b] = a
                use.append(i)
        yield tuple(x[use] for x in links)


def _linked(votes: int, meetings: int, forest: bool):
    """Over the rows (i, j, part, id, packed) of two parts of the images (of one, if i = j): linked pairs between them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tidy()
        table = table.sort_by("id")
        sides = []
        for k in dict.fromkeys(x.as_py() for x in key):
            own = table.filter(pc.equal(table.column("part"), k))
            if own.num_rows:
                sides.append(Side.of(own.column("id").to_numpy(), own.column("packed").to_pylist()))
        own = key[0].as_py() == key[1].as_py()
        found = _between(sides[0], sides[-1], own, votes, meetings) if own or len(sides) > 1 else iter(())
        rows = [(np.empty(0, np.int64),) * 3, *(_forest(found) if forest else found)]
        return pa.table({name: np.concatenate([r[i] for r in rows]) for i, name in enumerate(("a", "b", "votes"))})

    return run


def links(images: DataFrame, votes: int = VOTES, forest: bool = False) -> DataFrame:
    """(id, packed descriptors) of distinct images -> linked pairs (a, b, votes); with `forest`, of each task only those that join images
    which the task has not joined yet."""
    spark = images.sparkSession
    n = images.count()
    parts = max(-(-n // CROWD), min(SPREAD, -(-n // 512)), 1)
    block = images.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "packed")
    schema, out = "a long, b long, votes long", []
    for first in range(0, parts, ROUND):
        last = min(first + ROUND, parts)
        # The pairs (i, j) of this round have i in it and j >= i: a part of the round meets all parts from the first on, later parts the round's.
        met = block.where(F.col("part") >= first).withColumn("o", F.explode(F.sequence(F.lit(first), F.when(F.col("part") < last, parts - 1).otherwise(last - 1))))
        paired = met.select(F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "id", "packed")
        dealt = paired.repartition(2 * (last - first) * (parts - first), "i", "j")
        out.append(write_table(dealt.groupBy("i", "j").applyInArrow(_linked(votes, MEETINGS, forest), schema), "media-pairs"))
    return spark.read.schema(schema).parquet(*out)


def described(rows: DataFrame) -> DataFrame:
    """(id, image) -> (id, sum, packed), written once."""
    ship(rows.sparkSession)
    return materialize(rows.mapInArrow(_described, "id long, sum string, packed binary"), "media-described")


def _compare(votes: int):
    """Over the rows (group, i, j, part, id, packed) of two parts of a class: how many images of the other part (of the own one, if
    i = j) each image is linked to."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids, part = (table.column(c).to_numpy()[order] for c in ("id", "part"))
        images = [_unpacked(x) for x in table.column("packed").take(pa.array(order)).to_pylist()]
        own, n = key[1].as_py() == key[2].as_py(), len(ids)
        owner = np.repeat(np.arange(n), [len(x[0]) for x in images])
        spots, keys = np.concatenate([x[0] for x in images]), np.concatenate([x[1] for x in images])
        first = np.searchsorted(owner, np.arange(n), "right")
        count = np.zeros(n, np.int64)
        for x in range(n):
            use = np.arange(int(first[x]), len(owner))
            use = use if own else use[part[owner[use]] != part[x]]
            if len(use):
                found = agreeing(images[x], owner[use], spots[use], keys[use], votes)
                count[x] += len(found)
                count[found] += 1
        return pa.table({"id": ids, "n": count})

    return run


def degrees(members: DataFrame, images: DataFrame, votes: int = VOTES) -> DataFrame:
    """`members` (group, id) -> (id, n_links): all images of a group compared, each pair of parts of it in a task."""
    parts = members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    block = members.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    paired = block.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.select("group", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "id")
    counted = paired.join(images, "id").groupBy("group", "i", "j").applyInArrow(_compare(votes), "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n_links"))


def classes(images: DataFrame, votes: int = VOTES) -> DataFrame:
    """(id, packed) of distinct images -> (id, class): the least id that links reach."""
    found = links(images, votes, forest=True).select("a", "b")
    rooted = components(found, "media-components")
    return images.select("id").join(rooted, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("class"))


def copies(df: DataFrame, key: str = "media_id", image: str = "image", votes: int = VOTES) -> DataFrame:
    """(key, class_id, n_links): the least key among an image's copies, and how many different images it is linked to directly."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(image).alias("image"))
    marked = described(rows)
    own = materialize(marked.groupBy("sum").agg(F.min("id").alias("owner")), "media-owners")
    first = own.where("owner is not null").select(F.col("owner").alias("id"), "sum")
    images = marked.join(first, ["id", "sum"]).where(F.octet_length("packed") > 0).groupBy("id").agg(F.min("packed").alias("packed"))
    images = materialize(images, "media-images")
    rooted = materialize(classes(images, votes), "media-rooted")
    shared = rooted.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    degree = degrees(rooted.join(shared, "class", "left_semi").select(F.col("class").alias("group"), "id"), images, votes)
    named = own.select("sum", "owner").join(rooted.join(degree, "id", "left").select(F.col("id").alias("owner"), "class", "n_links"), "owner", "left")
    named = named.select("sum", F.coalesce("class", "owner").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return marked.select("id", "sum").join(named, "sum").select(F.col("id").alias(key), "class_id", "n_links")


SIDE, CANVAS = 96, 112


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    rng = np.random.default_rng(7)
    fy, fx = np.fft.fftfreq(CANVAS)[:, None], np.fft.fftfreq(CANVAS)[None]
    f = np.hypot(fy, fx)
    band = np.exp(-((f - 0.06) ** 2) / (2 * 0.03**2))
    noise = np.fft.ifft2(np.fft.fft2(rng.normal(size=(64, CANVAS, CANVAS))) * band).real
    return (noise / noise.std(axis=(1, 2), keepdims=True)).reshape(64, -1).astype(np.float32)


def render(vectors: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """A picture for each vector: near vectors, near pictures; each cropped, brightened and stretched in contrast by its id."""
    flat = vectors.astype(np.float32) @ _basis()[: vectors.shape[1]]
    out = []
    for picture, i in zip(flat.reshape(-1, CANVAS, CANVAS), ids.tolist(), strict=True):
        e = zlib.crc32(str(i).encode())
        y, x = e & 15, e >> 4 & 15
        grey = 128 + (e >> 8 & 15) - 8 + (30 + (e >> 12 & 15)) * picture[y : y + SIDE, x : x + SIDE]
        out.append(b"P5\n%d %d\n255\n" % (SIDE, SIDE) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes())
    return out


def pictures(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, image): the driver's tables hold no media, so each row of `embeddings` becomes a picture. A null vector gives a null image."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vectors = batch.column("v").to_pylist()
                ok = [i for i, v in enumerate(vectors) if v is not None and len(v) <= 64 and None not in v]
                images: list[bytes | None] = [None] * len(vectors)
                if ok:
                    full = np.zeros((len(ok), 64), np.float32)
                    for j, i in enumerate(ok):
                        full[j, : len(vectors[i])] = vectors[i]
                    ids = np.array([batch.column("k")[i].as_py() for i in ok])
                    for i, image in zip(ok, render(full, ids), strict=True):
                        images[i] = image
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(images, pa.binary())], names=["k", "image"])

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    return rows.mapInArrow(run, T.StructType([T.StructField("k", T.LongType()), T.StructField("image", T.BinaryType())])).withColumnRenamed("k", key)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = pictures(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return copies(images, "vec_id")
