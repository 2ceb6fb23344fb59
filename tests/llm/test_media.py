import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimworks.llm import media as M


def _pgm(a):
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    return b"P5\n# made\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def _png(a, kind):
    a = a.astype(np.uint8)
    h, w = a.shape
    rows = b""
    for y in range(h):
        line = a[y].astype(int)
        up = a[y - 1].astype(int) if y else np.zeros(w, int)
        left = np.concatenate([[0], line[:-1]])
        corner = np.concatenate([[0], up[:-1]])
        paeth = [min((abs(b - c), 0, l), (abs(l - c), 1, b), (abs(l + b - 2 * c), 2, c))[2] for l, b, c in zip(left, up, corner)]
        base = [0 * line, left, up, (left + up) // 2, np.array(paeth)][kind]
        rows += bytes([kind]) + ((line - base) & 255).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _scene(seed, side=160):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(side, side))
    for _ in range(6):
        a = M._smooth(a)
    return 128 + 45 * a / a.std()


def test_decoders():
    a = np.rint(np.clip(_scene(1, 48), 0, 255))
    for kind in range(5):
        assert (M.decode_image(_png(a, kind)) == a).all()
    assert (M.decode_image(_pgm(a)) == a).all()
    assert M.decode_image(b"P5\n9 9\n255\nxx") is None and M.decode_image(b"\x89PNG\r\n\x1a\nbad") is None and M.decode_image(b"GIF89a") is None


def test_copies_are_found(spark):
    rows = []
    for k in range(12):
        a = _scene(k)
        edits = [a, a[20:150, 10:140], a * 0.8 + 20, M._smooth(a), np.rot90(a), M._resized(a, 0.7)]
        rows += [(100 * k + i, _pgm(e)) for i, e in enumerate(edits)]
        rows.append((100 * k + 50, _pgm(a)))  # an exact copy
    rows += [(9000, None), (9001, None), (9002, b""), (9003, b"not an image"), (9004, b"not an image"), (9005, _pgm(np.full((80, 80), 7)))]
    df = spark.createDataFrame(rows, "media_id long, image binary").withColumn("class_id", F.lit(-1)).repartition(5)
    got = {r.media_id: r.class_id for r in M.copies(df).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        found = [i for i in (0, 1, 2, 3, 4, 5, 50) if got[100 * k + i] == 100 * k]
        assert {0, 1, 2, 3, 50} <= set(found) and len(found) >= 6, (k, found)
    assert [got[i] for i in (9000, 9001, 9003, 9004, 9005)] == [9000, 9001, 9003, 9003, 9005]
    assert all(got[i] % 100 == 0 or i >= 9000 or got[i] // 100 == i // 100 for i in got)
    assert M.copies(df.where("false")).count() == 0


def test_classes_and_links_against_all_pairs(spark, monkeypatch):
    """A hot group of crops, and unrelated images that share a common mark: every pair is compared here."""
    a, rng = _scene(3, 130), np.random.default_rng(0)
    images = [a[y : y + 110, x : x + 110] * (0.9 + 0.01 * (i % 9)) for i, (y, x) in enumerate(rng.integers(0, 20, (70, 2)).tolist())]
    mark = _scene(50, 60)
    for k in range(40):
        b = _scene(60 + k, 110)
        b[20:80, 20:80] = mark
        images.append(b)
    rows = [(i, _pgm(x)) for i, x in enumerate(images)]
    df = spark.createDataFrame(rows, "media_id long, image binary").withColumn("sum", F.lit("x")).repartition(4)
    found = {r.id: M._unpacked(r.packed) for r in M.described(df.select(F.col("media_id").alias("id"), "image")).collect()}
    label, links = dict.fromkeys(found, 0), Counter()
    label = {i: i for i in found}
    for i in sorted(found):
        for j in sorted(found):
            if j > i and len(M.agreeing(found[i], np.zeros(len(found[j][0]), int), *found[j])):
                links.update([i, j])
                label = {x: label[i] if y == label[j] else y for x, y in label.items()}
    least = {c: min(x for x, y in label.items() if y == c) for c in set(label.values())}
    monkeypatch.setattr(M, "BLOCK", 16)
    got = {r.media_id: (r.class_id, r.n_links) for r in M.copies(df).collect()}
    alike = Counter(i for i in found for j in found if i != j and got[i][0] == got[j][0])
    truly = {i: least[label[i]] for i in found}
    assert all(truly[i] == truly[got[i][0]] for i in found)  # no false class
    assert sum(n for _, n in got.values()) >= 0.97 * sum(links.values())  # recall of links over all pairs
    assert all(n <= links[i] for i, (_, n) in got.items()) and sum(n == links[i] for i, (_, n) in got.items()) >= 0.8 * len(got)
    assert len({c for c, _ in got.values()}) >= 2 and max(alike.values()) > 60
    # The join alone, where no key is dense, finds the same links.
    pairs = M.links(M.described(df.select(F.col("media_id").alias("id"), "image")).where("id % 9 = 0"))
    own = [i for i in found if i % 9 == 0]
    want = {(i, j) for i in own for j in own if i < j and len(M.agreeing(found[i], np.zeros(len(found[j][0]), int), *found[j]))}
    assert {(r.a, r.b) for r in pairs.collect()} == want


@pytest.mark.parametrize("crowd", [20, 4096])
def test_keys_of_many_descriptors_lose_no_link(spark, monkeypatch, crowd):
    """Unlike images that share a mark: most keys of its corners are held by all of them."""
    rng, mark, images = np.random.default_rng(1), _scene(50, 60), []
    for k in range(36):
        b = _scene(60 + k // 2, 110) * (1 - 0.1 * (k % 2)) + rng.normal(0, 3, (110, 110))
        b[20:80, 20:80] = mark + rng.normal(0, 3, (60, 60))
        images.append((k, _pgm(b)))
    described = M.described(spark.createDataFrame(images, "id long, image binary"))
    found = {r.id: M._unpacked(r.packed) for r in described.collect()}
    want = {(i, j) for i in found for j in found if i < j and len(M.agreeing(found[i], np.zeros(len(found[j][0]), int), *found[j]))}
    keys = Counter((t, int(k)) for _, rows in found.values() for row in rows for t, k in enumerate(row))
    assert max(keys.values()) > M.DENSE
    monkeypatch.setattr(M, "CROWD", crowd)
    assert {(r.a, r.b) for r in M.links(described).collect()} == want


def _marked(n):
    """Unlike images that share a mark, described."""
    rng, mark, images = np.random.default_rng(2), _scene(50, 60), []
    for k in range(n):
        b = _scene(100 + k, 110)
        b[20:80, 20:80] = mark + rng.normal(0, 3, (60, 60))
        images.append((7 * k, _pgm(b)))
    return images


def _shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_votes_stay_in_their_task(spark):
    """What is shuffled grows with the images, not with the meetings of their common corners."""
    described = M.described(spark.createDataFrame(_marked(60), "id long, image binary"))
    size = described.agg(F.sum(F.octet_length("packed"))).first()[0]
    before = _shuffled(spark)
    assert M.links(described).count() > 60
    assert _shuffled(spark) - before < 3 * size


def test_parts_rounds_and_runs_lose_no_link(spark, monkeypatch):
    described = M.described(spark.createDataFrame(_marked(30), "id long, image binary"))
    found = {r.id: M._unpacked(r.packed) for r in described.collect()}
    want = {(i, j) for i in found for j in found if i < j and len(M.agreeing(found[i], np.zeros(len(found[j][0]), int), *found[j]))}
    for name, value in (("CROWD", 5), ("ROUND", 4), ("MEETINGS", 40)):
        monkeypatch.setattr(M, name, value)
    rows = M.links(described).collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want) and min(r.votes for r in rows) >= M.VOTES
    tree = {(r.a, r.b) for r in M.links(described, forest=True).collect()}

    def groups(pairs):
        root = {i: i for i in found}
        for a, b in pairs:
            root = {x: root[a] if y == root[b] else y for x, y in root.items()}
        return {frozenset(x for x in found if root[x] == r) for r in root.values()}

    assert tree <= want and groups(tree) == groups(want)
