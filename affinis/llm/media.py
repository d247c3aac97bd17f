"""Copies among images by local descriptors, also cropped, rotated or edited ones.

Corners at several scales, a sixth of an octave apart from an enlarged image on, get an orientation and a string of
binary tests turned by it. The tests span a patch wide enough that the strings of unrelated images seldom agree. Parts
of the strings are keys of Hamming tables: strings within 7 of 352 bits agree on one of 8 parts. Images that meet in a table are pairs if
enough of their corners agree on one similarity transform; links join into classes.

Each image is first compared with the hub (smallest id) that it meets most often. Of what then lies in different classes
still, every pair that shares enough keys is compared: pairs that meet in small buckets only come from a join, members
of larger buckets are compared in blocks as arrays. So no bucket is expanded into rows of all its pairs, and none is cut.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import Scratch, arrow_limits

#: Radius of the tests and of the patch that gives the orientation; corners that must agree, error in pixels.
RADIUS, TURNED_BY, AGREE, ERROR = 16, 12, 5, 3.0
#: A sixth of an octave apart, so that a copy of any size from half to double has a level within 6 % of one of the original.
#: Enlarged levels give small copies corners far enough from their borders.
SCALES = tuple(2 ** (k / 6) for k in range(-4, 4))
#: Corners in a bucket that is joined (larger ones are compared in blocks), corners in a block, matches expanded at a time.
SMALL, BLOCK, MATCHES = 16, 60_000, 1 << 21
#: Hamming tables, bits of a string in each; prepared blocks that a task keeps.
_TABLES, _WORD, _HELD = 8, 44, 12


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM (8 bits), or of a PNG (8 bits, grey or RGB, with or without alpha, not
    interlaced); null for what is none of these or broken."""
    if not data:
        return None
    try:
        return _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _pnm(data)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.uint8)
    return np.rint(pixels[:, :, :3].astype(float) @ [0.299, 0.587, 0.114]).astype(np.uint8)


def _pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    channels = {b"P5": 1, b"P6": 3}[data[:2]]
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    if top != 255:
        raise ValueError("only 8 bits")
    return _grey(np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels))


def _png(data: bytes) -> np.ndarray:
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced:
        raise ValueError("only 8 bits, not interlaced")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.int64)
    above = np.zeros((width, channels), np.int64)
    for y in range(height):
        line = rows[y, 1:].astype(np.int64).reshape(width, channels)
        how = rows[y, 0]
        if how == 2:
            line = (line + above) & 255
        elif how == 1:
            line = np.cumsum(line, axis=0) & 255
        elif how in (3, 4):
            left = np.zeros(channels, np.int64)
            corner = np.zeros(channels, np.int64)
            for x in range(width):
                if how == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    d = np.abs(np.stack([p - left, p - above[x], p - corner]))
                    guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above[x], corner))
                line[x] = left = (line[x] + guess) & 255
                corner = above[x]
        out[y] = above = line
    return _grey(out)


def _box(stack: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1, edges repeated."""
    padded = np.pad(stack, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(axis=1).cumsum(axis=2)
    n = 2 * r + 1
    return padded[:, n:, n:] - padded[:, :-n, n:] - padded[:, n:, :-n] + padded[:, :-n, :-n]


def _smaller(image: np.ndarray, scale: float) -> np.ndarray:
    """An image at 1 / scale, bilinear; larger than it is if scale is below 1."""
    if scale == 1.0:
        return image
    h, w = int(image.shape[0] / scale), int(image.shape[1] / scale)
    y, x = (np.arange(h) + 0.5) * scale - 0.5, (np.arange(w) + 0.5) * scale - 0.5
    y0, x0 = np.clip(y.astype(int), 0, image.shape[0] - 2), np.clip(x.astype(int), 0, image.shape[1] - 2)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    a, b, c, d = (image[y0 + i][:, x0 + j] for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)))
    return (a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy


_random = np.random.default_rng(20)
_TESTS = _random.normal(0, RADIUS / 2, (16 * _TABLES * _WORD, 2, 2))
_TESTS = _TESTS[(np.hypot(_TESTS[:, :, 0], _TESTS[:, :, 1]) <= RADIUS).all(axis=1)][: _TABLES * _WORD]
_DISC = np.array([(y, x) for y in range(-TURNED_BY + 1, TURNED_BY) for x in range(-TURNED_BY + 1, TURNED_BY) if y * y + x * x < TURNED_BY * TURNED_BY])


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, angle, scale) in pixels of the image, and their tests as one word for each table."""
    places, words = [np.zeros((0, 4))], [np.zeros((0, _TABLES), np.int64)]
    for scale in SCALES:
        border = RADIUS + 1
        if min(image.shape) / scale < 2 * border + 3:
            break
        level = _box(_smaller(image.astype(np.float64), scale)[None], 1)[0] / 9
        soft = _box(level[None], 1)[0]
        gy, gx = np.gradient(level)
        xx, yy, xy = (_box(v[None], 2)[0] for v in (gx * gx, gy * gy, gx * gy))
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        around = np.pad(response, 1, constant_values=-np.inf)
        neighbours = np.max([around[1 + i : around.shape[0] - 1 + i, 1 + j : around.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], axis=0)
        peak = (response > neighbours) & (response > 1e-3 * max(response.max(), 1.0))
        peak[:border], peak[-border:], peak[:, :border], peak[:, -border:] = False, False, False, False
        y, x = np.nonzero(peak)
        if not len(y):
            continue
        disc = level[y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        angle = np.arctan2(disc @ _DISC[:, 0], disc @ _DISC[:, 1])
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        dy, dx = _TESTS[None, :, :, 0], _TESTS[None, :, :, 1]
        ty = np.rint(dx * sin + dy * cos).astype(int) + y[:, None, None]
        tx = np.rint(dx * cos - dy * sin).astype(int) + x[:, None, None]
        seen = soft[np.clip(ty, 0, level.shape[0] - 1), np.clip(tx, 0, level.shape[1] - 1)]
        words.append((seen[:, :, 0] < seen[:, :, 1]).reshape(-1, _TABLES, _WORD) @ (1 << np.arange(_WORD, dtype=np.int64)))
        places.append(np.stack([(x + 0.5) * scale - 0.5, (y + 0.5) * scale - 0.5, angle, np.full(len(x), scale)], axis=1))
    return np.concatenate(places), np.concatenate(words)


def agreeing(a: np.ndarray, b: np.ndarray, error: float = ERROR, enough: int | None = None) -> int:
    """The most corners of a (rows x, y, angle, scale, matched with b's) that one similarity transform takes to b's; the
    search ends where ``enough`` are found, and fewer than that count as none."""
    best, least = 0, enough or 1
    places = [np.rint(x[:, :2] / 3).astype(np.int64) @ [1 << 32, 1] for x in (a, b)]
    here, there = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    turns, grows = b[:, 2] - a[:, 2], b[:, 3] / a[:, 3]
    transforms = grows * np.exp(1j * turns)
    for k in range(len(a)):
        off = (here - here[k]) * transforms[k] + (there[k] - there)
        good = np.flatnonzero(off.real**2 + off.imag**2 <= (error * max(1.0, grows[k])) ** 2)
        if len(good) < max(best + 1, least):
            continue
        good = good[np.abs((turns[good] - turns[k] + np.pi) % (2 * np.pi) - np.pi) < 0.5]
        best = max(best, min(len(np.unique(x[good])) for x in places))
        if enough is not None and best >= enough:
            break
    return best if best >= least else 0


class _Images:
    """Images of a block: ids, classes so far, corners (image after image), and their keys, sorted, with the corner of each."""

    def __init__(self, held: pa.StructArray):
        self.ids, self.c = held.field("id").to_numpy(), held.field("c").to_numpy()
        counts = np.array([len(k) for k in held.field("keys")], np.int64) // _TABLES
        self.of = np.repeat(np.arange(len(self.ids)), counts)
        self.points = np.frombuffer(b"".join(held.field("points").to_pylist()), np.float32).reshape(-1, 4).astype(float)
        keys = held.field("keys").flatten().to_numpy()
        order = np.argsort(keys, kind="stable")
        self.keys, self.corner = keys[order], order // _TABLES


def _passing(a: np.ndarray, b: np.ndarray, agree: int) -> np.ndarray:
    """Which of many pairs with m matches each (arrays pairs x m x 4) have a match whose transform fits ``agree`` matches,
    places that coincide counted as often as they occur: all that agreeing() may accept."""
    out, m = np.zeros(len(a), bool), a.shape[1]
    step = max(1, MATCHES // (4 * m))
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        todo = np.arange(len(x))
        for k in range(m):
            p, q = x[todo], y[todo]
            turn, grow = q[:, k, 2] - p[:, k, 2], q[:, k, 3] / p[:, k, 3]
            cos, sin = (np.cos(turn) * grow)[:, None], (np.sin(turn) * grow)[:, None]
            dx, dy = p[:, :, 0] - p[:, k : k + 1, 0], p[:, :, 1] - p[:, k : k + 1, 1]
            ex = dx * cos - dy * sin + q[:, k : k + 1, 0] - q[:, :, 0]
            ey = dx * sin + dy * cos + q[:, k : k + 1, 1] - q[:, :, 1]
            # a little wider than agreeing(), which decides
            good = ex * ex + ey * ey <= ((ERROR * np.maximum(1.0, grow)) ** 2)[:, None] * 1.0001
            apart = np.abs((q[:, :, 2] - p[:, :, 2] - turn[:, None] + np.pi) % (2 * np.pi) - np.pi)
            hit = (good & (apart < 0.5001)).sum(axis=1) >= agree
            out[at + todo[hit]] = True
            todo = todo[~hit]
            if not len(todo):
                break
    return out


def _linked(x: _Images, y: _Images, agree: int) -> np.ndarray:
    """Pairs of ids (smaller, greater) of two blocks, in different classes, that ``agree`` corners link."""
    found = [np.zeros((0, 2), np.int64)]
    low, high = np.searchsorted(y.keys, x.keys, "left"), np.searchsorted(y.keys, x.keys, "right")
    some = np.flatnonzero(high > low)
    some = some[np.argsort(x.of[x.corner[some]], kind="stable")]  # image after image, so that a chunk has all of a pair
    image, n = x.of[x.corner[some]], (high - low)[some]
    ends = np.flatnonzero(np.append(np.diff(image) != 0, True)) + 1 if len(some) else np.zeros(0, int)
    total = np.concatenate([[0], np.cumsum(n)])
    start = 0
    while start < len(some):
        fits = ends[(ends > start) & (total[ends] - total[start] <= MATCHES)]
        end = int(fits[-1] if len(fits) else ends[ends > start][0])
        use, count = some[start:end], n[start:end]
        start = end
        left = np.repeat(x.corner[use], count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[use], count)
        right = y.corner[place]
        i, j = x.of[left], y.of[right]
        apart = x.c[i] != y.c[j]
        left, right, i, j = left[apart], right[apart], i[apart], j[apart]
        if not len(i):
            continue
        first, pair = i.min(), (i - i.min()) * len(y.ids) + j
        often = np.bincount(pair)[pair] >= agree
        match = np.unique(pair[often] * len(y.of) * len(x.of) + left[often] * len(y.of) + right[often])
        pair, match = np.divmod(match, len(y.of) * len(x.of))
        left, right = np.divmod(match, len(y.of))
        pairs, at, size = np.unique(pair, return_index=True, return_counts=True)
        for m in np.unique(size[size >= agree]):
            group = np.flatnonzero(size == m)
            rows = at[group][:, None] + np.arange(m)
            for part in np.array_split(np.arange(len(group)), max(1, len(group) * int(m) // MATCHES)):
                a, b = x.points[left[rows[part]]], y.points[right[rows[part]]]
                for k in np.flatnonzero(_passing(a, b, agree)):
                    if agreeing(a[k], b[k], enough=agree) >= agree:
                        s, t = divmod(int(pairs[group[part[k]]]), len(y.ids))
                        found.append(np.sort([[x.ids[first + s], y.ids[t]]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _compared(sides: DataFrame, agree: int) -> DataFrame:
    """Links (a, b) among rows of two blocks of images (columns one and two, named by p and q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, _Images] = OrderedDict()

        def prepared(name: int, value: pa.ListScalar) -> _Images:
            if name not in held:
                held[name] = _Images(value.values)
                if len(held) > _HELD:
                    held.popitem(last=False)
            held.move_to_end(name)
            return held[name]

        for batch in batches:
            for row in range(batch.num_rows):
                got = _linked(*(prepared(batch.column(k)[row].as_py(), batch.column(k + 2)[row]) for k in (0, 1)), agree)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return sides.select("p", "q", "one", "two").mapInArrow(run, "a long, b long").distinct()


def _sides(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids as blocks of one image each."""
    x, y = (placed.select(F.col("id").alias(k), F.array(F.struct("id", "c", "keys", "points")).alias(n)) for k, n in (("a", "one"), ("b", "two")))
    return pairs.join(x, "a").join(y, "b").withColumn("p", F.col("a")).withColumn("q", F.col("b"))


def _blocks(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """Every two blocks of about BLOCK corners, once. Their product reads the written blocks again instead of dealing copies."""
    parts = max(1, -(-(placed.agg(F.sum(F.size("keys"))).first()[0] or 0) // (_TABLES * BLOCK)))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("block").agg(F.collect_list(F.struct("id", "c", "keys", "points")).alias("held"))
    blocks = scratch.keep(dealt.repartition(min(parts, 12)), "blocks")
    x, y = blocks.select(F.col("block").alias("p"), F.col("held").alias("one")), blocks.select(F.col("block").alias("q"), F.col("held").alias("two"))
    return x.repartition(min(parts, 12)).join(y.repartition(min(parts, 12)).hint("shuffle_replicate_nl"), F.col("p") <= F.col("q"))


def image_copies(images: DataFrame, *, agree: int = AGREE) -> DataFrame:
    """Classes of images that show the same, by column image (encoded bytes) and image_id.

    Returns image_id, class_id (the smallest image_id reachable), corners (how many were described) and links (confirmed
    links to other representatives; images of one class already are not compared again), one row per row. Equal bytes
    are one representative, before any table is joined. Null, broken or featureless images and those with a null id are
    classes of their own; repeated ids share an answer; an empty table gives no rows; other columns are not read.
    """
    from affinis.llm.minhash import components

    spark = images.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "media")
    rows = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("image").cast("binary").alias("image")).withColumn("print", F.sha2("image", 256))
    reps = rows.filter("image is not null and image_id is not null").groupBy("print").agg(F.min("image_id").alias("rep"))
    reps = scratch.keep(reps, "reps")

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = decode_image(data)
                if image is None or min(image.shape, default=0) < 3:
                    continue
                at, words = describe(image)
                if len(at):
                    keys = words + (np.arange(_TABLES, dtype=np.int64) << _WORD)
                    yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([keys.ravel()], pa.list_(pa.int64())), pa.array([at.astype(np.float32).tobytes()], pa.binary())], names=["id", "keys", "points"])

    own = rows.join(reps.select(F.col("rep").alias("image_id"), "print"), ["image_id", "print"], "left_semi").dropDuplicates(["print"])
    found = scratch.keep(own.select("image_id", "image").mapInArrow(corners, "id long, keys array<long>, points binary"), "corners")
    counted = found.select("id", (F.size("keys") / _TABLES).cast("long").alias("corners"))
    keyed = found.select("id", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last").select("key", "hub")
    met = keyed.join(hubs, "key").filter("id <> hub").groupBy("hub", "id").agg(F.count("*").alias("n")).filter(F.col("n") >= agree)
    stars = scratch.keep(met.groupBy("id").agg(F.max_by("hub", F.struct("n", "hub")).alias("a")).select("a", F.col("id").alias("b")), "stars")
    scratch.free()
    links = scratch.keep(_compared(_sides(stars, found.withColumn("c", F.col("id"))), agree), "star-links")
    classes = components(links, scratch)
    # Joined anew where it is read: a written copy would hold all keys a second time.
    placed = found.join(scratch.keep(classes.withColumnRenamed("node", "id"), "star-classes"), "id", "left").select("id", F.coalesce("component", "id").alias("c"), "keys", "points")
    # Buckets whose members lie in different classes still.
    keyed = placed.select("id", "c", F.explode("keys").alias("key"))
    open_keys = scratch.keep(keyed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n"), "open")
    hot = scratch.keep(keyed.join(open_keys.filter(F.col("n") > SMALL), "key").select("id").distinct(), "hot")
    scratch.free()
    # Pairs of images that are not both in a large open bucket share small buckets only.
    small = keyed.join(open_keys.filter(F.col("n") <= SMALL).select("key"), "key")
    x = small.join(hot, "id", "left_anti").select("key", F.col("id").alias("i"), F.col("c").alias("ci"))
    few = x.join(small, "key").filter("ci <> c").groupBy(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= agree)
    more = scratch.keep(_compared(_sides(few.select("a", "b"), placed), agree), "few-links")
    across = scratch.keep(_compared(_blocks(placed.join(hot, "id", "left_semi"), scratch), agree), "block-links")
    links = links.union(more).union(across)
    classes = scratch.keep(components(links, scratch), "classes")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    out = rows.select("image_id", "print").join(reps, "print", "left")
    out = out.join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(counted.withColumnRenamed("id", "rep"), "rep", "left").join(degree.withColumnRenamed("id", "rep"), "rep", "left")
    answer = F.when(F.col("image_id").isNotNull(), F.coalesce("component", "rep", "image_id"))
    zero = F.lit(0).cast("long")
    return out.select("image_id", answer.alias("class_id"), F.coalesce("corners", zero).alias("corners"), F.coalesce("links", zero).alias("links"))


def rendered(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", side: int = 8, copy_every: int = 10) -> DataFrame:
    """Images (PGM) of vectors of 64 numbers: an 8 by 8 board of grey fields, each ``side`` pixels wide. Each vector
    whose id is divisible by ``copy_every`` has an edited copy too, with image_id -1 - vec_id: cropped, darker, and
    turned by a quarter if the id is odd after division. The tables have no images; this makes some of whole tables."""
    arrow_limits(vectors.sparkSession)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, out = [], []
            for one, v in zip(b["id"], b["v"], strict=True):
                if v is None or len(v) != 64 or any(c is None or not np.isfinite(c) for c in v):
                    continue
                levels = 128 + 100 * np.tanh(5 * np.asarray(v, float))
                image = np.kron(levels.reshape(8, 8), np.ones((side, side))).round().astype(np.uint8)
                ids.append(one)
                out.append(_as_pgm(image))
                if one % copy_every == 0:
                    copy = np.rint(image[3 : 7 * side + 5, side // 2 :] * 0.8 + 10).astype(np.uint8)
                    ids.append(-1 - one)
                    out.append(_as_pgm(np.rot90(copy) if one // copy_every % 2 else copy))
            yield pd.DataFrame({"image_id": pd.Series(ids, dtype="int64"), "image": pd.Series(out, dtype=object)})

    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter("id is not null").mapInPandas(draw, "image_id long, image binary")


def _as_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image).tobytes()
