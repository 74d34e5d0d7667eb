"""Tiles as packed bytes: reshaping, distance maps and statistics in numpy inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batches_of(items: Sequence, size: int) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield list(items[at : at + size])


def block_array(tile: np.ndarray, d: int) -> np.ndarray:
    """bands x n x n to blocks x bands x d x d in row-major order."""
    bands, h, w = tile.shape
    if h % d or w % d:
        raise ValueError(f"{d} doesn't divide {h} x {w}")
    return tile.reshape(bands, h // d, d, w // d, d).transpose(1, 3, 0, 2, 4).reshape(-1, bands, d, d)


def unblock_array(blocks: np.ndarray, n: int) -> np.ndarray:
    """The inverse of ``block_array`` for square tiles."""
    _, bands, d, _ = blocks.shape
    k = n // d
    return blocks.reshape(k, k, bands, d, d).transpose(2, 0, 3, 1, 4).reshape(bands, n, n)


def pack_blocks(tiles: DataFrame, n: int, d: int) -> DataFrame:
    """(img, h, w, bands, data) to a row each block: (img, sub, bands, data), zero-padded to n x n."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for img, h, w, bands, data in zip(pdf["img"], pdf["h"], pdf["w"], pdf["bands"], pdf["data"], strict=True):
                full = np.zeros((bands, n, n), np.uint8)
                full[:, :h, :w] = np.frombuffer(data, np.uint8).reshape(bands, h, w)
                parts = block_array(full, d)
                yield pd.DataFrame({"img": img, "sub": range(len(parts)), "bands": bands, "data": [p.tobytes() for p in parts]})

    return tiles.mapInPandas(run, "img long, sub int, bands int, data binary")


def stitch_blocks(blocks: DataFrame, n: int, d: int) -> DataFrame:
    """Blocks back to tiles of n x n; absent blocks are zero. One group holds one tile."""
    k = n // d

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bands = int(pdf["bands"].iat[0])
        parts = np.zeros((k * k, bands, d, d), np.uint8)
        for sub, data in zip(pdf["sub"], pdf["data"], strict=True):
            parts[sub] = np.frombuffer(data, np.uint8).reshape(bands, d, d)
        return pd.DataFrame({"img": [pdf["img"].iat[0]], "h": [n], "w": [n], "bands": [bands], "data": [unblock_array(parts, n).tobytes()]})

    return blocks.groupBy("img").applyInPandas(run, "img long, h int, w int, bands int, data binary")


def lower_envelope(f: np.ndarray) -> np.ndarray:
    """Of every row, at each place x the least f[q] + (x - q)^2: the envelope of its parabolas, in linear time.

    All rows go at once: each column is put on the stacks of all rows, and only rows whose last parabola it hides go on popping.
    """
    rows, w = f.shape
    high = f + np.arange(w) ** 2
    where, begins = np.zeros((rows, w), np.int64), np.full((rows, w + 1), np.inf)
    begins[:, 0] = -np.inf
    top, each = np.zeros(rows, np.int64), np.arange(rows)
    for q in range(1, w):
        open_ = each
        while len(open_):
            k = top[open_]
            v = where[open_, k]
            meet = (high[open_, q] - high[open_, v]) / (2.0 * (q - v))
            hidden = meet <= begins[open_, k]
            kept, k = open_[~hidden], k[~hidden] + 1
            top[kept], where[kept, k], begins[kept, k], begins[kept, k + 1] = k, q, meet[~hidden], np.inf
            open_ = open_[hidden]
            top[open_] -= 1
    out, k = np.empty_like(f), np.zeros(rows, np.int64)
    for x in range(w):
        behind = each
        while len(behind := behind[begins[behind, k[behind] + 1] < x]):
            k[behind] += 1
        v = where[each, k]
        out[:, x] = f[each, v] + (x - v) ** 2
    return out


def squared_distance(target: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel to the nearest true one, axis by axis (infinite without any)."""
    h, w = target.shape
    if not target.any():
        return np.full(target.shape, np.inf)
    far = float(h + w)  # further than any pixel of the tile
    gap = np.where(target, 0.0, far)
    for y in range(1, h):  # distance along columns, down and up
        gap[y] = np.minimum(gap[y], gap[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        gap[y] = np.minimum(gap[y], gap[y + 1] + 1)
    return lower_envelope(np.minimum(gap, far) ** 2)


def signed_distance(mask: np.ndarray, cls: int, truncate: float | None = None) -> np.ndarray:
    """Distance to the class outside, minus the distance to others plus one inside; 0 if absent, NaN if everywhere.

    With ``truncate``, distances beyond it count as that much.
    """
    hot = mask == cls
    if not hot.any():
        return np.zeros(mask.shape)
    near = lambda t: np.sqrt(squared_distance(t)) if truncate is None else np.minimum(np.sqrt(squared_distance(t)), truncate)
    inside = np.full(mask.shape, np.nan) if hot.all() else 1 - near(~hot)
    return np.where(hot, inside, near(hot))


def recut(pieces: DataFrame, dim: int, order: str | None = None) -> DataFrame:
    """(row, col, h, w, bands, data): pieces of a raster at (gy, gx), with (h, w, bands, data), cut anew into tiles of ``dim``.

    Serves retiling (strips to tiles) and mosaics (overlapping tiles to a raster): each piece is cut at
    the borders of the tiles, so what is shuffled are runs of bytes of about the raster's size, and put
    together there; where pieces overlap, the last one by ``order`` wins. Pixels that no piece has are 0;
    tiles end where their pixels do.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(order).to_pylist() if order else [0] * batch.num_rows
            for turn, gy, gx, h, w, bands, data in zip(turns, *(batch.column(c).to_pylist() for c in ("gy", "gx", "h", "w", "bands", "data")), strict=True):
                a = np.frombuffer(data, np.uint8)[: bands * h * w].reshape(bands, h, w)
                rows = []
                for row in range(gy // dim, (gy + h - 1) // dim + 1):
                    for col in range(gx // dim, (gx + w - 1) // dim + 1):
                        y0, y1, x0, x1 = max(gy, row * dim), min(gy + h, row * dim + dim), max(gx, col * dim), min(gx + w, col * dim + dim)
                        part = np.ascontiguousarray(a[:, y0 - gy : y1 - gy, x0 - gx : x1 - gx])
                        rows.append((row, col, turn, y0 - row * dim, x0 - col * dim, y1 - y0, x1 - x0, bands, part.tobytes()))
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.binary())
                    names = ["row", "col", "turn", "y", "x", "h", "w", "bands", "data"]
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", kind="stable")
        tile = np.zeros((int(pdf["bands"].max()), int((pdf["y"] + pdf["h"]).max()), int((pdf["x"] + pdf["w"]).max())), np.uint8)
        for y, x, h, w, bands, data in pdf[["y", "x", "h", "w", "bands", "data"]].itertuples(index=False):
            tile[:bands, y : y + h, x : x + w] = np.frombuffer(data, np.uint8).reshape(bands, h, w)
        bands, h, w = tile.shape
        return pd.DataFrame({"row": [pdf["row"].iat[0]], "col": [pdf["col"].iat[0]], "h": [h], "w": [w], "bands": [bands], "data": [tile.tobytes()]})

    parts = pieces.mapInArrow(cut, "row int, col int, turn long, y int, x int, h int, w int, bands int, data binary")
    return parts.groupBy("row", "col").applyInPandas(put, "row int, col int, h int, w int, bands int, data binary")


#: What pads a mask where its mosaic has no pixel.
ABSENT = 255


def _strip(mask: np.ndarray, dy: int, dx: int, t: int) -> np.ndarray:
    """The part of a tile that lies within ``t`` of its neighbour at (dy, dx)."""
    cut = lambda d, n: slice(None) if d == 0 else slice(max(0, n - t), n) if d > 0 else slice(0, t)
    return mask[cut(dy, mask.shape[0]), cut(dx, mask.shape[1])]


def distance_mosaic(tiles: DataFrame, n: int, k: int, truncate: int) -> DataFrame:
    """(img, k, y, x, dist): signed distances over the borders of tiles (row, col, img, h, w, data), none above ``truncate``.

    Each tile of n x n sends its neighbours the strips that lie within ``truncate`` of them, so the
    result is that of the whole mosaic. Without a pixel of the class, or of others, within
    that distance, the distance is ``truncate``. A mosaic may lack tiles, and tiles pixels at the lower and right side.
    """
    if not 0 < truncate <= n:
        raise ValueError("the distance must be positive and no tile's side must be shorter")
    sides = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    t = truncate

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, col, img, h, w, data in zip(*(batch.column(c).to_pylist() for c in ("row", "col", "img", "h", "w", "data")), strict=True):
                full = np.full((n, n), ABSENT, np.uint8)
                full[:h, :w] = np.frombuffer(data, np.uint8)[: h * w].reshape(h, w)
                parts = [np.ascontiguousarray(_strip(full, dy, dx, t)).tobytes() for dy, dx in sides]
                own = [img if side == (0, 0) else None for side in sides]
                values = [([row + dy for dy, _ in sides], pa.int32()), ([col + dx for _, dx in sides], pa.int32()), ([dy for dy, _ in sides], pa.int32()), ([dx for _, dx in sides], pa.int32()), (own, pa.int64()), ([h] * 9, pa.int32()), ([w] * 9, pa.int32()), (parts, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in values], ["row", "col", "dy", "dx", "img", "h", "w", "data"])

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[(pdf["dy"] == 0) & (pdf["dx"] == 0)]
        if not len(mine):  # a place of the mosaic without a tile
            return pd.DataFrame({c: pd.Series(dtype=d) for c, d in (("img", "int64"), ("k", "int32"), ("y", "int32"), ("x", "int32"), ("dist", "float64"))})
        wide = np.full((n + 2 * t, n + 2 * t), ABSENT, np.uint8)
        place = lambda d: slice(t, t + n) if d == 0 else slice(0, t) if d > 0 else slice(t + n, n + 2 * t)
        for dy, dx, data in zip(pdf["dy"], pdf["dx"], pdf["data"], strict=True):
            at = wide[place(dy), place(dx)]
            at[:] = np.frombuffer(data, np.uint8).reshape(at.shape)
        img, h, w = (int(mine[c].iat[0]) for c in ("img", "h", "w"))
        y, x = (a.ravel() for a in np.mgrid[:h, :w].astype(np.int32))
        out = []
        for c in range(k):
            hot, other = wide == c, (wide != c) & (wide != ABSENT)
            near = lambda target: np.minimum(np.sqrt(squared_distance(target)), t)[place(0), place(0)][:h, :w]
            dist = np.where(hot[place(0), place(0)][:h, :w], 1 - near(other), near(hot))
            out.append(pd.DataFrame({"img": img, "k": np.int32(c), "y": y, "x": x, "dist": dist.ravel()}))
        return pd.concat(out)

    sent = tiles.mapInArrow(send, "row int, col int, dy int, dx int, img long, h int, w int, data binary")
    return sent.groupBy("row", "col").applyInPandas(measure, "img long, k int, y int, x int, dist double")


# --- statistics of packed tiles --------------------------------------------------------------------
def _tile_arrays(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for h, w, bands, data in zip(*(batch.column(c).to_pylist() for c in ("h", "w", "bands", "data")), strict=True):
        yield np.frombuffer(data, np.uint8)[: bands * h * w].reshape(bands, h, w)


def _per_tile(tiles: DataFrame, keys: Sequence[str], columns: dict[str, str], fn: Callable[[np.ndarray], Sequence]) -> DataFrame:
    """(keys, columns): one row a tile of what a function says of its array; nothing is shuffled."""
    kept = [f for f in tiles.schema if f.name in keys]
    schema = T.StructType([*kept, *T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in columns.items()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(t) for t in _tile_arrays(batch)]
            values = list(zip(*rows, strict=True)) or [()] * len(columns)
            made = [pa.array(list(v), pa.bool_() if t == "boolean" else pa.int64() if t == "long" else pa.float64()) for v, t in zip(values, columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *made], [*[f.name for f in kept], *columns])

    return tiles.mapInArrow(run, schema)


def nodata_packed(tiles: DataFrame, bands: str = "first") -> DataFrame:
    """(img, is_nodata) as ``raster.nodata`` has it."""
    blank = lambda t: [bool(np.isin(t if bands == "all" else t[:1], (0, 255)).all())]
    return _per_tile(tiles, ["img"], {"is_nodata": "boolean"}, blank)


def class_counts_packed(pred: DataFrame, classes: Sequence[int] = (0, 1, 2), keys: Sequence[str] = ("yr", "img")) -> DataFrame:
    """(keys, cl_<k>..., total) as ``stats.class_counts`` has it, of packed classes."""
    names = {f"cl_{c}": "long" for c in classes} | {"total": "long"}

    def count(t: np.ndarray) -> list[int]:
        found = np.bincount(t.ravel(), minlength=256)
        return [*(int(found[c]) for c in classes), int(t.size)]

    return _per_tile(pred, keys, names, count)


def forest_share_packed(pred: DataFrame, forest: DataFrame, pixels: int, limit: float = 10.0, compat: bool = False) -> DataFrame:
    """(yr, img, conifer, broadleaf, total) as ``stats.forest_share`` has it: tiles meet as bytes, not pixel by pixel.

    Where one of two tiles has more rows or columns, only the pixels that both have count.
    """
    other = forest.select("img", F.col("h").alias("fh"), F.col("w").alias("fw"), F.col("data").alias("forest"))
    both = pred.join(other, "img")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, w, data, fh, fw, under in zip(*(batch.column(c).to_pylist() for c in ("h", "w", "data", "fh", "fw", "forest")), strict=True):
                a, b = np.frombuffer(data, np.uint8)[: h * w].reshape(h, w), np.frombuffer(under, np.uint8)[: fh * fw].reshape(fh, fw)
                h, w = min(h, fh), min(w, fw)
                inside = b[:h, :w] == 1
                rows.append((*(int((a[:h, :w][inside] == c).sum()) * (c if compat else 1) for c in (1, 2)), int(b[:h, :w].sum())))
            values = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("yr"), batch.column("img"), *[pa.array(list(v), pa.int64()) for v in values]], ["yr", "img", "a", "b", "f"])

    sums = both.mapInArrow(run, T.StructType([pred.schema["yr"], pred.schema["img"], *T._parse_datatype_string("a long, b long, f long")]))
    share = lambda c: F.when(F.col("f") * 100.0 / pixels >= limit, c * 100.0 / F.col("f"))
    return sums.select("yr", "img", share(F.col("a")).alias("conifer"), share(F.col("b")).alias("broadleaf"), share(F.col("a") + F.col("b")).alias("total"))


def band_stats_packed(tiles: DataFrame, d: int, compat: bool = False) -> DataFrame:
    """(band, mean, std, cnt) as ``stats.band_stats`` has it: each tile gives one mergeable state a band, and no pixel is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states: dict[int, list[float]] = {}
            for t in _tile_arrays(batch):
                bands, h, w = t.shape
                if h != w or np.isin(t, (0, 255)).all():
                    continue
                blocks = block_array(t, d).reshape(-1, bands, d * d)
                varied = blocks[blocks[:, 0].min(axis=1) < blocks[:, 0].max(axis=1)] / 255.0
                for b in range(bands if len(varied) else 0):
                    s = states.setdefault(b + 1, [0.0, 0.0, 0])
                    s[0] += varied[:, b].mean(axis=1).sum()
                    s[1] += (varied[:, b] ** 2).mean(axis=1).sum()
                    s[2] += len(varied)
            rows = [(b, *s) for b, s in states.items()]
            values = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)], ["band", "s1", "s2", "cnt"])

    states = tiles.mapInArrow(run, "band int, s1 double, s2 double, cnt long")
    return deviation(states.groupBy("band").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("cnt").alias("cnt")), compat)


def deviation(sums: DataFrame, compat: bool = False) -> DataFrame:
    """(band, mean, std, cnt) of sums of means and of mean squares; ``compat`` divides by one more than the count."""
    by = F.col("cnt") + (1 if compat else 0)
    mean = F.col("s1") / by
    var = (F.col("s2") - 2 * mean * F.col("s1") + F.col("cnt") * mean * mean) / by
    return sums.select("band", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), "cnt")


def map_tiles(tiles: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a function array[bands, h, w] -> uint8 array[bands', h', w'] to every packed tile."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for img, h, w, bands, data in zip(pdf["img"], pdf["h"], pdf["w"], pdf["bands"], pdf["data"], strict=True):
                out = fn(np.frombuffer(data, np.uint8).reshape(bands, h, w)).astype(np.uint8)
                yield pd.DataFrame({"img": [img], "h": [out.shape[1]], "w": [out.shape[2]], "bands": [out.shape[0]], "data": [out.tobytes()]})

    return tiles.mapInPandas(run, "img long, h int, w int, bands int, data binary")


def distance_rows(tiles: DataFrame, k: int) -> DataFrame:
    """(img, k, y, x, dist): signed distances of every pixel of packed masks to each of ``k`` classes; null if a class fills its tile."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for img, h, w, data in zip(pdf["img"], pdf["h"], pdf["w"], pdf["data"], strict=True):
                mask = np.frombuffer(data, np.uint8)[: h * w].reshape(h, w)
                y, x = np.mgrid[:h, :w].astype(np.int32)
                for c in range(k):
                    dist = signed_distance(mask, c).ravel()
                    yield pd.DataFrame({"img": img, "k": np.int32(c), "y": y.ravel(), "x": x.ravel(), "dist": pd.array(dist, "Float64") if np.isnan(dist).any() else dist})

    return tiles.mapInPandas(run, "img long, k int, y int, x int, dist double")
