"""Raster files as a Spark data source: windows of large TIFF files, read by byte ranges.

A file's header says where its internal tiles or strips lie. Planning reads the headers alone; a
partition is a run of neighbouring tiles, whose task reads their part of the tile index and their
bytes, and nothing else of the file. A box prunes the runs before any task starts.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tilewright.sources.store import Read, opener, store_of

#: Internal tiles of a partition, and files beyond which a partition takes whole files and planning reads none.
RUN, MANY_FILES = 32, 256
SCHEMA = "path string, row int, col int, y0 long, x0 long, h int, w int, bands int, dtype string, data binary, n_read long"
#: Fixed values of the format: bytes and letters of its field types, and the numbers of the fields read here.
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "c", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 277, 284, 317, 339
STRIP_OFFSETS, STRIP_ROWS, STRIP_COUNTS, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 273, 278, 279, 322, 323, 324, 325
PIXEL_SCALE, TIE_POINT = 33550, 33922
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946

def find_files(path: str, ending: tuple[str, ...] = (".tif", ".tiff")) -> list[str]:
    """The file itself, or the raster files below a folder, by name."""
    from pyarrow import fs

    store, inner = store_of(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if store.get_file_info(inner).type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted(f"{head}{f.path}" for f in found if f.type == fs.FileType.File and f.path.lower().endswith(ending))
    return [path]


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest first; 256 begins anew and 257 ends, as this format has it."""
    out, table, width, at, bits, held, last = [], [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, 0, b""
    size = len(data)
    while True:
        while bits < width:
            if at == size:
                return b"".join(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        code = held >> bits - width & (1 << width) - 1
        bits -= width
        if code == 257:
            return b"".join(out)
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("broken codes")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1


@dataclass
class RasterFile:
    """What the header says; tiles are read on demand. Strips count as tiles of the full width."""

    read: Read
    n_read: int = 0

    def __post_init__(self) -> None:
        head = self._bytes(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError("no TIFF file")
        self.order, big = order, version == 43
        at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
        size, form, count = (20, "HHQ", "Q") if big else (12, "HHI", "H")
        (n,) = struct.unpack(f"{order}{count}", self._bytes(at, struct.calcsize(count)))
        table = self._bytes(at + struct.calcsize(count), n * size)
        #: By field: type, number of values, and where they lie; short ones lie in the table itself.
        self.fields: dict[int, tuple[int, int, int, bytes | None]] = {}
        inline = 8 if big else 4
        for k in range(n):
            entry = table[k * size : (k + 1) * size]
            field, kind, values = struct.unpack(f"{order}{form}", entry[: size - inline])
            if kind not in FIELDS:
                continue
            held = entry[size - inline :]
            if struct.calcsize(f"<{FIELDS[kind]}") * values <= inline:
                self.fields[field] = (kind, values, 0, held)
            else:
                self.fields[field] = (kind, values, struct.unpack(f"{order}{'Q' if big else 'I'}", held)[0], None)
        self.width, self.height = self._one(WIDTH), self._one(HEIGHT)
        self.bands, self.planar = self._one(SAMPLES, 1), self._one(PLANAR, 1) == 2
        self.compression, self.predictor = self._one(COMPRESSION, 1), self._one(PREDICTOR, 1)
        bits = set(self.values(BITS)) if BITS in self.fields else {1}
        if len(bits) != 1 or bits & {1, 2, 4}:
            raise ValueError(f"samples of {sorted(bits)} bits")
        self.dtype = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[self._one(FORMAT, 1)]}{bits.pop() // 8}")
        if self.compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE) or self.predictor not in (1, 2):
            raise ValueError(f"compression {self.compression} with predictor {self.predictor}")
        self.tiled = TILE_OFFSETS in self.fields
        self.tile_w = self._one(TILE_WIDTH) if self.tiled else self.width
        self.tile_h = self._one(TILE_HEIGHT) if self.tiled else min(self.height, self._one(STRIP_ROWS, self.height))
        self.across, self.down = -(-self.width // self.tile_w), -(-self.height // self.tile_h)

    def _bytes(self, at: int, n: int) -> bytes:
        got = self.read(at, n)
        self.n_read += len(got)
        return got

    def values(self, field: int, first: int = 0, n: int | None = None) -> tuple:
        """Some values of a field, by a read of these alone."""
        kind, count, at, held = self.fields[field]
        n = count - first if n is None else n
        size = struct.calcsize(f"<{FIELDS[kind]}")
        raw = held[first * size : (first + n) * size] if held is not None else self._bytes(at + first * size, n * size)
        return struct.unpack(f"{self.order}{FIELDS[kind] * n}", raw)

    def _one(self, field: int, default: int | None = None) -> int:
        if field not in self.fields:
            if default is None:
                raise ValueError(f"field {field} is missing")
            return default
        return self.values(field, 0, 1)[0]

    def geo(self) -> tuple[float, float, float, float] | None:
        """x and y of the upper left corner and the size of a pixel, if the file says so."""
        if PIXEL_SCALE not in self.fields or TIE_POINT not in self.fields:
            return None
        (sx, sy), (i, j, _, x, y) = self.values(PIXEL_SCALE, 0, 2), self.values(TIE_POINT, 0, 5)
        return x - i * sx, y + j * sy, sx, sy

    def run(self, row: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, int]]:
        """(column, bands x rows x columns, bytes read) of the tiles of a row from one column to another."""
        planes = self.bands if self.planar else 1
        index = TILE_OFFSETS if self.tiled else STRIP_OFFSETS
        counts = TILE_COUNTS if self.tiled else STRIP_COUNTS
        before = self.n_read
        starts = [row * self.across + first + p * self.across * self.down for p in range(planes)]
        places = [(self.values(index, s, last - first + 1), self.values(counts, s, last - first + 1)) for s in starts]
        for k in range(last - first + 1):
            parts = [self._tile(row, at[k], n[k]) for at, n in places]
            tile = np.concatenate(parts) if len(parts) > 1 else parts[0]
            h, w = min(self.tile_h, self.height - row * self.tile_h), min(self.tile_w, self.width - (first + k) * self.tile_w)
            yield first + k, tile[:, :h, :w], self.n_read - before
            before = self.n_read

    def _tile(self, row: int, at: int, n: int) -> np.ndarray:
        depth = 1 if self.planar else self.bands
        rows = self.tile_h if self.tiled else min(self.tile_h, self.height - row * self.tile_h)
        size = rows * self.tile_w * depth * self.dtype.itemsize
        if n == 0:  # left out of a sparse file
            return np.zeros((depth, rows, self.tile_w), self.dtype)
        raw = self._bytes(at, n)
        if self.compression == LZW:
            raw = unpack_lzw(raw)
        elif self.compression != NONE:
            raw = zlib.decompress(raw)
        tile = np.frombuffer(raw[:size], self.dtype).reshape(rows, self.tile_w, depth)
        if self.predictor == 2:
            tile = np.cumsum(tile, axis=1, dtype=tile.dtype.newbyteorder("="))
        return tile.transpose(2, 0, 1)


def decode_tiff(data: bytes) -> np.ndarray:
    """A whole file of moderate size as bands x rows x columns."""
    f = RasterFile(lambda at, n: data[at : at + n])
    out = np.zeros((f.bands, f.height, f.width), f.dtype.newbyteorder("="))
    for row in range(f.down):
        for col, tile, _ in f.run(row, 0, f.across - 1):
            y, x = row * f.tile_h, col * f.tile_w
            out[:, y : y + tile.shape[1], x : x + tile.shape[2]] = tile
    return out


def encode_tiff(tile: np.ndarray, side: int = 256, predictor: bool = True, geo: tuple[float, float, float, float] | None = None) -> bytes:
    """bands x rows x columns of bytes as a tiled, deflated file; ``side`` is a multiple of 16."""
    if tile.dtype != np.uint8 or side % 16:
        raise ValueError("bytes and a side of a multiple of 16")
    bands, h, w = tile.shape
    body, places = io.BytesIO(), []
    for y in range(0, h, side):
        for x in range(0, w, side):
            part = np.zeros((side, side, bands), np.uint8)
            cut = tile[:, y : y + side, x : x + side].transpose(1, 2, 0)
            part[: cut.shape[0], : cut.shape[1]] = cut
            if predictor:
                part[:, 1:] -= part[:, :-1].copy()
            data = zlib.compress(part.tobytes(), 6)
            places.append((body.tell(), len(data)))
            body.write(data)
    longs = lambda v: struct.pack(f"<{len(v)}I", *v)
    shorts = lambda *v: struct.pack(f"<{len(v)}H", *v)
    fields = {
        WIDTH: (4, 1, longs([w])), HEIGHT: (4, 1, longs([h])), BITS: (3, bands, shorts(*[8] * bands)), COMPRESSION: (3, 1, shorts(DEFLATE)), 262: (3, 1, shorts(1)),
        SAMPLES: (3, 1, shorts(bands)), PLANAR: (3, 1, shorts(1)), PREDICTOR: (3, 1, shorts(2 if predictor else 1)), TILE_WIDTH: (4, 1, longs([side])), TILE_HEIGHT: (4, 1, longs([side])),
        TILE_OFFSETS: (4, len(places), longs([8 + at for at, _ in places])), TILE_COUNTS: (4, len(places), longs([n for _, n in places])), FORMAT: (3, bands, shorts(*[1] * bands)),
    }
    if geo is not None:
        x, y, sx, sy = geo
        fields |= {PIXEL_SCALE: (12, 3, struct.pack("<3d", sx, sy, 0)), TIE_POINT: (12, 6, struct.pack("<6d", 0, 0, 0, x, y, 0))}
    start = 8 + body.tell() + body.tell() % 2
    table, beyond = io.BytesIO(), io.BytesIO()
    after = start + 2 + 12 * len(fields) + 4
    for field, (kind, n, data) in sorted(fields.items()):
        value = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", after + beyond.tell())
        if len(data) > 4:
            beyond.write(data + b"\0" * (len(data) % 2))
        table.write(struct.pack("<HHI", field, kind, n) + value)
    if after + beyond.tell() >= 1 << 32:
        raise ValueError("too large for this kind of file")
    return b"II*\0" + struct.pack("<I", start) + body.getvalue() + b"\0" * (body.tell() % 2) + struct.pack("<H", len(fields)) + table.getvalue() + longs([0]) + beyond.getvalue()


# --- data source ---------------------------------------------------------------------------------
@dataclass
class Run(InputPartition):
    """Neighbouring tiles of one row of a file, or with ``files`` the boxes of several small files."""

    path: str
    row: int = 0
    first: int = 0
    last: int = 0
    files: tuple[str, ...] = ()


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        number = lambda k, default: int(options.get(k, default))
        #: The pixels asked for: x from, y from, x to and y to (excluded).
        self.box = [number("x0", 0), number("y0", 0), number("x1", 1 << 62), number("y1", 1 << 62)]
        self.span = {"row": [0, 1 << 62], "col": [0, 1 << 62]}

    def _runs(self, path: str, f: RasterFile) -> Iterator[Run]:
        x0, y0, x1, y1 = self.box
        if x0 >= min(x1, f.width) or y0 >= min(y1, f.height):
            return
        rows = max(y0 // f.tile_h, self.span["row"][0]), min((min(y1, f.height) - 1) // f.tile_h, self.span["row"][1])
        cols = max(x0 // f.tile_w, self.span["col"][0]), min((min(x1, f.width) - 1) // f.tile_w, self.span["col"][1])
        for row in range(rows[0], rows[1] + 1):
            for first in range(cols[0], cols[1] + 1, RUN):
                yield Run(path, row, first, min(first + RUN - 1, cols[1]))

    def partitions(self) -> list[Run]:
        files = find_files(self.path)
        if len(files) > MANY_FILES:  # headers are read by the tasks
            return [Run("", files=tuple(files[k : k + RUN])) for k in range(0, len(files), RUN)]
        out, small = [], []
        for p in files:
            runs = list(self._runs(p, RasterFile(opener(p))))
            if sum(r.last - r.first + 1 for r in runs) * 4 > RUN:
                out += runs
            elif runs:
                small.append(p)
        return out + [Run("", files=tuple(small[k : k + RUN])) for k in range(0, len(small), RUN)]

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no tile is asked for
            return
        if partition.files:
            for path in partition.files:
                f = RasterFile(opener(path))
                for r in self._runs(path, f):
                    yield from self._read(f, r)
        else:
            yield from self._read(RasterFile(opener(partition.path)), partition)

    def _read(self, f: RasterFile, r: Run) -> Iterator[pa.RecordBatch]:
        for col, tile, n_read in f.run(r.row, r.first, r.last):
            _, h, w = tile.shape
            little = tile.astype(f.dtype.newbyteorder("<"), copy=False)
            values = [r.path, r.row, col, r.row * f.tile_h, col * f.tile_w, h, w, f.bands, f.dtype.newbyteorder("<").str.lstrip("<|"), np.ascontiguousarray(little).tobytes(), n_read]
            kinds = [pa.string(), *[pa.int32()] * 2, *[pa.int64()] * 2, *[pa.int32()] * 3, pa.string(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


class PushingReader(RasterReader):
    """The reader of sessions that hand filters to Python sources; Spark refuses it in others."""

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds on ``row`` and ``col`` prune runs; Spark still applies every filter."""
        for f in filters:
            name, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
            if name in self.span and isinstance(value, int):
                span = self.span[name]
                low = {EqualTo: value, GreaterThan: value + 1, GreaterThanOrEqual: value}.get(type(f))
                high = {EqualTo: value, LessThan: value - 1, LessThanOrEqual: value}.get(type(f))
                span[0], span[1] = max(span[0], low if low is not None else span[0]), min(span[1], high if high is not None else span[1])
            yield f


class RasterSource(DataSource):
    """``spark.read.format("raster")``: internal tiles of raster files; options x0, y0, x1, y1 give a box of pixels.

    With the option ``push``, and ``spark.sql.python.filterPushdown.enabled``, filters on ``row`` and ``col`` prune as well.
    """

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        kind = PushingReader if self.options.get("push", "").lower() == "true" else RasterReader
        return kind(dict(self.options))


def read_raster(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Internal tiles (path, row, col, y0, x0, h, w, bands, dtype, data, n_read) of a file or of all files of a folder.

    ``box`` is (x0, y0, x1, y1) in pixels, the last two excluded: tiles that share pixels with it come
    whole. ``n_read`` counts the bytes read for each tile, its part of the index included.
    """
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("raster").option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, value in zip(("x0", "y0", "x1", "y1"), box or (), strict=False):
        reader = reader.option(name, value)
    return reader.load(path)
