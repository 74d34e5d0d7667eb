"""Readers and writers: tile tables, tar shards, grid and statistics files."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.lineage import cut
from tilewright.functions.ordering import with_index
from tilewright.sources.store import Read, opener, store_of

GRID_SCHEMA = "filename string, x1 double, x2 double, y1 double, y2 double"
STATS_SCHEMA = "tile string, frac double, status int"
TILE_SCHEMA = "img long, h int, w int, bands int, data binary"


def read_tiles(spark: SparkSession, path: str | list[str], glob: str = "*", decoder: Callable[[bytes], tuple[int, int, int, bytes]] | None = None) -> DataFrame:
    """A tile table as Parquet from one or several folders, or with ``decoder`` one tile a file: (path, h, w, bands, data).

    The decoder gets a file's bytes and gives height, width, bands and band-sequential bytes.
    """
    if decoder is None:
        return spark.read.option("pathGlobFilter", glob).parquet(*([path] if isinstance(path, str) else path))
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def decode(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [(p, *decoder(bytes(c))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "h", "w", "bands", "data"])

    return files.mapInPandas(decode, "path string, h int, w int, bands int, data binary")


def write_tiles(df: DataFrame, path: str, year: str | None = None) -> None:
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(year) if year else writer).parquet(path)


def hilbert(row: Column, col: Column, bits: int) -> Column:
    """Place of a cell on the Hilbert curve of 2^bits x 2^bits cells: near places are near cells."""
    start = F.struct(col.cast("long").alias("x"), row.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, side: Column) -> Column:
        rx, ry = (s["x"].bitwiseAND(side) > 0).cast("long"), (s["y"].bitwiseAND(side) > 0).cast("long")
        d = s["d"] + side * side * (rx * 3).bitwiseXOR(ry)
        turned = (ry == 0) & (rx == 1)
        x, y = F.when(turned, side - 1 - s["x"].bitwiseAND(side - 1)).otherwise(s["x"].bitwiseAND(side - 1)), F.when(turned, side - 1 - s["y"].bitwiseAND(side - 1)).otherwise(s["y"].bitwiseAND(side - 1))
        return F.struct(F.when(ry == 0, y).otherwise(x).alias("x"), F.when(ry == 0, x).otherwise(y).alias("y"), d.alias("d"))

    sides = F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(bits))]) if bits else F.array().cast("array<bigint>")
    return F.aggregate(sides, start, step, lambda s: s["d"])


def write_by_place(tiles: DataFrame, path: str, bits: int, shift: int) -> None:
    """Tiles (row, col, ...) as Parquet, laid out by place: folders of 2^shift x 2^shift tiles, and in each the order of the Hilbert curve.

    A reader with a box opens the folders that share tiles with it and no others; see ``read_box``.
    """
    placed = tiles.withColumn("block", hilbert(F.shiftright("row", shift), F.shiftright("col", shift), max(0, bits - shift))).withColumn("__h", hilbert(F.col("row"), F.col("col"), bits))
    placed.repartitionByRange("block").sortWithinPartitions("block", "__h").drop("__h").write.option("compression", "zstd").partitionBy("block").parquet(path)


def read_box(spark: SparkSession, path: str, bits: int, shift: int, box: tuple[int, int, int, int]) -> DataFrame:
    """Tiles of a layout of ``write_by_place`` with row and col from (r0, c0) to (r1, c1), these included."""
    r0, c0, r1, c1 = box
    cells = spark.range(r0 >> shift, (r1 >> shift) + 1).withColumnRenamed("id", "r").withColumn("c", F.explode(F.sequence(F.lit(c0 >> shift), F.lit(c1 >> shift))))
    blocks = [r[0] for r in cells.select(hilbert(F.col("r"), F.col("c"), max(0, bits - shift))).collect()]  # one for each folder of the box
    return spark.read.parquet(path).where(F.col("block").isin(blocks) & F.col("row").between(r0, r1) & F.col("col").between(c0, c1)).drop("block")


def member_key(name: str) -> tuple[str, str]:
    """Key and part of a member: its name is cut at the first dot after its last folder, which the key keeps."""
    folder, _, base = name.rpartition("/")
    key, _, part = base.partition(".")
    return (f"{folder}/{key}" if folder else key), part


def read_shards(spark: SparkSession, path: str | list[str], glob: str = "*.tar") -> DataFrame:
    """Tar shards of one or several folders as samples: (shard, pos, key, parts); members of a key are one sample."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("shard"), "content")

    def untar(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for shard, content in zip(pdf["shard"], pdf["content"], strict=True):
                samples: dict[str, list[tuple[str, bytes]]] = {}
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():  # folders, links and devices are no samples
                            key, suffix = member_key(m.name)
                            samples.setdefault(key, []).append((suffix, tar.extractfile(m).read()))
                rows = [(shard, i, k, v) for i, (k, v) in enumerate(samples.items())]
                yield pd.DataFrame(rows, columns=["shard", "pos", "key", "parts"])

    listed = files.mapInPandas(untar, "shard string, pos long, key string, parts array<struct<name:string,data:binary>>")
    return listed.withColumn("parts", F.map_from_entries("parts"))


def write_shards(df: DataFrame, path: str, pattern: str = "train-%06d.tar", maxcount: int = 32) -> DataFrame:
    """Write (key, parts) as tar shards of at most ``maxcount`` samples in the order of the keys; returns (name, samples).

    A global index gives each sample its shard and place. Samples stream into their shard one by
    one, so a shard may be larger than memory. Tasks write below a temporary folder of the target;
    when all have ended, the files of the tasks that count get their names, so a lost or repeated
    task leaves no file behind.
    """
    placed = with_index(df, [F.col("key")])
    placed = placed.select(F.floor(F.col("idx") / maxcount).alias("shard"), (F.col("idx") % maxcount).alias("pos"), "key", F.map_entries("parts").alias("parts"))
    return commit_shards(placed.repartition("shard").sortWithinPartitions("shard", "pos"), path, pattern)


def commit_shards(ordered: DataFrame, path: str, pattern: str) -> DataFrame:
    """Write rows (shard, pos, key, parts) that come to each task in the order of shard and pos, in two phases."""
    import uuid

    temporary = f"{path.rstrip('/')}/_temporary-{uuid.uuid4().hex}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, inner = store_of(temporary)
        store.create_dir(inner, recursive=True)
        now, out, n, at = None, None, 0, ""
        done = lambda: pa.RecordBatch.from_arrays([pa.array([pattern % now]), pa.array([at]), pa.array([n], pa.int64())], ["name", "file", "samples"])
        for batch in batches:
            for shard, key, parts in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), batch.column("parts"), strict=True):
                if shard != now:
                    if out is not None:
                        _end(out)
                        yield done()
                    now, n, at = shard, 0, f"{inner}/{uuid.uuid4().hex}"
                    out = store.open_output_stream(at)
                for name, value in sorted((p["key"].as_py(), p["value"].as_py()) for p in parts):
                    _put_member(out, f"{key}.{name}", value or b"")
                n += 1
        if out is not None:
            _end(out)
            yield done()

    store, inner = store_of(path)
    try:
        written = ordered.mapInArrow(put, "name string, file string, samples long").collect()  # a row a shard
        for r in written:
            store.move(r["file"], f"{inner.rstrip('/')}/{r['name']}")
    finally:
        left, folder = store_of(temporary)
        if left.get_file_info(folder).type.name == "Directory":
            left.delete_dir(folder)
    return ordered.sparkSession.createDataFrame([(r["name"], r["samples"]) for r in written], "name string, samples long")


def _put_member(out, name: str, data: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size = len(data)
    out.write(info.tobuf(tarfile.GNU_FORMAT))
    out.write(data)
    out.write(b"\0" * (-len(data) % tarfile.BLOCKSIZE))


def _end(out) -> None:
    out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
    out.close()


def tar_members(read: Read) -> Iterator[tuple[str, int, int]]:
    """(name, place, size) of the files in a tar, by its headers alone; long names and sizes included."""
    at, longer, sizes = 0, None, None
    while True:
        block = read(at, tarfile.BLOCKSIZE)
        if len(block) < tarfile.BLOCKSIZE or not block.strip(b"\0"):
            return
        info = tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
        at += tarfile.BLOCKSIZE
        if info.type in (tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK, tarfile.XHDTYPE, tarfile.XGLTYPE, tarfile.SOLARIS_XHDTYPE):
            data = read(at, info.size)
            if info.type == tarfile.GNUTYPE_LONGNAME:
                longer = data.rstrip(b"\0").decode("utf-8", "surrogateescape")
            elif info.type in (tarfile.XHDTYPE, tarfile.SOLARIS_XHDTYPE):
                records = _records(data)
                longer, sizes = records.get("path", longer), int(records["size"]) if "size" in records else sizes
            size = info.size
        else:
            size = sizes if sizes is not None else info.size
            if info.isreg():
                yield longer or info.name, at, size
            else:
                size = size if info.type not in tarfile.SUPPORTED_TYPES else 0
            longer = sizes = None
        at += -(-size // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE


def _records(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(data) and data[at : at + 1] != b"\0":
        n = int(data[at : data.index(b" ", at)])
        key, _, value = data[data.index(b" ", at) + 1 : at + n - 1].partition(b"=")
        out[key.decode()] = value.decode("utf-8", "surrogateescape")
        at += n
    return out


def shard_index(spark: SparkSession, path: str | list[str], glob: str = "*.tar") -> DataFrame:
    """(path, shard, pos, key, part, place, size): where every member of the shards lies, read from the headers alone.

    The index is a table like any other: filter or join it, then give what is left to ``read_members``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                rows, seen = [], {}
                for name, place, size in tar_members(opener(p)):
                    key, part = member_key(name)
                    rows.append((p, p.rpartition("/")[2], seen.setdefault(key, len(seen)), key, part, place, size))
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "shard", "pos", "key", "part", "place", "size"])

    return files.mapInArrow(walk, "path string, shard string, pos long, key string, part string, place long, size long")


def read_members(index: DataFrame) -> DataFrame:
    """Samples (shard, pos, key, parts) of an index: every member is read by its own byte range, whatever the size of its shard."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read = None, None
        for batch in batches:
            for k, (p, place, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "place", "size")), strict=True)):
                if p != path:
                    path, read = p, opener(p)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in ("shard", "pos", "key", "part")], pa.array([read(place, size)], pa.binary())], ["shard", "pos", "key", "part", "data"])

    ordered = index.repartition("path", "key").sortWithinPartitions("path", "place")
    data = ordered.mapInArrow(fetch, "shard string, pos long, key string, part string, data binary")
    return data.groupBy("shard", "pos", "key").agg(F.map_from_entries(F.collect_list(F.struct("part", "data"))).alias("parts"))


def write_files(df: DataFrame, path: str) -> DataFrame:
    """Write each row's ``content`` as the file ``name``, through the file system that Spark uses for ``path``.

    Files are written under another name and renamed, so that a task that runs again leaves whole files.
    """
    if "://" in path and not path.startswith("file://"):
        raise ValueError("tar files are written to mounted folders; use the Parquet sink for object stores")
    local = path.removeprefix("file://")

    def put(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        os.makedirs(local, exist_ok=True)
        for pdf in pdfs:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                part = os.path.join(local, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(local, name))
            yield pdf[["name", "samples"]]

    return cut(df.mapInPandas(put, "name string, samples long"), "written")  # writes the files, once


def read_any(spark: SparkSession, path: str, tiles: str = "*.parquet", shards: str = "*.tar") -> DataFrame:
    """Shards if a folder has more shard files than tile files, else tiles."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    like = lambda g: F.count_if(F.col("path").rlike(g.replace(".", r"\.").replace("*", ".*") + "$"))
    n_shards, n_tiles = files.agg(like(shards), like(tiles)).first()
    return read_shards(spark, path, shards) if n_shards > n_tiles else read_tiles(spark, path, tiles)


def to_tuple(samples: DataFrame, *parts: str) -> DataFrame:
    """(key, and a column for each part): the named parts of every sample (key, parts); one that a sample lacks is null."""
    return samples.select("key", *[F.col("parts")[p].alias(p) for p in parts])


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", schema=GRID_SCHEMA)


def write_stats(df: DataFrame, path: str) -> None:
    df.select("tile", "frac", "status").write.csv(path, header=True)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=STATS_SCHEMA)


def write_area(df: DataFrame, path: str, key: str = "img") -> None:
    """Area table with the tile and its total first."""
    df.select(key, "total", *[c for c in df.columns if c not in (key, "total")]).write.csv(path, header=True)


def write_shares(shares: DataFrame, grid: DataFrame, path: str, key: str = "filename") -> None:
    """Shares by year with the tile's box and its outline as text."""
    corners = [("x1", "y1"), ("x1", "y2"), ("x2", "y2"), ("x2", "y1"), ("x1", "y1")]
    ring = F.format_string("POLYGON ((" + ", ".join(["%s %s"] * 5) + "))", *[F.col(c) for pair in corners for c in pair])
    shares.join(grid, key).withColumn("wkt", ring).write.partitionBy("yr").parquet(path)


def write_usage(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)
