"""Golden values, properties and plan checks of the raster operators."""

import os
import struct
import tarfile
import threading
import time
import zlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import evaluate as ev
from tilewright.operators import packed, raster, rings, sampling, score, stats, vector
from tilewright.functions.lineage import cut, scratch, shared_dir
from tilewright.functions.ordering import with_index, with_running_sum
from tilewright.plans import catalog, fixtures
from tilewright.sources import io, tiff

SF = "/root/testdata/sf0.001"
#: Two shards are too few for three parts, so this query is compared at the next scale.
LARGER = {"merge_years": "/root/testdata/sf0.01"}


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con, sf = duckdb.connect(), LARGER.get(name, SF)
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    df, sql = catalog.queries()[name](spark, sf), con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    ours = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    assert ours == sorted(tuple(map(norm, r)) for r in sql.select(*[f'"{c}"' for c in cols]).fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_block_order_is_row_major():
    got = packed.block_array(np.stack([np.arange(16).reshape(4, 4)] * 3), 2)
    assert got.shape == (4, 3, 2, 2) and got[:, 0].reshape(4, 4).tolist() == [[0, 1, 4, 5], [2, 3, 6, 7], [8, 9, 12, 13], [10, 11, 14, 15]]
    assert (packed.unblock_array(got, 4) == np.stack([np.arange(16).reshape(4, 4)] * 3)).all()
    with pytest.raises(ValueError, match="divide"):
        packed.block_array(np.zeros((1, 5, 4)), 2)


@pytest.mark.parametrize(("h", "w", "ny", "nx"), [(8192, 8192, 16, 16), (8192, 7433, 16, 15), (2649, 8192, 6, 16)])
def test_subtile_grids(spark, h, w, ny, nx):
    corner = spark.createDataFrame([(1, 1, h - 1, w - 1, 0)], "img long, band int, y int, x int, v int")
    assert tuple(raster.grid_of(corner, (8192, 8192), (512, 512)).first()) == (1, h, w, ny, nx)
    assert raster.needed(corner, 8192, 512).count() == ny * nx
    with pytest.raises(ValueError, match="divide"):
        raster.grid_of(corner, (8192, 8192), (500, 500))


def test_packed_and_long_forms_agree(spark):
    px = fixtures.view(spark, SF, "px")
    tiles = score.pack_tiles(px, 8)
    subs = {(r["img"], r["sub"]): np.frombuffer(r["data"], np.uint8).reshape(r["bands"], 4, 4) for r in packed.pack_blocks(tiles, 8, 4).collect()}
    for r in raster.blocks(raster.pad(px, 8), 8, 4).collect():
        assert subs[r["img"], r["sub"]][r["band"] - 1, r["y"], r["x"]] == r["v"]
    back = {r["img"]: r["data"] for r in packed.stitch_blocks(packed.pack_blocks(tiles, 8, 4), 8, 4).collect()}
    full = {r["img"]: r["data"] for r in score.pack_tiles(raster.pad(px, 8), 8).collect()}
    assert back == full
    flipped = packed.map_tiles(tiles, lambda t: t[:, :, ::-1])
    assert flipped.count() == tiles.count()


def test_packed_distances_agree_with_the_join(spark):
    mask = fixtures.view(spark, SF, "mask_px")
    near = {(r["img"], r["k"], r["y"], r["x"]): r["dist"] for r in raster.distance_map(mask, 3).collect()}
    grids: dict = {}
    for r in mask.collect():
        grids.setdefault(r["img"], {})[r["y"], r["x"]] = r["cls"]
    for img, cells in grids.items():
        h, w = max(y for y, _ in cells) + 1, max(x for _, x in cells) + 1
        grid = np.array([[cells[y, x] for x in range(w)] for y in range(h)])
        for k in range(3):
            got = packed.signed_distance(grid, k)
            for (y, x) in cells:
                want = near[img, k, y, x]
                assert np.isnan(got[y, x]) if want is None else got[y, x] == pytest.approx(want)


def test_dice_squares(spark):
    def rows(y0, y1, x0, x1):
        return [(1, int(2 <= y < 5 and 2 <= x < 5), float(not (y0 <= y < y1 and x0 <= x < x1)), float(y0 <= y < y1 and x0 <= x < x1)) for y in range(5) for x in range(5)]

    schema = "sample long, t int, p0 double, p1 double"
    same = spark.createDataFrame(rows(2, 5, 2, 5), schema)
    assert ev.fscore(same, 2).first()[0] == pytest.approx(1.0) and ev.fscore(same, 2, [0]).first()[0] == pytest.approx(1.0)
    other = spark.createDataFrame(rows(1, 3, 2, 5), schema)
    tp = sum(1 for r in rows(1, 3, 2, 5) if r[1] and r[3])
    assert ev.fscore(other, 2, [0]).first()[0] == pytest.approx(2 * tp / (9 + 6), rel=1e-6)


def test_balanced_groups_have_even_totals(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(f"t{i}", float(f), 1) for i, f in enumerate(r.gamma(9, 0.5, 100) + 1e-7)], "tile string, frac double, status int")
    totals = sampling.shard_totals(sampling.balanced_split(df, 10)).collect()
    mean = sum(t["total"] for t in totals) / 10
    assert len(totals) == 10 and abs(mean - 45) < 5 and all(t["n"] == 10 and abs(t["total"] - mean) < 5 for t in totals)
    for size in (0, 101):
        with pytest.raises(ValueError, match="size"):
            sampling.balanced_split(df, size)
    with pytest.raises(ValueError, match="above 0"):
        sampling.balanced_split(df.withColumn("frac", F.lit(0.0)), 10)


def test_split_thresholds():
    assert sampling.thresholds(10, (0.7, 0.2, 0.1)) == [7, 9, 10]
    assert sampling.thresholds(12, (0.7, 0.2, 0.1)) == [8, 10, 12]
    assert sampling.thresholds(3, (0.7, 0.2, 0.1)) == [1, 2, 3] and sampling.thresholds(3, (0.9, 0.1)) == [2, 3]
    with pytest.raises(ValueError, match="cover"):
        sampling.thresholds(12, (0.7, 0.2, 0.1), compat=True)
    with pytest.raises(ValueError, match="sum"):
        sampling.thresholds(5, (0.5, 0.2))
    with pytest.raises(ValueError, match="few"):
        sampling.thresholds(2, (0.7, 0.2, 0.1))


def test_errors(spark):
    stats_df = fixtures.view(spark, SF, "subtile_stats")
    with pytest.raises(ValueError, match="negative"):
        sampling.sample_negatives(sampling.all_keys(stats_df, 4), sampling.all_keys(stats_df, 4))
    with pytest.raises(ValueError, match="2016"):
        stats.require_years(fixtures.view(spark, SF, "pred_px"), [2016, 2017])
    with pytest.raises(ValueError, match="even"):
        ev.vote(fixtures.view(spark, SF, "vote_px"), ["img"], 2)
    with pytest.raises(ValueError, match="two years"):
        sampling.merge_years(spark.createDataFrame([(2017, 1)], "year int, shard int"))
    with pytest.raises(Exception, match="out of range"):
        raster.one_hot(spark.createDataFrame([(1, 0, 0, 5)], "img long, y int, x int, cls int"), 3).collect()


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = fixtures.view(spark, SF, "subtile_stats").repartition(parts)
    got = with_index(df, [-F.col("frac"), F.col("tile")], buckets=5).orderBy("idx").select("tile", "idx").collect()
    want = sorted(((-r["frac"], r["tile"]) for r in df.collect()))
    assert [(r["tile"], r["idx"]) for r in got] == [(t, i) for i, (_, t) in enumerate(want)]
    run = with_running_sum(df.withColumn("n", F.length("tile").cast("long")), [F.col("tile")], F.col("n"), buckets=4).orderBy("tile").collect()
    assert [r["before"] for r in run] == [sum(x["n"] for x in run[:i]) for i in range(len(run))]
    sample = sorted(r["tile"] for r in sampling.sample_exact(df, "tile", 3, 20).collect())
    assert sample == sorted(r["tile"] for r in sampling.sample_exact(df.repartition(2), "tile", 3, 20).collect())


def test_augmentation_keeps_masks_aligned(spark):
    px = fixtures.view(spark, SF, "px").where("band = 1 and img % 16 <> 3")
    mask = px.select("img", "y", "x", F.col("v").alias("cls"))
    moved = raster.augment(mask, 8, 5)
    both = raster.augment(px.withColumn("old", F.col("v")), 8, 5).join(moved, ["img", "y", "x"])
    assert both.where("old <> cls").count() == 0 and both.count() == px.count()


@pytest.mark.parametrize("name", ["tile_ring", "overlay_pairs", "tiles_with_truth", "valid_tiles", "rasterize", "rasterize_simple", "sample_exact", "sample_negatives", "global_index"])
def test_no_nested_loops_and_no_single_partition(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["rasterize", "rasterize_simple", "rasterize_rings", "rasterize_rings_simple"])
def test_burnt_cells_are_not_broadcast(spark, name):
    # A table of polygons is small, the cells that they burn are many; the driver would hold them all.
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_views_deal_out_a_table_of_one_task(spark):
    assert fixtures.view(spark, "/root/testdata/sf0.1", "geo").rdd.getNumPartitions() == 2


def test_views_grow_with_their_tables(spark):
    customers = spark.read.parquet("/root/testdata/sf0.1/customer.parquet").count()
    assert fixtures.view(spark, "/root/testdata/sf0.1", "grid").count() == customers // 15
    assert fixtures.view(spark, "/root/testdata/sf0.1", "cells").count() == customers // 15 * 400
    assert fixtures.view(spark, "/root/testdata/sf0.1", "polys").count() > 0.8 * customers


def test_generalized_dice_with_an_absent_class(spark):
    px = spark.createDataFrame([(1, 0, 0.7, 0.2, 0.1), (1, 0, 0.7, 0.2, 0.1), (1, 1, 0.3, 0.6, 0.1)], "sample long, t int, p0 double, p1 double, p2 double")
    # By hand: class sizes 2, 1, 0; sums of probabilities 1.7, 1, 0.3; of the true ones 1.4, 0.6, 0.
    assert ev.gdice(px, 3).first()[0] == pytest.approx(1 - 2 * (1.4 / 4 + 0.6 + 1e-9) / (3.7 / 4 + 2.0 + 0.3e9), abs=1e-13)
    assert ev.gdice_sample(px, 3).first()[0] == pytest.approx(1 - 2 * (1.4 / 4 + 0.6 + 1e-10) / (3.7 / 4 + 2.0 + 0.3e10), abs=1e-13)


def test_scores_become_probabilities(spark):
    row = ev.softmax(spark.createDataFrame([(1000.0, 1000.0, 999.0)], "p0 double, p1 double, p2 double"), 3).first()
    assert row["p0"] == row["p1"] == pytest.approx(1 / (2 + np.exp(-1))) and sum(row) == pytest.approx(1)


def test_model_interface():
    seen = []

    def fn(batch):
        seen.append(batch.shape)
        return np.stack([batch[:, 0], 1 - batch[:, 0]], axis=1)

    fn.bands = 3
    assert score.infer(fn, np.zeros((4, 2, 2))).tolist() == [[1, 1], [1, 1]] and seen == [(1, 3, 2, 2)]
    assert score.infer(fn, np.ones((5, 4, 2, 2))).shape == (5, 2, 2) and seen[1] == (5, 3, 2, 2)
    for bad, error in (([[1.0]], TypeError), (np.zeros((2, 2)), ValueError)):
        with pytest.raises(error):
            score.infer(fn, bad)
    with pytest.raises(ValueError, match="gave"):
        score.infer(lambda b: b[:, 0], np.zeros((1, 3, 2, 2)))


@pytest.mark.parametrize("name", ["score_linear", "score_normalized", "score_fraction", "score_ensemble"])
def test_tiles_without_all_bands_are_scored(spark, tmp_path, name):
    import duckdb

    # The last tile has two bands only, as in tables whose vectors aren't a multiple of four.
    con, path = duckdb.connect(), f"{tmp_path}/embeddings.parquet"
    con.sql(f"copy (select * from '{SF}/embeddings.parquet' where vec_id < 42) to '{path}' (format parquet)")
    con.sql(f"create view embeddings as select * from '{path}'")
    df, sql = catalog.queries()[name](spark, str(tmp_path)), con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    ours = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    assert ours == sorted(tuple(map(norm, r)) for r in sql.select(*[f'"{c}"' for c in cols]).fetchall())
    assert df.where("img = 10").count() > 0


def test_turns_are_quarter_turns(spark):
    grid = np.arange(16).reshape(4, 4)
    px = spark.createDataFrame([(t, y, x, int(grid[y, x]), "n", t) for t in range(4) for y in range(4) for x in range(4)], "img long, y int, x int, v int, __f string, __t int")
    out = np.zeros((4, 4, 4), int)
    for r in raster.flip_rot(px, 4).collect():
        out[r["img"], r["y"], r["x"]] = r["v"]
    assert all((out[t] == np.rot90(grid, t)).all() for t in range(4))


def test_extra_sets_and_missing_predictions(spark):
    assert sampling.extra_sets(["a-*", "b-*"], [3, 1]) == {"a-*": 3, "b-*": 1}
    for args in ((["a"], [1, 2]), (["a"], []), (["a"], [1], 3)):
        with pytest.raises(ValueError, match="extra sets"):
            sampling.extra_sets(*args)
    forest, pred = fixtures.view(spark, SF, "lu_px"), fixtures.view(spark, SF, "pred_px")
    assert stats.require_predictions(pred, forest) is pred
    with pytest.raises(ValueError, match="no prediction"):
        stats.require_predictions(pred.where("img > 3"), forest)


def test_report_names_its_sources(spark):
    import json

    got = json.loads(stats.stats_report(catalog.queries()["band_stats"](spark, SF), ["/data/2019", "/data/2020"], 0.1).first()[0])
    assert got["sources"] == ["/data/2019", "/data/2020"] and got["frac"] == 0.1 and got["date"][:2] == "20" and set(got["results"]) == {"1", "2", "3", "4"}


def test_scratch_files_go(spark):
    from tilewright.functions.lineage import cut, keep, scratch, shared_dir

    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    with scratch(spark):
        kept = keep(cut(spark.range(5), "gone"), "stays")
    assert {n.split("-")[0] for n in set(os.listdir(at)) - before} == {"stays"} and kept.count() == 5


def test_shards_round_trip(spark, tmp_path):
    samples = spark.range(70).select(F.format_string("t_%03d", "id").alias("key"), F.create_map(F.lit("rgbn.tif"), F.encode(F.lit("px"), "utf-8"), F.lit("txt"), F.encode(F.col("id").cast("string"), "utf-8")).alias("parts"))
    counts = {r["name"]: r["samples"] for r in io.write_shards(samples, str(tmp_path / "s"), "train-%03d.tar", 32).collect()}
    assert counts == {"train-000.tar": 32, "train-001.tar": 32, "train-002.tar": 6}
    back = io.read_shards(spark, str(tmp_path / "s"), "train-*.tar").orderBy("shard", "pos").collect()
    assert [r["key"] for r in back] == [f"t_{i:03d}" for i in range(70)] and bytes(back[69]["parts"]["txt"]) == b"69"
    assert io.read_any(spark, str(tmp_path / "s")).count() == 70
    io.write_shards(samples, str(tmp_path / "more"), "train-%03d.tar", 50)
    assert io.read_shards(spark, [str(tmp_path / "s"), str(tmp_path / "more")]).count() == 140
    one = io.to_tuple(io.read_shards(spark, str(tmp_path / "s")).where("key = 't_007'"), "txt", "lu.tif").first()
    assert (one["key"], bytes(one["txt"]), one["lu.tif"]) == ("t_007", b"7", None)


def test_files_round_trip(spark, tmp_path):
    stats_df = fixtures.view(spark, SF, "subtile_stats")
    io.write_stats(stats_df, str(tmp_path / "stats"))
    assert io.read_stats(spark, str(tmp_path / "stats")).exceptAll(stats_df).count() == 0
    (tmp_path / "grid.csv").write_text("a;0;100;0;100\nb;100;200;0;100\n")
    grid = io.read_grid(spark, str(tmp_path / "grid.csv"))
    assert vector.tile_ring(grid).count() == 10
    tiles = score.pack_tiles(fixtures.view(spark, SF, "px"), 8)
    io.write_tiles(tiles, str(tmp_path / "tiles"))
    assert io.read_tiles(spark, str(tmp_path / "tiles")).count() == tiles.count()
    (tmp_path / "x.bin").write_bytes(bytes(4))
    assert io.read_tiles(spark, str(tmp_path), "*.bin", lambda b: (2, 2, 1, b)).first()["data"] == bytes(4)
    shares = catalog.queries()["forest_share"](spark, SF).withColumn("filename", F.lit("a"))
    io.write_shares(shares, grid, str(tmp_path / "shares"))
    assert "POLYGON" in spark.read.parquet(str(tmp_path / "shares")).first()["wkt"]
    io.write_area(catalog.queries()["area_by_year"](spark, SF), str(tmp_path / "area"))
    assert spark.read.csv(str(tmp_path / "area"), header=True).columns[:2] == ["img", "total"]
    io.write_usage(catalog.queries()["usage"](spark, SF), str(tmp_path / "usage"))


def test_scratch_blocks_belong_to_their_thread(spark):
    from concurrent.futures import ThreadPoolExecutor

    gate = threading.Barrier(2)

    def first():
        with scratch(spark):
            gate.wait(60)  # both blocks are open
            cut(spark.range(10))
            gate.wait(60)
        gate.wait(60)  # this block is over

    def second():
        with scratch(spark):
            gate.wait(60)
            df = cut(spark.range(20))
            gate.wait(60)
            gate.wait(60)
            return df.count()

    with ThreadPoolExecutor(2) as pool:
        done = [pool.submit(first), pool.submit(second)]
        assert done[0].result() is None and done[1].result() == 20


def test_shared_folder_without_a_setting():
    class Context:
        master, applicationId = "local", "app-7"

    class Session:
        sparkContext = Context
        conf = {}

    assert shared_dir(Session) == shared_dir(Session) and os.path.isdir(shared_dir(Session))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://local[2]"):
        Context.master = master
        with pytest.raises(ValueError):
            shared_dir(Session)


def test_shards_with_folders(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in [("v1.2", None), ("v1.2/a.tif", b"1"), ("v1.2/a.txt.gz", b"22"), ("b.tif", b"3"), ("v1.2/.hidden", b"4")]:
            info = tarfile.TarInfo(name)
            info.type = tarfile.DIRTYPE if data is None else tarfile.REGTYPE
            info.size = len(data or b"")
            tar.addfile(info, BytesIO(data) if data else None)
    got = {r["key"]: {k: bytes(v) for k, v in r["parts"].items()} for r in io.read_shards(spark, str(tmp_path)).collect()}
    assert got == {"v1.2/a": {"tif": b"1", "txt.gz": b"22"}, "b": {"tif": b"3"}, "v1.2/": {"hidden": b"4"}}


def star(r, x, y, big, n=9):
    """A ring of 2 n corners at random distances around a point, which sees them all."""
    turns = np.sort(r.uniform(0, 2 * np.pi, 2 * n - 2).tolist() + [0.1, 3.2])
    far = r.uniform(0.5, 1, 2 * n) * big
    ring = [(float(x + f * np.cos(t)), float(y + f * np.sin(t))) for f, t in zip(far, turns, strict=True)]
    return [*ring, ring[0]]


def clipped_area(ring, x0, y0, x1, y1):
    """Area of a ring inside a box, by cutting the ring at each side in turn."""
    points = ring[:-1]
    for axis, at, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(points, [*points[1:], *points[:1]], strict=True):
            ia, ib = keep * (a[axis] - at) >= 0, keep * (b[axis] - at) >= 0
            if ia:
                out.append(a)
            if ia != ib:
                t = (at - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(p + t * (q - p) for p, q in zip(a, b, strict=True)))
        points = out
        if not points:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], *points[:1]], strict=True))) / 2


@pytest.fixture(scope="module")
def shapes(spark):
    r, rows = np.random.default_rng(3), []
    for pid in range(25):
        x, y, big = *r.uniform(-60, 160, 2), float(r.choice([3, 20, 70]))
        part = [star(r, x, y, big)]
        if pid % 2:
            part.append(star(r, x, y, big * 0.3))  # inside, as the outline stays beyond half of its radius
        geometry = [[ring[::-1] if r.random() < 0.5 else ring for ring in part]]
        if pid % 3 == 0:
            geometry.append([star(r, x + 3 * big, y, big)])
        rows.append((pid, geometry))
    rows.append((100, [[[(10.0, 20.0), (40.0, 20.0), (40.0, 50.0), (10.0, 50.0), (10.0, 20.0)]]]))  # along the lattice
    rows += [(101, None), (102, [])]
    return rows, spark.createDataFrame(rows, "pid int, geometry array<array<array<struct<x:double,y:double>>>>").repartition(3)


def test_covering_areas_against_clipping(spark, shapes):
    rows, df = shapes
    got = {(r["pid"], r["row"], c): r["area"] for r in rings.covering(df, ["pid"], 10.0).collect() for c in range(r["lo"], r["hi"] + 1)}
    want = {}
    for pid, geometry in rows:
        for part in geometry or []:
            for i, ring in enumerate(part):
                xs, ys = zip(*ring, strict=True)
                for cy in range(int(min(ys) // 10), int(max(ys) // 10) + 1):
                    for cx in range(int(min(xs) // 10), int(max(xs) // 10) + 1):
                        a = clipped_area(ring, cx * 10, cy * 10, cx * 10 + 10, cy * 10 + 10)
                        want[pid, cy, cx] = want.get((pid, cy, cx), 0.0) + (a if i == 0 else -a)
    want = {k: v for k, v in want.items() if v > 1e-7}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-7 for k in want)
    assert {k[1:] for k in got if k[0] == 100} == {(y, x) for y in (2, 3, 4) for x in (1, 2, 3)}


def test_covering_grows_with_the_outline(spark):
    square = lambda n: [[[(0.5, 0.5), (n, 0.5), (n, n), (0.5, n), (0.5, 0.5)]]]
    df = spark.createDataFrame([(1, square(2000.0)), (2, square(4000.0))], "pid int, geometry array<array<array<struct<x:double,y:double>>>>")
    n = {r["pid"]: r["count"] for r in rings.covering(df, ["pid"], 1.0).groupBy("pid").count().collect()}
    assert n[1] <= 8 * 2000 and n[2] <= 8 * 4000 and abs(n[2] / n[1] - 2) < 0.01
    grid = spark.range(60).selectExpr("cast(id as string) as filename", "cast(id * 61 - 3 as double) as x1", "cast(id * 67 % 4100 as double) as y1")
    got = {(int(r["filename"]), r["pid"]) for r in rings.overlay_area(grid, df, 1.0).collect()}
    assert got == {(i, p) for i in range(60) for p, n in ((1, 2000), (2, 4000)) if 0 <= i * 61 - 3 < n and i * 67 % 4100 < n}
    assert "NestedLoop" not in rings.overlay_area(grid, df, 1.0)._jdf.queryExecution().toString()


@pytest.mark.parametrize(("lo", "hi"), [(0, 0), (5, 5), (3, 900), (-17, 40), (-8, -1), (0, 3 << 17)])
def test_runs_are_halved_into_blocks(spark, lo, hi):
    got = [tuple(b) for b in spark.range(1).select(rings._halves(F.lit(lo), F.lit(hi))).first()[0]]
    assert sorted(n for k, b in got for n in range(b << k, (b + 1) << k)) == list(range(lo, hi + 1))
    assert len(got) <= 2 * rings.LEVELS + ((hi - lo) >> rings.LEVELS) + 1


def test_geometry_round_trips(spark, shapes):
    rows, df = shapes
    both = df.where("size(geometry) > 0 or geometry is null").select("pid", "geometry", rings.from_wkb(rings.to_wkb(F.col("geometry"))).alias("b"), rings.from_geojson(rings.to_geojson(F.col("geometry"))).alias("j"))
    assert all(r["b"] == r["geometry"] and r["j"] == r["geometry"] for r in both.collect())
    parts = rings.explode_parts(df)
    assert parts.count() == sum(max(1, len(g or [])) for _, g in rows)
    whole = {r["pid"]: r["a"] for r in df.select("pid", rings.area(F.col("geometry")).alias("a")).collect()}
    summed = {r["pid"]: r["a"] for r in parts.groupBy("pid").agg(F.sum(rings.area(F.col("geometry"))).alias("a")).collect()}
    assert all(abs((whole[p] or 0) - (summed[p] or 0)) < 1e-6 for p in whole)


def test_malformed_geometries_are_null(spark):
    good = struct.pack("<BIII", 1, 3, 1, 4) + np.array([0, 0, 1, 0, 0, 1, 0, 0], "<f8").tobytes()
    big = struct.pack(">BIII", 0, 3, 1, 4) + np.array([0, 0, 1, 0, 0, 1, 0, 0], ">f8").tobytes()
    deep = struct.pack("<BIII", 1, 1003, 1, 4) + np.array([0, 0, 9, 1, 0, 9, 0, 1, 9, 0, 0, 9], "<f8").tobytes()
    reference = struct.pack("<BIIII", 1, 3 | 0x20000000, 4326, 1, 4) + good[13:]
    odd = [b"", good[:-1], good + b"x", b"\x02" + good[1:], struct.pack("<BI", 1, 1), struct.pack("<BIII", 1, 3, 1, 2**31), struct.pack("<BII", 1, 3, 0), good[:-8] + struct.pack("<d", 5), good[:13] + struct.pack("<d", float("nan")) + good[21:]]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [good, big, deep, reference, *odd, None]], "d binary").select(rings.from_wkb(F.col("d"))).collect()]
    assert [g is not None for g in got] == [True] * 4 + [False] * (len(odd) + 1)
    assert all([(p["x"], p["y"]) for p in g[0][0]] == [(0, 0), (1, 0), (0, 1), (0, 0)] for g in got[:4])
    texts = ['{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,1],[0,0]]]}', '{"type":"Polygon","coordinates":[[[0,0,7],[1,0,7],[0,1,7],[0,0,7]]]}']
    bad = ["", "{", '{"type":"Point","coordinates":[0,0]}', '{"type":"Polygon"}', '{"type":"Polygon","coordinates":[]}', '{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}', '{"type":"Polygon","coordinates":[[[0,0],[1,null],[0,1],[0,0]]]}', '{"type":"Polygon","coordinates":"x"}', None]
    got = [r[0] is not None for r in spark.createDataFrame([(x,) for x in texts + bad], "t string").select(rings.from_geojson(F.col("t"))).collect()]
    assert got == [True] * 2 + [False] * len(bad)


def test_burnt_tiles_hold_the_cells(spark, shapes):
    _, df = shapes
    polys = df.withColumn("ty", F.col("pid") % 3)
    grid = spark.range(36).selectExpr("concat('t', id) as filename", "cast((id % 6) * 40 - 80 as double) as x1", "cast(floor(id / 6) * 40 - 80 as double) as y1")
    cells = grid.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(99)))).selectExpr("filename", "cast(floor(v / 10) as int) as y", "cast(v % 10 as int) as x", "x1 + (v % 10) * 4 as cx", "y1 + floor(v / 10) * 4 as cy")
    for simple in (False, True):
        want = {tuple(r) for r in rings.rasterize_rings(cells, polys, 4.0, simple).where("cls > 0").collect()}
        got = {tuple(r) for r in score.unpack_named(rings.burn_tiles(grid, polys, 10, 4.0, simple)).where("cls > 0").collect()}
        assert got == want and len(want) > 100


def lzw(data: bytes) -> bytes:
    """The plain form of the packing: codes of growing width, a clear code at the start and when the table is full."""
    table, width, bits, word = {bytes([i]): i for i in range(256)}, 9, [], b""
    put = lambda code: bits.append(format(code, f"0{width}b"))
    put(256)
    n = 258
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer], n, word = n, n + 1, bytes([b])
        if n == 4094:
            put(256)
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        elif n >= (1 << width):
            width += 1
    if word:
        put(table[word])
        if n + 1 >= (1 << width) and width < 12:
            width += 1
    put(257)
    joined = "".join(bits)
    return bytes(int(joined[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(joined), 8))


@pytest.mark.parametrize("n", [0, 1, 300, 5000, 40_000])
def test_lzw_unpacks(n):
    r = np.random.default_rng(n)
    for data in (r.integers(0, 256, n, np.uint8).tobytes(), r.integers(0, 3, n, np.uint8).tobytes(), b"a" * n):
        assert tiff.unpack_lzw(lzw(data)) == data


def plain_tiff(a: np.ndarray, order: str, big: bool, compression: int, predictor: int, planar: int, tile: tuple | None) -> bytes:
    """A file of any layout: bands x rows x columns in tiles, or in strips of 7 rows."""
    bands, h, w = a.shape
    th, tw = tile or (7, w)
    blocks = []
    for planes in [[b] for b in range(bands)] if planar == 2 else [range(bands)]:
        for y in range(0, h, th):
            for x in range(0, w, tw):
                rows = th if tile else min(th, h - y)
                part = np.zeros((rows, tw, len(planes)), a.dtype)
                got = a[list(planes), y : y + th, x : x + tw].transpose(1, 2, 0)
                part[: got.shape[0], : got.shape[1]] = got
                if predictor == 2:
                    part[:, 1:] -= part[:, :-1].copy()
                raw = part.astype(a.dtype.newbyteorder(order)).tobytes()
                blocks.append({1: raw, 5: lzw(raw), 8: zlib.compress(raw)}[compression])
    head, long_, inline = (16, "Q", 8) if big else (8, "I", 4)
    offsets = np.cumsum([head] + [len(b) for b in blocks])[:-1].tolist()
    kind = 16 if big else 4
    fields = {256: (4, [w]), 257: (4, [h]), 258: (3, [8 * a.dtype.itemsize] * bands), 259: (3, [compression]), 277: (3, [bands]), 284: (3, [planar]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * bands)}
    fields |= {322: (3, [tw]), 323: (3, [th]), 324: (kind, offsets), 325: (4, [len(b) for b in blocks])} if tile else {273: (kind, offsets), 278: (3, [th]), 279: (4, [len(b) for b in blocks])}
    at = head + sum(map(len, blocks))
    size = 20 if big else 12
    beyond, table = b"", b""
    start = at + (8 if big else 2) + size * len(fields) + inline
    for f, (k, v) in sorted(fields.items()):
        data = struct.pack(f"{order}{len(v)}{ {3: 'H', 4: 'I', 16: 'Q'}[k]}", *v)
        table += struct.pack(f"{order}HH{long_}", f, k, len(v)) + (data.ljust(inline, b"\0") if len(data) <= inline else struct.pack(f"{order}{long_}", start + len(beyond)))
        beyond += data if len(data) > inline else b""
    name = b"II" if order == "<" else b"MM"
    first = struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{order}HI", 42, at)
    return name + first + b"".join(blocks) + struct.pack(f"{order}{'Q' if big else 'H'}", len(fields)) + table + struct.pack(f"{order}{long_}", 0) + beyond


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_raster_files_of_any_layout(order, big):
    r = np.random.default_rng(1)
    for kind in (np.uint8, np.uint16, np.float32):
        a = (r.random((3, 50, 70)) * 250).astype(kind)
        for compression in (1, 5, 8):
            for predictor in (1, 2) if kind is not np.float32 else (1,):
                for planar in (1, 2):
                    for tile in (None, (16, 32)):
                        got = tiff.decode_tiff(plain_tiff(a, order, big, compression, predictor, planar, tile))
                        assert got.dtype == a.dtype and np.array_equal(got, a), (kind, compression, predictor, planar, tile)


def test_encoded_rasters_come_back():
    r = np.random.default_rng(2)
    for shape in ((1, 1, 1), (4, 100, 333), (3, 256, 256)):
        a = r.integers(0, 256, shape, np.uint8)
        for predictor in (True, False):
            data = tiff.encode_tiff(a, 64, predictor, (500.0, 9000.0, 0.2, 0.2))
            assert np.array_equal(tiff.decode_tiff(data), a)
            assert tiff.RasterFile(lambda at, n, d=data: d[at : at + n]).geo() == (500.0, 9000.0, 0.2, 0.2)
    for bad in (b"", b"II*\0", b"PNG" * 10):
        with pytest.raises((ValueError, struct.error)):
            tiff.decode_tiff(bad)


def test_windows_read_only_their_bytes(spark, tmp_path):
    r = np.random.default_rng(3)
    a = r.integers(0, 256, (4, 1500, 2100), np.uint8)
    file = tmp_path / "a.tif"
    file.write_bytes(tiff.encode_tiff(a, 64))
    size = file.stat().st_size
    box = (130, 700, 400, 900)
    rows = tiff.read_raster(spark, str(file), box).collect()
    assert {(x["row"], x["col"]) for x in rows} == {(y, x) for y in range(700 // 64, 899 // 64 + 1) for x in range(130 // 64, 399 // 64 + 1)}
    for x in rows:
        tile = np.frombuffer(x["data"], np.uint8).reshape(x["bands"], x["h"], x["w"])
        assert np.array_equal(tile, a[:, x["y0"] : x["y0"] + x["h"], x["x0"] : x["x0"] + x["w"]])
    assert sum(x["n_read"] for x in rows) < 1.05 * size * len(rows) / (33 * 24)
    whole = tiff.read_raster(spark, str(tmp_path))
    assert whole.count() == 24 * 33 and whole.rdd.getNumPartitions() == 24 * 2
    assert tiff.read_raster(spark, str(file), (5000, 0, 6000, 10)).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = tiff.read_raster(spark, str(file)).where("row = 3 and col >= 30")
        assert some.rdd.getNumPartitions() == 1 and some.count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_many_raster_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiff, "MANY_FILES", 5)
    for k in range(40):
        (tmp_path / f"{k:02}.tif").write_bytes(tiff.encode_tiff(np.full((1, 20, 20), k, np.uint8), 16))
    reader = tiff.RasterReader({"path": str(tmp_path)})
    assert [len(p.files) for p in reader.partitions()] == [32, 8]
    got = [b.to_pylist()[0] for p in reader.partitions() for b in reader.read(p)]
    assert len(got) == 160 and all(set(x["data"]) == {int(x["path"][-6:-4])} for x in got)


def test_distances_in_linear_time():
    r = np.random.default_rng(5)
    for shape, share in (((1, 1), 1.0), ((1, 40), 0.1), ((40, 1), 0.1), ((31, 47), 0.02), ((31, 47), 0.5), ((64, 64), 0.001), ((30, 30), 0.0)):
        target = r.random(shape) < share
        got = packed.squared_distance(target)
        at = np.argwhere(target)
        y, x = np.mgrid[: shape[0], : shape[1]]
        want = np.min((y[..., None] - at[:, 0]) ** 2 + (x[..., None] - at[:, 1]) ** 2, axis=2) if len(at) else np.full(shape, np.inf)
        assert np.array_equal(got, want)
    large = r.random((2048, 2048)) < 1e-4
    began = time.time()
    got = packed.squared_distance(large)
    assert time.time() - began < 60 and (got[large] == 0).all() and got.max() < 2048**2
    assert packed.signed_distance(np.array([[0, 1, 1, 1, 1]]), 0, 2).tolist() == [[0, 1, 2, 2, 2]]


def test_distances_cross_tile_borders(spark):
    """A mosaic of 3 x 4 tiles, one of them missing and one with fewer rows, gives what the whole raster gives."""
    r, n, t = np.random.default_rng(6), 16, 5
    whole = np.full((3 * n, 4 * n), packed.ABSENT, np.uint8)
    rows = []
    for row in range(3):
        for col in range(4):
            if (row, col) == (1, 2):
                continue
            tile = (r.random((n, n)) < 0.03).astype(np.uint8) + 2 * (r.random((n, n)) < 0.01).astype(np.uint8)
            tile = tile[: 9 if (row, col) == (2, 3) else n]
            whole[row * n : row * n + len(tile), col * n : col * n + n] = tile
            rows.append((row, col, row * 10 + col, len(tile), n, tile.tobytes()))
    tiles = spark.createDataFrame(rows, "row int, col int, img long, h int, w int, data binary").repartition(4)
    got = {(x["img"], x["k"], x["y"], x["x"]): x["dist"] for x in packed.distance_mosaic(tiles, n, 4, t).collect()}
    assert len(got) == 4 * (11 * n * n - 7 * n)
    for c in range(4):
        hot, other = whole == c, (whole != c) & (whole != packed.ABSENT)
        near = lambda target: np.minimum(np.sqrt(packed.squared_distance(target)), t)
        want = np.where(hot, 1 - near(other), near(hot))
        for img, k, y, x in got:
            if k == c:
                assert got[img, k, y, x] == pytest.approx(want[img // 10 * n + y, img % 10 * n + x])
    with pytest.raises(ValueError):
        packed.distance_mosaic(tiles, n, 4, n + 1)


def test_packed_statistics_shuffle_no_pixels(spark):
    tiles = score.pack_tiles(fixtures.view(spark, SF, "px"), 8)
    cached = tiles.cache()
    try:
        assert "Exchange" not in packed.class_counts_packed(cached, keys=["img"])._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert packed.band_stats_packed(cached.limit(0), 4).count() == 0 and packed.nodata_packed(cached.limit(0)).count() == 0
    finally:
        cached.unpersist()
    px = fixtures.view(spark, SF, "px")
    plan = stats.band_stats(px, 8, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") + plan.count("LogicalRelation") <= 1 and "Join" not in plan


def test_packer_streams_large_tiles(spark):
    """Tiles that span many batches, keys of two columns, nulls among the keys."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        px = spark.range(5 * 40 * 30).selectExpr("cast(case when id % 5 = 4 then null else id % 5 end as long) as img", "cast(id % 5 % 2 as int) as yr", "1 as band", "cast(floor(id / 5 / 30) as int) as y", "cast(floor(id / 5) % 30 as int) as x", "cast(id % 251 as int) as v").repartition(7)
        tiles = score.pack_tiles(px, 40, keys=("yr", "img"))
        want = {}
        for r in px.collect():
            want.setdefault((r["yr"], r["img"]), np.zeros((40, 30), np.uint8))[r["y"], r["x"]] = r["v"]
        got = {(r["yr"], r["img"]): np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"]) for r in tiles.collect()}
        assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want) and tiles.count() == 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shards_by_their_index(spark, tmp_path):
    """An index of headers, of long names and other formats too, and members read by their ranges."""
    r = np.random.default_rng(9)
    for k, form in enumerate((tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT)):
        with tarfile.open(tmp_path / f"s{k}.tar", "w", format=form) as tar:
            for i in range(20):
                name = ("long" * 40 + "/" if i == 3 and form != tarfile.USTAR_FORMAT else "d/") + f"k{i:02}"
                for part in ("tif", "txt"):
                    info = tarfile.TarInfo(f"{name}.{part}")
                    info.size = int(r.integers(0, 2000))
                    tar.addfile(info, BytesIO(r.bytes(info.size)))
            link = tarfile.TarInfo("link")
            link.type, link.linkname = tarfile.SYMTYPE, "d/k00.tif"
            tar.addfile(link)
    index = io.shard_index(spark, str(tmp_path))
    assert index.count() == 120
    got = {(x["shard"], x["key"]): {k: bytes(v) for k, v in x["parts"].items()} for x in io.read_members(index.where("key like '%k0%'")).collect()}
    want = {(x["shard"], x["key"]): {k: bytes(v) for k, v in x["parts"].items()} for x in io.read_shards(spark, str(tmp_path)).where("key like '%k0%'").collect()}
    assert got == want and len(got) == 30


def test_shards_beyond_two_gigabytes(tmp_path):
    """Headers hop over data: a sparse shard of 5 GB gives its members in a few reads."""
    size, path = 3 << 30, tmp_path / "big.tar"
    with open(path, "wb") as f:
        for name, n in (("a.tif", size), ("b.tif", 2 << 30), ("c.txt", 3)):
            info = tarfile.TarInfo(name)
            info.size = n
            f.write(info.tobuf(tarfile.GNU_FORMAT))
            f.write(b"abc") if n == 3 else f.seek(n, 1)
            f.seek(-(-f.tell() // 512) * 512)
        f.truncate(f.tell() + 1024)
    reads = []
    read = io.opener(str(path))
    found = list(io.tar_members(lambda at, n: reads.append(n) or read(at, n)))
    assert [(n, s) for n, _, s in found] == [("a.tif", size), ("b.tif", 2 << 30), ("c.txt", 3)] and sum(reads) < 10_000
    assert read(found[2][1], 3) == b"abc"


def test_failed_shard_writes_leave_nothing(spark, tmp_path):
    df = spark.range(100).selectExpr("format_string('k%03d', id) as key", "map('txt', cast(cast(id as string) as binary)) as parts")
    bad = df.withColumn("parts", F.when(F.col("key") == "k077", F.raise_error(F.lit("broken")).cast("map<string,binary>")).otherwise(F.col("parts")))
    with pytest.raises(Exception, match="broken"):
        io.commit_shards(bad.selectExpr("cast(substr(key, 2) as long) div 10 as shard", "0 as pos", "key", "map_entries(parts) as parts").repartition("shard").sortWithinPartitions("shard", "key"), str(tmp_path / "out"), "x-%03d.tar")
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    done = io.write_shards(df, str(tmp_path / "out"), "x-%03d.tar", 30)
    assert sorted(tuple(r) for r in done.collect()) == [("x-000.tar", 30), ("x-001.tar", 30), ("x-002.tar", 30), ("x-003.tar", 10)]
    assert sorted(os.listdir(tmp_path / "out")) == [f"x-00{k}.tar" for k in range(4)]
    assert {r["key"]: bytes(r["parts"]["txt"]) for r in io.read_shards(spark, str(tmp_path / "out")).collect()} == {f"k{i:03}": str(i).encode() for i in range(100)}


def test_samples_by_selection_are_the_first_in_order(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SMALL", 5)
    df = spark.range(3000).selectExpr("cast(id % 1700 as string) as k", "id as other").unionByName(spark.createDataFrame([(None, i) for i in range(4)] + [("hot", i) for i in range(900)], "k string, other long"))
    for n, frac in ((0, None), (1, None), (700, None), (None, 0.25), (3904, None), (10_000, None)):
        got = sampling.sample_exact(df, "k", 3, n, frac)
        want = with_index(df, [F.coalesce(sampling.seeded(F.col("k"), 3), F.lit(""))], "i").where(F.col("i") < (n if n is not None else round(0.25 * 3904)))
        assert sorted(str(r[0]) for r in got.select("k").collect()) == sorted(str(r[0]) for r in want.select("k").collect())
        assert got.distinct().count() == got.count() and {tuple(r) for r in sampling.sample_exact(df.repartition(3), "k", 3, n, frac).collect()} == {tuple(r) for r in got.collect()}


def test_shuffle_buffer(spark):
    samples = spark.range(600).selectExpr("concat('s', id % 7) as shard", "cast(id / 7 as int) as pos", "cast(id as string) as key")
    run = lambda size=10, epoch=0, parts=5: {(r["stream"], r["seq"]): r["key"] for r in sampling.buffered_shuffle(samples.repartition(parts), size, 1, epoch, 3).collect()}
    first = run()
    assert sorted(first.values()) == sorted(str(i) for i in range(600)) and first == run(parts=2) and first != run(epoch=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run() == first  # however the rows come in batches
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for stream in {s for s, _ in first}:
        keys = [first[stream, i] for i in range(sum(s == stream for s, _ in first))]
        shards = {int(k) % 7 for k in keys}
        turn = {k: n for n, k in enumerate(sorted(keys, key=lambda k: (int(k) // 7)))}
        # A sample can't come out before it came in: at most the buffer's size, and one turn of the shards, ahead of its place.
        assert all(turn[k] <= i + 10 + len(shards) for i, k in enumerate(keys)) and keys != sorted(keys, key=lambda k: turn[k])
    assert run(size=1) and run(size=10_000)
    with pytest.raises(ValueError):
        sampling.buffered_shuffle(samples, 0, 1)


def test_layout_by_place_reads_few_files(spark, tmp_path):
    cells = spark.range(64 * 64).selectExpr("cast(id div 64 as int) as row", "cast(id % 64 as int) as col", "cast(id as string) as data")
    order = [tuple(r) for r in cells.withColumn("h", io.hilbert(F.col("row"), F.col("col"), 6)).orderBy("h").select("row", "col").collect()]
    assert len(set(order)) == 4096 and all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(order, order[1:], strict=False))
    assert [r["h"] for r in cells.withColumn("h", io.hilbert(F.col("row"), F.col("col"), 6)).orderBy("h").collect()] == list(range(4096))
    io.write_by_place(cells, str(tmp_path / "t"), 6, 3)
    files = sum(f.endswith(".parquet") for _, _, names in os.walk(tmp_path / "t") for f in names)
    got = io.read_box(spark, str(tmp_path / "t"), 6, 3, (17, 40, 22, 46))
    assert {(r["row"], r["col"]) for r in got.collect()} == {(y, x) for y in range(17, 23) for x in range(40, 47)}
    scan = got._jdf.queryExecution().executedPlan()
    got._jdf.queryExecution().toRdd().count()
    text = scan.toString()
    assert files >= 64 and "PartitionFilters: [block" in text or "PartitionFilters: [isnotnull(block" in text
    metric = [m for m in _metrics(scan) if m[0] == "numFiles"]
    assert metric and metric[0][1] < 0.05 * files


def _metrics(plan):
    out = [(k, plan.metrics().apply(k).value()) for k in ("numFiles",) if plan.metrics().contains(k)]
    for i in range(plan.children().size()):
        out += _metrics(plan.children().apply(i))
    return out
