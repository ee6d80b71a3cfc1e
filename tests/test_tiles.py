"""Grids, masks, ids and hierarchies by hand-computed cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import InvalidArgument, NoSharedFolder, UnknownLevelError, UnknownMethodError
from gridloom.functions import coords
from gridloom.operators import masks, tiles
from gridloom.plans import catalogue, patchify, pictures
from gridloom.plans.patchify import HierarchicalPatchifier, Patchifier, pixel_filter
from gridloom.plans.project import Project, training_batches
from gridloom.sources import discovery, images
from gridloom.sources import slides as S
from gridloom.storage import remove_tree, shared_dir
from tests.compare import TABLES, assert_same


def _slide(spark, width, height, levels=1):
    rows = [("a.mrxs", k, width >> k, height >> k, float(1 << k)) for k in range(levels)]
    return spark.createDataFrame(rows, "slide string, level int, width long, height long, downsample double")


def _places(df):
    return [(r.x, r.y) for r in df.orderBy(F.length("id"), "id").collect()]


@pytest.mark.parametrize(
    ("interval", "want"),
    [(0, [(0, 0), (4, 0), (8, 0), (0, 4), (4, 4), (8, 4)]), (-1, [(0, 0), (3, 0), (6, 0), (0, 3), (3, 3), (6, 3)]), (1, [(0, 0), (5, 0)])],
)
def test_regular_grid(spark, interval, want):
    assert _places(tiles.root_patches(_slide(spark, 12, 8), 0, 4, interval)) == want


def test_grid_edge_cases(spark):
    assert _places(tiles.root_patches(_slide(spark, 3, 3), 0, 4)) == [(0, 0)]  # smaller than a patch: one patch still
    assert tiles.root_patches(_slide(spark, 1, 1), 0, 9, -8).count() == 0
    with pytest.raises(InvalidArgument):
        tiles.root_patches(_slide(spark, 8, 8), 0, 4, -4)
    assert tiles.root_patches(_slide(spark, 8, 8).limit(0), 0, 4).count() == 0


@pytest.mark.parametrize(
    ("cells", "want"),
    [([], []), ([(1, 1)], [(4, 4)]), ([(i, j) for i in range(2) for j in range(3)], [(0, 0), (4, 0), (8, 0), (0, 4), (4, 4), (8, 4)])],
)
def test_mask_grid(spark, cells, want):
    mask = spark.createDataFrame([("a.mrxs", i, j, 2, 3) for i, j in cells], "slide string, i int, j int, mask_height int, mask_width int")
    got = tiles.root_patches(_slide(spark, 12, 8), 0, 4, mask=mask)
    assert _places(got) == want
    assert sorted(r.id for r in got.collect()) == [f"#{k + 1}" for k in range(len(want))]


def test_first_root_and_child_patch(spark):
    slides = _slide(spark, 4096, 4096, 3)
    root = tiles.root_patches(slides, 1, 224)
    first = root.where("id = '#1'").first()
    assert (first.global_id, first.x, first.y, first.dx, first.dy, first.size_x, first.parent) == ("a.mrxs#1", 0, 0, 448, 448, 224, None)
    child = tiles.child_patches(root, slides, 0, 224).where("id = '#1#1'").first()
    assert (child.x, child.y, child.dx, child.parent) == (0, 0, 224, "#1")


def test_hierarchy_prunes_and_keeps_ids(spark):
    slides = _slide(spark, 64, 64, 2)
    keep = lambda df: df.where("level = 0 or x >= 32")
    got = tiles.hierarchy(slides, 1, 0, 16, filters={1: [keep]})
    assert sorted(r.id for r in got.where("level = 1").collect()) == ["#2", "#4"]
    assert got.where("level = 0").count() == 8
    assert got.where("level = 0 and x < 32").count() == 0
    assert tiles.hierarchy(slides, 1, 0, 16, filters={1: [lambda df: df.where("false")]}).count() == 0
    with pytest.raises(UnknownLevelError):
        tiles.standard_filters({5: []}, 1, 0)


def test_offset_holds_for_roots_only(spark):
    slides = _slide(spark, 64, 64, 2)
    got = {r.id: (r.x, r.y) for r in tiles.hierarchy(slides, 1, 0, 16, offset=(3, 5)).collect()}
    assert got["#1"] == (3, 5) and got["#1#2"] == (19, 5)


def test_grid_plan_has_no_shuffle_and_no_python(spark):
    plan = tiles.root_patches(_slide(spark, 64, 64), 0, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_coordinates(spark):
    row = spark.range(1).select(coords.add(4, 2).alias("a"), coords.over(-4, 5).alias("b"), coords.times(3, 2.9).alias("c"), coords.negative(7).alias("d"), coords.point(3).alias("p"), coords.if_none(F.lit(None), 5).alias("n")).first()
    assert (row.a, row.b, row.c, row.d, tuple(row.p), row.n) == (6, 0, 6, -7, (3, 3), 5)


def test_pixels_filters_and_builders(spark):
    table = S.slide_table(spark, ["one.mrxs", "two.mrxs"])
    assert table.count() == 10
    flat = Patchifier(3, 64, silence=1)
    every = flat.patchify(table).count()
    flat.add_filter(pixel_filter(["has-tissue-he"], (64, 64)))
    assert 0 < flat.patchify(table).count() <= every
    deep = HierarchicalPatchifier(4, 3, 64)
    deep.add_filter(lambda df: df.where("x = 0"), 4)
    assert deep.patchify(table).where("level = 4 and x > 0").count() == 0
    assert len(deep.by_level[3]) == 0  # levels do not share their filters
    with pytest.raises(UnknownLevelError):
        deep.add_filter(lambda df: df, 9)
    with pytest.raises(InvalidArgument):
        Patchifier(0, 8, silence=3)


class StoredSlide:
    """A reader of files: one level, side and colour as the file says; an empty file is broken."""

    def __init__(self, path):
        with open(path) as f:
            side, self.colour = map(int, f.read().split())
        self.levels = [(side, side, 1.0)]

    def read_region(self, x, y, level, width, height):
        return np.full((height, width, 4), self.colour, np.uint8)


def stored(path):
    return StoredSlide(path)


def test_folders_of_slides(spark, tmp_path):
    """Slides of one name in two folders, a broken one and a nested one, tiled, with pixels, files and features."""
    for name, content in (("a/x.mrxs", "64 10"), ("b/x.mrxs", "32 20"), ("b/c d/y+z.mrxs", "16 30"), ("b/broken.mrxs", ""), ("b/other.txt", "1 1")):
        path = tmp_path / "slides" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    root = str(tmp_path / "slides")
    found = patchify.folder_slides(spark, root, (".mrxs",), True, None, stored)
    assert {r.slide for r in S.unreadable(found).collect()} == {"b/broken.mrxs"}
    assert {(r.slide, r.width) for r in S.readable(found).collect()} == {("a/x.mrxs", 64), ("b/x.mrxs", 32), ("b/c d/y+z.mrxs", 16)}
    out = tmp_path / "out"
    got = Patchifier(0, 16, silence=0, backend=stored).patchify_folder(spark, root, str(out))
    counts = {r["slide"]: r["count"] for r in got.groupBy("slide").count().collect()}
    assert counts == {"a/x.mrxs": 16, "b/x.mrxs": 4, "b/c d/y+z.mrxs": 1}
    assert spark.read.option("header", True).csv(str(out / "unreadable")).first().slide == "b/broken.mrxs"
    images = spark.read.parquet(str(out / "images"))
    assert images.count() == 21
    assert S.write_files(images, str(tmp_path / "png")).count() == 21
    assert (tmp_path / "png/b/c d/y+z.mrxs/level_0/0_0_0.png").read_bytes().startswith(b"\x89PNG")
    assert HierarchicalPatchifier(0, 0, 16, backend=stored).patchify_folder(spark, root).count() == 21
    assert Patchifier(0, 16, backend=stored).patchify_folder(spark, root, folders=["a"]).count() == 16
    pixels = S.with_pixels(got.withColumn("slide", F.concat(F.lit("no/"), "slide")), root, stored, errors="why")
    assert pixels.where("pixels is null and why like 'FileNotFoundError%'").count() == 21
    with pytest.raises(UnknownMethodError):
        S.slide_table(spark, ["x"], "no such reader")
    spark.dataSource.register(S.slide_source(stored, "stored"))
    assert [r.width for r in spark.read.format("stored").option("paths", f"{root}/a/x.mrxs").load().collect()] == [64]


def test_folders_that_are_slides(spark, tmp_path):
    """Without recursion no folder is entered; a folder named as a slide is one, whether it has parts, deeper ones or keys."""
    names = ("a.mrxs", "b.mrxs/part-0.mrxs", "b.mrxs/part-1.mrxs", "c d+e.MRXS/k=1/x.bin", "c d+e.MRXS/k=2/x.bin", "other/d.mrxs", "other/e.png", "f.png", "g.png/h.png", ".i.mrxs/j.mrxs", "k.mrxs/_SUCCESS")
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("8 1")
    root = str(tmp_path)
    of = lambda df: sorted((r.path, r.rel) for r in df.collect())
    at = lambda *rel: [(f"{root}/{n}", n) for n in rel]
    assert of(discovery.get_files(spark, root, (".mrxs",), recurse=False)) == at("a.mrxs", "b.mrxs", "c d+e.MRXS")
    assert of(discovery.get_files(spark, root + "/", recurse=False)) == at("a.mrxs", "f.png")
    assert of(discovery.get_files(spark, root, (".mrxs",))) == at("a.mrxs", "b.mrxs/part-0.mrxs", "b.mrxs/part-1.mrxs", "other/d.mrxs")
    assert of(discovery.slides_in_folder(spark, root)) == at("a.mrxs", "b.mrxs")
    assert of(discovery.images_in_folder(spark, root)) == at("f.png")


def test_tables_of_several_parts_are_one_slide(spark, tmp_path):
    for k, name in enumerate(TABLES):
        folder = tmp_path / f"{name}.parquet"
        files = [folder] if k % 3 else [folder / "part-0000.parquet", folder / "part-0001.parquet", folder / "_SUCCESS"]
        files[0].parent.mkdir(exist_ok=True)
        for file in files:
            file.write_bytes(b"x")
    assert_same(catalogue.QUERIES["tile_folder"](spark, str(tmp_path)), "/root/testdata/sf0.001", catalogue.ORACLES["tile_folder"])


def test_project_of_nested_folders(spark, tmp_path):
    """Patch files at any depth; features and training batches of pixels."""
    for name, colour in (("p/one", 40), ("two", 80)):
        (tmp_path / "slides" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "slides" / f"{name}.mrxs").write_text(f"16 {colour}")
        folder = tmp_path / "project" / name
        folder.mkdir(parents=True)
        rows = [f"#{k},{name}#{k},{8 * (k % 2)},{8 * (k // 2)},0,8,8,8,8,None,{k}" for k in range(4)]
        (folder / "patches.csv").write_text("\n".join(["id,global_id,x,y,level,dx,dy,size_x,size_y,parent,grade", *rows]) + "\n")
    own = Project(spark, str(tmp_path / "project"), str(tmp_path / "slides"))
    listed = own.list_patches(0, "grade", [("grade", "int")])
    assert listed.count() == 8
    mean = lambda x: x.mean(axis=(1, 2))
    got = own.extract_features(mean, 0, stored, (8, 8), prepare=lambda x: x / 2.0)
    assert {(r.slide_path.rsplit("/", 1)[-1], *r.features) for r in got.collect()} == {("one.mrxs", 20, 20, 20), ("two.mrxs", 40, 40, 40)}
    batches = list(training_batches(listed.withColumn("slide", F.col("slide_path")), 3, lambda x: x + 1, stored))
    assert [len(labels) for _, labels in batches] == [3, 3, 2] and sorted(v for _, labels in batches for v in labels) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert batches[0][0].shape == (3, 8, 8, 3) and {int(v) for b, _ in batches for v in b.ravel()} == {41, 81}


def test_image_files():
    rng = np.random.default_rng(2)
    for shape in ((5, 7), (6, 3, 3), (4, 9, 4), (1, 1, 3)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (images.decode(images.png(image)) == image).all()
        assert (images.decode(images.tiff(image)) == image).all()
    with pytest.raises(UnknownMethodError):
        images.decode(b"GIF89a")
    above, line = rng.integers(0, 256, 12).astype(np.uint8), rng.integers(0, 256, 12).astype(np.uint8)
    for kind in range(5):  # each filter undone as PNG defines it, sample by sample
        want = []
        for i, v in enumerate(line.tolist()):
            a, b, c = (want[i - 3] if i > 2 else 0), int(above[i]), (int(above[i - 3]) if i > 2 else 0)
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            want.append((v + (0, a, b, (a + b) // 2, nearest)[kind]) & 255)
        assert images._unfiltered(kind, line, above, 3).tolist() == want


def test_previews_and_segmentations_as_files(spark, tmp_path):
    table = S.slide_table(spark, ["one.mrxs"])
    patches = tiles.root_patches(table, 2, 256)
    (row,) = pictures.previews(patches, table, colour=(1, 2, 3)).collect()
    image = images.decode(bytes(row.content))
    marked = {(i, j) for i, j in zip(*np.where((image == (1, 2, 3)).all(axis=2)), strict=True)}
    assert row.path == "one.mrxs.png" and marked == {(r.i, r.j) for r in tiles.outline_pixels(patches, table).collect()}
    folder = tmp_path / "level_1"
    folder.mkdir()
    grey = np.repeat(np.arange(6, dtype=np.uint8)[:, None], 5, axis=1)
    for name, body in (("a.png", images.png(np.stack([grey] * 3, axis=2))), ("b.tif", images.tiff(grey)), ("thumbnail.png", b""), ("b_semantic.tiff", b"")):
        (folder / name).write_bytes(body)
    top = lambda x: x.max(axis=1)
    for channels in (False, True):
        got = {r.path: images.decode(bytes(r.content)) for r in pictures.coarse_files(spark, str(tmp_path), 1, top, 2, channels).collect()}
        want = np.zeros((6, 5), np.uint8)
        want[:, :4] = np.repeat([[1], [1], [3], [3], [5], [5]], 4, axis=1)
        assert set(got) == {"a_semantic.tiff", "b_semantic.tiff"} and (got["b_semantic.tiff"] == want).all()
        assert (got["a_semantic.tiff"] == (np.stack([want] * 3, axis=2) if channels else want)).all()
    read = discovery.decoded_images(images.contents(discovery.images_in_folder(spark, str(folder), forbidden=("thumbnail", "semantic"))))
    assert {(r.height, r.width, r.channels) for r in read.collect()} == {(6, 5, 3), (6, 5, 1)}


def test_dilation_and_removal(spark, tmp_path):
    cells = spark.createDataFrame([(0, 3, 3), (0, 3, 4), (1, 0, 0)], "m int, i int, j int")
    got = {tuple(r) for r in masks.dilated(cells, ["m"], 1).collect()}
    want = {(m, i + a, j + b) for m, i, j in ((0, 3, 3), (0, 3, 4), (1, 0, 0)) for a, b in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))}
    assert got == want and masks.disk(0) == [(0, 0)] and len(masks.disk(2)) == 13
    (tmp_path / "x/y").mkdir(parents=True)
    answers = iter(["what", "N", "y"])
    assert not remove_tree(spark, str(tmp_path / "x"), ask=lambda _: next(answers)) and (tmp_path / "x").exists()
    assert not remove_tree(spark, str(tmp_path / "x"), False) and remove_tree(spark, str(tmp_path / "x"), ask=lambda _: next(answers)) and not (tmp_path / "x").exists()


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(NoSharedFolder):
        shared_dir(Session)


def test_slide_source_and_levels(spark):
    spark.dataSource.register(S.SlideSource)
    got = spark.read.format("slides").option("paths", "x.mrxs,y.mrxs").load()
    assert got.count() == 10
    assert {r.level for r in S.best_level(got, 5.0).collect()} == {2}
    image = S.ProceduralSlide("x.mrxs").read_region(-8, 0, 0, 16, 4)
    assert (image[:, :8] == 0).all() and (image[:, 8:, 3] == 255).all()
    assert S.png(image[..., :3]).startswith(b"\x89PNG")


def test_outlines(spark):
    slides = _slide(spark, 100, 100)
    patches = tiles.root_patches(slides, 0, 50)
    got = tiles.outline_pixels(patches, slides, min_res=100, thickness=1)
    pixels = {(r.i, r.j) for r in got.collect()}
    assert (0, 0) in pixels and (50, 20) in pixels and (20, 20) not in pixels
    assert tiles.outline_pixels(patches.limit(0), slides).count() == 0
