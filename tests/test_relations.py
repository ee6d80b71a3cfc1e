"""Files, data sets, regions, documents, streams."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import InvalidSplitError, OutOfBound, PatchesNotFoundError, SlideNotFoundError, TagNotFoundError, UnknownColumnError, UnknownFilterError
from gridloom.operators import datasets, masks, predicates, regions, semantic, tiles
from gridloom.plans.export import export_annotations
from gridloom.plans.project import Project, iter_batches
from gridloom.sources import discovery, documents, patches
from gridloom.streaming import patches as stream


def _dataset(spark, tags):
    return spark.createDataFrame([(t, i) for i, t in enumerate(tags)], "tag string, ord long")


def test_dataset_operators(spark):
    ds = _dataset(spark, ["a"] * 7 + ["b"] * 2 + [None])
    clean = datasets.clean(ds)
    assert clean.count() == 9 and datasets.clean(ds, rm=["b"]).count() == 7 and datasets.clean(ds, "int").count() == 0
    even = datasets.balance(clean)
    assert {r.tag: r.n for r in datasets.info(even).collect()} == {"a": 7, "b": 7}
    assert {(r.ord, r["count"]) for r in even.where("tag = 'b'").groupBy("ord").count().collect()} == {(7, 4), (8, 3)}
    mixed = datasets.shuffle(clean, 1)
    assert sorted(r.ord for r in mixed.collect()) == list(range(1, 10))
    assert datasets.clip(ds, 3).count() == 3
    halves = datasets.split(clean, [0.5, 0.5])
    assert {(r.split, r.tag): r["count"] for r in halves.groupBy("split", "tag").count().collect()} == {("0", "a"): 3, ("1", "a"): 3, ("0", "b"): 1, ("1", "b"): 1}
    assert datasets.clip(halves, 1).count() == 2  # within each split
    assert datasets.batch(clean, 4).count() == 2 and datasets.batch(clean, 4, keep_last=True).count() == 3
    with pytest.raises(InvalidSplitError):
        datasets.split(clean, [0.5, 0.4])
    with pytest.raises(TagNotFoundError):
        datasets.class_data(ds, "z")
    run = datasets.pre(datasets.clean, lambda df: datasets.clip(df, 5))(lambda df: df)
    assert run(ds).count() == 5
    made = datasets.post_balance()(lambda: clean)()
    assert made.count() == 14
    assert [len(b) for b in iter_batches(clean, 4)] == [4, 4, 1]


def test_predicates(spark):
    dark = np.zeros((8, 8, 3), np.uint8)
    assert not predicates.passes(dark, ["has-dapi"]) and not predicates.passes(dark, ["has-tissue-he"])
    assert predicates.passes(dark, [lambda a: True]) and predicates.passes(dark, [])
    with pytest.raises(UnknownFilterError):
        predicates.passes(dark, ["nothing"])
    bins = {0: (0, 50), 1: (50, 200)}
    assert predicates.category_of(50, bins) == 1
    with pytest.raises(OutOfBound):
        predicates.category_of(200, bins)
    values = spark.createDataFrame([(0, [0, 2, 2]), (1, [0, 0, 2])], "id int, v array<int>")
    got = values.select(predicates.has_signal(F.col("v")).alias("a"), predicates.has_significant_signal(F.col("v")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, True), (True, False)]


def test_small_objects_and_polygons(spark):
    cells = [("s", i, j) for i in range(10) for j in range(10)] + [("s", 20, 20), ("s", 30, 1)]
    df = spark.createDataFrame(cells, "slide string, i long, j long")
    assert masks.remove_small_objects(df, ["slide"]).count() == 100
    scattered = spark.createDataFrame([("s", 3 * k, 0) for k in range(20)], "slide string, i long, j long")
    assert masks.remove_small_objects(scattered, ["slide"]).count() == 20  # the least size falls to one
    assert masks.remove_small_objects(scattered, ["slide"], avoid_overmask=False).count() == 0
    square = F.array(*map(F.lit, (0.0, 10.0, 10.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0)))
    row = spark.range(1).select(masks.in_polygon(F.lit(5.0), F.lit(5.0), *square).alias("a"), masks.in_polygon(F.lit(15.0), F.lit(5.0), *square).alias("b")).first()
    assert row.a and not row.b


def test_trace_and_regions(spark):
    ring = {(x, y) for x in range(4) for y in range(4)} - {(1, 1), (2, 1), (1, 2), (2, 2)}
    path = regions.trace(ring, 1)
    assert path[0] == (0, 3) and set(path) == ring and len(path) == len(ring)
    patch = spark.createDataFrame([("s", 0, 0, 0), ("s", 0, 10, 0), ("s", 0, 30, 0), ("s", 0, 70, 0)], "slide string, category int, x long, y long")
    labelled, _, contours = regions.region_tables(patch, ["slide"], 10)
    assert labelled.select("seg_x", "seg_y").distinct().count() == 2  # a gap of one patch joins, a gap of three does not
    shapes = regions.polygons(contours, ["slide"], 10)
    assert shapes.where("complete").count() == 2
    slides = spark.createDataFrame([("s", 0, 100, 100)], "slide string, level int, width int, height int")
    doc = json.loads(regions.annotations(shapes, slides, {0: ("low", "#fff")}, "me").first().document)
    assert doc["slide_id"] == "s" and [s["id"] for s in doc["layers"][0]["shapes"]] == ["0", "1"]
    assert doc["layers"][0]["id"] == "me_low" and doc["layers"][0]["shapes"][0]["points"][0]["status"] == "written"


def test_patch_files(spark, tmp_path):
    project, store = tmp_path / "project", tmp_path / "slides"
    for name in ("one", "two", "lost"):
        (project / name).mkdir(parents=True)
        (project / name / "patches.csv").write_text("id,global_id,x,y,level,dx,dy,size_x,size_y,parent,score\n" + "".join(f"#{k},{name}#{k},{k * 8},0,{k % 2},8,8,8,8,None,{k / 4}\n" for k in range(4)))
    store.mkdir()
    (store / "one.svs").write_text("x")
    (store / "one.mrxs").write_text("x")
    (store / "two.svs").write_text("x")
    (store / ".hidden.svs").write_text("x")
    p = Project(spark, str(project), str(store))
    assert {r.slide_path.rsplit("/", 1)[-1] for r in p.folders().collect()} == {"one.mrxs", "two.svs"}
    assert p.missing().count() == 1
    rows = p.list_patches(1, "score", [("score", "double")])
    assert rows.count() == 4 and {r.label for r in rows.collect()} == {0.25, 0.75} and rows.where("parent is not null").count() == 0
    assert p.random_split(0.5).where("split = 'validation'").count() == 1
    files = discovery.get_files(spark, str(store), ["SVS"])
    assert files.count() == 2
    own = discovery.get_files(spark, str(project))
    folders = discovery.patch_folders(own)
    with pytest.raises(SlideNotFoundError):
        discovery.patch_file(folders, own, str(project / "none"))
    with pytest.raises(PatchesNotFoundError):
        discovery.patch_file(folders, own, str(tmp_path / "project"))
    table = patches.read_patches(spark, f"{project}/one/patches.csv", [("score", "double")])
    new = patches.with_predictions(table, spark.createDataFrame([("#1", 9.0), ("#9", 1.0)], "id string, value double"), "score")
    assert {r.id: r.score for r in new.collect()} == {"#0": 0.0, "#1": 9.0, "#2": 0.5, "#3": 0.75, "#9": 1.0}
    with pytest.raises(UnknownColumnError):
        patches.predicted(table, 0, "none")
    patches.write_patches(table.drop("slide_folder").withColumn("slide", F.lit("one")), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 4


def test_export(spark):
    slides = spark.createDataFrame([("s", 0, 100, 100)], "slide string, level int, width int, height int")
    rows = spark.createDataFrame([("s", "#1", 0, 0, 0, 10, 0.2), ("s", "#2", 10, 0, 0, 10, 0.9), ("s", "#3", 20, 0, 0, 10, 7.0)], "slide string, id string, x int, y int, level int, dx int, risk double")
    doc = json.loads(export_annotations(rows, slides, 0, "risk", {0: (0, 0.5), 1: (0.5, 1)}, {0: ("low", "g"), 1: ("high", "r")}, 10).first().document)
    assert [layer["id"] for layer in doc["layers"]] == ["risk_low", "risk_high"]


def test_documents(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4]]
    (tmp_path / "100_200_0.json").write_text(json.dumps({"nuc": {"1": {"centroid": [2, 2], "contour": square}, "2": {"centroid": [5, 5], "contour": [[x + 3, y + 3] for x, y in square]}, "3": {"centroid": [52, 52], "contour": [[x + 50, y + 50] for x, y in square]}}}))
    nuclei = documents.read_nuclei(spark, str(tmp_path / "100_200_0.json"))
    assert nuclei.count() == 3
    assert {(r.src, r.dst) for r in documents.nuclei_graph(nuclei, 1, 10.0).collect()} == {("1", "2"), ("2", "1")}
    merged = documents.dissolve(documents.read_nuclei_tiles(spark, str(tmp_path / "100_200_0.json")))
    assert sorted((r.x, r.y, r.parts) for r in merged.collect()) == [(103, 203, 2), (152, 252, 1)]
    tree = spark.createDataFrame([(2, 1), (3, 1)], "node long, parent long")
    props = spark.createDataFrame([(2, "size", 4.0)], "node long, name string, value double")
    doc = documents.tree_document(tree, props).first().document
    (tmp_path / "tree.json").write_text(doc)
    back, values = documents.read_trees(spark, str(tmp_path / "tree.json"))
    assert {(r.node, r.parent) for r in back.collect()} == {("2", "1"), ("3", "1")}
    assert [(r.node, r.name, r.value) for r in values.collect()] == [("2", "size", 4.0)]
    note = {"slide_id": "s", "layers": [{"id": "Tumour", "color": "r", "shapes": [{"points": [{"x": 0, "y": 0, "status": "w"}, {"x": 50, "y": 0, "status": "w"}, {"x": 50, "y": 50, "status": "w"}, {"x": 0, "y": 50, "status": "w"}], "id": "0"}]}]}
    (tmp_path / "note.json").write_text(json.dumps(note))
    cells = spark.createDataFrame([("s", i, j, 4, 4) for i in range(4) for j in range(4)], "slide_id string, i int, j int, mask_height int, mask_width int")
    assert documents.annotation_mask(documents.read_annotations(spark, str(tmp_path / "note.json")), "tumour", cells).count() == 4


def test_semantic(spark):
    image = np.arange(4 * 4 * 2)
    images = spark.createDataFrame([("a", 4, 4, 2, [int(v) for v in image])], "image string, height int, width int, channels int, pixels array<int>")
    labels = semantic.coarse(images, 2, lambda x: (x.sum(axis=1) > 100).astype(int))
    want = {(i, j): int(image.reshape(4, 4, 2)[i : i + 2, j : j + 2].sum() > 100) for i in (0, 2) for j in (0, 2)}
    assert {(r.i, r.j): r.label for r in labels.collect()} == want
    assert semantic.painted(labels, 2).count() == 16
    assert semantic.coarse_channels(images, 2, lambda x: x[:, 0].astype(int)).count() == 8
    described = semantic.describe_channels(images, 2, lambda x: x[:, :2], regions=True)
    assert {r.region for r in described.collect()} == {0, 1, 2, 3}


def test_coarse_patches(spark):
    image = np.zeros((5, 4, 3), np.uint8)
    image[:2, 2:] = 9
    rows = spark.createDataFrame([("a", 4, 5, bytearray(image.tobytes()))], "id string, size_x int, size_y int, pixels binary")
    got = np.frombuffer(semantic.coarse_patches(rows, 2, lambda x: (x.sum(axis=1) > 0).astype(int)).first().labels, np.uint8).reshape(5, 4)
    assert (got[:2] == [0, 0, 1, 1]).all() and (got[2:] == 0).all()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("id,global_id,x,y,level,dx,dy,size_x,size_y,parent\n#1,s#1,0,0,0,8,8,8,8,None\n#2,s#2,8,0,1,8,8,8,8,None\n")
    q = stream.level_counts(stream.deduplicated(stream.patch_stream(spark, str(source)))).writeStream.outputMode("complete").format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (source / "b.csv").write_text("id,global_id,x,y,level,dx,dy,size_x,size_y,parent\n#1,s#1,0,0,0,8,8,8,8,None\n#3,s#3,0,8,0,8,8,8,8,None\n")
    q.processAllAvailable()
    q.stop()
    assert {r.level: r.n for r in spark.table("levels").collect()} == {0: 2, 1: 1}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert tiles.pair(3) == (3, 3)
    with pytest.warns(DeprecationWarning):
        assert tiles.pair({"x": 1, "y": 2}) == (1, 2)
