"""Registered queries of the tiling, data-set, region and graph operators, with their SQL oracles.

Every query runs over its whole tables. Doubles are rounded on both sides, and integers have the same width.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, coords, paths
from ..operators import clustering, datasets, graphs, masks, neighbours, predicates, regions, semantic, spanning, tiles, trees
from ..sources.documents import tree_document
from ..sources.patches import predicted, with_label, with_predictions
from ..sources.slides import best_level
from .bindings import event_cells, event_patches, part_slides, quality, table, turn_tree
from .patchify import HierarchicalPatchifier

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Tiling.

_SLIDES = "SELECT 'part-' || p_partkey AS slide, p_size * 7 AS w, p_size * 5 AS h FROM part"


@query(f"""
WITH s AS ({_SLIDES}),
n AS (SELECT slide, CAST(trunc((w - 16) / 12.0) AS BIGINT) + 1 AS nx, CAST(trunc((h - 16) / 12.0) AS BIGINT) + 1 AS ny FROM s),
r AS (SELECT slide, nx, unnest(range(ny)) AS r FROM n),
g AS (SELECT slide, nx, r, unnest(range(nx)) AS c FROM r)
SELECT slide, '#' || (r * nx + c + 1) AS id, slide || '#' || (r * nx + c + 1) AS global_id, CAST(c * 12 AS INTEGER) AS x, CAST(r * 12 AS INTEGER) AS y,
  CAST(0 AS INTEGER) AS level, CAST(16 AS INTEGER) AS dx, CAST(16 AS INTEGER) AS dy
FROM g""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping patches of all slides: the flagship; no shuffle, no Python."""
    return tiles.root_patches(part_slides(spark, sf_dir), 0, 16, -4).select("slide", "id", "global_id", "x", "y", "level", "dx", "dy")


@query(f"""
WITH s AS ({_SLIDES}),
n AS (SELECT slide, CAST(trunc((w - 32) / 32.0) AS BIGINT) + 1 AS nx, CAST(trunc((h - 32) / 32.0) AS BIGINT) + 1 AS ny FROM s),
r AS (SELECT slide, nx, unnest(range(ny)) AS r FROM n),
t AS (SELECT slide, '#' || (r * nx + c + 1) AS id, c * 64 AS x, r * 64 AS y FROM (SELECT slide, nx, r, unnest(range(nx)) AS c FROM r)),
k AS (SELECT slide, id, x, y, unnest(range(4)) AS k FROM t)
SELECT slide, id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(1 AS INTEGER) AS level, CAST(64 AS INTEGER) AS dx, CAST(NULL AS VARCHAR) AS parent FROM t
UNION ALL
SELECT slide, id || '#' || (k + 1), CAST(x + (k % 2) * 32 AS INTEGER), CAST(y + (k // 2) * 32 AS INTEGER), CAST(0 AS INTEGER), CAST(32 AS INTEGER), id FROM k""")
def tile_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of two levels; children lie in their parents."""
    return tiles.hierarchy(part_slides(spark, sf_dir, 2), 1, 0, 32).select("slide", "id", "x", "y", "level", "dx", "parent")


_FILES = "SELECT unnest(['" + "', '".join(f"{t}.parquet" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()) + "']) AS slide"


@query(f"""
WITH s AS ({_FILES}), t AS (SELECT slide, unnest(range(2)) AS c FROM s), k AS (SELECT slide, c, unnest(range(4)) AS k FROM t)
SELECT slide, '#' || (c + 1) AS id, slide || '#' || (c + 1) AS global_id, CAST(c * 2048 AS INTEGER) AS x, CAST(0 AS INTEGER) AS y, CAST(1 AS INTEGER) AS level, CAST(2048 AS INTEGER) AS dx, CAST(NULL AS VARCHAR) AS parent FROM t
UNION ALL
SELECT slide, '#' || (c + 1) || '#' || (k + 1), slide || '#' || (c + 1) || '#' || (k + 1), CAST(c * 2048 + (k % 2) * 1024 AS INTEGER), CAST((k // 2) * 1024 AS INTEGER), CAST(0 AS INTEGER), CAST(1024 AS INTEGER), '#' || (c + 1) FROM k""")
def tile_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's files found, opened as procedural slides of 4096 by 3072 pixels in the workers, and tiled on two levels."""
    found = HierarchicalPatchifier(1, 0, 1024).patchify_folder(spark, sf_dir, extensions=(".parquet",), recurse=False)
    return found.select("slide", "id", "global_id", "x", "y", "level", "dx", "parent")


_CELLS = "SELECT DISTINCT event_type AS slide, event_id % 40 AS i, user_id % 15 AS j FROM events WHERE value > {least}"


@query(f"""
WITH m AS ({_CELLS.format(least=60)}),
g AS (SELECT slide, r, unnest(range(9)) AS c FROM (SELECT slide, unnest(range(31)) AS r FROM (SELECT DISTINCT event_type AS slide FROM events))),
k AS (SELECT g.slide, r, c FROM g JOIN m ON m.slide = g.slide AND m.i = CAST(floor((r + 0.5) * 40 / 31) AS BIGINT) AND m.j = CAST(floor((c + 0.5) * 15 / 9) AS BIGINT))
SELECT slide, '#' || row_number() OVER (PARTITION BY slide ORDER BY r, c) AS id, CAST(c * 32 AS INTEGER) AS x, CAST(r * 32 AS INTEGER) AS y FROM k""")
def tile_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches where a coarser mask is true."""
    slides = table(spark, sf_dir, "events").select(F.col("event_type").alias("slide")).distinct()
    slides = slides.select("slide", F.lit(0).alias("level"), F.lit(300).cast("long").alias("width"), F.lit(1000).cast("long").alias("height"), F.lit(1.0).alias("downsample"))
    mask = event_cells(spark, sf_dir, 60).withColumn("mask_height", F.lit(40)).withColumn("mask_width", F.lit(15))
    return tiles.root_patches(slides, 0, 32, 0, 0, mask).select("slide", "id", "x", "y")


@query("""
SELECT user_id, CAST(count(CASE WHEN value > 10 THEN 1 END) AS BIGINT) AS above, CAST(count(value) AS BIGINT) AS pixels FROM events
GROUP BY user_id HAVING count(CASE WHEN value > 10 THEN 1 END) > 0.65 * count(value)""")
def tile_filter_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of which most pixels carry a signal: users as patches, values as pixels."""
    return predicates.significant_groups(table(spark, sf_dir, "events"), ["user_id"], "value", 0.65, 10)


@query(f"""
WITH s AS ({_SLIDES}),
i AS (SELECT slide, w, unnest(range(0, CAST(trunc((h - 12) / 20.0) AS BIGINT) * 20 + 1, 20)) AS i FROM s WHERE h >= 0)
SELECT slide, i, unnest(range(0, CAST(trunc((w - 12) / 20.0) AS BIGINT) * 20 + 1, 20)) AS j FROM i""")
def tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows for dense segmentation, one more on each axis than the regular grid has."""
    slides = part_slides(spark, sf_dir).select("slide", "height", "width")
    return tiles.window_grid(slides, "height", "width", 32, 20).select("slide", "i", "j")


@query(f"""
WITH s AS ({_SLIDES}),
k AS (SELECT slide, w - 30 + 1 AS nx, h - 30 + 1 AS ny, unnest(range(1, 4)) AS k FROM s WHERE w >= 30 AND h >= 30),
d AS (SELECT slide, nx, ny, k, CAST(('0x' || substring(md5('7:' || slide || ':' || k), 1, 12)) AS BIGINT) AS d FROM k)
SELECT slide, CAST(k AS INTEGER) AS k, CAST((d // nx) % ny AS BIGINT) AS i, CAST(d % nx AS BIGINT) AS j FROM d""")
def tile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three random patch positions of every slide."""
    return tiles.sample_positions(part_slides(spark, sf_dir), ("slide",), "width", "height", 30, 3, 7).select("slide", "k", "i", "j")


@query("""
WITH v AS (SELECT p_partkey, p_size, CAST(trunc(p_retailprice) AS BIGINT) AS price FROM part)
SELECT p_partkey, p_size + price AS plus, p_size - price AS minus, p_size * price AS times, CAST(trunc(-price / CAST(p_size AS DOUBLE)) AS BIGINT) AS over, p_size * 2 AS twice FROM v""")
def coord_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate arithmetic: operands are made whole first, division truncates toward zero."""
    a, b = "p_size", F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", coords.add(a, b).alias("plus"), coords.subtract(a, b).alias("minus"), coords.times(a, b).alias("times"), coords.over(coords.negative(b), a).alias("over"), coords.times(a, 2.5).alias("twice"))


@query("""
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file, CASE WHEN regexp_extract(url, '([^/]*)$', 1) LIKE '%.html' THEN 'html' ELSE lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\\.([^.]*)$', 1)) END AS extension,
  regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder FROM pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File name, extension and folder of paths."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.file_name(url).alias("file"), paths.extension(url).alias("extension"), paths.folder(url).alias("folder"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b FROM part)
SELECT p_partkey, (r > 30 AND r < 230) OR (g > 30 AND g < 230) OR (b > 30 AND b < 230) AS tissue FROM p""")
def tissue_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tissue by colour: any channel between the tolerances."""
    rows = table(spark, sf_dir, "part").select("p_partkey", *[(F.col("p_partkey") * k % 256).alias(c) for c, k in (("r", 1), ("g", 7), ("b", 13))])
    return rows.select("p_partkey", colour.tissue(F.col("r"), F.col("g"), F.col("b"), 30, 230, "rgb").alias("tissue"))


_LIN = "CASE WHEN {c} / 255.0 > 0.04045 THEN power(({c} / CAST(255 AS DOUBLE) + 0.055) / 1.055, CAST(2.4 AS DOUBLE)) ELSE {c} / CAST(255 AS DOUBLE) / 12.92 END"


@query(f"""
WITH p AS (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b FROM part),
l AS (SELECT p_partkey, {_LIN.format(c="r")} AS r, {_LIN.format(c="g")} AS g, {_LIN.format(c="b")} AS b FROM p),
y AS (SELECT p_partkey, CAST(0.212671 AS DOUBLE) * r + CAST(0.715160 AS DOUBLE) * g + CAST(0.072169 AS DOUBLE) * b AS y FROM l)
SELECT p_partkey, round(116 * CASE WHEN y > 0.008856 THEN power(y, 1 / CAST(3 AS DOUBLE)) ELSE 7.787 * y + 16 / CAST(116 AS DOUBLE) END - 16, 4) AS lightness FROM y""")
def lab_lightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightness of colours, in the JVM."""
    rows = table(spark, sf_dir, "part").select("p_partkey", *[(F.col("p_partkey") * k % 256).alias(c) for c, k in (("r", 1), ("g", 7), ("b", 13))])
    return rows.select("p_partkey", F.round(colour.lab(F.col("r"), F.col("g"), F.col("b"))[0], 4).alias("lightness"))


@query("""
WITH l AS (SELECT p_partkey, p_size, unnest(range(4)) AS level FROM part)
SELECT 'part-' || p_partkey AS slide, CAST(max(level) AS INTEGER) AS level FROM l WHERE power(2, level) <= 1 + p_size / CAST(5 AS DOUBLE) GROUP BY p_partkey""")
def slide_best_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last level whose downsample is not above a slide's own limit."""
    limit = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("slide"), (1 + F.col("p_size") / 5).alias("limit"))
    levels = part_slides(spark, sf_dir, 4).join(limit, "slide").withColumn("downsample", F.col("downsample") / F.col("limit"))
    return best_level(levels, 1.0).select("slide", F.col("level").cast("int").alias("level"))


# Masks.


@query("""
WITH b AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT event_type, v, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY v) AS DOUBLE) AS w, CAST(sum(n * v) OVER (PARTITION BY event_type ORDER BY v) AS DOUBLE) AS s,
  CAST(sum(n) OVER (PARTITION BY event_type) AS DOUBLE) AS tw, CAST(sum(n * v) OVER (PARTITION BY event_type) AS DOUBLE) AS ts FROM b),
q AS (SELECT event_type, v, CASE WHEN tw > w THEN (ts * w - s * tw) * (ts * w - s * tw) / (w * (tw - w)) ELSE -1.0 END AS q FROM c),
o AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY q DESC, v) AS k FROM q)
SELECT event_type, v AS threshold FROM o WHERE k = 1""")
def mask_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otsu thresholds of whole-number values."""
    values = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("v"))
    return masks.otsu(masks.histogram(values, ["event_type"], "v"), ["event_type"])


_TRIES = ", ".join(f"({k}, CAST('{f!r}' AS DOUBLE))" for k, f in enumerate(masks._factors(1.0, 1.0)))


@query(f"""
WITH RECURSIVE c AS (SELECT slide, i, j, i * 100 + j AS p FROM ({_CELLS.format(least=150)})),
e AS (SELECT a.slide, a.p AS a, b.p AS b FROM c a JOIN c b ON a.slide = b.slide AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
reach AS (SELECT slide, p, p AS r FROM c UNION SELECT reach.slide, e.b, reach.r FROM reach JOIN e ON e.slide = reach.slide AND e.a = reach.p),
l AS (SELECT slide, p, min(r) AS root FROM reach GROUP BY slide, p),
z AS (SELECT slide, root, count(*) AS size FROM l GROUP BY slide, root),
a AS (SELECT slide, sum(size) AS area FROM z GROUP BY slide),
t AS (SELECT slide, area, k, CAST(trunc(f * area * 10 / 100) AS BIGINT) AS least FROM a, (VALUES {_TRIES}) v(k, f)),
d AS (SELECT t.slide, t.k, t.area, t.least, sum(CASE WHEN z.size >= t.least THEN z.size ELSE 0 END) AS kept FROM t JOIN z ON z.slide = t.slide GROUP BY 1, 2, 3, 4),
o AS (SELECT slide, least, row_number() OVER (PARTITION BY slide ORDER BY k) AS n FROM d WHERE 100 - kept / CAST(area AS DOUBLE) * 100 < 10 OR least < 1)
SELECT c.slide, c.i, c.j FROM c JOIN l ON l.slide = c.slide AND l.p = c.p JOIN z ON z.slide = l.slide AND z.root = l.root JOIN o ON o.slide = c.slide AND o.n = 1 WHERE z.size >= o.least""")
def mask_small_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask cells without small components; the least size falls while too much would go."""
    return masks.remove_small_objects(event_cells(spark, sf_dir, 150), ["slide"])


# The patch relation.


@query("SELECT l_orderkey, l_partkey, CAST(l_linenumber AS INTEGER) AS level, l_returnflag AS label FROM lineitem WHERE l_linenumber = 2")
def rel_level_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one level with a label column; the filter reaches the scan."""
    rows = table(spark, sf_dir, "lineitem").withColumn("level", F.col("l_linenumber").cast("int"))
    return with_label(rows, 2, "l_returnflag").select("l_orderkey", "l_partkey", "level", "label")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.source, coalesce(l.quality, CASE WHEN d.doc_id % 3 = 0 THEN 7 END) AS quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def rel_write_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written over a column by id; other rows keep what they have."""
    old = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, 7).cast("int").alias("quality"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("value"))
    return with_predictions(old, new, "quality", ["doc_id"])


@query("SELECT l_orderkey AS x, l_partkey AS y, CAST(l_suppkey AS INTEGER) AS interval, l_discount AS value, 'l_discount' AS author FROM lineitem WHERE l_linenumber = 1")
def rel_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions of one level, with the column's name as their author."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("x"), F.col("l_partkey").alias("y"), F.col("l_suppkey").cast("int").alias("dx"), F.col("l_linenumber").alias("level"), "l_discount")
    return predicted(rows, 1, "l_discount")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS k FROM orders)
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN o ON o_custkey = c_custkey AND k = 1""")
def rel_slide_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first partner by rank of every row: customers as folders, orders as slides."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderpriority", "o_orderkey")).alias("f"))
    return table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("f.o_orderkey").alias("o_orderkey"))


@query("SELECT event_id, CAST(CASE WHEN value >= 0 AND value < 50 THEN 0 WHEN value >= 50 AND value < 200 THEN 1 END AS INTEGER) AS category FROM events WHERE value >= 0 AND value < 200")
def bin_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open bins; what is in none goes."""
    return predicates.categorized(table(spark, sf_dir, "events"), "value", {0: (0, 50), 1: (50, 200)}).select("event_id", "category")


# Data sets.


@query("SELECT quality AS tag, count(*) AS n FROM labels GROUP BY quality")
def ds_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each tag."""
    return datasets.info(quality(spark, sf_dir))


@query("SELECT quality AS tag, round(count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE), 9) AS ratio FROM labels GROUP BY quality")
def ds_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each tag."""
    return datasets.ratio_info(quality(spark, sf_dir)).select("tag", F.round("ratio", 9).alias("ratio"))


@query("SELECT doc_id AS ord, lang AS tag FROM documents WHERE lang = 'fr'")
def ds_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one tag."""
    return datasets.class_data(table(spark, sf_dir, "documents").select(F.col("lang").alias("tag"), F.col("doc_id").alias("ord")), "fr")


@query("SELECT doc_id AS ord, lang AS tag FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('de', 'es')")
def ds_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without unwanted tags."""
    return datasets.clean(table(spark, sf_dir, "documents").select(F.col("lang").alias("tag"), F.col("doc_id").alias("ord")), "string", ["de", "es"])


@query("SELECT doc_id AS ord, CAST(row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS BIGINT) AS place, quality AS tag FROM labels")
def ds_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded permutation."""
    rows = quality(spark, sf_dir).withColumn("first", F.col("ord"))
    return datasets.shuffle(rows, 3).select(F.col("first").alias("ord"), F.col("ord").alias("place"), "tag")


@query("SELECT event_id AS ord, event_type AS tag FROM events ORDER BY event_id LIMIT 500")
def ds_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by place (the limit is the operator)."""
    return datasets.clip(table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("ord")), 500)


@query("""
WITH r AS (SELECT event_id, user_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch FROM events)
SELECT CAST(batch AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n, min(event_id) AS first, max(event_id) AS last, CAST(sum(user_id) AS BIGINT) AS users FROM r GROUP BY batch HAVING count(*) = 64""")
def ds_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full batches by place."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("ord"), "event_id", "user_id")
    out = datasets.batch(rows, 64, payload=["event_id", "user_id"])
    return out.select("batch", F.size("rows").alias("n"), F.col("rows")[0]["event_id"].alias("first"), F.element_at("rows", -1)["event_id"].alias("last"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["user_id"]).alias("users"))


_BALANCE = """
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels),
m AS (SELECT max(n) AS most FROM r),
c AS (SELECT doc_id, quality, (most - n) // n + CASE WHEN k <= (most - n) % n THEN 1 ELSE 0 END AS more FROM r, m)
SELECT doc_id AS ord, quality AS tag, unnest(range(more + 1)) AS copy FROM c"""


@query(_BALANCE)
def ds_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag padded to the largest."""
    return datasets.balance(quality(spark, sf_dir))


@query("""
WITH f AS (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('5:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM f),
m AS (SELECT max(n) AS most FROM r),
c AS (SELECT doc_id, quality, unnest(range((most - n) // n + CASE WHEN k <= (most - n) % n THEN 1 ELSE 0 END + 1)) AS copy FROM r, m)
SELECT doc_id, quality AS tag, CAST(row_number() OVER (ORDER BY md5('5:' || doc_id || ':' || copy), doc_id, copy) AS BIGINT) AS ord FROM c""")
def ds_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, balanced and shuffled."""
    return datasets.fair(quality(spark, sf_dir).withColumn("doc_id", F.col("ord")), "int", seed=5).select("doc_id", "tag", "ord")


@query("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels),
b AS (SELECT *, CAST(trunc(CAST('0.7' AS DOUBLE) * n) AS BIGINT) AS t, CAST(trunc(CAST('0.2' AS DOUBLE) * n) AS BIGINT) AS v, CAST(trunc(CAST('0.1' AS DOUBLE) * n) AS BIGINT) AS s FROM r)
SELECT doc_id AS ord, quality AS tag, CASE WHEN k < t THEN 'train' WHEN k < t + v THEN 'valid' ELSE 'test' END AS split FROM b WHERE k < t + v + s""")
def ds_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified slices; the remainder goes."""
    return datasets.split(quality(spark, sf_dir), {"train": 0.7, "valid": 0.2, "test": 0.1})


@query("""
WITH g AS (SELECT DISTINCT c_nationkey FROM customer),
r AS (SELECT c_nationkey, row_number() OVER (ORDER BY md5('0:' || c_nationkey), c_nationkey) AS k, count(*) OVER () AS n FROM g)
SELECT c_custkey, c_nationkey, CASE WHEN k <= CAST(trunc(CAST('0.3' AS DOUBLE) * n) AS BIGINT) THEN 'validation' ELSE 'training' END AS split FROM customer JOIN r USING (c_nationkey)""")
def slide_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by whole groups: customers by nation."""
    return datasets.group_split(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 0.3, 0)


# Trees.

_UP = """
WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn, (turn - 1) // 2 AS parent FROM conversations WHERE turn > 0),
v AS (SELECT conv_id, turn FROM t UNION SELECT conv_id, parent FROM t),
up AS (SELECT conv_id, turn AS node, turn AS anc, CAST(0 AS BIGINT) AS depth FROM v UNION ALL SELECT up.conv_id, up.node, t.parent, up.depth + 1 FROM up JOIN t ON t.conv_id = up.conv_id AND t.turn = up.anc)"""
_LCA = (
    _UP
    + """,
c AS (SELECT a.conv_id, a.node AS a, b.node AS b, a.anc AS lca, a.depth AS d_a, b.depth AS d_b, row_number() OVER (PARTITION BY a.conv_id, a.node, b.node ORDER BY a.depth + b.depth) AS k
  FROM up a JOIN up b ON a.conv_id = b.conv_id AND a.anc = b.anc AND a.node < b.node
  JOIN t ta ON ta.conv_id = a.conv_id AND ta.turn = a.node JOIN t tb ON tb.conv_id = b.conv_id AND tb.turn = b.node),
m AS (SELECT conv_id, a, b, lca, d_a, d_b FROM c WHERE k = 1)"""
)


def _pairs(tree: DataFrame) -> DataFrame:
    """All pairs of nodes of a conversation that have a parent."""
    return tree.select("conv_id", F.col("node").alias("a")).join(tree.select("conv_id", F.col("node").alias("b")), "conv_id").where("a < b")


@query(_UP + " SELECT conv_id, node, string_agg(CAST(anc AS VARCHAR), '/' ORDER BY depth) AS path FROM up GROUP BY conv_id, node")
def tree_root_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path from every node to its root."""
    return trees.root_path(turn_tree(spark, sf_dir), ["conv_id"]).select("conv_id", "node", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(_UP + " SELECT up.conv_id, up.anc AS node, up.node AS leaf FROM up WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id = up.conv_id AND t.parent = up.node)")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves below every node."""
    return trees.leaves(turn_tree(spark, sf_dir), ["conv_id"])


@query(_LCA + " SELECT conv_id, a, b, lca FROM m")
def tree_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest common ancestors of all pairs of a conversation."""
    tree = turn_tree(spark, sf_dir)
    return trees.common_ancestors(tree, _pairs(tree), ["conv_id"]).select("conv_id", "a", "b", "lca")


@query(_LCA + " SELECT conv_id, a, b, d_a + d_b + 1 AS edge_dist, d_a + d_b AS hops FROM m")
def tree_edge_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on the path between all pairs."""
    tree = turn_tree(spark, sf_dir)
    return trees.edge_distance(tree, _pairs(tree), ["conv_id"])


@query(
    _LCA
    + """,
p AS (SELECT m.conv_id, a, b, up.anc AS n FROM m JOIN up ON up.conv_id = m.conv_id AND up.node = m.a AND up.depth <= m.d_a
  UNION SELECT m.conv_id, a, b, up.anc FROM m JOIN up ON up.conv_id = m.conv_id AND up.node = m.b AND up.depth <= m.d_b),
w AS (SELECT p.conv_id, p.a, p.b, sum(length(c.text)) AS s FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.n WHERE p.n <> p.a AND p.n <> p.b GROUP BY 1, 2, 3)
SELECT m.conv_id, m.a, m.b, CAST(coalesce(w.s, 0) AS DOUBLE) AS weighted_dist FROM m LEFT JOIN w ON w.conv_id = m.conv_id AND w.a = m.a AND w.b = m.b"""
)
def tree_weighted_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights on the path between all pairs, its ends left out."""
    tree = turn_tree(spark, sf_dir)
    weights = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("node"), F.length("text").cast("double").alias("weight"))
    return trees.weighted_distance(tree, _pairs(tree), weights, ["conv_id"])


@query(
    _UP
    + """,
ok AS (SELECT conv_id, turn AS node FROM conversations WHERE length(text) >= 60),
x AS (SELECT t.conv_id, t.turn, t.parent FROM t JOIN ok a ON a.conv_id = t.conv_id AND a.node = t.turn JOIN ok b ON b.conv_id = t.conv_id AND b.node = t.parent),
way AS (SELECT conv_id, node, node AS anc FROM ok UNION ALL SELECT way.conv_id, way.node, x.parent FROM way JOIN x ON x.conv_id = way.conv_id AND x.turn = way.anc)
SELECT w.conv_id, w.anc AS node, w.node AS leaf FROM way w WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.conv_id = w.conv_id AND x.parent = w.node)"""
)
def tree_flagged_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that are reached through flagged nodes only."""
    flags = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("node"), (F.length("text") >= 60).alias("flag"))
    return trees.leaves(turn_tree(spark, sf_dir), ["conv_id"], flags)


@query(
    _UP
    + """,
g AS (SELECT up.conv_id, up.node, min(CASE WHEN r.parent IS NULL OR length(c.text) >= 60 THEN 1 ELSE 0 END) AS ok FROM up
  LEFT JOIN t r ON r.conv_id = up.conv_id AND r.turn = up.anc LEFT JOIN conversations c ON c.conv_id = up.conv_id AND c.turn = up.anc GROUP BY 1, 2)
SELECT conv_id, node FROM g WHERE ok = 1"""
)
def tree_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are reached from the root through large values only."""
    values = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("node"), F.length("text").alias("value"))
    return trees.cut(turn_tree(spark, sf_dir), values, 60, ["conv_id"])


@query("SELECT 'N' || n_nationkey AS node, 'R' || n_regionkey AS parent FROM nation UNION SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer")
def tree_build_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree from parents, checked against its children."""
    named = lambda p, c: F.concat(F.lit(p), F.col(c))
    nation = table(spark, sf_dir, "nation").select(named("N", "n_nationkey").alias("node"), named("R", "n_regionkey").alias("parent"))
    own = nation.unionByName(table(spark, sf_dir, "customer").select(named("C", "c_custkey").alias("node"), named("N", "c_nationkey").alias("parent")))
    return trees.complete(own, nation.select(F.col("parent").alias("node"), F.col("node").alias("child")))


@query("""
WITH t AS (SELECT DISTINCT conv_id, turn, (turn - 1) // 2 AS parent FROM conversations WHERE turn > 0),
v AS (SELECT conv_id, turn AS node FROM t UNION SELECT conv_id, parent FROM t),
n AS (SELECT conv_id, string_agg('"' || node || '"', ',' ORDER BY CAST(node AS VARCHAR)) AS s FROM v GROUP BY conv_id),
p AS (SELECT conv_id, string_agg('"' || turn || '":"' || parent || '"', ',' ORDER BY CAST(turn AS VARCHAR)) AS s FROM t GROUP BY conv_id),
b AS (SELECT conv_id, parent, string_agg('"' || turn || '"', ',' ORDER BY CAST(turn AS VARCHAR)) AS s FROM t GROUP BY conv_id, parent),
c AS (SELECT conv_id, string_agg('"' || parent || '":[' || s || ']', ',' ORDER BY CAST(parent AS VARCHAR)) AS s FROM b GROUP BY conv_id),
l AS (SELECT conv_id, string_agg('"' || turn || '":' || length(text) || '.0', ',' ORDER BY CAST(turn AS VARCHAR)) AS s FROM conversations GROUP BY conv_id)
SELECT n.conv_id, '{"nodes":[' || n.s || '],"parents":{' || p.s || '},"children":{' || c.s || '},"nodeprops":{"length":{' || l.s || '}}}' AS document
FROM n JOIN p ON p.conv_id = n.conv_id JOIN c ON c.conv_id = n.conv_id JOIN l ON l.conv_id = n.conv_id""")
def tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a tree."""
    props = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("node"), F.lit("length").alias("name"), F.length("text").cast("double").alias("value"))
    return tree_document(turn_tree(spark, sf_dir), props, ["conv_id"])


# Graphs.

_PAIRS = "SELECT DISTINCT 'P' || l_partkey AS a, 'S' || l_suppkey AS b FROM lineitem"


def _part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"))


@query(f"SELECT a AS src, b AS dst FROM ({_PAIRS})")
def graph_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges once each."""
    return graphs.canonical(_part_supplier(spark, sf_dir))


@query(f"SELECT i, count(*) AS degree FROM (SELECT a AS i, b AS j FROM ({_PAIRS}) UNION SELECT b, a FROM ({_PAIRS})) GROUP BY i")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees from the symmetric adjacency."""
    return graphs.adjacency(_part_supplier(spark, sf_dir), symmetric=True).groupBy("i").agg(F.count("*").alias("degree"))


@query("SELECT i, j, max(w) AS weight FROM (SELECT 'S' || l_suppkey AS i, 'P' || l_partkey AS j, l_quantity AS w FROM lineitem UNION ALL SELECT 'P' || l_partkey, 'S' || l_suppkey, l_quantity FROM lineitem) GROUP BY i, j")
def graph_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric weights: the larger of both directions."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.col("l_quantity").alias("w"))
    return graphs.weighted_adjacency(rows, "w")


# Regions.

_BINS = {0: (120.0, 180.0), 1: (180.0, 1000.0)}
_LATTICE = """
WITH RECURSIVE p AS (SELECT event_type AS slide, user_id % 15 * 10 AS x, event_id % 40 * 10 AS y, CAST(CASE WHEN value < 180 THEN 0 ELSE 1 END AS INTEGER) AS layer FROM events WHERE value >= 120 AND value < 1000),
n AS (SELECT DISTINCT slide, layer, x + dx AS x, y + dy AS y FROM p, (VALUES (0, 0), (0, 10), (10, 0), (10, 10)) d(dx, dy)),
e AS (SELECT a.slide, a.layer, a.x, a.y, b.x AS x2, b.y AS y2 FROM n a JOIN n b ON a.slide = b.slide AND a.layer = b.layer AND abs(a.x - b.x) <= 10 AND abs(a.y - b.y) <= 10 AND (a.x <> b.x OR a.y <> b.y))"""
_REGIONS = (
    _LATTICE
    + """,
reach AS (SELECT slide, layer, x, y, y * 100000 + x AS r FROM n UNION SELECT reach.slide, reach.layer, e.x2, e.y2, reach.r FROM reach JOIN e ON e.slide = reach.slide AND e.layer = reach.layer AND e.x = reach.x AND e.y = reach.y),
g AS (SELECT slide, layer, x, y, min(r) AS r FROM reach GROUP BY 1, 2, 3, 4)"""
)


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.categorized(event_patches(spark, sf_dir), "value", _BINS)


@query(_LATTICE + " SELECT slide, layer, x, y FROM n")
def region_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct corners of each class."""
    return regions.corners(_binned(spark, sf_dir).withColumn("interval", F.lit(10)), ["slide"])


@query(_LATTICE + " SELECT slide, layer, x, y, x2, y2 FROM e")
def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice neighbours."""
    return regions.lattice_edges(region_lattice(spark, sf_dir), ["slide"], 10)


@query(_REGIONS + " SELECT slide, layer, x, y, CAST(r // 100000 AS BIGINT) AS seg_y, CAST(r % 100000 AS BIGINT) AS seg_x FROM g")
def region_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions: connected corners."""
    return regions.region_tables(_binned(spark, sf_dir), ["slide"], 10)[0]


@query(
    _REGIONS
    + """, d AS (SELECT slide, layer, x, y, count(*) AS d FROM e GROUP BY 1, 2, 3, 4)
SELECT g.slide, g.layer, g.x, g.y, CAST(r // 100000 AS BIGINT) AS seg_y, CAST(r % 100000 AS BIGINT) AS seg_x FROM g LEFT JOIN d ON d.slide = g.slide AND d.layer = g.layer AND d.x = g.x AND d.y = g.y WHERE coalesce(d.d, 0) < 8"""
)
def region_contour_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners with fewer than 8 neighbours."""
    return regions.region_tables(_binned(spark, sf_dir), ["slide"], 10)[2]


@query()
def region_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traced outlines as one annotation document a slide."""
    contours = regions.region_tables(_binned(spark, sf_dir), ["slide"], 10)[2]
    slides = table(spark, sf_dir, "events").select(F.col("event_type").alias("slide")).distinct().select("slide", F.lit(0).alias("level"), F.lit(160).alias("width"), F.lit(410).alias("height"))
    return regions.annotations(regions.polygons(contours, ["slide"], 10), slides, {0: ("low", "#00ff00"), 1: ("high", "#ff0000")}, "value")


# Neighbours, spanning trees, clustering.

_DIST = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS k FROM d)"""


@query(_DIST + " SELECT src, dst, round(d, 6) AS dist2, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 5")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector, exactly, block by block."""
    return neighbours.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5).select("src", "dst", F.round("dist2", 6).alias("dist2"), F.col("rank").cast("int").alias("rank"))


@query(_DIST + ", n AS (SELECT src, dst, round(sqrt(d), 6) AS dist FROM k WHERE k <= 5 AND sqrt(d) <= 500 AND d > 0) SELECT src, dst, dist FROM n UNION SELECT dst, src, dist FROM n")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetric neighbour graph within a distance."""
    return neighbours.kneighbours_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5, 500.0).select("src", "dst", F.round("dist", 6).alias("dist")).distinct()


@query("""
WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey * 100 AS DOUBLE) AS y FROM supplier),
d AS (SELECT a.id AS src, b.id AS dst, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS dist FROM p a JOIN p b ON a.id <> b.id),
k AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS k FROM d WHERE dist <= 700 AND dist > 0),
n AS (SELECT src, dst, round(dist, 6) AS dist FROM k WHERE k <= 3)
SELECT src, dst, dist FROM n UNION SELECT dst, src, dist FROM n""")
def plane_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbour graph of points in the plane, by cells as wide as the distance limit."""
    points = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100).alias("y"))
    near = neighbours.near_points(points, "s_suppkey", "x", "y", 3, 700.0)
    return near.select("src", "dst", F.round("dist", 6).alias("dist")).distinct()


def _fps_sql(n: int) -> str:
    """One subquery a step: the point farthest from those before, ties to the least id."""
    square = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = ["WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", "s0 AS (SELECT vec_id, e FROM v ORDER BY vec_id LIMIT 1)", f"d0 AS (SELECT v.vec_id, v.e, {square} AS d FROM v, s0 c)"]
    for k in range(1, n):
        out.append(f"s{k} AS (SELECT vec_id, e FROM d{k - 1} ORDER BY d DESC, vec_id LIMIT 1)")
        out.append(f"d{k} AS (SELECT v.vec_id, v.e, least(v.d, {square}) AS d FROM d{k - 1} v, s{k} c)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT vec_id AS id, CAST({k} AS INTEGER) AS step FROM s{k}" for k in range(n))


@query(_fps_sql(5))
def farthest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five points, each farthest from those before."""
    return neighbours.farthest_points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)


def _neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.kneighbours_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)
    return near.where("src < dst").select("src", "dst", F.round("dist", 9).alias("weight"))


#: Of the neighbour graph, an edge is in the forest if no path of edges before it, by weight and then ends, joins its ends.
_FOREST = (
    _DIST.replace("WITH", "WITH RECURSIVE", 1)
    + """,
n AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(round(sqrt(d), 9)) AS weight FROM k WHERE k <= 5 AND sqrt(d) <= 500 AND d > 0 GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS r FROM n),
s AS (SELECT src AS a, dst AS b, r FROM e UNION ALL SELECT dst, src, r FROM e),
w AS (SELECT r AS edge, src AS node FROM e UNION SELECT w.edge, s.b FROM w JOIN s ON s.a = w.node AND s.r < w.edge),
f AS (SELECT src, dst, weight, row_number() OVER (ORDER BY r) - 1 AS r FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.edge = e.r AND w.node = e.dst))"""
)


@query(_FOREST + " SELECT src, dst, weight FROM f")
def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum spanning forest of the neighbour graph."""
    return spanning.spanning_forest(_neighbour_edges(spark, sf_dir))


@query(
    _FOREST
    + """,
g AS (SELECT src AS a, dst AS b, r FROM f UNION ALL SELECT dst, src, r FROM f),
h AS (SELECT r AS k, src AS leaf, src AS node, CAST(-1 AS BIGINT) AS via FROM f UNION SELECT r, dst, dst, -1 FROM f UNION SELECT h.k, h.leaf, g.b, g.r FROM h JOIN g ON g.a = h.node AND g.r < h.k),
base AS (SELECT greatest(2 * count(*), (SELECT max(vec_id) FROM v) + 1) AS base FROM f),
p AS (SELECT k, leaf, CASE WHEN max(via) < 0 THEN leaf ELSE max(base) + max(via) END AS part, count(DISTINCT node) AS size FROM h, base GROUP BY k, leaf)
SELECT CAST(base + f.r AS BIGINT) AS node, CAST(a.part AS BIGINT) AS "left", CAST(b.part AS BIGINT) AS "right", f.weight, CAST(a.size + b.size AS DOUBLE) AS size
FROM f JOIN p a ON a.k = f.r AND a.leaf = f.src JOIN p b ON b.k = f.r AND b.leaf = f.dst, base"""
)
def kruskal_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge tree of that forest."""
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.lit(1.0).alias("size"))
    return spanning.merge_tree(mst_edges(spark, sf_dir), sizes)


@query()
def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dendrograms of the neighbour graphs within each label."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("node"), F.col("embedding").alias("vector"))
    of = lambda end: rows.select(F.col("node").alias(end), F.col("label").alias(f"l_{end}"))
    edges = _neighbour_edges(spark, sf_dir).join(of("src"), "src").join(of("dst"), "dst").where("l_src = l_dst").select(F.col("l_src").alias("label"), "src", "dst", "weight")
    return clustering.agglomerate(rows, edges, ["label"])


# Models.

_PROTOTYPES = [[0.1] * 64, [-0.1] * 64, [0.1 if k % 2 else -0.1 for k in range(64)]]


@query(
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT vec_id, "
    + ", ".join(f"list_sum(list_transform(list_zip(e, CAST({p} AS DOUBLE[])), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d{k}" for k, p in enumerate(_PROTOTYPES))
    + " FROM v) SELECT vec_id, CAST(CASE WHEN d0 = least(d0, d1, d2) THEN 0 WHEN d1 = least(d0, d1, d2) THEN 1 ELSE 2 END AS INTEGER) AS label FROM d"
)
def semantic_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest prototype of each window, in the JVM."""
    return table(spark, sf_dir, "embeddings").select("vec_id", semantic.nearest_prototype(F.col("embedding").cast("array<double>"), _PROTOTYPES).alias("label"))


def _summary(x: np.ndarray) -> np.ndarray:
    return np.stack([x.sum(axis=1), x.min(axis=1), x.max(axis=1)], axis=1)


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(list_sum(e), 6) AS total, round(list_min(e), 6) AS least, round(list_max(e), 6) AS most FROM v")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors by a model in Python, batch by batch."""
    out = semantic.extract_features(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", _summary)
    return out.select("vec_id", *[F.round(F.col("features")[k], 6).alias(n) for k, n in enumerate(("total", "least", "most"))])
