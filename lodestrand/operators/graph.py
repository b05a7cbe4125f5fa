"""Adjacency of places: lookups, neighbours, classes for maps.

``edges(a, b)``: unordered pairs once, a < b. ``regions(region, name, iso, country)``: one row a region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Classes by priority, and their colours on a map.
CLASSES = ("na", "telecoupling", "pericoupling", "intracoupling")
COLOURS = {"intracoupling": "#2e7d32", "pericoupling": "#f9a825", "telecoupling": "#1565c0", "na": "#d9d9d9"}


def edge_set(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs of different, non-null ends."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(src, neighbours): sorted adjacent codes."""
    return both_ways(edges).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def lookup_pairs(pairs: DataFrame, edges: DataFrame, a: str = "code_a", b: str = "code_b", peri: str = "pericoupled", tele: str = "telecoupled") -> DataFrame:
    """Adds ``pair_type`` and ``confidence``: unknown where a code is null or both are the same, else whether they are adjacent."""
    e = edges.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_hit"))
    rows = pairs.join(e, (F.least(a, b) == F.col("_a")) & (F.greatest(a, b) == F.col("_b")), "left")
    unknown = F.col(a).isNull() | F.col(b).isNull()
    same = F.col(a) == F.col(b)
    kind = F.when(unknown | same, "unknown").when(F.col("_hit"), peri).otherwise(tele)
    how = F.when(unknown, "unresolved").when(same, "same_country").otherwise("database")
    return rows.withColumn("pair_type", kind).withColumn("confidence", how).drop("_a", "_b", "_hit")


def is_coupled(pair_type: Column) -> Column:
    """True, false, or null where it isn't known."""
    return F.when(pair_type == "pericoupled", True).when(pair_type.isin("telecoupled", "same_region"), False)


def lookup_regions(pairs: DataFrame, edges: DataFrame, regions: DataFrame, a: str = "code_a", b: str = "code_b") -> DataFrame:
    """Region pairs: unknown codes become null; ``pair_type`` also same_region; ``cross_country`` if both are known."""
    side = lambda x: regions.select(F.col("region").alias(x), F.col("iso").alias(f"_iso_{x}"))
    rows = pairs.withColumn(a, F.upper(F.trim(a))).withColumn(b, F.upper(F.trim(b))).join(side(a), a, "left").join(side(b), b, "left")
    rows = rows.withColumn(a, F.when(F.col(f"_iso_{a}").isNotNull(), F.col(a))).withColumn(b, F.when(F.col(f"_iso_{b}").isNotNull(), F.col(b)))
    rows = lookup_pairs(rows, edges, a, b)
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    cross = F.coalesce(F.col(f"_iso_{a}") != F.col(f"_iso_{b}"), F.lit(False))
    kind = F.when(same, "same_region").otherwise(F.col("pair_type"))
    how = F.when(same, "database").otherwise(F.col("confidence"))
    return rows.withColumn("pair_type", kind).withColumn("confidence", how).withColumn("cross_country", cross).drop(f"_iso_{a}", f"_iso_{b}")


def border_neighbours(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(src, domestic, cross_border): sorted neighbours in the same and in other countries."""
    iso = regions.select("region", "iso")
    rows = both_ways(edges).join(iso.select(F.col("region").alias("src"), F.col("iso").alias("i")), "src").join(iso.select(F.col("region").alias("dst"), F.col("iso").alias("j")), "dst")
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("dst"))))
    return rows.groupBy("src").agg(pick(F.col("i") == F.col("j")).alias("domestic"), pick(F.col("i") != F.col("j")).alias("cross_border"))


def region_table(edge_rows: DataFrame, order: str | None = None) -> DataFrame:
    """Regions from both sides of an edge list (columns ending in _a and _b); the first row of a region wins."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    rows = edge_rows.withColumn("_at", at)
    side = lambda s, k: rows.select("_at", F.lit(k).alias("_k"), *[F.trim(F.col(f"{c}_{s}")).alias(c) for c in ("region", "name", "iso", "country")])
    both = side("a", 0).unionByName(side("b", 1)).where("region <> ''")
    first = F.row_number().over(Window.partitionBy("region").orderBy("_at", "_k"))
    return both.withColumn("_r", first).where("_r = 1").drop("_r", "_at", "_k")


def _flag(rows: DataFrame, on: str, codes: DataFrame | None, name: str) -> DataFrame:
    if codes is None:
        return rows.withColumn(name, F.lit(None).cast("boolean"))
    marks = codes.select(F.col(codes.columns[0]).alias(on)).distinct().withColumn(name, F.lit(True))
    return rows.join(marks, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def classify_countries(shapes: DataFrame, focal: str, edges: DataFrame, known: DataFrame, mentioned: DataFrame | None = None) -> DataFrame:
    """(code, class): the focal one, its neighbours, then those mentioned, or all known ones where ``mentioned`` is None."""
    near = both_ways(edges).where(F.col("src") == focal).select("dst")
    rows = _flag(_flag(_flag(shapes.select("code").distinct(), "code", near, "_near"), "code", known, "_known"), "code", mentioned, "_said")
    tele = F.col("_known") if mentioned is None else F.col("_said")
    kind = F.when(F.col("code") == focal, "intracoupling").when(F.col("_near"), "pericoupling").when(tele, "telecoupling").otherwise("na")
    return rows.select("code", kind.alias("class"))


def classify_mentioned(codes: DataFrame, focal: str, edges: DataFrame) -> DataFrame:
    """(code, class) for mentioned countries only: focal, adjacent to it, or neither."""
    near = both_ways(edges).where(F.col("src") == focal).select("dst")
    rows = _flag(codes.select("code").distinct(), "code", near, "_near")
    return rows.select("code", F.when(F.col("code") == focal, "intracoupling").when(F.col("_near"), "pericoupling").otherwise("telecoupling").alias("class"))


def classify_regions(shapes: DataFrame, focal: str, focal_iso: str, edges: DataFrame, known_iso: DataFrame, mentioned_iso: DataFrame | None = None, mentioned: DataFrame | None = None) -> DataFrame:
    """(code, iso, class) of every region (code, iso).

    Strict where ``mentioned`` is a table, even an empty one: of mentioned regions neighbours are
    pericoupling, others telecoupling; an unmentioned region is telecoupling if its country is
    mentioned and not the focal one. Else neighbours count without mention, and others by their
    country: mentioned, or known where ``mentioned_iso`` is None.
    """
    near = both_ways(edges).where(F.col("src") == focal).select("dst")
    rows = _flag(_flag(shapes.select("code", "iso"), "code", near, "_near"), "code", mentioned, "_said")
    rows = _flag(_flag(rows, "iso", known_iso, "_known"), "iso", mentioned_iso, "_iso_said")
    foreign = F.coalesce(F.col("iso") != focal_iso, F.lit(False))
    strict = F.when(F.col("_said") & F.col("_near"), "pericoupling").when(F.col("_said"), "telecoupling")
    strict = strict.when((foreign & F.col("_iso_said")) if mentioned_iso is not None else F.lit(False), "telecoupling").otherwise("na")
    by_iso = F.col("_iso_said") if mentioned_iso is not None else (F.coalesce(F.col("iso") == focal_iso, F.lit(False)) | F.col("_known"))
    loose = F.when(F.col("_near"), "pericoupling").when(by_iso, "telecoupling").otherwise("na")
    kind = F.when(F.col("code") == focal, "intracoupling").otherwise(strict if mentioned is not None else loose)
    return rows.select("code", "iso", kind.alias("class"))


def priority(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CLASSES)), kind)


def dissolve(classified: DataFrame, by: str = "iso") -> DataFrame:
    """(by, class): of a country's regions the class of the highest priority."""
    return classified.groupBy(by).agg(F.max_by("class", priority(F.col("class"))).alias("class"))


def detail_countries(focal: str, edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(iso): of the focal region and its neighbours."""
    near = both_ways(edges).where(F.col("src") == focal).select(F.col("dst").alias("region"))
    return regions.join(near.unionByName(regions.where(F.col("region") == focal).select("region")).distinct(), "region", "left_semi").select("iso").distinct()


def map_layer(classified: DataFrame) -> DataFrame:
    """Adds a colour to classes."""
    table = F.create_map(*[x for k, v in COLOURS.items() for x in (F.lit(k), F.lit(v))])
    return classified.withColumn("colour", F.element_at(table, F.col("class")))


def validation(focal: DataFrame, others: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, pericoupled, telecoupled, note): how the pairs of a focal country with others in an analysis agree with its classes.

    focal: (key, focal, says_peri, says_tele), the classes an analysis claims; others: (key, code).
    """
    pairs = focal.join(others, key).where("focal <> code").distinct()
    found = lookup_pairs(pairs, edges, "focal", "code")
    list_of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("pair_type") == kind, F.col("code"))))
    rows = found.groupBy(key, "focal", "says_peri", "says_tele").agg(list_of("pericoupled").alias("pericoupled"), list_of("telecoupled").alias("telecoupled"))
    peri, tele = F.size("pericoupled") > 0, F.size("telecoupled") > 0
    note = F.when((peri & ~F.col("says_peri")) | (tele & ~F.col("says_tele") & ~peri), "differs").when(peri | tele, "consistent").otherwise("no pairs")
    return rows.withColumn("note", note)


def largest_part(parts: DataFrame, key: str, area: str, *point: str) -> DataFrame:
    """(key, point): the representative point of the largest part."""
    return parts.groupBy(key).agg(F.max_by(F.struct(*point), F.struct(area, *point)).alias("p")).select(key, "p.*")


def bounds(points: DataFrame, key: str, x: str, y: str, margin: float = 2.0) -> DataFrame:
    return points.groupBy(key).agg(*[f(c).alias(n) for f, c, n in ((F.min, x, "x0"), (F.min, y, "y0"), (F.max, x, "x1"), (F.max, y, "y1"))]).select(key, *[(F.col(c) + s * margin).alias(c) for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])
