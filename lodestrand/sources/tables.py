"""Readers of side tables and document folders, and writers with their manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators.chunks import fingerprint
from lodestrand.operators.graph import edge_set, region_table

#: Fixed value: the status of disputed areas in boundary files.
DISPUTED = "Non-determined legal status area"


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with a header, all strings, trimmed; a missing column is an error, rows without any value are dropped."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = {c.lstrip("﻿").strip(): c for c in rows.columns}
    lacking = [c for c in required if c not in names]
    if lacking:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    rows = rows.select(*[F.trim(F.col(f"`{raw}`")).alias(c) for c, raw in names.items()])
    return rows.where(F.concat_ws("", *[F.col(c) for c in required]) != "")


def read_country_pairs(spark: SparkSession, path: str) -> DataFrame:
    """edges(a, b) of the rows whose Intracoupling is 1."""
    rows = read_csv(spark, path, ["Sending", "Receiving", "Intracoupling"])
    return edge_set(rows.where("Intracoupling = '1'"), "Sending", "Receiving")


def read_region_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, regions) of an edge list with columns ADM1_code_A, ADM1_name_A, ISO_A3_A, country_A and the same for B."""
    rows = read_csv(spark, path, ["ADM1_code_A", "ADM1_code_B"]).withColumn("_at", F.monotonically_increasing_id())
    sides = [F.coalesce(F.col(f"{raw}_{s.upper()}"), F.lit("")).alias(f"{c}_{s}") for s in "ab" for c, raw in (("region", "ADM1_code"), ("name", "ADM1_name"), ("iso", "ISO_A3"), ("country", "country"))]
    rows = rows.select("_at", *sides).where("region_a <> '' and region_b <> ''")
    return edge_set(rows, "region_a", "region_b"), region_table(rows.withColumnRenamed("_at", "at"), "at")


def read_documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(file_name, text): whole files, names in the order of their bytes."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")).orderBy("file_name")


def unzip(files: DataFrame) -> DataFrame:
    """(archive, file_name, text): text members of zip files read as binary files, one archive at a time."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(data.as_buffer())) as z:
                    for member in z.infolist():
                        if not member.is_dir():
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member.filename]), pa.array([z.read(member).decode("utf-8", "replace")])], ["archive", "file_name", "text"])

    return files.select(F.regexp_extract("path", "([^/]+)$", 1), "content").mapInArrow(run, "archive string, file_name string, text string")


def coalesced_codes(boundaries: DataFrame, names: list[str], to: str, remap: dict[str, str] | None = None) -> DataFrame:
    """Adds ``to``: the first of the columns ``names`` that exist and isn't blank or -99, with codes replaced by ``remap``."""
    have = [F.when(~F.trim(n).isin("", "-99"), F.upper(F.trim(n))) for n in names if n in boundaries.columns]
    if not have:
        raise ValueError(f"none of the columns {', '.join(names)}")
    code = F.coalesce(*have)
    if remap:
        code = F.coalesce(F.try_element_at(F.create_map(*[x for p in remap.items() for x in map(F.lit, p)]), code), code)
    return boundaries.withColumn(to, code)


def disputed(boundaries: DataFrame, column: str = "WB_STATUS") -> DataFrame:
    """The rows of an overlay of disputed areas; none where the column is missing."""
    return boundaries.where(F.col(column) == DISPUTED) if column in boundaries.columns else boundaries.limit(0)


def fallback(*tables: DataFrame | None) -> DataFrame | None:
    """The first table that is there and has a row."""
    return next((t for t in tables if t is not None and t.limit(1).count()), None)


def write_with_manifest(rows: DataFrame, path: str, order: list[str], columns: list[str], **facts: str) -> None:
    """Parquet under path/data and one JSON row under path/manifest: rows, fingerprint, facts, and the time."""
    rows.write.mode("overwrite").parquet(f"{path}/data")
    kept = rows.sparkSession.read.parquet(f"{path}/data")
    manifest = fingerprint(kept, order, columns).select("*", *[F.lit(v).alias(k) for k, v in sorted(facts.items())], F.current_timestamp().alias("built_at"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_with_manifest(spark: SparkSession, path: str, order: list[str], columns: list[str]) -> DataFrame:
    """The rows written with a manifest; an error if count or fingerprint differ."""
    rows = spark.read.parquet(f"{path}/data")
    said, found = spark.read.json(f"{path}/manifest").first(), fingerprint(rows, order, columns).first()
    if (said["rows"], said["fingerprint"]) != (found["rows"], found["fingerprint"]):
        raise ValueError(f"{path}: {found['rows']} rows, not the {said['rows']} of the manifest, or other contents")
    return rows


def pending(rows: DataFrame, done: DataFrame, key: str, start: int = 0, count: int | None = None, ship: str | None = None) -> DataFrame:
    """Rows to work on: those to ship, from ``start`` on, without those already done."""
    rows = rows if ship is None else rows.where(F.lower(F.trim(ship)) == "yes")
    rows = rows.orderBy(key).offset(start)
    return (rows if count is None else rows.limit(count)).join(done, key, "left_anti")


def record_markdown(title: Column, meta: Column, summary: Column, sections: dict[str, Column]) -> Column:
    """A summary as markdown: a title, metadata lines, the summary, and a list for each section."""
    block = lambda name, items: F.concat(F.lit(f"\n\n## {name}\n\n"), F.coalesce(F.nullif(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")), F.lit("- Not identified.")))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(meta, "\n"), F.lit("\n\n## Summary\n\n"), F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.lit("Not available.")), *[block(n, i) for n, i in sections.items()], F.lit("\n"))


def safe_stem(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(T.without_marks(name), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, 90)


def page_lines_to_markdown(lines: DataFrame, key: str, order: str, text_col: str, excluded: tuple[str, ...] = ("references", "bibliography", "acknowledgements", "acknowledgments")) -> DataFrame:
    """(key, text): extracted page lines as markdown: headings (capitals of up to eight words, or numbered under 100 characters), excluded sections dropped, other lines joined to paragraphs."""
    from pyspark.sql.window import Window

    line = F.trim(text_col)
    caps = (line == F.upper(line)) & line.rlike("[A-Z]") & (F.size(F.split(line, r"\s+")) <= 8)
    numbered = line.rlike(r"^\d+(?:\.\d+)*\.?\s+[A-Z]") & (F.length(line) < 100)
    name = F.when(caps, F.initcap(F.lower(line))).when(numbered, line)
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(key, order, line.alias("l"), name.alias("h")).where("l <> ''").withColumn("s", F.coalesce(F.last("h", True).over(so_far), F.lit("")))
    rows = rows.where(~F.lower(F.regexp_replace("s", r"^[\d.\s]+", "")).isin(*excluded))
    shown = F.when(F.col("h").isNotNull(), F.concat(F.lit("\n## "), "h", F.lit("\n"))).otherwise(F.when(F.col("l").endswith("-"), F.regexp_replace("l", "-$", "")).otherwise(F.concat("l", F.lit(" "))))
    rows = rows.withColumn("t", shown)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "t"))), lambda x: x["t"]), "").alias("text"))


def keyword_block(text: Column) -> Column:
    """Keywords of a paper's text: a heading with its paragraph, a bold or plain line, or inline; split at |, else ;, else commas. Null without."""
    after = F.regexp_extract(text, r"(?im)^#{1,6}\s*key\s?words?\s*:?\s*\n+([^\n#]+)", 1)
    line = F.regexp_extract(text, r"(?im)^\*{0,2}key\s?words?\*{0,2}\s*[:—-]\s*\*{0,2}\s*([^\n]+)$", 1)
    inline = F.regexp_extract(text, r"(?i)\bkey\s?words?\s*[:—-]\s*([^\n.]+)", 1)
    found = F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (after, line, inline)])
    by = F.when(F.contains(found, F.lit("|")), F.split(found, r"\|")).when(F.contains(found, F.lit(";")), F.split(found, ";")).otherwise(F.split(found, ","))
    return F.filter(F.transform(by, lambda w: F.regexp_replace(F.trim(w), r"[.*]+$", "")), lambda w: w != "")


def abstract_block(text: Column) -> Column:
    """The abstract of a paper's text by the first form that fits: a heading, bold, a label, spaced letters, a summary heading; null without. Graphical abstracts don't count."""
    t = F.regexp_replace(text, r"(?is)^#{1,6}\s*graphical abstract.*?(?=^#{1,6}\s)", "")
    stop = r"(?=\n\s*(?:#{1,6}\s|\*{0,2}key\s?words?\b|\*{0,2}introduction\b|1\.?\s+introduction)|\z)"
    forms = (r"(?im)^#{1,6}\s*abstract\s*:?\s*\n+", r"(?im)^\*\*\s*abstract\s*:?\s*\*\*\s*:?\s*", r"(?im)^abstract\s*[:.—-]\s*", r"(?im)^a\s+b\s+s\s+t\s+r\s+a\s+c\s+t\s*\n+", r"(?im)^#{1,6}\s*summary\s*:?\s*\n+", r"(?im)^abstract\s*\n+")
    return F.coalesce(*[F.nullif(T.squeeze(F.regexp_extract(t, rf"(?s){f}(.+?){stop}", 1)), F.lit("")) for f in forms])


def corpus_source(folder: str | None = None, corpus: str | None = None, shipped: dict[str, str] | None = None) -> str | None:
    """Where the papers are: a folder, or the path of a shipped corpus by its name (case and ``-`` for ``_`` don't matter); None for neither, an error for both."""
    if folder is not None and corpus is not None:
        raise ValueError("give a folder or the name of a shipped corpus, not both")
    if corpus is None:
        return folder
    shipped = shipped or {}
    name = corpus.strip().lower().replace("-", "_")
    if name not in shipped:
        raise ValueError(f"no shipped corpus named {corpus!r}; there are {sorted(shipped)}")
    return shipped[name]
