"""Record linkage: files, citations and titles to papers.

Candidates come from joins on a shared word or surname together with a year band, spread over the
years by exploding the smaller side; scores are computed on candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions import text as T
from lodestrand.sources.scratch import cut


def file_parts(name: Column) -> Column:
    """struct(authors, year, title) of ``authors - year - title.md``; null if the name isn't of that form."""
    form = r"(?i)^(.+?)\s*-\s*(\d{4})\s*-\s*(.+)\.md$"
    part = lambda i: F.regexp_extract(name, form, i)
    return F.when(name.rlike(form), F.struct(part(1).alias("authors"), part(2).cast("int").alias("year"), part(3).alias("title")))


def fallback_paper(name: Column) -> Column:
    """struct(key, title, authors, year, keywords) from a file name of any form."""
    parts, stem = file_parts(name), F.regexp_replace(name, r"\.[^.]+$", "")
    year = F.coalesce(F.nullif(F.regexp_extract(stem, r"\b((?:18|19|20)\d{2})\b", 1), F.lit("")).cast("int"), F.lit(0))
    cut = F.when(F.contains(stem, F.lit(" - ")), F.split(stem, " - ", 2)).when(F.contains(stem, F.lit("_")), F.split(stem, "_", 2)).otherwise(F.array(F.lit("Unknown"), stem))
    words = lambda c, p=r"\s+": F.trim(F.regexp_replace(c, p, " "))
    authors = F.coalesce(words(parts["authors"]), F.nullif(words(F.get(cut, F.lit(0))), F.lit("")), F.lit("Unknown"))
    title = F.coalesce(words(parts["title"]), F.nullif(words(F.get(cut, F.lit(1)), r"[_\s]+"), F.lit("")), stem)
    y = F.coalesce(parts["year"], year)
    key = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("_", authors, y.cast("string"), title)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 80)
    return F.struct(key.alias("key"), title.alias("title"), authors.alias("authors"), y.alias("year"), F.array(F.lit("rag-fallback-metadata")).alias("keywords"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(T.match_form(text), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(0.0)


def _near_years(rows: DataFrame, year: str) -> DataFrame:
    return rows.withColumn("_y", F.explode(F.array(F.col(year) - 1, F.col(year), F.col(year) + 1)))


def match_files(files: DataFrame, papers: DataFrame, file: str = "file_name", least: float = 0.3, order: str = "key") -> DataFrame:
    """(file, key, score): the paper within a year whose title words overlap most, with up to 0.2 for authors; under ``least`` none (nulls).

    Of equal scores the first by ``order``. Papers of one year with the same words and authors stand as one, the first
    by ``order``, and files of one year likewise. A file that meets its own title words and all its authors has the
    highest score there is, found by a join on the set of words; the others meet papers on year and shared word, of
    the title alone if authors can't reach ``least``.
    """
    named = files.select(file, file_parts(F.col(file)).alias("p")).where("p is not null")
    named = named.select(file, F.col("p.year").alias("fy"), F.array_sort(word_set(F.col("p.title"))).alias("ft"), F.array_sort(word_set(F.col("p.authors"))).alias("fa"))
    p = papers.select("key", F.col(order).alias("_o"), F.col("year").alias("py"), F.array_sort(word_set(F.col("title"))).alias("pt"), F.array_sort(word_set(F.col("authors"))).alias("pa")).where((F.size("pt") > 0) & F.col("pa").isNotNull())
    p = p.groupBy("py", "pt", "pa").agg(F.min(F.struct("_o", "key")).alias("_k"))
    f = named.select("fy", "ft", "fa").distinct()
    bonus = F.least(F.lit(0.2), F.size(F.array_intersect("fa", "pa")) * 0.05)
    fold = F.min(F.struct(-F.col("score"), "_k")).alias("_b")

    same = _near_years(f, "fy").join(p.select(F.col("py").alias("_y"), F.col("pt").alias("ft"), "pa", "_k"), ["_y", "ft"])
    top = F.round(F.lit(1.0) + F.least(F.lit(0.2), F.size("fa") * 0.05), 9)
    best = cut(same.withColumn("score", F.round(F.lit(1.0) + bonus, 9)).where((F.col("score") >= top) & (F.col("score") >= least)).groupBy("fy", "ft", "fa").agg(fold))

    words = (lambda t, a: F.array_distinct(F.concat(t, a))) if least <= 0.2 else (lambda t, a: F.col(t))
    rest = _near_years(f.join(best, ["fy", "ft", "fa"], "left_anti"), "fy").withColumn("_w", F.explode(words("ft", "fa")))
    others = p.withColumn("_w", F.explode(words("pt", "pa"))).withColumn("_y", F.col("py"))
    pairs = rest.join(others, ["_y", "_w"]).select("fy", "ft", "fa", "pt", "pa", "_k").distinct()
    score = F.round(jaccard(F.col("ft"), F.col("pt")) + bonus, 9)
    best = best.unionByName(pairs.withColumn("score", score).where(F.col("score") >= least).groupBy("fy", "ft", "fa").agg(fold))
    found = named.join(best, ["fy", "ft", "fa"]).groupBy(file).agg(F.min("_b").alias("_b")).select(file, F.col("_b._k.key").alias("key"), (-F.col("_b.col1")).alias("score"))
    return files.select(file).join(found, file, "left")


def common_prefix_words(a: Column, b: Column) -> Column:
    """How many leading words two texts share."""
    same = F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(same))


def title_score(a: Column, b: Column) -> Column:
    """Leading words in common if at least four or all of the first title; 3 if its first four words stand in the second; 2 if over fifteen of the characters of its first six do; else 0. Both in link form."""
    words = F.split(a, " ")
    n = common_prefix_words(a, b)
    four, six = F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.slice(words, 1, 6), " ")
    start = F.substring(six, 1, 16)
    return F.when((a == "") | (b == ""), 0).when(n >= F.least(F.lit(4), F.size(words)), n).when(F.contains(b, four), 3).when((F.length(six) >= 16) & F.contains(b, start), 2).otherwise(0)


def match_citations(cites: DataFrame, papers: DataFrame, cite: str = "cite_id") -> DataFrame:
    """(cite, key, score): year within one; an author in common and a fitting title (+10, or +5 for a weak one), or five leading title words. Nulls without a match; ties by key."""
    c = cites.select(cite, F.col("year").alias("cy"), T.link_form(F.col("title")).alias("ct"), _surnames(F.col("authors")).alias("ca"))
    p = papers.select("key", F.col("year").alias("py"), T.link_form(F.col("title")).alias("pt"), _surnames(F.col("authors")).alias("pa"))
    # a match shares a surname or the first title word
    c = _near_years(c, "cy").withColumn("_w", F.explode(F.array_distinct(F.concat("ca", F.array(F.concat(F.lit("t:"), F.get(F.split("ct", " "), F.lit(0))))))))
    p = p.withColumn("_w", F.explode(F.array_distinct(F.concat("pa", F.array(F.concat(F.lit("t:"), F.get(F.split("pt", " "), F.lit(0)))))))).withColumn("_y", F.col("py"))
    pairs = c.join(p, ["_y", "_w"]).select(cite, "key", "ct", "ca", "pt", "pa").distinct()
    t, author = title_score(F.col("ct"), F.col("pt")), F.arrays_overlap("ca", "pa")
    score = F.when(author & (t >= 2), t + 10).when(t >= 5, t).when(author & (t >= 1), t + 5)
    best = pairs.withColumn("score", score).where("score is not null").groupBy(cite).agg(F.min_by(F.struct("key", "score"), F.struct(-F.col("score"), "key")).alias("b"))
    return cites.select(cite).join(best.select(cite, "b.*"), cite, "left")


def _surnames(authors: Column) -> Column:
    names = F.split(F.coalesce(authors, F.lit("")), r"\s+and\s+|;")
    last = F.transform(names, lambda n: F.when(F.contains(n, F.lit(",")), F.split(n, ",")[0]).otherwise(n))
    return F.array_distinct(F.flatten(F.transform(last, T.surname_forms)))


def match_keys(files: DataFrame, papers: DataFrame, manual: DataFrame | None = None, file: str = "file_name") -> DataFrame:
    """(file, key, phase): a manual entry; else the same year with the first surname, or its first four letters, where several by title words; else null."""
    f = files.select(file, file_parts(F.col(file)).alias("p")).where("p is not null")
    f = f.select(file, F.col("p.year").alias("year"), F.get(_surnames(F.regexp_replace("p.authors", r"\s+et al\.?.*$| and .*$", "")), F.lit(0)).alias("s"), word_set(F.col("p.title")).alias("ft"))
    p = papers.select("key", "year", F.get(_surnames(F.col("authors")), F.lit(0)).alias("ps"), word_set(F.col("title")).alias("pt"))
    four = lambda c: F.substring(c, 1, 4)
    pairs = f.withColumn("_f", four("s")).join(p.withColumn("_f", four("ps")), ["year", "_f"])
    best = pairs.groupBy(file).agg(F.min_by("key", F.struct((F.col("s") != F.col("ps")).cast("int"), -F.size(F.array_intersect("ft", "pt")), "key")).alias("auto"))
    rows = files.select(file).join(best, file, "left")
    if manual is not None:
        rows = rows.join(manual.select(file, F.col("key").alias("manual")), file, "left")
    else:
        rows = rows.withColumn("manual", F.lit(None).cast("string"))
    return rows.select(file, F.coalesce("manual", "auto").alias("key"), F.when(F.col("manual").isNotNull(), "manual").when(F.col("auto").isNotNull(), "auto").otherwise("none").alias("phase"))


def audit_candidates(entries: DataFrame, rows: DataFrame, entry: str = "key", row: str = "file_name", least: float = 0.3, most: int = 3) -> DataFrame:
    """(entry, row, overlap, surname_hit, rank): rows whose name holds the entry's year and its surname, or enough of its title words."""
    e = entries.select(entry, F.col("year").cast("string").alias("y"), F.get(_surnames(F.col("authors")), F.lit(0)).alias("s"), word_set(F.col("title")).alias("t"))
    r = rows.select(row, F.explode(F.array_distinct(T.all_matches(F.col(row), r"(?:18|19|20)\d{2}"))).alias("y"), word_set(F.col(row)).alias("w"))
    pairs = e.join(r, "y")
    overlap = F.round(F.size(F.array_intersect("t", "w")) / F.greatest(F.lit(1), F.least(F.size("t"), F.size("w"))), 9)
    pairs = pairs.withColumn("overlap", overlap).withColumn("surname_hit", F.array_contains("w", F.col("s"))).where((F.col("overlap") >= least) | F.col("surname_hit"))
    best = Window.partitionBy(entry).orderBy(F.col("surname_hit").desc(), F.col("overlap").desc(), row)
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(entry, row, "overlap", "surname_hit", "rank")


def probe_keys(rows: DataFrame, index: DataFrame, row: str, candidates: str, path: str = "path") -> DataFrame:
    """(row, path): for an ordered array of candidate keys the path of the first that the index (key, path, ord) has; of repeated keys the last entry counts."""
    last = index.groupBy("key").agg(F.max_by(path, "ord").alias(path))
    hit = rows.select(row, F.posexplode(candidates).alias("_p", "key")).join(last, "key").groupBy(row).agg(F.min_by(path, "_p").alias(path))
    return rows.select(row).join(hit, row, "left")


def prefix_reconcile(left: DataFrame, right: DataFrame, a: str, b: str, least: int = 30, lead: int = 5) -> DataFrame:
    """(a, b, how): equal names first; of the rest those with a common prefix of ``least`` characters or more, if it is longer than any other's by over ``lead`` both ways."""
    ours, theirs = left.select(a, T.file_key(F.col(a)).alias("k")), right.select(b, T.file_key(F.col(b)).alias("k"))
    exact = ours.join(theirs, "k").select(a, b, F.lit("exact").alias("how"))
    rest_l, rest_r = ours.join(exact, a, "left_anti"), theirs.join(exact, b, "left_anti")
    head = lambda d, n: d.withColumnRenamed("k", n).withColumn("_h", F.substring(n, 1, least)).where(F.length("_h") == least)
    pairs = head(rest_l, "x").join(head(rest_r, "y"), "_h")
    common = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("x"), F.length("y"))), lambda n: F.substring(F.col("x"), F.lit(1), n) == F.substring(F.col("y"), F.lit(1), n)))
    pairs = pairs.withColumn("n", common)

    def clear(key: str) -> Column:
        w = Window.partitionBy(key).orderBy(F.col("n").desc(), a, b)
        return (F.row_number().over(w) == 1) & (F.col("n") - F.coalesce(F.lead("n").over(w), F.lit(-lead - 1)) > lead)

    pairs = pairs.withColumn("_a", clear(a)).withColumn("_b", clear(b)).where("_a and _b")
    return exact.unionByName(pairs.select(a, b, F.lit("prefix").alias("how")))


def unique_keys(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Adds ``unique_key``: the base, with _a, _b, ... from the second on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    letter = F.when(n <= 27, F.chr(F.lit(95) + n)).otherwise((n - 1).cast("string"))
    return rows.withColumn("unique_key", F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), letter)))


def bib_key(authors: Column, year: Column, title: Column) -> Column:
    """surname_firstword_year in ASCII lower case; short words aren't first words."""
    s = F.coalesce(F.get(_surnames(authors), F.lit(0)), F.lit("unknown"))
    w = F.filter(F.split(T.link_form(title), " "), lambda x: F.length(x) > 3)
    return F.concat_ws("_", s, F.coalesce(F.get(w, F.lit(0)), F.lit("untitled")), year.cast("string"))
