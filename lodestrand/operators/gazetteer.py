"""Place names to codes.

A gazetteer is a table ``terms(term, code, kind, ord)``: term in lower case; kind ``code``, ``alias`` or
``name``. Texts meet terms by equality, or for names inside a text by a join on the term's first
word, which leaves few candidates for the boundary test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import lexicon as L
from lodestrand.functions import text as T

# Other names of countries, and their adjectives.
ALIASES = (
    ("us", "USA"), ("usa", "USA"), ("u.s.", "USA"), ("u.s.a.", "USA"), ("uk", "GBR"), ("u.k.", "GBR"), ("uae", "ARE"), ("u.a.e.", "ARE"),
    ("drc", "COD"), ("dr congo", "COD"), ("rok", "KOR"), ("dprk", "PRK"), ("prc", "CHN"), ("america", "USA"), ("united states", "USA"),
    ("united states of america", "USA"), ("britain", "GBR"), ("great britain", "GBR"), ("united kingdom", "GBR"), ("england", "GBR"),
    ("scotland", "GBR"), ("wales", "GBR"), ("holland", "NLD"), ("the netherlands", "NLD"), ("ivory coast", "CIV"), ("cote d'ivoire", "CIV"),
    ("côte d'ivoire", "CIV"), ("czech republic", "CZE"), ("czechia", "CZE"), ("south korea", "KOR"), ("south sudan", "SSD"), ("greenland", "GRL"),
    ("montenegro", "MNE"), ("puerto rico", "USA"), ("new caledonia", "NCL"), ("falkland islands", "FLK"), ("falklands", "FLK"),
    ("republic of korea", "KOR"), ("north korea", "PRK"), ("democratic people's republic of korea", "PRK"), ("burma", "MMR"), ("myanmar", "MMR"),
    ("persia", "IRN"), ("swaziland", "SWZ"), ("eswatini", "SWZ"), ("east timor", "TLS"), ("timor-leste", "TLS"), ("zaire", "COD"),
    ("congo-kinshasa", "COD"), ("democratic republic of the congo", "COD"), ("congo-brazzaville", "COG"), ("republic of the congo", "COG"),
    ("congo", "COG"), ("palestine", "PSE"), ("palestinian territories", "PSE"), ("west bank", "PSE"), ("gaza", "PSE"), ("hong kong", "HKG"),
    ("macau", "MAC"), ("macao", "MAC"), ("taiwan", "TWN"), ("brunei darussalam", "BRN"), ("cabo verde", "CPV"), ("cape verde", "CPV"),
    ("laos", "LAO"), ("lao pdr", "LAO"), ("russia", "RUS"), ("russian federation", "RUS"), ("soviet union", "RUS"), ("ussr", "RUS"), ("iran", "IRN"),
    ("syria", "SYR"), ("libya", "LBY"), ("venezuela", "VEN"), ("bolivia", "BOL"), ("tanzania", "TZA"), ("vietnam", "VNM"), ("viet nam", "VNM"),
    ("north macedonia", "MKD"), ("macedonia", "MKD"), ("bosnia", "BIH"), ("bosnia and herzegovina", "BIH"), ("serbia", "SRB"), ("yugoslavia", "SRB"),
    ("serbia and montenegro", "SRB"), ("western sahara", "ESH"), ("french guiana", "GUF"), ("papua new guinea", "PNG"), ("new zealand", "NZL"),
    ("south africa", "ZAF"), ("saudi arabia", "SAU"), ("sri lanka", "LKA"), ("trinidad and tobago", "TTO"), ("el salvador", "SLV"),
    ("costa rica", "CRI"), ("central african republic", "CAF"), ("equatorial guinea", "GNQ"), ("guinea-bissau", "GNB"), ("sierra leone", "SLE"),
    ("burkina faso", "BFA"), ("san marino", "SMR"), ("turkiye", "TUR"), ("türkiye", "TUR"), ("turkey", "TUR"), ("american", "USA"),
    ("mexican", "MEX"), ("canadian", "CAN"), ("brazilian", "BRA"), ("chinese", "CHN"), ("indian", "IND"), ("german", "DEU"), ("french", "FRA"),
    ("british", "GBR"), ("japanese", "JPN"), ("korean", "KOR"), ("korea", "KOR"), ("australian", "AUS"), ("russian", "RUS"), ("italian", "ITA"),
    ("spanish", "ESP"), ("colombian", "COL"), ("chilean", "CHL"), ("peruvian", "PER"), ("argentine", "ARG"), ("argentinian", "ARG"),
    ("venezuelan", "VEN"), ("ecuadorian", "ECU"), ("bolivian", "BOL"), ("paraguayan", "PRY"), ("uruguayan", "URY"), ("guatemalan", "GTM"),
    ("honduran", "HND"), ("salvadoran", "SLV"), ("nicaraguan", "NIC"), ("costa rican", "CRI"), ("panamanian", "PAN"), ("cuban", "CUB"),
    ("dominican", "DOM"), ("haitian", "HTI"), ("jamaican", "JAM"), ("ethiopian", "ETH"), ("kenyan", "KEN"), ("nigerian", "NGA"), ("ghanaian", "GHA"),
    ("south african", "ZAF"), ("egyptian", "EGY"), ("moroccan", "MAR"), ("tunisian", "TUN"), ("algerian", "DZA"), ("sudanese", "SDN"),
    ("tanzanian", "TZA"), ("ugandan", "UGA"), ("thai", "THA"), ("vietnamese", "VNM"), ("indonesian", "IDN"), ("malaysian", "MYS"),
    ("philippine", "PHL"), ("filipino", "PHL"), ("cambodian", "KHM"), ("burmese", "MMR"), ("pakistani", "PAK"), ("afghan", "AFG"), ("iranian", "IRN"),
    ("iraqi", "IRQ"), ("saudi", "SAU"), ("turkish", "TUR"), ("israeli", "ISR"), ("palestinian", "PSE"), ("jordanian", "JOR"), ("lebanese", "LBN"),
    ("syrian", "SYR"), ("polish", "POL"), ("ukrainian", "UKR"), ("romanian", "ROU"), ("hungarian", "HUN"), ("czech", "CZE"), ("swedish", "SWE"),
    ("norwegian", "NOR"), ("finnish", "FIN"), ("danish", "DNK"), ("dutch", "NLD"), ("belgian", "BEL"), ("swiss", "CHE"), ("austrian", "AUT"),
    ("portuguese", "PRT"), ("greek", "GRC"), ("irish", "IRL"), ("scottish", "GBR"), ("welsh", "GBR"),
)
#: Boundary files' codes where they differ.
BOUNDARY_CODES = {"ROU": "ROM", "COD": "ZAR", "TLS": "TMP", "SRB": "YUG"}


def countries(spark: SparkSession) -> DataFrame:
    """(code, name): ISO 3166 alpha-3 codes and English names, from the JVM's locale data."""
    jvm = spark.sparkContext._jvm
    rows = []
    for two in jvm.java.util.Locale.getISOCountries():
        place = jvm.java.util.Locale("", two)
        rows.append((place.getISO3Country(), place.getDisplayCountry(jvm.java.util.Locale.ENGLISH)))
    return spark.createDataFrame(sorted(rows), "code string, name string")


def terms(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """A gazetteer from (code, name) and (alias, code); of equal terms of a kind the one with the smallest code."""
    parts = names.select(F.lower("code").alias("term"), "code", F.lit("code").alias("kind"), F.lit(0).alias("prio"))
    parts = parts.unionByName(names.select(F.lower("name").alias("term"), "code", F.lit("name").alias("kind"), F.lit(2).alias("prio")))
    if aliases is not None:
        parts = parts.unionByName(aliases.select(F.lower("alias").alias("term"), "code", F.lit("alias").alias("kind"), F.lit(1).alias("prio")))
    return parts.where("term <> ''").groupBy("term", "kind", "prio").agg(F.min("code").alias("code"))


def default_terms(spark: SparkSession) -> DataFrame:
    return terms(countries(spark), spark.createDataFrame(list(ALIASES), "alias string, code string"))


def contains_term(text: Column, term: Column, inside: str = "a-z0-9") -> Column:
    """Whether the lower-case term stands in the lower-case text with no letter or digit at either side."""
    return F.regexp_like(text, F.concat(F.lit(rf"(?<![{inside}])\Q"), term, F.lit(rf"\E(?![{inside}])")))


def _first_word(term: Column) -> Column:
    """Its first run of a-z and 0-9; of a term without any its first character."""
    return F.coalesce(F.nullif(F.regexp_extract(term, "[a-z0-9]+", 0), F.lit("")), F.substring(F.trim(term), 1, 1))


def mentions(texts: DataFrame, key: list[str], text_col: str, gazetteer: DataFrame) -> DataFrame:
    """(key, term, code, prio): every alias or name that stands in a text by itself."""
    names = gazetteer.where("kind <> 'code'").withColumn("_w", _first_word(F.col("term")))
    rows = texts.select(*key, F.lower(text_col).alias("_t")).where("_t is not null")
    words = rows.select(*key, "_t", F.explode(F.array_distinct(T.all_matches(F.col("_t"), r"[a-z0-9]+|[^\x00-\x7f]"))).alias("_w"))
    plain = words.join(names.where("_w <> ''"), "_w")
    return plain.where(contains_term(F.col("_t"), F.col("term"))).select(*key, "term", "code", "prio")


def resolve(texts: DataFrame, key: list[str], text_col: str, gazetteer: DataFrame) -> DataFrame:
    """(key, code): the text as a code, an alias or a name; else the longest term that stands in it, of equally long ones an alias, then by term. Null if nothing does."""
    rows = texts.select(*key, F.lower(F.trim(text_col)).alias("_t"))
    whole = rows.join(gazetteer.withColumnRenamed("term", "_t"), "_t").select(*key, "code", F.lit(0).alias("_stage"), F.lit(0).alias("_len"), "prio", F.col("_t").alias("term"))
    part = mentions(rows, key, "_t", gazetteer).select(*key, "code", F.lit(1).alias("_stage"), (-F.length("term")).alias("_len"), "prio", "term")
    best = whole.unionByName(part).groupBy(*key).agg(F.min_by("code", F.struct("_stage", "_len", "prio", "term")).alias("code"))
    return texts.select(*key).join(best, key, "left")


def country_scan(texts: DataFrame, key: list[str], text_col: str, gazetteer: DataFrame) -> DataFrame:
    """(key, code), distinct: of the whole text, of its parts between delimiters of three characters or more, and of these between and/or."""
    whole = texts.select(*key, F.col(text_col).alias("_t"))
    chunks = F.split("_t", r"[,;/()|→↔\n]+|->|<->|=>")
    parts = F.concat(F.array(F.col("_t")), chunks, F.flatten(F.transform(chunks, lambda c: F.split(c, r"(?i)\band\b|\bor\b"))))
    rows = whole.select(*key, F.posexplode(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= 3))).alias("_n", "_part"))
    return resolve(rows, [*key, "_n"], "_part", gazetteer).where("code is not null").select(*key, "code").distinct()


# --- regions -----------------------------------------------------------------------------------


def region_terms(regions: DataFrame) -> DataFrame:
    """(term, region, iso) from (region, name, iso): names whole, without a suffix, and the parts around slashes."""
    name = F.lower("name")
    bare = [F.when(name.endswith(" " + s), F.trim(F.substring(name, F.lit(1), F.length(name) - len(s) - 1))) for s in L.REGION_SUFFIXES]
    parts = F.when(F.contains(name, F.lit("/")), F.transform(F.split(name, "/"), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    others = F.filter(F.concat(F.array(*bare), parts), lambda x: x.isNotNull() & (F.length(x) >= 2))
    return regions.select(F.explode(F.array_distinct(F.concat(F.array(name), others))).alias("term"), "region", "iso")


def resolve_regions(texts: DataFrame, key: list[str], name_col: str, regions: DataFrame, gazetteer: DataFrame, iso_col: str | None = None) -> DataFrame:
    """(key, region): a region's code, or null.

    With ``iso_col`` only regions of that country count; without, or where it is null, a text that is a
    country's name is none, and a name that regions of several countries have is ambiguous. A term of
    the whole text comes before terms that contain it or stand in it (four characters or more); of
    these the longest, then the smallest code. Regions without an ``iso`` are never found.
    """
    iso = F.col(iso_col) if iso_col else F.lit(None).cast("string")
    rows = texts.select(*key, F.lower(F.trim(name_col)).alias("_t"), iso.alias("_iso")).where("_t <> ''")
    index = region_terms(regions)
    exact = rows.join(index.withColumnRenamed("term", "_t"), "_t").select(*key, "_iso", "region", "iso", F.lit(0).alias("_stage"), F.lit(0).alias("_len"), F.col("_t").alias("term"))
    pieces = lambda df, col: df.withColumn("_w", F.explode(F.array_distinct(F.filter(F.split(col, "[^a-z]+"), lambda w: w != ""))))
    near = pieces(rows.where(F.length("_t") >= 4), "_t").join(pieces(index.where(F.length("term") >= 4), "term"), "_w").where("_t <> term")
    near = near.where(contains_term(F.col("_t"), F.col("term"), "a-z") | contains_term(F.col("term"), F.col("_t"), "a-z"))
    near = near.select(*key, "_iso", "region", "iso", F.lit(1).alias("_stage"), (-F.length("term")).alias("_len"), "term").distinct()
    found = exact.unionByName(near).where("_iso is null or iso = _iso")
    by_term = found.groupBy(*key, "_stage", "_len", "term", F.col("_iso").isNull().alias("_free")).agg(F.min("region").alias("region"), F.count_distinct("iso").alias("isos"))
    best = by_term.where("not _free or isos = 1").groupBy(*key, "_free").agg(F.min_by("region", F.struct("_stage", "_len", "term")).alias("region"))
    national = resolve(rows, key, "_t", gazetteer).where("code is not null").select(*key)
    free = best.where("_free").join(national, key, "left_anti")
    return texts.select(*key).join(best.where("not _free").unionByName(free).select(*key, "region"), key, "left")


# --- questions ---------------------------------------------------------------------------------


def focus(texts: DataFrame, key: list[str], text_col: str, regions: DataFrame, gazetteer: DataFrame, names: DataFrame) -> DataFrame:
    """(key, place, country): what a question is about.

    Of its phrases, longest first, the first that names a region gives the place and, by the region's
    ``iso`` in ``names(code, name)``, the country; where none does, place is null and the first phrase
    that names a country gives the country. Both are null without either, and for null and empty texts.
    """
    rows = texts.select(*key, F.posexplode(T.phrases(F.col(text_col))).alias("_n", "_p")).withColumn("_p", T.without_possessive(F.col("_p"))).where("_p <> ''")
    first = lambda found, code: found.where(F.col(code).isNotNull()).groupBy(*key).agg(F.min_by(code, "_n").alias(code))
    region, country = first(resolve_regions(rows, [*key, "_n"], "_p", regions, gazetteer), "region"), first(resolve(rows, [*key, "_n"], "_p", gazetteer), "code")
    places = regions.select("region", F.col("name").alias("place"), F.col("iso").alias("_iso"))
    out = texts.select(*key).join(region, key, "left").join(places, "region", "left").join(country, key, "left")
    code = F.when(F.col("region").isNotNull(), F.col("_iso")).otherwise(F.col("code"))
    called = names.select(F.col("code").alias("_code"), F.col("name").alias("country"))
    return out.withColumn("_code", code).join(called, "_code", "left").select(*key, "place", "country")
