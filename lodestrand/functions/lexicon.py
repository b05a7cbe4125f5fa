"""Word lists and lookup tables."""

# Words that retrieval ignores.
STOPWORDS = tuple("""
a an the and or but in on at to for of with by from is it as be was were are been being has had have do does did
will would could should may might can shall not no nor so if then than that this these those their its our his her my your
we they he she you i me us them him also more most much many some any all each every both few several other another such only
just very too even still already about over after before between through during into out up down which who whom what where when
how while there here et al fig figure table however thus therefore although because since whether either neither per via
""".split())

# Words too general to support a citation.
GENERIC_TOKENS = tuple("""
agent agents cause causes coupled coupling effect effects flow flows framework human humannature impact impacts information
interaction interactions intracoupling metacoupling nature pericoupling receiving sending spillover system systems telecoupling
""".split())

# Words that are no search terms, in any text, in free text, in records.
TERM_STOPWORDS = tuple("""
this that with from have been were will also more than such each which their there these those about into over between through
during before after other some both most very just only well including based using
""".split())
TEXT_TERM_STOPWORDS = (*TERM_STOPWORDS, "analyze", "analysis", "study", "research", "please", "help")
RECORD_TERM_STOPWORDS = (*TERM_STOPWORDS, "system", "systems", "analysis", "study", "research", "framework", "intracoupling", "pericoupling", "telecoupling")

# Words that web snippets are not matched by.
WEB_STOPWORDS = tuple("""
a an the and or but in on of to for is are was were be been by at as it its with from this that these those not no do does did
has have had will would shall should can could may might must so if than too very also about more most such each every all
any both few many much some their them they which what when where who how because between into through during before after
above below up down out off over under again further then once here there just only own same other another new old well still
even us our we you your he she him her his
""".split())

# Words of a query that name no topic, and words that show interest in trade.
QUERY_FILLER = tuple("""
a an analyze analysed analyzed analyzes analyzing analysis and apply applying assess assessed assessing assesses case consider
considering examines examining explain explains focus focused focusing for from how impact impacts in investigate investigating
looking my of on or our paper project question questions research researcher researchers review reviews study studying the to
topic topics what will with
""".split())
STRUCTURAL_TERMS = tuple("""
chain chains commodity commodities coupling couplings effect effects environment environmental export exported exporter exporters
exports flow flows food framework frameworks import imported importer importers imports industry industries market markets
metacoupling partner partners production productions sector sectors supply system systems telecoupling trade traded trader traders
trading transfer transfers
""".split())
TRADE_HINTS = tuple("""
destination destinations export exported exporter exporters exports import imported importer importers imports market markets
partner partners trade traded trader traders trading
""".split())

# Categories of flows, and words that stand for them, first match first.
FLOW_CATEGORIES = ("capital", "energy", "information", "matter", "organisms", "people")
FLOW_ALIASES = (
    ("material", "matter"), ("materials", "matter"), ("goods", "matter"), ("commodity", "matter"), ("commodities", "matter"),
    ("financial", "capital"), ("finance", "capital"), ("monetary", "capital"), ("money", "capital"), ("economic", "capital"),
    ("knowledge", "information"), ("data", "information"), ("technology", "information"), ("human", "people"), ("labor", "people"),
    ("labour", "people"), ("migration", "people"), ("organism", "organisms"), ("biological", "organisms"), ("species", "organisms"),
    ("wildlife", "organisms"), ("power", "energy"), ("electricity", "energy"),
)

# Levels of agents with the words that stand for each, first match first.
AGENT_LEVELS = (
    ("individuals / households", "individuals / households|individuals/households|individual|individuals|person|people|household|households|family|families|resident|residents|farmer|farmers|consumer|consumers|tourist|tourists"),
    ("firms / traders / corporations", "firms / traders / corporations|firms/traders/corporations|firm|firms|trader|traders|company|companies|corporation|corporations|business|businesses|exporter|exporters|importer|importers"),
    ("governments / policymakers", "governments / policymakers|governments/policymakers|government|governments|policymaker|policymakers|policy maker|policy makers|regulator|regulators|agency|agencies"),
    ("organizations / NGOs", "organization|organizations|organisations|organisation|organizations / ngos|organizations/ngos|ngo|ngos|nonprofit|non-profit|university|universities|research institution|research institutions"),
    ("non-human agents", "non-human agents|nonhuman agents|non-human|nonhuman|animal|animals|species|organism|organisms|pathogen|pathogens|pest|pests|invasive species|livestock|crop|crops"),
)

# Categories of causes and effects with the headings that stand for each.
CAUSE_CATEGORIES = (
    ("economic", "economic|economics|socioeconomic|socio-economic|financial|market"),
    ("political / institutional", "political|institutional|political / institutional|political/institutional|governance"),
    ("ecological / biological", "ecological|biological|ecological / biological|ecological/biological|environmental|biodiversity"),
    ("technological / infrastructural", "technological|infrastructural|technological / infrastructural|technological/infrastructural|infrastructure"),
    ("cultural / social / demographic", "cultural|social|demographic|cultural / social / demographic|cultural/social/demographic|cultural / demographic / social"),
    ("hydrological", "hydrological|water"),
    ("climatic / atmospheric", "climatic|atmospheric|climatic / atmospheric|climatic/atmospheric|climate|biogeochemical"),
    ("geological / geomorphological", "geological|geomorphological|geological / geomorphological|geological/geomorphological"),
)

# Roles of systems and labels of their fields.
SYSTEM_ROLES = ("focal", "adjacent", "sending", "receiving", "spillover")
SYSTEM_FIELDS = (
    ("human_subsystem", "human subsystem|human subsystems|human component|human components"),
    ("natural_subsystem", "natural subsystem|natural subsystems|natural component|natural components"),
    ("geographic_scope", "geographic scope|geography|location"),
)

# Headings that end or are left out of a document's text.
REFERENCE_HEADINGS = ("references", "bibliography", "literature cited", "acknowledgments", "acknowledgements", "appendix", "supplementary material", "supporting information")

# Suffixes of region names that may be left out.
REGION_SUFFIXES = ("sheng", "oblast", "okrug", "kray", "pradesh", "laen", "novads", "maakond", "region", "province", "state", "zizhiqu", "rep.", "giang")

# Words of a direction that refer to the countries of a role.
ROLE_REFERENCES = (
    ("receiving", "receiving|importing|importer|importers|destination|destinations"),
    ("spillover", "spillover|competing|competitor|competitors|indirectly affected"),
    ("adjacent", "adjacent|neighboring|neighbouring|pericoupled|nearby"),
    ("sending", "sending|exporting|exporter|exporters|origin|origins"),
)

# Wording that makes a list of countries too uncertain to use, always or unless asked for.
HARD_HEDGES = ("for example", "e.g.", "depending on", "depending upon", "another market", "another destination", "does not specify", "not specify", "not yet", "uncertain", "unknown", "would specify whether", "should be confirmed", "to be confirmed")
SOFT_HEDGES = ("such as", "likely", "may ", " may", "might", "could", "plausible", "potential", "possible", "include", "includes", "including", "proxy")
MARKET_WORDS = ("receiving", "market", "markets", "destination", "destinations", "export", "exports", "import", "imports")
LOCATION_HEDGES = ("such as", "for example", "for instance", "e.g.", "including", "especially", "depending on", "potentially", "plausibly", "likely ", "possible ")
LIST_WORDS = "and|or|countries?|country|markets?|market|regions?|region|systems?|system|states?|state|destinations?|destination|importers?|exporters?|trade|trading|importing|exporting|distant|domestic|foreign|international|major|key|selected|target|receiving|sending|spillover|focal|adjacent|nonadjacent|other|main|principal|likely|possible|potential|plausible|connected|connect|linked|link|including|include|includes|such|proxy|confirmed|top"


def lookup(table: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    """(word, value) pairs of a table of value and words joined by bars, in order."""
    return [(word, value) for value, words in table for word in words.split("|")]
