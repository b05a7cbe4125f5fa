"""All queries of the library's own operators, with their SQL equivalents.

The driver's tables stand in for papers and places: a document is a passage, its source the paper
and its language the section; nations are countries, and adjacent when they share a region.
"""

from __future__ import annotations

from lodestrand.plans import catalogue_geo, catalogue_links, catalogue_records, catalogue_text

QUERIES = {**catalogue_text.QUERIES, **catalogue_geo.QUERIES, **catalogue_links.QUERIES, **catalogue_records.QUERIES}
ORACLE = {**catalogue_text.ORACLE, **catalogue_geo.ORACLE, **catalogue_links.ORACLE, **catalogue_records.ORACLE}
