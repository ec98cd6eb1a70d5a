"""All queries of the listing engine, by group, with their oracle SQL."""

from hearthline import queries
from hearthline.plans import link_queries, listing_queries, lookup_queries, markup_queries, page_queries, site_queries, state_queries, store_queries

GROUPS = (queries, link_queries, page_queries, listing_queries, state_queries, lookup_queries, markup_queries, site_queries, store_queries)
QUERIES: dict = {}
ORACLES: dict = {}
for _group in GROUPS:
    QUERIES.update(_group.QUERIES)
    ORACLES.update(_group.ORACLES)
