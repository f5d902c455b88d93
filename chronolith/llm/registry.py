"""The opN_ queries and their SQL."""

from chronolith.llm import decontaminate, media, neardup, pieces, pii, quality, secret_scan, substrings, urls, warc

MODULES = (decontaminate, pii, secret_scan, substrings, media, urls, quality, neardup, pieces, warc)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
