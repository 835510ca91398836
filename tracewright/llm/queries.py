"""The queries of this subpackage and the SQL that checks them."""

from . import additive, bpe, chosen_path, fim, html_text, media, packing, pii, quality, runs, secrets, shingle_join, toxicity

MODULES = (secrets, quality, media, shingle_join, html_text, pii, bpe, toxicity, additive, packing, fim, runs, chosen_path)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
