"""The queries of this subpackage and the SQL that checks them."""

from . import langid, media, mixing, neardup, packing, quality_model, quality_rules, secrets, substrings, toxicity

_modules = (mixing, quality_model, neardup, langid, substrings, media, packing, secrets, toxicity, quality_rules)
QUERIES = {name: f for m in _modules for name, f in m.QUERIES.items()}
SQL = {name: q for m in _modules for name, q in m.SQL.items()}
