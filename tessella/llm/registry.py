"""The queries of this subpackage and the SQL that checks them."""

from tessella.llm import decontaminate, html_text, minhash_dedup, mixing, quality, secret_scan, surrogates, token_counts, toxicity, vector_dedup

MODULES = [quality, decontaminate, minhash_dedup, toxicity, html_text, vector_dedup, secret_scan, surrogates, token_counts, mixing]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
