"""Every query of this subpackage and its SQL, where SQL can express it."""

from __future__ import annotations

from . import divergence, language_id, license_scan, main_text, manifest, near_dedup, packing, pieces, quality_rules, secret_scan, substring_dedup, vector_search, warc

_MODULES = (packing, secret_scan, near_dedup, language_id, pieces, license_scan, warc, quality_rules, substring_dedup, vector_search, main_text, manifest, divergence)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in getattr(m, "SQL", {}).items()}
