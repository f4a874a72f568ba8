"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import (
    bpe, collocations, decontamination, html_extract, language_id, neighbours, quality_rules, sharding, simhash,
    suffix_dedup, toxicity, url_filters, whitening,
)

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_html_extract": html_extract.query,
    "op3_url_filters": url_filters.query,
    "op4_sharding": sharding.query,
    "op5_toxicity": toxicity.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_quality_rules": quality_rules.query,
    "op8_simhash": simhash.query,
    "op9_decontamination": decontamination.query,
    "op10_language_id": language_id.query,
    "op11_nearest_neighbours": neighbours.query,
    "op12_whitening": whitening.query,
    "op13_collocations": collocations.query,
}
ORACLE = {
    "op3_url_filters": url_filters.ORACLE, "op9_decontamination": decontamination.ORACLE,
    "op11_nearest_neighbours": neighbours.ORACLE, "op13_collocations": collocations.ORACLE,
}
