"""The queries of this folder for the driver, and the SQL that states their results."""

from __future__ import annotations

from . import oracles
from .decontaminate import op9_decontaminate
from .lm_filter import op12_lm_scores
from .minhash import op1_minhash_dedup
from .mixing import op8_source_mixing
from .quality_model import op2_quality_fm
from .quality_rules import op5_quality_rules
from .quote_links import op3_quote_links
from .secrets import op7_secret_scan
from .suffix_dedup import op4_suffix_dedup
from .tokens import op10_token_output
from .url_model import op6_url_filter
from .whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (
    op1_minhash_dedup, op2_quality_fm, op3_quote_links, op4_suffix_dedup, op5_quality_rules, op6_url_filter, op7_secret_scan, op8_source_mixing, op9_decontaminate, op10_token_output,
    op11_embedding_whitening, op12_lm_scores,
)}

SQL = {"op3_quote_links": oracles.quote_links, "op5_quality_rules": oracles.quality_rules, "op8_source_mixing": oracles.source_mixing, "op9_decontaminate": oracles.decontaminate}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in SQL.items()}
