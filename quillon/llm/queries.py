"""The queries of this package, and their SQL where there is one."""

from __future__ import annotations

from .attribution import op4_token_counts
from .decontaminate import OP2_SQL, op2_decontamination
from .exact import OP5_SQL, op5_exact_dedup
from .html import op7_html_extraction
from .linededup import op9_line_dedup
from .lm import op8_lm_scoring
from .neardup import op1_minhash_neardup
from .order import op10_token_output
from .packing import op6_best_fit_packing
from .toxicity import op3_toxicity


def queries() -> dict:
    return {f.__name__: f for f in (op1_minhash_neardup, op2_decontamination, op3_toxicity, op4_token_counts, op5_exact_dedup, op6_best_fit_packing, op7_html_extraction, op8_lm_scoring, op9_line_dedup, op10_token_output)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op5_exact_dedup": OP5_SQL}
