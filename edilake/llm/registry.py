"""The corpus operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from .gif import op8_media_gif
from .jaccard import op5_ngram_jaccard
from .lang_id import op4_language_id
from .line_dedup import op7_line_dedup
from .mixing import op10_source_mixing
from .mixing import oracle as _mixing_sql
from .packing import op6_best_fit_packing
from .quality import op3_quality
from .simple8b import op2_token_ids
from .topk import ORACLE as _topk_sql
from .topk import op9_exact_topk
from .toxicity import op1_toxicity

ALL = (op1_toxicity, op2_token_ids, op3_quality, op4_language_id, op5_ngram_jaccard, op6_best_fit_packing, op7_line_dedup, op8_media_gif, op9_exact_topk, op10_source_mixing)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op10_source_mixing": _mixing_sql(), "op9_exact_topk": _topk_sql}
