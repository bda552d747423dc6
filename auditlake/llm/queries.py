"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import sql
from .chat import op9_chat_formatting
from .collocations import op11_collocations
from .decontaminate import op3_decontamination
from .fill_middle import op12_fill_in_middle
from .jaccard import op7_ngram_jaccard
from .language import op5_language_id
from .licenses import op2_license_scan
from .neighbours import op13_nearest_neighbours
from .packing import op1_best_fit_packing
from .quality import op6_quality_rules
from .scoring import op10_lm_scoring
from .token_binary import op8_token_binary
from .token_counts import op4_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_license_scan,
        op3_decontamination,
        op4_token_counts,
        op5_language_id,
        op6_quality_rules,
        op7_ngram_jaccard,
        op8_token_binary,
        op9_chat_formatting,
        op10_lm_scoring,
        op11_collocations,
        op12_fill_in_middle,
        op13_nearest_neighbours,
    )
}
#: SQL where it can express the result; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = dict(sql.ORACLES)
