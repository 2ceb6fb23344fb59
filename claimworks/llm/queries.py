"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from . import importance, infill, mixing, quality
from .bpe import op7_bpe
from .html import op8_html
from .importance import op12_importance
from .infill import op11_infill
from .language import op2_language
from .lm import op9_lm
from .media import op10_media
from .mixing import op4_mixing
from .phrases import op5_phrases
from .quality import op3_quality
from .simhash import op6_simhash
from .toxicity import op1_toxicity
from .wordbpe import op13_wordbpe

QUERIES = {"op1_toxicity": op1_toxicity, "op2_language": op2_language, "op3_quality": op3_quality, "op4_mixing": op4_mixing, "op5_phrases": op5_phrases, "op6_simhash": op6_simhash, "op7_bpe": op7_bpe, "op8_html": op8_html, "op9_lm": op9_lm, "op10_media": op10_media, "op11_infill": op11_infill, "op12_importance": op12_importance, "op13_wordbpe": op13_wordbpe}

ORACLES: dict[str, str] = {"op3_quality": quality.ORACLE, "op4_mixing": mixing.ORACLE, "op11_infill": infill.ORACLE, "op12_importance": importance.ORACLE}
