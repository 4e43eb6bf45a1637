"""The registered queries over text, pages and vectors, and their DuckDB counterparts."""

from __future__ import annotations

from . import licences, urls
from .bpe import op3_bpe
from .capjoin import op8_capjoin
from .decontam import op2_decontaminate
from .editcount import op6_editcount
from .langid import op9_langid
from .licences import op7_licences
from .neardup import op10_neardup
from .toxicity import op4_toxicity
from .urls import op1_urls
from .word_contexts import op5_pitman_yor

QUERIES = {
    "op1_urls": op1_urls,
    "op2_decontaminate": op2_decontaminate,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_editcount": op6_editcount,
    "op7_licences": op7_licences,
    "op8_capjoin": op8_capjoin,
    "op9_langid": op9_langid,
    "op10_neardup": op10_neardup,
}

ORACLES: dict[str, str] = {"op1_urls": urls.ORACLE, "op7_licences": licences.ORACLE}
