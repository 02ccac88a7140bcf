"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from quaylark.llm import chat, decontaminate, jaccard_join, substring_dedup
from quaylark.llm.bpe import op1_bpe
from quaylark.llm.chat import op2_chat_format
from quaylark.llm.decontaminate import op5_decontaminate
from quaylark.llm.fingerprint import op4_fingerprint
from quaylark.llm.html_extract import op6_html_extract
from quaylark.llm.jaccard_join import op9_jaccard_join
from quaylark.llm.language import op8_language_id
from quaylark.llm.secrets import op3_secrets
from quaylark.llm.substring_dedup import op10_substring_dedup
from quaylark.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_bpe, op2_chat_format, op3_secrets, op4_fingerprint, op5_decontaminate, op6_html_extract, op7_toxicity, op8_language_id, op9_jaccard_join, op10_substring_dedup)}
ORACLES: dict[str, str] = {"op2_chat_format": chat.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE, "op10_substring_dedup": substring_dedup.ORACLE}
