"""The corpus queries by name, and SQL for those that SQL can express."""
from __future__ import annotations

from .fingerprint import op1_fingerprint
from .sharding import op2_sharding
from .toxicity import op3_toxicity
from .secrets import op9_secrets
from .decontaminate import op10_decontaminate
from .packing import op8_packing
from .html_text import op5_html_text
from .quality import op7_quality
from .jaccard import op6_jaccard_join
from .stupid_backoff import ORACLE_SQL as OP4_SQL
from .stupid_backoff import op4_stupid_backoff
from .hard_negatives import ORACLE_SQL as OP11_SQL
from .hard_negatives import op11_hard_negatives
from .whitening import op12_whitening
from .line_dedup import ORACLE_SQL as OP13_SQL
from .line_dedup import op13_line_dedup

QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
    "op8_packing": op8_packing,
    "op5_html_text": op5_html_text,
    "op7_quality": op7_quality,
    "op6_jaccard_join": op6_jaccard_join,
    "op4_stupid_backoff": op4_stupid_backoff,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_stupid_backoff": OP4_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_line_dedup": OP13_SQL,
}
