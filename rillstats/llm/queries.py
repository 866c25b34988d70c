"""The registered queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from .chat_format import OP8_SQL, op8_chat_format
from .decontamination import op1_decontamination
from .language_id import op6_language_id
from .license_scan import OP10_SQL, op10_license_scan
from .mixing import TARGETS_SQL, mix_targets, op3_mixing
from .near_dedup import OP2_SQL, op2_near_dedup
from .quality_rules import OP4_SQL, op4_quality_rules
from .quality_classifier import op9_quality_classifier
from .secret_scan import op7_secret_scan
from .token_counts import BYTES_SQL, op5_token_counts, token_bytes

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_near_dedup, op3_mixing, op4_quality_rules, op5_token_counts, op6_language_id, op7_secret_scan, op8_chat_format,
        op9_quality_classifier, op10_license_scan, mix_targets, token_bytes,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": OP2_SQL, "op4_quality_rules": OP4_SQL, "op8_chat_format": OP8_SQL, "op10_license_scan": OP10_SQL, "mix_targets": TARGETS_SQL, "token_bytes": BYTES_SQL,
}
