"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from .decontamination import OP7_SQL, op7_decontamination
from .edit_counts import op8_edit_counts
from .license_scan import op3_license_scan
from .near_dedup import op10_bagminhash
from .periodic_runs import op13_periodic_runs
from .quality_rules import op1_quality_rules
from .sentencepiece_codec import op5_sentencepiece
from .sharding import op6_sharding
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .token_files import op4_token_files
from .toxicity import op9_toxicity
from .url_filter import OP11_SQL, op11_url_filter
from .whitening import op12_whitening

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_token_files": op4_token_files,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_edit_counts": op8_edit_counts,
    "op9_toxicity": op9_toxicity,
    "op10_bagminhash": op10_bagminhash,
    "op11_url_filter": op11_url_filter,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL = {
    "op2_substring_dedup": OP2_SQL,
    "op7_decontamination": OP7_SQL,
    "op11_url_filter": OP11_SQL,
}
