"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from .chat import OP11_SQL, op11_chat_formatting
from .decontaminate import op7_decontamination
from .line_dedup import op1_line_dedup
from .manifest import OP13_SQL, op13_merkle_manifest
from .near_dedup import op8_near_dedup
from .packing import op10_packing
from .repeated_spans import op9_repeated_spans
from .repetition import op5_quality_rules
from .sharding import op3_sharding
from .site_quality import op4_quality_classifier
from .token_counts import op2_token_counts
from .warc import OP6_SQL, op6_warc
from .whitening import op12_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_sharding, op4_quality_classifier, op5_quality_rules, op6_warc, op7_decontamination, op8_near_dedup, op9_repeated_spans, op10_packing, op11_chat_formatting, op12_embedding_whitening, op13_merkle_manifest)}
SQL: dict[str, str] = {"op6_warc": OP6_SQL, "op11_chat_formatting": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
