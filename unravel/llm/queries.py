"""The registered queries of this subpackage and their SQL."""

from .decontaminate import op6_decontaminate
from .exact_index import OP11_SQL, op11_exact_index
from .lines import op8_line_dedup
from .minhash import op2_minhash
from .packing import op3_packing
from .phrases import OP13_SQL, op13_phrases
from .pii import op7_pii
from .quality import op1_host_quality
from .secrets import op4_secrets
from .spelling import op12_spelling
from .token_counts import op5_token_counts
from .token_files import op9_token_orc
from .toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_host_quality, op2_minhash, op3_packing, op4_secrets, op5_token_counts, op6_decontaminate, op7_pii, op8_line_dedup, op9_token_orc, op10_toxicity, op11_exact_index, op12_spelling, op13_phrases)}
SQL: dict[str, str] = {"op11_exact_index": OP11_SQL, "op13_phrases": OP13_SQL}
