"""The queries of this subpackage, and their SQL where SQL can express them."""

from .bpe import op6_bpe
from .decontam import OP8_SQL, op8_decontamination
from .jaccard import OP5_SQL, op5_jaccard_join
from .langid import op10_language_id
from .linededup import OP2_SQL, op2_line_dedup
from .substring import OP4_SQL, op4_substring_dedup
from .suffixes import op9_suffix_dedup
from .tokenfile import op1_token_ids
from .topk import OP3_SQL, op3_topk
from .urlfilter import OP7_SQL, op7_url_filters

QUERIES = {f.__name__: f for f in (op1_token_ids, op2_line_dedup, op3_topk, op4_substring_dedup, op5_jaccard_join, op6_bpe, op7_url_filters, op8_decontamination, op9_suffix_dedup, op10_language_id)}
SQL = {"op2_line_dedup": OP2_SQL, "op3_topk": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_jaccard_join": OP5_SQL, "op7_url_filters": OP7_SQL, "op8_decontamination": OP8_SQL}
