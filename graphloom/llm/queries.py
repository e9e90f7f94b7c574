"""The subpackage's queries, with DuckDB SQL where SQL expresses them."""

from .chat import OP4_SQL, op4_chat_formatting
from .decontaminate import OP1_SQL, op1_decontamination
from .dedup import OP10_SQL, op10_exact_dedup
from .jaccard import OP7_SQL, op7_ngram_jaccard, op7_ngram_jaccard_links
from .language import op5_language_id
from .mixing import OP2_SQL, op2_mixing
from .pages import op3_html_extraction
from .quality import op6_quality_classifier
from .secrets import op9_secret_scan
from .sharding import OP8_SQL, op8_sharding

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op7_ngram_jaccard_links": op7_ngram_jaccard_links,
    "op8_sharding": op8_sharding,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op8_sharding": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
}
