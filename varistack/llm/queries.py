"""The registered queries of this subpackage and their SQL."""

from varistack.llm.decontaminate import op5_decontaminate
from varistack.llm.importance import ORACLE as OP13_SQL
from varistack.llm.importance import op13_importance_resampling
from varistack.llm.infilling import ORACLE as OP11_SQL
from varistack.llm.infilling import op11_fill_in_middle
from varistack.llm.langid import op8_language_id
from varistack.llm.packing import op10_best_fit_packing
from varistack.llm.pieces import op12_sentencepiece
from varistack.llm.search import op1_bm25_topk
from varistack.llm.secrets import ORACLE as OP4_SQL
from varistack.llm.secrets import op4_secret_scan
from varistack.llm.simhash import op2_simhash
from varistack.llm.suffix_dedup import op7_suffix_dedup
from varistack.llm.toxicity import op3_toxicity
from varistack.llm.urlfilter import op6_url_filter
from varistack.llm.warc import ORACLE as OP9_SQL
from varistack.llm.warc import op9_warc

QUERIES = {
    "op1_bm25_topk": op1_bm25_topk,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op4_secret_scan": OP4_SQL,
    "op9_warc": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_importance_resampling": OP13_SQL,
}
