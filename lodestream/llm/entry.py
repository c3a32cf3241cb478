"""The queries of this subpackage and the SQL that gives the same results, where there is one."""

from __future__ import annotations

from lodestream.llm.byte_bpe import op8_byte_bpe
from lodestream.llm.factorisation import op7_quality_classifier
from lodestream.llm.html_text import op3_html_extraction
from lodestream.llm.line_dedup import ORACLE as LINE_DEDUP_SQL
from lodestream.llm.line_dedup import op10_line_dedup
from lodestream.llm.minhash import ORACLE as MINHASH_SQL
from lodestream.llm.minhash import op13_minhash_near_dedup
from lodestream.llm.packing import op4_best_fit_packing
from lodestream.llm.periodic_runs import ORACLE as PERIODIC_RUNS_SQL
from lodestream.llm.periodic_runs import op12_periodic_runs
from lodestream.llm.pii import op6_pii_surrogates
from lodestream.llm.quality_rules import op1_quality_rules
from lodestream.llm.simhash import ORACLE as SIMHASH_SQL
from lodestream.llm.simhash import op2_simhash_near_dedup
from lodestream.llm.top_k import ORACLE as TOP_K_SQL
from lodestream.llm.top_k import op5_exact_top_k
from lodestream.llm.vector_codes import ORACLE as VECTOR_CODES_SQL
from lodestream.llm.vector_codes import op11_vector_codes
from lodestream.llm.warc import ORACLE as WARC_SQL
from lodestream.llm.warc import op9_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_warc": op9_warc,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op2_simhash_near_dedup": SIMHASH_SQL,
    "op5_exact_top_k": TOP_K_SQL,
    "op9_warc": WARC_SQL,
    "op10_line_dedup": LINE_DEDUP_SQL,
    "op11_vector_codes": VECTOR_CODES_SQL,
    "op12_periodic_runs": PERIODIC_RUNS_SQL,
    "op13_minhash_near_dedup": MINHASH_SQL,
}
