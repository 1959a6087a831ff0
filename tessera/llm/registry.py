"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm.ann import op4_ann
from tessera.llm.bpe import op6_bpe
from tessera.llm.centroids import OP11_SQL, op11_centroids
from tessera.llm.exact_topk import OP8_SQL, op8_exact_topk
from tessera.llm.fingerprints import op13_fingerprints
from tessera.llm.importance import op12_importance
from tessera.llm.lang_id import op7_language_id, pages_language_id
from tessera.llm.license_scan import OP1_SQL, op1_license_scan
from tessera.llm.line_dedup import OP2_SQL, op2_line_dedup
from tessera.llm.packing import op5_packing
from tessera.llm.quality import op9_quality
from tessera.llm.simhash import op3_simhash
from tessera.llm.token_shards import op10_token_shards

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_ann": op4_ann,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_language_id": op7_language_id,
    "pages_language_id": pages_language_id,
    "op8_exact_topk": op8_exact_topk,
    "op9_quality": op9_quality,
    "op10_token_shards": op10_token_shards,
    "op11_centroids": op11_centroids,
    "op12_importance": op12_importance,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op8_exact_topk": OP8_SQL,
    "op11_centroids": OP11_SQL,
}
