"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe
from .edit_embedding import op5_edit_embedding
from .factorisation import op9_factorisation_machine
from .html_text import op4_html_extraction
from .license_scan import op12_license_scan
from .packing import op2_best_fit_packing
from .periodic_runs import op11_periodic_runs
from .prefix_trie import ORACLE_SQL as _OP13
from .prefix_trie import op13_prefix_trie
from .quality_rules import op3_quality_rules
from .secrets import op7_secret_scan
from .sharding import op8_sharding
from .simhash import op6_simhash_near_dedup
from .substring_dedup import op10_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_extraction": op4_html_extraction,
    "op5_edit_embedding": op5_edit_embedding,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_sharding": op8_sharding,
    "op9_factorisation_machine": op9_factorisation_machine,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

_OP10 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN cut ON w.doc_id = cut.doc_id
"""

#: Only op10 and op13 can be said in SQL; the tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {"op10_substring_dedup": _OP10, "op13_prefix_trie": _OP13}
