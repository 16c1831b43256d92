"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .bpe import op5_bpe
from .decontamination import SQL as LEAKS_SQL
from .decontamination import op8_decontamination
from .pii import op7_pii
from .quality_cnn import op9_quality_classifier
from .quality_rules import op4_quality_rules
from .secrets import op10_secret_scan
from .simhash_dedup import op3_simhash_dedup
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_substring_dedup, op3_simhash_dedup, op4_quality_rules, op5_bpe, op6_toxicity, op7_pii, op8_decontamination, op9_quality_classifier, op10_secret_scan)}

#: Bytes as two hexadecimal digits each, so that positions are bytes.
SUFFIX_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT r, unnest(range(0, len(h) // 2 - 199)) AS p, h FROM d WHERE len(h) >= 400),
k AS (SELECT r, p, md5_number(substr(h, 2 * p + 1, 400)) AS k FROM w),
hit AS (SELECT r, p FROM k JOIN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) USING (k)),
isl AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 200 OR lag(p) OVER (PARTITION BY r ORDER BY p) IS NULL THEN 1 ELSE 0 END AS b FROM hit),
num AS (SELECT r, p, sum(b) OVER (PARTITION BY r ORDER BY p) AS g FROM isl),
spans AS (SELECT r, g, min(p) AS s, max(p) + 200 AS e FROM num GROUP BY r, g),
cut AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS f FROM spans),
kept AS (SELECT r, count(*) AS n_spans, sum(e - s) AS gone, max(e) AS last, string_agg(substr(h, 2 * f + 1, 2 * (s - f)), '' ORDER BY s) AS k FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN k IS NULL THEN h ELSE k || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS i, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, i, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
k AS (SELECT r, i, p, md5_number(array_to_string(w[p:p + 19], ' ')) AS k FROM s),
o AS (SELECT k, min((i, p)) AS o FROM k GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p FROM k JOIN o USING (k) WHERE (i, p) > o),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS q FROM hit),
g AS (SELECT r, list(q) AS q, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN q IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(q, x)), lambda x: w[x]), ' ') END) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""

ORACLE = {"op1_suffix_dedup": SUFFIX_SQL, "op2_substring_dedup": SUBSTRING_SQL, "op8_decontamination": LEAKS_SQL}
