"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from panelweft.llm.bpe import op3_bpe
from panelweft.llm.conversation import ORACLE as OP12
from panelweft.llm.conversation import op12_conversations
from panelweft.llm.decontaminate import ORACLE as OP2
from panelweft.llm.decontaminate import op2_decontaminate
from panelweft.llm.fingerprint import op9_fingerprint
from panelweft.llm.language import op6_language
from panelweft.llm.neardup import op7_minhash
from panelweft.llm.pii import op5_pii
from panelweft.llm.quality import ORACLE as OP13
from panelweft.llm.quality import op13_quality
from panelweft.llm.resample import ORACLE as OP11
from panelweft.llm.resample import op11_resample
from panelweft.llm.sstable import op8_sstable
from panelweft.llm.substrings import op1_substrings
from panelweft.llm.toxicity import op10_toxicity
from panelweft.llm.warc import op4_warc

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_decontaminate": op2_decontaminate,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_language": op6_language,
    "op7_minhash": op7_minhash,
    "op8_sstable": op8_sstable,
    "op9_fingerprint": op9_fingerprint,
    "op10_toxicity": op10_toxicity,
    "op11_resample": op11_resample,
    "op12_conversations": op12_conversations,
    "op13_quality": op13_quality,
}

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
word AS (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS most FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> most THEN most END AS refers_to
FROM h
"""
OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_ AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, m) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""
ORACLES = {"op1_substrings": OP1, "op2_decontaminate": OP2, "op4_warc": OP4, "op7_minhash": OP7, "op11_resample": OP11, "op12_conversations": OP12, "op13_quality": OP13}
