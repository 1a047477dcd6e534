"""The registered queries of this package and their SQL."""

from __future__ import annotations

from .bpe import op9_bpe
from .idstore import op12_id_store
from .langid import op2_language
from .licenses import op1_licenses
from .licenses import oracle_sql as licenses_sql
from .media import op4_media
from .packing import op3_packing
from .passages import op10_passages
from .phrases import op13_phrases
from .phrases import oracle_sql as phrases_sql
from .pii import op7_pii
from .secrets import op5_secrets
from .simhash import op6_simhash
from .topk import op8_topk
from .vectorcodes import op11_vector_codes
from .vectorcodes import oracle_sql as vector_codes_sql

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_media": op4_media,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_topk": op8_topk,
    "op9_bpe": op9_bpe,
    "op10_passages": op10_passages,
    "op11_vector_codes": op11_vector_codes,
    "op12_id_store": op12_id_store,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses_sql(),
    "op11_vector_codes": vector_codes_sql(),
    "op13_phrases": phrases_sql(),
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
