"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, langid, quality, secrets, sentencepiece_codec, simhash, spelling_variants, substring_dedup, suffix_dedup, token_alignment, token_counts, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_simhash": simhash.op2_simhash,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_quality": quality.op6_quality,
        "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_warc": warc.op9_warc,
        "op10_language_id": langid.op10_language_id,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_substring_dedup": substring_dedup.op12_substring_dedup,
        "op13_spelling_variants": spelling_variants.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    digits = "'0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    base32 = " || ".join(f"translate(lpad(upper(to_base(('0x' || substr(h, {1 + 10 * i}, 10))::BIGINT, 32)), 8, '0'), {digits})" for i in range(4))
    return {
        "op4_embedding_dedup": """
            WITH RECURSIVE v AS (
                SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
            ok AS (
                SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
            links AS (
                SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
            reached AS (
                SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
            named AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY 1)
            SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM named""",
        "op9_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
            SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {base32} AS payload_digest,
                CASE WHEN page_id IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id <> first THEN first END AS refers_to
            FROM f""",
        "op12_substring_dedup": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w),
            k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM s),
            f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM k),
            g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE first < doc_id),
            r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
            e AS (SELECT w.doc_id, w, coalesce(gone, []::BIGINT[]) AS gone FROM w LEFT JOIN r USING (doc_id))
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
                sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
            FROM e""",
    }
