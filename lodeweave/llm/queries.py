"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, exact_dedup, filter_audit, langid, licenses, media, mixing, ngram_join, packing, pii, secrets, tokens, whitening

QUERIES = {
    f.__name__: f
    for f in (
        tokens.op1_token_counts,
        packing.op2_packing,
        exact_dedup.op3_exact_dedup,
        media.op4_media_columns,
        secrets.op5_secret_scan,
        pii.op6_pii,
        langid.op7_language_id,
        ngram_join.op8_ngram_join,
        mixing.op9_mixing,
        licenses.op10_license_scan,
        whitening.op11_whitening,
        decontamination.op12_decontamination,
        filter_audit.op13_filter_audit,
    )
}

SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_secret_scan": secrets.OP5_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_license_scan": licenses.OP10_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
