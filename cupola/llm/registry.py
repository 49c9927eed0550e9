"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from cupola.llm import bpe, decontaminate, filteraudit, imatch, langid, nra, quality, revisit, secrets, simhash, tokenfile, toxicity, urlfilter

QUERIES = {
    "op1_tokens": tokenfile.op1_tokens,
    "op2_bpe": bpe.op2_bpe,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_revisit": revisit.op4_revisit,
    "op5_langid": langid.op5_langid,
    "op6_urlfilter": urlfilter.op6_urlfilter,
    "op7_secrets": secrets.op7_secrets,
    "op8_imatch": imatch.op8_imatch,
    "op9_quality": quality.op9_quality,
    "op10_simhash": simhash.op10_simhash,
    "op11_lexical": nra.op11_lexical,
    "op12_filteraudit": filteraudit.op12_filteraudit,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op4_revisit": revisit.OP4_SQL,
    "op8_imatch": imatch.OP8_SQL,
    "op6_urlfilter": urlfilter.OP6_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op11_lexical": nra.OP11_SQL,
    "op12_filteraudit": filteraudit.OP12_SQL,
}
