"""The queries of the corpus operators and, where SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

from fanloom.llm import decontaminate, grulm, htmlwrap, langid, lines, minhash, ngramjoin, pii, sentencepieces, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_sentencepiece": sentencepieces.op2_sentencepiece,
    "op3_pii": pii.op3_pii,
    "op4_language_id": langid.op4_language_id,
    "op5_line_dedup": lines.op5_line_dedup,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op9_ngram_join": ngramjoin.op9_ngram_join,
    "op6_html_wrappers": htmlwrap.op6_html_wrappers,
    "op10_gru_scores": grulm.op10_gru_scores,
    "op7_decontamination": decontaminate.op7_decontamination,
}
ORACLES = {
    "op5_line_dedup": lines.OP5_SQL,
    "op9_ngram_join": ngramjoin.OP9_CLASSES_SQL,
    "op8_warc_revisits": warc.OP8_SQL,
}
