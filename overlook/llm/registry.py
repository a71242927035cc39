"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from overlook.llm import ann, chat, collocations, decontaminate, fim, langid, licenses, line_dedup, mixing, pii, simhash, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_langid": langid.op2_langid,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_licenses": licenses.op6_licenses,
    "op7_mixing": mixing.op7_mixing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_ann": ann.op9_ann,
    "op10_chat": chat.op10_chat,
    "op11_collocations": collocations.op11_collocations,
    "op12_pii": pii.op12_pii,
    "op13_fim": fim.op13_fim,
}

#: DuckDB SQL where it can express the query over whole tables.
SQL = {
    "op1_warc": warc.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op10_chat": chat.SQL,
    "op11_collocations": collocations.SQL,
    "op13_fim": fim.SQL,
}
