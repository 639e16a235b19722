"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import align, ann, bpe, chat, decontaminate, katz, line_dedup, main_text, ranked, simhash, suffix, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_suffix": suffix.op2_suffix,
    "op3_ann": ann.op3_ann,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_bpe": bpe.op5_bpe,
    "op6_simhash": simhash.op6_simhash,
    "op7_warc": warc.op7_warc,
    "op8_katz": katz.op8_katz,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_chat": chat.op10_chat,
    "op11_align": align.op11_align,
    "op12_html": main_text.op12_html,
    "op13_ranked": ranked.op13_ranked,
}
ORACLES = {**line_dedup.ORACLE, **warc.ORACLE, **decontaminate.ORACLE, **ranked.ORACLE}
