"""Registered queries of the operators and their SQL, where SQL can say it."""

from __future__ import annotations

from grainwise.llm import ann, bpe, chat, htmltext, langid, neardup, packing, pieces, pii, quality, spelling, suffixdedup, tokenalign

QUERIES = {
    "op9_ann": ann.query,
    "op1_pieces": pieces.query,
    "op7_htmltext": htmltext.query,
    "op2_suffixdedup": suffixdedup.query,
    "op6_neardup": neardup.query,
    "op3_langid": langid.query,
    "op4_pii": pii.query,
    "op10_quality": quality.query,
    "op5_packing": packing.query,
    "op8_chat": chat.query,
    "op11_bpe": bpe.query,
    "op12_tokenalign": tokenalign.query,
    "op13_spelling": spelling.query,
}
ORACLE = {
    "op8_chat": chat.ORACLE,
}
