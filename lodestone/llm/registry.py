"""The queries of this package by name, and SQL for those that it can express."""

from __future__ import annotations

from lodestone.llm import html_text, jaccard, langid, lines, merkle, mixing, packing, passages, suffixes, tiff, topk, trie, warc

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op2_tiff": tiff.op2_tiff,
    "op3_langid": langid.op3_langid,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_warc": warc.op5_warc,
    "op6_passages": passages.op6_passages,
    "op7_html": html_text.op7_html,
    "op8_packing": packing.op8_packing,
    "op9_mixing": mixing.op9_mixing,
    "op10_topk": topk.op10_topk,
    "op11_trie": trie.op11_trie,
    "op12_suffixes": suffixes.op12_suffixes,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {
    "op1_lines": lines.SQL,
    "op4_jaccard": jaccard.SQL,
    "op5_warc": warc.SQL,
    "op10_topk": topk.SQL,
    "op11_trie": trie.SQL,
    "op12_suffixes": suffixes.SQL,
    "op13_merkle": merkle.SQL,
}
