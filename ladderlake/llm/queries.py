"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import byte_bpe, chat, infill, katz, langid, licenses, merkle, mixing, pieces, quality, simhash, topk, trie

QUERIES = {f.__name__: f for f in (langid.op1_language_id, topk.op2_topk, licenses.op3_licenses, pieces.op4_sentencepiece, mixing.op5_mixing, simhash.op6_simhash, chat.op7_chat, quality.op8_quality, merkle.op9_fingerprints, katz.op10_katz, infill.op11_infill, trie.op12_trie, byte_bpe.op13_byte_bpe)}
ORACLES = {"op2_topk": topk.OP2_SQL, "op3_licenses": licenses.OP3_SQL, "op11_infill": infill.OP11_SQL}
