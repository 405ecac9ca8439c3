"""The queries of this subpackage and their SQL where it can express them."""

from __future__ import annotations

from . import chat, digests, langid, mixing, pieces, quality, secrets, simhash, substrings, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": quality.op2_quality,
    "quality_ablation": quality.quality_ablation,
    "op3_mixing": mixing.op3_mixing,
    "op4_fingerprints": digests.op4_fingerprints,
    "op5_substrings": substrings.op5_substrings,
    "substrings_reference": substrings.substrings_reference,
    "op6_urls": urls.op6_urls,
    "op7_pieces": pieces.op7_pieces,
    "op8_langid": langid.op8_langid,
    "op9_chat": chat.op9_chat,
    "op10_secrets": secrets.op10_secrets,
}

ORACLES: dict[str, str] = {
    "op2_quality": quality.OP2_SQL,
    "quality_ablation": quality.ABLATION_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "substrings_reference": substrings.REFERENCE_SQL,
    "op9_chat": chat.OP9_SQL,
}
