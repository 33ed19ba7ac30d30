"""The corpus operators' entries for the driver: queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, langid, licenses, media, mixing, pii, quality, simhash, tokenstore

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_preference": chat.op2_preference,
    "op3_quality": quality.op3_quality,
    "op4_simhash": simhash.op4_simhash,
    "op5_language": langid.op5_language,
    "op6_licenses": licenses.op6_licenses,
    "op7_mix": mixing.op7_mix,
    "op8_pii": pii.op8_pii,
    "op9_media": media.op9_media,
    "op10_token_store": tokenstore.op10_token_store,
}

ORACLES = {
    "op1_decontaminate": decontam.OP1_SQL,
    "op2_preference": chat.OP2_SQL,
    "op6_licenses": licenses.OP6_SQL,
}
