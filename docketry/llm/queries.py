"""Queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from . import licenses, maxscore, media, mixing, packing, repeats, secrets, simhash, token_files, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_secrets": secrets.op2_secrets,
    "op3_maxscore": maxscore.op3_maxscore,
    "op4_token_ids": token_files.op4_token_ids,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_media": media.op6_media,
    "op7_simhash": simhash.op7_simhash,
    "op8_repeats": repeats.op8_repeats,
    "op9_licenses": licenses.op9_licenses,
    "op10_packing": packing.op10_packing,
}
ORACLES = {"op1_mixing": mixing.OP1_SQL, "op3_maxscore": maxscore.OP3_SQL}
