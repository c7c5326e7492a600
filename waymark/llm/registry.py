"""The operators' queries and the SQL that the driver can hold against them."""

from __future__ import annotations

from . import bpe, fim, itq, lm, minhash, mixing, ogg, pii, pointintime, quality, secrets, toxicity, winnow

QUERIES = {
    "op1_lm_score": lm.op1_lm_score,
    "op2_mixing": mixing.op2_mixing,
    "op3_pii": pii.op3_pii,
    "op4_ogg": ogg.op4_ogg,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_itq": itq.op6_itq,
    "op7_secrets": secrets.op7_secrets,
    "op8_minhash": minhash.op8_minhash,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
    "op11_winnow": winnow.op11_winnow,
    "op12_fim": fim.op12_fim,
    "op13_point_in_time": pointintime.op13_point_in_time,
}

ORACLES = {"op2_mixing": mixing.ORACLE, "op11_winnow": winnow.ORACLE, "op12_fim": fim.ORACLE, "op13_point_in_time": pointintime.ORACLE}
