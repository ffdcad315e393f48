"""The training-data queries, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import collocations, decontaminate, dialogues, licenses, lmscore, neighbours, packing, quality, recipes, repeats, secrets, sharding, simhash

QUERIES = {
    "op1_lm_scoring": lmscore.op1_lm_scoring,
    "op2_packing": packing.op2_packing,
    "op3_nearest_neighbours": neighbours.op3_nearest_neighbours,
    "op4_sharding": sharding.op4_sharding,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_suffix_dedup": repeats.op7_suffix_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_secrets": secrets.op10_secrets,
    "op11_collocations": collocations.op11_collocations,
    "op12_exact_dedup": recipes.op12_exact_dedup,
    "op13_conversation_repair": dialogues.op13_conversation_repair,
}
ORACLES = {"op5_decontamination": decontaminate.ORACLE, "op12_exact_dedup": recipes.ORACLE,
           "op13_conversation_repair": dialogues.ORACLE, "op11_collocations": collocations.ORACLE}
