"""Queries and oracle SQL of the training-data operators, for the entry module."""

from __future__ import annotations

from tidewell.llm import audit, brown, decontaminate, flatgraph, impact, language, licenses, mixing, pages, pairwise, repeats, secrets, simhash

QUERIES = {
    "op1_brown": brown.op1_brown,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_language": language.op3_language,
    "op4_flatgraph": flatgraph.op4_flatgraph,
    "op5_repeats": repeats.op5_repeats,
    "op6_secrets": secrets.op6_secrets,
    "op7_simhash": simhash.op7_simhash,
    "op8_licenses": licenses.op8_licenses,
    "op9_pages": pages.op9_pages,
    "op10_mixing": mixing.op10_mixing,
    "op11_pairwise": pairwise.op11_pairwise,
    "op12_search": impact.op12_search,
    "op13_audit": audit.op13_audit,
}

ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op4_flatgraph": flatgraph.ORACLE,
    "op5_repeats": repeats.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_search": impact.ORACLE,
    "op13_audit": audit.ORACLE,
}
