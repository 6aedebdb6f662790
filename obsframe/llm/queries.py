"""Queries of the operators. None of their methods can be put in SQL; tests hold them against brute force."""

from __future__ import annotations

from obsframe.llm import (
    alignment, decontam, fingerprints, langid, linededup, mixing, neardup, prefixtrie, quality, repeats, surrogates, tokenfiles, toxicity)

QUERIES = {
    "op1_winnow": fingerprints.op1_winnow,
    "op2_surrogates": surrogates.op2_surrogates,
    "op3_repeats": repeats.op3_repeats,
    "op4_token_files": tokenfiles.op4_token_files,
    "op5_minhash": neardup.op5_minhash,
    "op6_language": langid.op6_language,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality": quality.op8_quality,
    "op9_decontaminate": decontam.op9_decontaminate,
    "op10_fuzzy_lines": linededup.op10_fuzzy_lines,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_alignment": alignment.op12_alignment,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
}
ORACLES: dict[str, str] = {}
