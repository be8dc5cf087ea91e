"""Registered queries of the corpus operators and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import chat, curriculum, decontaminate, deobfuscate, embedding_join, exact_copies, language, lattice, ngram_join, periodic_runs, quality, spelling, suffix_trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": embedding_join.op1_embedding_neardup,
    "op2_deobfuscate": deobfuscate.op2_deobfuscate,
    "op3_lattice": lattice.op3_lattice,
    "op4_suffix_trees": suffix_trees.op4_suffix_trees,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_curriculum_mix": curriculum.op6_curriculum_mix,
    "op7_string_kernel": language.op7_string_kernel,
    "op8_latent_leaks": decontaminate.op8_latent_leaks,
    "op9_weak_quality": quality.op9_weak_quality,
    "op10_chat_parts": chat.op10_chat_parts,
    "op11_exact_dedup": exact_copies.op11_exact_dedup,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op1_embedding_neardup": embedding_join.OP1_SQL,
    "op4_suffix_trees": suffix_trees.OP4_SQL,
    "op5_ngram_join": ngram_join.OP5_SQL,
    "op6_curriculum_mix": curriculum.OP6_SQL,
    "op10_chat_parts": chat.OP10_SQL,
    "op11_exact_dedup": exact_copies.OP11_SQL,
}
