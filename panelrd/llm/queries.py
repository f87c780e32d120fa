"""Registered queries of the subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from panelrd.llm import fingerprints, html_extract, langid, lexical_search, line_dedup, minhash, mixing, neighbours, packing, spelling, substring_dedup, suffix_dedup, toxicity
from panelrd.llm.common import table


def _over(name: str, operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES = {
    "op1_suffix_dedup": _over("documents", suffix_dedup.op1_suffix_dedup),
    "op4_best_fit_packing": _over("documents", packing.op4_best_fit_packing),
    "op2_edit_fingerprints": _over("documents", fingerprints.op2_edit_fingerprints),
    "op3_minhash_dedup": _over("documents", minhash.op3_minhash_dedup),
    "op5_substring_dedup": _over("documents", substring_dedup.op5_substring_dedup),
    "op6_line_dedup": _over("documents", line_dedup.op6_line_dedup),
    "op7_toxicity": lambda spark, sf_dir: toxicity.op7_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op8_language_id": _over("documents", langid.op8_language_id),
    "op9_nearest_neighbours": _over("embeddings", neighbours.op9_nearest_neighbours),
    "op10_mix_sources": _over("documents", mixing.op10_mix_sources),
    "op11_html_extraction": _over("pages", html_extract.op11_html_extraction),
    "op12_spelling_variants": _over("documents", spelling.op12_spelling_variants),
    "op13_ranked_search": lambda spark, sf_dir: lexical_search.op13_ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}

SQL = {"op10_mix_sources": mixing.OP10_SQL, "op12_spelling_variants": spelling.OP12_SQL, "op13_ranked_search": lexical_search.OP13_SQL}
