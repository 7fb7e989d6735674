"""The registered queries of this subpackage: name -> function(spark, sf_dir)."""

from __future__ import annotations

from arbora.llm import boilerplate, bpe, codebooks, ctw, decontaminate, embeddings, language, lines, manifest, minhash, passages, quality, sharding


def queries() -> dict:
    return {
        "op1_quality": quality.query,
        "op4_product_quantisation": embeddings.query,
        "op5_sampled_splitters": sharding.query,
        "op6_context_tree": ctw.query,
        "op7_language_ppm": language.query,
        "op2_repeated_passages": passages.query,
        "op3_probminhash": minhash.query,
        "op8_main_text": boilerplate.query,
        "op9_byte_bpe": bpe.query,
        "op10_decontaminate": decontaminate.query,
        "op11_line_runs": lines.query,
        "op12_vector_codes": codebooks.query,
        "op13_merkle_manifest": manifest.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_line_runs": lines.SQL,
        "op12_vector_codes": codebooks.SQL,
        "op13_merkle_manifest": manifest.SQL,
    }
