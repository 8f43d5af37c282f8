"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from loomsight.llm import alignment, bpe, chat, divergence, fixity, langid, lexical, minhash, ordinal, suffix, suffixtree, templates, wavelet


def _pipeline(spark, sf_dir):
    # the root module is looked for when it runs, so that the package can be imported from elsewhere
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_merkle_fixity": fixity.query,
        "op2_suffix_dedup": suffix.query,
        "op3_langid": langid.query,
        "op4_minhash_forest": minhash.query,
        "op5_divergence": divergence.query,
        "op6_templates": templates.query,
        "op7_ordinal": ordinal.query,
        "op8_wavelet": wavelet.query,
        "op9_chat_format": chat.query,
        "op10_bpe": bpe.query,
        "op11_block_max_wand": lexical.query,
        "op12_alignment": alignment.query,
        "op13_suffix_tree": suffixtree.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_merkle_fixity": fixity.SQL, "op9_chat_format": chat.SQL, "op11_block_max_wand": lexical.SQL}
