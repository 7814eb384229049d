"""The queries of this subpackage and their SQL; __spark_entry__.py adds them to the library's own."""

from __future__ import annotations

from trailspark.llm import bpe, decontaminate, jaccard, langid, lexical, prefixtrie, quality, secrets, suffixdedup, tokencount, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_jaccard": jaccard.op1_jaccard,
        "op2_langid": langid.op2_langid,
        "op3_suffixdedup": suffixdedup.op3_suffixdedup,
        "op4_warc": warc.op4_warc,
        "op5_bpe": bpe.op5_bpe,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_topk": topk.op7_topk,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_tokencount": tokencount.op9_tokencount,
        "op10_secrets": secrets.op10_secrets,
        "op11_quality": quality.op11_quality,
        "op12_prefixtrie": prefixtrie.op12_prefixtrie,
        "op13_lexical": lexical.op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": warc.OP4_SQL,
        "op6_decontaminate": decontaminate.OP6_SQL,
        "op7_topk": topk.OP7_SQL,
        "op12_prefixtrie": prefixtrie.OP12_SQL,
        "op13_lexical": lexical.OP13_SQL,
    }
