"""The registered queries of this subpackage and their SQL, where SQL can say it."""

from quire.llm import (bpe, divergence, exact_dedup, language, line_dedup, mixing, periods, quality, sharding,
                       simhash, suffix_dedup, topk, warc)

QUERIES = {
    "op1_bpe": bpe.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_topk": topk.op3,
    "op4_language": language.op4,
    "op5_suffix_dedup": suffix_dedup.op5,
    "op6_quality_rules": quality.op6,
    "op7_sharding": sharding.op7,
    "op8_warc": warc.op8,
    "op9_mixing": mixing.op9,
    "op10_simhash": simhash.op10,
    "op11_periods": periods.op11,
    "op12_exact_dedup": exact_dedup.op12,
    "op13_divergence": divergence.op13,
}

ORACLE = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_topk": topk.OP3_SQL,
    "op8_warc": warc.OP8_SQL,
    "op12_exact_dedup": exact_dedup.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
