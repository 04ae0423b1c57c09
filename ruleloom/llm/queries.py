"""The registered queries of these operators, and the SQL of those that SQL can express."""

from ruleloom.llm import bm25, exact, fim, fptree, jaccard, langid, lm, mixing, phrases, pieces, tokenfile, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_language_id": langid.op2,
    "op3_sentencepiece": pieces.op3,
    "op4_ngram_jaccard": jaccard.op4,
    "op5_language_model": lm.op5,
    "op6_repeated_passages": phrases.op6,
    "op7_exact_dedup": exact.op7,
    "op8_token_file": tokenfile.op8,
    "op9_toxicity": toxicity.op9,
    "op10_exact_search": bm25.op10,
    "op11_fill_in_middle": fim.op11,
    "op12_warc_revisits": warc.op12,
    "op13_ranked_search": fptree.op13,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.SQL,
    "op7_exact_dedup": exact.SQL,
    "op11_fill_in_middle": fim.SQL,
    "op12_warc_revisits": warc.SQL,
    "op13_ranked_search": fptree.SQL,
}
