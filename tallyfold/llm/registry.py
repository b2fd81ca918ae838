"""The corpus queries and their SQL."""

from tallyfold.llm import multiset_hash, packing, quality, secret_scan, simhash, sstable, substring_dedup, telephony, tiktoken_codec, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality": quality.op3_quality,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_tiktoken": tiktoken_codec.op5_tiktoken,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_simhash": simhash.op7_simhash,
    "op8_telephony": telephony.op8_telephony,
    "op9_sstable": sstable.op9_sstable,
    "op10_multiset_hash": multiset_hash.op10_multiset_hash,
}

ORACLE_SQL = {"op2_substring_dedup": substring_dedup.SQL}
