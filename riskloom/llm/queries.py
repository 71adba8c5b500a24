"""The registered queries of the text operators and their SQL."""

from . import decontaminate, mixing, ngram_join, prefix_trie, quality_rules, repeats, secrets, site_quality, token_orc, toxicity, url_filter, warc_zip, whitening

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_warc_zip": warc_zip.op2_warc_zip,
    "op3_suffix_dedup": repeats.op3_suffix_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_token_orc": token_orc.op5_token_orc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_quality_classifier": site_quality.op10_quality_classifier,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_whitening": whitening.op13_whitening,
}

SQL = {
    "op1_ngram_jaccard_join": ngram_join.SQL,
    "op2_warc_zip": warc_zip.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op7_secret_scan": secrets.SQL,
    "op8_mixing": mixing.SQL,
    "op12_url_filter": url_filter.SQL,
}
