"""The registered queries of this subpackage and their SQL."""

from . import exact_dedup, html_extract, mixing, ngram_jaccard, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_quality_classifier": quality_classifier.op2,
    "op3_mixing": mixing.op3,
    "op4_ngram_jaccard": ngram_jaccard.op4,
    "op5_html_extraction": html_extract.op5,
    "op6_quality_rules": quality_rules.op6,
    "op7_warc": warc.op7,
    "op8_secret_scan": secret_scan.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_packing": packing.op10,
}
ORACLE_SQL = {
    "op3_mixing": mixing.SQL,
    "op4_ngram_jaccard": ngram_jaccard.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op7_warc": warc.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
