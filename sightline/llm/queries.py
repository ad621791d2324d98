"""The registered queries of this subpackage and their SQL; each runs over its whole tables."""

from __future__ import annotations

from sightline.llm import exact_dedup, html_extract, langid, ngram_join, packing, pii, prefix_trie, quality_classifier, quality_rules, sentencepiece_fst, structure_repair, suffix_dedup, url_filters
from sightline.llm.common import read


def op1_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return sentencepiece_fst.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return quality_classifier.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))


def op6_url_filters(spark, sf_dir):
    return url_filters.judge(read(spark, sf_dir, "pages"))


def op7_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(*packing.PACKED)


def op8_pii(spark, sf_dir):
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return langid.language_id(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


def op12_structure_repair(spark, sf_dir):
    return structure_repair.repaired_damage(read(spark, sf_dir, "conversations"))


def op13_html_extract(spark, sf_dir):
    return html_extract.extract(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_ngram_join, op3_quality_rules, op4_quality_classifier, op5_suffix_dedup, op6_url_filters, op7_packing, op8_pii, op9_language_id, op10_exact_dedup,
    op11_prefix_trie, op12_structure_repair, op13_html_extract,
)}

ORACLES = {
    "op6_url_filters": url_filters.oracle(),
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
WINDOW w AS (PARTITION BY t)""",
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_structure_repair": structure_repair.ORACLE,
}
