"""The queries of this folder, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import quality as _quality
from .bpe import encode_digests
from .collocations import ORACLE as _COLLOCATIONS
from .collocations import collocations
from .common import materialise, read_table
from .conversations import repair_conversations
from .html_text import extract_pages
from .media import media_features, to_media
from .neighbours import ORACLE as _NEIGHBOURS
from .neighbours import nearest_neighbours
from .ngram_join import similar_groups
from .packing import pack_documents
from .secrets import find_secrets
from .suffix_dedup import remove_repeats
from .toxicity import toxic_scores
from .warc import archive_pages


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_warc(spark, sf_dir):
    return archive_pages(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "segment", "offset", "length", "range", "place")


def op3_quality_rules(spark, sf_dir):
    return _quality.quality(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secret_scans(spark, sf_dir):
    return find_secrets(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark, sf_dir):
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark, sf_dir):
    return similar_groups(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxic_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_bpe_transducer(spark, sf_dir):
    return encode_digests(read_table(spark, sf_dir, "documents"))


def op10_media_columns(spark, sf_dir):
    return media_features(materialise(to_media(read_table(spark, sf_dir, "documents")), "media"))


def op11_curve_neighbours(spark, sf_dir):
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def op12_phrase_collocations(spark, sf_dir):
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return repair_conversations(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_warc, op3_quality_rules, op4_secret_scans, op5_html_extraction, op6_best_fit_packing, op7_ngram_join, op8_toxicity, op9_bpe_transducer, op10_media_columns, op11_curve_neighbours, op12_phrase_collocations, op13_conversation_repair)
}
ORACLES: dict[str, str] = {"op3_quality_rules": _quality.ORACLE, "op11_curve_neighbours": _NEIGHBOURS, "op12_phrase_collocations": _COLLOCATIONS}
