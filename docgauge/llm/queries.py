"""One query per operator, over its whole table with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from docgauge.llm import embeddings, infilling, language, media, merges, mixing, packing, search, secrets, shingles, substrings, token_files, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, carry=["doc_id"])


def op2_language_id(spark, sf_dir):
    return language.language_id(_table(spark, sf_dir, "documents"))


def op3_token_files(spark, sf_dir):
    return token_files.encode_and_read(_table(spark, sf_dir, "documents"))


def op9_sequence_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark, sf_dir):
    return shingles.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_media_columns(spark, sf_dir):
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))


def op11_ranked_search(spark, sf_dir):
    return search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark, sf_dir):
    return infilling.infilling_digests(_table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark, sf_dir):
    return merges.encoding_digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_language_id": op2_language_id,
    "op3_token_files": op3_token_files,
    "op4_secret_scan": op4_secret_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_media_columns": op8_media_columns,
    "op9_sequence_packing": op9_sequence_packing,
    "op10_warc": op10_warc,
    "op11_ranked_search": op11_ranked_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE = {
    "op1_source_mixing": mixing.SQL,
    "op6_ngram_jaccard_join": shingles.SQL,
    "op7_embedding_near_dedup": embeddings.SQL,
    "op10_warc": warc.SQL,
    "op11_ranked_search": search.SQL,
    "op12_fill_in_middle": infilling.SQL,
}
