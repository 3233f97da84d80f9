"""The queries of this subpackage and their SQL, by name."""

from rivulet.llm import chat_format, embedding_dedup, language_id, mixing, pieces, simhash, span_hashes, suffix_dedup, token_counts, warc

QUERIES = {
    f.__name__: f
    for f in (
        suffix_dedup.op1_suffix_dedup,
        language_id.op2_language_id,
        token_counts.op3_token_counts,
        mixing.op4_mixing,
        embedding_dedup.op5_embedding_dedup,
        pieces.op6_sentencepiece,
        warc.op7_warc,
        simhash.op8_simhash,
        chat_format.op9_chat_formatting,
        span_hashes.op10_fingerprints,
    )
}

ORACLE_SQL = {"op4_mixing": mixing.OP4_SQL, "op7_warc": warc.OP7_SQL, "op9_chat_formatting": chat_format.OP9_SQL}
