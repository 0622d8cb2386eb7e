from glossa.functions.text import (
    block_number,
    clean_text,
    format_percent,
    ngram_terms,
    phrase_words,
    tokenize,
    uniform_hash,
    word_list_pattern,
)

__all__ = [
    "block_number",
    "clean_text",
    "format_percent",
    "ngram_terms",
    "phrase_words",
    "tokenize",
    "uniform_hash",
    "word_list_pattern",
]
