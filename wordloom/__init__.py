"""Lexical search over large text tables, written as Spark DataFrame operators."""

from wordloom.plans.layout import Layout
from wordloom.plans.indexing import append_batch, format_index, index_corpus, open_index, open_texts, open_vocabulary
from wordloom.operators.search import (
    all_words_filter,
    missing_texts,
    multi_word_search,
    phrase_search,
    posting_lookup,
    rank_top,
    read_texts,
    search,
    search_summary,
    single_word_search,
)

__all__ = [
    "Layout",
    "all_words_filter",
    "append_batch",
    "format_index",
    "index_corpus",
    "missing_texts",
    "multi_word_search",
    "open_index",
    "open_texts",
    "open_vocabulary",
    "phrase_search",
    "posting_lookup",
    "rank_top",
    "read_texts",
    "search",
    "search_summary",
    "single_word_search",
]
