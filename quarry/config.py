"""Defaults of the retrieval engine.

Fixed values: these must equal the reference's defaults for equal results.
    batch size ............ 128
    chunk size / overlap .. 500 / 50 characters
    chunk separators ...... "\\n\\n", "\\n", " ", ""
    dense dimension ....... 384, metric cosine (exact, no ANN)
    sparse metric ......... inner product
    learned sparse ........ off; full text (BM25) ....... on
    top k ................. 5
    trust threshold ....... 0.98 (accept when score >= threshold)
    max output tokens ..... 500
    RRF constant k ........ 60, positions counted from 0
    BM25 k1, b, epsilon ... 1.5, 0.75, 0.25
    strategy priority ..... no_retrieval, semantic_search, hybrid_search_with_rrf,
                            hybrid_search_with_reranker, hyde_retrieval
    stub response ......... see STUB_RESPONSE
    prompt templates ...... see RAG_PROMPT, HYDE_PROMPT, SYSTEM_PROMPT
"""

from __future__ import annotations

from dataclasses import dataclass, field

BATCH_SIZE = 128
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
SEPARATORS = ("\n\n", "\n", " ", "")
DENSE_DIM = 384
TOP_K = 5
TRUST_THRESHOLD = 0.98
MAX_OUTPUT_TOKENS = 500
RRF_K = 60
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
ENABLE_SPARSE = False
ENABLE_FULL_TEXT = True

STRATEGIES = (
    "no_retrieval",
    "semantic_search",
    "hybrid_search_with_rrf",
    "hybrid_search_with_reranker",
    "hyde_retrieval",
)

STUB_RESPONSE = (
    "This question cannot be handled without additional clarification "
    "or further information."
)

SYSTEM_PROMPT = (
    "You are an AI assistant that specializes in providing factually accurate and "
    "contextually relevant responses by using both your trained knowledge and retrieved "
    "information. Always prioritize the retrieved information when answering user "
    "queries. If the retrieved data doesn't fully answer the question, use your general "
    "knowledge to provide additional context. Make sure your responses are clear, "
    "concise, and helpful."
)

RAG_PROMPT = """
Context information is below.
---------------------
$context
---------------------
Given the context information and not prior knowledge, answer the query.
Query: $query
Answer:
"""

HYDE_PROMPT = """Given a question, generate a paragraph of text that answers the question.
Question: $query
Paragraph:
"""

# Text columns of the knowledge table are VARCHAR(65535) in the reference store.
MAX_TEXT_BYTES = 65535

# Largest query set whose vectors are shipped to every task as a broadcast
# (rows). Above it, queries are searched one block of this size after another.
MAX_BROADCAST_QUERIES = 20000
# Largest number of rows of a query-side table we hint as broadcast.
MAX_BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Settings:
    """Knobs of one run; defaults are the reference's."""

    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    dense_dim: int = DENSE_DIM
    top_k: int = TOP_K
    threshold: float = TRUST_THRESHOLD
    rrf_k: int = RRF_K
    enable_sparse: bool = ENABLE_SPARSE
    enable_full_text: bool = ENABLE_FULL_TEXT
    strategies: tuple = field(default=STRATEGIES)
    dry_run: bool = False
    max_output_tokens: int = MAX_OUTPUT_TOKENS
    stop_words: tuple = ()  # dropped by the analyzer on the corpus and the query side alike
    suffixes: tuple = ()  # endings the analyzer cuts off on both sides
