"""quarry: a Spark-native retrieval and answer-selection engine.

Pages or documents become a knowledge table (sections, chunks, vectors,
BM25 postings); whole tables of queries are answered with exact dense,
sparse and full-text top-k search, rank fusion, reranking, hypothetical
document expansion, prompt building and a trust-score cascade.
"""

__version__ = "0.1.0"
