"""Retrieval strategies (R1-R7) over a table of queries, and their evaluation
(context -> prompt -> response -> trust score).

A ``Retriever`` holds one materialised corpus (chunks with their tokens, the
BM25 model, the dense vectors) and answers any number of query tables; every
method takes and returns DataFrames with ``query_id`` as the key.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import HYDE_PROMPT, MAX_BROADCAST_QUERIES, MAX_BROADCAST_ROWS, RAG_PROMPT, Settings
from quarry.operators import bm25, encode, fusion, generate, search
from quarry.operators.sizing import at_most, collect_if_small, in_blocks, query_blocks
from quarry.plans.corpus import FullTextIndex, full_text_index, materialize
from quarry.sources.store import Store, dense_store, read_store, search_store, sparse_store

HIT_COLS = ["query_id", "rank", "pk", "text", "score"]



@dataclass
class Models:
    """Caller-supplied model factories (each built once per task). ``None``
    means the offline stand-in. See ``operators.encode`` / ``generate``."""

    dense_encoder: object = None
    generator: object = None
    trust_scorer: object = None
    reranker: object = None
    sparse_encoder: object = None


@dataclass
class Retriever:
    chunks: DataFrame  # materialised: pk, text, ..., dl, terms
    settings: Settings = field(default_factory=Settings)
    models: Models = field(default_factory=Models)
    prefetched: dict | None = None
    prefetch_small: bool = False
    store: Store | None = None

    @classmethod
    def from_store(
        cls,
        spark: SparkSession,
        root: str,
        settings: Settings | None = None,
        models: Models | None = None,
    ) -> "Retriever":
        """Answer from a store written earlier, maybe by another application
        (S9): the stored vectors, vocabulary and postings are read as they are,
        nothing is refitted or encoded again. Chunks whose BM25 vector was
        empty are not in a store (P10), so no strategy returns them."""
        store = read_store(spark, root)
        out = cls(store.knowledge, settings or Settings(), models or Models(), store=store)
        out.index = FullTextIndex(
            store.knowledge, store.postings, store.bm25_terms, store.bm25_stats, store.postings
        )
        out.vectors = store.knowledge.select("pk", F.col("dense_vector").alias("vector"))
        return out

    def prefetch(self, queries: DataFrame) -> "Retriever":
        """A copy whose ranked lists (dense, sparse, full text) for ``queries``
        are computed once and written; strategies then take the rows of the
        queries they are given with a semi join instead of searching again.
        Retrieval is deterministic per query, so results are unchanged."""
        other = copy.copy(self)
        other.prefetched = None
        other.prefetch_small = at_most(queries, MAX_BROADCAST_QUERIES)
        lists = {"dense": materialize(self.dense(queries))}
        if self.settings.enable_sparse:
            lists["sparse"] = materialize(self.sparse(queries))
        if self.settings.enable_full_text:
            lists["full_text"] = materialize(self.full_text(queries))
        other.prefetched = lists
        return other

    def _list(self, name: str, queries: DataFrame) -> DataFrame:
        if self.prefetched is not None and name in self.prefetched:
            ids = queries.select("query_id")
            if self.prefetch_small:  # a subset of the query set checked in prefetch
                ids = F.broadcast(ids)
            return self.prefetched[name].join(ids, "query_id", "left_semi")
        return {"dense": self.dense, "sparse": self.sparse, "full_text": self.full_text}[name](queries)

    @cached_property
    def index(self) -> FullTextIndex:
        """BM25 model fitted once; the vocabulary is written (checkpoint) so
        every strategy and cascade round looks terms up without refitting."""
        ix = full_text_index(self.chunks)
        ix.vocab = materialize(ix.vocab)
        return ix

    @cached_property
    def vectors(self) -> DataFrame:
        """Dense vectors of every chunk, computed once (pk, vector)."""
        if self.models.dense_encoder is None:
            out = encode.hash_vectors_from_terms(
                self.chunks.select("pk", "terms"), "terms", self.settings.dense_dim
            )
        else:
            out = encode.encode_with_model(
                self.chunks.select("pk", "text"), self.models.dense_encoder, "text"
            )
        return materialize(out.select("pk", "vector"))

    @cached_property
    def sparse_rows(self) -> DataFrame:
        """Learned-sparse maps of every chunk, computed once (pk,
        sparse_vector); ids and weights are not made again at every search."""
        if self.models.sparse_encoder is None:
            out = encode.with_sparse_map(self.chunks.select("pk", "terms"), weight="double", ids=encode.term_ids("terms"))
        else:
            out = encode.sparse_with_model(self.chunks.select("pk", "text"), self.models.sparse_encoder)
        return materialize(out.select("pk", "sparse_vector"))

    # ----------------------------------------------------------- retrievers

    def _encode_queries(self, queries: DataFrame) -> DataFrame:
        if self.models.dense_encoder is None:
            return encode.hash_vectors(queries, "query_text", self.settings.dense_dim)
        return encode.encode_with_model(queries, self.models.dense_encoder, "query_text")

    @cached_property
    def avgdl(self) -> float:
        return float(self.index.stats.select("avgdl").first()[0] or 0.0)

    def dense(self, queries: DataFrame) -> DataFrame:
        """R2 (semantic search): E2 -> J1 -> W1 -> J3. The query matrix is
        broadcast when its size check passes, else the blocked plan runs."""
        qv = self._encode_queries(queries)
        if self.store is not None:
            found = dense_store(self.store, qv.select("query_id", "vector"), self.settings.top_k, MAX_BROADCAST_QUERIES)
            return found.select(*HIT_COLS)
        hits, small = search.dense_topk(qv, self.vectors, k=self.settings.top_k, with_plan=True)
        return search.with_text(hits, self.chunks, hits_small=small).select(*HIT_COLS)

    def _scanned(self, weights: DataFrame, **kw) -> tuple[DataFrame, bool]:
        """Scoring in every corpus task, and whether the hits are few enough to
        broadcast; a query side too large for that goes through in blocks."""
        k = self.settings.top_k
        rows = collect_if_small(weights, MAX_BROADCAST_ROWS)
        if rows is not None:
            return search.bm25_scan_topk(rows, k=k, **kw), search.few_hits(rows, k)
        blocks = query_blocks(weights, MAX_BROADCAST_ROWS)
        return in_blocks(weights.sparkSession, blocks, lambda part, held: search.bm25_scan_topk(part, k=k, held=held, **kw)), False

    def full_text(self, queries: DataFrame) -> DataFrame:
        """E7 -> J2 -> A3 -> W3 -> J3. The query weights are broadcast, in
        blocks where they are many, and scored inside each corpus task (no
        pair shuffle). A written store is searched by ``search_store``."""
        words, suffixes = list(self.settings.stop_words), self.settings.suffixes
        if self.store is not None:
            found = search_store(self.store, queries, self.settings.top_k, stop_words=words, suffixes=suffixes)
            return found.select(*HIT_COLS)
        qw, _ = bm25.query_weights(queries, self.index.vocab, words, suffixes)
        hits, small = self._scanned(qw, chunks=self.chunks, stats=self.avgdl)
        return search.with_text(hits, self.chunks, hits_small=small).select(*HIT_COLS)

    def _sparse_queries(self, queries: DataFrame) -> DataFrame:
        """``(query_id, term, weight)`` of the learned-sparse side."""
        if self.models.sparse_encoder is None:
            return encode.sparse_vectors(queries, "query_text", key="query_id").withColumnRenamed("term_id", "term")
        maps = encode.sparse_with_model(queries.select("query_id", "query_text"), self.models.sparse_encoder, "query_text")
        rows = maps.select("query_id", F.explode_outer("sparse_vector").alias("term", "weight")).where("term is not null")
        return materialize(rows.withColumn("weight", F.col("weight").cast("double")))  # the model runs once

    def sparse(self, queries: DataFrame) -> DataFrame:
        """R3 with the caller's sparse model or the stand-in. A written store
        is searched through its shard index of ``sparse_vector``."""
        q = self._sparse_queries(queries)
        if self.store is not None:
            return sparse_store(self.store, q, self.settings.top_k).select(*HIT_COLS)
        hits, small = self._scanned(q, chunks=self.sparse_rows, stats=None, doc_weight="stored", stored="sparse_vector")
        return search.with_text(hits, self.chunks, hits_small=small).select(*HIT_COLS)

    def ranked_lists(self, queries: DataFrame) -> list[DataFrame]:
        lists = [self._list("dense", queries)]
        if self.settings.enable_sparse:
            lists.append(self._list("sparse", queries))
        if self.settings.enable_full_text:
            lists.append(self._list("full_text", queries))
        return lists

    def no_retrieval(self, queries: DataFrame) -> DataFrame:
        """No hits, so the context is ''."""
        return self.chunks.sparkSession.createDataFrame(
            [], "query_id long, rank long, pk string, text string, score double"
        )

    def hybrid_rrf(self, queries: DataFrame) -> DataFrame:
        """Dense [+ sparse] [+ full text] -> RRF -> top k (keyed by text)."""
        return fusion.rrf(self.ranked_lists(queries), self.settings.top_k, self.settings.rrf_k).select(
            "query_id", "rank", F.lit(None).cast("string").alias("pk"), "text", "score"
        )

    def hybrid_rerank(self, queries: DataFrame) -> DataFrame:
        """Pooled distinct texts of all lists, rescored, top k."""
        pool = fusion.pooled(self.ranked_lists(queries))
        if self.models.reranker is None:
            scored = generate.idf_overlap(pool, queries, self.index.vocab)
        else:
            scored = generate.score_pairs(pool, queries, self.models.reranker)
        w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("text"))
        return (
            scored.withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= self.settings.top_k)
            .select("query_id", "rank", F.lit(None).cast("string").alias("pk"), "text", "score")
        )

    def hypothetical(self, queries: DataFrame) -> DataFrame:
        """G2 on the HyDE prompt: ``(query_id, query_text=paragraph)``.

        Stand-in paragraph: the question followed by its best full-text
        passage (pseudo-relevance feedback)."""
        if self.models.generator is not None:
            rows = queries.withColumn("prompt", generate.prompt_column(HYDE_PROMPT, F.col("query_text")))
            out = generate.generate_responses(rows, self.models.generator, self.settings.max_output_tokens)
            return out.select("query_id", F.col("response").alias("query_text"))
        top = generate.first_passage(self._list("full_text", queries), queries)
        return queries.join(top, "query_id").select(
            "query_id", F.concat_ws(" ", "query_text", "response").alias("query_text")
        )

    def hyde(self, queries: DataFrame) -> DataFrame:
        """Semantic search with the hypothetical paragraph as the query."""
        if self.settings.dry_run:
            return self.no_retrieval(queries)
        return self.dense(materialize(self.hypothetical(queries)))

    def hits(self, strategy: str, queries: DataFrame) -> DataFrame:
        fn = {
            "no_retrieval": self.no_retrieval,
            "semantic_search": lambda q: self._list("dense", q),
            "hybrid_search_with_rrf": self.hybrid_rrf,
            "hybrid_search_with_reranker": self.hybrid_rerank,
            "hyde_retrieval": self.hyde,
            "full_text_search": lambda q: self._list("full_text", q),
            "sparse_search": lambda q: self._list("sparse", q),
        }[strategy]
        return fn(queries)

    # ----------------------------------------------------------- evaluation

    def consistency(self, strategy: str, queries: DataFrame, n: int, template: str = RAG_PROMPT) -> DataFrame:
        """``(query_id, n_samples, consistency)`` of ``n`` responses of the
        caller's generator to every query's prompt."""
        if self.models.generator is None:
            raise ValueError("sampling responses needs a generator")
        ctx = fusion.context(self.hits(strategy, queries), queries)
        prompt = generate.prompt_column(template, F.col("query_text"), F.col("context"))
        rows = queries.join(ctx, "query_id").select("query_id", prompt.alias("prompt"))
        samples = generate.sample_responses(rows, self.models.generator, n, self.settings.max_output_tokens)
        return generate.sample_consistency(samples)

    def evaluate(
        self, strategy: str, queries: DataFrame, priority: int, template: str = RAG_PROMPT
    ) -> DataFrame:
        """One strategy for every query: ``evals(query_id, strategy, priority,
        prompt, response, trust_score)``."""
        hits = self.hits(strategy, queries)
        ctx = fusion.context(hits, queries)
        rows = queries.join(ctx, "query_id").withColumn(
            "prompt", generate.prompt_column(template, F.col("query_text"), F.col("context"))
        )
        if self.settings.dry_run:
            rows = rows.withColumn("response", F.lit(""))
        elif self.models.generator is not None:
            rows = generate.generate_responses(rows, self.models.generator, self.settings.max_output_tokens)
        else:
            rows = rows.join(generate.first_passage(hits, queries), "query_id")
        if self.settings.dry_run:
            rows = rows.withColumn("trust_score", F.lit(0.0))
        elif self.models.trust_scorer is not None:
            rows = generate.score_responses(rows, self.models.trust_scorer)
        else:
            rows = rows.withColumn("trust_score", generate.coverage(F.col("query_text"), F.col("response")))
        return rows.select(
            "query_id",
            F.lit(strategy).alias("strategy"),
            F.lit(priority).cast("long").alias("priority"),
            "prompt",
            "response",
            F.col("trust_score").cast("double").alias("trust_score"),
        )
