"""A Spark-native engine for document ingestion, hybrid retrieval and corpus analytics."""

from __future__ import annotations

from importlib import import_module

#: Names of the public interface and where they live; they are imported when first used.
_PUBLIC = {
    "Engine": "plans.engine", "IngestReport": "plans.engine", "NothingIngested": "plans.engine", "StaleEntries": "plans.engine", "Settings": "config", "load_settings": "config",
    "Bm25Index": "operators.bm25", "build_bm25": "operators.bm25", "bm25_search": "operators.bm25", "VectorIndex": "operators.vector_index", "dense_search": "operators.retrieval",
    "hybrid": "operators.retrieval", "rerank": "operators.retrieval", "build_context": "operators.context", "build_prompt": "operators.context", "fixed_chunks": "operators.chunking",
    "recursive_chunks": "operators.chunking", "Store": "sources.store", "ingest_stream": "streaming.ingest",
}
__all__ = list(_PUBLIC)


def __getattr__(name: str):
    if name in _PUBLIC:
        return getattr(import_module(f".{_PUBLIC[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
