"""Retrieval settings. Values outside a setting's range are brought to its nearer end."""

from __future__ import annotations

from dataclasses import dataclass, fields

_RANGES = {
    "oversample": (1, 12), "cover_weight": (0.0, None), "title_weight": (0.0, None), "max_chunks_per_doc": (1, 8), "max_terms": (4, 18),
    "rrf_k": (10, 120), "fts_pool": (24, 200), "vector_pool": (24, 200), "rerank_pool": (8, 48), "unit_eps": (1e-6, 0.1),
    "graph_slots": (0, 16), "graph_per_seed": (1, 8), "cache_threshold": (0.85, 0.999), "cache_entries": (32, 5000),
    "distance_percentile": (55.0, 99.5), "context_chars": (500, None), "search_span_chars": (0, 4000),
}


@dataclass(frozen=True)
class RetrievalConfig:
    oversample: int = 4
    cover_weight: float = 1.25
    title_weight: float = 0.35
    max_chunks_per_doc: int = 3
    max_terms: int = 14
    rrf_k: int = 60
    fts_pool: int = 100
    vector_pool: int = 100
    rerank_pool: int = 20
    cross_rerank: bool = True
    hybrid: bool = True
    strong_match_degrade: bool = True
    unit_eps: float = 1e-3
    graph: bool = False
    graph_slots: int = 2
    graph_per_seed: int = 2
    chunk_chars: int = 900
    chunk_overlap: int = 120
    distance_percentile: float = 78.0
    semantic_min_chunk: int = 150
    search_span_chars: int = 0
    cache_threshold: float = 0.95
    cache_entries: int = 400
    context_chars: int = 2400
    routing: bool = False

    def __post_init__(self):
        for f in fields(self):
            low, high = _RANGES.get(f.name, (None, None))
            v = getattr(self, f.name)
            v = v if low is None else max(low, v)
            object.__setattr__(self, f.name, v if high is None else min(high, v))
