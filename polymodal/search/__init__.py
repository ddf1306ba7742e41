"""Vector, full-text and hybrid search over DataFrames. Hits are rows (id, score, rank, payload)."""

from .filters import compile_filter
from .fusion import fuse_dbsf, fuse_rrf, group_hits
from .topk import full_text_hits, hybrid_hits, prefetch_hits, recommend_hits, top_k_hits, top_k_ids

__all__ = ["compile_filter", "full_text_hits", "fuse_dbsf", "fuse_rrf", "group_hits", "hybrid_hits", "prefetch_hits", "recommend_hits", "top_k_hits", "top_k_ids"]
