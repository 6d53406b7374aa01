"""Defaults of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Limits and weights that the operators take as arguments."""

    dominant_words: int = 30
    dominant_chars: int = 180
    block_chars: int = 1200
    max_words: int = 300
    overlap_words: int = 60
    k1: float = 1.2
    b: float = 0.75
    least_idf: float = 1e-6
    top_k: int = 8
    alpha: float = 0.6
    rrf_k: int = 60
    guaranteed_semantic: int = 15
    dedup_threshold: float = 0.95
    char_budget: int = 12_000
    min_truncated: int = 200
    memory_turns: int = 6
    answer_chars: int = 600
    title_chars: int = 120
    topic_percentile: float = 90
    topic_similarity: float = 0.5
    ocr_words: int = 20
    ocr_area: float = 0.25
    drawings: int = 4
    drawn_coverage: float = 0.03
    drawn_ratio: float = 0.004
    least_image: int = 50
    heading_ratio: float = 1.2
    heading_words: int = 20
    bold_words: int = 15
    bold_ratio: float = 0.95
    stream_accuracy: float = 85.0
    cell_average: int = 200
    cell_most: int = 500
    empty_ratio: float = 0.6
    uneven_ratio: float = 0.3
    rerank_candidates: int = 30
    expansions: int = 3
    vector_size: int = 384
    summary_chunks: int = 3
    vision_context: int = 1500

    def __post_init__(self):
        if not 0 <= self.overlap_words < self.max_words or not 0 <= self.alpha <= 1 or self.top_k < 1:
            raise ValueError("overlap_words must be under max_words, alpha from 0 to 1, and top_k positive")


DEFAULT = EngineConfig()
