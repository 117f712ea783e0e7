"""Settings of the question-answering pipeline; each query takes them as a value, none are global."""

from __future__ import annotations

from dataclasses import dataclass

NO_TEXT = "No text found in document."
TOO_LARGE = "File too large (max 20 MB)."


@dataclass(frozen=True)
class Settings:
    # fixed values that results depend on
    max_bytes: int = 20_000_000
    max_pages: int = 25
    min_sentence: int = 15
    min_answer_sentence: int = 10
    window: int = 3
    stride: int = 2
    percentile: float = 0.4
    top_fast: int = 8
    pool: int = 20
    max_reranked: int = 4
    rerank_margin: float = 2.0
    rerank_floor: float = -5.0
    token_budget: int = 480
    answer_tokens: int = 30
    min_confidence: float = 0.05
    use_reranker: bool = False
    use_layout: bool = True
    mode: str = "tfidf"
