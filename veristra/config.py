"""Constants of the engine's rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # fusion and retrieval
    rrf_k: int = 60
    dense_limit: int = 24
    sparse_limit: int = 24
    final_limit: int = 10
    evidence_limit: int = 3
    # gates
    minimum_confidence: float = 0.55
    minimum_score: float = 0.24
    minimum_margin: float = 0.015
    minimum_agreement: float = 0.05
    margin_waiver: float = 0.85
    # chunking
    window_sentences: int = 3
    window_overlap: int = 1
    semantic_sentences: int = 4
    semantic_quantile: float = 0.35
    semantic_words: int = 180
    pair_characters: int = 800
    late_sentences: int = 2
    # sparse features
    ngram_low: int = 3
    ngram_high: int = 5
    # transcripts
    stable_ms: int = 120
    stable_events: int = 2
    stable_characters: int = 3
    reuse_similarity: float = 0.82
    # sessions, stores, breakers
    idle_seconds: int = 30
    longest_seconds: int = 90
    ttl_seconds: int = 60
    failures: int = 3
    recovery_seconds: int = 10
    seed: int = 2026


SETTINGS = Settings()
