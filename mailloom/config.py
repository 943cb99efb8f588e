"""Settings that change results, passed to operators as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    confidence_threshold: float = 0.85
    pii_mask_char: str = "*"
    pii_entities: tuple[str, ...] = (
        "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "SSN",
    )
    exact_domain_weight: float = 1.0
    similar_domain_weight: float = 0.8
    default_domain_weight: float = 0.5
    footer_lines_count: int = 3
    max_email_length: int | None = None
    max_policy_length: int | None = None
    embedding_size: int = 256
    min_page_length: int = 100
    match_candidates: int = 10
    score_threshold: float = 0.35
    entity_thresholds: tuple[tuple[str, float], ...] = ()
    model_score: float = 0.85
    high_confidence: float = 0.8
    min_accuracy: float = 0.6
    max_latency_sec: float = 10.0
    mean_latency_sec: float = 5.0

    @property
    def max_domain_weight(self) -> float:
        return max(self.exact_domain_weight, self.similar_domain_weight, self.default_domain_weight)


DEFAULT_CONFIG = EngineConfig()
