"""Thresholds and sizes, one frozen value object passed to the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TriageConfig:
    confidence_escalation: float = 0.60
    similarity_high: float = 0.80
    similarity_medium: float = 0.55
    near_duplicate: float = 0.96
    top_k: int = 5
    human_boost: float = 0.05
    min_solved_rows: int = 1000
    label_batch_rows: int = 25
    label_group_batches: int = 20
    # Work units of the similarity join: one task compares at most about
    # block_rows cases with query_rows queries.
    block_rows: int = 4096
    query_rows: int = 4096
