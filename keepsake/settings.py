"""Settings that change results, as one frozen value. The defaults of the record store."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # retrieval
    min_semantic_similarity: float = 0.65
    min_score: float = 0.45
    min_expanded_score: float = 0.45
    min_semantic_only_score: float = 0.65
    semantic_anchor_threshold: float = 0.65
    max_records: int = 8
    max_tokens: int = 4000
    mmr_lambda: float = 0.7
    usage_ratio_weight: float = 0.2
    keyword_bonus: float = 0.08
    project_match_bonus: float = 0.05
    semantic_weight: float = 0.7
    topic_change_threshold: float = 0.3
    recently_injected_window: int = 20
    suppression_mode: str = "soft"
    suppression_penalty: float = 0.5
    max_relation_hops: int = 1
    max_relation_expansions: int = 5
    relation_hop_decay: float = 0.6
    max_relations_per_record: int = 50
    enable_relation_expansion: bool = True
    enable_entity_edges: bool = False
    enable_entity_keywords: bool = False
    max_keyword_queries: int = 6
    max_keyword_errors: int = 3
    max_keyword_commands: int = 3
    # maintenance
    stale_days: int = 90
    low_usage_min_retrievals: int = 5
    low_usage_ratio_threshold: float = 0.1
    low_usage_high_retrieval_min: int = 5
    stale_unused_days: int = 30
    consolidation_search_limit: int = 12
    consolidation_max_cluster_size: int = 8
    consolidation_threshold: float = 0.75
    cross_type_threshold: float = 0.80
    consolidation_recheck_days: int = 7
    no_merge_backoff_days: int = 90
    conflict_threshold: float = 0.85
    conflict_limit: int = 5
    currentness_threshold: float = 0.7
    currentness_search_limit: int = 12
    currentness_max_cluster_size: int = 8
    currentness_recheck_days: int = 7
    promotion_batch_size: int = 20
    promotion_recheck_days: int = 30
    promotion_min_success: int = 2
    promotion_min_usage_ratio: float = 0.3
    promotion_min_retrievals: int = 3
    warning_threshold: float = 0.8
    warning_limit: int = 5
    warning_min_failures: int = 2
    warning_recheck_days: int = 7
    warning_dedup_threshold: float = 0.9
    max_warnings: int = 5
    warning_budget_share: float = 0.3
    relation_days: int = 30
    dedup_threshold: float = 0.85

    def __post_init__(self) -> None:
        if self.suppression_mode not in ("soft", "hard"):
            raise ValueError("suppression_mode is soft or hard")
        if not 0 <= self.mmr_lambda <= 1:
            raise ValueError("mmr_lambda lies between 0 and 1")

    def using(self, **changes: object) -> Settings:
        known = {f.name for f in fields(self)}
        if unknown := set(changes) - known:
            raise ValueError(f"no such setting: {sorted(unknown)}")
        return replace(self, **changes)  # type: ignore[arg-type]


DAY_MS = 86_400_000
