"""Stable identifiers and declared parameters shared by every operator."""

# Action identifiers; list position is the arm index.
ACTIONS = (
    "A0_direct",
    "A1_bm25",
    "A2_dense",
    "A3_hybrid",
    "A4_hybrid_rerank",
    "A5_agentic",
    "A6_abstain",
)
ABSTAIN = "A6_abstain"
DIRECT = "A0_direct"
RETRIEVING_ACTIONS = ACTIONS[1:6]
ANSWERING_ACTIONS = ACTIONS[:6]

# Abstention reason codes.
ABSTENTION_REASONS = (
    "insufficient_evidence",
    "retrieval_disagreement",
    "ambiguous_question",
    "conflicting_documents",
    "calculation_unverified",
    "policy_low_confidence",
)

# Outcome error statuses.
ERROR_STATUSES = (
    "ok",
    "provider_error",
    "timeout",
    "rate_limited",
    "parse_error",
    "budget_exceeded",
    "step_limit_exceeded",
)

# Question types and splits.
QUESTION_TYPES = ("extraction", "comparison", "arithmetic", "synthesis", "unanswerable")
SPLITS = ("dev", "validation", "test", "challenge")

# Corpus provenance; only the first may back a reported result.
PROVENANCES = ("full_documents", "evidence_pages_only", "fixture")
REPORTABLE_PROVENANCE = "full_documents"

# Split fractions and seed of the benchmark configuration.
SPLIT_FRACTIONS = {"dev": 0.30, "validation": 0.25, "test": 0.45}
DEFAULT_SEED = 20260815

# Reward penalties per profile (cost, latency, hallucination, violation).
REWARD_PROFILES = {
    "quality_first": (0.05, 0.05, 0.60, 1.00),
    "balanced_enterprise": (0.25, 0.20, 0.40, 1.00),
    "cost_sensitive": (0.60, 0.35, 0.30, 1.00),
    "regulated": (0.10, 0.10, 1.00, 2.00),
}
PROFILE_VERSION = "v1"
PRIMARY_PROFILE = "balanced_enterprise"
CORRECTNESS_WEIGHT = 0.6
SUPPORT_WEIGHT = 0.4
COST_REFERENCE_USD = 0.05
LATENCY_REFERENCE_MS = 30000.0

# Agent execution limits.
AGENT_LIMITS = {
    "max_steps": 8,
    "max_tool_calls": 12,
    "max_total_tokens": 20000,
    "max_wall_clock_seconds": 120.0,
}
