"""Memory policy: how long kinds of facts last, what they weigh, and where thresholds lie."""

from __future__ import annotations

# A store and its readers must agree on these.
CONTEXT_TYPES = ("professional_identity", "stated_preference", "explicit_save", "active_project", "recurring_pattern", "task_query", "passing_reference")
DEFAULT_TYPE = "task_query"
TIERS = {"professional_identity": 1, "stated_preference": 1, "explicit_save": 1, "active_project": 1, "recurring_pattern": 2, "task_query": 3, "passing_reference": 3}
HALF_LIVES = {"professional_identity": None, "stated_preference": None, "explicit_save": None, "active_project": None, "recurring_pattern": 90.0, "task_query": 30.0, "passing_reference": 14.0}
MULTIPLIERS = {"professional_identity": 1.0, "stated_preference": 1.0, "explicit_save": 1.0, "active_project": 0.95, "recurring_pattern": 0.8, "task_query": 0.2, "passing_reference": 0.05}
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4, "speculative": 0.2}
SOURCE_WEIGHTS = {"explicit_save": 3.0, "claude_code": 1.5, "codex": 1.5, "claude_ai": 1.0, "github_readme": 1.2, "github_commits": 0.9, "email": 0.6}
SEMANTIC, RECENCY, SALIENCE = 0.55, 0.15, 0.3
TIER_MULTIPLIERS = {1: 1.15, 2: 1.0, 3: 0.85}
TIER_2_SIMILARITY = 0.65
RECENCY_STEPS = ((7, 1.0), (30, 0.9), (90, 0.75), (180, 0.6), (365, 0.45), (730, 0.3))
RECENCY_OLD, RECENCY_UNKNOWN = 0.2, 0.5
ACCESS_BOOST, ACCESS_HALF_LIFE, FULL_MENTIONS = 0.15, 60.0, 20
PROMOTE_MENTIONS, DECAY_SALIENCE, ARCHIVE_SALIENCE, STABLE_SALIENCE = 3, 0.1, 0.05, 0.35
OPPOSING = (("outperform", "underperform"), ("bullish", "bearish"), ("rising", "falling"), ("increase", "decrease"), ("improve", "worsen"), ("positive", "negative"), ("buy", "sell"), ("expand", "contract"), ("accelerating", "slowing"))
COMPATIBLE_SIMILARITY, CONTRADICTION_SIMILARITY, INTERNAL_SIMILARITY, FINGERPRINT_LENGTH = 0.3, 0.12, 0.08, 6
TOPIC_CAP, PROJECT_CAP = 100, 50
