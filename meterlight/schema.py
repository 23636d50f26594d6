"""Names and codes of the data model."""

#: Token metrics, in order; each has <name>_value and <name>_origin.
METRICS = ("input_reported", "uncached_input", "cache_read", "cache_write", "output", "reasoning", "tool", "reported_total", "normalized_total")

#: Codes of metric origins, states, kinds, roles and coverages.
ORIGIN_UNAVAILABLE, ORIGIN_EXACT, ORIGIN_DERIVED, ORIGIN_UNKNOWN = 0, 1, 2, 6
PARTIAL, COMPLETED, FINALIZED = 0, 1, 2
KIND_UNKNOWN, KIND_PRIMARY, KIND_SIDE = 0, 1, 2
ROLE_UNKNOWN, ROLE_MAIN, ROLE_SUBAGENT, ROLE_GUARDIAN, ROLE_INTERNAL = 0, 1, 2, 3, 4
RELATION_NONE, RELATION_CONFIRMED, RELATION_UNCERTAIN = 0, 1, 2
RELATION_BY_SOURCE_PARENT = 4
INCLUSION_UNKNOWN, INCLUDED, SEPARATE = 0, 1, 2
COVERAGE_NO_DATA, COVERAGE_COMPLETE, COVERAGE_PARTIAL, COVERAGE_UNKNOWN, COVERAGE_UNAVAILABLE = 0, 1, 2, 3, 4
UNPRICED, PRICED, PARTLY_PRICED = 0, 1, 2
PRICING_NO_DATA, PRICING_COMPLETE, PRICING_PARTIAL, PRICING_UNPRICED = 0, 1, 2, 3
MISSING_RULE, MISSING_UNCACHED, MISSING_CACHED, MISSING_CACHED_RATE, MISSING_WRITE, MISSING_WRITE_RATE, MISSING_OUTPUT, MISSING_LONG = 1, 2, 4, 8, 16, 32, 64, 128
DIRECT, SPAWN, FOLLOW_UP, GUARDIAN_INTERVAL, SOURCE_INTERVAL, CONTINUATION = 0, 1, 2, 3, 4, 5

#: Names shown for events without a model or a project.
UNKNOWN_MODEL, UNIDENTIFIED_PROJECT = "未知模型", "__unidentified_project__"

EVENT_KEY = ("agent_id", "source_instance_id", "dedup_key")
SESSION_KEY = ("agent_id", "source_instance_id", "session_id")
TURN_KEY = (*SESSION_KEY, "turn_id")
MAX_DEPTH = 1024
