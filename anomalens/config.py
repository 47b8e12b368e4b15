"""Fixed values and default limits shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Statement kinds a read-only query may start with.
ALLOWED_STATEMENTS = (
    "SELECT", "WITH", "DESCRIBE", "SUMMARIZE", "EXPLAIN", "SHOW", "FROM", "VALUES",
)

# Keywords that make a query illegal, in the order they are reported.
FORBIDDEN_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE",
    "ATTACH", "DETACH", "COPY", "EXPORT", "IMPORT", "INSTALL", "LOAD",
    "CALL", "PRAGMA", "SET", "BEGIN", "COMMIT", "ROLLBACK", "VACUUM",
)

# Functions that reach outside the loaded tables.
FORBIDDEN_FUNCTIONS = (
    "read_csv", "read_parquet", "read_json", "read_csv_auto",
    "read_text", "read_blob", "glob", "httpfs", "install", "load",
)

# Tool names found in a session log.
SQL_TOOL = "execute_sql"
CONTEXT_TOOL = "retrieve_context"
ANSWER_TOOL = "final_answer"
KNOWN_TOOLS = (CONTEXT_TOOL, SQL_TOOL, ANSWER_TOOL)

# Error marks and stop reasons found in a session log.
OVER_BUDGET = "over_budget"
ILLEGAL, EXECUTION, TIMEOUT = "illegal", "execution", "timeout"

# Default limits, thresholds, boosts, budgets and weights.
MAX_RESULT_ROWS = 50
SAMPLE_VALUES = 5

DUPLICATE_SIMILARITY = 0.95
RECOVERY_SIMILARITY = 0.40
EVIDENCE_SIMILARITY = 0.80
NUMERIC_RTOL = 0.01
NUMERIC_ATOL = 1e-9

TAG_BOOST = 0.25
TITLE_BOOST = 0.35


@dataclass(frozen=True)
class Budget:
    """Limits of one session."""

    max_turns: int = 10
    max_sql_calls: int = 8
    max_context_calls: int = 3
    max_chars: int = 60_000
    force_finish: bool = True
    turns_without_call: int = 3


@dataclass(frozen=True)
class RewardWeights:
    """Weights of the score components."""

    final_diagnosis: float = 0.55
    key_numbers: float = 0.20
    evidence: float = 0.15
    recovery: float = 0.10
    illegal_sql: float = -0.03
    duplicate_sql: float = -0.02
    over_budget: float = -0.10
    numeric_rtol: float = NUMERIC_RTOL
