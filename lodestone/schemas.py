"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


BLOCK = "struct<type: string, text: string, id: string, name: string, arguments: string>"

#: One event of a session log.
_EVENT = (
    f"session string, seq bigint, type string, kind string, blocks array<{BLOCK}>, call_id string, name string, arguments string, "
    "turn int, step int, is_error boolean, usage struct<input: bigint, output: bigint, cache_read: bigint>, "
    "shadowed_seqs array<bigint>, shadowed_tokens bigint, raw string"
)
#: Levels of memory items, each a table of its own at the source.
LEVELS = ("soul", "user", "project", "fact", "lesson", "topic", "rules")
_ITEM = ("id string, content string, title string, keywords string, project string, subcategory string, status string, updated_at bigint, source_session string, created_at bigint, edit_history string, level string")
_TURN = ("id string, session_id string, turn_index int, summary string, outcome string, user_seq bigint, answer_seq bigint, user_text string, answer_text string, answer_hash string, created_at bigint, updated_at bigint")
OUTCOMES = ("completed", "partial", "failed", "informational", "unknown")
_TERM = ("id string, normalized string, display_text string")
_TRIPLE = ("id string, turn_id string, session_id string, subject_id string, predicate string, object_id string, source_order int, created_at bigint")
_QUEUE = ("session_id string, turn_index int, user_seq bigint, answer_seq bigint, state string, attempts int, last_error string, next_retry_at bigint, provider string, model string, updated_at bigint")
QUEUE_STATES = ("pending", "succeeded", "quarantined")
_FACT = ("src string, level string, project string, updated_at bigint, subject string, predicate string, value string, category string, src_updated_at bigint")
_DECISION = ("id string, relation string, goal string, constraints array<string>, options array<string>, chosen string, reason string, evidence array<string>, expected string, actual string, conditions array<string>, status string, tags array<string>, created_at bigint, updated_at bigint")
_VECTOR = ("turn_id string, content_hash string, embedding binary, updated_at bigint")

_SPECS = {"EVENT": _EVENT, "ITEM": _ITEM, "TURN": _TURN, "TERM": _TERM, "TRIPLE": _TRIPLE, "QUEUE": _QUEUE, "FACT": _FACT, "DECISION": _DECISION, "VECTOR": _VECTOR}


def __getattr__(name: str) -> T.StructType:
    """Schemas are parsed when they are first asked for, as that takes a session."""
    if name not in _SPECS:
        raise AttributeError(name)
    globals()[name] = T.StructType.fromDDL(_SPECS[name])
    return globals()[name]
