"""The engine's functions by SQL names, as expressions that Catalyst sees through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evidence

_X = "coalesce(x, '')"
_LOW = "lower(coalesce(x, ''))"
_REST = f"regexp_replace({_LOW}, r'[a-z0-9_{tx.SPACE}]+', '')"
_CHARACTERS = f"filter(split({_REST}, ''), c -> c <> '')"
_TOKENS = f"""concat(regexp_extract_all({_LOW}, r'[a-z0-9_]+', 0), CASE WHEN {_REST} RLIKE r'[\\x{{10000}}-\\x{{10FFFF}}]'
  THEN zip_with(slice({_CHARACTERS}, 1, size({_CHARACTERS}) - 1), slice({_CHARACTERS}, 2, size({_CHARACTERS}) - 1), (a, b) -> concat(a, b)) ELSE regexp_extract_all({_REST}, r'(?s)(?=(..))', 1) END)"""
_FOUND = [f"regexp_extract_all(coalesce(x, ''), r'{p}', 0)" for p in tx.EXACT_PATTERNS]
_UNITS = "zip_with(" + ", ".join(f"regexp_extract_all(coalesce(x, ''), r'{tx.UNIT_PATTERN}', {k})" for k in (1, 2)) + ", (a, b) -> concat(a, b))"
_EXACT = f"array_distinct(transform(concat({_FOUND[0]}, {_FOUND[1]}, {_UNITS}, {_FOUND[2]}), v -> lower(v)))"
_PART = lambda k: f"nullif(regexp_extract(e, r'{evidence.EDIT}', {k}), '')"
_EDITS = f"""transform(filter(transform(split(coalesce(x, ''), ';'), e -> regexp_replace(e, r'^[{tx.SPACE}]+|[{tx.SPACE}]+$', '')), e -> e <> ''), e -> named_struct('raw', e, 'unparsed', NOT e RLIKE r'{evidence.EDIT}',
  'scene', {_PART(1)}, 'action', {_PART(2)}, 'session', {_PART(3)}, 'turn', coalesce(try_cast({_PART(5)} AS INT), try_cast({_PART(7)} AS INT)), 'low', try_cast({_PART(6)} AS INT), 'high', try_cast({_PART(7)} AS INT)))"""

#: SQL name, type it returns, and its body: SQL over x, or the function whose expression has SQL without lambdas.
FUNCTIONS = {
    "mem_tokenize": ("ARRAY<STRING>", _TOKENS),
    "mem_redact": ("STRING", lambda c: tx.redact(tx.text(c))),
    "mem_has_secret": ("BOOLEAN", tx.has_secret),
    "mem_informative_len": ("INT", tx.informative_length),
    "mem_should_recall": ("BOOLEAN", tx.should_recall),
    "mem_strip_non_content": ("STRING", tx.strip_non_content),
    "mem_echo_label": ("STRING", f"CASE {' '.join(f"WHEN {_X} RLIKE r'{p}' THEN '{label}'" for label, _, p in tx.ECHO_RULES)} END"),
    "mem_echo_factor": ("DOUBLE", f"CASE {' '.join(f"WHEN {_X} RLIKE r'{p}' THEN {factor}D" for _, factor, p in tx.ECHO_RULES)} ELSE 1.0D END"),
    "mem_query_type": ("STRING", f"CASE WHEN {_X} RLIKE r'{tx.FACT_WORDS}' AND {_X} RLIKE r'{tx.TOPIC_WORDS}' THEN 'mixed' WHEN {_X} RLIKE r'{tx.FACT_WORDS}' THEN 'fact' ELSE 'topic' END"),
    "mem_exact_values": ("ARRAY<STRING>", _EXACT),
    "mem_normalize_term": ("STRING", tx.normalize_term),
    "mem_strip_code_fence": ("STRING", tx.strip_code_fence),
    "mem_http_status": ("INT", tx.http_status),
    "mem_ids": ("ARRAY<STRING>", tx.memory_ids),
    "mem_parse_edits": ("ARRAY<STRUCT<raw: STRING, unparsed: BOOLEAN, scene: STRING, action: STRING, session: STRING, turn: INT, low: INT, high: INT>>", _EDITS),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL of this session, and return their names.

    Each is a temporary function whose body is SQL, so plans hold built-in functions alone; ``inline`` of a column of mem_parse_edits is a table.
    """
    probe = spark.createDataFrame([], "x string")
    for name, (kind, body) in FUNCTIONS.items():
        own = body if isinstance(body, str) else _sql(probe, body(F.col("x")))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {own}")
    return list(FUNCTIONS)


def _sql(probe: DataFrame, column: Column) -> str:
    """The SQL of an expression over the column x."""
    plan = probe.select(column.alias("y"))._jdf.queryExecution().analyzed()
    return plan.projectList().apply(0).child().sql()
