"""The functions as SQL: temporary functions whose bodies are the same expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lipika.functions import lexicon as lx
from lipika.functions import text as tx
from lipika.functions.tagger import PATTERNS


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names."""
    made = []

    def sql(name: str, args: str, kind: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
        made.append(name)

    space = _literal(tx.SPACE)
    sql("token_count", "t STRING", "INT", f"size(filter(split(coalesce(t, ''), {space}), x -> x <> ''))")
    sql("plain_norm", "t STRING", "STRING", f"lower(trim(regexp_replace(coalesce(t, ''), {space}, ' ')))")
    sql("digits_only", "t STRING", "STRING", "regexp_replace(coalesce(t, ''), '[^\\\\p{Nd}]', '')")
    sql("latin_count", "t STRING", "INT", "length(regexp_replace(coalesce(t, ''), '[^A-Za-z]', ''))")
    own = " ".join(f"WHEN {_literal(k)} THEN length(regexp_replace(t, {_literal('[^[' + chr(92) + 'p{L}&&[' + ''.join(tx.block_class(*r) for r in v) + ']]]')}, ''))" for k, v in lx.SCRIPT_RANGES.items())
    sql("script_fidelity", "t STRING, lang STRING", "DOUBLE", f"coalesce(try_divide(CASE lang {own} ELSE 0 END, length(regexp_replace(t, '[^\\\\p{{L}}]', ''))), 1.0D)")
    for cls, (kind, pattern) in PATTERNS.items():
        sql(f"tag_{kind}", "t STRING", "ARRAY<STRING>", f"regexp_extract_all(coalesce(t, ''), {_literal(pattern)}, 0)")
        _ = cls
    for name, f in (("key_norm", tx._py_key), ("audit_key", tx._py_audit_key), ("match_norm", tx._py_match)):
        spark.udf.register(name, F.pandas_udf(_series(f), "string"))
        made.append(name)
    return made


def _series(f):
    def run(s):
        return s.map(lambda t: "" if t is None else f(t)).astype(object)

    return run
