"""Read-only SQL over registered tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "merge", "grant", "revoke", "copy", "call", "set", "refresh", "load", "add", "cache", "analyze", "explain", "describe", "show", "use")
MOST_CHARS, MOST_ROWS = 4000, 200


def checked(sql: str) -> str | None:
    """The statement without its semicolon, or None if it isn't one plain SELECT without forbidden words."""
    bare = sql.strip().rstrip(";").strip()
    words = re.sub(r"'(?:[^']|'')*'", "''", bare)
    if not bare or len(bare) > MOST_CHARS or ";" in words or "--" in words or "/*" in words or not re.match(r"(?i)select\b", bare):
        return None
    return None if re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b|\b(java_method|reflect|read_files|input_file_name)\s*\(|\b(parquet|csv|json|text|orc|binaryfile)\s*\.\s*`", words) else bare


def guarded(spark: SparkSession, sql: str, tables: dict[str, DataFrame], most: int = MOST_ROWS) -> DataFrame:
    """Run a checked statement over temporary views of the tables; limited where it names no limit itself."""
    bare = checked(sql)
    if bare is None:
        raise ValueError("only one plain SELECT is allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(bare)
    return out if re.search(r"(?i)\blimit\b", bare) else out.limit(most)
