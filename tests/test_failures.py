"""Messages of failures without what varies between repeats."""

from tessera.functions import code as C
from pyspark.sql import functions as F


def test_a_failure_s_message_is_its_cause(spark):
    said = {
        "FAIL x\n./pkg/a.go:12:3: undefined: x": ("compile", "pkg/a.go undefined: x"),
        "SqliteError: no such column: a b": ("sql", "no such column: a b"),
        "Error: Cannot find module 'a-b' from c": ("module_not_found", "Cannot find module 'a-b"),
        "  java.lang.IllegalStateException: gone": ("exception", "IllegalStateException: gone"),
        "a.py:3: error[E12]": ("compile", "a.py error[E12]"),
        "OperationalError": ("sql", "OperationalError"),
    }
    rows = spark.createDataFrame([(x,) for x in said], "t string").select("t", C.failure(F.col("t")).alias("f")).select("t", "f.family", "f.message")
    assert {r["t"]: (r["family"], r["message"]) for r in rows.collect()} == said
