"""Small tables with every awkward case, and columns whose names clash with those the operators use."""

from pyspark.sql import functions as F

CLASHING = ("size", "row", "pick", "times", "code", "key", "check", "root", "score", "clean", "shard", "slot", "part", "node")


def docs_table(spark, rows, clashing=True):
    """rows: (doc_id, text, source)."""
    out = spark.createDataFrame(
        [(i, t, "en", s, len(t or "")) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return out.withColumns({c: F.lit(f"x{c}") for c in CLASHING}) if clashing else out


def awkward():
    long = " ".join(f"word{k} of{k % 7} the{k % 3}" for k in range(20_000))
    return [
        (1, "one two three four five", "a"),
        (2, "one two three four five", "b"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n", "a"),
        (None, "a row without an id", None),
        (7, "Repeated row of words", "c"),
        (7, "Repeated row of words", "c"),
        (8, long, "c"),
        (9, long + " end", None),
        (10, "é ü 漢字 🙂 x", "b"),
    ]
