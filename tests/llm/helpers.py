"""Small tables with nulls, blanks, ties, repeats and clashing columns."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("doc", "pos", "w", "n", "node", "key", "token", "own", "covered", "n_lines", "n_removed", "x", "quality", "text_hash", "length", "piece", "html_", "component_id", "size", "band")


def docs(spark, rows, clash=True):
    """A documents table of (doc_id, text) pairs, with columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASHES}) if clash else df


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + str(r.randrange(60)) for _ in range(n))
