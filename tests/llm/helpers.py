"""Small tables for the operators' edge cases."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept string"
LINE = "this very line stands in many documents"


def documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated texts, columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    texts = [
        "", None, LINE, f"{LINE}\nown one", f"  {LINE.upper()}\t\nown two", long, long, long.upper(), "a b", "a", " \t\r\n", "x\n\n\nx",
        "Straße Ünï ÀÉ\n" + LINE, "two  spaces\t and   more\n\n  end ", "<|endoftext|> 's 're don't 12 345", "\U0001f600 emoji 中文", "short\nshort\nshort",
    ]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 3 else f"src{i % 4}", None, "k", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return documents(spark).where(F.lit(False))


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
