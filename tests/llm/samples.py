"""Small tables with the awkward rows every operator has to take."""
from pyspark.sql import functions as F

WORDS = "the of and that with for this which from river stone garden window paper little morning yellow carry follow answer number kitchen summer bridge".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int = 60) -> str:
    out, x = [], seed * 7919 + 17
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 16) % len(WORDS)] + ("." if i % 11 == 10 else ""))
    return " ".join(out)


def rows(texts):
    return [(i, t, None if t is None else "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]


def odd(spark):
    """Null, empty and blank texts, a very long one, ties, a repeated row, null and equal ids, other columns with names the operators use."""
    long = prose(5, 30_000)
    data = [(1, None, None, "a", None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "a b c d", "en", None, 7),
            (6, long, "en", "b", len(long)), (7, prose(1), "en", "b", 1), (8, prose(1), "en", "b", 1), (9, prose(2), "de", "c", 2), (9, prose(2), "de", "c", 2),
            (9, prose(3), "de", "c", 2), (None, prose(4), "fr", "c", 2), (None, None, None, None, None), (12, "日本語 ́  'tis <|x|> \x00 12 é!", "xx", "d", 3)]
    df = spark.createDataFrame(data, COLUMNS)
    for name in ("part", "score", "node", "key", "shard", "tail", "quality", "fold", "slot", "root", "rank", "length", "kept", "n", "h", "item_id", "d", "k"):
        df = df.withColumn(name, F.lit("x"))
    return df, data


def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
