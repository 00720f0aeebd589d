import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
    # names that operators use themselves
    ("class", T.StringType()), ("size", T.StringType()), ("doc", T.StringType()), ("places", T.StringType()), ("label", T.StringType()),
    ("score", T.StringType()), ("n_tokens", T.StringType()), ("shard", T.StringType()), ("component_id", T.StringType())]])
PASSAGE = ("The river rose in the night. Nobody on the farm had heard the rain. By morning the lower fields were a lake, and the "
           "gates stood open to it. The cattle had gone up to the ridge by themselves. They came down only when the water had left, "
           "three days later, thin and loud.")


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls in every column, empty and long texts, ties and repeats, and extra columns with clashing names."""
    extra = ("x",) * 9
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(40_000))
    rows = [(1, PASSAGE, "en", "a", 10, *extra), (2, PASSAGE, "en", "a", 10, *extra), (2, PASSAGE, "en", "a", 10, *extra),
            (3, None, None, None, None, *(None,) * 9), (4, "", "en", "b", 0, *extra), (5, " \t\n ", "en", "b", 4, *extra),
            (None, "one two three", "en", None, 13, *extra), (6, "one two three", "fr", "a", 13, *extra),
            (7, long, "en", "b", len(long), *extra), (8, long + " end", "en", "b", len(long) + 4, *extra),
            (9, "x" * 20_000, "en", "c", 20_000, *extra), (10, "Ends at once. " + PASSAGE + " And goes on.", "en", None, 9, *extra),
            (11, "licensed under the MIT License ÄÖ 中文 😀 ▁ a", "de", "a", 9, *extra)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 3 > 0, int(i % 4 == 0)) for i in range(1, 12)] + [(1, None, None), (None, True, 1)]
    return spark.createDataFrame([(a, None if b is None else int(b), c) for a, b, c in rows], "doc_id long, quality int, toxic int")
