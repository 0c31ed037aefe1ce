import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and blank texts, repeated rows, equal texts, one very long text.
WORDS = "the quick brown fox jumps over a lazy dog and runs to that old river bank with great speed".split()


NAN, INF = float("nan"), float("inf")
#: Repeated vectors and ids, null and non-finite entries, shorter and empty vectors, large entries.
VECTORS = [
    (1, [0.5, -0.25, 1.0, 3.0, 0.1], 0), (1, [0.5, -0.25, 1.0, 3.0, 0.1], 0), (2, [0.5, -0.25, 1.0, 3.0, 0.1], 1), (3, None, 0), (4, [1.0, None, 2.0, 1.0, 1.0], 0), (5, [1.0, NAN, 2.0, 1.0, 1.0], 0),
    (6, [INF, 0.0, 0.0, 0.0, 0.0], 0), (7, [2.0, 1.0], 0), (8, [], 0), (None, [-1.0, 7.5, 0.003, -0.003, 2.0], None), (9, [1e5, 1.0, -1e5, 0.0, -0.0], 3), (10, [0.2, 0.4, 0.1, -3.0, 0.7], 3), (11, [5.0, 4.0, 0.5, 0.25, 0.125], 3),
]


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefghij") * (k % 2) for k in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    a, b, c = prose(1, 120), prose(2, 130), prose(3, 9000)
    words = a.split()
    words[60] = "changed"
    return [
        (1, a, "en", "s1", 500), (2, a, "en", "s1", 500), (3, " ".join(words), "fr", None, 500), (4, b, None, "s2", None), (4, b, None, "s2", None), (5, None, "en", "s1", 0), (6, "", "en", "s1", 0),
        (7, " \t\n ", "xx", "s3", 4), (None, prose(4, 80), "de", "s3", 9), (8, c, "en", "s2", 60000), (9, "One two", "es", None, 7), (10, "one TWO", "es", "s9", 7), (11, a + "\n" + b, "en", "s1", 1000),
    ]


@pytest.fixture(scope="session")
def odd_dir(spark, odd_rows, tmp_path_factory):
    """Tables of odd rows, with extra columns of names that operators use, and in empty/ the same tables without rows."""
    d = tmp_path_factory.mktemp("odd")
    names = "component rep w row y key label_id kept_id leaked_id n_copies _row_key row_key _copy size slot id k node at hot host path rule score verdict win s fp item band bands bits places spans start part shard before"
    extra = lambda df: df.selectExpr("*", *(f"'{c}' as {c}" for c in names.split()))
    item = " ".join(odd_rows[7 + 2][1].split()[10:50])
    tables = {
        "documents": spark.createDataFrame(odd_rows, DOC),
        "benchmark": spark.createDataFrame([(1, item), (1, item), (2, None), (3, "one two"), (None, prose(9, 30))], "item_id long, text string"),
        "labels": spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 0, 1), (4, 1, 0), (8, 1, None), (99, 0, 0), (None, 1, 0), (9, None, 0), (11, 0, 0)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame(
            [(1, "http://A.example.NET/en/x?q=1", "h"), (2, None, None), (3, "no scheme", ""), (4, "://", ""), (None, "https://spam-farm.example.com/de", ""), (5, "http://x.org/fr/1#a", ""), (5, "http://x.org/fr/1#a", ""), (6, "http://q.com?b/c", "")],
            "page_id long, url string, html string",
        ),
        "conversations": spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, None, "> Hi\nYes"), (1, 1, None, "> Hi\nYes"), (None, None, "user", None), (None, 2, "x", "")], "conv_id long, turn long, role string, text string"),
        "embeddings": spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int"),
    }
    for name, df in tables.items():
        extra(df).coalesce(1).write.parquet(f"{d}/{name}.parquet")
        extra(df).limit(0).coalesce(1).write.parquet(f"{d}/empty/{name}.parquet")
    return str(d)
