import random
import re

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that documents may have besides their own; operators use these names inside.
CLASHING = ["good", "kept", "score", "key", "set_id", "bucket", "row", "word", "n", "topic", "weight", "ids", "spans", "__x"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def _odd_rows():
    rng = random.Random(3)
    plain = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta."]) + str(rng.randrange(40)) for _ in range(120))
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(40_000))
    rows = [
        (1, plain), (1, plain), (2, plain), (3, None), (4, ""), (5, " \n\t "), (6, long), (None, plain + " more"), (None, None),
        (7, "x" * 70_000), (8, "one"), (9, "\n\n\nline\nline\nline"), (10, "日本語 テキスト 🎉 <|endoftext|> +1 (212) 555-0100 a@b.co 1.2.3.4"),
    ]
    return [(i, t, None if n % 4 == 0 else "en", None if n % 3 == 0 else "src0", len(t or "")) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with names that operators use inside."""
    schema = T.StructType([*T._parse_datatype_string(DOCUMENT).fields, *(T.StructField(c, T.StringType()) for c in CLASHING)])
    return spark.createDataFrame([(*r, *(c for c in CLASHING)) for r in _odd_rows()], schema).repartition(3)


@pytest.fixture(scope="session")
def odd_rows():
    return _odd_rows()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def words_of():
    return lambda text: re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def lowered():
    return lambda text: re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
