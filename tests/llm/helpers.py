"""Fixtures shared by the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Extra columns whose names the operators use inside.
CLASHING = {"block": 1, "signature": "x", "spans": "s", "kept": False, "rank": 2, "scope": "t", "id": 3, "component": 4, "length": 5, "bands": "b"}


def odd_rows(seed=1, n=60):
    """Documents with nulls, empty, one-word, long and repeated texts, ties."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["The", "of", "and", "é", "漢字"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (4, " \n\t ", "en", "b", 4), (5, text(4), "en", "b", 0)]
    passage = text(20)
    for i in range(n):
        body = text(rng.choice([5, 12, 30, 80]))
        rows.append((10 + i, body if i % 3 else f"{body}\n{passage}\n{text(6)}", rng.choice(["en", "de", None]), rng.choice(["a", "b"]), len(body)))
    copied = text(60)
    rows += [(200 + i, copied, "en", "a", len(copied)) for i in range(4)]
    words = copied.split()
    rows += [(220 + i, " ".join([*words[: 20 + i], "changed", *words[21 + i :]]), "en", "a", 0) for i in range(4)]
    rows.append((300, text(6000), "de", "c", 0))
    rows += [rows[-1], rows[7]]  # repeated rows
    return rows


def odd_docs(spark, **kw):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(**kw), SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
