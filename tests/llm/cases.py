"""Small tables that hold what operators must stand: nulls, empty and long texts, repeated rows, clashing names."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["id", "n", "h", "key", "keys", "rep", "comp", "k1", "k2", "p", "item", "stats", "label", "score", "posterior", "pattern",
            "cost", "u", "epoch", "block", "spans", "assign", "kind", "canon", "new", "attempt", "host", "bad", "mean", "curl", "found"]


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def odd_texts(rng: random.Random) -> list[str | None]:
    text = words(rng, 60)
    return [None, "", " \n\t ", "one", "two words", "É ñ ß 漢字 𝒳   end", text, text, text.upper(), "a" * 30_000, words(rng, 20_000)]


def documents(spark, texts: list[str | None], clashing: bool = True, ids: list[int | None] | None = None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", None if k % 7 == 3 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, DOCUMENTS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHING})
    return df


def empty(spark, schema: str = DOCUMENTS):
    return spark.createDataFrame([], schema)
