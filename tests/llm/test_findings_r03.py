"""What the findings of round 3 name in the training-data operators."""

import random

from redactory.llm import _common, substring_dedup


def test_substring_dedup_shuffles_texts_once(spark, monkeypatch):
    """Where what was found is too large to broadcast, it comes to the texts: no join shuffles them again."""
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(70))
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(90)) + f" {passage}" * (k % 2) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = sorted(map(tuple, substring_dedup.substring_dedup(docs).collect()))
    assert sum(row[2] for row in expected) == 9 * 70
    plain, plans = _common.stored, {}

    def spy(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name, **options)

    monkeypatch.setattr(_common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(substring_dedup, "stored", spy)
    out = substring_dedup.substring_dedup(docs)
    assert sorted(map(tuple, out.collect())) == expected
    for name in ("substring-13", "substring-25", "substring-last"):
        assert plans[name].count("Exchange") == 1, plans[name]
