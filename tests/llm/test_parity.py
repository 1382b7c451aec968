"""The filter by parities of words in line deduplication: it takes chance pairs out of the join and no similar ones."""

import random

from pyspark.sql import functions as F

from hushlake.llm import lines


def test_chance_pairs_are_not_made(spark):
    rng = random.Random(8)
    common = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(common, 30))) for i in range(300)]
    near = [(1000 + i, " ".join(t.split()[: -(i % 4)] if i % 4 else t.split()) + " extra") for i, t in rows[:40]]
    docs = spark.createDataFrame(rows + near, "doc_id long, text string").repartition(4)
    e = lines._entries(lines._lines(docs), lines._rarity(docs), True).cache()
    x, y = (e.select(F.col("key").alias(f"key_{c}"), F.struct("name", "v", "bits").alias(c)) for c in "xy")
    made = x.join(y, (F.col("key_x") == F.col("key_y")) & (F.col("x.name") > F.col("y.name")) & lines._fit("x.", "y."))
    got = {(r[0], r[1]) for r in made.select("x.name", "y.name").distinct().collect()}
    words = {i: set(t.split()) for i, t in rows + near}
    all_ = [(a, b) for a in words for b in words if a > b]
    similar = {(a, b) for a, b in all_ if 9 * len(words[a] & words[b]) >= 4 * (len(words[a]) + len(words[b]))}
    assert len(similar) >= 40 and similar <= got
    assert len(got - similar) < 0.02 * len(all_)
    bits = {r["name"]: r["bits"] for r in e.select("name", "bits").distinct().collect()}
    assert all(bin((bits[a] ^ bits[b]) & (2**64 - 1)).count("1") <= len(words[a] ^ words[b]) for a, b in all_)
