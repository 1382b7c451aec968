"""What is compared before words are: sketches of lines, and arrays of words that are sorted as plain longs."""

import random

from pyspark.sql import functions as F

from hushlake.llm import lines


def test_words_are_sorted_as_longs(spark):
    """An array that might hold nulls is sorted as objects; before, that of a line's words was one."""
    df = spark.createDataFrame([("b a a c",)], "line string")
    got = df.select(lines._ordered("line", F.from_json(F.lit("[" + "0," * (lines.COUNTERS - 1) + "0]"), "array<bigint>")).alias("all"))
    assert got.schema["all"].dataType.containsNull is False
    (all_,) = got.first()
    assert len(all_) == 4 and all_ == sorted(all_) and all_[-1] == lines._COMMON


def test_sketches_keep_similar_lines_and_part_others(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        n = rng.randint(1, 120)
        x = [f"a{i}x{j}" for j in range(n)]
        common = x[: rng.randint(0, n)] if i % 2 else x[: n - n // 9]
        y = common + [f"b{i}x{j}" for j in range(rng.randint(0, 2) if i % 2 else n // 9)] or ["z"]
        rows.append((" ".join(x), " ".join(y)))
    df = spark.createDataFrame(rows, "x string, y string").select(lines._words("x").alias("w"), lines._words("y").alias("v"))
    df = df.withColumns({"s": lines._sketch("w"), "t": lines._sketch("v")})
    got = df.select(lines._alike("w", "v").alias("alike"), lines._may_be_alike("s", "t").alias("may")).collect()
    assert all(r["may"] for r in got if r["alike"]) and sum(r["alike"] for r in got) >= 100
    assert sum(r["may"] for r in got if not r["alike"]) < 20
