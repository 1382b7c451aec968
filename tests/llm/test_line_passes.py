"""What each pass over lines costs: blanks are found from the left, words are made distinct once."""

import re

from pyspark.sql import functions as F

from hushlake.llm import lines


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blank_lines_are_found_from_the_left(spark):
    """Before, each line was walked through to its end and back."""
    odd = ["", " ", "\t\x0b\x0c\r ", " a", "a ", " ", "\r\n x", " ", "é"]
    df = spark.createDataFrame([("\n".join(odd), 1)], "text string, doc_id long")
    got = lines._lines(df)
    assert re.search(r"\bltrim\(", plan(got)) and not re.search(r"\btrim\(", plan(got))
    each = "\n".join(odd).split("\n")
    assert sorted(r["line_no"] for r in got.collect()) == [i for i, x in enumerate(each) if x.strip(" \t\x0b\x0c\r")]


def test_words_are_made_distinct_once(spark):
    """Before, their hashes were, and then their codes."""
    df = spark.createDataFrame([("b a  a c ",), ("",)], "line string")
    got = df.select(lines._ordered("line", F.from_json(F.lit("[" + "0," * (lines.COUNTERS - 1) + "0]"), "array<bigint>")).alias("all"))
    assert plan(got).count("array_distinct(") == 1
    assert [len(r["all"]) for r in got.collect()] == [4, 1]
