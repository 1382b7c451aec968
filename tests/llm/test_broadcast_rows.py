"""What lines broadcast are rows of few longs, keyed by one."""

import re

from hushlake.llm import lines


def test_copies_are_broadcast_by_one_long(spark):
    docs = spark.createDataFrame([(i, f"same line\nown {i}") for i in range(20)], "doc_id long, text string")
    out = lines._without_copies(docs, lines._firsts(docs)[0])
    assert out.count() == 21
    keys = re.findall(r"HashedRelationBroadcastMode\((.*)", out._jdf.queryExecution().executedPlan().toString())
    assert keys and all(re.findall(r"input\[\d+, (\w+)", k) == ["bigint"] for k in keys)
