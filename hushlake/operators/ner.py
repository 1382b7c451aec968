"""Names from token labels: windows, decoding, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, OVERLAP = 510, 64
KINDS = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION"}


def windows(tokens: DataFrame, request: str = "request_id", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(request, window, tok_no, ...): tokens dealt to windows of ``size`` that overlap; a token may be in two.

    Windows start every size - overlap tokens, and the last one is the first to reach the end.
    """
    step = size - overlap
    tokens = tokens.withColumn("n_", F.max("tok_no").over(Window.partitionBy(request)) + 1)
    last = F.greatest(F.ceil((F.col("n_") - size) / step), F.lit(0))
    first = F.greatest(F.ceil((F.col("tok_no") - size + 1) / step), F.lit(0))
    to = F.least(F.floor(F.col("tok_no") / step), last)
    return tokens.withColumn("window", F.explode(F.sequence(first.cast("int"), to.cast("int")))).drop("n_")


_SPAN = "struct<start:int,end:int,label:string,sum:double,n:int,word:bigint>"


def decode(tokens: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, start, end, kind, score) from tokens (request, tok_no, word_id, byte_start, byte_end, tag, score).

    B opens a span; I of its kind goes on and opens one if there is none; a token of the word that the
    span ends with always goes on, even if it is tagged O. The score is the mean of tagged tokens. Overlapping spans of
    several windows are for ``dedupe``. A fold over the tokens of a request in order; spans are added once each.
    """
    fields = ["tok_no", F.col("word_id").cast("long").alias("word"), F.col("byte_start").cast("int").alias("start"), F.col("byte_end").cast("int").alias("end"), "tag", F.col("score").cast("double").alias("score")]
    rows = tokens.groupBy(request).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("toks"))
    zero = F.struct(F.array().cast(f"array<{_SPAN}>").alias("done"), F.lit(None).cast(_SPAN).alias("own"))

    def step(a: Column, t: Column) -> Column:
        own = a["own"]
        kind = F.when(t["tag"] != "O", F.substr(t["tag"], F.lit(3)))
        same = F.coalesce(own["word"] == t["word"], F.lit(False))
        goes_on = F.when(kind.isNull(), same).otherwise(same | F.coalesce(t["tag"].startswith("I-") & (own["label"] == kind), F.lit(False)))
        counts = kind.isNotNull().cast("int")

        def span(start: Column, label: Column, total: Column, n: Column) -> Column:
            return F.struct(start.alias("start"), t["end"].alias("end"), label.alias("label"), total.alias("sum"), n.alias("n"), t["word"].alias("word")).cast(_SPAN)

        longer = span(own["start"], own["label"], own["sum"] + counts * t["score"], own["n"] + counts)
        new = F.when(kind.isNotNull(), span(t["start"], kind, t["score"], F.lit(1)))
        done = F.when(own.isNotNull() & ~goes_on, F.concat(a["done"], F.array(own))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(goes_on, longer).otherwise(new).alias("own"))

    found = F.aggregate("toks", zero, step, lambda a: F.when(a["own"].isNotNull(), F.concat(a["done"], F.array(a["own"]))).otherwise(a["done"]))
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    spans = rows.select(request, F.explode(found).alias("s"))
    return spans.select(request, "s.start", "s.end", names[F.col("s.label")].alias("kind"), F.round(F.col("s.sum") / F.col("s.n"), 6).alias("score")).where("kind is not null")


def dedupe(spans: Column) -> Column:
    """Of spans (start, end, kind, score) of one kind that overlap, the one that scores more; in order of start.

    Spans are taken by start, the better first; each meets the ones kept by then, so a span that has
    lost doesn't put out others.
    """
    queue = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["score"]).alias("low"), s.alias("s")))), lambda x: x["s"])
    zero = F.slice(spans, 1, 0)

    def step(kept: Column, s: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: (k["kind"] == s["kind"]) & (k["start"] < s["end"]) & (s["start"] < k["end"])), F.lit(True)).cast("int")
        better = F.transform(kept, lambda k, i: F.when((i + 1 == hit) & (s["score"] > k["score"]), s).otherwise(k))
        return F.when(hit > 0, better).otherwise(F.concat(kept, F.array(s)))

    return F.array_sort(F.aggregate(queue, zero, step))


def best_first(spans: Column) -> Column:
    """Disjoint spans taken greedily by score, then length, then start; in order of start."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct((-s["score"]).alias("w"), (s["start"] - s["end"]).alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    kind = "array<struct<start:int,end:int,label:string,score:double>>"
    zero = F.array().cast(kind)

    def step(a: Column, s: Column) -> Column:
        one = F.array(F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label"), (-s["w"]).cast("double").alias("score")))
        return F.when(F.exists(a, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])), a).otherwise(F.concat(a, one))

    return F.array_sort(F.aggregate(keyed, zero, step))
