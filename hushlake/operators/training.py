"""Training data for name models: samples, checks, splits, labels, scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ner import best_first

SAMPLE = "text string, entities array<struct<start:int,end:int,label:string>>"
TEMPLATES = [
    "{PER} works for {ORG} in {LOC}.",
    "Please send the contract of {ORG} to {PER}.",
    "{PER} hat gestern bei {ORG} angerufen.",
    "Die Reise nach {LOC} bucht {PER}.",
    "{ORG} opened an office in {LOC}.",
    "In {LOC} traf {PER} den Vorstand von {ORG}.",
]
NAMES = {
    "PER": ["Anna Weber", "John Miller", "Lena Fischer", "Omar Haddad", "Maria Rossi", "Peter Novak"],
    "ORG": ["Nordlicht AG", "Acme Ltd", "Baumann GmbH", "Blue River Inc", "Hansa Bank"],
    "LOC": ["Hamburg", "Leeds", "Zürich", "Porto", "Lyon", "Graz", "Köln"],
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as (line, text, entities, error); blank lines are left out, what doesn't parse has a null text."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = rows.select("value", F.from_json("value", SAMPLE).alias("s"))
    return validate(parsed.select(F.col("value").alias("line"), "s.text", "s.entities"))


def write(samples: DataFrame, path: str) -> None:
    samples.select(F.to_json(F.struct("text", "entities")).alias("value")).write.mode("overwrite").text(path)


def annotate(lines: DataFrame, find: Callable[[str], list[tuple[int, int, str, float]]], kinds: dict[str, str], threshold: float = 0.35) -> DataFrame:
    """(text, entities) of the lines (text) that aren't blank, labelled by a model.

    ``find`` gives (start, end, kind, score); kinds are renamed, others and scores below the threshold left
    out. Of spans that overlap the one that scores more stays, of equal ones the longer.
    """

    @F.pandas_udf("array<struct<start:int,end:int,label:string,score:double>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "label": kinds[k], "score": score} for s, e, k, score in find(t) if k in kinds and score >= threshold] for t in texts])

    found = lines.where(F.col("text").rlike(r"\S")).select("text", run("text").alias("found"))
    return found.select("text", F.transform(best_first(F.col("found")), lambda s: s.dropFields("score")).alias("entities"))


def problem(text: Column, entities: Column, labels: list[str] | None = None) -> Column:
    """The first thing wrong with a sample; null if nothing is."""
    ordered = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"))))
    overlap = F.exists(F.transform(ordered, lambda e, i: F.struct(e.alias("e"), F.get(ordered, i + 1).alias("next"))), lambda p: F.coalesce(p["next"]["start"] < p["e"]["end"], F.lit(False)))
    bad = lambda f: F.exists(entities, f)
    out = F.when(text.isNull(), "no text").when(entities.isNull(), "no entities")
    out = out.when(bad(lambda e: e["start"].isNull() | e["end"].isNull() | e["label"].isNull()), "field missing")
    out = out.when(bad(lambda e: (e["start"] < 0) | (e["end"] > F.length(text))), "out of range").when(bad(lambda e: e["start"] >= e["end"]), "empty")
    if labels:
        out = out.when(bad(lambda e: ~e["label"].isin(labels)), "unknown label")
    return out.when(overlap, "overlap")


def validate(samples: DataFrame, labels: list[str] | None = None) -> DataFrame:
    return samples.withColumn("error", problem(F.col("text"), F.col("entities"), labels))


def split(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``rows`` with part: "eval" for the round(n * share) rows first by hash, one at least, leaving one to train on at least.

    The cut is found by counting rows in parts of the hash space, so no task sorts all rows: only
    the part that holds the cut is ranked.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    marked = rows.withColumn("h_", h).withColumn("p_", F.shiftrightunsigned("h_", 52))
    n = rows.count()
    wanted = min(max(1, int(n * share + 0.5)), n - 1) if n > 1 else 0
    parts = marked.groupBy("p_").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("p_", before.alias("before_"))  # 4096 rows at most
    rank = F.row_number().over(Window.partitionBy("p_").orderBy("h_", key))
    out = marked.join(F.broadcast(parts), "p_").withColumn("part", F.when(F.col("before_") + rank <= wanted, "eval").otherwise("train"))
    return out.drop("h_", "p_", "before_")


def bio_labels(types: list[str]) -> list[str]:
    return ["O"] + [f"{b}-{t}" for t in types for b in "BI"]


def align(samples: DataFrame, special: str = "special") -> DataFrame:
    """``samples`` (entities, tokens of start, end, word_id) with labels: -100 for special tokens (no word, or no place) and for all tokens of an entity but the one that holds its start, which has B; else O."""

    def label(t: Column) -> Column:
        by_start = F.array_sort(F.filter("entities", lambda e: (e["start"] < t["end"]) & (t["start"] < e["end"])))
        own = F.get(by_start, F.lit(0))
        nowhere = t["word_id"].isNull() | ((t["start"] == 0) & (t["end"] == 0))
        return F.when(nowhere, "-100").when(own.isNull(), "O").when(t["start"] <= own["start"], F.concat(F.lit("B-"), own["label"])).otherwise("-100")

    return samples.withColumn("labels", F.transform("tokens", label))


def score(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 by label of whole entities: rows (keys, start, end, label)."""
    cols = [*keys, "start", "end", "label"]
    g = gold.select(cols).distinct().withColumn("g", F.lit(1))
    p = found.select(cols).distinct().withColumn("p", F.lit(1))
    both = g.join(p, cols, "full").groupBy("label").agg(F.count("g").alias("support"), F.count("p").alias("predicted"), F.count(F.col("g") + F.col("p")).alias("hits"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = both.withColumn("precision", ratio("hits", "predicted")).withColumn("recall", ratio("hits", "support"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def synthesize(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(id, text, entities): n samples from templates, the same for a seed, with the places of the names."""

    def choose(what: list[str], salt: int) -> Column:
        return F.get(F.array(*map(F.lit, what)), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(what))).cast("int"))

    rows = spark.range(n).withColumn("text", choose(TEMPLATES, 0))
    for i, (label, names) in enumerate(NAMES.items()):
        rows = rows.withColumn(label, choose(names, i + 1))
    for label in NAMES:
        rows = rows.withColumn("text", F.replace("text", F.lit("{%s}" % label), F.col(label)))
    found = F.array(*[F.struct((F.instr("text", F.col(x)) - 1).alias("start"), (F.instr("text", F.col(x)) - 1 + F.length(x)).alias("end"), F.lit(x).alias("label")) for x in NAMES])
    return rows.select("id", "text", F.array_sort(F.filter(found, lambda e: e["start"] >= 0)).alias("entities"))
