"""The vault: a persistent table of entities, found by a blind index, values encrypted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import hmac_sha256, subkey
from .detect import values
from .pseudonymize import restore
from .spans import rewrite

CHECK = "vault key check"


@dataclass
class Vault:
    """Keys of a vault: ``key`` is 32 bytes, ``salt`` is drawn once for a vault so that two vaults of one key can't be linked."""

    key: bytes
    salt: bytes

    def __post_init__(self) -> None:
        if len(self.key) != 32:
            raise ValueError("the key must have 32 bytes")
        self.encryption, self.index = subkey(self.key, "enc"), subkey(self.key, "idx")

    def blind(self, kind: Column, value: Column) -> Column:
        return hmac_sha256(self.index, F.concat(kind.cast("binary"), F.lit(bytearray(b"\0")), value.cast("binary")))

    def suffix(self, kind: Column, value: Column, attempt: Column | None = None) -> Column:
        """A decimal of 19 or 20 digits, the top bit set, from a keyed hash: the same on every retry of a task, and nothing without the key."""
        extra = F.lit(bytearray(self.salt + b"tok"))
        parts = [extra, kind.cast("binary"), F.lit(bytearray(b"\0")), value.cast("binary")]
        if attempt is not None:
            parts.append(F.when(attempt > 0, F.concat(F.lit(bytearray(b"\0")), attempt.cast("string").cast("binary"))).otherwise(F.lit(bytearray(b""))))
        h = hmac_sha256(self.index, F.concat(*parts))
        top = F.lower(F.hex(F.conv(F.substr(h, F.lit(1), F.lit(1)), 16, 10).cast("int").bitwiseOR(F.lit(8))))
        return F.conv(F.concat(top, F.substr(h, F.lit(2), F.lit(15))), 16, 10)

    def encrypt(self, value: Column) -> Column:
        return F.aes_encrypt(value.cast("binary"), F.lit(bytearray(self.encryption)), F.lit("GCM"))

    def decrypt(self, blob: Column) -> Column:
        return F.try_aes_decrypt(blob, F.lit(bytearray(self.encryption)), F.lit("GCM")).cast("string")

    def assign(self, found: DataFrame, known: DataFrame | None = None, now: int = 0) -> DataFrame:
        """Rows to append for the (prefix, value) of ``found`` that ``known`` lacks: kind, value_hmac, placeholder, value_enc, created_unix.

        A placeholder that two values share is drawn anew for all but the first, by index.
        """
        from pyspark.sql import Window

        new = found.select("prefix", "value").distinct().withColumn("value_hmac", self.blind(F.col("prefix"), F.col("value")))
        if known is not None:
            new = new.join(known.select(F.col("kind").alias("prefix"), "value_hmac"), ["prefix", "value_hmac"], "left_anti")
        first = self.suffix(F.col("prefix"), F.col("value"))
        n = F.row_number().over(Window.partitionBy("prefix", "suffix").orderBy("value_hmac")) - 1
        new = new.withColumn("suffix", first).withColumn("again", n)
        new = new.withColumn("suffix", F.when(F.col("again") > 0, self.suffix(F.col("prefix"), F.col("value"), F.col("again"))).otherwise(F.col("suffix")))
        return new.select(F.col("prefix").alias("kind"), "value_hmac", F.concat("prefix", F.lit("_"), "suffix").alias("placeholder"), self.encrypt(F.col("value")).alias("value_enc"), F.lit(now).cast("long").alias("created_unix"))

    def lookup(self, tokens: DataFrame, entities: DataFrame) -> DataFrame:
        """``tokens`` (token) with value; null if the vault hasn't it."""
        own = entities.select(F.col("placeholder").alias("token"), self.decrypt(F.col("value_enc")).alias("value"))
        return tokens.join(own, "token", "left")

    def hide(self, docs: DataFrame, entities: DataFrame, request: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` (with spans) and their text rewritten as ``hidden`` with the vault's placeholders; a value that it hasn't stays."""
        found = values(docs, text).withColumn("value_hmac", self.blind(F.col("prefix"), F.col("value")))
        known = found.join(entities.select(F.col("kind").alias("prefix"), "value_hmac", "placeholder"), ["prefix", "value_hmac"])
        tokens = known.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("placeholder").alias("token")))).alias("tokens"))
        out = docs.join(tokens, request, "left")
        return out.withColumn("hidden", F.when(F.col("tokens").isNull(), F.col(text)).otherwise(rewrite(F.col(text), F.col("tokens")))).drop("tokens")

    def meta(self, spark) -> DataFrame:
        return spark.range(1).select(self.encrypt(F.lit(CHECK)).alias("key_check"), F.lit(1).alias("schema_version"))

    def verify(self, meta: DataFrame) -> None:
        """Before any job: whether this is the vault's key."""
        if meta.select(self.decrypt(F.col("key_check")).alias("c")).first()["c"] != CHECK:
            raise ValueError("the vault has another key")


def restore_with_store(texts: DataFrame, vault: Vault, entities: DataFrame, key: str, text: str) -> DataFrame:
    """``texts`` (key, text) with ``restored``: placeholders that the vault knows replaced, others kept.

    Texts are cut at placeholders, which are joined to the vault by equality and put together again.
    """
    from ..functions.checks import MARK_CLOSE, MARK_OPEN
    from ..functions.patterns import TOKEN

    marked = F.regexp_replace(text, TOKEN, f"{MARK_OPEN}$1{MARK_OPEN}")
    parts = texts.select(key, F.posexplode(F.split(marked, MARK_OPEN)).alias("n", "part"))
    known = vault.lookup(parts.where("n % 2 = 1").select(F.col("part").alias("token")).distinct(), entities).where("value is not null")
    joined = parts.join(known, (F.col("part") == F.col("token")) & (F.col("n") % 2 == 1), "left")
    whole = joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("value", "part").alias("s")))), lambda x: x["s"]), "").alias("restored"))
    return texts.join(whole, key, "left")


def restore_two_pass(texts: DataFrame, own: DataFrame, vault: Vault, entities: DataFrame, key: str, text: str) -> DataFrame:
    """``texts`` (key, text) with ``restored``: first the request's own placeholders by its map, then those of past requests by the vault."""
    first = restore(texts, own, key, text).withColumnRenamed("restored", "first_")
    return restore_with_store(first, vault, entities, key, "first_").drop("first_")


def size(entities: DataFrame) -> DataFrame:
    """(entities, empty): how many a vault holds."""
    return entities.agg(F.count("*").alias("entities")).withColumn("empty", F.col("entities") == 0)
