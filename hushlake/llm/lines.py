"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_table, release, renamed, shared_table

#: Counters of word frequency. A word counts with all words of its hash, which changes the order only, not the result.
COUNTERS = 1 << 17
#: Two words that are each on no more than this share of the square root of all words meet in few lines by chance, however many there are.
RARE = 1 / 24
#: Rows of 32 bytes, or twice as many as of 40, that are broadcast at most (8 and 21 MB, which the driver holds more than once); more are joined by a shuffle.
BROADCAST = 1 << 18
_LAST = (1 << 63) - 1
_MOST = (1 << 16) - 1
_THREE = 1 << 15
_COMMON = 1 << 56
POSITION = ["doc", "null_id", "th", "line_no"]


def _full(line: Column) -> Column:
    """Whether a line has a word; trimming its end too would walk through all of it."""
    return F.ltrim(line, F.lit(" \t\x0b\x0c\r")) != ""


def _plain(text: str) -> Column:
    """The text in lower case, with blanks for all other white space inside lines."""
    lower = blanks = F.lower(F.col(text).cast("string"))
    for x in "\t\x0b\x0c\r":
        blanks = F.replace(blanks, F.lit(x), F.lit(" "))
    found = [F.contains(F.col(text).cast("string"), F.lit(x)) for x in "\t\x0b\x0c\r"]
    return F.when(found[0] | found[1] | found[2] | found[3], blanks).otherwise(lower)


def _lines(docs: DataFrame, blank: bool = False) -> DataFrame:
    """(doc, null_id, th, line_no, line): the lines that aren't blank, or all; doc is doc_id, null last, th tells rows of one doc_id apart."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.col("doc_id").isNull().alias("null_id"), F.xxhash64("text").alias("th"), _plain("text").alias("text"))
    lines = d.select("doc", "null_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines if blank else lines.where(_full(F.col("line")))


def _counter(h: Column) -> Column:
    """The counter of a word's hash."""
    return h.bitwiseAND(F.lit(COUNTERS - 1))


def _rarity(docs: DataFrame) -> Column:
    """A literal of COUNTERS levels: how often words of a hash occur in all documents, in quarters of a binary logarithm; 0 is rare.

    Its size is fixed, whatever the documents. What counts as rare grows with the square root of the words, so that the lines
    that share two rare words by chance stay in proportion to the input.
    """
    each = docs.select(F.explode(F.split(F.replace(F.lower(F.col("text").cast("string")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    n = each.groupBy(_counter(F.xxhash64("w")).cast("int").alias("i")).count()
    level = F.least(F.floor(F.log2(F.col("count").cast("double")) * 4) + 1, F.lit(254)).cast("int")
    got, words = [0] * COUNTERS, 0
    for r in n.select("i", level.alias("level"), "count").collect():  # at most COUNTERS rows
        got[r["i"]] = r["level"]
        words += r["count"]
    rare = 4 * math.log2(max(math.sqrt(words) * RARE, 1))
    got = [min(max(x - int(rare) - 1, 0), 127) for x in got]
    return F.from_json(F.lit(json.dumps(got, separators=(",", ":"))), "array<bigint>")


def _words(line: str) -> Column:
    """The distinct words of a line, as 64-bit hashes."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _ordered(line: str, rarity: Column) -> Column:
    """The distinct words of a line, rare ones first, and among them ``_COMMON``, before the common ones: the level of the word's counter and 56 bits of its hash."""
    hashed = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    level = lambda x: F.coalesce(F.get(rarity, _counter(x)), F.lit(0).cast("long"))  # noqa: E731  # an array that can hold no null is sorted as plain longs
    code = lambda x: F.shiftleft(level(x), 56).bitwiseOR(F.shiftrightunsigned(x, 8))
    words = F.array_remove(F.array_distinct(F.transform(hashed, code)), code(F.xxhash64(F.lit(""))))
    return F.sort_array(F.concat(words, F.array(F.lit(_COMMON))))


def _parity(k: str) -> Column:
    """64 bits, each the parity of the number of words whose hash falls on it: of two lines no more bits differ than words are in one only."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))


def _prefix(n: Column, rare: Column) -> Column:
    """How many keys, rare words first, hold one that any similar line has too; ``rare`` of the n words are rare.

    A key is two neighbours if both are rare, or else three. A line of n words and a similar one of m differ in d <= (n + m) / 9
    words, of which a <= n - 4 (n + m) / 9 are in this one only. The words both have come in runs between those that only one has.
    A run without a key has one word if it ends among rare ones, else two at most, one of them rare; and a run with a key begins
    with one. So before the first key that both have there are a + d words at most if it begins with a rare one. Else there are
    a + 2 d, less one for each rare word that only one line has, and of those there are at least half of rare - 1, and rare - 1 - a.
    With m at 4/5 of n, where all of these are largest, a and d are n / 5.
    """
    ones, threes = F.floor(n * 2 / 5), F.floor((n * 6 - F.greatest(rare * 10 - 10 - n * 2, rare * 5 - 5)) / 10)
    pairs = F.least(ones + 1, F.greatest(rare, F.lit(0)))
    return F.least(F.greatest(pairs, threes + 1), F.when(rare >= n, n - 1).otherwise(n - 2)).cast("int")


def _entries(lines: DataFrame, rarity: Column, unique: bool) -> DataFrame:
    """(v, key, name, bits): a row for each of the keys, see ``_prefix``, in the beginning of each line; see ``_packed`` for v, ``_parity`` for bits.

    Lines of up to three words have equals only, so they have one key, made of all words. Of four and five words two in a row may be
    all that similar lines share, so those have their pairs besides, without places. What belongs to a line is made before
    its keys become rows, or it would be made for each of them. No line is without keys; the outer form only keeps Spark from
    inferring a filter, for which it would make the words of a line anew a dozen times.
    """
    k = lines.select(_name(unique).alias("name"), "null_id", "line_no", _ordered("line", rarity).alias("all"))
    k = k.select("name", "null_id", "line_no", (F.array_position("all", F.lit(_COMMON)) - 1).cast("int").alias("rare"), F.array_remove("all", F.lit(_COMMON)).alias("k"))
    n = F.size("k")
    m = F.greatest(_prefix(n, F.col("rare")), F.lit(0))
    n_keys = F.when(n <= 3, 1).when(n <= 5, m + n - 1).otherwise(m)
    two = F.greatest(F.least("m", F.col("rare") - 1), F.lit(0))
    k = k.select("name", "rare", "k", m.alias("m"), _packed(n).alias("v"), _parity("k").alias("bits"), n_keys.alias("n_keys"))
    e = k.select("name", "v", "bits", "m", two.alias("two"), "k", F.explode_outer(F.sequence(F.lit(0), F.col("n_keys") - 1)).alias("pos"))
    at = F.when(F.col("pos") < F.col("m"), F.col("pos")).otherwise(F.col("pos") - F.col("m"))
    next_ = lambda *i: F.xxhash64(*[F.get("k", at + x) for x in i])
    pair = (F.col("pos") < F.col("two")) | (F.col("pos") >= F.col("m"))
    e = e.withColumn("key", F.when(F.size("k") <= 3, F.xxhash64("k", F.lit(0))).when(pair, next_(0, 1)).otherwise(next_(0, 1, 2)))
    place = F.least("pos", F.lit(_THREE - 1)).bitwiseOR(F.when(F.col("pos") >= F.col("two"), F.lit(_THREE)).otherwise(F.lit(0)))
    v = F.col("v").bitwiseOR(F.when(F.col("pos") < F.col("m"), place).otherwise(F.lit(0)).cast("long"))
    return e.select(v.alias("v"), F.coalesce(F.shiftrightunsigned("key", 16), F.lit(0)).alias("key"), "name", "bits")


def _packed(n: Column) -> Column:
    """In one long: null_id as the sign, line_no in 31 bits, n, the number of words, in 16, and 16 bits free for the place, ``_THREE`` among them if the key has three words. n stops at ``_MOST``."""
    null_id = F.when(F.col("null_id"), F.lit(-1 << 63)).otherwise(F.lit(0))
    return null_id.bitwiseOR(F.shiftleft(F.col("line_no").cast("long"), 32)).bitwiseOR(F.shiftleft(F.least(n, F.lit(_MOST)).cast("long"), 16))


def _name(unique: bool, at: str = "") -> Column:
    """Names a document: its id, or the hash of its text if that is null or ids repeat."""
    null_id, th, doc = (F.col(f"{at}{c}") for c in ("null_id", "th", "doc"))
    return F.when(null_id, th).otherwise(doc) if unique else th


def _line(v: str) -> Column:
    return F.shiftright(v, 32)


def _n(v: str) -> Column:
    return F.shiftright(v, 16).bitwiseAND(F.lit(_MOST))


def _place(v: str) -> Column:
    return F.col(v).bitwiseAND(F.lit(_THREE - 1))


def _differ(x: str, y: str) -> Column:
    """Three times how many words at least are in one only of lines x and y, if the key they share there is the first they share.

    Before it, in runs of one word each, or two if the key has three words, come the words both have, and each run ends with a
    word that one line only has; so of the i + j words there a third, or a fifth, are in one line only.
    """
    nx, ny = _n(f"{x}v"), _n(f"{y}v")
    i, j = _place(f"{x}v"), _place(f"{y}v")
    before = F.when(F.col(f"{x}v").bitwiseAND(F.lit(_THREE)) == 0, i + j).otherwise(F.floor((i + j) * 3 / 5))
    before = F.greatest(before, F.abs(i - j) * 3)
    return F.greatest(before + F.abs((nx - i) - (ny - j)) * 3, F.bit_count(F.col(f"{x}bits").bitwiseXOR(F.col(f"{y}bits"))) * 3)


def _fit(x: str, y: str) -> Column:
    """Whether lines that share a key may be similar, by their numbers of words, by the words before and behind and by their bits, unless one is too long to tell.

    Similar lines fit at the first key they share, others need not.
    """
    nx, ny = _n(f"{x}v"), _n(f"{y}v")
    i, j = _place(f"{x}v"), _place(f"{y}v")
    two = (i * 3 <= nx * 2 - ny) & (j * 3 <= ny * 2 - nx)  # as in _prefix, but for these two lengths
    three = (i * 9 <= nx * 7 - ny * 2) & (j * 9 <= ny * 7 - nx * 2)
    first = F.when(F.col(f"{x}v").bitwiseAND(F.lit(_THREE)) == 0, two).otherwise(three)
    return (F.least(nx, ny) * 5 >= F.greatest(nx, ny) * 4) & ((F.greatest(nx, ny) >= _THREE) | first & (_differ(x, y) * 3 <= nx + ny))


def _firsts(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table of (h, g, n, doc, null_id, th, line_no): of equal lines, told apart by 96 bits of hashes, their number and the first."""
    h = {"h": F.xxhash64("line"), "g": F.hash("line")}
    return shared_table(_lines(docs).withColumns(h).groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct(*POSITION)).alias("at")).select("h", "g", "n", "at.*"))


def _without_copies(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The lines of docs without copies of those that have most; at most BROADCAST lines are broadcast for that.

    Copies of lines with fewer than that stay; they are similar lines like any other.
    """
    sizes = firsts.where("n > 1").groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("size")).count().collect()  # at most 63 rows
    least, total = 63, 0
    for r in sorted(sizes, reverse=True):
        if (total := total + r["count"]) > BROADCAST:
            break
        least = r["size"]
    at = F.xxhash64(*POSITION)
    most = firsts.where((F.col("n") > 1) & (F.col("n") >= 1 << min(least, 62))).select(F.col("h").alias("h_"), F.col("g").alias("g_"), at.alias("first"))
    same = (F.xxhash64("line") == F.col("h_")) & (F.hash("line").bitwiseXOR(F.col("g_")) == 0)  # an equality would be a second key, and one long takes least memory
    lines = _lines(docs).join(F.broadcast(most), same, "left")
    return lines.where(F.col("first").isNull() | (at == F.col("first"))).select(*POSITION, "line")


def _id(at: str) -> Column:
    """A line by the name of its document and v without the place."""
    return F.struct(F.col(f"{at}name").alias("name"), F.shiftright(f"{at}v", 16).alias("v"))


def _candidates(docs: DataFrame, firsts: DataFrame, unique: bool) -> tuple[DataFrame, str]:
    """The table of entries (v, key, name, bits) that share the key with one of a similar number of words, each with its place among them.

    On the way to their keys' tasks entries are three longs: the bits are folded to 24, still one for each word, beside 40 of the key.

    In ``met`` are the first of the key and the one before, if they fit, as structs (y, differ); ``more`` says whether two follow.
    """
    e = _entries(_without_copies(docs, firsts), _rarity(docs), unique)
    own_key = F.col("key").bitwiseAND(F.lit((1 << 40) - 1))
    folded = F.col("bits").bitwiseXOR(F.shiftrightunsigned("bits", 24)).bitwiseXOR(F.shiftrightunsigned("bits", 48))
    packed = F.shiftleft(folded, 40).bitwiseOR(own_key)
    e = e.select("v", "name", packed.alias("key")).repartition(own_key).select("v", own_key.alias("key"), "name", F.shiftrightunsigned("key", 40).alias("bits"))
    key = Window.partitionBy("key")  # spills where a key has many rows
    e = e.withColumn("rows", F.count("*").over(key)).where("rows > 1").drop("rows").withColumn("n", _n("v"))
    least = e.withColumns({"less": F.lag("n").over(key.orderBy("n")), "more": F.lead("n").over(key.orderBy("n"))})
    e = least.where("5 * less >= 4 * n or 5 * n >= 4 * more").select("v", "key", "name", "bits")
    own, order = F.struct("name", "v", "bits"), key.orderBy(F.col("v") < 0, "name", "v")
    e = e.withColumns({"first": F.first(own).over(order), "last": F.lag(own).over(order), "place": F.row_number().over(order), "more": F.lead("v", 2).over(order).isNotNull()})
    met = [F.when((F.col("place") > after) & _fit("", f"{y}."), F.struct(_id(f"{y}.").alias("y"), _differ("", f"{y}.").alias("differ"))) for after, y in ((1, "first"), (2, "last"))]
    return shared_table(e.select("v", "key", "name", "bits", "place", "more", F.array_compact(F.array(*met)).alias("met")))


def _met(e: DataFrame) -> DataFrame:
    """(x, y, differ): each line with the first of its key and the one before it, if they fit."""
    return e.select(_id("").alias("x"), F.explode("met").alias("m")).select("x", "m.y", "m.differ")


def _worded(docs: DataFrame, ids: DataFrame, n: int, unique: bool) -> DataFrame:
    """(name, line_no, at, w, s): positions, words and sketches, see ``_sketch``, of the n lines of ids (name, line_no)."""
    small = F.broadcast if n <= BROADCAST else lambda df: df
    name = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")) if unique else F.xxhash64("text")
    some = docs.select("doc_id", "text", name.alias("name")).join(small(ids.select("name").distinct()), "name", "left_semi")
    lines = _lines(some, blank=True).withColumn("name", _name(unique)).join(small(ids), ["name", "line_no"], "left_semi")  # none of ids is blank
    lines = lines.select("name", "line_no", F.struct(*POSITION).alias("at"), _words("line").alias("w"))
    if not unique or not docs.where("doc_id is null").isEmpty():  # else no line comes twice
        lines = lines.distinct()
    return cut(lines.withColumn("s", _sketch("w")))


def _sketch(w: str) -> Column:
    """The number of words, and 128 bits, each the parity of the number of words whose hash falls on it."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    half = lambda i: F.aggregate(F.filter(w, lambda x: F.getbit(x, F.lit(6)) == i), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))
    return F.struct(F.size(w).alias("n"), half(0).alias("a"), half(1).alias("b"))


def _may_be_alike(x: str, y: str) -> Column:
    """Whether lines with sketches x and y may be similar: no more bits differ than words are in one only, and those are a ninth of all at most."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    differ = lambda c: F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    return (F.least(f"{x}.n", f"{y}.n") * 5 >= F.greatest(f"{x}.n", f"{y}.n") * 4) & ((differ("a") + differ("b")) * 9 <= n)


def _alike(x: str, y: str) -> Column:
    return F.size(F.array_intersect(x, y)) * 9 >= (F.size(x) + F.size(y)) * 4


def _only(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of lines whose (name, line_no) are among ids; it counts them first, to shuffle no words that none asks for."""
    ids = cut(ids.distinct())
    return lines.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, ["name", "line_no"], "left_semi")


def _rest(docs: DataFrame, left: DataFrame, e: DataFrame, unique: bool) -> DataFrame | None:
    """The positions of the lines of left that an earlier line of e resembles, beyond the first of a key and the one before; None if no two fit.

    Pairs are never made: of the entries those are taken that fit with any other, first of left, then of e, they get their
    lines' words, and an entry of left is looked up until an earlier line is found that is similar.
    """
    side = lambda some, c: some.select(F.col("key").alias(f"key_{c}"), F.struct("name", "v", "bits", "place").alias(c))
    x_after, y_before = ("place > 3", "place > 1 and more") if unique else ("place > 1 and (place > 3 or more)",) * 2

    def meet(x: str) -> Column:
        apart = F.col(f"{x}place") - F.col("y.place")
        return (F.col("key_x") == F.col("key_y")) & ((apart if unique else F.abs(apart)) > 1) & _fit(x, "y.")

    e = e.where(y_before)
    x = cut(side(left.where(x_after), "x").join(side(e, "y"), meet("x."), "left_semi"))
    flat = x.select("key_x", *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("v", "bits", "place")])
    y = cut(side(e, "y").join(F.broadcast(flat) if x.count() <= 2 * BROADCAST else flat, meet("x_"), "left_semi"))
    line_no = lambda c: _line(f"{c}.v").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("line_no")
    ids = cut(x.select("x.name", line_no("x")).union(y.select("y.name", line_no("y"))).distinct())
    n = ids.count()
    if not n:
        return None
    lines = _worded(docs, ids, n, unique)
    brief = lines.select("name", "line_no", "at", "s")
    known = lambda some, c: some.select(f"key_{c}", F.struct(f"{c}.v", f"{c}.bits").alias(c), F.col(f"{c}.name").alias("name"), line_no(c)).join(brief, ["name", "line_no"])
    known_as = lambda some, c: some.select(f"key_{c}", c, F.struct("name", "line_no").alias(f"id_{c}"), F.col("at").alias(f"at_{c}"), F.col("s").alias(f"s_{c}"))
    earlier = (F.col("key_x") == F.col("key_y")) & (F.col("at_y") < F.col("at_x")) & _fit("x.", "y.") & _may_be_alike("s_x", "s_y")
    x, y = (known_as(known(some, c), c) for some, c in ((x, "x"), (y, "y")))
    x = cut(x.join(y, earlier, "left_semi"))
    y = cut(y.join(x, earlier, "left_semi"))
    lines = _only(lines, x.select("id_x.*").union(y.select("id_y.*"))).select(F.struct("name", "line_no").alias("id"), "at", "w")
    worded = lambda some, c: some.join(lines.select(F.col("id").alias(f"id_{c}"), F.col("at").alias(f"at_{c}"), F.col("w").alias(f"w_{c}")), [f"id_{c}", f"at_{c}"])
    return cut(worded(x, "x").join(worded(y, "y"), earlier & _alike("w_x", "w_y"), "left_semi").select("at_x.*").distinct())


def _similar(docs: DataFrame, pairs: DataFrame, unique: bool) -> DataFrame | None:
    """The positions of the later lines of those pairs (x, y, near) whose Jaccard similarity is 4/5 or more; None if there are no pairs.

    x and y are structs of name and v without the place. The most promising pair of each x, that with most of ``near``, is tried first,
    the rest only for those x that aren't gone by then, if x is known to be the later one.
    """
    line = lambda side: F.struct(F.col(f"{side}.name").alias("name"), F.shiftright(f"{side}.v", 16).bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("line_no"))
    pairs = cut(pairs.select(line("x").alias("x"), line("y").alias("y"), "near"))
    ids = cut(pairs.select("x.*").union(pairs.select("y.*")).distinct())
    n = ids.count()
    if not n:
        return None
    lines = _worded(docs, ids, n, unique)
    brief = lambda c: lines.select(F.struct("name", "line_no").alias(c), F.col("at").alias(f"at_{c}"), F.col("s").alias(f"s_{c}"))
    pairs = pairs.join(brief("x"), "x").join(brief("y"), "y").where((F.col("at_x") != F.col("at_y")) & _may_be_alike("s_x", "s_y"))
    pairs = cut(pairs.select("x", "y", "near").distinct())
    side = lambda some, c: some.select(F.struct("name", "line_no").alias(c), F.col("at").alias(f"at_{c}"), F.col("w").alias(f"w_{c}"))
    later = F.when(F.col("at_x") > F.col("at_y"), F.col("at_x")).otherwise(F.col("at_y"))

    def found(some: DataFrame) -> DataFrame:
        some = cut(some)
        words = _only(lines, some.select("x.*").union(some.select("y.*")))
        both = some.join(side(words, "x"), "x").join(side(words, "y"), "y").where((F.col("at_x") != F.col("at_y")) & _alike("w_x", "w_y"))
        return cut(both.select(later.alias("at")).distinct().select("at.*"))

    early = found(pairs.groupBy("x").agg(F.max_by("y", F.struct("near", "y")).alias("y")))
    gone = early.select(F.struct(_name(unique).alias("name"), "line_no").alias("x"))
    late = found(pairs.join(F.broadcast(gone) if n <= BROADCAST else gone, "x", "left_anti") if unique else pairs)
    return early.union(late).distinct()


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no) of the lines that stay, but for blank ones, which always stay.

    A line goes if an earlier one, by doc_id (null last), hash of the text and number, has the same
    words up to a Jaccard similarity of 4/5; case doesn't count. Words are compared by 64-bit hashes.
    First, equal lines become one. The keys of the join are pairs of neighbours in the beginnings of
    lines, rare words first, which hardly any lines share that aren't similar; lengths, places and parities of words must fit
    as they do at the first that two similar lines share. Before all lines of a key meet, each line meets the first and the last one before
    it; that settles most lines of large groups of near copies. The others are looked up, and pairs of them are never made.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    unique = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    firsts, of_firsts = _firsts(docs)
    e, of_e = _candidates(docs, firsts, unique)
    release(spark)

    near = F.struct((-F.min("differ")).alias("differ"), F.count("*").alias("count")).alias("near")  # most of it has the pair that differs least
    early = _similar(docs, _met(e).groupBy("x", "y").agg(near), unique)
    release(spark)

    left = e
    if early is not None and unique:  # then the places are those of the documents, so that x is the later of each pair
        gone = early.select(_name(unique).alias("name_"), F.col("line_no").alias("line_"))
        gone = F.broadcast(gone) if gone.count() <= BROADCAST else gone
        left = e.join(gone, (F.col("name") == F.col("name_")) & (_line("v").bitwiseAND(F.lit((1 << 31) - 1)) == F.col("line_")), "left_anti")
    late = _rest(docs, left, e, unique)

    lines = firsts.select(*POSITION)
    for found in (early, late):
        if found is not None:
            lines = lines.join(found, POSITION, "left_anti")
    kept = cut(lines.select(F.when(~F.col("null_id"), F.col("doc")).alias("doc_id"), "th", "line_no"))
    drop_table(spark, of_firsts)
    drop_table(spark, of_e)
    release(spark)
    return kept


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_blank, removed): for each document the numbers, from 0, of the lines that go.

    A null text has no line. Rows equal in doc_id and text are treated alike: both keep the same lines.
    """
    kept = kept_lines(docs).groupBy("doc_id", "th").agg(F.collect_list("line_no").alias("kept"))
    lines = F.split(F.col("text"), "\n")
    full = F.filter(F.transform(lines, lambda l, i: F.when(_full(l), i)), lambda i: i.isNotNull())
    own = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), F.coalesce(F.size(lines), F.lit(0)).alias("n"), full.alias("full"))
    own = own.withColumn("n_lines", F.greatest("n", F.lit(0)))
    out = own.join(kept, own["id"].eqNullSafe(kept["doc_id"]) & (own["own"] == kept["th"]), "left")
    gone = F.array_except(F.coalesce("full", F.array().cast("array<int>")), F.coalesce("kept", F.array().cast("array<int>")))
    return out.select(F.col("id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.coalesce(F.size("full"), F.lit(0))).alias("n_blank"), F.sort_array(gone).alias("removed"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that stay as text and n_chars to match; a document all of whose lines went goes, one that had none stays."""
    kept = kept_lines(docs).groupBy("doc_id", "th").agg(F.collect_list("line_no").alias("kept"))
    rows, names = renamed(docs)
    doc_id, text = (rows[f"c{docs.columns.index(c)}"] for c in ("doc_id", "text"))
    out = rows.join(kept, doc_id.eqNullSafe(kept["doc_id"]) & (F.xxhash64(text) == kept["th"]), "left")
    stays = F.filter(F.split(text, "\n"), lambda l, i: ~_full(l) | F.array_contains(F.coalesce("kept", F.array().cast("array<int>")), i))
    had = F.coalesce(text.rlike("[^ \t\x0b\x0c\r\n]"), F.lit(False))
    out = out.where(~had | F.col("kept").isNotNull()).withColumn("left", F.array_join(stays, "\n"))
    changed = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    return out.select(*[changed.get(c, F.col(k)).alias(c) for k, c in names.items()])
