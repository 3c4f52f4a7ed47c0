"""Benchmark decontamination with DataFrame functions only.

Every window of ten consecutive benchmark words is hashed; the set of windows is
broadcast while it is small (its rows are counted first) and joined by shuffle
beyond that.  Documents are scanned once: each word is hashed once, and at each word
the hash of the LEAD words from there is looked up in a bitmap of the windows' first
words.  Only where it is set are the window hashes of all lengths made, exploded and
joined, and a hit counts only if the words agree.  What leaves the scan are hits, so
shuffles grow with contamination and not with the corpus.

Defined cases: a null or empty text has no words and is clean; a benchmark item
with fewer than ten words is one window of its own length, one without words is
none; the words of a benchmark item without item_id are hits, but it is not counted or
listed among the items; repeated documents are judged alike, each row by itself; an
empty benchmark leaves all clean; a text is held whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import keyed, order_key, without
from .scratch import Scratch

WINDOW = 10
#: Words at the head of a window that the bitmap knows.
LEAD = 4
#: Broadcast the windows up to this many (about 150 bytes each), else shuffle.
MAX_BROADCAST_WINDOWS = 200_000
#: Bits of the bitmap for each head of a window, and the most in all (a literal of 10 MB).
BITS, MAX_BITS = 32, 1 << 25

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _inner(parts: Column) -> Column:
    """Parts without the empty strings that a split leaves at either end."""
    head = (F.element_at(parts, 1) == "").cast("int")
    tail = (F.element_at(parts, -1) == "").cast("int")
    return F.when(F.size(parts) == 1, F.filter(parts, lambda w: w != "")).otherwise(F.slice(parts, head + 1, F.size(parts) - head - tail))


def with_words(df: DataFrame, text: str = "text", lower: bool = True) -> DataFrame:
    """Add ``words``, the array of normalised words of a text column."""
    value = F.coalesce(F.col(text), F.lit(""))
    value = lower_ascii(value) if lower else value
    return df.withColumn("parts", F.split(value, _OUTSIDE if lower else r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).withColumn("words", _inner(F.col("parts"))).drop("parts")


def _hash(hashes: Column | str) -> Column:
    """The hash of a run of words from their hashes."""
    return F.xxhash64(hashes)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each item and window: item_id, length, gram, head, h, window_id."""
    items = with_words(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")).where(F.size("words") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (size - 1))))
    grams = items.select("item_id", F.least(F.lit(size), F.size("words")).alias("length"), at.alias("at"), "words")
    grams = grams.select("item_id", "length", F.slice("words", F.col("at"), F.col("length")).alias("gram"))
    grams = grams.withColumn("hashes", F.transform("gram", lambda w: F.xxhash64(w)))
    return grams.select("item_id", "length", "gram", _hash(F.slice("hashes", 1, LEAD)).alias("head"), _hash("hashes").alias("h"), F.md5(F.array_join("gram", " ")).alias("window_id"))


def _bitmap(heads: DataFrame) -> tuple[Column, int]:
    """A Bloom filter with one probe over the windows' heads, as a literal.

    Its size follows the number of heads up to MAX_BITS; a fuller filter lets more
    candidates pass, which the join then decides.
    """
    heads = heads.distinct()
    bits = 1 << max(6, min(MAX_BITS, BITS * heads.count()).bit_length())
    at = F.pmod("head", F.lit(bits))
    rows = heads.select(F.shiftright(at, 6).alias("i"), F.expr(f"shiftleft(1L, CAST(pmod(head, {bits}) % 64 AS INT))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).collect()  # at most bits / 64 rows
    longs = [0] * (bits // 64)
    for r in rows:
        longs[r["i"]] = r["b"]
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>"), bits


def _set_in(bitmap: Column, bits: int, head: Column) -> Column:
    at = F.pmod(head, F.lit(bits))
    return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1


def _places(heads: Column, bitmap: Column, bits: int) -> Column:
    return F.array_compact(F.transform(heads, lambda x, i: F.when(_set_in(bitmap, bits, x), i)))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, work: Scratch | None = None) -> DataFrame:
    """Where benchmark windows occur: ord, fp, pos (from 0), length, window_id.

    A window that several items have is reported once for each position.
    """
    work = work or Scratch(docs.sparkSession, "decontaminate")
    grams = work.save(windows(benchmark, size), "windows").drop("item_id").dropDuplicates(["window_id"])
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect())  # at most ``size`` numbers
    n = grams.limit(MAX_BROADCAST_WINDOWS + 1).count()
    hashed = with_words(keyed(docs)).select("doc_id", "ord", "fp", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))

    def places(leads: list[int]) -> Column:
        """Words at which some window's first words stand; windows of fewer than LEAD words have heads of their own."""
        found = []
        for lead in leads:
            bitmap, bits = _bitmap(grams.where(F.least("length", F.lit(LEAD)) == lead).select("head"))
            heads = F.transform(F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - (lead - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get("hashes", i + j) for j in range(1, lead))))
            found.append(_places(heads, bitmap, bits))
        return F.array_distinct(F.concat(*found))

    leads = sorted({min(LEAD, x) for x in lengths})
    at = places(leads) if leads else F.array().cast("array<int>")
    # size() and slice() both refer to words, so the split stays in a projection of its own.
    placed = hashed.withColumn("at", at)

    def window(pos: Column, length: int) -> Column:
        """The window of so many words at a place, if the text goes on that far."""
        part = F.struct(pos.alias("pos"), F.lit(length).alias("length"), _hash(F.slice("hashes", pos + 1, F.lit(length))).alias("h"), F.slice("words", pos + 1, F.lit(length)).alias("seen"))
        return F.when(pos + length <= F.size("words"), part)

    candidates = F.flatten(F.transform("at", lambda pos: F.array_compact(F.array(*(window(pos, x) for x in lengths or [size])))))
    # All that is read of the documents: a row each, with the few windows that may be the benchmark's.
    scanned = work.save(placed.select("doc_id", "ord", "fp", F.size("words").cast("long").alias("n_words"), candidates.alias("candidates")), "scanned")
    at = scanned.select("ord", "fp", F.explode("candidates").alias("w")).select("ord", "fp", "w.*")
    mine = grams.select("length", "h", "window_id", "gram")
    hit = at.join(F.broadcast(mine) if n <= MAX_BROADCAST_WINDOWS else mine, ["length", "h"]).where(F.col("seen") == F.col("gram"))
    return work.save(hit.select("ord", "fp", "pos", "length", "window_id"), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, work: Scratch | None = None) -> DataFrame:
    """One row per hit document: ord, fp, n_hit, n_items, items (sorted strings)."""
    work = work or Scratch(docs.sparkSession, "decontaminate")
    found = hits(docs, benchmark, size, work)
    covered = found.select("ord", "fp", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("word"))
    members = work.spark.read.parquet(f"{work.root}/windows").where("item_id IS NOT NULL").select("window_id", "item_id").distinct()
    n_hit = covered.groupBy("ord", "fp", "word").agg(F.lit(1).alias("one")).groupBy("ord", "fp").agg(F.count("*").alias("n_hit"))
    items = found.select("ord", "fp", "window_id").distinct().join(members, "window_id").select("ord", "fp", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("ord", "fp").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    return n_hit.join(items, ["ord", "fp"], "left")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Every document with its words, hit words and items; nothing is dropped."""
    work = Scratch(docs.sparkSession, "decontaminate")
    found = contamination(docs, benchmark, size, work)
    base = work.spark.read.parquet(f"{work.root}/scanned").select("doc_id", "ord", "fp", "n_words")
    joined = base.join(found, ["ord", "fp"], "left")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window occurs."""
    work = Scratch(docs.sparkSession, "decontaminate")
    bad = work.save(hits(docs, benchmark, size, work).select("ord", "fp").distinct(), "bad")
    return without(docs, bad, [order_key(), F.xxhash64("text")])


def cut_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Every document as doc_id and text, without its hit words.

    The words of a document that was hit are kept in their own case and joined
    by one space; other texts are returned unchanged.
    """
    found = hits(docs, benchmark, size)
    gone = found.select("ord", "fp", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("word"))
    gone = gone.distinct().groupBy("ord", "fp").agg(F.collect_list("word").alias("gone"))
    joined = with_words(keyed(docs).join(gone, ["ord", "fp"], "left"), lower=False)
    kept = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), F.col("gone"))
    text = F.array_join(F.transform(kept, lambda i: F.element_at("words", i + 1)), " ")
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(text).alias("text"))
