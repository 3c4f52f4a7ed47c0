"""What five quality filters do to a corpus in every order, from one CUBE.

Each document fails or passes each filter:

- A: fewer than 200 words; B: fewer than half of the words differ;
- C: more than 3 % of the characters are capitals A-Z; D: a character of ``#$%&*|``;
- E: the text is that of a smaller doc_id anywhere in the table.

A CUBE over the five failures and the part counts documents for every set of filters:
its rows in which each selected failure is false are the survivors of that set.  A step
of an order goes from the set of the filters before it to that set and one more, so each
step joins two of these rows, and whatever it reports is a difference of their counts.

Only the words, hashes of the text and doc_id are read from the documents in one scan;
equal rows are counted before each shuffle, so neither a text nor a doc_id that a third
of the rows share meets in one task.  The CUBE runs over at most 32 rows a part.

Defined cases: a null text is an empty one; a null doc_id has no label and counts as the
largest; rows of one doc_id and one text are not copies of each other; a document has
quality 1 (or toxic 1) if any of its rows in the labels says so; a part is a value of
``lang``, null the empty one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import LAST, order_key, second_print
from .scratch import Scratch

FILTERS = "ABCDE"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The failures that a text, not null, and its words show by themselves: all but E."""
    n = F.size(words)
    chars = F.char_length(text)
    capitals = chars - F.char_length(F.translate(text, _CAPITALS, ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * chars.cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failures A to D, fp, fp2, ord, and the rows ``n`` that agree in these, with their labels."""
    some = docs.select(order_key().alias("ord"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    some = some.withColumn("words", words_of(F.col("text")))
    cut = some.select("ord", "part", F.xxhash64("text").alias("fp"), second_print("text").alias("fp2"), *(c.alias(k) for k, c in failures(F.col("text"), F.col("words")).items()))
    rows = cut.groupBy("ord", "part", "fp", "fp2", *FILTERS[:4]).agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = F.when(F.col("ord") < LAST, F.col("ord"))
    joined = rows.join(marks, known == F.col("l_id"), "left")
    return joined.select(*rows.columns, *((F.coalesce(c, F.lit(0)) * F.col("n")).cast("long").alias(c) for c in ("good", "toxic")))


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents ``n`` of each part with each combination of failures A to E, those of quality 1 and the toxic ones."""
    rows = _labelled(docs, labels)
    counts = ("n", "good", "toxic")
    # Of the rows of one text, those of the least doc_id are no copies.
    texts = rows.groupBy("fp", "fp2", "part", *FILTERS[:4]).agg(*(F.sum(c).alias(c) for c in counts), F.min(F.struct("ord", *counts)).alias("first"))
    least = F.min("first.ord").over(Window.partitionBy("fp", "fp2"))
    texts = texts.withColumn("own", F.col("first.ord") == least)
    first = [F.when(F.col("own"), F.col(f"first.{c}")).otherwise(0).alias(c) for c in counts]
    first = F.struct(F.lit(False).alias("E"), *first)
    rest = F.struct(F.lit(True).alias("E"), *((F.col(c) - F.when(F.col("own"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in counts))
    each = texts.select("part", *FILTERS[:4], F.explode(F.array(first, rest)).alias("x")).select("part", *FILTERS[:4], "x.*").where("n > 0")
    return each.groupBy("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in counts))


def survivors(flagged: DataFrame) -> DataFrame:
    """The documents of each part that pass all filters of a set (bit i: filter i), good and toxic ones too."""
    cube = flagged.cube(*FILTERS, "part").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"g{f}") for f in FILTERS))
    passed = F.lit(True)
    for f in FILTERS:
        passed &= ~F.coalesce(F.col(f), F.lit(False))
    selected = sum(((1 - F.col(f"g{f}").cast("int")) * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    return cube.where((F.col("all_parts") == 0) & passed).select("part", selected.alias("subset"), "n", "good", "toxic")


def lattice(left: DataFrame) -> DataFrame:
    """The ``survivors`` of all 32 sets, zeros included, and by filter those of it alone and of all others."""
    every = (1 << len(FILTERS)) - 1
    sets = left.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct("n", "good", "toxic")))).alias("sets"))

    def of(subset: Column, what: str) -> Column:
        return F.coalesce(F.try_element_at("sets", subset)[what], F.lit(0).cast("long"))

    each = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("subset"))
    fails = F.create_map(*(x for i, f in enumerate(FILTERS) for x in (F.lit(f), of(F.lit(0), "n") - of(F.lit(1 << i), "n"))))
    unique = F.create_map(*(x for i, f in enumerate(FILTERS) for x in (F.lit(f), of(F.lit(every - (1 << i)), "n") - of(F.lit(every), "n"))))
    return each.select("part", "subset", *(of(F.col("subset"), c).alias(c) for c in ("n", "good", "toxic")), fails.alias("fails"), unique.alias("unique"))


def _steps() -> list[tuple[str, int, str, int, int]]:
    """Each step of each order: its filter, and the sets before and after it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << FILTERS.index(f)
            out.append(("".join(order), step, f, before, after))
            before = after
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    # Written, as both sides of the join below start from these few rows.
    flagged = Scratch(docs.sparkSession, "audit").save(flags(docs, labels), "flags")
    sets = lattice(survivors(flagged))
    steps = docs.sparkSession.createDataFrame(_steps(), "filter_order string, step int, filter string, s_before int, s_after int")
    before = sets.select("part", F.col("subset").alias("s_before"), *(F.col(c).alias(f"b_{c}") for c in ("n", "good", "toxic")), "fails", "unique")
    after = sets.select("part", F.col("subset").alias("s_after"), "n", "good", "toxic")
    each = before.join(F.broadcast(steps), "s_before").join(after, ["part", "s_after"])  # 600 steps, whatever the input
    removed = F.col("b_n") - F.col("n")
    out = each.select(
        "part",
        "filter_order",
        "step",
        "filter",
        F.col("n").alias("kept"),
        removed.alias("removed"),
        (F.col("fails")[F.col("filter")] - removed).alias("redundant"),
        F.col("unique")[F.col("filter")].alias("unique_fails"),
        (F.col("b_good") - F.col("good")).alias("good_lost"),
        (F.col("b_toxic") - F.col("toxic")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
