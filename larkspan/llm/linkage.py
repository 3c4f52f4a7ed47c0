"""Linking rows that share a bucket, without pairs of all rows in a bucket.

Every bucket has a leader, a member picked by the bucket's key, so one row has other
leaders in other buckets.  Work is in proportion to the rows of the buckets:

1. Each row is compared with the leader it shares most buckets with.  Rows found
   alike form components.
2. In buckets of more than CROWD rows, a few members of every component are compared
   with members of the bucket's largest one, so a large group of near copies costs a
   few comparisons a row.  This only saves work: it decides nothing.
3. In buckets of up to CROWD rows all pairs of rows from different components are
   compared: at most CROWD - 1 a row.  Where things come with signatures of their words,
   this is done together with step 1, for the pairs whose signatures allow it.
4. Crowded buckets that still hold several components share something common.  All their
   rows get further keys, made of the words that are rare among them, and go through
   steps 1 and 3 together, and then step 2, again with these.
5. Where even such a bucket is crowded and holds several components, all pairs of rows
   from different components are compared; a pair comes from the first bucket it shares.
   Steps 4 and 5 take many further keys in shares, one after the other.

So rows that share a bucket are apart in the end only if they are not alike or share no
key of step 4; what those keys guarantee is said where they are made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: The most rows of a bucket whose rows are all compared.
CROWD = 16
#: Rounds that take all crowded buckets in turn, so that later ones see what earlier ones joined,
#: and the rows of crowded buckets up to which one round takes all.
SHARES, ONE_SHARE = 4, 20_000_000
#: Shares of the further keys that are taken one after the other, so that what is shuffled and written
#: at once is a part of them, and the rows of crowded buckets up to which one share has them all.
KEY_SHARES, ONE_KEY_SHARE = 4, 1_000_000
#: Members of a component that are compared in one of these, and in the round after them.
TRIES, LATER_TRIES = 3, 16

#: Edges that the driver connects by itself; more are connected by rounds of joins.
LOCAL_EDGES = 500_000

#: Bits of a signature of a row's words.
SIGNATURE = 256

Verify = Callable[[DataFrame, int, str], DataFrame]
#: The signatures of rows (id, sig) and how many bits they have.
Signatures = tuple[DataFrame, int]


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The pairs (least node of its component, node) of what the edges u, v connect, as two columns."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    away = root != np.arange(len(nodes))
    return np.stack([nodes[root[away]], nodes[away]], axis=1)


def components(work: Scratch, edges: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """id and root (the least id of its component) for each id that is not a root.

    ``edges`` has columns a < b, and at most ``most`` rows if that is known.  Up to
    LOCAL_EDGES are connected in the driver.  Otherwise every round hooks each id to its
    least smaller neighbour and follows the hooks to their ends; what joins different ends
    are the next round's edges.
    """
    if most is not None and most <= LOCAL_EDGES:
        ends = edges.select("a", "b").toArrow()
        root, node = forest(ends["a"].to_numpy(), ends["b"].to_numpy()).T
        table = pa.table({"id": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})
        return work.save(work.spark.createDataFrame(table), f"{name}-c0", len(node))

    def onward(hooks: DataFrame) -> DataFrame:
        """Each hook followed one step, and whether it moved."""
        ahead = hooks.select(F.col("b").alias("q"), F.col("p").alias("pp"))
        moved = hooks.join(ahead, hooks["p"] == ahead["q"], "left")
        return moved.select("b", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))

    found, step, n = None, 0, 1
    while n:
        hooks, jump, moving = edges.groupBy("b").agg(F.min("a").alias("p")), 0, 1
        while moving:
            # Most chains of hooks end within the three steps.
            far = onward(onward(hooks).select("b", "p")).select("b", "p")
            hooks, moving = work.counted(onward(far), f"{name}-h{step}-{jump}", most, "moved")
            hooks, jump = hooks.select("b", "p"), jump + 1
        new = hooks.select(F.col("b").alias("id"), F.col("p").alias("root"))
        if found is not None:
            old = found.join(hooks, found["root"] == hooks["b"], "left").select("id", F.coalesce("p", "root").alias("root"))
            new = work.save(old.unionByName(new), f"{name}-c{step}", most)
        found = new
        left = hooks.select(F.col("b").alias("x"), F.col("p").alias("px"))
        right = hooks.select(F.col("b").alias("y"), F.col("p").alias("py"))
        ends = edges.join(left, F.col("a") == F.col("x"), "left").join(right, F.col("b") == F.col("y"), "left")
        ends = ends.select(F.coalesce("px", "a").alias("u"), F.coalesce("py", "b").alias("v")).where("u <> v")
        step += 1
        edges, n = work.counted(ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), f"{name}-e{step}", most)
    return found


def shared(work: Scratch, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows`` (key, id and others) of keys that two rows or more have, with their number n and a leader.

    Also how many of them are in crowded buckets.
    """
    # The id next to the key bit by bit is as good as a random one, and takes one long to find.
    pick = F.min(F.col("key").bitwiseXOR(F.col("id"))).bitwiseXOR(F.col("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), pick.alias("lead")).where("n > 1")
    # Shuffled at every size: buckets grow with the rows.
    return work.counted(rows.join(work.save(counts, f"{name}-counts").hint("merge"), "key"), f"{name}-rows", where=F.col("n") > CROWD)


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.withColumnRenamed("root", "comp_root"), "id", "left").withColumn("comp", F.coalesce("comp_root", "id")).drop("comp_root")


class _Groups:
    """The components so far: id and root of each id that is not a root."""

    def __init__(self, work: Scratch):
        self.work, self.found, self.rows = work, None, 0

    def join(self, links: DataFrame, n: int, name: str) -> None:
        """Make one of the components that the ``n`` ``links`` (a, b) connect."""
        if self.found is not None and not n:
            return
        if self.found is None:
            self.found = components(self.work, links, name, n)
        else:
            left, right = (self.found.select(F.col("id").alias(f"{x}_id"), F.col("root").alias(f"{x}_root")) for x in ("n", "f"))
            ends = links.join(left, F.col("a") == F.col("n_id"), "left").join(right, F.col("b") == F.col("f_id"), "left")
            ends = ends.select(F.coalesce("n_root", "a").alias("u"), F.coalesce("f_root", "b").alias("v")).where("u <> v")
            new = components(self.work, ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), name, n)
            onward = new.select(F.col("id").alias("r"), F.col("root").alias("rr"))
            old = self.found.join(onward, F.col("root") == F.col("r"), "left").select("id", F.coalesce("rr", "root").alias("root"))
            self.found = self.work.save(old.unionByName(new), f"{name}-all", self.rows + n)
        self.rows += n


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class _Tried:
    """Pairs that were compared, so that none is twice; of all that may be, only those that the signatures of ``own`` allow."""

    def __init__(self, work: Scratch, verify: Verify, own: Signatures | None = None):
        self.work, self.verify, self.own, self.tables = work, verify, own, []

    def __call__(self, pairs: DataFrame, name: str, seen: bool = False) -> tuple[DataFrame, int]:
        """The links among those of ``pairs`` (a, b) that are new, and their number; ``seen``: signatures were asked."""
        if self.own and not seen:
            pairs = _allowed(pairs, *self.own)
        if self.tables:
            pairs = pairs.join(reduce(DataFrame.unionByName, self.tables), ["a", "b"], "left_anti")
        return self.compare(*self.work.counted(pairs, f"{name}-pairs"), name)

    def compare(self, pairs: DataFrame, n: int, name: str) -> tuple[DataFrame, int]:
        """The links among ``pairs``, a written table of ``n`` new ones, and their number."""
        self.tables.append(pairs)
        if not n and len(self.tables) > 1:
            return pairs, 0
        # Comparing takes longer than writing, so there are more tasks than files of that size.
        return self.work.counted(self.verify(pairs, n, name), f"{name}-links", 10 * n)


def _parts(rows: DataFrame, found: DataFrame, step: int, tries: int) -> DataFrame:
    """The components of each bucket with their rows and some of their members, other ones at each step."""
    seeds = [F.xxhash64("key", F.lit(step), F.lit(t)) for t in range(tries)]
    reps = [F.min(s.bitwiseXOR(F.col("id"))).bitwiseXOR(s).alias(f"rep{t}") for t, s in enumerate(seeds)]
    return _labelled(rows, found).groupBy("key", "comp").agg(F.count("*").alias("rows"), *reps)


def _round(rows: DataFrame, found: DataFrame, step: int, tries: int, half: bool) -> DataFrame:
    """Pairs between the largest component of each bucket and the others.

    With ``half``, only in buckets of which the largest component has half of the rows.
    """
    parts = _parts(rows, found, step, tries)
    names = [f"rep{t}" for t in range(tries)]
    tops = parts.groupBy("key").agg(F.max_by(F.struct("comp", *names), F.struct("rows", "comp")).alias("top"), F.count("*").alias("comps"), F.max("rows").alias("most"), F.sum("rows").alias("all"))
    tops = tops.where("comps > 1 AND 2 * most >= all" if half else "comps > 1").select("key", "top")
    both = parts.join(tops, "key").where("comp <> top.comp")
    pairs = [F.struct(*_ordered(F.col(x), F.col(f"top.{x}"))).alias(x) for x in names]
    each = both.select(F.least("comp", "top.comp").alias("u"), F.greatest("comp", "top.comp").alias("v"), *pairs)
    # A pair of rows belongs to one pair of components, so what is distinct there is distinct.
    one = each.groupBy("u", "v").agg(F.array_distinct(F.array(*(F.min(x) for x in names))).alias("pairs"))
    return one.select(F.explode("pairs").alias("pair")).select("pair.a", "pair.b")


def _few_bits_differ(bits: int) -> Column:
    """What all alike rows meet: a word that only one of them has changes one bit of its signature at most."""
    differ = sum((F.bit_count(F.get("sig", F.lit(i)).bitwiseXOR(F.get("o_sig", F.lit(i)))) for i in range(bits // 64)), F.lit(0))
    return differ <= 2 * F.floor(0.2 * F.greatest("size", "o_size") + 1e-9)


def _similar(x: str, y: str) -> str:
    return f"least({x}, {y}) >= 0.8 * greatest({x}, {y})"


def _allowed(pairs: DataFrame, sigs: DataFrame, bits: int) -> DataFrame:
    """Those of ``pairs`` (a, b, maybe others) whose sizes and signatures (id, size, sig) are as all alike rows' are."""
    one = sigs.select(F.col("id").alias("a"), "size", "sig")
    other = sigs.select(F.col("id").alias("b"), F.col("size").alias("o_size"), F.col("sig").alias("o_sig"))
    return pairs.join(one, "a").join(other, "b").where(_similar("size", "o_size")).where(_few_bits_differ(bits)).select(*pairs.columns)


def _first(work: Scratch, rows: DataFrame, groups: _Groups, tried: _Tried) -> None:
    """Steps 1 and 3 at once: rows of crowded buckets with a leader, those of others with all, as signatures allow.

    The table ``asked`` then has the ids of these pairs and of the rows of crowded buckets.
    """
    sigs, bits = tried.own
    crowd = rows.where(F.col("n") > CROWD)
    stars = crowd.where("id <> lead").groupBy(F.col("id").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("n"))
    best = _allowed(stars, sigs, bits).groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    few = rows.where(F.col("n") <= CROWD).select("key", "id").join(sigs, "id")
    pairs = _bucket_pairs(few, F.col("id") < F.col("o_id"), bits).unionByName(best.select(*_ordered(F.col("a"), F.col("b"))))
    pairs, n = work.counted(pairs.distinct(), "0-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd.select("id"))
    work.save(ids.distinct(), "asked")
    groups.join(*tried.compare(pairs, n, "0"), "0")


def _leads(rows: DataFrame) -> DataFrame:
    """Each row with the leader it shares most buckets with, as pairs (a, b)."""
    stars = rows.where("id <> lead").groupBy("id", "lead").agg(F.count("*").alias("n"))
    best = stars.groupBy("id").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))
    return best.select(*_ordered(F.col("id"), F.col("lead"))).distinct()


def _linked(work: Scratch, rows: DataFrame, crowded: int, groups: _Groups, tried: _Tried, name: str, sigs: Signatures | None = None) -> None:
    """Steps 1 to 3 for the rows of some buckets, of which ``crowded`` are in crowded ones.

    With signatures, steps 1 and 3 are one: only rows of crowded buckets need a leader.
    """
    few = rows.where(F.col("n") <= CROWD)
    if sigs:
        _across(work, few, groups, tried, f"{name}-rest", sigs, leads=_leads(rows.where(F.col("n") > CROWD)) if crowded else None)
        _crowded(rows, crowded, groups, tried, name)
        return
    groups.join(*tried(_leads(rows), f"{name}-lead"), f"{name}-lead")
    _crowded(rows, crowded, groups, tried, name)
    _across(work, few, groups, tried, f"{name}-rest")


def _crowded(rows: DataFrame, crowded: int, groups: _Groups, tried: _Tried, name: str) -> None:
    """Step 2."""
    crowd, shares = rows.where(F.col("n") > CROWD), 1 if crowded <= ONE_SHARE else SHARES
    for step in range((shares + (shares > 1)) if crowded else 0):
        last = step == shares
        mine = crowd if last else crowd.where(F.pmod(F.xxhash64("key"), F.lit(shares)) == step)
        links, n = tried(_round(mine, groups.found, step, LATER_TRIES if last else TRIES, half=last), f"{name}-{step}")
        groups.join(links, n, f"{name}-{step}")


def _mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows, with comp, of those buckets that hold several components."""
    rows = _labelled(rows, found)
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return rows.join(mixed, "key")


def _bucket_pairs(rows: DataFrame, which: Column, bits: int = 0, once: bool = False) -> DataFrame:
    """Pairs (a, b) of bucket mates in ``rows`` (key, id, size and others), of like sizes, for which ``which`` holds.

    With ``bits``, also of like signatures (sig).  With ``once``, a pair is made in the first of
    the buckets that it shares only, so the pairs do not grow with the buckets that two rows share;
    ``rows`` may have all keys of each id in a column keys for that.
    """
    if once and "keys" not in rows.columns:
        rows = rows.join(rows.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    other = rows.select("key", *(F.col(c).alias(f"o_{c}") for c in rows.columns if c != "key"))
    pairs = rows.join(other, "key").where(which).where(_similar("size", "o_size"))
    if bits:
        pairs = pairs.where(_few_bits_differ(bits))
    if once:
        pairs = pairs.where(F.col("key") == F.array_min(F.array_intersect("keys", "o_keys")))
    return pairs.select(*_ordered(F.col("id"), F.col("o_id")))


def _gathered(rows: DataFrame) -> DataFrame:
    """One row for each id of ``rows`` (key, id, size, comp), with its keys."""
    return rows.groupBy("id").agg(F.first("size").alias("size"), F.first("comp").alias("comp"), F.collect_set("key").alias("keys"))


def _across(work: Scratch, rows: DataFrame, groups: _Groups, tried: _Tried, name: str, sigs: Signatures | None = None, once: bool = False, leads: DataFrame | None = None) -> None:
    """Compare all rows of different components that share one of the buckets, and where there are signatures, whose allow it.

    Pairs of ``leads`` are compared in the same go.
    """
    rows = _mixed(rows, groups.found).select("key", "id", "size", "comp")
    if sigs:
        # Signatures meet ids, not their rows in all buckets, and that once for both sides of the pairs.
        ids = work.save(_gathered(rows).join(sigs[0], "id"), f"{name}-mixed")
        rows = ids.select(F.explode("keys").alias("key"), "id", "size", "comp", "sig", *(["keys"] if once else []))
    else:
        rows = work.save(rows, f"{name}-mixed")
    pairs = _bucket_pairs(rows, F.col("comp") < F.col("o_comp"), sigs[1] if sigs else 0, once)
    if leads is not None:
        pairs = pairs.unionByName(_allowed(leads, *tried.own) if tried.own else leads)
    groups.join(*tried(pairs if once else pairs.distinct(), name, seen=sigs is not None), name)


def link(work: Scratch, things: DataFrame, verify: Verify, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], bits: int = SIGNATURE, own_bits: int = 0) -> DataFrame:
    """id and root for things linked by verified pairs of bucket mates.

    ``things`` has columns id, size and keys; the sizes of alike things are within a
    fifth of each other.  ``verify`` takes distinct pairs (a, b), their number and a
    name, and returns those that are alike; all ids it is asked about are in the table
    ``asked`` of ``work``.  ``split`` takes a written table of rows (key, pos of the key,
    id, size) of crowded buckets and returns rows (key, id, size) with further keys, and a
    table (id, sig) of signatures of ``bits`` bits, one or none for each different word of the row.
    With ``own_bits``, ``things`` has such signatures of so many bits in a column sig.
    """
    own = (things.select("id", "size", "sig"), own_bits) if own_bits else None
    tried, groups = _Tried(work, verify, own), _Groups(work)
    rows, crowded = shared(work, things.select("id", "size", F.posexplode("keys").alias("pos", "key")), "0")
    if own:
        _first(work, rows, groups, tried)
        _crowded(rows, crowded, groups, tried, "0")
    else:
        work.save(rows.select("id").distinct(), "asked")
        _linked(work, rows, crowded, groups, tried, "0")
    if not crowded:
        return groups.found
    apart, n = work.counted(_mixed(rows.where(F.col("n") > CROWD), groups.found).select("key", "pos", "id", "size"), "apart")
    if n:
        keys, sigs = split(apart)
        shares = 1 if n <= ONE_KEY_SHARE else KEY_SHARES
        for share in range(shares):
            # A bucket is in one share whole, and later ones see what earlier ones joined.
            mine = keys.where(F.pmod(F.xxhash64("key"), F.lit(shares)) == share) if shares > 1 else keys
            more, crowded = shared(work, mine.select("key", "id", "size"), f"{share + 1}")
            _linked(work, more, crowded, groups, tried, f"{share + 1}", (sigs, bits))
            if crowded:
                _across(work, more.where(F.col("n") > CROWD), groups, tried, f"{share + 1}-last", (sigs, bits), once=True)
            work.drop(*(f"{share + 1}-{x}" for x in ("counts", "rows", "rest-mixed", "last-mixed")))
    return groups.found
