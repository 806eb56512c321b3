"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source is to be copied target / source size times. The whole part is taken at once; the fraction is
rounded by pivotal steps: two documents of a source meet, and mass goes from one to the other, in words, until one of
them has a whole number of copies; which way is drawn so that each fraction is kept in expectation. A step leaves the
words taken from the source as they were, so the whole source misses its target by half a document at most: the one
document that is left is rounded to the nearer whole number.

The steps form a reduction tree: documents meet in groups of about ``GROUP``, each of which settles all its members but
one; the ones left meet in the next level, until a source has one. A level is one shuffle of slim rows, and a source with
a third of all documents has as many groups as its size asks for. The draws are hashes of ids, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyflow.llm.common import materialize

#: Documents that meet in a group on average.
GROUP = 48
_WORD = r"[^\x20\x09-\x0D]+"
_UNIT = "struct<doc_id:{id},nth:bigint,size:bigint,x:double,copies:bigint>"


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) for each source of ``sized`` (source, size).

    Sources by code point, null last, have ``weights`` in turn and share all words by them; a target stops at ``most``
    times its source, and what is over goes to the others by weight until none is above. Sources in order of the ratio
    of that stop to their weight: those below the level that the rest would share are the ones that stop. The table of
    sources is ranked in one task, a row for each source: up to some ten million of them are no burden.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sizes = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(most))
    ratio = Window.partitionBy(F.lit(0)).orderBy((F.col("stop") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    above = F.coalesce(F.sum("stop").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(every) - above) / F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = sizes.withColumn("level", level).withColumn("level", F.when(F.col("stop") >= F.col("level") * F.col("weight"), F.col("level")))
    # The first source that doesn't stop sets the level of all that follow it.
    shared = F.first("level", ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("stop"), F.coalesce(shared * F.col("weight"), F.col("stop")))
    return levels.select("source", "source_size", target.alias("target"))


def _draw(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _settle(units: Column, seed: int, kind: str) -> Column:
    """Fold a group: (held: the unit that is still fractional, done: the settled ones)."""
    unit = _UNIT.format(id=kind)

    def whole(u: Column) -> Column:
        return F.struct(u.doc_id.alias("doc_id"), u.nth.alias("nth"), u.size.alias("size"), F.lit(0.0).alias("x"), (u.copies + F.round(u.x).cast("bigint")).alias("copies"))

    def to(u: Column, x: Column) -> Column:
        # Within a billionth of a whole number is whole.
        near = F.when(F.abs(x - F.round(x)) < 1e-9, F.round(x)).otherwise(x)
        return F.struct(u.doc_id.alias("doc_id"), u.nth.alias("nth"), u.size.alias("size"), near.alias("x"), u.copies.alias("copies"))

    def fractional(u: Column) -> Column:
        return (u.x > 0) & (u.x < 1)

    def pair(h: Column, u: Column, moved: Column) -> Column:
        return F.struct(to(h, h.x + moved / h.size).alias("h"), to(u, u.x - moved / u.size).alias("u"))

    def after(p: Column, done: Column) -> Column:
        none = F.lit(None).cast(unit)
        keep = F.when(fractional(p.h), p.h).when(fractional(p.u), p.u).otherwise(none)
        settled = F.when(fractional(p.h), F.array(whole(p.u))).when(fractional(p.u), F.array(whole(p.h))).otherwise(F.array(whole(p.h), whole(p.u)))
        return F.struct(keep.alias("held"), F.concat(done, settled).alias("done"))

    def step(state: Column, u: Column) -> Column:
        h = state.held
        # Words that can go from u to h, and from h to u, until one of the two is whole.
        up = F.least((1 - h.x) * h.size, u.x * u.size)
        down = F.least(h.x * h.size, (1 - u.x) * u.size)
        ways = F.struct(up.alias("up"), down.alias("down"), _draw(seed, h.doc_id, h.nth, u.doc_id, u.nth).alias("draw"))
        moved = _let(ways, lambda w: F.when(w.draw < w.down / (w.up + w.down), w.up).otherwise(-w.down))
        met = _let(_let(moved, lambda m: pair(h, u, m)), lambda p: after(p, state.done))
        return F.when(h.isNull(), F.struct(u.alias("held"), state.done.alias("done"))).otherwise(met)

    start = F.struct(F.lit(None).cast(unit).alias("held"), F.array().cast(f"array<{unit}>").alias("done"))
    return F.aggregate(units, start, step)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 42, **targets) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken): a row for each row of ``docs``.

    size counts the words (null text: none), copies how often the mix has the document, taken = copies * size. A null
    source is a source. A document without words takes no part: it has the whole part of its source's copies, none
    left over. Rows that repeat are told apart by their number, so a repeat may have other copies; an empty table gives
    an empty result; a source without words has target 0 and no copies. Other columns are not read.
    """
    sized = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), _words(text_column).alias("size"))
    kind = dict(sized.dtypes)["doc_id"]
    sized = materialize(sized, "sizes")
    # Rows that repeat get numbers, so that draws depend on the rows alone.
    counted = sized.groupBy("doc_id", "source", "size").count()
    units = counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("nth"))
    goals = materialize(source_targets(sized, **targets), "targets")
    few = _few(goals)
    joined = units.join(F.broadcast(goals) if few else goals, units.source.eqNullSafe(goals.source)).drop(goals.source)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = joined.withColumn("share", F.when(F.abs(share - F.round(share)) < 1e-12, F.round(share)).otherwise(share))
    planned = planned.withColumn("copies", F.floor("share")).withColumn("x", F.when(F.col("size") > 0, F.col("share") - F.floor("share")).otherwise(0.0))
    planned = materialize(planned.select("source", "source_size", "target", "doc_id", "nth", "size", "x", "copies"), "planned")
    keys = ["source", "doc_id", "nth", "size", "x", "copies"]
    settled = [planned.where("x <= 0").select("source", "doc_id", "nth", "size", "copies")]
    level, open_units = 0, planned.where("x > 0").select(*keys)
    unit = F.struct("doc_id", "nth", "size", "x", "copies")
    # How many groups a source has in the first level; each leaves one document at most, so those of the next follow.
    groups = open_units.groupBy("source").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    groups = materialize(groups, "groups")
    most = groups.agg(F.max("groups")).first()[0] or 1
    while True:
        placed = open_units.join(F.broadcast(groups) if few else groups, open_units.source.eqNullSafe(groups.source)).drop(groups.source)
        slot = F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "nth", "size"), F.col("groups"))
        order = F.xxhash64(F.lit(seed - 1 - level), "doc_id", "nth").alias("order")
        met = placed.groupBy("source", slot.alias("slot")).agg(F.sort_array(F.collect_list(F.struct(order, unit.alias("unit")))).alias("units"))
        state = _settle(F.transform("units", lambda u: u.unit), seed + level, kind)
        met = materialize(met.select("source", state.alias("state")), f"level{level}")
        done = met.select("source", F.inline("state.done")).select("source", "doc_id", "nth", "size", "copies")
        settled.append(done)
        held = met.where("state.held is not null").select("source", "state.held.*").select(*keys)
        if most <= 1:
            # One document of a source is left: the nearer whole number keeps the source nearest to its target.
            up = F.round("x").cast("long")
            settled.append(held.select("source", "doc_id", "nth", "size", (F.col("copies") + up).alias("copies")))
            break
        groups, most = groups.withColumn("groups", F.ceil(F.col("groups") / GROUP)), -(-most // GROUP)
        open_units, level = held, level + 1
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    out = every.join(F.broadcast(goals) if few else goals, every.source.eqNullSafe(goals.source)).drop(goals.source)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _few(frame: DataFrame, rows: int = 10_000) -> bool:
    """Whether a table of sources is small enough to be broadcast."""
    return len(frame.select(F.lit(1)).head(rows + 1)) <= rows


def _key(*columns: Column) -> Column:
    """One string for each combination of values, nulls included."""
    return F.concat_ws("\x00", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns))


def _words(text_column: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit(_WORD)).cast("long")


def _digest(docs: DataFrame) -> Column:
    """A hash of the whole row; maps, which have no hash, as JSON."""
    return F.xxhash64(*(F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in docs.dtypes))


def _shares(docs: DataFrame, mixed: DataFrame, id_column: str, text_column: str, source_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their key, size and hash; for each (key, size, hash): low, taken, same): ``same`` rows get ``low`` copies
    each and ``taken`` of them one more.

    Copies of rows that share id, source and size differ by one at most, as their source has one share: the rows with the
    smallest hashes get the greater number. The running sum that finds them goes by buckets of the hash, so that not even
    all rows of a null id meet in one task.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), _key(F.col(id_column), F.col(source_column)).alias("key"), _words(text_column).alias("size"), _digest(docs).alias("hash"))
    plan = mixed.groupBy(_key(F.col("doc_id"), F.col("source")).alias("key"), "size").agg(F.min("copies").alias("low"), F.sum("copies").alias("all"), F.count("*").alias("n"))
    plan = plan.select("key", "size", "low", (F.col("all") - F.col("n") * F.col("low")).alias("more"))
    sets = keyed.groupBy("key", "size", "hash").agg(F.count("*").alias("same")).withColumn("bucket", F.shiftright("hash", 52))
    buckets = sets.groupBy("key", "size", "bucket").agg(F.sum("same").alias("rows"))
    earlier = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("key", "size", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("key", "size", "bucket").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = sets.join(buckets, ["key", "size", "bucket"]).join(plan, ["key", "size"])
    before = F.col("before") + F.coalesce(F.sum("same").over(here), F.lit(0))
    taken = F.least(F.greatest(F.col("more") - before, F.lit(0)), F.col("same"))
    return keyed, materialize(placed.select("key", "size", "hash", "low", taken.alias("taken"), "same"), "shares")


def repeat(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mixed`` says, columns as they were.

    Rows that share id, source and size have the copies of such rows, more of them for the rows with the smaller hashes;
    so the words of the result are those that the mix takes. Rows that are the same in all columns are interchangeable.
    Only identical rows of which some but not all get one more are numbered.
    """
    keyed, shares = _shares(docs, mixed, id_column, text_column, source_column)
    key = ["key", "size", "hash"]
    split = (F.col("taken") > 0) & (F.col("taken") < F.col("same"))
    every = keyed.join(shares.where(~split), key).select("row", (F.col("low") + F.when(F.col("taken") > 0, 1).otherwise(0)).alias("n"))
    some = shares.where(split)
    if not some.isEmpty():
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
        numbered = keyed.join(some, key).withColumn("nth", nth)
        every = every.unionByName(numbered.select("row", (F.col("low") + F.when(F.col("nth") <= F.col("taken"), 1).otherwise(0)).alias("n")))
    return every.where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("row.*")
