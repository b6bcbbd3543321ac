"""Mixing sources to target weights by a low-discrepancy schedule.

Slots: the sources' takings lie end to end on a line, which ``2 ** k`` points cut in pieces of the
same number of words.  Slot ``i`` is the piece at the van der Corput point ``reverse(i)``, so every
run of slots holds each source close to its share; a piece that several sources meet is shared by
them, so a source takes its target to the word however small it is.  The ``r``-th slot of a source
takes the ``r``-th block of that source's stream: its documents in hashed order, repeated as often
as needed.  Places on the line are counted in ``2 ** -k`` words, so all is whole numbers.  Only
block sums per (source, hash range) are summed up in order, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD

SLOT_BITS = 16
#: Hash ranges that a source's documents are ordered in.
RANGE_BITS = 12
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20_251
RESULT = ["size", "source_size", "target", "taken"]


def sized(docs: DataFrame, carry: list[str], text: str, doc_id: str, source: str, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    return (docs.select(*carry, F.col(doc_id).alias("__id"), F.col(source).alias("__src"),
                        F.col(source).isNull().alias("__null"), size.alias("size"),
                        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("__h"))
            .withColumn("__src", F.coalesce("__src", F.lit("")))
            .withColumn("__range", F.shiftrightunsigned("__h", 64 - RANGE_BITS)))


KEY = ["__null", "__src"]


def targets(totals: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``totals (KEY, source_size)``, one row for each source, with ``target``.

    Weights repeat along the sources by code point, null last.  Water filling: with sources by
    ``cap / weight``, those before the first level that fits are full and the others share the
    rest by weight.  The windows hold one row for each source.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(*KEY)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(max_repeats)))
    full = Window.partitionBy(F.lit(0))
    up = full.orderBy(F.col("__cap") / F.col("__w"), *KEY)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("__total", F.sum("source_size").over(full))
         .withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
                     / F.sum("__w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("__fits", F.col("__level") * F.col("__w") <= F.col("__cap"))
         .withColumn("__level", F.min_by(F.when(F.col("__fits"), F.col("__level")),
                                         F.when(F.col("__fits"), F.col("__cap") / F.col("__w"))).over(full)))
    return t.withColumn("target", F.least("__cap", F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap"))))


def reversed_bits(point, bits: int):
    return F.conv(F.reverse(F.lpad(F.bin(point), bits, "0")), 2, 10).cast("bigint")


def rank_of_point(point: str, first: str, last: str, bits: int):
    """How many of the points ``first`` to ``last`` have a smaller slot than ``point``.

    Slots below that of ``p`` are, for each bit ``m`` set in ``p``, the points that end in ``p``'s
    bits below ``m`` with bit ``m`` clear; those below ``x`` are counted by one shift.
    """
    below = lambda x: "+".join(
        f"(shiftright({point}, {m}) & 1L) * shiftright({x} - ({point} & {(1 << m) - 1}L) + {(2 << m) - 1}L, {m + 1})"
        for m in range(bits))
    return F.expr(f"({below(f'({last} + 1L)')}) - ({below(first)})")


def on_line(goal: DataFrame, slot_bits: int = SLOT_BITS) -> DataFrame:
    """``goal`` with each source's words to take and its place on the line.

    A source takes its target, rounded, and one word at least if it has a target at all.
    ``__ra`` and ``__rb`` are the ranks of its first and last point, by slot; ``__da`` and
    ``__db`` say how much their pieces lack of a whole one.
    """
    least = F.when(F.col("target") > 0, 1).otherwise(0)
    take = F.least(F.greatest(F.round("target").cast("bigint"), least), F.col("__cap").cast("bigint"))
    goal = (goal.withColumn("__take", take)
            .withColumn("__block", F.nullif(F.sum("__take").over(Window.partitionBy(F.lit(0))), F.lit(0)))
            .withColumn("__hi", F.sum("__take").over(Window.partitionBy(F.lit(0)).orderBy(*KEY)) * F.lit(1 << slot_bits))
            .withColumn("__lo", F.col("__hi") - F.col("__take") * F.lit(1 << slot_bits))
            .withColumn("__p", F.expr("__lo div __block")).withColumn("__q", F.expr("(__hi - 1) div __block")))
    first = F.col("__block") - (F.least("__hi", (F.col("__p") + 1) * F.col("__block")) - F.col("__lo"))
    last = F.when(F.col("__q") > F.col("__p"), (F.col("__q") + 1) * F.col("__block") - F.col("__hi")).otherwise(0)
    rank = lambda x: rank_of_point(x, "__p", "__q", slot_bits)
    ends = F.array_sort(F.array(F.struct(rank("__p").alias("r"), first.alias("d")),
                                F.struct(rank("__q").alias("r"), last.cast("bigint").alias("d"))))
    return (goal.withColumn("__ends", ends).withColumn("__ra", F.col("__ends")[0]["r"])
            .withColumn("__da", F.col("__ends")[0]["d"]).withColumn("__rb", F.col("__ends")[1]["r"])
            .withColumn("__db", F.col("__ends")[1]["d"]).drop("__ends"))


def schedule(line: DataFrame, slot_bits: int = SLOT_BITS) -> DataFrame:
    """``(KEY, __slot, __rank, __first, __last)``: each source's slots, ranked, with the words of its stream there.

    Words go from ``__first`` up to ``__last``.  There are ``2 ** slot_bits`` slots, and one row
    more for each source that shares one.
    """
    points = (line.where("__take > 0").withColumn("__point", F.explode(F.sequence("__p", "__q")))
              .withColumn("__slot", reversed_bits(F.col("__point"), slot_bits))
              .withColumn("__rank", rank_of_point("__point", "__p", "__q", slot_bits)))
    at = (F.col("__rank") * F.col("__block") - F.when(F.col("__rank") > F.col("__ra"), F.col("__da")).otherwise(0)
          - F.when(F.col("__rank") > F.col("__rb"), F.col("__db")).otherwise(0))
    width = (F.least("__hi", (F.col("__point") + 1) * F.col("__block"))
             - F.greatest("__lo", F.col("__point") * F.col("__block")))
    return points.select(*KEY, "__slot", "__rank", F.shiftright(at, slot_bits).alias("__first"),
                         F.shiftright(at + width, slot_bits).alias("__last"))


def rank_of_word(word, slot_bits: int):
    """Rank, in its source, of the slot that holds word ``word`` of the stream (``on_line``'s columns)."""
    u = (word + 1) * F.lit(1 << slot_bits) - 1
    a, b = F.col("__da"), F.col("__da") + F.col("__db")
    places = (F.when(u < (F.col("__ra") + 1) * F.col("__block") - a, u)
              .when(u < (F.col("__rb") + 1) * F.col("__block") - b, u + a).otherwise(u + b))
    return F.call_function("div", places, F.col("__block"))


LINE = ["__take", "__block", "__ra", "__da", "__rb", "__db"]


def streams(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", source: str = "source",
            weights=WEIGHTS, max_repeats: int = MAX_REPEATS, slot_bits: int = SLOT_BITS,
            seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in their source's stream and what the mix takes; the slots."""
    rows = sized(docs, carry, text, doc_id, source, seed)
    sums = rows.groupBy(*KEY, "__range").agg(F.sum("size").alias("__sum"))
    by = Window.partitionBy(*KEY)
    sums = (sums.withColumn("__from", F.sum("__sum").over(by.orderBy("__range")) - F.col("__sum"))
            .withColumn("source_size", F.sum("__sum").over(by)))
    goal = targets(sums.groupBy(*KEY).agg(F.max("source_size").alias("source_size")), weights, max_repeats)
    line = on_line(goal, slot_bits)
    place = sums.join(line.select(*KEY, "target", *LINE), KEY).select(
        *KEY, "__range", "__from", "source_size", "target", *LINE)
    inside = Window.partitionBy(*KEY, "__range").orderBy("__h", "__id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = (rows.join(place, [*KEY, "__range"])
              .withColumn("__at", F.col("__from") + F.sum("size").over(inside) - F.col("size")))
    return placed.withColumn("__nth", F.row_number().over(inside)), schedule(line, slot_bits)


#: One row of ``streams``: its hash range and its place there.
ROW = [*KEY, "__range", "__nth"]


def dealt(rows: DataFrame, slots: DataFrame, carry: list[str], max_repeats: int = MAX_REPEATS,
          slot_bits: int = SLOT_BITS, whole: bool = False, **_) -> DataFrame:
    """``carry`` of ``rows`` with ``__slot, __pass, __from_word, __n_words`` for each run of words in a slot.

    ``whole``: one row for each copy of a document, in the slot that its first word is in.
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    runs = (rows.where("size > 0").withColumn("__pass", reps)
            .withColumn("__a", F.col("__pass") * F.col("source_size") + F.col("__at"))
            .withColumn("__z", F.least(F.col("__a") + F.col("size"), F.col("__take"))).where("__z > __a"))
    first = rank_of_word(F.col("__a"), slot_bits)
    last = rank_of_word(F.col("__z") - 1, slot_bits)
    runs = runs.withColumn("__rank", first if whole else F.explode(F.sequence(first, last)))
    lo = F.col("__a") if whole else F.greatest("__a", "__first")
    hi = F.col("__z") if whole else F.least("__z", "__last")
    # whole copies carry their texts, the schedule has a bounded number of rows and one for each source
    return (runs.join(F.broadcast(slots) if whole else slots, [*KEY, "__rank"])
            .select(*carry, "__slot", "__pass", (lo - F.col("__a")).alias("__from_word"), (hi - lo).alias("__n_words"))
            .where("__n_words > 0"))


def mix(docs: DataFrame, carry: list[str] | None = None, **how) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with ``RESULT``; ``how`` as for ``streams``.

    ``size`` counts words between ASCII white space (null and empty texts: 0, so nothing of them
    is taken); ``taken`` counts words, repeats included: the sum of the row's runs in ``mixture``.
    Null sources are one source, the last.  Rows repeated whole are documents of their own.  Null ids are ordered by their text.
    Columns of the input that carry a result's name are replaced.  An empty table gives an
    empty result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    rows, slots = streams(docs, carry, **how)
    took = dealt(rows, slots, ROW, **how).groupBy(*ROW).agg(F.sum("__n_words").alias("taken"))
    return rows.join(took, ROW, "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint"))).select(
        *carry, *RESULT)


def mixture(docs: DataFrame, carry: list[str], **how) -> DataFrame:
    """The mix itself: ``carry`` with ``slot, pass, first_word, n_words`` for each run of words in a slot."""
    rows, slots = streams(docs, carry, **how)
    return dealt(rows, slots, carry, **how).select(*carry, *[
        F.col(f"__{c}").alias(n) for c, n in (("slot", "slot"), ("pass", "pass"), ("from_word", "first_word"),
                                              ("n_words", "n_words"))])


def mixed_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **how) -> DataFrame:
    """``docs`` as the mix takes it: each copy of a row in the slot of its first word, in slot order.

    Texts are kept together: a copy that runs over the end of its slot's block stays one row.
    A copy cut by the end of its source's share keeps its first words, joined by spaces, with
    ``n_chars`` counted anew (where there is such a column).  Columns are those of ``docs``.
    Partitions are equal runs of slots, in order, so the tables written from them are too.
    """
    boxed = docs.select(F.col(text).alias("__text"), F.col(how.get("doc_id", "doc_id")).alias("__doc"),
                        F.col(how.get("source", "source")).alias("__source"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    how = {k: v for k, v in how.items() if k not in ("doc_id", "source")}
    rows, slots = streams(boxed, ["__row"], text="__text", doc_id="__doc", source="__source", **how)
    copies = dealt(rows, slots, ["__row", "size", *KEY, "__a"], whole=True, **how)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = F.shiftright(F.col("__slot") * F.lit(parts), how.get("slot_bits", SLOT_BITS)).cast("int")
    rows = (copies.repartitionById(parts, run).sortWithinPartitions("__slot", *KEY, "__a")
            .withColumn("__cut", F.when(F.col("__n_words") < F.col("size"), F.col("__n_words"))))
    words = F.regexp_extract_all(F.col("__row")[text], F.lit(f"({WORD})"))
    cut = F.when(F.col("__cut").isNotNull(), F.array_join(F.slice(words, F.lit(1), F.col("__cut").cast("int")), " "))
    new = cut.alias("__new")
    fields = []
    for c in docs.columns:
        f = F.col("__row")[c]
        if c == text:
            f = F.coalesce("__new", f)
        elif c == n_chars:
            f = F.coalesce(F.char_length("__new").cast(docs.schema[c].dataType), f)
        fields.append(f.alias(c))
    return rows.select("__row", new).select(*fields)
