"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source has a weight; the sources share the corpus' tokens by weight, but a
source is asked for at most ``max_epochs`` times its size, and what it cannot
give is shared again by weight (``source_plan``). The targets are met in blocks
of ``block_tokens`` tokens: block j of a source has the quotient
target / (2 j + 1), and blocks go to the sources by the highest quotients. The
first blocks of that order fill shard 0, the next ones shard 1, and so on, so
every shard gets an integer quota per source and each shard keeps the weights.

A source's documents lie in a seeded order, read round and round from a seeded
place; its blocks are cut from that stream one after the other, so documents stay
whole except where a quota ends, a repeat comes a whole epoch later, and nothing
is taken more than ``max_epochs`` times.

Scale: quotas are found from bounds on the seats (a few candidates per source and
shard), never by listing blocks. Places in the seeded order are prefix sums over
4096 hash ranges per source and then inside one range, so a source with a third
of the rows is spread; rows repeated whole are one row with a count until the end.
The source table is broadcast only up to ``BROADCAST_SOURCES`` rows.

Only DataFrame / SQL functions run on the main path.

Defined cases: a NULL text has no words and takes no part (its row stays, with
nothing taken); a NULL source is a source of its own, after all others; NULL and
repeated identifiers are rows like any other; rows equal in identifier, source and
size are interchangeable; an empty table gives no rows; when all sizes are 0 nothing
is taken. ``mix`` returns its own columns only, so no input name can clash;
``mixed_texts`` keeps the input columns and refuses clashing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_TOKENS = 16
SHARDS = 16
SEED = 7
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"
WORD_WITH_SPACE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\z)?"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _digest(seed: int, *cols: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_plan(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
                block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per source from (source, source_size): its place in code point order, weight,
    target, seeded first token and ``ends``, the blocks it has given before each shard (and in all).

    Rows here are sources, so the windows without a key see one row per source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (sizes.withColumn("place", F.row_number().over(by_name) - 1)
              .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                 F.pmod("place", F.lit(len(weights))) + 1))
              .withColumn("cap", F.col("source_size") * max_epochs)
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("n", F.count(F.lit(1)).over(everything)))
    # sources that meet their cap first: in the order of cap / weight, those whose cap lies
    # below what the level of the rest would give them
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
             / F.sum("weight").over(rest))
    levels = ranked.withColumn("level", level).withColumn("full", F.col("cap") < F.col("weight") * F.col("level"))
    # the first source that is not full sets the level (row numbers are negated for max)
    numbered = levels.withColumn("row", F.row_number().over(fill))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.coalesce(
        F.max(F.when(~F.col("full"), F.struct((-F.col("row")).alias("r"), "level"))).over(everything)["level"],
        F.lit(0.0)))
    plan = numbered.withColumn("target", target).drop("row", "level", "full").withColumn(
        "first", F.when(F.col("source_size") > 0,
                        F.pmod(_number(_digest(seed, F.col("source"))), F.col("source_size"))).otherwise(F.lit(0)))
    stride = F.element_at("ends", -1) * block_tokens / F.lit(shards)
    slack = F.array_max(F.transform("ends", lambda e, k: F.abs(e * block_tokens - k * stride))) + block_tokens
    return plan.join(_quotas(plan, block_tokens, shards), "place", "left").withColumn(
        "ends", F.coalesce("ends", F.array_repeat(F.lit(0).cast("long"), shards + 1))).select(
        "source", "place", "weight", "source_size", "target", "cap", "first", "ends",
        stride.alias("stride"), slack.alias("slack"))


def _quotas(plan: DataFrame, block_tokens: int, shards: int) -> DataFrame:
    """(place, ends): blocks of every source among the first h blocks by quotient, for the h of each shard.

    A source holds round(target / d) blocks for one divisor d common to all, so its number lies
    within the number of sources of its share of h; only the seats between those bounds are ranked.
    """
    seats = F.ceil(F.col("cap") / F.lit(block_tokens))
    house = F.floor(F.col("total") / F.lit(block_tokens) + F.lit(0.5)).cast("long")
    per = (plan.where("total > 0").select("place", "target", "total", "n", seats.alias("seats"), house.alias("house"),
                                          F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("k"))
           .withColumn("h", F.expr(f"(house * k) div {shards}"))
           .withColumn("low", F.greatest(F.lit(0), F.least(F.col("seats"), F.floor(
               F.col("target") * (F.col("h") - 3 * F.col("n")) / F.col("total")) - 2)).cast("long"))
           .withColumn("high", F.greatest(F.lit(0), F.least(F.col("seats"), F.ceil(
               F.col("target") * (F.col("h") + 3 * F.col("n")) / F.col("total")) + 2)).cast("long")))
    open_ = (per.withColumn("left", F.col("h") - F.sum("low").over(Window.partitionBy("k")))
             .withColumn("j", F.explode_outer(F.when(F.col("high") > F.col("low"),
                                                     F.sequence("low", F.col("high") - 1)))))
    order = Window.partitionBy("k").orderBy(((2 * F.col("j") + 1) / F.col("target")).asc_nulls_last(), "place", "j")
    won = open_.withColumn("won", (F.col("j").isNotNull() & (F.row_number().over(order) <= F.col("left"))).cast("long"))
    blocks = won.groupBy("place", "k").agg((F.first("low") + F.sum("won")).alias("blocks"))
    ends = F.transform(F.array_sort(F.collect_list(F.struct("k", "blocks"))), lambda x: x["blocks"])
    return blocks.groupBy("place").agg(F.concat(F.array(F.lit(0).cast("long")), ends).alias("ends"))


def mix(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS,
        shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """What the mix takes of every row of ``rows``: (id, source, size, copy, source_size, target,
    pieces), with pieces as array of (shard, epoch, first_word, words, at): words
    [first_word, first_word + words) lie ``at`` words into the source's part of that shard.
    ``copy`` numbers rows that are equal in identifier, source and size."""
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    distinct = materialise(
        rows.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
        .groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-rows")
    sizes = distinct.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    plan = materialise(source_plan(sizes, weights, max_epochs, block_tokens, shards, seed), "mix-sources")
    small = plan.count() <= BROADCAST_SOURCES
    names = plan.select(F.col("source").alias("name"), "place")
    keyed = (distinct.join(F.broadcast(names) if small else names, F.col("source").eqNullSafe(F.col("name")))
             .drop("name").withColumn("digest", _digest(seed, F.col("id")))
             .withColumn("range", F.substring("digest", 1, 3)))
    weight = F.col("size") * F.col("m")
    ranges = (keyed.groupBy("place", "range").agg(F.sum(weight).alias("tokens"))
              .withColumn("base", F.sum("tokens").over(Window.partitionBy("place").orderBy("range")) - F.col("tokens"))
              .drop("tokens"))  # at most 4096 rows a source
    in_range = Window.partitionBy("place", "range").orderBy("digest", F.col("id").asc_nulls_first(), "size")
    placed = (keyed.withColumn("upto", F.sum(weight).over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
              .join(ranges, ["place", "range"])
              .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
              .withColumn("start", F.col("base") + F.col("upto") - weight + F.col("copy") * F.col("size")))
    side = plan.drop("source")
    full = placed.join(F.broadcast(side) if small else side, "place")
    return full.select("id", "source", "size", "copy", "source_size", "target",
                       _pieces(max_epochs, block_tokens, shards).alias("pieces"))


def _pieces(max_epochs: int, block_tokens: int, shards: int) -> Column:
    """Where the row's words [start, start + size) of each epoch meet the shards' parts of the stream.

    Ends of shards lie within ``slack`` of equal strides (measured in the plan), so each epoch looks
    at the few shards it can meet, however many there are.
    """
    def end(k):
        return F.least(F.get("ends", k) * block_tokens, F.col("cap"))

    def in_epoch(p):
        at = p * F.col("source_size") + F.col("start") - F.col("first")
        lo, hi = F.greatest(at, F.lit(0)), F.least(at + F.col("size"), end(F.lit(shards)))
        k0 = F.greatest(F.floor((lo - F.col("slack")) / F.col("stride")) - 1, F.lit(0)).cast("int")
        k1 = F.least(F.floor((hi + F.col("slack")) / F.col("stride")) + 1, F.lit(shards - 1)).cast("int")

        def meet(k):
            a, b = F.greatest(end(k), lo), F.least(end(k + 1), hi)
            return F.struct(k.alias("shard"), p.cast("int").alias("epoch"), (a - at).alias("first_word"),
                            (b - a).alias("words"), (a - end(k)).alias("at"))
        return F.when((hi > lo) & (k1 >= k0), F.transform(F.sequence(k0, k1), meet))

    every = F.flatten(F.filter(F.array(*[in_epoch(F.lit(p).cast("long")) for p in range(max_epochs + 1)]),
                               lambda x: x.isNotNull()))
    return F.filter(every, lambda x: x["words"] > 0)


def taken(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, x: a + x["words"])


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                **options) -> DataFrame:
    """The mix itself: one row per piece, the input columns with ``text`` cut to the piece (white
    space before its words kept), and ``shard``, ``epoch``, ``at``. Rows without words have no piece."""
    new = ("shard", "epoch", "at", "mix_id", "mix_source", "mix_size", "mix_copy", "mix_pieces")
    for c in new:
        if c in docs.columns:
            raise ValueError(f"the input already has a column {c!r}")
    text = F.col(text_col).cast("string")
    sized = docs.withColumn("mix_size", n_words(text))
    plan = mix(sized, id_col, source_col, "mix_size", **options).select(
        *[F.col(c).alias(f"mix_{c}") for c in ("id", "source", "copy", "pieces")], F.col("size").alias("size_"))
    same = Window.partitionBy(id_col, source_col, "mix_size").orderBy(F.sha2(F.coalesce(text, F.lit("")), 256))
    numbered = sized.where("mix_size > 0").withColumn("copy_", F.row_number().over(same) - 1)
    met = numbered.join(plan, F.col(id_col).eqNullSafe(F.col("mix_id"))
                        & F.col(source_col).cast("string").eqNullSafe(F.col("mix_source"))
                        & (F.col("mix_size") == F.col("size_")) & (F.col("copy_") == F.col("mix_copy")))
    cut = met.withColumn("piece_", F.explode("mix_pieces")).withColumn(text_col, F.when(
        F.col("piece_")["words"] == F.col("mix_size"), text).otherwise(F.array_join(F.slice(
            F.regexp_extract_all(text, F.lit(WORD_WITH_SPACE), F.lit(0)),
            (F.col("piece_")["first_word"] + 1).cast("int"), F.col("piece_")["words"].cast("int")), "")))
    return cut.select(*docs.columns, *[F.col("piece_")[c].alias(c) for c in ("shard", "epoch", "at")])


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, 3 * sum(size)::BIGINT AS cap,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, (sum(ss) OVER ()) AS total, row_number() OVER f AS r,
    ((sum(ss) OVER ()) - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM w WINDOW f AS (ORDER BY cap / weight, place)),
t AS (SELECT f.*, CASE WHEN cap < weight * level THEN cap::DOUBLE ELSE weight *
    (SELECT arg_min(level, r) FROM f WHERE NOT cap < weight * level) END AS target,
    CASE WHEN ss > 0 THEN (('0x' || substr(sha256('{SEED}:' || coalesce(source, '')), 1, 15))::BIGINT % ss)::BIGINT
         ELSE 0 END AS first FROM f),
q AS (SELECT place, j FROM (SELECT place, target, unnest(range(0, (cap + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS})) AS j, total FROM t)
    QUALIFY row_number() OVER (ORDER BY (2 * j + 1) / target, place, j) <= floor(total / {BLOCK_TOKENS} + 0.5)),
b AS (SELECT t.*, first + least((SELECT count(*) FROM q WHERE q.place = t.place) * {BLOCK_TOKENS}, cap) AS last FROM t),
p AS (SELECT d.doc_id, d.size, b.ss, b.target, b.first, b.last,
    (sum(d.size) OVER (PARTITION BY b.place ORDER BY d.h, d.doc_id) - d.size)::BIGINT AS a
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, ss AS source_size, target, CASE WHEN ss = 0 THEN 0 ELSE
    (last // ss - first // ss) * size + greatest(0, least(last % ss - a, size))
    - greatest(0, least(first % ss - a, size)) END::BIGINT AS taken
FROM p
"""
