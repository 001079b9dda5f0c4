"""Column functions: deterministic weights and draws of edges."""

from pyspark.sql import Column, DataFrame, functions as F

#: Draws lie below this prime.
PRIME = 2_147_483_647
#: Rows of one key that a task joins with all of the other side's.
HUB = 2_000


def edge_probability(src: Column, dst: Column) -> Column:
    """Activation probability of an edge in [0, 1), from its ends."""
    return ((src * 7919 + dst * 104729) % 1000) / F.lit(1000.0)


def edge_draw(src: Column, dst: Column, sim: Column) -> Column:
    """The draw of an edge in simulation ``sim``, in [0, 1)."""
    return ((src * 31 + dst * 17 + sim * 7907) % 1000) / F.lit(1000.0)


def draw(seed: int, *columns: Column) -> Column:
    """A number in [0, PRIME) from whole numbers, by arithmetic alone, so that any SQL
    engine gives the same."""
    h = F.lit(seed % PRIME).cast("long")
    for c in columns:
        h = F.pmod(h * 48_271 + F.pmod(c, F.lit(PRIME)), F.lit(PRIME))
        h = F.pmod(F.pmod(h * h + 12 * h, F.lit(PRIME)) * 48_271, F.lit(PRIME))
    return h


def hub_join(left: DataFrame, right: DataFrame, keys: list[str], hub: int = HUB) -> DataFrame:
    """The join of two tables whose keys may be hubs: the rows of a key that ``left`` has
    over ``hub`` times are dealt over as many tasks as that takes, and its rows of
    ``right`` go to each of them. No task makes a hub's pairs alone."""
    parts = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("__parts")).where("__parts > 1")
    of = F.coalesce("__parts", F.lit(1))
    rest = [c for c in left.columns if c not in keys]
    a = left.join(parts, keys, "left").withColumn("__part", F.pmod(F.xxhash64(*rest), of).cast("int")).drop("__parts")
    b = right.join(parts, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), of - 1))).drop("__parts")
    return a.join(b, [*keys, "__part"]).drop("__part")
