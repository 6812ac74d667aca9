"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

LEVELS = ("domain", "lang", "source")


def words(text: Column) -> Column:
    """Tokens for budgets: runs of characters that aren't ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source, where documents have none: one of four, by the
    last digit of its name; null and other names belong to domain 0."""
    digit = F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9])$", 1), F.lit("9")), F.lit(0)).cast("int")
    return F.concat(F.lit("domain"), (digit % 4).cast("string"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, the tree's levels (null: the empty name) and the text."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    domain = level("domain") if "domain" in docs.columns else domain_of(level("source"))
    return docs.select("doc_id", domain.alias("domain"), level("lang").alias("lang"), level("source").alias("source"), text_of(docs).alias("text"))


def _weight(names: Mapping[str, int] | None, level: str) -> Column:
    """The weight of a name; 1 where none is given."""
    out = F.lit(1).cast("long")
    for name, w in (names or {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def shared_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Adds ``budget`` to siblings (columns: ``parent``, ``level``, weight, cap and
    the parent's total) so that none exceeds its cap.

    By rising cap / weight, a sibling is full if its cap is at most its share of
    what those before it leave; the others divide the rest by weight. A full
    sibling's shortage so goes to its siblings; what a whole family can't take
    is beyond its parent's cap, and has gone to the parent's siblings before.
    Shares are whole tokens, rounded down; weights of 0 get nothing.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    ratio = F.col("cap").cast("double") / F.col("weight")
    nodes = nodes.withColumn("w", F.col("weight")).where("weight > 0")
    order = Window.partitionBy(*parent).orderBy(ratio, level)
    whole = Window.partitionBy(*parent)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns({"k": F.row_number().over(order), "r": F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "rw": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    full = big("cap") * big("rw") <= big("r") * big("w")
    nodes = nodes.withColumn("at", F.coalesce(F.min(F.when(~full, F.col("k"))).over(whole), F.lit(1 << 30)))
    nodes = nodes.withColumns({"pr": F.max(F.when(F.col("k") == F.col("at"), F.col("r"))).over(whole), "pw": F.max(F.when(F.col("k") == F.col("at"), F.col("rw"))).over(whole)})
    share = F.expr("cast(cast(w as decimal(19,0)) * cast(pr as decimal(19,0)) div cast(pw as decimal(19,0)) as bigint)")
    return nodes.withColumn("budget", F.when(F.col("k") < F.col("at"), F.col("cap")).otherwise(share)).drop("w", "k", "r", "rw", "at", "pr", "pw")


def budgets(stats: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int) -> DataFrame:
    """stats: a row for each leaf with its tokens. Adds budget, from the root
    down: ``share`` of all tokens, and of a leaf at most ``max_epochs`` times its own."""
    stats = stats.withColumn("cap", F.col("tokens") * max_epochs)
    above: DataFrame | None = None
    for k, level in enumerate(LEVELS):
        nodes = stats.groupBy(*LEVELS[: k + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(weights.get(level), level))
        if above is None:
            total = stats.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("long").alias("total"))
            nodes = nodes.withColumn("root", F.lit(0)).join(total.withColumn("root", F.lit(0)), "root").withColumn("total", F.least("total", F.sum("cap").over(Window.partitionBy("root"))))
            above = shared_out(nodes, ["root"], level).drop("root")
        else:
            nodes = nodes.join(above.select(*LEVELS[:k], F.col("budget").alias("total")), list(LEVELS[:k]))
            above = shared_out(nodes, list(LEVELS[:k]), level)
    return above.select(*LEVELS, "tokens", "cap", "budget")


def order_key(seed: int, epoch: str) -> Column:
    """The place of a document in a seeded epoch, as hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def counted(docs: DataFrame) -> DataFrame:
    """Written: doc_id, the levels and the tokens n of every row; texts are read
    and counted once, all that follows reads this table."""
    return written(leaves(docs).select("doc_id", *LEVELS, words(F.col("text")).alias("n")), "counted")


def plan(rows: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int, seed: int) -> DataFrame:
    """For each leaf its budget, whole epochs and the last order key of its prefix
    of the next epoch (empty: none). Prefix sums run over 4096 ranges of the key
    first and only inside the range where the budget ends by document. rows: as
    ``counted`` gives them."""
    stats = rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    known = written(budgets(stats, weights, share, max_epochs).where("tokens > 0 and budget > 0")
                    .withColumns({"epochs": F.expr("budget div tokens"), "rest": F.expr("budget % tokens")}), "budgets")
    part = rows.join(known.where("rest > 0").select(*LEVELS, "epochs", "rest"), list(LEVELS)).withColumn("key", order_key(seed, "epochs")).withColumn("bucket", F.substring("key", 1, 3))
    sums = part.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n").alias("n"))
    until = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    ends = sums.withColumn("before", until - F.col("n")).where("before <= rest and before + n > rest").select(*LEVELS, "bucket", "before")
    ends = written(ends, "ends")
    inside = part.join(ends, [*LEVELS, "bucket"])
    so_far = F.sum("n").over(Window.partitionBy(*LEVELS, "bucket").orderBy("key"))  # rows of one key together
    last = inside.withColumn("sum", F.col("before") + so_far).groupBy(*LEVELS).agg(F.coalesce(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("key"))), F.max("bucket")).alias("last"))
    return written(known.join(last, list(LEVELS), "left").select(*LEVELS, "budget", "epochs", F.coalesce("last", F.lit("")).alias("last")), "mixing")


DEFAULT_WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def mixture(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = DEFAULT_WEIGHTS, share: float = 0.8, max_epochs: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies: the documents of the mixture.

    docs: doc_id, lang, source, text (null: empty) and maybe domain; null names
    are the empty name; other columns are ignored. ``share`` of all tokens is
    divided over domains, their languages and their sources by weight (1 where
    none is given). Of each leaf the whole epochs that its budget holds are
    taken and then the longest prefix of the next one's seeded order that fits;
    copies counts both. Rows of one doc_id stand together in that order.
    Documents that are not taken, and all of a leaf without tokens, are left
    out. An empty table gives an empty result.
    """
    rows = counted(docs)
    known = plan(rows, weights, share, max_epochs, seed)
    rows = rows.withColumnRenamed("n", "tokens").join(known, list(LEVELS))
    copies = F.col("epochs") + (order_key(seed, "epochs") <= F.col("last")).cast("long")
    return rows.select("doc_id", *LEVELS, "tokens", copies.alias("copies")).where("copies > 0")


def mixed(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = DEFAULT_WEIGHTS, share: float = 0.95, seed: int = 42, max_epochs: int = 1) -> DataFrame:
    """The rows of docs that ``mixture`` takes, each as often as its copies say.
    With one epoch the weights act only as far as small leaves have the tokens."""
    known = plan(counted(docs), weights, share, max_epochs, seed)
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    domain = level("domain") if "domain" in docs.columns else domain_of(level("source"))
    mark = max((c for c in docs.columns), key=len, default="") + "_"  # names that no column of docs has
    leaf = known.select(*[F.col(c).alias(f"{mark}{c}") for c in (*LEVELS, "epochs", "last")])
    on = (domain == F.col(f"{mark}domain")) & (level("lang") == F.col(f"{mark}lang")) & (level("source") == F.col(f"{mark}source"))
    copies = F.col(f"{mark}epochs") + (order_key(seed, f"{mark}epochs") <= F.col(f"{mark}last")).cast("long")
    taken = docs.join(leaf, on).withColumn(f"{mark}copies", copies).where(F.col(f"{mark}copies") > 0)
    if max_epochs > 1:
        taken = taken.withColumn(f"{mark}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{mark}copies"))))
    return taken.select(*docs.columns)
