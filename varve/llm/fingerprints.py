"""SimHash document fingerprints and permuted block tables, in DataFrame
operations only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: Neighbours in doc_id order meet in buckets of 2**BUCKET ids.
BUCKET = 6


def term_hashes(text: str, size: int = 5) -> list[str]:
    """SQL for the term hashes of a text column, in steps to be selected one
    after the other as w and then t: for each place its pair of neighbouring
    words (p) and, where ``size`` words follow, their shingle (s). Every term
    counts as often as it occurs; the only word of a text is a term."""
    words = f"filter(split(lower({text}), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    shingle = f"xxhash64({', '.join(f'w[i + {k}]' for k in range(size))})"
    return [f"transform({words}, w -> xxhash64(w))", f"""
        transform(if(size(w) = 0, cast(array() AS array<int>), sequence(0, greatest(size(w) - 2, 0))),
        i -> named_struct('p', xxhash64(w[i], get(w, i + 1)), 's', if(i + {size} <= size(w), {shingle}, cast(null AS bigint))))"""]


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and fp: the signed votes of each row's term hashes, as a long.

    Bits i and i + 32 of a hash are counted in the halves of one long, so 32
    sums hold the votes of a row and combine before the shuffle. A bit is 1 if
    set in over half of the votes; texts without terms have fingerprint 0.
    """
    w, t = term_hashes(text)
    terms = rows.selectExpr(*keys, f"{w} AS w").selectExpr(*keys, f"{t} AS t").select(*keys, F.explode_outer("t").alias("t"))
    terms = terms.select(*keys, "t.p", F.coalesce("t.s", F.lit(0)).alias("s"), F.col("t.s").isNotNull().cast("int").alias("has"))
    lanes = F.lit((1 << 32) | 1)
    lane = lambda c, i: F.shiftrightunsigned(c, i).bitwiseAND(lanes)
    sums = [F.sum(lane("p", i) + lane("s", i)).alias(f"s{i}") for i in range(32)]
    votes = terms.groupBy(*keys).agg((F.count("p") + F.sum("has")).alias("n"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"s{i}", 32)
        for bit, count in ((i, low), (i + 32, high)):
            one = (1 << bit) - (1 << 64 if bit == 63 else 0)
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(one)).otherwise(F.lit(0)).cast("long"))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return (64 - F.bit_count(a.bitwiseXOR(b))) / F.lit(64.0)


def block_bounds(radius: int, n: int) -> list[int]:
    """Bounds of the blocks for n fingerprints: as few blocks over ``radius`` + 2
    as let those that lead a table hold at least log2(n) bits, so that a bucket
    holds few rows whatever their number."""
    count = radius + 2
    while 64 * (count - radius) // count < n.bit_length() and count < radius + 5:
        count += 1
    return [64 * k // count for k in range(count + 1)]


def near_links(distinct: DataFrame, radius: int = 3, n: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of fingerprints within ``radius`` bits, each once.

    distinct: fp, each value once. Differing bits leave all but ``radius`` of the
    blocks equal: for every choice of so many blocks a table holds the
    fingerprints permuted so that these lead, and rows that agree on them meet.
    A pair that meets in several tables is taken from the first.
    """
    bounds = block_bounds(radius, distinct.count() if n is None else n)
    tables = list(combinations(range(len(bounds) - 1), len(bounds) - 1 - radius))
    part = lambda c, j: F.shiftrightunsigned(c, bounds[j]).bitwiseAND(F.lit((1 << (bounds[j + 1] - bounds[j])) - 1))
    rows = []
    for k, blocks in enumerate(tables):
        key = F.lit(k).cast("long")
        for j in blocks:
            key = F.shiftleft(key, bounds[j + 1] - bounds[j]).bitwiseOR(part(F.col("fp"), j))
        rows.append(F.struct(F.lit(k).alias("k"), key.alias("key")))
    entries = distinct.select("fp", F.explode(F.array(*rows)).alias("x"))
    a, b = entries.select("x.k", "x.key", F.col("fp").alias("a")), entries.select("x.key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    equal = lambda blocks: x.bitwiseAND(F.lit(_signed(sum((1 << bounds[j + 1]) - (1 << bounds[j]) for j in blocks)))) == 0
    earliest = F.lit(len(tables))
    for k in reversed(range(len(tables))):
        earliest = F.when(equal(tables[k]), F.lit(k)).otherwise(earliest)
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (F.bit_count(x) <= radius) & (F.col("k") == earliest)).select("a", "b")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def successors(buckets: DataFrame, levels: int = 10, step: int = 7) -> DataFrame:
    """(bucket, after): each value of ``bucket`` and the next larger one, null
    behind the last. Rows look for it in windows of 2**step values, then those
    that end a window in one of 2**step windows, and so on: no task sorts all."""
    found = None
    # a row per open interval end: ``last`` of one window, ``first`` of another
    level = buckets.select(F.col("bucket").alias("first"), F.col("bucket").alias("last"))
    for k in range(1, levels + 1):
        group = F.shiftright("first", k * step) if k * step < 64 else F.lit(0).cast("long")
        w = Window.partitionBy("g").orderBy("first")
        seen = written(level.withColumn("g", group).withColumn("after", F.lead("first").over(w)), "next")
        done = seen.where("after is not null").select(F.col("last").alias("bucket"), "after")
        found = done if found is None else found.unionByName(done)
        level = seen.groupBy("g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")
        if level.limit(2).count() < 2:
            break
    return found.unionByName(level.select(F.col("last").alias("bucket"), F.lit(None).cast("long").alias("after")))


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, rn, doc_id, text, next_text, next_bucket, next_rn for every row of
    docs: the next row's text in the order of (doc_id, text), nulls first, the
    first row's behind the last. Text is shuffled once; only the first row of
    each bucket of ids travels to the bucket before."""
    bucket = F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BUCKET), F.lit(-(1 << 62)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), bucket.alias("bucket"))
    w = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "text")
    rows = base.withColumns({"rn": F.row_number().over(w), "inner": F.lead("text").over(w)})
    order = written(successors(docs.select(bucket.alias("bucket")).distinct()), "order")
    first = order.agg(F.min("bucket")).first()[0]
    order = order.withColumn("after", F.coalesce("after", F.lit(first)))
    heads = rows.where("rn = 1").select(F.col("bucket").alias("after"), F.col("text").alias("head"))
    heads = heads.join(order, "after").select(F.col("bucket").alias("of"), F.col("after").alias("head_bucket"), "head")
    joined = rows.join(heads, rows["bucket"] == heads["of"], "left")
    last = F.col("inner").isNull()
    return joined.select("bucket", "rn", "doc_id", "text", F.coalesce("inner", "head").alias("next_text"), F.when(last, F.col("head_bucket")).otherwise(F.col("bucket")).alias("next_bucket"), F.when(last, F.lit(1)).otherwise(F.col("rn") + 1).alias("next_rn"))


def edited_pairs(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and near_fingerprints for every row of docs.

    docs: doc_id, text (null: empty); other columns are ignored. The edited text
    is the text with its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next row's, in the order of (doc_id, text),
    nulls first; behind the last row comes the first. near_fingerprints counts
    the other fingerprints of the table within ``radius`` bits. Repeated rows
    stay and follow each other. An empty table gives an empty result.
    """
    rows = with_next(docs)
    n, quarter = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.withColumns({"edited": edited, "n_chars": n.cast("long")})
    facts = ["bucket", "rn", "doc_id", "n_chars", "next_bucket", "next_rn"]
    both = F.array(F.struct(F.lit(0).alias("edit"), F.lit("").alias("sha"), F.col("text").alias("text")), F.struct(F.lit(1).alias("edit"), F.sha2("edited", 256).alias("sha"), F.col("edited").alias("text")))
    each = rows.select(*facts, F.explode(both).alias("x")).select(*facts, "x.edit", "x.sha", "x.text")
    fps = fingerprints(each, [*facts, "edit", "sha"])
    one = lambda edit, c: F.max(F.when(F.col("edit") == edit, F.col(c)))
    fps = written(fps.groupBy(*facts).agg(one(0, "fp").alias("fp"), one(1, "fp").alias("edited_fp"), one(1, "sha").alias("edited_sha256")), "fingerprints")
    after = fps.select(F.col("bucket").alias("next_bucket"), F.col("rn").alias("next_rn"), F.col("fp").alias("next_fp"))
    distinct = written(fps.select("fp").distinct(), "fp")
    # pairs are counted where they are found: none is written or shuffled
    degree = near_links(distinct, radius).select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("near"))
    hex_ = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    out = fps.join(after, ["next_bucket", "next_rn"]).join(degree, "fp", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", hex_("fp").alias("fingerprint"), hex_("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.coalesce("near", F.lit(0)).cast("long").alias("near_fingerprints"))
