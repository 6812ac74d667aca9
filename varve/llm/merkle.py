"""WARC records and a Merkle audit of their replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Children of a node: 2**FAN; page ids of a WARC file: 2**FILE.
FAN, FILE = 5, 8
_NO_ID = -(1 << 40)


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The WARC/1.0 resource record of a page; nulls are empty."""
    body, head = F.coalesce(html, F.lit("")), F.lit("\r\n")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), head, head, body, head, head)


def records(pages: DataFrame) -> DataFrame:
    """page_id, file, digest, length of every page's record; the text stays behind."""
    record = warc_record(F.col("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), record.alias("record"))
    file = F.coalesce(F.shiftright("page_id", FILE), F.lit(_NO_ID))
    return rows.select("page_id", file.alias("file"), F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"))


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds pos (from 0), start (byte offset in the file), copy (from 1 among the
    rows of a page_id) and leaf, the hash of a record's range and content."""
    order = Window.partitionBy(*by, "file").orderBy(F.asc_nulls_first("page_id"), "digest")
    same = Window.partitionBy(*by, "file", "page_id").orderBy("digest")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    rows = rows.withColumns({"pos": F.row_number().over(order).cast("long") - 1, "start": before, "copy": F.row_number().over(same)})
    return rows.withColumn("leaf", F.sha2(F.concat_ws(":", "start", "length", "digest"), 256))


def _parents(nodes: DataFrame, by: list[str], key: list[str], index: str) -> DataFrame:
    """One level up: nodes ``index`` >> FAN under ``key``; hash over the children in order."""
    up = nodes.withColumn("up", F.shiftright(index, FAN)).groupBy(*by, *key, "up").agg(
        F.sort_array(F.collect_list(F.struct(index, "hash"))).alias("c"), F.min("start").alias("start"), F.max("end").alias("end"))
    return up.select(*by, *key, F.col("up").alias(index), F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), ""), 256).alias("hash"), "start", "end")


def tree(rows: DataFrame, by: list[str]) -> list[DataFrame]:
    """Levels from the records to the root, of the trees that ``by`` tells apart.

    Inside a file a node covers 2**FAN ordered offset ranges, up to one node a
    file; above, a node covers 2**FAN neighbouring files, up to one root. No
    node has more children, so no task gathers more. Each level is written.
    """
    level = rows.select(*by, "file", F.col("pos").alias("idx"), F.col("leaf").alias("hash"), "start", (F.col("start") + F.col("length")).alias("end"))
    out = [level]
    while True:
        level = written(_parents(level, by, ["file"], "idx"), "merkle")
        out.append(level)
        if not level.where("idx > 0").limit(1).count():
            break
    level = level.select(*by, "file", "hash", F.lit(0).cast("long").alias("start"), "end")
    while True:
        level = written(_parents(level, by, [], "file"), "merkle")
        out.append(level)
        # negative numbers end at -1, all others at 0: the last two meet in the root
        if not level.where("file not in (-1, 0)").limit(1).count():
            break
    top = level.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("file", "hash"))).alias("c"), F.min("start").alias("start"), F.max("end").alias("end"))
    out.append(top.select(*by, F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), ""), 256).alias("hash"), "start", "end"))
    return out


def _differing(level: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose hashes differ between the sides, or that one side lacks."""
    return level.groupBy(*key).agg(F.count("*").alias("n"), F.min("hash").alias("x"), F.max("hash").alias("y")).where("n < 2 or x <> y").select(*key)


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, copy, status, start, length, sha256, replica_start,
    replica_length, replica_sha256: every record of both.

    pages, replica: page_id, url, html (nulls: empty); other columns are ignored.
    The records of 2**FILE page ids are one WARC file, in the order of (page_id,
    digest), nulls first and in a file of their own. Status: ``intact`` (same
    range and content), ``moved`` (same content elsewhere in its file),
    ``altered``, ``missing`` or ``extra`` in the replica. Roots are compared
    first and only differing branches are descended; records of equal branches
    are intact without being looked at. Rows repeated under a page_id are paired
    in the order of their digests. Two empty tables give no rows.
    """
    both = records(pages).withColumn("side", F.lit(0)).unionByName(records(replica).withColumn("side", F.lit(1)))
    rows = written(placed(both, ["side"]), "records")
    levels = tree(rows, ["side"])
    root = levels[-1].groupBy().agg(F.count("*").alias("n"), F.count_distinct("hash").alias("d")).first()
    mine = rows.where("side = 0")
    blank = F.lit(None)
    intact = mine.select("page_id", "copy", F.lit("intact").alias("status"), "start", "length", F.col("digest").alias("sha256"), F.col("start").alias("replica_start"), F.col("length").alias("replica_length"), F.col("digest").alias("replica_sha256"), "file", F.shiftright("pos", FAN).alias("idx"))
    if root["n"] == 2 and root["d"] == 1 or not root["n"]:
        return intact.drop("file", "idx")
    files = [x for x in levels[1:-1] if "idx" not in x.columns]
    inside = [x for x in levels[1:-1] if "idx" in x.columns]
    bad = None
    for level in reversed(files):
        if bad is not None:
            level = level.withColumn("up", F.shiftright("file", FAN)).join(bad.select(F.col("file").alias("up")), "up", "left_semi")
        bad = written(_differing(level, ["file"]), "differ")
    for k, level in enumerate(reversed(inside)):
        if not k:  # one node a file: its number's parent is a node of files
            level = level.withColumn("up", F.shiftright("file", FAN)).join(bad.select(F.col("file").alias("up")), "up", "left_semi")
        else:
            level = level.withColumn("up", F.shiftright("idx", FAN)).join(bad.select("file", F.col("idx").alias("up")), ["file", "up"], "left_semi")
        bad = written(_differing(level, ["file", "idx"]), "differ")
    near = rows.withColumn("idx", F.shiftright("pos", FAN)).join(bad, ["file", "idx"], "left_semi")
    sides = [near.where(f"side = {s}").select(*[F.col(c).alias(f"{p}{c}") for c in ("file", "page_id", "copy", "start", "length", "digest")]) for s, p in ((0, "a_"), (1, "b_"))]
    same = (F.col("a_file") == F.col("b_file")) & F.col("a_page_id").eqNullSafe(F.col("b_page_id")) & (F.col("a_copy") == F.col("b_copy"))
    status = (F.when(F.col("b_file").isNull(), "missing").when(F.col("a_file").isNull(), "extra").when(F.col("a_digest") != F.col("b_digest"), "altered")
              .when(F.col("a_start") != F.col("b_start"), "moved").otherwise("intact"))
    located = sides[0].join(sides[1], same, "full_outer").select(
        F.when(F.col("a_file").isNull(), F.col("b_page_id")).otherwise(F.col("a_page_id")).alias("page_id"), F.coalesce("a_copy", "b_copy").alias("copy"), status.alias("status"),
        F.col("a_start").alias("start"), F.col("a_length").alias("length"), F.col("a_digest").alias("sha256"), F.col("b_start").alias("replica_start"), F.col("b_length").alias("replica_length"), F.col("b_digest").alias("replica_sha256"))
    return intact.join(bad, ["file", "idx"], "left_anti").drop("file", "idx").unionByName(located)


def aged(pages: DataFrame) -> DataFrame:
    """A replica with faults by rule, from the first three hex digits of the md5 of
    page_id as text: of 4096 pages 12 have a character replaced, 1 is missing and 1
    is stored twice."""
    draw = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 3)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    half = F.floor(F.char_length(html) / 2).cast("int")
    worn = F.concat(F.substring(html, F.lit(1), half), F.lit("¤"), F.substring(html, half + 2, F.char_length(html)))
    rows = pages.select("page_id", "url", F.when(draw < "00c", worn).otherwise(html).alias("html"), draw.alias("draw"))
    copies = F.when(F.col("draw") == "c80", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("draw <> '640'").select("page_id", "url", "html", F.explode(copies).alias("k")).drop("k")
