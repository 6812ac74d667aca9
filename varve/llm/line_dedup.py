"""Line dedup by a segment-partition edit join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .components import components

# Characters whose counts make up the filter, each by two bits.
LETTERS = "aentirsolhdcumpgbfvyz0123456789"
#: One edit from 20 code points on; shorter lines have no near lines, only copies.
#: (least length, edits) for the shorter line of a pair, rising in both.
ONE_EDIT = ((20, 1),)
#: One edit for every 20 code points of the shorter line, three at most.
BY_LENGTH = ((20, 1), (40, 2), (60, 3))
Bands = tuple[tuple[int, int], ...]
#: Buckets of more rows than the first are narrowed further where one edit is
#: allowed; where more are, those above the second run along pivots, at most so
#: many levels.
SMALL, CHUNK, LEVELS = 512, 64, 4
_KEYS = "array<struct<key:bigint,lo:int,hi:int,own:int>>"


def letter_counts(line: str = "line") -> Column:
    """The counts of LETTERS modulo 4 as Gray codes: one edit changes at most two
    counts by one, and so at most two bits."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        count = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(3))
        gray = count.bitwiseXOR(F.shiftright(count, 1)).cast("long")
        out = out.bitwiseOR(F.shiftleft(gray, 2 * k))
    return out


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of ``parts`` even segments of n."""
    a, b = (F.floor(n * j / parts) for j in (i, i + 1))
    return a, b - a


def bands_of(max_edits: int | Bands) -> Bands:
    """Edits by length; a number holds from 20 code points on (or, where that is
    more, from one above itself)."""
    return max_edits if isinstance(max_edits, tuple) else ((max(20, max_edits + 1), max_edits),)


def edits_for(n: Column, bands: Bands) -> Column:
    """The edits that a line of n code points allows, null below all bands."""
    out = F.lit(None).cast("int")
    for least, k in bands:
        out = F.when(n >= least, F.lit(k)).otherwise(out)
    return out


def keys(bands: Bands, bare: bool = False) -> Column:
    """The segment index entries of the column ``line`` of ``n`` code points.

    Table keys (lowest bit 0): each of the k + 1 segments with the line's
    length, k being the edits of its band. Probe keys (lowest bit 1): the
    substrings that may match a segment of a line shorter by delta = 0 .. k, by
    both bounds on the shift; those equal to a table key are left out. Where one
    edit is allowed, lo and hi bound the part that the key leaves open; a code
    point too many that could as well be deleted elsewhere counts where it comes
    first, and such places belong to the key from ``own`` on. ``bare``: the
    keys alone.
    """
    kind, lists = "array<bigint>" if bare else _KEYS, []
    for delta in range(max(k for _, k in bands) + 1):
        n = F.col("n") - delta
        choice = F.array().cast(kind)
        for least, k in bands:
            out = []
            for i in range(k + 1) if delta <= k else ():
                a, size = _segment(n, i, k + 1)
                left, right = (-i, i), (delta - (k - i), delta + k - i)
                for shift in range(max(left[0], right[0]), min(left[1], right[1]) + 1):
                    # a substring that overruns a short line's ends is only one more candidate
                    piece = F.substring(F.col("line"), (a + shift + 1).cast("int"), size.cast("int"))
                    probe = 0 if shift == delta == 0 else 1
                    key = F.xxhash64(piece, n.cast("int"), F.lit(i)).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(probe).cast("long"))
                    if bare:
                        out.append(key)
                        continue
                    spots = (size, F.col("n"), size + 1) if i == 0 else (F.lit(0), a + shift, F.lit(0))
                    lo, hi, own = (x.cast("int") if k == 1 else F.lit(None).cast("int") for x in spots)
                    out.append(F.struct(key.alias("key"), lo.alias("lo"), hi.alias("hi"), own.alias("own")))
            choice = F.when(n >= least, F.array(*out).cast(kind)).otherwise(choice)
        lists.append(choice)
    return F.concat(*lists)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no (from 0), line, n (code points) and the line's
    identity (h1, h2), for all lines but those of ASCII white space."""
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    return rows.withColumns({"n": F.char_length("line"), "h1": F.xxhash64("line"), "h2": F.crc32(F.col("line").cast("binary"))})


def occurrences(docs: DataFrame, bands: Bands) -> DataFrame:
    """Written: doc_id, text_hash, line_no, h1, h2 and the index keys of every
    line. All that follows reads this narrow table in place of the texts. Keys
    keep 48 bits, which take less disk; two that agree there only add candidates."""
    found = F.when(F.col("n") >= bands[0][0], F.transform(keys(bands, bare=True), lambda x: x.bitwiseAND(F.lit((1 << 48) - 1))))
    return written(lines(docs).select("doc_id", "text_hash", "line_no", "h1", "h2", found.alias("keys")), "lines")


def maybe_among(rows: DataFrame, column: str, values: DataFrame, bits: int = 26, others: bool = False) -> DataFrame:
    """The rows whose long ``column`` is among ``values`` (its only column), and
    few others: a bitmap of 2**bits places, at most 8 MB for any number of
    values, goes to every task, so that the other rows aren't shuffled.
    ``others``: exactly the rows that the same call without it leaves out."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    place = spot(values.columns[0])
    spots = values.select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit(32767)).alias("bit"))
    bitmap = spots.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    marked = rows.withColumn("place", spot(column))
    place = F.col("place")
    joined = marked.join(F.broadcast(bitmap), F.shiftright(place, 15) == F.col("bucket"), "left" if others else "inner")
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(place.bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    there = F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1
    return joined.where(~F.coalesce(there, F.lit(False)) if others else there).select(*rows.columns)


def _shared(rows: DataFrame, of: str) -> DataFrame:
    """key63 and rows of the keys under which a table entry and another line
    meet; rows: x (key and its lowest bit) and the line's identity ``of``."""
    got = rows.groupBy(F.shiftright("x", 1).alias("key63")).agg(F.min(of).alias("low"), F.max(of).alias("high"), F.min(F.col("x").bitwiseAND(F.lit(1))).alias("probe"), F.count("*").alias("rows"))
    return got.where("probe = 0 and low <> high").select("key63", "rows")


def candidates(found: DataFrame) -> DataFrame:
    """h1 of the lines that share a key with another line, by ``occurrences``.

    Each different line counts its keys once, so that the largest shuffle holds
    keys and counts but no lines: lines that repeat combine before, the others
    stay where they are.
    """
    rows = found.where("keys is not null").select("h1", "keys")
    again = written(rows.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("again")), "line-copies")
    once = maybe_among(rows, "h1", again, others=True)
    some = maybe_among(rows, "h1", again).groupBy("h1").agg(F.first("keys").alias("keys"))
    entries = once.unionByName(some).select(F.explode("keys").alias("x"))
    # the sum: table entries by 2**32, all entries by one
    worth = F.when(F.col("x").bitwiseAND(F.lit(1)) == 0, F.lit((1 << 32) + 1)).otherwise(F.lit(1).cast("long"))
    counts = entries.select(F.shiftright("x", 1).alias("key63"), worth.alias("w")).groupBy("key63").agg(F.sum("w").alias("w"))
    shared = written(counts.where((F.col("w") >= 1 << 32) & (F.col("w").bitwiseAND(F.lit((1 << 32) - 1)) > 1)).select("key63"), "line-keys")
    near = maybe_among(rows.select("h1", F.explode("keys").alias("x")).select("h1", F.shiftright("x", 1).alias("key63")), "key63", shared).distinct()
    return near.join(shared, "key63").select("h1").distinct()


def _bucketed(rows: DataFrame) -> DataFrame:
    """The rows of buckets where a table entry meets another line, with the
    bucket's ``size``. rows: x, id, lo, hi, own, rest, sketch."""
    sizes = _shared(rows, "id").withColumnRenamed("rows", "size")
    return rows.withColumn("key63", F.shiftright("x", 1)).join(sizes, "key63")


def _narrowed(rows: DataFrame) -> DataFrame:
    """The index entries of a large bucket of one edit, one level down.

    All its table entries have m code points in the open part, probes m + 1. The
    edit lies in the left or the right half: under one new key the right halves
    are equal and the left ones open, under the other the reverse. Of an open
    part of one code point, a table entry is all behind or all before a probe's
    edit.
    """
    probe = F.col("x").bitwiseAND(F.lit(1))
    m = F.col("hi") - F.col("lo") - probe.cast("int")
    mid = F.floor(m / 2).cast("int")
    cut = lambda a, size: F.substring(F.col("rest"), (a + 1).cast("int"), size.cast("int"))
    key = lambda side, piece: F.xxhash64(F.col("key63"), F.lit(side), piece).bitwiseAND(F.lit(-2)).bitwiseOR(probe)
    none, p = F.lit(0), probe.cast("int")
    first = F.when(m > 1, mid).otherwise(none)  # table's code points that stay open on the left
    left = F.struct(key(0, cut(first + p, m - first)).alias("x"), F.col("lo").alias("lo"), (F.col("lo") + first + p).alias("hi"), F.col("own").alias("own"), cut(none, first + p).alias("rest"))
    second = F.when(m > 1, mid).otherwise(F.lit(1))  # its code points equal on the left
    right = F.struct(key(1, cut(none, second)).alias("x"), (F.col("lo") + second).alias("lo"), F.col("hi").alias("hi"), (F.col("lo") + first + 1).alias("own"), cut(second, m - second + p).alias("rest"))
    return rows.select("id", "sketch", F.explode(F.array(left, right)).alias("y")).select("y.x", "id", "y.lo", "y.hi", "y.own", "y.rest", "sketch")


def _grouped(rows: DataFrame, texts: DataFrame, bands: Bands) -> DataFrame:
    """The lines of large buckets of several edits, dealt to hubs: key, id, u
    (edits spent), k (edits that the line allows), rest.

    Each bucket goes to the one of its lines that is in the most and largest of
    them, so that the buckets of one group of near copies mostly share a hub and
    a line is there once in place of once a key. Lines that share a bucket meet.
    """
    rows = rows.select("key63", "id", "size")
    score = rows.groupBy("id").agg(F.sum("size").alias("score"))
    hubs = rows.join(score, "id").groupBy("key63").agg(F.max(F.struct("score", "id")).alias("hub")).select("key63", "hub.id")
    members = rows.select("key63", "id").join(hubs.withColumnRenamed("id", "hub"), "key63").select("hub", "id").distinct()
    own = texts.select("id", edits_for(F.char_length("line"), bands).alias("k"), F.col("line").alias("rest"))
    return members.join(own, "id").select(F.xxhash64("hub").alias("key"), "id", F.lit(0).alias("u"), "k", "rest")


def _with_pivots(rows: DataFrame) -> DataFrame:
    """The entries with their key's pivot: a rest that begins as most of them do,
    up to half the length of the shortest."""
    half = rows.groupBy("key").agg(F.floor(F.min(F.char_length("rest")) / 2).cast("int").alias("half"))
    begun = rows.join(half, "key").groupBy("key", F.xxhash64(F.substring(F.col("rest"), F.lit(1), F.col("half"))).alias("begin"))
    begun = begun.agg(F.count("*").alias("n"), F.min(F.struct("u", F.xxhash64("id", "rest").alias("any"), "rest")).alias("best"))
    pivots = begun.groupBy("key").agg(F.max(F.struct("n", "begin", "best")).alias("most"))
    return rows.join(pivots.select("key", F.col("most.best.rest").alias("pivot")), "key")


def _diverged(rows: DataFrame, most: int) -> DataFrame:
    """The entries of ``_grouped`` one level down, for buckets of different lines.

    An entry runs along its pivot to the place a where they differ. Of two, the
    one that leaves the pivot earlier also differs from the other there, so it
    has to spend one edit: to take the pivot's code point for its own, to drop
    its own or to insert the pivot's. All three ways are followed while edits
    are left. So lines within their edits meet under one place, where the edits
    spent and those between the rests make up no more. At the ``end`` both have
    run through the pivot, and the edits spent alone bound their distance.
    """
    slid = lambda i, a: f"aggregate(steps, 0, (c, w) -> if({i} + c + w <= n and {a} + c + w <= m and substring(rest, {i} + c + 1, w) = substring(pivot, {a} + c + 1, w), c + w, c))"
    spot = lambda i, a: f"get(transform(array({slid(i, a)}), c -> named_struct('i', {i} + c, 'a', {a} + c)), 0)"
    rows = rows.withColumns({"n": F.char_length("rest"), "m": F.char_length("pivot")})
    rows = rows.withColumn("steps", F.expr("transform(sequence(cast(log2(greatest(n, 1)) as int) + 1, 0, -1), x -> shiftleft(1, x))"))
    rows = rows.withColumn("s0", F.expr(f"array({spot('0', '0')})"))
    for j in range(1, most + 1):
        ways = "array(named_struct('i', s.i + 1, 'a', s.a + 1), named_struct('i', s.i + 1, 'a', s.a), named_struct('i', s.i, 'a', s.a + 1))"
        there = f"flatten(transform(s{j - 1}, s -> filter({ways}, t -> t.i <= n and t.a <= m)))"
        before = ", ".join(f"s{x}" for x in range(j))
        rows = rows.withColumn(f"s{j}", F.expr(f"if(u + {j} > k, slice(s0, 1, 0), array_except(transform({there}, t -> {spot('t.i', 't.a')}), concat({before})))"))
    spots = ", ".join(f"transform(s{j}, s -> named_struct('u', u + {j}, 'i', s.i, 'a', s.a))" for j in range(most + 1))
    rows = rows.select("key", "id", "k", "rest", "n", "m", F.expr(f"explode(concat({spots}))").alias("t"))
    end = (F.col("t.i") == F.col("n")) & (F.col("t.a") == F.col("m"))
    rows = rows.select(F.xxhash64("key", "t.a", end).alias("key"), "id", "t.u", "k", end.alias("end"), F.expr("substring(rest, t.i + 1)").alias("rest"))
    rows = written(rows, "line-spots")
    sizes = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("u").alias("least"), F.count("*").alias("size"))
    sizes = sizes.where("low <> high").select("key", "least", "size")
    return written(rows.join(sizes, "key").where("u + least <= k").drop("least"), "line-places")


def _met(rows: DataFrame, most: int) -> DataFrame:
    """Pairs of the entries of one key whose edits suffice; more than CHUNK
    entries meet by pairs of chunks."""
    k = F.ceil(F.col("size") / CHUNK).cast("long")
    rows = rows.withColumn("sketch", letter_counts("rest")).withColumn("slot", F.pmod(F.xxhash64("id", "rest"), k)).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
    side = lambda x, p, q: rows.select(F.xxhash64("key", p, q).alias("met"), F.col("id").alias(x), F.col("u").alias(f"u{x}"), F.col("k").alias(f"k{x}"), F.col("rest").alias(f"r{x}"), F.char_length("rest").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    left = F.least("ka", "kb") - F.col("ua") - F.col("ub")
    alike = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2 * left - F.abs(F.col("na") - F.col("nb"))
    # equal ends don't count, and Spark's distance takes the square of the length
    tail, allowed = "greatest(least(na, nb) - 32, 0)", "least(ka, kb) - ua - ub"
    apart = F.expr(f"if(right(ra, {tail}) = right(rb, {tail}), levenshtein(substring(ra, 1, na - {tail}), substring(rb, 1, nb - {tail}), {allowed}), levenshtein(ra, rb, {allowed}))")
    near = (F.col("a") < F.col("b")) & (left >= 0) & alike & F.when(left == 0, F.col("ra") == F.col("rb")).otherwise(apart >= 0)
    return side("a", "slot", "d").join(side("b", "d", "slot"), "met").where(near).select("a", "b")


def _spanned(ends: DataFrame, bands: Bands) -> DataFrame:
    """Pairs that connect the entries at the end as all their links would: of
    those that allow at least j edits, for each j, the one with the fewest spent
    is within j of any that is within j of another."""
    levels = F.array(*(F.lit(k) for k in sorted({k for _, k in bands})))
    rows = ends.select("key", "id", "u", F.explode(F.filter(levels, lambda x: x <= F.col("k"))).alias("j"))
    hubs = rows.groupBy("key", "j").agg(F.min(F.struct("u", "id")).alias("hub"))
    return rows.join(hubs, ["key", "j"]).where("id <> hub.id and u + hub.u <= j").select(F.col("id").alias("a"), F.col("hub.id").alias("b"))


def _by_pivots(rows: DataFrame, texts: DataFrame, bands: Bands, counts: bool) -> list[DataFrame]:
    """Pairs of the large buckets of several edits (written): groups run along a
    pivot, level by level, until few entries are at one place. What is still
    large after LEVELS meets chunk by chunk. Without ``counts`` a star stands for
    the links at a pivot's end."""
    most, out = max(k for _, k in bands), []
    rows = written(_grouped(rows, texts, bands), "line-groups")
    for _ in range(LEVELS):
        rows = _diverged(_with_pivots(rows.select("key", "id", "u", "k", "rest")), most)
        ends, large = rows.where("end"), ~F.col("end") & (F.col("size") > SMALL)
        out.append(_met(ends, most) if counts else _spanned(ends, bands))
        out.append(_met(rows.where(~F.col("end") & ~large), most))
        rows = rows.where(large)
        if not rows.limit(1).count():
            return out
    return [*out, _met(rows, most)]


def _pairs(rows: DataFrame, most: int) -> DataFrame:
    """Candidate pairs of the buckets: a from a table entry, b a table entry of
    larger id or a probe, whose ``own`` stays."""
    probe = F.col("x").bitwiseAND(F.lit(1))
    t = rows.where(probe == 0).select("key63", F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("own").alias("la"), F.col("rest").alias("ra"))
    p = rows.select("key63", F.col("id").alias("b"), F.col("sketch").alias("sb"), probe.alias("p"), F.col("own").alias("lb"), F.col("rest").alias("rb"))
    # letter counts, and then the open parts, drop most pairs before their lines are fetched
    near = (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2 * most) & (F.col("ra").isNull() | (F.levenshtein("ra", "rb", 1) >= 0))
    # entries marked -1 stand there for probes only
    wanted = ((F.col("p") == 1) & (F.col("a") != F.col("b"))) | ((F.col("p") == 0) & (F.col("a") < F.col("b")) & (F.coalesce("la", F.lit(0)) >= 0) & (F.coalesce("lb", F.lit(0)) >= 0))
    return t.join(p, "key63").where(near & wanted).select("a", "b", F.when(F.col("p") == 1, F.col("lb")).alias("own"))


def within(a: str, b: str, max_edits: int) -> str:
    """SQL: whether the strings ``a`` and ``b`` are within ``max_edits`` edits.
    Bit d of a state word stands for the diagonal d - max_edits of the band; word
    e holds the diagonals that e edits reach. Each code point of b updates all
    diagonals of a word at once. The lambda variable t keeps the UTF-32 texts,
    so that they are made once a pair."""
    k, full = max_edits, (1 << (2 * max_edits + 1)) - 1
    at = lambda x, j: f"substr(t.{x}, 4 * ({j}) + 1, 4)"
    match = " + ".join(f"if(j >= {k - d} and {at('x', f'j + {d - k}')} = {at('y', 'j')}, {1 << d}, 0)" for d in range(2 * k + 1))
    start, state = [1 << k], ["(s.r0 & m)"]
    for e in range(1, k + 1):
        start.append((start[-1] | start[-1] << 1) & full)
        state.append(f"(((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | shiftleft({state[-1]}, 1)) & {full})")
    word = lambda v: "named_struct(" + ", ".join(f"'r{e}', {x}" for e, x in enumerate(v)) + ")"
    size = lambda x: f"cast(octet_length(t.{x}) div 4 as int)"
    marks = f"transform(if({size('y')} = 0, cast(array() as array<int>), sequence(0, greatest({size('y')}, 1) - 1)), j -> {match})"
    reached = f"aggregate({marks}, {word(start)}, (s, m) -> {word(state)}, s -> s.r{k})"
    last = f"{size('x')} - {size('y')}"
    near = f"if(abs({last}) > {k}, false, getbit(cast({reached} as long), greatest(least({last} + {k}, {2 * k}), 0)) = 1)"
    return f"get(transform(array(named_struct('x', encode({a}, 'UTF-32'), 'y', encode({b}, 'UTF-32'))), t -> {near}), 0)"


def verified(pairs: DataFrame, texts: DataFrame, bands: Bands) -> DataFrame:
    """The pairs whose lines are within the edits that the shorter one's band
    allows. Where ``own`` is known, b is the longer line of one deletion; where that
    could also be further left, the pair is left to the key that owns the place."""
    pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("va")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("vb")), "b")
    shorter = F.least(F.char_length("va"), F.char_length("vb"))
    before = F.concat(F.expr("substring(vb, 1, own - 1)"), F.expr("substring(vb, own + 1)"))
    pairs = pairs.where(F.col("own").isNull() | (F.col("own") == 0) | (before != F.col("va")))
    sound, allowed = F.lit(False), edits_for(shorter, bands)
    for k in sorted({k for _, k in bands}):
        sound = F.when(allowed == k, F.expr(within("va", "vb", k))).otherwise(sound)
    return pairs.where(sound)


def line_links(texts: DataFrame, bands: Bands, counts: bool = True) -> DataFrame:
    """a, b, wa, wb: verified links that connect all near lines, with the number
    of links that each gives to its ends; without ``counts``, fewer links that
    connect the same lines.

    texts: id (h1, h2) and line, for candidates; each line once. Buckets of few
    rows yield their pairs. Larger ones of one edit are narrowed until they are
    small, or until their open part is one code point: those lines are all
    linked, and a star with counts stands for their pairs. Larger buckets of
    more edits run along pivots.
    """
    most = max(k for _, k in bands)
    rows = texts.withColumns({"n": F.char_length("line"), "sketch": letter_counts()})
    rows = rows.select("id", "sketch", "line", F.explode(keys(bands)).alias("y"))
    rest = F.when(F.col("y.lo").isNotNull(), F.substring(F.col("line"), F.col("y.lo") + 1, F.col("y.hi") - F.col("y.lo")))
    rows = rows.select(F.col("y.key").alias("x"), "id", "y.lo", "y.hi", "y.own", rest.alias("rest"), "sketch")
    pairs, stars, several = [], [], F.col("lo").isNull()
    while True:
        rows = written(_bucketed(rows), "line-buckets")
        pairs.append(_pairs(rows.where(F.col("size") <= F.when(several, CHUNK).otherwise(SMALL)), most))
        large = rows.where(several & (F.col("size") > CHUNK))
        if most > 1 and len(pairs) == 1 and large.limit(1).count():
            pairs += [p.withColumn("own", F.lit(None).cast("int")) for p in _by_pivots(large, texts, bands, counts)]
        rows = rows.where((F.col("size") > SMALL) & ~several)
        if not rows.limit(1).count():
            break
        probe = F.col("x").bitwiseAND(F.lit(1)) == 1
        m = F.col("hi") - F.col("lo") - probe.cast("int")
        # no code point is open: the one table entry meets every probe
        pairs.append(_pairs(rows.where(m == 0), most))
        equal = rows.where((m == 1) & ~probe)
        hubs = equal.groupBy("key63").agg(F.min("id").alias("b"), (F.count("*") - 1).alias("wa")).where("wa > 0")
        stars.append(equal.join(hubs, "key63").select(F.col("id").alias("a"), "b", "wa"))
        rows = _narrowed(rows.where(m > 0))
    found = None
    for p in pairs:
        found = p if found is None else found.unionByName(p)
    if most > 1:  # a pair of several edits may share several keys
        found = found.where("own is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "own").distinct().unionByName(found.where("own is not null"))
    one = F.lit(1).cast("long")
    found = found.withColumns({"wa": one, "wb": one})
    for s in stars:
        found = found.unionByName(s.withColumns({"own": F.lit(None).cast("int"), "wb": F.lit(0).cast("long")}))
    return verified(found, texts, bands).select("a", "b", "wa", "wb")


def classes(docs: DataFrame, found: DataFrame, bands: Bands, counts: bool = True) -> DataFrame:
    """h1, h2, class (doc_id, line_no, text_hash of the first line), links: a row
    for each different line that repeats or has near lines. found: the
    ``occurrences`` of docs. Without ``counts``, links may be fewer."""
    ids = written(candidates(found), "line-candidates")
    # copies combine before anything is joined
    texts = maybe_among(lines(docs).select("h1", "h2", "line"), "h1", ids).groupBy("h1", "h2").agg(F.min("line").alias("line"))
    texts = written(texts.join(ids, "h1").select(F.struct("h1", "h2").alias("id"), "line"), "line-texts")
    links = written(line_links(texts, bands, counts), "line-links")
    ends = links.select(F.col("a").alias("id"), F.col("wa").alias("w")).unionByName(links.select(F.col("b").alias("id"), F.col("wb").alias("w")))
    degree = ends.groupBy("id").agg(F.sum("w").alias("links"))
    roots = written(components(links).select(F.col("node").alias("id"), "root").join(degree, "id"), "line-roots")
    first = F.struct("doc_id", "line_no", "text_hash")
    exact = found.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    exact = exact.join(roots.select("id.h1", "id.h2", "root", "links"), ["h1", "h2"], "left").where("n > 1 or root is not null")
    exact = written(exact, "line-firsts")
    near = exact.where("root is not null")
    of = near.groupBy("root").agg(F.min("first").alias("class"))
    near = near.join(of, "root").select("h1", "h2", "class", "links")
    return written(near.unionByName(exact.where("root is null").select("h1", "h2", F.col("first").alias("class"), F.lit(0).cast("long").alias("links"))), "line-classes")


def duplicate_lines(docs: DataFrame, max_edits: int | Bands = ONE_EDIT) -> DataFrame:
    """doc_id, line_no, class_doc_id, class_line_no, links, kept: a row for each
    line that isn't blank (ASCII white space).

    docs: doc_id, text (null: empty); other columns are ignored. Lines are the
    parts between line feeds. Equal lines of any length, and lines that a chain
    of links joins, form a class, named by its first line in the order of
    (doc_id, line_no), nulls first; only that line is kept. Two lines are linked
    within ``max_edits`` edits: bands by the shorter one's length as in ONE_EDIT
    and BY_LENGTH, or a number for all lines of 20 code points or more. links
    counts the different lines linked. Rows repeated under one doc_id with the
    same text count as one place: all keep their lines or none. An empty table
    gives an empty result.
    """
    bands = bands_of(max_edits)
    rows = occurrences(docs, bands)
    found = classes(docs, rows, bands)
    own = F.struct("doc_id", "line_no", "text_hash")
    out = rows.select("doc_id", "line_no", "text_hash", "h1", "h2").join(found, ["h1", "h2"], "left")
    out = out.withColumn("own", own).withColumn("class", F.coalesce("class", "own"))
    return out.select("doc_id", "line_no", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.col("class").eqNullSafe(F.col("own")).alias("kept"))


def without_duplicate_lines(docs: DataFrame, max_edits: int | Bands = ONE_EDIT) -> DataFrame:
    """The rows of docs, each text without the lines that ``duplicate_lines``
    doesn't keep. Columns stay; n_chars, where there is one, is counted anew.
    Documents stay even where no line is left; null texts without lines stay null."""
    bands = bands_of(max_edits)
    rows = occurrences(docs, bands)
    found = classes(docs, rows, bands, counts=False)
    own = F.struct("doc_id", "line_no", "text_hash")
    gone = rows.select("doc_id", "line_no", "text_hash", "h1", "h2").join(found, ["h1", "h2"]).where(~F.col("class").eqNullSafe(own))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    # names that no column of docs has
    mark = max((c for c in docs.columns), key=len, default="") + "_"
    gone = gone.select(F.col("doc_id").alias(f"{mark}id"), F.col("text_hash").alias(f"{mark}hash"), F.col("gone").alias(f"{mark}gone"))
    text, lost = text_of(docs), F.col(f"{mark}gone")
    same = F.col("doc_id").eqNullSafe(F.col(f"{mark}id")) & (F.col(f"{mark}text") == F.col(f"{mark}hash"))
    joined = docs.withColumn(f"{mark}text", F.xxhash64(text)).join(gone, same, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    new = {"text": F.when(lost.isNull(), F.col("text")).otherwise(kept)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost.isNull(), F.col("n_chars")).otherwise(F.char_length(kept).cast("long"))
    return joined.withColumns(new).select(*docs.columns)
