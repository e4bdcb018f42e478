"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line of at least ``MIN_CHARS`` characters is a repeat if an equal line, or one within ``max_edits`` edits, or one that
a chain of such steps reaches, stands earlier (smaller doc_id, then earlier in the text). Repeats go; the first line of each
class stays, and so do shorter lines.

Join. Equal lines collapse to one, with its first place and count. A distinct line of n characters is cut in max_edits + 1
segments; a line within max_edits of it has one of them unchanged, at a start that the edits before and after
it bound. Each line files its own segments and the substrings that could be a segment of lines of its length
or up to max_edits less. Lines that share a key are compared in the join itself, by their lengths and counts of frequent characters, which two edits
change little, and by Spark's bounded levenshtein, so that not all pairs of a family of alike lines leave it; what leaves it is
verified by banded bit-parallel edit distance on the lines.

Large keys. Every member of a key is compared with its hub first, the member that shares most places with others. What
the hubs link is contracted to components, and only members of different components are compared further, so a group
of near copies does not make all its pairs. A key that more than ``HOT`` lines share is split further before: what is left of
its lines without the shared segment is within max_edits too, so it is cut in segments again, level by level, until no
key is hot, or has one component, or what is left is so short that all its lines are near.

Null and empty texts have no lines that count; a document whose lines all go keeps an empty text; rows that repeat an id
are one document, each keeps what the first keeps; a null id counts as the smallest; extra columns are carried; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linekin.llm.common import drop_stored, small, stored
from linekin.operators.graph import components

MIN_CHARS = 20
MAX_EDITS = 2
#: Lines of a key that are compared in one task, at most.
HOT = 4096
#: Characters that are counted, one byte each; in other scripts they are rare and more pairs are confirmed.
COUNTED = " etaoinsrhldcum."
#: Rows that may be sent to every task, and the numbers in them.
FEW, FEW_NUMBERS = 250_000, 4_000_000


def starts(n: Column, k: int, parts: int) -> tuple[Column, Column]:
    """(start from 0, length) of segment k of n characters: the last n mod parts segments are one longer."""
    base = F.floor(n / parts).cast("int")
    longer = (n % parts).cast("int")
    return k * base + F.greatest(F.lit(0), F.lit(k) - (F.lit(parts) - longer)), base + (F.lit(k) >= F.lit(parts) - longer).cast("int")


def places(n: Column, edits: int) -> Iterator[tuple[Column, int, Column, Column]]:
    """(length of the indexed line, segment, start, length) of each substring that a line of n characters files."""
    parts = edits + 1
    for less in range(edits + 1):
        m = n - less
        for k in range(parts):
            at, size = starts(m, k, parts)
            low, high = max(-k, less - (edits - k)), min(k, less + (edits - k))
            for shift in range(low, high + 1):
                yield m, k, at + shift, size


def filed(text: Column, group: Column, edits: int) -> list[Column]:
    """The key, start and length of each place of a text; a place that does not exist has a null key."""
    n = F.char_length(text).cast("int")
    out = []
    for m, k, at, size in places(n, edits):
        exists = (m > edits) & (at >= 0) & (at + size <= n)
        key = F.when(exists, F.xxhash64(group, m, F.lit(k), F.substring(text, at + 1, size)))
        out.append(F.struct(key.alias("key"), at.alias("at"), size.alias("size")))
    return out


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most ``edits``, else a larger number.

    Bit-parallel over a band of 2 * edits + 1 rows: bit d of column j stands for row j - edits + d. ``vp`` and ``vn`` are
    the vertical steps up and down in the band; the score follows the band's lowest row, then the last row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    # The longer one is cut in rows; both are arrays of characters.
    swap = F.char_length(a) < F.char_length(b)
    x, y = F.split(F.when(swap, b).otherwise(a), ""), F.split(F.when(swap, a).otherwise(b), "")
    both = F.struct(x.alias("x"), y.alias("y"))
    # An expression that an array's one element stands for is evaluated once.
    return F.element_at(F.transform(F.array(both), lambda t: _band(t["x"], t["y"], edits, width, full)), 1)


def _band(x: Column, y: Column, edits: int, width: int, full: int) -> Column:
    n, m = F.size(x), F.size(y)

    def step(s: Column, j: Column) -> Column:  # j from 0
        c = F.get(y, j)
        same = F.lit(0)
        for d in range(width):
            same = same + F.when(F.coalesce((j - edits + d >= 0) & (F.get(x, j - edits + d) == c), F.lit(False)), F.lit(1 << d)).otherwise(F.lit(0))
        one = F.struct(same.alias("e"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["score"].alias("score"), j.alias("j"))
        one = _then(one, lambda r: F.struct(((((r["e"].bitwiseAND(r["vp"]) + r["vp"]).bitwiseXOR(r["vp"])).bitwiseOR(r["e"]).bitwiseOR(r["vn"])).bitwiseAND(F.lit(full))).alias("d0"), r["vp"].alias("vp"), r["vn"].alias("vn"), r["score"].alias("score"), r["j"].alias("j")))
        one = _then(one, lambda r: F.struct(r["d0"].alias("d0"), r["vn"].bitwiseOR(F.lit(full).bitwiseXOR(r["d0"].bitwiseOR(r["vp"]))).alias("hp"), r["d0"].bitwiseAND(r["vp"]).alias("hn"), r["score"].alias("score"), r["j"].alias("j")))

        def last(r: Column) -> Column:
            down = F.shiftright(r["d0"], 1)
            bit = F.lit(1 << (2 * edits))
            # In the last rows the band hangs over the end: the last row is bit n - 1 - (j - edits).
            row = F.greatest(n - 1 - r["j"] + edits, F.lit(0))
            score = F.when(r["j"] < n - edits, r["score"] + F.when(r["d0"].bitwiseAND(bit) == 0, 1).otherwise(0)).otherwise(r["score"] + _bit(r["hp"], row) - _bit(r["hn"], row))
            return F.struct(r["hn"].bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(r["hp"]))).alias("vp"), down.bitwiseAND(r["hp"]).alias("vn"), score.alias("score"))

        return _then(one, last)

    begin = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("score"))
    few = F.levenshtein(F.array_join(x, ""), F.array_join(y, ""))  # strings that are shorter than the band
    return F.when(n - m > edits, F.lit(edits + 1)).when(m <= edits, few).otherwise(F.aggregate(F.sequence(F.lit(0), m - 1), begin, step, lambda s: s["score"]))


def _then(value: Column, use) -> Column:  # noqa: ANN001
    return F.element_at(F.transform(F.array(value), use), 1)


def _bit(v: Column, row: Column) -> Column:
    return F.pmod(F.floor(v / F.pow(F.lit(2.0), row)).cast("int"), F.lit(2))


def occurrences(docs: DataFrame, edits: int) -> DataFrame:
    """(place, doc_id, pos, h1, h2, n, keys) of each line that counts; ``place`` orders lines by document and position."""
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.char_length("line") >= MIN_CHARS)
    keys = [c["key"].alias(f"k{i}") for i, c in enumerate(filed(F.col("line"), F.lit(0), edits))]
    return lines.select("doc_id", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), *keys)


def _place() -> Column:
    return (F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")).cast("decimal(38,0)")


def _few(df: DataFrame, most: int = FEW) -> DataFrame:
    """The table, to be sent to every task if it is as small as that."""
    return small(df, most)


def _counts(line: Column) -> list[Column]:
    """Counts of the counted characters (modulo 256), eight in a number."""
    size = F.octet_length(line)
    packed = []
    for k in range(0, len(COUNTED), 8):
        total = F.lit(0).cast("long")
        for j, c in enumerate(COUNTED[k : k + 8]):
            own = (size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(255))
            total = total.bitwiseOR(F.shiftleft(own, 8 * j))
        packed.append(total.alias(f"c{k // 8}"))
    return packed


def may_be_near(a: str, b: str, edits: int) -> Column:
    """Cheap tests first: an edit changes the length by one and two counts by one, at most; then the bounded distance."""
    apart = F.lit(0).cast("long")
    for k in range(len(COUNTED)):
        one = lambda t: F.shiftrightunsigned(F.col(f"{t}.c{k // 8}"), 8 * (k % 8)).bitwiseAND(F.lit(255))
        d = F.abs(one(a) - one(b))
        apart = apart + F.least(d, F.lit(256) - d)
    near = (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= edits) & (apart <= 2 * edits)
    return near & (F.levenshtein(F.col(f"{a}.line"), F.col(f"{b}.line"), edits) >= 0)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, first, line, n, counts) of the lines at the wanted (doc_id, pos) places."""
    ids = _few(stored(wanted.select(F.col("doc_id").alias("_id")).distinct(), "line-docs"))
    some = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    lines = some.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # A document that several rows hold has the wanted line in one of them: its hash tells which.
    found = lines.join(_few(wanted.select("doc_id", "pos", "h1", "first")), ["doc_id", "pos"]).where(F.col("h1") == F.xxhash64("line")).dropDuplicates(["first"])
    return found.select("h1", "first", "line", F.char_length("line").cast("int").alias("n"), *_counts(F.col("line")))


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(a, b): first places of the lines of (a, b) pairs of h1 values that are within that many edits."""
    both = pairs.alias("p").join(texts.alias("a"), F.col("p.a") == F.col("a.h1")).join(texts.alias("b"), F.col("p.b") == F.col("b.h1"))
    # A case evaluates its branch only where it holds, also within a join.
    near = both.where(F.when(may_be_near("a", "b", edits), edit_distance(F.col("a.line"), F.col("b.line"), edits) <= edits).otherwise(F.lit(False)))
    return near.select(F.col("a.first").alias("a"), F.col("b.first").alias("b"))


def _across(members: DataFrame, edits: int) -> DataFrame:
    """(a, b) pairs of h1 values of members (key, h1, component, line, n, counts) of a key that are in two components and may be near."""
    near = (F.col("a.h1") < F.col("b.h1")) & (F.col("a.component") != F.col("b.component")) & may_be_near("a", "b", edits)
    return members.alias("a").join(members.alias("b"), (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.h1").alias("a"), F.col("b.h1").alias("b"))


def _open(members: DataFrame) -> DataFrame:
    """(key, c) of the keys whose members are in more than one component."""
    by = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return by.where("lo <> hi").select("key", "c")


def near_lines(docs: DataFrame, distinct: DataFrame, edits: int) -> DataFrame:
    """(node, component): the first places of distinct lines that are near another one, and the least place of their class."""
    count = len(list(places(F.lit(0), edits)))
    rows = distinct.select(F.explode(F.array(*[F.col(f"k{i}") for i in range(count)])).alias("key"), "h1").where("key is not null")
    keys = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("h1").alias("a"), F.max("h1").alias("b")).where("c > 1 and a <> b"), "line-keys")
    twos = keys.where("c = 2").select("a", "b").distinct()
    more = stored(rows.join(_few(keys.where("c > 2").select("key", "c")), "key"), "line-members")
    ids = twos.select(F.explode(F.array("a", "b")).alias("h1")).union(more.select("h1")).distinct()
    wanted = distinct.select("h1", "doc_id", "pos", "first").join(_few(stored(ids, "line-ids")), "h1", "left_semi")
    texts = stored(_texts(docs, stored(wanted, "line-places")), "line-texts")
    # Each member with the hub of its key.
    weight = more.groupBy("h1").agg(F.sum("c").alias("w"))
    weighed = more.join(_few(stored(weight, "line-weights")), "h1")
    hub = stored(weighed.groupBy("key").agg(F.max(F.struct("w", "h1")).alias("top")).select("key", F.col("top.h1").alias("hub")), "line-hubs")
    star = more.join(_few(hub), "key").where("h1 <> hub").select(F.least("h1", "hub").alias("a"), F.greatest("h1", "hub").alias("b"))
    first = stored(_verified(twos.union(star).distinct(), texts, edits), "line-links")
    known = components(first)
    # What the hubs left, with what a comparison needs of each line.
    marked = texts.join(known, texts["first"] == known["node"], "left").select("h1", F.coalesce("component", "first").alias("component"), "line", "n", "c0", "c1")
    marked = stored(marked, "line-marked")
    members = stored(more.select("key", "h1").join(marked.select("h1", "component"), "h1"), "line-open")
    open_ = stored(_open(members), "line-open-keys")
    few = members.join(_few(open_.where(F.col("c") <= HOT).select("key")), "key", "left_semi").select("key", "h1")
    pairs = [_across(few.join(marked, "h1"), edits)]
    hot = members.join(_few(open_.where(F.col("c") > HOT).select("key")), "key", "left_semi").select("key", "h1")
    # Level 0 of hot keys: which place of the line the key is, then what is left without it.
    place = filed(F.col("line"), F.lit(0), edits)
    cut = hot.join(marked.select("h1", "component", "line"), "h1").select("key", "h1", "component", "line", F.explode(F.array(*place)).alias("f")).where("f.key = key")
    left = cut.select(F.col("key").alias("group"), "h1", "component", F.concat(F.substring("line", F.lit(1), F.col("f.at")), F.substring("line", F.col("f.at") + F.col("f.size") + 1, F.char_length("line"))).alias("rest"))
    while not left.isEmpty():
        left = stored(left, "line-rests")
        # Pairs of which one has no more characters left than may be edited: few, as all else of their lines is alike.
        short = left.where(F.char_length("rest") <= 2 * edits).select("group", F.col("h1").alias("a"), F.char_length("rest").alias("na"), F.col("component").alias("ca"))
        other = short.toDF("group", "b", "nb", "cb")
        pairs.append(short.join(other, "group").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") <= edits)).select("a", "b"))
        next_ = left.where(F.char_length("rest") > edits).select("h1", "component", "rest", F.explode(F.array(*filed(F.col("rest"), F.col("group"), edits))).alias("f")).where("f.key is not null")
        next_ = stored(next_.select(F.col("f.key").alias("key"), "h1", "component", "rest", F.col("f.at").alias("at"), F.col("f.size").alias("size")), "line-next")
        sizes = stored(_open(next_), "line-open-keys")
        some = next_.join(_few(sizes), "key")
        pairs.append(_across(some.where(F.col("c") <= HOT).select("key", "h1").join(marked, "h1"), edits))
        left = some.where(F.col("c") > HOT).select(F.col("key").alias("group"), "h1", "component", F.concat(F.substring("rest", F.lit(1), F.col("at")), F.substring("rest", F.col("at") + F.col("size") + 1, F.char_length("rest"))).alias("rest"))
    every = pairs[0]
    for p in pairs[1:]:
        every = every.union(p)
    rest = _verified(stored(every.distinct(), "line-pairs"), texts, edits)
    return components(first.union(stored(rest, "line-links")))


def line_classes(docs: DataFrame, max_edits: int = MAX_EDITS) -> tuple[DataFrame, DataFrame]:
    """Occurrences of lines that count, and (h1, h2, top, near) of each distinct line that is repeated or near another.

    ``top`` is the place of the first line of its class, ``near`` whether the class has other lines than this one.
    """
    occ = stored(occurrences(docs, max_edits), "lines")
    count = len(list(places(F.lit(0), max_edits)))
    keys = [F.first(f"k{i}").alias(f"k{i}") for i in range(count)]
    distinct = occ.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("copies"), *keys)
    whole = F.lit(1 << 32).cast("decimal(10,0)")
    distinct = distinct.withColumn("pos", F.pmod(F.col("first"), whole).cast("int")).withColumn("doc_id", ((F.col("first") - F.pmod(F.col("first"), whole)) / whole).cast("long"))
    distinct = stored(distinct, "distinct-lines")
    # The keys of the occurrences have done their work.
    wide, occ = occ, stored(occ.select("doc_id", "pos", "h1", "h2"), "line-occurrences")
    drop_stored(wide)
    top = stored(near_lines(docs, distinct, max_edits), "line-tops")
    marked = distinct.select("h1", "h2", "first", "copies").join(_few(top), F.col("first") == F.col("node"), "left").where("copies > 1 or component is not null")
    return occ, marked.select("h1", "h2", F.coalesce("component", "first").alias("top"), F.col("component").isNotNull().alias("near"))


def without_repeats(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """``docs`` with repeats cut from ``text``, and n_lines (that count), n_removed and n_near (of its lines) beside.

    ``n_near`` counts the document's lines that are near a line of other characters, removed or not.
    """
    occ, marked = line_classes(docs, max_edits)
    found = occ.select("doc_id", "pos", "h1", "h2").join(_few(stored(marked, "line-classes")), ["h1", "h2"], "left")
    goes = F.col("top").isNotNull() & (_place() != F.col("top"))
    near = F.sum(F.coalesce(F.col("near"), F.lit(False)).cast("long"))
    by_doc = found.groupBy("doc_id").agg(F.countDistinct("pos").alias("n_lines"), F.collect_set(F.when(goes, F.col("pos"))).alias("gone"), near.alias("n_near"))
    by_doc = stored(by_doc.toDF("__id", "__lines", "__gone", "__near"), "line-verdicts")
    size = by_doc.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("__gone")).alias("m")).first()
    few = size["n"] <= FEW * 2 and (size["m"] or 0) <= FEW_NUMBERS
    # Columns are named by their table, as documents may have columns of any name.
    out = docs.join(F.broadcast(by_doc) if few else by_doc, F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))) == by_doc["__id"], "left")
    gone = by_doc["__gone"]
    stay = F.filter(F.split(docs["text"], "\n"), lambda line, i: ~F.array_contains(gone, i))
    text = F.when(F.size(gone) > 0, F.array_join(stay, "\n")).otherwise(docs["text"])
    kept = [text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_removed", "n_near")]
    counts = [F.coalesce(by_doc["__lines"], F.lit(0)), F.when(gone.isNull(), 0).otherwise(F.size(gone)), F.coalesce(by_doc["__near"], F.lit(0))]
    return out.select(*kept, *[c.cast("long").alias(n) for c, n in zip(counts, ("n_lines", "n_removed", "n_near"), strict=True)])
