"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, by DataFrame functions alone.

A paragraph is a line. Its leaves are cut by what stands there, so an edit moves no far border:
after punctuation and a space; what is longer than twice LEAF characters then also after words that end in
one of a few letters, and what still is after every LEAF. A section is a run of paragraphs that ends with one whose digest begins with 0 to
3. A node's digest covers its children's, so equal roots mean equal texts, and below equal nodes nothing
needs to be compared: edits are located from the root downwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, stored

#: Characters after which a leaf is cut at the latest, and the letters after which a word ends one.
LEAF, ENDS = 128, "bcfgkmpvwz"
_CUT, _WORDS = "(?<=[.,;:!?] )", f"(?<=[{ENDS}] )"
#: A character beyond 16 bits counts as two where the pattern looks back, hence the range; the cut comes after LEAF characters either way.
_LONG = rf"(?s)(?<=\G.{{{LEAF},{2 * LEAF}}})"


def _digest(x: Column) -> Column:
    """128 bits of SHA-256 as hex digits."""
    return F.substring(F.sha2(x, 256), 1, 32)


def _numbered(xs: Column) -> Column:
    """A set of numbers for an array of numbers: the values, and for each value's second and later occurrences a number that depends on it and on how many there are before."""
    # a lambda over one element holds a step's value, which would else be worked out again for each use
    once = lambda x, f: F.transform(F.array(x), f)[0]
    again = lambda o: F.transform(F.filter(F.sequence(F.lit(1), F.size(o) - 1), lambda i: F.get(o, i) == F.get(o, i - 1)), lambda i: F.get(o, i))
    starts = lambda e: F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: ~F.coalesce(F.get(e, i) == F.get(e, i - 1), F.lit(False)))
    count = lambda x, s, j: F.coalesce(F.get(x["s"], j + 1), F.size(x["e"])) - s
    told = lambda x: F.flatten(F.transform(x["s"], lambda s, j: F.transform(F.sequence(F.lit(1), count(x, s, j)), lambda k: F.xxhash64(F.get(x["e"], s), k))))
    more = lambda o: F.when(F.size(o) < 2, F.array().cast("array<bigint>")).otherwise(once(again(o), lambda e: F.when(F.size(e) == 0, F.array().cast("array<bigint>")).otherwise(once(F.struct(e.alias("e"), starts(e).alias("s")), told))))
    return once(F.sort_array(xs), lambda o: F.concat(F.array_distinct(o), more(o)))


def tree(text: Column) -> Column:
    """struct(root, sections, starts, paragraphs, leaves) of a whole text; a null counts as empty.

    sections and paragraphs are digests in order, leaves those of each paragraph, starts the
    number of the first paragraph of each section.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.transform(_leaves(p), _digest))
    inner = lambda x: F.struct(x.alias("leaves"), F.transform(x, lambda p: _digest(F.array_join(p, ""))).alias("paragraphs"))
    return F.transform(F.transform(F.transform(F.array(lines), inner), _bounded), _node)[0]


def _leaves(p: Column) -> Column:
    cut = lambda x, how, then: F.when(F.length(x) > 2 * LEAF, F.flatten(F.transform(F.split(x, how), then))).otherwise(F.array(x))
    by_length = lambda x: F.when(F.length(x) > 2 * LEAF, F.split(x, _LONG)).otherwise(F.array(x))
    parts = F.split(p, _CUT)
    return F.when(F.length(p) > 2 * LEAF, F.flatten(F.transform(parts, lambda x: cut(x, _WORDS, by_length)))).otherwise(parts)


def _bounded(x: Column) -> Column:
    """struct(leaves, paragraphs) with ends, the numbers of the last paragraphs of the sections."""
    last = lambda i: F.get(x["paragraphs"], i).rlike("^[0-3]") | (i == F.size(x["paragraphs"]) - 1)
    return F.struct(x["leaves"].alias("leaves"), x["paragraphs"].alias("paragraphs"), F.filter(F.sequence(F.lit(0), F.size(x["paragraphs"]) - 1), last).alias("ends"))


def _node(x: Column) -> Column:
    """The upper levels over struct(leaves, paragraphs, ends)."""
    starts = F.transform(x["ends"], lambda e, j: F.coalesce(F.get(x["ends"], j - 1) + 1, F.lit(0)))
    sections = F.transform(F.arrays_zip(starts.alias("s"), x["ends"].alias("e")), lambda p: _digest(F.array_join(F.slice(x["paragraphs"], p["s"] + 1, p["e"] - p["s"] + 1), "")))
    held = F.transform(F.array(sections), lambda y: F.struct(F.sha2(F.array_join(y, ""), 256).alias("root"), y.alias("sections")))[0]
    return F.transform(F.array(held), lambda h: F.struct(h["root"].alias("root"), h["sections"].alias("sections"), starts.alias("starts"), x["paragraphs"].alias("paragraphs"), x["leaves"].alias("leaves")))[0]


def fingerprint(t: Column) -> Column:
    """A tree as text: root, sections, paragraphs and, shortened to 8 digits, leaves."""
    return F.concat_ws("/", t["root"], F.array_join(t["sections"], ","), F.array_join(t["paragraphs"], ","), F.array_join(F.transform(F.flatten(t["leaves"]), lambda x: F.substring(x, 1, 8)), ","))


def brief(t: Column) -> Column:
    """struct(root, nodes): the nodes below the root, repeats numbered, as 64 bits each: what likeness compares."""
    return F.struct(t["root"].alias("root"), _numbered(F.transform(F.concat(t["sections"], t["paragraphs"], F.flatten(t["leaves"])), lambda x: F.xxhash64(x))).alias("nodes"))


def likeness(a: Column, b: Column) -> Column:
    """Of two brief trees: 1 for equal roots, else twice the nodes that they share over all they have, both roots included.

    Repeated nodes count as often as they occur, and as a node covers the order below it, texts
    that differ only in repeats or order are less than 1.
    """
    both = F.size(F.array_intersect(a["nodes"], b["nodes"]))
    return F.when(a["root"] == b["root"], 1.0).otherwise(2.0 * both / (F.size(a["nodes"]) + F.size(b["nodes"]) + 2))


def _changed(a: Column, b: Column) -> Column:
    """struct(at, old, new): arrays a and b are equal but for old elements of a and new ones of b from number at on."""

    def same(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(first == 0, F.greatest(F.size(x), F.size(y))).otherwise(first - 1).cast("int")

    ends = F.struct(same(a, b).alias("head"), same(F.reverse(a), F.reverse(b)).alias("tail"))
    cut = lambda x: F.least(x["tail"], F.size(a) - x["head"], F.size(b) - x["head"])
    return F.transform(F.array(ends), lambda x: F.struct(x["head"].alias("at"), (F.size(a) - x["head"] - cut(x)).alias("old"), (F.size(b) - x["head"] - cut(x)).alias("new")))[0]


def edited(a: Column, b: Column) -> Column:
    """struct(at, old, new, leaf, old_leaves, new_leaves): where tree b differs from tree a; null for equal roots.

    Paragraphs at to at + old of a stand as at to at + new in b; in these, so many leaves differ
    from number leaf on. Only the sections between the first and the last that differ are
    entered, only the paragraphs between the first and the last of theirs that differ, and so on
    for leaves: what lies below equal branches is never compared. Deleted, added, moved and
    repeated paragraphs all lie in the range; several edits are one range.
    """
    within = lambda t, r, n: F.coalesce(F.get(t["starts"], r["at"] + r[n]), F.size(t["paragraphs"])) - F.get(t["starts"], r["at"])
    # the first section that differs starts alike in both, or behind the end of one of them
    start = lambda r: F.coalesce(F.get(a["starts"], r["at"]), F.get(b["starts"], r["at"]))
    part = lambda t, r, n: F.when(r[n] == 0, F.array().cast("array<string>")).otherwise(F.slice(t["paragraphs"], start(r) + 1, within(t, r, n)))
    sections = F.transform(F.array(_changed(a["sections"], b["sections"])), lambda r: F.struct(start(r).alias("start"), part(a, r, "old").alias("p"), part(b, r, "new").alias("q")))
    paragraphs = F.transform(F.transform(sections, lambda s: F.struct(s["start"].alias("start"), _changed(s["p"], s["q"]).alias("r"))), lambda s: F.struct((s["start"] + s["r"]["at"]).alias("at"), s["r"]["old"].alias("old"), s["r"]["new"].alias("new")))
    below = lambda t, s, n: F.flatten(F.slice(t["leaves"], s["at"] + 1, s[n]))
    leaves = F.transform(F.transform(paragraphs, lambda s: F.struct(s.alias("s"), below(a, s, "old").alias("p"), below(b, s, "new").alias("q"))), lambda x: F.struct(x["s"].alias("s"), _changed(x["p"], x["q"]).alias("r")))
    found = F.transform(leaves, lambda x: F.struct(x["s"]["at"].alias("at"), x["s"]["old"].alias("old"), x["s"]["new"].alias("new"), x["r"]["at"].alias("leaf"), x["r"]["old"].alias("old_leaves"), x["r"]["new"].alias("new_leaves")))[0]
    return F.when(a["root"] != b["root"], found)


def successors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(absent, id, mark, n, copies, before_absent, before_id, before_mark, before_n): each different row of docs and the one before it.

    Rows go by descending key, null last, then by the hash of the text; before the first comes the
    last. absent is whether the key is null, id the key or 0.
    """
    rows = docs.select(c(key).isNull().alias("absent"), F.coalesce(c(key).cast("long"), F.lit(0)).alias("id"), F.coalesce(c(text), F.lit("")).alias("text"))
    nodes = rows.select("absent", "id", F.xxhash64("text").alias("mark"), F.length("text").cast("long").alias("n")).groupBy("absent", "id", "mark", "n").agg(F.count("*").alias("copies"))
    order = [F.col("absent"), F.col("id").desc(), F.col("mark")]
    nodes = stored(nodes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    here = F.struct("absent", "id", "mark", "n")
    own = Window.partitionBy("part").orderBy(*order)
    nodes = nodes.withColumn("before", F.lag(here).over(own))
    # the last row of each part stands before the first of the next part: as many rows as there are parts
    ends = nodes.groupBy("part").agg(F.max_by(here, F.struct(F.col("absent").cast("int"), -F.col("id"), F.col("mark"))).alias("end"))
    ends = ends.withColumn("earlier", F.coalesce(F.lag("end").over(Window.orderBy("part")), F.last("end").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    nodes = nodes.join(ends.select("part", "earlier"), "part").withColumn("before", F.coalesce("before", "earlier"))
    return nodes.select("absent", "id", "mark", "n", "copies", *(F.col(f"before.{x}").alias(f"before_{x}") for x in ("absent", "id", "mark", "n")))


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, own, changed, near_edited, near_next, edit) of each row of docs.

    The edited text ends with the beginning of the next document by descending key. own and changed
    are the trees, edit is where they differ. Null texts are empty, rows that are equal follow each other, null keys come last
    and then by text; a table of one row is its own next; other columns are left aside. Keys are
    whole numbers: others are an error, as a null would take their place. Texts are
    shuffled once in full and once up to the part that the document before needs.
    """
    if not isinstance(docs.select(c(key)).schema[0].dataType, T.IntegralType):
        raise ValueError(f"{key} is not a whole number")
    nodes = stored(successors(docs, key, text))
    named = ["absent", "id", "mark"]
    rows = docs.select(c(key).isNull().alias("absent"), F.coalesce(c(key).cast("long"), F.lit(0)).alias("id"), F.coalesce(c(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    if not nodes.filter("copies > 1").isEmpty():
        rows = rows.dropDuplicates(named)  # equal rows come back below
    rows = rows.join(nodes, named)
    nexts = rows.select(F.col("before_absent").alias("absent"), F.col("before_id").alias("id"), F.col("before_mark").alias("mark"), F.expr("left(text, cast(floor(before_n / 2) as int))").alias("head"), brief(tree(F.col("text"))).alias("next"))
    rows = rows.select(*named, "text", "n", "copies").join(nexts, named).withColumn("own", tree(F.col("text")))
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))) if not nodes.filter("copies > 1").isEmpty() else rows.withColumn("copy", F.col("copies"))
    same = F.col("copy") < F.col("copies")
    half = F.expr("cast(floor(n / 2) as int)")
    kept = F.expr("left(text, cast(n - floor(n / 2) as int))")
    out = rows.withColumn("changed_text", F.concat(kept, F.when(same, F.substring(F.col("text"), F.lit(1), half)).otherwise(F.col("head"))))
    out = out.withColumns({"changed": tree(F.col("changed_text")), "own_brief": brief(F.col("own"))})
    nearest = F.when(same, F.lit(1.0)).otherwise(likeness(F.col("own_brief"), F.col("next")))
    return out.select(F.when(~F.col("absent"), F.col("id")).alias(key), F.col("n").alias("n_chars"), F.sha2("changed_text", 256).alias("edited_sha256"), "own", "changed", likeness(F.col("own_brief"), brief(F.col("changed"))).alias("near_edited"), nearest.alias("near_next"), edited(F.col("own"), F.col("changed")).alias("edit"))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and the paragraphs that differ, found from the root downwards."""
    found = against_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next", F.col("edit.at").alias("edit_paragraph"), F.col("edit.old").alias("edit_deleted"), F.col("edit.new").alias("edit_added"), F.col("edit.leaf").alias("edit_leaf"))
