"""Fill-in-middle from an index of distinct texts.

Rows of one text meet in one group (many rows in several groups) and are told apart by the texts
themselves. A group's line boundaries are listed once, as an Elias-Fano code, and each row
selects its two cuts from that list by numbers drawn from its own key.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, fresh, small_batches, with_arrow_columns

#: Bytes that a row counts beside its text when groups are weighed, and bytes of one partition.
ROW, PARTITION = 64, 64 << 20
#: Place of the k-th set bit of each byte, lowest first; 8 where there is none.
_PLACES = np.argsort(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") == 0, axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """A list of numbers in ascending order: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray):
        self.n, top = len(values), int(values[-1]) if len(values) else 0
        self.width = max(0, (top // max(1, self.n)).bit_length() - 1)
        low = (values[:, None] >> np.arange(self.width)) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        high = np.zeros((top >> self.width) + self.n + 1, np.uint8)
        high[(values >> self.width) + np.arange(self.n)] = 1
        self.high = np.packbits(high, bitorder="little")
        self.ranks = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)  # set bits up to the end of each byte

    def select(self, k: np.ndarray) -> np.ndarray:
        """The numbers at places k, from 0."""
        byte = np.searchsorted(self.ranks, k, side="right")
        before = self.ranks[byte] - np.bitwise_count(self.high[byte])
        high = byte * 8 + _PLACES[self.high[byte], k - before] - k
        bit = k[:, None] * self.width + np.arange(self.width)
        low = (self.low[bit >> 3] >> (bit & 7) & 1).astype(np.int64)
        return (high << self.width) + (low << np.arange(self.width)).sum(axis=1)


def boundaries(text: bytes) -> np.ndarray:
    """0 and where each line of a UTF-8 text ends, in code points; a line ends after its line feed or with the text."""
    given = np.frombuffer(text, np.uint8)
    points = np.cumsum((given & 0xC0) != 0x80)
    ends = points[given == 10]
    if len(given) and given[-1] != 10:
        ends = np.append(ends, points[-1])
    return np.concatenate([[0], ends]).astype(np.int64)


def _grouped(docs: DataFrame, text: str) -> DataFrame:
    """docs dealt so that rows of one text are neighbours, and texts of many rows or bytes lie in several partitions."""
    spark = docs.sparkSession
    mark, weight, hot, blocks, source = fresh(docs, "mark", "weight", "hot", "blocks", "source_part")
    whole = F.coalesce(c(text), F.lit(""))
    rows = docs.withColumn(mark, F.xxhash64(whole))
    weights = rows.withColumn(weight, F.octet_length(whole) + ROW).groupBy(mark).agg(F.sum(weight).alias(weight))
    total = weights.agg(F.sum(weight)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    share = total / (4 * parts)
    # at most 4 * parts marks can weigh more than that share of all, so their table may be broadcast
    heavy = weights.filter(F.col(weight) > share).select(F.col(mark).alias(hot), F.ceil(F.col(weight) / share).alias(blocks))
    # a block is drawn from the map partition, so a task that runs again deals its rows alike
    dealt = rows.withColumn(source, F.spark_partition_id()).join(F.broadcast(heavy), F.col(mark) == F.col(hot), "left")
    block = F.coalesce(F.pmod(F.xxhash64(source), blocks), F.lit(0))
    return dealt.repartition(parts, mark, block).sortWithinPartitions(mark).select(*map(c, docs.columns))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple = ("<P>", "<S>", "<M>")) -> DataFrame:
    """docs with n (lines), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and output.

    The cuts and the form depend on seed and key alone: numbers h1 to h4 of the digest of
    `seed:key`, a null key as nothing. The prefix ends after the smaller of h1 and h2 modulo n + 1
    lines, the middle after the larger; of 100 texts rate are cut, of those spm go suffix first. A
    null text counts as an empty one. Empty texts and those that hold a mark stay plain, so that
    restored finds each text again. Equal rows stay rows of their own and are cut alike. Columns
    of the new names are replaced, others stay.
    """
    if len(marks) != 3 or any(not m or m[0] in m[1:] for m in marks) or len({m[0] for m in marks}) > 1 or any(a != b and a.startswith(b) for a in marks for b in marks) or len(set(marks)) < 3:
        raise ValueError("three different marks, all of which begin with one character that they do not repeat, none the start of another")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c(key).cast("string"), F.lit(""))), 256)
    drawn, *h = fresh(docs, "digest", "h1", "h2", "h3", "h4")
    rows = _grouped(docs, text).withColumn(drawn, digest)
    rows = rows.withColumns({x: F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long") for i, x in enumerate(h)}).drop(drawn)
    held: dict = {"text": None}

    def lines(whole: bytes):
        """The index of a text, or None if it stays plain: worked out once for rows that follow each other."""
        if held["text"] != whole:
            plain = any(m.encode() in whole for m in marks)
            held.update(text=whole, cuts=EliasFano(boundaries(whole)), plain=plain or not whole, points=whole.decode("utf-8", "replace"))
        return held

    def run(given, *h):
        wholes = [t or b"" for t in given.cast(pa.binary()).to_pylist()]
        h = np.stack([x.to_numpy() for x in h])
        n, form, first, middle, output = [], [], [], [], []
        for at, whole in enumerate(wholes):
            same = lines(whole)
            count = same["cuts"].n - 1
            n.append(count)
            if same["plain"] or h[2, at] % 100 >= rate:
                form.append("plain"), first.append(None), middle.append(None), output.append(same["points"])
                continue
            a, b = same["cuts"].select(np.sort(h[:2, at] % (count + 1))).tolist()
            p, m, s = same["points"][:a], same["points"][a:b], same["points"][b:]
            form.append("spm" if h[3, at] % 100 < spm else "psm"), first.append(a), middle.append(b - a)
            output.append("".join((marks[1], s, marks[0], p, marks[2], m) if form[-1] == "spm" else (marks[0], p, marks[1], s, marks[2], m)))
        return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]

    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    return with_arrow_columns(rows, fields, run, [text, *h], 1 << 22).drop(*h)


def restored(output: Column, form: Column, marks: tuple = ("<P>", "<S>", "<M>")) -> Column:
    """The text of an output: its parts in their old order."""
    part = F.split(output, "|".join(map(re.escape, marks)))
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op11_infill(spark, sf_dir: str) -> DataFrame:
    """The form and cuts of every whole text, and digests of what is written and of what is got back."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = fill_in_middle(docs).drop("text")
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The same in SQL: cuts by counting line ends, without an index.
OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), l AS (
  SELECT *, string_split(t, chr(10)) AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), e AS (
  SELECT *, CASE WHEN t = '' THEN 0 WHEN u[-1] = '' THEN len(u) - 1 ELSE len(u) END AS n FROM l
), k AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, list_transform(u, lambda x: length(x)) AS w,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM e
), c AS (
  SELECT *, CASE WHEN plain THEN NULL ELSE least(coalesce(list_sum(w[1:a]), 0) + a, length(t)) END AS pc, CASE WHEN plain THEN NULL ELSE least(coalesce(list_sum(w[1:b]), 0) + b, length(t)) END AS pm FROM k
), o AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, substring(t, 1, CAST(pc AS BIGINT)) AS p, substring(t, CAST(pc + 1 AS BIGINT), CAST(pm - pc AS BIGINT)) AS m, substring(t, CAST(pm + 1 AS BIGINT)) AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(pc AS BIGINT) AS prefix_chars, CAST(pm - pc AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
