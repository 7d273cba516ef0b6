"""Merkle-tree fingerprints of documents, in DataFrame functions only.

A text is cut into paragraphs: its lines, and within a long line each run of WORDS words; cut end to
end they give the text back. A leaf is a hash of a paragraph, a section hash covers SECTION leaves in
order, and the root covers the sections. The fingerprint is ``root:sections:leaves``, all digests at
full width (32 hex digits). Equal roots mean equal texts. Where roots differ, differing sections and then
differing leaves in them locate the edits. The likeness of two trees is the share of their nodes (root,
sections, leaves) in common, a node as often as both have it: 1 for equal roots, and less for all others.
``compare_with_edits`` can also give the share of different leaves in common, from shorter digests.

Defined cases: null text is empty, with no leaves; two empty texts are alike (1); rows without doc_id
stand last in descending order; repeated doc_ids stand in descending order of text; one row is its own
next document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.llm.common import table, written

WORDS = 8
SECTION = 16
#: Hex digits of a section or leaf: all of an md5.
FULL = 32
#: Rows of neighbouring documents that a window holds, about.
WINDOW_ROWS = 2048
_INTERVALS = 64


def paragraph_pattern(words: int = WORDS) -> str:
    return rf"(?:[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D]+){{1,{words}}}\n?|[\x20\x09-\x0D]"


def leaves(text: Column, words: int = WORDS, digits: int = FULL) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(paragraph_pattern(words)), F.lit(0)), lambda p: F.substring(F.md5(p.cast("binary")), 1, digits))


def sections(leaf: Column, digits: int = FULL) -> Column:
    starts = F.when(F.size(leaf) > 0, F.sequence(F.lit(1), F.size(leaf), F.lit(SECTION))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(leaf, i, SECTION), "").cast("binary")), 1, digits))


def fingerprint(leaf: Column, section: Column) -> Column:
    joined = F.array_join(section, "")
    return F.concat_ws(":", F.md5(joined.cast("binary")), joined, F.array_join(leaf, ""))


def likeness(leaf_a: Column, leaf_b: Column) -> Column:
    """0 to 1, from the leaves of two fingerprints: the share in common, each different leaf once."""
    a, b = F.array_distinct(leaf_a), F.array_distinct(leaf_b)
    return F.when(leaf_a == leaf_b, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def _with_nodes(rows: DataFrame, trees: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each name the sections and leaves of a tree (names of columns), every digest with the number of its occurrence, so that they are all different.

    Digests are sorted, and runs of equal ones are numbered through, so the work is that of sorting.
    """
    steps = [
        ("s", lambda k, leaf, section: F.array_sort(F.concat(leaf, section))),
        ("p", lambda k, leaf, section: F.filter(F.zip_with(F.sequence(F.lit(0), F.size(f"_{k}s")), F.zip_with(f"_{k}s", F.concat(F.array(F.lit(None).cast("string")), f"_{k}s"), lambda x, before: ~x.eqNullSafe(before)), lambda i, new: F.when(new, i)), lambda i: i.isNotNull())),
        ("c", lambda k, leaf, section: F.zip_with(F.array_distinct(f"_{k}s"), F.zip_with(f"_{k}p", F.slice(f"_{k}p", 2, F.greatest(F.lit(0), F.size(f"_{k}p"))), lambda a, b: b - a), lambda x, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(":", x, i)))),
        ("", lambda k, leaf, section: F.flatten(F.filter(f"_{k}c", lambda c: c.isNotNull()))),
    ]
    for suffix, step in steps:
        rows = rows.withColumns({f"_{k}{suffix}" if suffix else k: step(k, F.col(leaf), F.col(section)) for k, (leaf, section) in trees.items()})
    return rows.drop(*[f"_{k}{suffix}" for k in trees for suffix, _ in steps if suffix])


def tree_likeness(nodes_a: Column, nodes_b: Column, same: Column) -> Column:
    """0 to 1, from two trees' numbered nodes and whether their roots are equal; 1 for equal roots only."""
    common = F.size(F.array_intersect(nodes_a, nodes_b)) + F.when(same, 1).otherwise(0)
    return F.lit(2.0) * common / (F.size(nodes_a) + F.size(nodes_b) + 2)


def _digests(part: Column, digits: int) -> Column:
    return F.regexp_extract_all(part, F.lit(f"[0-9a-f]{{{digits}}}"), F.lit(0))


def locate_edits(a: Column, b: Column, digits: int = FULL) -> Column:
    """Numbers (from 0) of the leaves of fingerprint ``b`` that differ from those of ``a`` at their place; only differing sections are opened."""
    sa, sb = _digests(F.split_part(a, F.lit(":"), F.lit(2)), digits), _digests(F.split_part(b, F.lit(":"), F.lit(2)), digits)
    la, lb = _digests(F.split_part(a, F.lit(":"), F.lit(3)), digits), _digests(F.split_part(b, F.lit(":"), F.lit(3)), digits)
    return located(sa, sb, la, lb)


def located(sections_a: Column, sections_b: Column, leaves_a: Column, leaves_b: Column) -> Column:
    """As ``locate_edits``, from the digests."""
    some = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    unlike = lambda x, y, i: ~F.get(x, i).eqNullSafe(F.get(y, i))
    opened = F.filter(some(F.size(sections_b)), lambda s: unlike(sections_a, sections_b, s))
    inside = F.flatten(F.transform(opened, lambda s: F.transform(F.sequence(F.lit(0), F.lit(SECTION - 1)), lambda i: s * SECTION + i)))
    return F.filter(inside, lambda i: (i < F.size(leaves_b)) & unlike(leaves_a, leaves_b, i))


def with_next_text(docs: DataFrame, out: str = "next_text") -> DataFrame:
    """Adds the text of the next document in descending order of doc_id; the first follows the last.

    Rows are bucketed by ranges of doc_id (interpolated between quantiles), so a window holds one
    bucket. What follows a bucket's last row is the first row of the next bucket, one text a bucket.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    steps = [i / _INTERVALS for i in range(_INTERVALS + 1)]
    count, bounds = rows.agg(F.count("*"), F.percentile_approx("doc_id", steps, 10_000)).first()
    bounds, parts = sorted(set(bounds or [])), max(1, math.ceil(count / _INTERVALS / WINDOW_ROWS))
    bucket = F.lit(0).cast("long")
    if len(bounds) > 1:
        low, width = F.array(*map(F.lit, bounds[:-1])), F.array(*[F.lit(b - a) for a, b in zip(bounds, bounds[1:], strict=False)])
        at = F.greatest(F.lit(1), F.size(F.filter(low, lambda b: b <= F.col("doc_id"))))
        inside = F.floor((F.col("doc_id") - F.element_at(low, at)) / F.element_at(width, at) * F.lit(parts))
        bucket = at.cast("long") * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket).cast("long"))
    tops = written(rows.groupBy("bucket").agg(F.max("doc_id").alias("top")), "merkle-tops")  # of known size, so Spark may send it to the texts
    heads = rows.join(tops.withColumnRenamed("bucket", "_tb"), (F.col("bucket") == F.col("_tb")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.max("text").alias("head"))
    down = W.orderBy(F.desc("bucket"))  # a row for each bucket
    after = tops.select(F.col("bucket").alias("_b"), F.coalesce(F.lead("bucket").over(down), F.first("bucket").over(down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_next"))
    after = after.join(heads.withColumnRenamed("bucket", "_hb"), F.col("_next") == F.col("_hb")).select("_b", "head")
    order = W.partitionBy("bucket").orderBy(F.desc("doc_id"), F.desc("text"))
    rows = rows.withColumn("_lead", F.lead("text").over(order))
    rows = rows.join(after, F.col("bucket") == F.col("_b"))
    return rows.select("doc_id", "text", F.coalesce("_lead", "head").alias(out))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256; leaves of the text (l), the edited text (e: second half replaced from the next document) and the next (n); sections of all (s, t, u)."""
    rows = with_next_text(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[leaves(F.col(c)).alias(a) for c, a in (("text", "l"), ("edited", "e"), ("next_text", "n"))])
    return rows.withColumns({"s": sections(F.col("l")), "t": sections(F.col("e")), "u": sections(F.col("n"))})


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the share of their leaves in common."""
    return with_edits(docs).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("l"), F.col("s")).alias("fingerprint"),
        fingerprint(F.col("e"), F.col("t")).alias("edited_fingerprint"),
        likeness(F.col("l"), F.col("e")).alias("near_edited"),
        likeness(F.col("l"), F.col("n")).alias("near_next"),
    )


def compare_trees(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, the likeness of the whole trees, and the numbers (from 0, comma-joined) of the leaves in which the edited text differs."""
    rows = _with_nodes(with_edits(docs), {"a": ("l", "s"), "b": ("e", "t"), "c": ("n", "u")})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("l"), F.col("s")).alias("fingerprint"),
        fingerprint(F.col("e"), F.col("t")).alias("edited_fingerprint"),
        tree_likeness(F.col("a"), F.col("b"), F.col("s") == F.col("t")).alias("near_edited"),
        tree_likeness(F.col("a"), F.col("c"), F.col("s") == F.col("u")).alias("near_next"),
        F.array_join(located(F.col("s"), F.col("t"), F.col("l"), F.col("e")), ",").alias("edits"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_trees(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), paired AS (
  SELECT *, length(text) AS n_chars,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text DESC),
      first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text
  FROM rows
), changed AS (
  SELECT *, concat(substring(text, 1, n_chars - n_chars // 2), substring(next_text, 1, n_chars // 2)) AS edited FROM paired
), leafed AS (
  SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
    list_transform(regexp_extract_all(text, '{paragraph_pattern()}'), lambda p: md5(p)) AS l,
    list_transform(regexp_extract_all(edited, '{paragraph_pattern()}'), lambda p: md5(p)) AS e,
    list_transform(regexp_extract_all(next_text, '{paragraph_pattern()}'), lambda p: md5(p)) AS n
  FROM changed
), sectioned AS (
  SELECT *,
    list_transform(range(0, len(l), {SECTION}), lambda i: md5(array_to_string(l[i + 1 : i + {SECTION}], ''))) AS s,
    list_transform(range(0, len(e), {SECTION}), lambda i: md5(array_to_string(e[i + 1 : i + {SECTION}], ''))) AS t,
    list_transform(range(0, len(n), {SECTION}), lambda i: md5(array_to_string(n[i + 1 : i + {SECTION}], ''))) AS u
  FROM leafed
), sorted AS (
  SELECT *, list_sort(list_concat(l, s)) AS ls, list_sort(list_concat(e, t)) AS es, list_sort(list_concat(n, u)) AS ns FROM sectioned
), numbered AS (
  SELECT *,
    list_transform(ls, lambda x, i: concat(x, ':', i - list_position(ls, x))) AS a,
    list_transform(es, lambda x, i: concat(x, ':', i - list_position(es, x))) AS b,
    list_transform(ns, lambda x, i: concat(x, ':', i - list_position(ns, x))) AS c
  FROM sorted
)
SELECT doc_id, n_chars, edited_sha256,
  concat_ws(':', md5(array_to_string(s, '')), array_to_string(s, ''), array_to_string(l, '')) AS fingerprint,
  concat_ws(':', md5(array_to_string(t, '')), array_to_string(t, ''), array_to_string(e, '')) AS edited_fingerprint,
  2.0::DOUBLE * (len(list_intersect(a, b)) + CASE WHEN s = t THEN 1 ELSE 0 END) / (len(a) + len(b) + 2) AS near_edited,
  2.0::DOUBLE * (len(list_intersect(a, c)) + CASE WHEN s = u THEN 1 ELSE 0 END) / (len(a) + len(c) + 2) AS near_next,
  array_to_string(list_filter(range(0, len(e)), lambda i: e[i + 1] IS DISTINCT FROM l[i + 1]), ',') AS edits
FROM numbered
"""
