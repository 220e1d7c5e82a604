"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Within a source the key space is cut
into ranges of about ``ROWS`` documents; sums by range give each range's
offset, a window within the range the rest, so a prefix sum over a source
never gathers it in one task.  The source's budget is cut exactly there:
whole epochs first, then the documents before the cut and part of the one
that it falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, full_text, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents of a range, about.
ROWS = 4096
#: The order of a source's documents.
ORDER = ("key", "doc_id", "size", "tie")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def random_key(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text; null as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, docs) with rank-dealt weight and target.

    Sources by code point, null last, get the weights in turn.  ``share``
    times all sizes is dealt by weight; a source stops at ``most`` times its
    size and what it leaves is dealt again.  In order of size by weight the
    sources that stop come first, which gives the level in one pass.  One
    row per source goes through one task here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.lit(share) * F.sum("source_size").over(everything)
    stopped = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (total - stopped) / weight_left
    return (
        dealt.withColumn("level", level)
        .withColumn("free", level * F.col("weight") < most * F.col("source_size"))
        # the level of the first source that does not stop holds for all after it
        .withColumn("shared", F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("level"))).otherwise(F.lit(None))).over(everything)["level"])
        .withColumn("target", F.coalesce(F.least(F.col("shared") * F.col("weight"), (most * F.col("source_size")).cast("double")), (most * F.col("source_size")).cast("double")))
        .drop("level", "free", "shared")
    )


def _ranked(docs: DataFrame, rows: int) -> DataFrame:
    """doc_id, size, tie, key, of, source_size, target, epochs, rest, before, nth and equal per document.

    Of a source's ``rest`` words beyond whole epochs, ``before`` stand before
    the document; ``nth`` counts from 0 among the ``equal`` rows that the
    order (key, doc_id, size, tie) does not tell apart.
    """
    text = full_text()
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = source_targets(totals).select(
        F.col("source").alias("of"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("docs") / rows)).cast("long").alias("ranges")
    )
    keyed = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("key", random_key(F.col("doc_id")))
    keyed = keyed.withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("ranges")).cast("long"))
    sums = keyed.groupBy("of", "range").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("of").alias("o_of"), F.col("range").alias("o_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("of", "range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    alike = Window.partitionBy("of", "range", *ORDER)
    ranked = keyed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ranked = ranked.withColumn("nth", F.row_number().over(alike.orderBy("local")) - 1).withColumn("equal", F.count(F.lit(1)).over(alike))
    joined = ranked.join(offsets, F.col("of").eqNullSafe(F.col("o_of")) & (F.col("range") == F.col("o_range")))
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    return joined.withColumn("epochs", epochs).withColumn("rest", rest).withColumn("before", F.col("offset") + F.col("local"))


def mix_documents(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, size, source_size, target, epochs, part, taken per document.

    ``epochs`` whole copies and the first ``part`` words of one more make
    ``taken`` words.  Columns read: doc_id, text and source.  A null text has
    size 0; a null source is a source of its own, as is the empty one; rows of
    one doc_id and size are ordered by a hash of their text, so that reruns
    cut the same; equal rows are all kept; an empty table gives no rows.  Very
    long texts count whole.
    """
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))).cast("long")
    return _ranked(docs, rows).withColumn("part", part).select(
        "doc_id", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    )


def source_cuts(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """of, epochs, cut, cut_nth, cut_equal and cut_part of each source that has words.

    What a source's rest covers are the rows before ``cut`` (a struct of
    ``ORDER``), the first ``cut_nth`` of the ``cut_equal`` rows there, and
    ``cut_part`` words of the next.
    """
    at = _ranked(docs, rows).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
    return at.select(
        "of", "epochs", F.struct(*ORDER).alias("cut"), F.col("nth").alias("cut_nth"), F.col("equal").alias("cut_equal"), (F.col("rest") - F.col("before")).alias("cut_part")
    )


def take_mix(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """The mix itself: the columns of ``docs``, rows repeated by epoch.

    A document that the cut falls in ends after its last word taken; where
    there is an ``n_chars`` column it follows.  Texts are not shuffled: prefix
    sums of sizes give each source's cut, and a row's place before or behind
    it tells what is taken.  Cases are those of ``mix_documents``.
    """
    own, text = docs.columns, full_text()
    cuts = materialize(source_cuts(docs, rows), "mix-cuts")
    named = docs.select(F.struct(*own).alias("row"), F.col("source").cast("string").alias("source"), F.struct(random_key(F.col("doc_id")).alias("key"), "doc_id", word_count(text).alias("size"), F.xxhash64(text).alias("tie")).alias("at"))
    placed = named.join(cuts, F.col("source").eqNullSafe(F.col("of")))
    whole = F.when(F.col("at") < F.col("cut"), F.col("at.size")).otherwise(F.lit(0))
    if cuts.where("cut_equal > 1").isEmpty():
        placed = placed.withColumn("part", F.when(F.col("at") == F.col("cut"), F.col("cut_part")).otherwise(whole))
    else:
        # only rows at a cut are numbered, in an order that reruns share
        here = placed.where("at = cut").withColumn("nth", F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64(F.to_json("row")))) - 1)
        cut_in = F.when(F.col("nth") < F.col("cut_nth"), F.col("at.size")).when(F.col("nth") == F.col("cut_nth"), F.col("cut_part")).otherwise(F.lit(0))
        placed = placed.where("at <> cut").withColumn("part", whole).unionByName(here.withColumn("part", cut_in).drop("nth"))
    copies = F.expr("concat(array_repeat(at.size, cast(epochs as int)), if(part > 0, array(part), array()))")
    taken = placed.select("row", F.col("at.size").alias("size"), F.explode(copies).alias("words"))
    # the first n words with the white space between them
    cut = F.when(F.col("words") >= F.col("size"), F.col("row.text")).otherwise(
        F.expr(r"array_join(slice(regexp_extract_all(row.text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, cast(words as int)), '')")
    )
    out = taken.select(*[cut.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in own])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in own else out


def mix_sql() -> str:
    """The rows of ``mix_documents`` by one unbounded window per source."""
    return """
    WITH sized AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    dealt AS (
      SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM totals),
    levels AS (
      SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER f, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
      FROM dealt
      WINDOW f AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    shared AS (
      SELECT arg_min(level, source_size / weight) AS l FROM levels WHERE level * weight < 2 * source_size),
    targets AS (
      SELECT source, source_size, coalesce(least(l * weight, CAST(2 * source_size AS DOUBLE)), CAST(2 * source_size AS DOUBLE)) AS target
      FROM levels, shared),
    ranked AS (
      SELECT s.doc_id, s.size, t.source_size, t.target,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    parts AS (
      SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - earlier)) AS part FROM ranked)
    SELECT doc_id, size, source_size, target, CAST(epochs AS BIGINT) AS epochs, CAST(part AS BIGINT) AS part,
           CAST(epochs * size + part AS BIGINT) AS taken FROM parts
    """
