"""Line dedup: lines that many documents share stay in one of them only.

Only DataFrame functions: lines are exploded with their position, their normalised keys hashed and
counted per document, and the texts reassembled from the slices between dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import stored

BLANKS = " \t\n\x0b\f\r"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, SMALL)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """`docs` with its shared lines removed from `text`, and `n_lines` and `n_dropped` as longs.

    A key of at least `min_chars` code points that at least `min_docs` documents hold loses all its
    lines except those in the smallest `doc_id` holding it.  Documents are told apart by `doc_id`: rows
    that repeat an id count once (and rows of one id with different texts are cut each by its own
    lines), rows without an id count together as one document after all others.  A null or empty text
    is one empty line and comes back as it is.  Columns named `n_lines` or `n_dropped` are replaced;
    all others are kept.  Keys are compared by 128 bits of hash.

    Every line is a row of two hashes, so a line that a third of all documents share is aggregated in
    the map tasks first, and the join with the repeated keys can be split by AQE.
    """
    given = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    base = docs.select(own.alias("__d"), F.xxhash64("text").alias("__t"), _lines(F.col("text")).alias("__l"))
    key = line_key(F.col("__line"))
    rows = (
        base.select("__d", "__t", F.posexplode("__l").alias("__p", "__line"))
        .select("__d", "__t", "__p", key.alias("__k"))
        .filter(F.char_length("__k") >= min_chars)
        .select("__d", "__t", "__p", F.xxhash64("__k").alias("__h"), F.xxhash64(F.lit(7), "__k").alias("__g"))
    )
    if min_docs == 2:
        found = rows.groupBy("__h", "__g").agg(F.min("__d").alias("__first"), F.max("__d").alias("__last"))
        found = found.filter("__first < __last").drop("__last")
    else:
        held = rows.select("__h", "__g", "__d").distinct().groupBy("__h", "__g")
        found = held.agg(F.min("__d").alias("__first"), F.count("*").alias("__n"))
        found = found.filter(F.col("__n") >= min_docs).drop("__n")
    # written first: a join in one stage with the aggregate could not be split at a hot line
    found = stored(found, "repeated-lines")
    dropped = (
        rows.join(found, ["__h", "__g"])
        .filter(F.col("__d") > F.col("__first"))
        .groupBy("__d", "__t")
        .agg(F.array_sort(F.collect_set("__p")).alias("__drop"))
    )
    ends = docs.select(*[F.col(f"`{c}`") for c in given], own.alias("__d"), F.xxhash64("text").alias("__t"))
    cut = ends.join(dropped, ["__d", "__t"], "left").withColumn("__l", _lines(F.col("text")))
    starts = F.concat(F.array(F.lit(-1)), F.col("__drop"))
    stops = F.concat(F.col("__drop"), F.array(F.size("__l")))
    kept = F.zip_with(starts, stops, lambda a, b: F.slice(F.col("__l"), a + 2, b - a - 1))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(kept), "\n"))
    return cut.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in given],
        F.size("__l").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> first, false) AS gone
  FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def line_dedup_query(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(docs)
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", sha.alias("kept_sha256"))
