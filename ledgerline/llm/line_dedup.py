"""Operator 10: repeated runs of lines, by a suffix array over line-id sequences.

A text is the sequence of its lines' ids (lines without a word break nothing and stay). Ids are places in the sorted list of the lines that occur
twice or more, told apart by 128 bits of hash; a line that occurs once is in no repeated run, so only stretches of repeated lines
with min_words or more go on. Their suffixes are ranked by prefix doubling across all texts: the rank of a suffix by 2k lines is the place of its
pair (rank by k lines, rank of the suffix k lines on) in the sorted list of all such pairs. A pair that occurs once ranks nothing and its suffix is
left out from there; a round sorts distinct pairs only, so a line that a third of all texts share is one entry of it.

The shortest run of min_words words from each line on has some length of r lines. Suffixes whose common prefix has r lines or more are one
interval of the suffix array; it is known by r and the ranks by the largest power of two of the two ends of the run. The same is done with all
texts reversed, for the shortest runs that end at each line: the union of both kinds is the union of all maximal repeated runs. Of each
interval the first suffix (by doc_id, null before all others, text hash, line) stays; the runs of the others are later copies and their lines are
deleted. No run needs more than min_words lines, so log2(min_words) rounds are enough; rounds end with the longest run in use.

Equal keys are counted with partial sums before the shuffle. Work and memory are linear in the lines of a text.

Results: a null text stays null; texts under min_words words are left as they are. Rows that repeat doc_id and text are one text: the same lines
go from each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, row_key, saved

MIN_WORDS = 50
BROADCAST_ROWS = 200_000
"""Line ids and ranks (24 bytes a row) go to all tasks up to so many rows; beyond, rows and ranks meet in a shuffle join."""
BROADCAST_BYTES = 16 << 20
"""Line numbers of later copies go to all tasks up to this size (several times as much in memory); beyond, they and the documents meet in a shuffle join."""


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACE))) > 0


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _reach(counts: Column, least: int) -> Column:
    """How many of the counts, from the first, it takes to reach `least`; null if all do not."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("len"))
    more = lambda t, x: F.when(t["sum"] >= least, t).otherwise(F.struct((t["sum"] + x).alias("sum"), (t["len"] + 1).alias("len")))
    return F.aggregate(counts, start, more, lambda t: F.when(t["sum"] >= least, t["len"]))


def line_rows(docs: DataFrame) -> DataFrame:
    """k (row key), i (number from 1 of the line among those with a word), two hashes of the line, n (its words)."""
    lines = F.filter(F.split("text", "\n"), _has_word)
    rows = docs.where("text is not null").select(row_key().alias("k"), lines.alias("l"))  # the key first: beside posexplode it would be made once a line
    return rows.select("k", F.posexplode("l").alias("i", "l")).select("k", (F.col("i") + 1).alias("i"), F.xxhash64("l").alias("h1"), F.xxhash64(F.lit(1), "l").alias("h2"), F.regexp_count("l", F.lit("[^\\x20\\x09-\\x0D]+")).alias("n"))


def ranked(keys: DataFrame, *columns: str, name: str) -> DataFrame:
    """The keys that occur twice or more, with numbers that ascend in their order."""
    twice = keys.groupBy(*columns).count().where("count > 1").select(*columns)
    return saved(twice.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(name, F.monotonically_increasing_id()))


def suffixes(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """k, at, rank, r: the lines of all long enough stretches of repeated lines, forth (at from 1) and back (at from -1 down).

    rank is the line's id, different for the two directions; r is how many lines make the shortest run from there on, null if there is none.
    """
    lines = saved(line_rows(docs))
    ids = ranked(lines, "h1", "h2", name="id")
    rows = lines.join(_small(ids), ["h1", "h2"]).groupBy("k", "i").agg(F.first("n").alias("n"), F.first("id").alias("id"))
    text = Window.partitionBy("k").orderBy("i")
    stretch = Window.partitionBy("k", "s")
    rows = rows.withColumn("s", F.col("i") - F.row_number().over(text)).withColumn("words", F.sum("n").over(stretch)).where(F.col("words") >= min_words)
    forth = F.collect_list("n").over(stretch.orderBy("i").rowsBetween(0, min_words - 1))
    back = F.collect_list("n").over(stretch.orderBy(F.desc("i")).rowsBetween(0, min_words - 1))
    rows = rows.withColumn("f", forth).withColumn("b", back)
    way = lambda sign, n, odd: F.struct((sign * F.col("i")).alias("at"), (2 * F.col("id") + odd).alias("rank"), _reach(n, min_words).alias("r"))
    return saved(rows.select("k", F.inline(F.array(way(1, F.col("f"), 0), way(-1, F.col("b"), 1)))))


def intervals(rows: DataFrame) -> DataFrame:
    """k, at, r, x, y for each suffix with a run: those with equal (r, x, y) share a prefix of r lines."""
    longest, half, out = rows.agg(F.max("r")).first()[0] or 0, 1, None
    while True:
        order = Window.partitionBy("k", F.col("at") > 0).orderBy("at")
        end = F.get(F.filter(F.collect_list(F.struct("at", "rank")).over(order.rangeBetween(0, half - 1)), lambda x: x["at"] == F.col("at") + F.col("r") - half), 0)["rank"]
        here = rows.withColumn("y", F.when((F.col("r") >= half) & (F.col("r") < 2 * half), end)).withColumn("next", F.max("rank").over(order.rangeBetween(half, half)))
        here = saved(here)
        found = here.where("y is not null").select("k", "at", "r", F.col("rank").alias("x"), "y")
        out = found if out is None else out.unionByName(found)
        half *= 2
        if half > longest:
            return out
        pairs = ranked(here.where("next is not null"), "rank", "next", name="new")
        rows = here.join(_small(pairs), ["rank", "next"]).select("k", "at", F.col("new").alias("rank"), "r")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """k, lines: for each text with later copies of runs, the numbers of their lines (from 1, lines with a word), in order."""
    found = intervals(suffixes(docs, min_words)).withColumn("place", F.struct("k", F.abs("at").alias("i")))
    firsts = found.groupBy("r", "x", "y").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("r", "x", "y", "first")
    later = found.join(_small(saved(firsts)), ["r", "x", "y"]).where("place <> first")
    ends = F.sequence(F.least(F.abs("at"), F.abs(F.col("at") + F.col("r") - 1)), F.greatest(F.abs("at"), F.abs(F.col("at") + F.col("r") - 1)))
    return later.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(ends)))).alias("lines"))


def _cut(lines: Column, gone: Column) -> Column:
    """The lines without those with a word that `gone` numbers. The one-element array computes its members once, not once a line."""
    number = F.filter(F.transform(lines, lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull())
    first = F.transform(F.array(F.struct(number.alias("n"), gone.alias("g"))), lambda s: F.transform(s["g"], lambda g: F.get(s["n"], g - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.get(first, 0))
    text = F.transform(F.array(F.struct(lines.alias("l"), left.alias("i"))), lambda s: F.array_join(F.transform(s["i"], lambda i: F.get(s["l"], i)), "\n"))
    return F.get(text, 0)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of docs, text without the lines of later copies, and n_lines (with a word), n_removed_lines, n_removed_words.

    Columns of docs that have one of these three names are replaced.
    """
    gone = saved(later_copies(docs, min_words)).withColumnRenamed("k", "__k").withColumnRenamed("lines", "__g")
    if (gone.agg(F.sum(4 * F.size("__g") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    rows = docs.withColumn("__k", row_key()).join(gone, "__k", "left").drop("__k")
    lines = F.split("text", "\n")
    rows = rows.withColumn("__t", F.when(F.col("__g").isNull(), F.col("text")).otherwise(_cut(lines, F.col("__g"))))
    words = lambda c: F.coalesce(F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    removed = F.when(F.col("__g").isNull(), F.lit(0).cast("long")).otherwise(words(F.col("text")) - words(F.col("__t")))
    keep = [F.col("__t").alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_removed_words")]
    n_lines = F.coalesce(F.size(F.filter(lines, _has_word)), F.lit(0)).cast("long")
    return rows.select(*keep, F.greatest(n_lines, F.lit(0)).alias("n_lines"), F.greatest(F.coalesce(F.size("__g"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed_lines"), removed.alias("n_removed_words"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents),
l AS (SELECT doc_id, text, list_filter(ls, lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS l FROM d),
p AS (SELECT doc_id, l, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l),
q AS (SELECT doc_id, line, i, len(regexp_extract_all(line, '[^ \t\n\v\f\r]+')) AS n FROM p),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM q),
forth AS (SELECT s.doc_id, s.i AS a, min(t.i) AS b FROM c s JOIN c t ON t.doc_id = s.doc_id AND t.i >= s.i AND t.i < s.i + 50 AND t.e - s.e + s.n >= 50 GROUP BY ALL),
back AS (SELECT t.doc_id, max(s.i) AS a, t.i AS b FROM c s JOIN c t ON t.doc_id = s.doc_id AND t.i >= s.i AND t.i < s.i + 50 AND t.e - s.e + s.n >= 50 GROUP BY t.doc_id, t.i),
w AS (SELECT * FROM forth UNION SELECT * FROM back),
k AS (SELECT w.doc_id, w.a, w.b, array_to_string(l.l[w.a:w.b], chr(10)) AS s FROM w JOIN l USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, a) AS r FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM f WHERE r > 1),
x AS (SELECT doc_id, count(*) AS nl, sum(n) AS nw FROM g JOIN q USING (doc_id, i) GROUP BY doc_id),
o AS (SELECT doc_id, string_agg(x.line, chr(10) ORDER BY x.pos) AS kept FROM (
    SELECT doc_id, line, pos, CASE WHEN regexp_matches(line, '[^ \t\n\v\f\r]') THEN count(CASE WHEN regexp_matches(line, '[^ \t\n\v\f\r]') THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) END AS i
    FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d)) x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NOT NULL THEN coalesce(o.kept, '') END AS text, coalesce(len(l.l), 0) AS n_lines, coalesce(x.nl, 0) AS n_removed_lines, coalesce(CAST(x.nw AS BIGINT), 0) AS n_removed_words
FROM l LEFT JOIN x USING (doc_id) LEFT JOIN o USING (doc_id)
"""
