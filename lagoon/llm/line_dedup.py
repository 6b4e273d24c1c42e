"""Site-relative line frequency: drops lines that too large a share of a host's pages contain.

Native: DataFrame functions only. A line's key is the line without spaces, tabs and carriage returns
at its ends; blank lines are never dropped. A page counts once for a line, however often it has it. A
line is boilerplate on a host if at least ``min_pages`` of the host's pages contain it and their share
of all the host's pages is above ``max_ratio``.

Shuffles carry two 64-bit hashes of a line instead of the line, after partial aggregation, so that a
host with a third of all pages, or a line on every page, is summed before it is sent. A host's
boilerplate lines number less than its mean distinct lines a page divided by ``max_ratio``, so they fit
an array; these arrays meet the pages by broadcast where they are few (counted first), else by a
join on the host that adaptive execution splits where a host is hot. Texts are not shuffled in the
first case and shuffled once in the second.

Defined cases: null texts stay null with 0 lines; a text all of whose lines go becomes empty; rows of
null host are one host; repeated rows count as pages of their own. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import cut, fresh, let

#: Well below the rate of real boilerplate (8.6 to 13.4 per cent of a host in the tables at hand) and above
#: that of passages which documents merely share (6.3 per cent at most).
MAX_RATIO = 0.07
MIN_PAGES = 5
BROADCAST_ROWS = 100_000  # of two longs each


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("x"), F.xxhash64(F.lit(1), key).alias("y"))


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n"))


def boilerplate(docs: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_h, _b): for each host with boilerplate, the hashes of its lines."""
    pages = docs.select(_host(host).alias("_h"), F.col(text).alias("_t"))
    totals = pages.groupBy("_h").agg(F.count("*").alias("total"))
    keys = F.array_distinct(F.transform(F.split("_t", "\n"), line_key))
    lines = pages.select("_h", F.explode(keys).alias("_k")).where("_k <> ''").select("_h", _hash(F.col("_k")).alias("_l"))
    counts = lines.groupBy("_h", "_l").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return (
        counts.join(totals, "_h").where(F.col("pages") > max_ratio * F.col("total"))
        .groupBy("_h").agg(F.collect_list("_l").alias("_b"))
    )


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, NULL where there is none: a ``host`` for web pages."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _cleaned(text: Column, drop: Column) -> Column:
    """Struct (text, n): the text without the lines whose hashes are in ``drop``, and how many went.

    ``drop`` is a struct of the host's hashes ``b`` and their first halves ``x``. The halves that a page
    has in common with them come from one pass with a hash set, however many there are; only these few
    are then looked up line by line.
    """

    def of_lines(lines: Column) -> Column:
        halves = F.transform(lines, lambda line: F.xxhash64(line_key(line)))

        def of_bad(bad: Column) -> Column:
            kept = F.filter(lines, lambda line: ~F.array_contains(bad, _hash(line_key(line))))
            return let(kept, lambda k: F.struct(F.array_join(k, "\n").alias("text"), (F.size(lines) - F.size(k)).alias("n")))

        same = lambda hits: F.when(F.size(hits) == 0, F.struct(text.alias("text"), F.lit(0).alias("n"))).otherwise(
            let(F.filter(drop["b"], lambda d: F.array_contains(hits, d["x"])), of_bad)
        )
        return let(F.array_intersect(halves, drop["x"]), same)

    return let(F.split(text, "\n"), of_lines)


def dedup_lines(
    docs: DataFrame, host: str = "source", text: str = "text", *, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text``; with ``counts`` also n_lines, n_dropped."""
    bad = cut(boilerplate(docs, host, text, max_ratio, min_pages))
    few = (bad.agg(F.coalesce(F.sum(F.size("_b")), F.lit(0)).alias("n")).first().n) <= BROADCAST_ROWS
    key, lines_of, new = fresh(docs, "_bh"), fresh(docs, "_b"), fresh(docs, "_new")
    right = bad.select(F.col("_h").alias(key), F.struct(F.col("_b").alias("b"), F.transform("_b", lambda d: d["x"]).alias("x")).alias(lines_of))
    joined = docs.join(F.broadcast(right) if few else right, _host(host) == F.col(key), "left")
    drop = F.col(lines_of)
    # without boilerplate on its host a text is left as it is, unread
    as_is = F.struct(F.col(text).alias("text"), F.lit(0).alias("n"))
    out = joined.withColumn(new, F.when(drop.isNull() | F.col(text).isNull(), as_is).otherwise(_cleaned(F.col(text), drop)))
    cols = [F.col(f"{new}.text").alias(c) if c == text else F.col(c) for c in docs.columns]
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.length(F.col(text)) - F.length(F.translate(F.col(text), "\n", "")) + 1)
        cols += [n.cast("long").alias("n_lines"), F.col(f"{new}.n").cast("long").alias("n_dropped")]
    return out.select(*cols)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_lines, n_dropped and the text that is left."""
    return dedup_lines(docs.select("doc_id", F.col("source").alias("host"), "text"), "host", counts=True).select("doc_id", "host", "n_lines", "n_dropped", "text")


REPORT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce('h' || source, 'n') AS h, text FROM documents),
l AS (SELECT rid, h, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
tot AS (SELECT h, count(*) AS total FROM d GROUP BY h),
cnt AS (SELECT h, key, count(DISTINCT rid) AS pages FROM k WHERE key <> '' GROUP BY h, key),
bad AS (SELECT cnt.h, key FROM cnt JOIN tot ON cnt.h = tot.h WHERE pages >= {MIN_PAGES} AND pages > {MAX_RATIO} * total),
agg AS (SELECT k.rid, count(*) AS n_lines, count(bad.key) AS n_dropped,
  coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE bad.key IS NULL), '') AS text
  FROM k LEFT JOIN bad ON k.h = bad.h AND k.key = bad.key GROUP BY k.rid)
SELECT d.doc_id, d.host, coalesce(agg.n_lines, 0) AS n_lines, coalesce(agg.n_dropped, 0) AS n_dropped, agg.text
FROM d LEFT JOIN agg ON d.rid = agg.rid
"""
