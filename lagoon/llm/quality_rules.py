"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a native column expression over the whole text; there is no user function, no shuffle
and no second pass. ``RULES`` is the threshold table: a metric, its bounds, and the least number of
words from which it applies. ``compile_rules`` turns it into one boolean column.

Repeated 8-word windows are found by hashing each word once, hashing each window of eight hashes, and
comparing neighbours after a sort; a text whose window hashes are all distinct skips the sort.

Defined cases: null and empty texts have no words and fail. Other columns do not matter and are kept
by ``apply_rules``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import fresh, let

WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on as with be by at this are from or an have not "
    "de la le les et des en un une du que est pour dans qui sur au par il ne se pas plus "
    "der die und das den von zu mit sich auf ist im dem nicht ein eine als auch es an "
    "el los las del y con no una su al lo como por más pero sus le ya o este"
).split()

#: (metric, least, most, applies from so many words)
RULES: list[tuple[str, float | None, float | None, int]] = [
    ("n_words", 20, 10_000_000, 0),
    ("repeat_ratio", None, 0.3, 0),
    ("mean_word_chars", 2.0, 20.0, 20),
    ("symbol_ratio", None, 0.3, 20),
    ("stop_ratio", 0.005, None, 50),
    ("dup_line_ratio", None, 0.6, 20),
    ("bullet_ratio", None, 0.9, 20),
    ("ellipsis_ratio", None, 0.5, 20),
]


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more; ``windows`` is bound."""

    def flagged(pairs: Column) -> Column:
        here = lambda i: F.get(pairs, i)["h"]
        twice = F.filter(pairs, lambda p, i: F.coalesce(p["h"] == here(i - 1), F.lit(False)) | F.coalesce(p["h"] == here(i + 1), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
        # from each start to the next, at most a window's words
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x,
        ))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, flagged))


def _from_words(words: Column) -> Column:
    """Struct of the counts that need the words; ``words`` is bound."""
    n = F.size(words)

    def repeats(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), n - WINDOW)
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        return let(windows, _covered)

    rep = F.when(n <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), repeats))
    stops = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
    return F.struct(n.alias("n_words"), rep.alias("n_repeat_words"), stops.alias("n_stop"))


def _from_lines(lines: Column) -> Column:
    """Struct of the counts that need the lines; ``lines`` (with a word each) is bound."""
    n = F.size(lines)
    return F.struct(
        n.alias("n_lines"), (n - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))).alias("n_bullet"),
        F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipsis"),
    )


def with_metrics(docs: DataFrame, text: str = "text", name: str = "_m") -> DataFrame:
    """``docs`` with a struct column ``name`` of counts and ratios."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    counts = F.struct(
        let(words, _from_words).alias("w"), let(lines, _from_lines).alias("l"),
        F.length(F.translate(t, SPACES, "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
    )

    def derive(c: Column) -> Column:
        w, li = c["w"], c["l"]
        over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        long = lambda x, name: x.cast("long").alias(name)
        return F.struct(
            long(w["n_words"], "n_words"), long(c["word_chars"], "word_chars"), long(c["n_symbols"], "n_symbols"),
            long(li["n_dup_lines"], "n_dup_lines"), long(w["n_repeat_words"], "n_repeat_words"),
            over(w["n_repeat_words"], w["n_words"]).alias("repeat_ratio"), over(c["word_chars"], w["n_words"]).alias("mean_word_chars"),
            over(c["n_symbols"], w["n_words"]).alias("symbol_ratio"), over(w["n_stop"], w["n_words"]).alias("stop_ratio"),
            over(li["n_dup_lines"], li["n_lines"]).alias("dup_line_ratio"), over(li["n_bullet"], li["n_lines"]).alias("bullet_ratio"),
            over(li["n_ellipsis"], li["n_lines"]).alias("ellipsis_ratio"),
        )

    return docs.withColumn(name, let(counts, derive))


def compile_rules(rules=None, name: str = "_m") -> Column:
    """True where every rule holds for the metrics in the column ``name``."""
    checks = []
    for metric, least, most, since in RULES if rules is None else rules:
        value = F.col(f"{name}.{metric}")
        ok = F.lit(True)
        if least is not None:
            ok = ok & (value >= least)
        if most is not None:
            ok = ok & (value <= most)
        checks.append(ok if not since else (F.col(f"{name}.n_words") < since) | ok)
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def base_failed(name: str = "_m") -> Column:
    n = F.col(f"{name}.n_words")
    return (n < 20) | (100 * F.col(f"{name}.n_repeat_words") > 30 * n)


def report(docs: DataFrame) -> DataFrame:
    m = with_metrics(docs.select("doc_id", "text"))
    return m.select(
        "doc_id", *[F.col(f"_m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"), (~base_failed() & compile_rules()).alias("kept"),
        F.round("_m.stop_ratio", 6).alias("stop_ratio"), F.round("_m.symbol_ratio", 6).alias("symbol_ratio"),
    )


def apply_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, as they are."""
    name = fresh(docs, "_m")
    return with_metrics(docs, text, name).where(~base_failed(name) & compile_rules(name=name)).drop(name)


def _rules_sql() -> str:
    checks = []
    for metric, least, most, since in RULES:
        bounds = " AND ".join(f"{metric} {op} {v}" for op, v in ((">=", least), ("<=", most)) if v is not None)
        checks.append(f"({bounds})" if not since else f"(n_words < {since} OR ({bounds}))")
    return " AND ".join(checks)


_SPACE = "[\\x20\\x09-\\x0D]"
#: The same counts and verdicts in DuckDB's SQL, from the same tables of thresholds and stop words.
REPORT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
ws AS (SELECT rid, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
n AS (SELECT rid, len(ws) AS n_words, len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop FROM ws),
g AS (SELECT rid, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM ws WHERE len(ws) >= {WINDOW})),
tw AS (SELECT rid, i FROM g JOIN (SELECT rid, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (rid, g)),
rep AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS k FROM tw) GROUP BY 1),
ls AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
li AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE regexp_matches(line, '^ *[-*•]')) AS n_bullet,
  count(*) FILTER (WHERE regexp_matches(line, '(\\.\\.\\.|…) *$')) AS n_ellipsis FROM ls WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS (SELECT doc_id, n_words, n_stop, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullet, 0) AS n_bullet, coalesce(n_ellipsis, 0) AS n_ellipsis
  FROM d JOIN n USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN li USING (rid)),
r AS (SELECT *, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repeat_ratio, coalesce(word_chars / nullif(n_words, 0), 0.0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbol_ratio,
  coalesce(n_stop / nullif(n_words, 0), 0.0) AS stop_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS dup_line_ratio, coalesce(n_bullet / nullif(n_lines, 0), 0.0) AS bullet_ratio,
  coalesce(n_ellipsis / nullif(n_lines, 0), 0.0) AS ellipsis_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {_rules_sql()} AS kept, round(stop_ratio, 6) AS stop_ratio, round(symbol_ratio, 6) AS symbol_ratio FROM r
"""
