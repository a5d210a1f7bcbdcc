"""Quality rules whose cutoffs adapt to each language and source.

Counts of every text are taken in one projection of built-in functions.  Their ratios go into mergeable quantile sketches, one for
each (language, source, ratio): histograms with 16 buckets an octave, whose counts add up from any split of the rows (relative
error below 1/16, deterministic).  A fence of the third quartile plus FENCE quartile ranges (and a floor) is read off each sketch
and joined back.  The fences of a group of n rows and those of all rows are averaged with the weights n and PRIOR_DOCS, so small
groups lean on all rows and no size switches from one rule to another.  No Python runs on the executors.

Edge cases: a null text has no words and fails the base rules; null languages and sources are groups of their own; ties and
repeated rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

PRIOR_DOCS = 100
FENCE = 3
#: Ratio: (its scaled integer in SQL, width added to the quartile range so that a constant ratio keeps some room).
RATIOS = {
    "word_len": ("100 * word_chars DIV n_words", 50),
    "symbols": ("1000 * n_symbols DIV n_words", 20),
    "dup_lines": ("1000 * n_dup_lines DIV n_words", 20),
    "repeats": ("1000 * n_repeat_words DIV n_words", 50),
}
_SPACE = r"\t\n\u000B\u000C\r "


def _let(value: str, name: str, body: str) -> str:
    """SQL that binds a value once; a plain reference inside a lambda would be evaluated for every element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    gone = lambda x, letters: f"translate({x}, '{letters}', '')"
    pairs = lambda a, step: f"zip_with(slice({a}, 1, size({a}) - {step}), slice({a}, {step} + 1, size({a}) - {step}), (p, q) -> xxhash64(p, q))"
    repeated = _let(
        "array_sort(transform(g, (x, i) -> struct(x AS x, i AS i)))",
        "s",
        "array_sort(transform(filter(s, (e, k) -> (k > 0 AND s[greatest(k - 1, 0)].x = e.x) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = e.x)), e -> e.i))",
    )
    covered = _let(repeated, "at", "aggregate(transform(at, (p, k) -> IF(k = 0, 8, least(8, p - at[greatest(k - 1, 0)]))), 0L, (a, x) -> a + x)")
    windows = _let("transform(w, x -> xxhash64(x))", "h1", _let(pairs("h1", 1), "h2", _let(pairs("h2", 2), "h4", _let(pairs("h4", 4), "g", f"CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {covered} END"))))
    words = f"filter(split(translate(t, '{_SPACE}', '      '), ' '), x -> x <> '')"
    per_words = _let(words, "w", f"struct(size(w) AS n, CASE WHEN size(w) < 9 THEN 0L ELSE {windows} END AS r)")
    lines = _let(f"filter(split(t, '\\n'), x -> {gone('x', _SPACE)} <> '')", "l", "size(l) - size(array_distinct(l))")
    src = df.withColumn("t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    src = src.select(
        *[c for c in df.columns if c != text_col],
        F.expr(per_words).alias("__wl_w"),
        F.expr(f"char_length({gone('t', _SPACE)})").cast("long").alias("word_chars"),
        F.expr(f"char_length(t) - char_length({gone('t', '#*$%&|<>')})").cast("long").alias("n_symbols"),
        F.expr(lines).cast("long").alias("n_dup_lines"),
    )
    return src.withColumn("n_words", F.col("__wl_w.n").cast("long")).withColumn("n_repeat_words", F.col("__wl_w.r")).drop("__wl_w")


def bucket(v: str) -> str:
    """SQL for the sketch's bucket of a whole number >= 0."""
    e = f"greatest(length(bin({v})) - 5, 0)"
    return f"16 * {e} + shiftright({v}, {e})"


def bucket_top(b: str) -> str:
    """SQL for the largest number of a bucket."""
    e = f"greatest({b} DIV 16 - 1, 0L)"
    return f"shiftleft({b} - 16 * {e} + 1, CAST({e} AS INT)) - 1"


def sketches(feats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio, b, n): histograms; those of two sets of rows are merged by adding n."""
    ratios = F.expr("array(" + ", ".join(f"struct('{k}' AS ratio, {sql} AS v)" for k, (sql, _) in RATIOS.items()) + ")")
    rows = feats.where("n_words > 0").select(*keys, F.explode(ratios).alias("r")).select(*keys, "r.ratio", F.col("r.v").alias("v"))
    return rows.groupBy(*keys, "ratio", F.expr(bucket("v")).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, docs, one column for each ratio): the largest value that passes."""
    w = W.partitionBy(*keys, "ratio").orderBy("b")
    cum = sketch.withColumn("c", F.sum("n").over(w)).withColumn("docs", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    quart = lambda k: F.min(F.when(F.col("c") * 4 >= F.col("docs") * k, F.col("b")))
    q = cum.groupBy(*keys, "ratio").agg(F.max("docs").alias("docs"), quart(1).alias("b1"), quart(3).alias("b3"))
    q = q.withColumn("q1", F.expr(bucket_top("b1"))).withColumn("q3", F.expr(bucket_top("b3")))
    room = F.create_map(*[F.lit(x) for k, (_, r) in RATIOS.items() for x in (k, r)])
    q = q.withColumn("top", F.col("q3") + FENCE * (F.col("q3") - F.col("q1") + room[F.col("ratio")]))
    one = lambda k: F.max(F.when(F.col("ratio") == k, F.col("top"))).alias(f"top_{k}")
    return q.groupBy(*keys).agg(F.max("docs").alias("docs"), *[one(k) for k in RATIOS])


def judge(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``df`` without its text, with the counts, base_failed and kept."""
    keys = ["__wl_lang", "__wl_source"]
    feats = counts(df.withColumn(keys[0], F.col(lang_col)).withColumn(keys[1], F.col(source_col)), text_col)
    feats = C.stage(feats, "quality-counts")
    sketch = C.stage(sketches(feats, keys), "quality-sketch")
    own = fences(sketch, keys)
    whole = fences(sketch.groupBy("ratio", "b").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), ["one"])
    tops = [f"top_{k}" for k in RATIOS]
    # null-safe keys, so that null languages and sources find their group
    safe = lambda c: F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())
    own = own.select(safe(keys[0]).alias("__wl_k0"), safe(keys[1]).alias("__wl_k1"), F.col("docs").alias("__wl_docs"), *tops)
    every = whole.select(*[F.col(t).alias(f"all_{t}") for t in tops])
    out = feats.withColumn("__wl_k0", safe(keys[0])).withColumn("__wl_k1", safe(keys[1]))
    out = out.join(own, ["__wl_k0", "__wl_k1"], "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    out = out.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    fine = " AND ".join(f"{sql} <= (__wl_docs * top_{k} + {PRIOR_DOCS} * all_top_{k}) DIV (__wl_docs + {PRIOR_DOCS})" for k, (sql, _) in RATIOS.items())
    out = out.withColumn("kept", F.expr(f"CASE WHEN base_failed THEN false ELSE {fine} END"))
    return out.drop("__wl_k0", "__wl_k1", "__wl_docs", *keys, *tops, *[f"all_{t}" for t in tops])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    ratio = {k: sql.replace(" DIV ", " // ") for k, (sql, _) in RATIOS.items()}
    e = "greatest(length(bin(v)) - 5, 0)"
    top = lambda b: f"((({b} - 16 * greatest({b} // 16 - 1, 0) + 1) << CAST(greatest({b} // 16 - 1, 0) AS INT)) - 1)"
    union = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {sql} AS v FROM f WHERE n_words > 0" for k, sql in ratio.items())
    room = "CASE ratio " + " ".join(f"WHEN '{k}' THEN {r}" for k, (_, r) in RATIOS.items()) + " END"

    def fence(name: str, keys: str, src: str) -> str:
        by = f"{keys}, " if keys else ""
        cols = ", ".join(f"max(CASE WHEN ratio = '{k}' THEN top END) AS top_{k}" for k in RATIOS)
        return f"""{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {by}ratio ORDER BY b) AS c, sum(n) OVER (PARTITION BY {by}ratio) AS docs FROM {src}),
{name}_q AS (SELECT {by}ratio, max(docs) AS docs, min(CASE WHEN c * 4 >= docs THEN b END) AS b1, min(CASE WHEN c * 4 >= docs * 3 THEN b END) AS b3 FROM {name}_c GROUP BY {by}ratio),
{name}_t AS (SELECT {by}ratio, docs, {top("b3")} + {FENCE} * ({top("b3")} - {top("b1")} + {room}) AS top FROM {name}_q),
{name} AS (SELECT {by}max(docs) AS docs, {cols} FROM {name}_t {"GROUP BY " + keys if keys else ""})"""

    fine = " AND ".join(f"{sql} <= (o.docs * o.top_{k} + {PRIOR_DOCS} * a.top_{k}) // (o.docs + {PRIOR_DOCS})" for k, sql in ratio.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') <> '') AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win),
gap AS (SELECT r, least(8, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 8)) AS k FROM rep WHERE n > 1),
cov AS (SELECT r, CAST(sum(k) AS BIGINT) AS n_repeat_words FROM gap GROUP BY r),
f AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
v AS ({union}),
s AS (SELECT lang, source, ratio, 16 * {e} + (v >> {e}) AS b, count(*) AS n FROM v GROUP BY ALL),
g AS (SELECT ratio, b, sum(n) AS n FROM s GROUP BY ratio, b),
{fence("own", "lang, source", "s")},
{fence("whole", "", "g")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  CASE WHEN n_words < 20 OR 100 * n_repeat_words > 30 * n_words THEN false ELSE {fine} END AS kept
FROM f CROSS JOIN whole a LEFT JOIN own o
  ON f.lang IS NOT DISTINCT FROM o.lang AND f.source IS NOT DISTINCT FROM o.source
"""


OP6_SQL = _oracle()
