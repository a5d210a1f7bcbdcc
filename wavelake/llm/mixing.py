"""Mixing sources to target weights by a temperature, realised as budgeted block permutations.

The weight of a source is its share of all tokens to the power ``alpha``, normalised.  ``alpha`` is the largest in [0, 1] whose
weights reach the target entropy (a part of the logarithm of the number of sources), unless the repetition limit asks for a larger
one; both are found by bisection.  Where no exponent keeps the limit (the budget is more than ``repeats`` times all tokens), it is 1
and every source repeats alike.  Weights times the token budget give whole-token budgets of the sources (largest remainders).

Weights depend on token counts alone, so the driver sees the distinct counts of sources and how many sources have each: T tokens
have less than the square root of 2T of them, however many sources there are.

Each source is cut into blocks by a hash.  For every pass over a source its blocks, and the rows of a block, are put into an order
of their own; a draw is taken if it starts before the source's budget ends.  So whole passes come first, the last may be part of
one, and a source overshoots by less than its longest text.  ``position`` is the start over the source's budget: ordered by it,
every prefix of the mix has the target weights, about.

Only the blocks of a source (MOST_BLOCKS at most) and sources of equal counts are ordered in one task; the rows of a source of any
size are spread over its blocks.

Edge cases: null sources are a source; a source without tokens gets no budget; null texts have no tokens; rows without tokens are
drawn with the pass they stand in; repeated rows are drawn as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

TARGET_ENTROPY = 0.95
MOST_REPEATS = 4.0
SEED = 11
BLOCK_TOKENS = 1 << 16
MOST_BLOCKS = 4096


def n_words(text_col: str):
    """Words of a text, from the borders between white space and the rest."""
    t = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(t, " "), lambda w: w != "")).cast("long")


def weights_at(tokens: np.ndarray, alpha: float, times: np.ndarray | int = 1) -> np.ndarray:
    """Weight of one source of each token count; ``times`` sources have it."""
    share = tokens / (tokens * times).sum()
    w = np.where(share > 0, share ** alpha, 0.0)
    return w / (w * times).sum()


def choose_alpha(tokens: np.ndarray, budget: float, entropy: float = TARGET_ENTROPY, repeats: float = MOST_REPEATS, times: np.ndarray | int = 1) -> float:
    times = np.broadcast_to(times, tokens.shape)[tokens > 0]
    tokens = tokens[tokens > 0].astype(float)
    if times.sum() < 2:
        return 1.0

    def even(alpha):  # falls as alpha grows
        w = weights_at(tokens, alpha, times)
        return -(times * w * np.log(w)).sum() >= entropy * np.log(times.sum()) - 1e-12

    def fits(alpha):  # holds from some alpha on, if at all
        return (weights_at(tokens, alpha, times) * budget / tokens).max() <= repeats + 1e-12

    def bisect(holds_low: bool, test) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if test(mid) == holds_low else (low, mid)
        return low if holds_low else high

    alpha = 1.0 if even(1.0) else bisect(True, even)
    return alpha if fits(alpha) else bisect(False, fits)


def budgets(tokens: np.ndarray, alpha: float, budget: int) -> np.ndarray:
    whole, more = shared_budgets(tokens, alpha, budget, 1)
    return whole + more


def shared_budgets(tokens: np.ndarray, alpha: float, budget: int, times: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Whole tokens of a source of each count, and how many of the ``times`` sources that have it get one more."""
    times = np.broadcast_to(times, tokens.shape)
    exact = weights_at(tokens.astype(float), alpha, times) * budget
    whole = np.floor(exact).astype(np.int64)
    rest = exact - whole
    short = int(budget - (whole * times).sum())
    order = np.lexsort((np.arange(len(rest)), -rest))
    before = np.cumsum(times[order]) - times[order]
    more = np.zeros(len(rest), np.int64)
    more[order] = np.clip(short - before, 0, times[order])
    return whole, more


#: Sources up to which their table (about 60 bytes each) is sent to every task instead of being joined by a salted shuffle.
SENT_SOURCES = 200_000
SALTS = 64
#: Buckets in which sources of one token count are numbered.
NUMBERED = 1024


def plan(per_source: DataFrame, budget: int | None, entropy: float, repeats: float) -> tuple[DataFrame, int]:
    """(src, tokens, budget, blocks) of the sources that have a budget, and how many sources there are."""
    spark = per_source.sparkSession
    per_source = C.stage(per_source, "mix-sources")
    # fewer rows than the square root of twice the tokens
    seen = sorted(map(tuple, per_source.groupBy("tokens").agg(F.count(F.lit(1)).alias("times")).collect()))
    tokens, times = (np.array(c, np.int64) for c in (zip(*seen, strict=True) if seen else ((), ())))
    total = int((tokens * times).sum())
    kind = "tokens long, whole long, more long, blocks long"
    if total:
        budget = total if budget is None else budget
        whole, more = shared_budgets(tokens, choose_alpha(tokens, budget, entropy, repeats, times), budget, times)
        blocks = np.clip(-(-tokens // BLOCK_TOKENS), 1, MOST_BLOCKS)
        rows = [tuple(map(int, r)) for r in zip(tokens, whole, more, blocks, strict=True)]
    else:
        rows = []
    # which of the sources of one count get a token more: numbered in hash buckets, as millions may share a count
    part = per_source.withColumn("__wl_b", F.pmod(F.xxhash64("src"), F.lit(NUMBERED)))
    by = ["tokens", "__wl_b"]
    before = part.groupBy(*by).agg(F.count(F.lit(1)).alias("__wl_c"))
    before = before.withColumn("__wl_0", F.sum("__wl_c").over(W.partitionBy("tokens").orderBy("__wl_b")) - F.col("__wl_c")).drop("__wl_c")
    nth = F.col("__wl_0") + F.row_number().over(W.partitionBy(*by).orderBy("src"))
    out = part.join(before, by).withColumn("__wl_i", nth).join(spark.createDataFrame(rows, kind), "tokens")
    out = out.withColumn("budget", F.col("whole") + (F.col("__wl_i") <= F.col("more")).cast("long"))
    return C.stage(out.where("budget > 0").select("src", "tokens", "budget", "blocks"), "mix-plan"), int(times.sum())


def _with_sources(rows: DataFrame, sources: DataFrame, n: int, spread: list[str]) -> DataFrame:
    """``rows`` with the plan of their source (null is one); rows of a large source never meet in one task."""
    known = lambda d: d.withColumn("__wl_s", F.coalesce("src", F.lit(""))).withColumn("__wl_0", F.col("src").isNull())
    keys, sources = ["__wl_s", "__wl_0"], known(sources).drop("src")
    if n <= SENT_SOURCES:
        return known(rows).join(F.broadcast(sources), keys).drop(*keys)  # size checked
    salted = known(rows).withColumn("__wl_x", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    every = sources.withColumn("__wl_x", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, [*keys, "__wl_x"]).drop(*keys, "__wl_x")


def mix(df: DataFrame, key_cols: list[str], source_col: str = "source", text_col: str = "text", budget: int | None = None, entropy: float = TARGET_ENTROPY, repeats: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """Draws: key_cols, source_col, n_tokens, epoch (int), block (int), start (long), position (double).

    ``budget`` is in tokens (words); by default that of all rows.  Equal rows are counted once and drawn as often as they occur.
    """
    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(key_cols)]
    rows = C.stage(df.select(*cols, F.col(source_col).cast("string").alias("src"), n_words(text_col).alias("t")), "mix-rows")
    sources, n = plan(rows.groupBy("src").agg(F.sum("t").alias("tokens")), budget, entropy, repeats)
    keys = [f"k{i}" for i in range(len(cols))]
    held = _with_sources(rows, sources, n, [*keys, "t"]).select(*keys, "src", "t", "tokens", "budget", "blocks")
    held = held.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *keys, "src", "t"), F.col("blocks")).cast("int"))
    passes = F.expr("CAST((budget + tokens - 1) DIV tokens AS INT)")
    sums = held.groupBy("src", "tokens", "budget", "block").agg(F.sum("t").alias("bt"))
    sums = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    order = lambda *c: [F.xxhash64(F.lit(seed), "epoch", *c), *c]
    run = W.partitionBy("src", "epoch").orderBy(*order("src", "block")).rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sums.withColumn("b0", F.sum("bt").over(run) - F.col("bt")).where("epoch * tokens + b0 < budget")
    starts = C.stage(starts.select(F.col("src").alias("s"), F.col("block").alias("b"), "epoch", "b0"), "mix-blocks")
    met = held.join(starts, held["src"].eqNullSafe(starts["s"]) & (held["block"] == starts["b"]))
    inner = W.partitionBy("src", "epoch", "block").orderBy(*order(*keys, "t")).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = met.withColumn("start", F.col("epoch") * F.col("tokens") + F.col("b0") + F.sum("t").over(inner) - F.col("t"))
    out = met.where("start < budget").withColumn("position", F.col("start") / F.col("budget"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, key_cols, strict=True)], F.col("src").alias(source_col), F.col("t").alias("n_tokens"), "epoch", "block", "start", "position")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` (all its columns) as often as the mix draws them.

    Rows are named by 128 bits of hashes of all their columns and of which of them are null.  Rows that are equal in all columns share a name; one of them then
    stands for all their draws.
    """
    tags = ["__wl_t1", "__wl_t2"]
    tagged = docs.withColumns(dict(zip(tags, C.row_names(docs), strict=True)))
    draws = mix(tagged.select(*tags, F.col("source").alias("source"), "text"), tags)
    times = draws.groupBy(*tags).agg(F.count(F.lit(1)).cast("int").alias("__wl_n"))
    seen = tagged.select(*tags).groupBy(*tags).agg(F.count(F.lit(1)).alias("__wl_c"))
    times = C.stage(times.join(seen, tags), "mix-times")
    joined = tagged.join(times, tags)
    out = joined.where("__wl_c = 1")
    if not times.where("__wl_c > 1").isEmpty():
        out = out.union(joined.where("__wl_c > 1").dropDuplicates(tags))
    return out.withColumn("__wl_i", F.explode(F.sequence(F.lit(1), F.col("__wl_n")))).select(*docs.columns)
