"""Merkle manifest of a table: leaves, subroots by source, a root, and the proof of every row.

Rows get their place among the leaves of their source by a range sort (ranges are dealt over tasks, so a source of any share is
many tasks).  Places are cut into blocks of ARITY**LEVELS leaves; within a block all levels are computed by windows over one
partitioning and one sort: at level k a node stands at its first leaf, the nodes of its run are ARITY**k places before or behind
(lag and lead columns, masked by the node's slot in its run and by the run's length), and the row of the first child hashes them into
the parent.  Block roots are the leaves of the next round, until one node for each source is left; the subroots, in the order of
their sources, are folded in the same way.  Siblings go back down by a join for each round, and each row folds its own leaf up again.

Hashes are lower-case hex SHA-256 of the concatenated inputs; a value is `-` if null, else its UTF-8 byte count, `:` and itself.

Edge cases: null ids come first in their source, the null source before all; rows of one id are ordered by their leaf, equal rows are
interchangeable and keep one place each; a source with one row has its leaf as subroot, one source alone has its subroot as root; an
empty table gives an empty result; other columns are kept out (the manifest has the id and hashes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

ARITY = 3
#: Levels of one round; a block has ARITY ** LEVELS leaves.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (long, from 0 in each ``key``) by ``order`` and ``n`` (rows of the key).

    Ranges of (key, order) are tasks; the only window is over one row for each key and task.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # spreads equal rows
    by = [key, *order, "tie"]
    ranged = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id())
    ranged = C.stage(ranged.withColumn("task", F.shiftright("at", 33)), f"{name}-ranged")
    runs = ranged.groupBy(key, "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    w = W.partitionBy(key)
    runs = runs.withColumn("n", F.sum("held").over(w)).withColumn("before", F.sum("held").over(w.orderBy("task")) - F.col("held"))
    return ranged.join(runs, [key, "task"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "task", "first", "held", "before")


def block_levels(nodes: DataFrame, key: str, levels: int) -> DataFrame:
    """``nodes`` (key, pos, n, node) with ``block``, ``steps`` (siblings left and right of the row's ancestor, level by level, as far as
    several nodes remain) and ``top`` (the block's root, at its first row)."""
    size = ARITY**levels
    w = W.partitionBy(key, "block").orderBy("pos")
    here = W.partitionBy(key, "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = nodes.withColumn("block", F.expr(f"pos div {size}")).repartition(F.col(key), F.col("block")).withColumn("d0", F.col("node"))
    steps = []
    for k in range(levels):
        gap, d = ARITY**k, F.col(f"d{k}")
        first, slot = F.col("pos") % gap == 0, F.expr(f"(pos div {gap}) % {ARITY}").cast("int")
        nodes_left = F.expr(f"(n + {gap - 1}) div {gap}")  # nodes of the key at this level
        run = F.least(F.lit(ARITY), nodes_left - (F.expr(f"pos div {gap}") - slot))
        t = t.withColumns({f"lag{j}": F.lag(d, gap * j).over(w) for j in range(1, ARITY)} | {f"lead{j}": F.lead(d, gap * j).over(w) for j in range(1, ARITY)})
        none = F.lit("")
        left = F.concat(*[F.when(slot >= j, F.col(f"lag{j}")).otherwise(none) for j in range(ARITY - 1, 0, -1)])
        right = F.concat(*[F.when(slot + j < run, F.col(f"lead{j}")).otherwise(none) for j in range(1, ARITY)])
        many = nodes_left > 1
        t = t.withColumn(f"s{k}", F.when(first & many, F.struct(left.alias("l"), right.alias("r"))))
        parent = F.when(first & (slot == 0), F.when(many, digest(d, right)).otherwise(d))
        t = t.withColumn(f"d{k + 1}", parent).drop(f"d{k}", *[f"{x}{j}" for x in ("lag", "lead") for j in range(1, ARITY)])
        t = t.withColumn(f"s{k}", F.when(many, F.last(f"s{k}", ignorenulls=True).over(here)))  # that of the row's ancestor
        steps.append(f"s{k}")
    got = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return t.withColumn("steps", got).withColumnRenamed(f"d{levels}", "top").drop(*steps)


def fold(nodes: DataFrame, key: str, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """Staged rounds of ``block_levels``, from the given nodes to one node for each key; each round's blocks are the next one's nodes."""
    rounds = []
    while True:
        now = C.stage(block_levels(nodes, key, levels), f"{name}-round")
        rounds.append(now)
        most = now.agg(F.max("n")).first()[0] or 0
        if most <= ARITY**levels:
            return rounds
        nodes = now.where("top IS NOT NULL").select(key, F.col("block").alias("pos"), F.expr(f"(n + {ARITY**levels - 1}) div {ARITY**levels}").alias("n"), F.col("top").alias("node"))


def paths(rounds: list[DataFrame], key: str, above: DataFrame | None = None) -> DataFrame:
    """The first round's rows with ``steps`` up to the last node and what ``above`` (one row for each key; ``steps``, ...) has for it."""
    kept = [c for c in above.columns if c not in (key, "steps")] if above is not None else []
    up = above
    for k in range(len(rounds) - 1, -1, -1):
        t = rounds[k]
        more = [c for c in t.columns if c not in (key, "pos", "steps", "block", "top", "n", "node")] if k == 0 else []
        if up is None:
            t = t.select(key, "pos", *more, "node", "steps")
        else:
            on = [key] if k == len(rounds) - 1 else [key, "block"]
            u = up.select(key, *([] if on == [key] else [F.col("pos").alias("block")]), F.col("steps").alias("more"), *kept)
            t = t.join(u, on).select(key, "pos", *more, "node", F.concat("steps", "more").alias("steps"), *kept)
        up = t
    return up


def refold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(steps, leaf, lambda d, s: digest(s["l"], d, s["r"]))


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, ...) for rows (source, doc_id, leaf, ...)."""
    # sources in order of their bytes, the null one first: as no other key is empty
    rows = leaves.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source")
    rows = numbered(C.stage(rows, "leaves"), "key", ["doc_id", "leaf"], "leaves").withColumn("node", F.col("leaf"))
    rounds = fold(rows, "key", "leaves", levels)
    last = rounds[-1].where("pos = 0").select(F.lit(0).alias("all"), F.col("key").alias("source_key"), F.col("top").alias("node"))
    tops = fold(numbered(C.stage(last, "subroots"), "all", ["source_key"], "subroots"), "all", "subroots", levels)
    root = tops[-1].where("pos = 0").select("all", F.col("top").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("steps"))
    above = paths(tops, "all", root).select(F.col("source_key").alias("key"), "steps", F.col("node").alias("subroot"), "root")
    return paths(rounds, "key", C.stage(above, "subroot-paths")).drop("key", "pos", "node")


def row_leaf(text: Column) -> Column:
    return digest(*[field(text if c == "text" else F.col(c)) for c in FIELDS])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    docs = docs.select("source", "doc_id", row_leaf(F.col("text")).alias("leaf"), F.when(hit, row_leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"))
    t = manifest(docs)
    flat = F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), "")
    t = t.select("doc_id", "leaf", "subroot", "root", F.sha2(flat, 256).alias("proof_sha256"), refold(F.coalesce("changed", "leaf"), F.col("steps")).alias("folded_root"))
    return t.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 14, over: int = 8) -> str:
    """The same with plain grouping, for sources of up to 3**levels rows and 3**over sources."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    less = leaf("replace(text, chr(10), '')")
    crc = (
        "WITH RECURSIVE bits AS (SELECT i AS b, i AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),\n"
        "steps AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),\n"
        "ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),\n"
        "walk AS (SELECT doc_id, s, 1 AS i, 4294967295 AS c FROM ids UNION ALL\n"
        f"  SELECT doc_id, s, i + 1, xor(c >> 8, v) FROM walk JOIN steps ON b = (xor(c, ascii(substr(s, i, 1))) & 255) WHERE i <= length(s)),\n"
        "hits AS MATERIALIZED (SELECT doc_id FROM walk WHERE i = length(s) + 1 AND xor(c, 4294967295) % 2 = 0),\n"
    )
    out = [
        crc + f"docs AS MATERIALIZED (SELECT coalesce('=' || source, '') AS key, doc_id, {leaf('text')} AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM hits) THEN {less} ELSE {leaf('text')} END AS cur FROM documents)",
        "d0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n, row_number() OVER () AS row_id FROM docs)",
        "t0 AS (SELECT key, pos, n, leaf AS node FROM d0)",
    ]

    def climb(at: str, count: int, group: str) -> None:
        for k in range(count):
            src, runs, nxt = f"{at}{k}", f"r{at}{k}", f"{at}{k + 1}"
            out.append(f"{runs} AS MATERIALIZED (SELECT {group}, pos // 3 AS pos, any_value(n) AS n, list(node ORDER BY pos) AS nodes FROM {src} GROUP BY {group}, pos // 3)")
            out.append(f"{nxt} AS (SELECT {group}, pos, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node FROM {runs})")

    climb("t", levels, "key")
    out.append(f"subs AS MATERIALIZED (SELECT key, node AS subroot, 0 AS g, row_number() OVER (ORDER BY key) - 1 AS spos, count(*) OVER () AS n FROM t{levels})")
    out.append("u0 AS (SELECT g, spos AS pos, n, subroot AS node FROM subs)")
    climb("u", over, "g")
    out.append("p0 AS (SELECT row_id, doc_id, key, leaf, cur, '' AS proof, pos FROM d0)")
    step = lambda src, runs, on: (
        f"SELECT p.* REPLACE (CASE WHEN r.n > 1 THEN sha256(array_to_string(r.nodes[1 : p.pos % 3], '') || p.cur || array_to_string(r.nodes[p.pos % 3 + 2 :], '')) ELSE p.cur END AS cur,"
        f" CASE WHEN r.n > 1 THEN p.proof || array_to_string(r.nodes[1 : p.pos % 3], '') || array_to_string(r.nodes[p.pos % 3 + 2 :], '') ELSE p.proof END AS proof, p.pos // 3 AS pos) FROM {src} p JOIN {runs} r ON {on} AND r.pos = p.pos // 3"
    )
    for k in range(levels):
        out.append(f"p{k + 1} AS MATERIALIZED ({step(f'p{k}', f'rt{k}', 'r.key = p.key')})")
    out.append(f"q0 AS (SELECT p.* REPLACE (s.spos AS pos), s.subroot, s.g FROM p{levels} p JOIN subs s USING (key))")
    for k in range(over):
        out.append(f"q{k + 1} AS MATERIALIZED ({step(f'q{k}', f'ru{k}', 'r.g = p.g')})")
    return ",\n".join(out) + (
        f"\nSELECT doc_id, leaf, subroot, (SELECT node FROM u{over}) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT node FROM u{over}) AS verified FROM q{over}"
    )


OP11_SQL = oracle()
