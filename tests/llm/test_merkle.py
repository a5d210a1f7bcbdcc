"""Manifests against a plain tree of Python lists."""

import hashlib
import random
import zlib

import duckdb
import pytest

from wavelake.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def tree(nodes):
    """Root and, for each node, the steps (left, right) up to it."""
    steps, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(place):
            run = level[p // 3 * 3 : p // 3 * 3 + 3]
            steps[i].append((run[: p % 3], run[p % 3 + 1 :]))
            place[i] = p // 3
        level = [H(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], steps


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in sources:
        by[s] = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subs.append(tree([leaf(r, r[1]) for r in by[s]]))
    root, over = tree([x[0] for x in subs])
    out = []
    for s, (sub, steps), up in zip(sources, subs, over, strict=True):
        for r, own in zip(by[s], steps, strict=True):
            path = own + up
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            cur = leaf(r, text)
            for left, right in path:
                cur = H(*left, cur, *right)
            out.append((r[0], leaf(r, r[1]), sub, root, H(*[x for left, right in path for x in left + right]), cur, cur == root))
    return out


def rows():
    rng = random.Random(2)
    out = [(i, f"text\n{i}" if i % 3 else f"line {i}", "en", f"s{rng.randrange(3)}", i) for i in range(500)]
    out += [(i, "é\n" * (i % 4), None, None, None) for i in range(10)] + [(7, None, "de", "zü", 3), (None, None, None, None, None), (None, "x", "en", "s1", 1)]
    out += [(3, "same\n", "en", "s0", 5)] * 20 + [(900 + i, "one", "en", f"only {i}", 3) for i in range(12)] + [(5, "", "", "", 0)]
    rng.shuffle(out)
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_equals_a_plain_tree(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(M, "manifest", lambda leaves, f=M.manifest: f(leaves, levels))
    data = rows()
    spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS pos", "2 AS key", "3 AS n").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in M.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(data)))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("data", [[], [(1, "a\n", "en", "s", 2)], [(1, "a", "en", "s", 2), (2, "b", "en", "t", 2)], [(i, "a", "en", "s", 2) for i in range(9)]])
def test_small_tables(spark, tmp_path, data):
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in M.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(data) if data else []))


def test_sql_says_the_same(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({M.OP11_SQL})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, plain(data)))


def test_any_change_is_found(spark):
    """A leaf put in for another does not fold to the root."""
    df = spark.createDataFrame([(f"s{i % 2}", i, H(str(i))) for i in range(40)], "source string, doc_id long, leaf string")
    t = M.manifest(df, 2)
    wrong = t.select("doc_id", "root", M.refold(M.F.sha2("leaf", 256), M.F.col("steps")).alias("other"), M.refold(M.F.col("leaf"), M.F.col("steps")).alias("own")).collect()
    assert len(wrong) == 40 and all(r.own == r.root != r.other for r in wrong)
