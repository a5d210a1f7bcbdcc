import duckdb

from wavelake.llm import quality as Q


def words(i, n=60):
    return [f"word{(i * 7 + k) % 97}" for k in range(n)]


def verdicts(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in Q.judge(df).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", data)
    assert got == {r[0]: r[-1] for r in c.execute(Q.OP6_SQL).fetchall()}
    return got


def test_small_groups_lean_on_all_rows_without_a_switch(spark):
    odd = lambda k: " ".join(f"w{j}" + "#" * 3 for j in range(k, k + 60))
    data = [(i, " ".join(words(i)), "en", "s") for i in range(400)]
    # alone, three such texts stay out; where hundreds of them are the rule of their source they stay
    data += [(1000 + i, odd(i), "en", "few") for i in range(3)]
    data += [(2000 + i, odd(i), "en", "many") for i in range(1200)]
    got = verdicts(spark, data[:403])
    assert not any(got[1000 + i] for i in range(3)) and all(got[i] for i in range(400))
    got = verdicts(spark, data)
    assert all(got[2000 + i] for i in range(1200))


def test_repeats_alone_reject(spark):
    data = [(i, " ".join(words(i)), "en", "s") for i in range(300)]
    again = words(5, 80)
    data.append((999, " ".join(again + again[:10]), "en", "s"))  # 20 of 90 words: within the base rule
    got = verdicts(spark, data)
    assert not got[999] and all(got[i] for i in range(300))
