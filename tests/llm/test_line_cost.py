import numpy as np
import pyarrow as pa

from wavelake.llm import lines as L


def test_lines_are_counted_in_bytes(spark):
    """Taking line breaks out letter by letter (``translate``) cost more than the join with the lines that go."""
    texts = [None, "", "\n", "é\n\r\nwörter 漢字\n", "one two\nthree"]
    out = L.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), slots=1 << 16, least_words=1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan and "translate" not in plan
    assert {r.doc_id: (r.text, r["__wl_lines"]) for r in out.collect()} == {i: (t, 0 if t is None else t.count("\n") + 1) for i, t in enumerate(texts)}


def test_texts_are_taken_without_decoding():
    texts = [None, "", "é 漢", "a\nb"]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.record_batch([pa.array(["x", *texts], kind)], names=["text"]).slice(1)
        assert L._texts(batch) == [(t or "").encode() for t in texts]


def test_packed_rows_carry_their_heads():
    rng = np.random.default_rng(3)
    rows = np.zeros(300, L._LINE)
    rows["h1"], rows["line"], rows["heads"] = rng.integers(0, 1 << 62, 300), np.arange(300), rng.integers(0, 4, 300)
    heads = np.zeros(int(rows["heads"].sum()), L._HEAD)
    heads["word"] = np.arange(len(heads))
    at = np.cumsum(rows["heads"]) - rows["heads"]
    pick, part = rng.permutation(300)[:200], rng.integers(0, 7, 200)
    got = L._packed(1, part, rows.take(pick), heads, at[pick])
    assert [g[:2] for g in got] == [(1, k) for k in sorted(set(part.tolist()))]
    for _, k, r, m in got:
        want = pick[part == k]
        assert bytes(r) == rows[want].tobytes()
        assert bytes(m) == b"".join(heads[at[i] : at[i] + rows["heads"][i]].tobytes() for i in want)
    assert L._packed(0, part[:0], rows[:0]) == []
    plain = L._packed(2, part, rows.take(pick))
    assert [bytes(p[2]) for p in plain] == [bytes(g[2]) for g in got] and not any(p[3] for p in plain)
