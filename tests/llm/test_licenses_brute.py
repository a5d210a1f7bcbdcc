"""Scans against a plain alignment of every template with every whole text."""

import random

import pytest

from wavelake.llm import licenses as L


def fits(want, have):
    """Least number of words missing, added or (twice) replaced when ``want`` is laid into any stretch of ``have``."""
    row = [0] * (len(have) + 1)
    for i, w in enumerate(want, 1):
        new = [i]
        for j, h in enumerate(have, 1):
            new.append(min(row[j - 1] + 2 * (w != h), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def times(words, have):
    return sum(have[i : i + len(words)] == words for i in range(len(have) - len(words) + 1))


def brute(text):
    have = L._WORDS((text or "").lower())
    sure = []
    for name, wording in L.TEMPLATES:
        want = L._WORDS(wording.lower())
        most = int(L.DIFFERING * len(want))
        if fits(want, have) <= most:
            sure.append((name, want, most))
    held = lambda a, b: a[0] != b[0] and len(a[1]) < len(b[1]) and times(a[1], b[1]) > 0 and (a[2] > 0 or times(a[1], have) <= times(a[1], b[1]) * times(b[1], have))
    return sorted({a[0] for a in sure if not any(held(a, b) for b in sure)})


def texts():
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice("the of river licence stone walks software under version and 2 4.0 copy".split()) for _ in range(n))
    out = [None, "", "  \n", "copyright only", "licensed"]
    for k, (_, wording) in enumerate(L.TEMPLATES):
        out.append(f"{prose(30)}\n{wording}\n{prose(30)}")
        out.append(f"{prose(5)} {wording.upper() if k % 2 else wording.replace(' ', chr(10) + '# ')} {prose(5)}")
        words = wording.split()
        if len(words) > 40:
            at = rng.randrange(len(words))
            out.append(" ".join([*words[:at], "strange", *words[at:]]))
            out.append(" ".join(w for i, w in enumerate(words) if i % 4))  # too much is gone
        else:
            out.append(" ".join(words[:-1]))
    return out


@pytest.mark.parametrize("part", range(4))
def test_every_template_is_found_as_a_plain_alignment_finds_it(part):
    for t in texts()[part::4]:
        assert [x["license"] for x in L.scan_text(t)] == brute(t), t


def test_null_ids_repeated_rows_and_long_texts(spark):
    long = "no such words here " * 50_000
    rows = [(None, "Released under the MIT License."), (None, "Released under the MIT License."), (1, long + L._ZLIB + long), (1, None), (2, "")]
    got = sorted((str(r.doc_id), [x.license for x in r.licenses]) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", []), ("1", ["Zlib"]), ("2", []), ("None", ["MIT"]), ("None", ["MIT"])]


def test_blocks_end_with_their_lines():
    text = "x" * 50 + "\n" + "y" * 650 + " license " + "z" * 750 + "\nrest"
    (a, b), = L.blocks(text)
    assert text[a:b] == text[51 : text.index("\nrest")] or a <= 51 and text[b : b + 5] == "\nrest"
