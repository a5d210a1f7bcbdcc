"""Ranking decides which license a stretch of words has."""

import pytest

from wavelake.llm import licenses as L


def names(text):
    return [x["license"] for x in L.name_text(text)]


@pytest.mark.parametrize("k", range(len(L.TEMPLATES)))
def test_each_template_names_its_own_license_alone(k):
    name, wording = L.TEMPLATES[k]
    assert names(f"some words before it\n{wording}\nand after it") == [name]
    assert names(wording.upper()) == [name]


def test_versions_of_one_wording_are_told_apart():
    gnu = lambda v: L._GNU.format("program", "General Public License", v)
    both = L.scan_text(gnu(2))
    assert {x["license"] for x in both} >= {"GPL-2.0", "GPL-3.0"} and names(gnu(2)) == ["GPL-2.0"] and names(gnu(3)) == ["GPL-3.0"]
    assert names(gnu(2) + "\nother words\n" + L._GNU.format("library", "Lesser General Public License", 3)) == ["GPL-2.0", "LGPL-3.0"]


def test_several_licenses_and_copies():
    mit, zlib = L._MIT, L._ZLIB
    assert names(f"{mit}\nx\n{zlib}\ny\n{mit}") == names(f"{zlib}\n{mit}") == sorted(["MIT", "Zlib"])
    changed = mit.replace("hereby granted", "hereby given")
    (got,) = L.name_text(changed)
    assert got["license"] == "MIT" and got["differing"] == ["-granted", "+given"] and got["saved"] > 0.3
    assert names("license " * 5000) == [] and names(None) == [] and names("SPDX-License-Identifier: MIT\n" * 300) == ["MIT"]


def test_other_sizes_give_other_names(monkeypatch):
    """With compressors that save nothing the order of templates decides, and stretches get other names."""
    texts = [wording for _, wording in L.TEMPLATES]
    want = [names(t) for t in texts]

    class Flat:
        def compress(self, data):
            return b"x" * 100

    monkeypatch.setattr(L, "_compressors", lambda: (Flat(), [Flat()] * len(L.TEMPLATES)))
    assert sum(names(t) != w for t, w in zip(texts, want, strict=True)) >= 5


def test_query_names_by_rank(spark, tmp_path):
    rows = [(1, L._GNU.format("program", "General Public License", 2)), (2, None), (None, "plain words"), (3, "Released under the MIT License.")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS licenses", "2 AS saved").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.licenses, r.n_licenses, r.n_differing) for r in L.op8_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: ("GPL-2.0", 1, 0), 2: ("", 0, 0), None: ("", 0, 0), 3: ("MIT", 1, 0)}
