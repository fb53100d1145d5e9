"""Alignments against their definition, finds against planted and altered notices."""

import itertools
import random
import re
import time

import pytest

from winnow.llm import licenses as L
from winnow.llm.words import words

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("seed", range(30))
def test_increasing_is_longest(seed):
    rng = random.Random(seed)
    values = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
    found = [values[i] for i in L.increasing(values)]
    assert all(a < b for a, b in itertools.pairwise(found))
    best = max(
        (len(c) for r in range(len(values) + 1) for c in itertools.combinations(values, r)
         if all(a < b for a, b in itertools.pairwise(c))), default=0)
    assert len(found) == best


@pytest.mark.parametrize("seed", range(30))
def test_patience_pairs_equal_items_in_order(seed):
    rng = random.Random(seed)
    a = [rng.randint(0, 30) for _ in range(rng.randint(0, 40))]
    b = [x for x in a if rng.random() > 0.2]
    b.insert(rng.randint(0, len(b)), 99)
    pairs = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    assert L.patience(a, a) == [(i, i) for i in range(len(a))]


def test_unique_words_anchor():
    a, b = "the cat and the dog sat".split(), "x the the cat y and then the dog".split()
    assert [(a[i], j) for i, j in L.patience(a, b)] == [("the", 2), ("cat", 3), ("and", 5), ("the", 7), ("dog", 8)]


def rows(spark, docs, **options):
    found = L.notices(spark.createDataFrame(docs, SCHEMA), **options).collect()
    return sorted((r.doc_id, r.license, round(r.coverage, 6), r.start, r.end) for r in found)


def test_planted_notices(spark):
    mit, isc = L.TEMPLATES["MIT"], L.TEMPLATES["ISC"]
    short = L.TEMPLATES["MIT notice"]
    line = "the of and in to with this is a software été "
    docs = [
        (1, line * 40 + mit + "\n" + line * 40),
        (2, f"{isc}\n{isc}\n\n{isc}"),
        (3, short.upper()),
        (4, "é " * 9 + short[:-1]),
        (5, line * 200),
        (6, " ".join(w for i, w in enumerate(mit.split()) if i % 11)),
        (7, " ".join(w for i, w in enumerate(mit.split()) if i % 3)),
        (8, None), (9, ""), (10, "!!"),
        (11, L.TEMPLATES["Apache-2.0"]),
        (12, ("released " + line + "under ") * 30),
        (13, (short + " ") * 50),
    ]
    found = rows(spark, docs)
    names = {i: [r[1] for r in found if r[0] == i] for i, _ in docs}
    assert names[1] == ["MIT"] and names[2] == ["ISC"] * 3 and names[3] == ["MIT notice"]
    assert names[6] == ["MIT"] and names[11] == ["Apache-2.0"] and len(names[13]) == 50
    assert not any(names[i] for i in (5, 7, 8, 9, 10, 12))
    (one,) = [r for r in found if r[0] == 1]
    assert docs[0][1][one[3] : one[4]] == mit[:-1] and one[2] == 1
    (four,) = [r for r in found if r[0] == 4]
    assert docs[3][1][four[3] : four[4]] == short[:-1]
    for i, text in docs:
        assert sorted((r[1], r[2]) for r in found if r[0] == i) == sorted(
            (n, round(c, 6)) for n, c in L.plain_notices(text, L.TEMPLATES)
        )


def test_licenses_that_differ_in_a_word(spark):
    cases = {
        "Released under the BSD License": ["BSD notice"],
        "Released under the terms of the X License": [],
        "Released under the terms of the MIT License": ["MIT notice"],
        "Released under MIT License": ["MIT notice"],
        "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0 notice"],
        "Licensed under CC BY-NC-SA 4.0": ["CC-BY-NC-SA-4.0 notice"],
        "Licensed under CC BY 4.0": ["CC-BY-4.0 notice"],
        "Licensed under CC BY-NC 2.0": [],
        "Licensed under the Apache License 2.0": ["Apache-2.0 notice"],
        "Licensed under the Apache License, Version 1.1": [],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0 notice"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0 notice"],
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0 notice"],
        "This work is licensed under the GNU General Public License, version 1.": [],
        "This work is licensed under the GNU General Public License 3.": ["GPL-3.0 notice"],
        **{t: [n] for n, t in L.TEMPLATES.items()},
    }
    found = rows(spark, list(enumerate(cases)))
    assert {t: [r[1] for r in found if r[0] == i] for i, t in enumerate(cases)} == cases


def test_random_texts_against_unfiltered_search(spark):
    rng = random.Random(8)
    vocabulary = "a b c d e f g h".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    templates = {f"t{i}": text(n) for i, n in enumerate((1, 3, 8, 20))}
    docs = [(i, text(rng.choice([0, 2, 30])) + " " + rng.choice([*templates.values()])) for i in range(60)]
    found = rows(spark, docs, templates=templates, least=0.7)
    for i, t in docs:
        expected = sorted((n, round(c, 6)) for n, c in L.plain_notices(t, templates, 0.7))
        assert sorted((r[1], r[2]) for r in found if r[0] == i) == expected


def test_empty_and_refused(spark):
    assert rows(spark, []) == []
    with pytest.raises(ValueError):
        L.Templates({"x": "!!"})


def test_documents_of_the_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {}
    for r in rows(spark, docs):
        found.setdefault(r[0], []).append(r[1])
    for name in (n for n in L.TEMPLATES if n.endswith("notice")):
        assert {i for i, t in docs if L.TEMPLATES[name] in t} <= {i for i, x in found.items() if name in x}


def test_ten_thousand_notices_in_one_text():
    t = L.Templates(L.TEMPLATES)
    name, text = min(L.TEMPLATES.items(), key=lambda x: len(x[1]))
    w = words([(f"é {text} other words here " * 10_000).encode()])
    begin = time.time()
    found = t.notices(t.numbered(w.hash).tolist(), [t.names.index(name)])
    assert len(found) == 10_000 and time.time() - begin < 30


def test_positions_in_characters(spark):
    name, text = min(L.TEMPLATES.items(), key=lambda x: len(x[1]))
    body = f"ééé 日本 {text.strip()} é " * 3
    df = spark.createDataFrame([(1, body, 5, "x"), (2, None, 0, "")], "doc_id long, text string, start int, license string")
    rows = sorted(L.notices(df).collect(), key=lambda r: r.start)
    first = [m.start() for m in re.finditer(re.escape(text.strip()), body)]
    assert len(rows) == 3 and [r.start for r in rows] == first and {r.doc_id for r in rows} == {1}
