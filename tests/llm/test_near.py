"""Classes against all pairs, signatures against the similarity that they estimate."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from winnow.llm import near as N
from winnow.llm.graph import components
from winnow.llm.words import plain_words

SCHEMA = "doc_id long, text string"


def plain_classes(docs, least=8, of=10):
    sets = []
    for _, text in docs:
        own = plain_words(text)
        n = max(1, len(own) - 4) if own else 0
        sets.append({tuple(own[i : i + 5]) for i in range(n)})
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and of * both >= least * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    return groups


def expected(docs):
    out = []
    for members in plain_classes(docs).values():
        ids = [docs[i][0] for i in members]
        name = min((i for i in ids if i is not None), default=None)
        out += [(i, name, len(members)) for i in ids]
    return sorted(out, key=repr)


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, SCHEMA)
    rows = N.report(df, **options).collect()
    assert sum(r.kept for r in rows) == len(plain_classes(docs))
    assert all(r.doc_id == r.class_id for r in rows if r.kept)
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in rows), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    docs = []
    for _ in range(12):  # sources, with copies that differ in a few words
        base = text(rng.choice([6, 30, 120, 400]))
        docs.append(base)
        for _ in range(rng.choice([0, 1, 4, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 40, len(base) // 20])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 10**6)}"
            docs.append(own)
    chain = text(200)  # each differs a little from the one before: linked in a row only
    for _ in range(12):
        chain = chain[6:] + text(6)
        docs.append(chain)
    docs = [(i, " ".join(x)) for i, x in enumerate(docs)]
    docs += [(500, docs[0][1].upper()), (501, docs[0][1].replace(" ", "... ")), (0, docs[0][1]), (None, docs[3][1])]
    docs += [(600, None), (601, ""), (602, "!?"), (603, "one two"), (604, "One, two"), (None, "alone here")]
    docs += [(700, "again and again the same line of words. " * 50), (701, "again and again the same line of words. " * 53)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_classes(spark, seed):
    docs = corpus(seed)
    assert run(spark, docs) == expected(docs)


def test_large_group_around_one_source(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    docs = [(0, " ".join(base))]
    for i in range(1, 250):  # 0.8 or more like the source, most less like each other
        own = list(base)
        for at in rng.sample(range(0, 96, 8), 2):
            own[at] = f"x{i}"
        docs.append((i, " ".join(own)))
    assert run(spark, docs) == expected(docs)


REST, TEXTS = "band long, rid long, class long", "rid long, shingles array<int>"


def test_an_outsider_does_not_pair_a_class_out(spark):
    base = list(range(100))
    sets = {i: [*base[:97], 1000 + i, 2000 + i, 3000 + i] for i in range(300)}
    sets[300] = [*base[:60], *range(5000, 5040)]  # in the bucket, but 0.4 like them
    sets[301] = [*base[:96], *range(6000, 6004)]  # 0.9 like them
    rest = spark.createDataFrame([(7, i, 1 if i < 300 else i) for i in sets], REST)
    pairs = {tuple(r) for r in N._across(rest, spark.createDataFrame(list(sets.items()), TEXTS)).collect()}
    assert {(i, 301) for i in range(300)} <= pairs
    assert len(pairs) <= 2 * len(sets)


@pytest.mark.parametrize("seed", [3, 4])
def test_no_similar_pair_of_two_classes_is_pruned(spark, seed):
    rng = random.Random(seed)
    bases = [rng.sample(range(300), n) for n in (1, 5, 12, 40, 80)]
    sets = {}
    for i in range(150):
        own = set(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(own) // 5))):
            own.discard(rng.choice(sorted(own))) if rng.random() < 0.5 and len(own) > 1 else own.add(rng.randint(0, 400))
        sets[i] = sorted(own)
    of = {i: rng.randint(0, 20) for i in sets}
    rest = {(b, i, of[i]) for i in sets for b in rng.sample(range(4), 2)}
    wanted = set()
    for (b, i, x), (c, j, y) in itertools.product(rest, rest):
        both = len(set(sets[i]) & set(sets[j]))
        if b == c and i < j and x != y and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            wanted.add((i, j))
    found = N._across(spark.createDataFrame(sorted(rest), REST), spark.createDataFrame(list(sets.items()), TEXTS))
    assert wanted and wanted <= {tuple(r) for r in found.collect()}


def test_pairs_with_repeated_lines(spark):
    docs = []
    for i in range(60):  # 126 shared shingles, 14 others on either side, of which 10 come fifty times
        base = " ".join(f"b{i}w{k}" for k in range(130))
        for side in "xy":
            docs.append((len(docs), base + " " + " ".join(f"{side}{i}w{k}" for k in range(10)) + (" " + " ".join(f"{side}{i}w{k}" for k in range(10))) * 49))
    assert len(plain_classes(docs)) == 60
    assert run(spark, docs) == expected(docs)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, None)]) == [(1, 1, 1), (2, 2, 1)]


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "a b c d e f", 3, "p"), (2, "a b c d e f", 4, None), (3, None, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid_ int, class string")
    kept = N.distinct_texts(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    weights = rng.uniform(0.5, 4, (2, 60))
    weights[0, :12] = 0
    weights[1, 40:] = 0
    elements = rng.integers(1, 2**63, 60).astype(np.uint64)
    text, which = np.nonzero(weights)
    found = N.signatures(text, elements[which], weights[text, which], 2, 4096)
    shared = [i for i in range(60) if weights[0, i] and weights[1, i]]
    exact = sum(1 / np.maximum(weights[0] / weights[0, i], weights[1] / weights[1, i]).sum() for i in shared)
    assert abs((found[0] == found[1]).mean() - exact) < 0.03
    share = Counter(found[0].tolist())[int(elements[50].astype(np.uint32))] / 4096
    assert abs(share - weights[0, 50] / weights[0].sum()) < 0.015


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)]
    edges += [(i, i + 1) for i in range(300, 360)] + [(1000, 1000 + i) for i in range(200)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {x for a, b in edges for x in (a, b) if a != b}
    assert {r.node: r.component for r in rows} == {x: find(x) for x in linked}
    assert len(rows) == len(linked)


def test_texts_meet_hashed_so_that_rows_of_a_text_stay_together(spark, monkeypatch):
    """Rows carry the lists of their text: sorted by band and shingle, they would be moved without shrinking."""
    plans = []
    settle = N.settle

    def noted(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return settle(df)

    monkeypatch.setattr(N, "settle", noted)
    sets = {i: [*range(100), 200 + i] for i in range(8)}
    rest = spark.createDataFrame([(band, i, i) for i in sets for band in range(6)], REST)
    found = N._across(rest, spark.createDataFrame(list(sets.items()), TEXTS)).collect()
    assert {tuple(r) for r in found} == set(itertools.combinations(range(8), 2))
    (met,) = (plan for columns, plan in plans if "most" in columns and "firsts" in columns)
    assert "ShuffledHashJoin" in met and "SortMergeJoin" not in met
