"""Both matching strategies and the highlights against the plain evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from tests import checker
from winnow import fixture as X
from winnow.functions import patterns as P
from winnow.operators import highlight as H
from winnow.operators import matching as M
from winnow.operators import terms as T
from winnow.params import SECTIONS, Params
from winnow.plans.engine import TriageEngine

TERMS = [
    ("A", "pos", "oil", "1", "any", "0"),
    ("A", "pos", "C++", "2", "any", "0"),
    ("A", "pos", ".NET", "2", "any", "0"),
    ("A", "pos", "oil and gas", "1", "any", "0"),
    ("A", "pos", "oil / gas & net", "3", "abstract", "0"),
    ("A", "pos", "optim*", "2", "any", "0"),
    ("A", "pos", "*tion", "4", "title", "0"),
    ("A", "pos", "*il*", "5", "any", "0"),
    ("A", "pos", "g*s", "5", "any", "0"),
    ("B", "pos", "Élan vital", "1", "any", "0"),
    ("B", "pos", "oil optim*", "1", "any", "0"),
    ("B", "pos", "a_b", "2", "any", "0"),
    ("B", "pos", "**", "2", "manual_tags", "0"),
    ("B", "pos", "e?", "2", "any", "0"),
    ("B", "pos", "+*+", "3", "any", "0"),
    ("B", "pos", "g(as|el)", "2", "any", "1"),
    ("B", "pos", r"^oil\b.*net", "2", "any", "1"),
    ("B", "anti", "net gas", "", "any", "0"),
    ("B", "flag", "12", "", "any", "0"),
    ("GLOBAL", "anti", "élan", "", "manual_tags", "0"),
    ("GLOBAL", "flag", "oil.", "", "title", "0"),
]
PIECES = [
    "oil", "gas", "OIL", "Gas", "and", "or", "c++", "C", "+", ".net", "net", "optimal", "Optimisation",
    "nation", "élan", "ÉLAN", "vital", "a_b", "12", "e?", "e", "-", "/", ".", ",", "--", "...", " ", "  ", "\n",
    "\t", " ", "ß", "文", "gel", "soil", "gs", "++", "&", "'", "$1", "\\",
]


def corpus(n, seed=1):
    rnd = random.Random(seed)

    def text(k):
        return "".join(rnd.choice(PIECES) + rnd.choice(["", " ", " ", "-"]) for _ in range(rnd.randint(0, k)))

    return [(f"r{i}", f"d{i % 7}", text(5), text(14), text(3)) for i in range(n)]


@pytest.fixture(scope="module")
def articles(spark):
    rows = corpus(600)
    return spark.createDataFrame(rows, "row_key string, id string, title string, abstract string, manual_tags string")


@pytest.fixture(scope="module")
def engine(spark):
    raw = X.raw_terms(spark, TERMS)
    return TriageEngine.build(raw, Params(block_order=("A", "B")), row_key="row_key")


def as_sets(hits):
    found = {}
    for r in hits.collect():
        item = (r.block, r.kind, r.term, r.level, r.section, r.match_type, tuple(r.components))
        found.setdefault(r.row_key, set()).add(item)
    return found


def expected_hits():
    terms = checker.compiled([t for t in TERMS if t[0] != "GLOBAL" or t[1] != "pos"])
    terms = [(("T0" if t[0] == "GLOBAL" else t[0]), *t[1:]) for t in terms]
    result = {}
    for key, _, title, abstract, tags in corpus(600):
        found = checker.hits({"title": title, "abstract": abstract, "manual_tags": tags}, terms)
        if found:
            result[key] = found
    return result


def test_narrow_equals_plain_evaluation(engine, articles):
    assert as_sets(engine.hits(articles, "row_key")) == expected_hits()


def test_join_equals_plain_evaluation(engine, articles):
    matched = M.match_join(articles, M.KeyTable.build(M.match_entries(engine.compiled), M.MATCH_ENTRY), engine.rules, "row_key")
    assert as_sets(M.hit_rows(matched, engine.blocks, "row_key")) == expected_hits()


def test_join_plan_broadcasts_nothing_unbounded(engine, articles):
    matched = M.match_join(articles, M.KeyTable.build(M.match_entries(engine.compiled), M.MATCH_ENTRY), engine.rules, "row_key")
    assert "CartesianProduct" not in matched._jdf.queryExecution().toString()


def test_the_caller_chooses_how_to_match(spark, articles):
    raw = X.raw_terms(spark, TERMS)
    params = Params(block_order=("A", "B"))
    for options in ({"matching": "join"}, {"matching": "any", "row_key": "row_key"}):
        with pytest.raises(ValueError):
            TriageEngine.build(raw, params, **options)
    joined = TriageEngine.build(raw, params, matching="join", row_key="row_key")
    by_join = joined.run(articles, timestamp=False).collect()
    by_row = TriageEngine.build(raw, params).run(articles, timestamp=False).collect()
    assert sorted(map(str, by_join)) == sorted(map(str, by_row))


def test_join_shuffles_no_normalised_text(engine, articles):
    table = M.KeyTable.build(M.match_entries(engine.compiled), M.MATCH_ENTRY)
    matched = M.match_join(articles, table, engine.rules, "row_key")
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("norm_" in line for line in joins)


def test_stored_articles_are_not_shuffled(spark, articles):
    raw = X.raw_terms(spark, TERMS)
    params = Params(block_order=("A", "B"))
    joined = TriageEngine.build(raw, params, matching="join", row_key="row_key")
    stored = joined.store(articles, buckets=4)
    found = joined.run(stored, timestamp=False)
    by_row = TriageEngine.build(raw, params).run(articles, timestamp=False)
    assert sorted(map(str, found.collect())) == sorted(map(str, by_row.collect()))
    # What is exchanged on the way to the candidates: keys, sections and words, no text.
    plan = joined.match(stored)._jdf.queryExecution().executedPlan()
    exchanged = []

    def walk(p):
        if "Exchange" in p.nodeName():
            exchanged.append(p.output().mkString(","))
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan.initialPlan() if "Adaptive" in plan.nodeName() else plan)
    assert exchanged and not any("title" in x or "abstract" in x for x in exchanged)


def test_a_filter_too_small_for_its_keys_loses_nothing(spark, engine, articles, monkeypatch):
    monkeypatch.setattr(M, "KEY_BITS", 1 << 15)
    monkeypatch.setattr(M, "_bit", lambda key: F.pmod(F.xxhash64(key), F.lit(3)))
    test_join_equals_plain_evaluation(engine, articles)


def test_all_contradictions_are_counted(spark):
    rows = [("A", k, f"t{i}", "1", "any", "0") for i in range(25) for k in ("pos", "anti")]
    with pytest.raises(ValueError, match="25"):
        TriageEngine.build(X.raw_terms(spark, rows))


def test_phrases_around_one_word_have_keys_of_their_own(spark):
    rows = [("A", "pos", f"x{i} sharedword", "1", "any", "0") for i in range(50)]
    e = TriageEngine.build(X.raw_terms(spark, rows))
    assert len(e.match_index.keys) == 50 and "sharedword" not in e.match_index.keys
    keyed = M.with_rarest_key(M.match_entries(e.compiled)).collect()
    assert sorted(r.lookup_key for r in keyed) == sorted(e.match_index.keys)


def test_terms_of_some_kinds(engine, articles):
    found = as_sets(engine.of_kinds("anti", "flag").hits(articles, "row_key"))
    whole = engine.hits(articles, "row_key").filter("kind <> 'pos'")
    assert found == as_sets(whole)


def test_narrow_plan_has_no_shuffle(engine, articles):
    plan = engine.run(articles)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PythonUDF" not in plan


def test_highlights(engine, articles):
    marked = engine.highlight(articles).collect()
    for row in marked:
        for section, column in zip(SECTIONS, ("Title_Highlighted", "Abstract_Highlighted", "Tags_Highlighted")):
            assert row[column] == checker.highlighted(row[section], section, TERMS), row[section]


def test_highlight_merges_touching_spans(spark):
    raw = X.raw_terms(spark, [("A", "pos", "c++", "1", "any", "0"), ("A", "pos", "+x", "1", "any", "0")])
    e = TriageEngine.build(raw)
    df = spark.createDataFrame([("1", "c+++x y", "", "")], "id string, title string, abstract string, manual_tags string")
    assert e.highlight(df).first()["Title_Highlighted"] == "***C+++X*** y"


def test_matches_of_one_pattern_that_touch_are_one_piece(spark):
    df = spark.createDataFrame([("aththe z zz", "th(?:e*)|z*"), ("no", "z*"), ("", "z*"), ("thth", "th")], "t string, p string")
    rows = df.select(H._pieces(F.col("t"), F.col("p")).alias("x")).collect()
    assert [[tuple(p) for p in r.x] for r in rows] == [
        [("a", "ththe"), (" ", "z"), (" ", "zz"), ("", None)], [("no", None)], [("", None)], [("", "thth"), ("", None)]
    ]


def test_highlights_in_long_texts(spark):
    """Spans at, before and over the edges of the chunks a long text is cut into."""
    rows = [("A", "pos", "oil and gas", "1", "any", "0"), ("A", "pos", "é*", "1", "any", "0")]
    e = TriageEngine.build(X.raw_terms(spark, rows))
    texts = ["x" * k + " oil and gas" + " éa 😀 y" * 400 + " oil and gas" for k in range(500, 515)]
    texts += ["oil and gas", "y" * 511 + " oil and gas", "oil and gas " + "z" * 1012]
    df = spark.createDataFrame(
        [(str(i), "", t, "") for i, t in enumerate(texts)],
        "id string, title string, abstract string, manual_tags string",
    )
    for row in e.highlight(df).collect():
        assert row["Abstract_Highlighted"] == checker.highlighted(row["abstract"], "abstract", rows)


def test_zero_length_matches_are_not_marked(spark):
    e = TriageEngine.build(X.raw_terms(spark, [("A", "pos", "z*|oil", "1", "any", "1")]))
    df = spark.createDataFrame([("1", "some oil", "", "")], "id string, title string, abstract string, manual_tags string")
    assert e.highlight(df).first()["Title_Highlighted"] == "some oil"


@pytest.mark.parametrize(
    ("regex", "text", "marked"),
    [
        ("oil(s*)|z*", "oils and zz oil", "***OILS*** and ***ZZ*** ***OIL***"),
        ("(?=o)", "oil", "oil"),
        ("o?", "oo x o", "***OO*** x ***O***"),
        ("colou{,1}r", "Color colour", "***COLOR*** ***COLOUR***"),
        ("[[]x", "a [x]", "a ***[X***]"),
        ("a(?#c)b", "ab", "***AB***"),
        (r"(?a:caf\w)", "cafe café", "***CAFE*** café"),
    ],
)
def test_regexes_that_match_nothing_or_are_written_differently(spark, regex, text, marked):
    e = TriageEngine.build(X.raw_terms(spark, [("A", "pos", regex, "1", "any", "1")]))
    df = spark.createDataFrame([("1", text, "", "")], "id string, title string, abstract string, manual_tags string")
    assert e.highlight(df).first()["Title_Highlighted"] == marked
    assert e.hits(df, "id").count() == 1


def test_spans_of_many_matches(spark):
    """More matches than one block of the running sums holds, with overlaps over its borders."""
    rows = [("A", "pos", r"b (a b )+", "1", "any", "1"), ("A", "pos", "a b", "1", "any", "0"), ("A", "pos", r"\bq\b.*", "1", "any", "1")]
    e = TriageEngine.build(X.raw_terms(spark, rows))
    texts = ["a b x " * k for k in (1, 127, 128, 129, 400)] + ["q " + "a b x " * 300, "a b a b a b x " * 200]
    df = spark.createDataFrame(
        [(str(i), "", t, "") for i, t in enumerate(texts)], "id string, title string, abstract string, manual_tags string"
    )
    for row in e.highlight(df).collect():
        assert row["Abstract_Highlighted"] == checker.highlighted(row["abstract"], "abstract", rows)


def test_proximity_pattern_equals_the_plain_form(spark):
    """The pattern that cannot run away accepts exactly what the plain one does."""
    rnd = random.Random(3)
    alphabet = ["a", "b", "-a", "b.", "x", " ", "-", ".", ",", "/", "xx", "a b"]
    for a, b, gap in (("a", "b", 2), ("a", "b", 0), ("-a", "b", 1), ("a", ".b", 2), ("a", "b.", 1), ("a b", "x", 3)):
        texts = {" ".join("".join(rnd.choices(alphabet, k=rnd.randint(1, 9))).split()) for _ in range(1500)}
        df = spark.createDataFrame([(t,) for t in texts if t], "t string").select(
            "t", F.rlike("t", P.proximity_pattern(F.lit(a), F.lit(b), gap, r"\S+")).alias("ok")
        )
        import re

        plain = re.compile(checker.near(a, b, gap))
        wrong = [r.t for r in df.collect() if r.ok != bool(plain.search(r.t))]
        assert not wrong, (a, b, gap, wrong[:5])


def test_proximity_over_long_rows_of_dots_ends(spark):
    text = "this " + "." * 20_000 + " x " + "-" * 20_000 + " y z"
    df = spark.createDataFrame([(text,)], "t string")
    pattern = P.proximity_pattern(F.lit("this"), F.lit("that"), 2)
    assert df.select(F.rlike("t", pattern)).first()[0] is False


def test_custom_token_unit(spark):
    df = spark.createDataFrame([("a 1 b",), ("a x b",)], "t string")
    rows = df.select(F.rlike("t", P.proximity_pattern(F.lit("a"), F.lit("b"), 1, r"\d"))).collect()
    assert [r[0] for r in rows] == [True, False]


@pytest.mark.parametrize(
    ("unit", "good", "between"),
    [
        (r"(?P<w>\S+)", True, "xyz"),
        (r"\w{,4}", True, "élan"),
        (r"(?:[[]|x)", True, "["),
        ("([", False, "anything"),
        ("(?(1)a|b)", False, "anything"),
        (r"(?P<w>x)(?P=w)", False, "anything"),
    ],
)
def test_token_units_are_vetted(spark, unit, good, between):
    assert T.vet_token_unit(spark, unit)[1] is good
    params = Params(block_order=("A",), token_unit=unit, max_gap=1)
    raw = X.raw_terms(spark, [("A", "pos", "oil and gas", "1", "any", "0")])
    docs = spark.createDataFrame([("1", f"oil {between} gas", "", "")], "id string, title string, abstract string, manual_tags string")
    assert TriageEngine.build(raw, params).hits(docs, "id").filter("match_type = 'proximity'").count() == 1
    assert ("token_unit" in [r.code for r in T.lint(raw, params).collect()]) is not good


def test_proximity_can_be_turned_off(spark, articles):
    raw = X.raw_terms(spark, TERMS)
    off = TriageEngine.build(raw, Params(block_order=("A", "B"), proximity=False))
    assert off.hits(articles, "row_key").filter("match_type = 'proximity'").isEmpty()


def test_compound_pairs(spark):
    cases = {
        "oil and gas": [["oil", "gas"]],
        "a AND b or c": [["a", "b"], ["b", "c"]],
        "x/y&z": [["x", "y"], ["y", "z"]],
        "brand": [],
        "& x": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.p for r in df.select("t", P.compound_pairs(F.col("t")).alias("p")).collect()}
    assert got == cases


def test_lookup_keys(spark):
    cases = {
        "oil": ["oil"], "C++": ["C"], "big data*": ["big"], "optim*": ["5<optim"], "*tion": ["4>tion"], "*il*": [],
        "g*s": ["1<g"], "ab*cde": ["3>cde"], "++": [], "de facto*": ["de"], "x* y*": ["1<x"],
        "oil and gas and oil": ["oil", "and", "gas"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.k for r in df.select("t", P.lookup_keys(F.col("t")).alias("k")).collect()}
    assert got == cases


def test_required_text_is_in_every_match():
    import re

    cases = {"th(is|at)": "th", "qu[ae]+": "qu", "a|b": "", "x?yz*w": "y", r"[0-9]{4}-[0-9]{2}": "-", "Oil(?=s)": "o"}
    for regex, text in cases.items():
        assert P.required_text(regex) in ("", text) or text in P.required_text(regex)
    for regex, sample in {"Straße": "STRAßE", "kilo": "KILO", r"a\.b": "x A.B"}.items():
        assert re.search(regex, sample, re.IGNORECASE) and P.required_text(regex) in sample.lower()


def test_regex_dialect():
    assert P.java_regex(r"(?P<n>a)(?P=n)\Z") == r"(?iuU)(?<n>a)\k<n>\z"


def test_highlight_entries_are_distinct(engine):
    rows = H.highlight_entries(engine.compiled).collect()
    assert len(rows) == len({str(r) for r in rows})
