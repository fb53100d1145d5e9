"""Timings of the headline queries; prints one JSON line.

Every query runs to a sink that takes all columns. One untimed run comes first, then the
median of two. `articles_per_sec` adds throughput by dictionary size.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from winnow import fixture as X  # noqa: E402
from winnow import queries as Q  # noqa: E402
from winnow.operators import analytics as A  # noqa: E402
from winnow.operators.matching import with_norm, with_words  # noqa: E402
from winnow.params import Params  # noqa: E402
from winnow.plans.engine import TriageEngine  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = [
    "triage", "term_hits", "wildcard_hits", "proximity_hits", "block_status",
    "decision_special", "decision_k_of_n", "report", "term_coverage",
    "coverage_export", "run_diff", "results", "highlight", "normalize_text", "terms_dedup",
    "terms_duplicates", "column_profile", "regex_hits", "term_hits_joined", "anti_hits",
]


def timed(make) -> float:
    def once() -> float:
        begin = time.perf_counter()
        df: DataFrame = make()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    once()
    return round(statistics.median(once() for _ in range(RUNS)), 3)


def laid_out(spark: SparkSession) -> str:
    """The tables with the documents in as many files as there are cores.

    The documents come as one row group, which one task reads. How a table is stored is for
    its owner to choose, so the library does not deal rows out anew.
    """
    target = tempfile.mkdtemp(prefix="bench-")
    for entry in os.scandir(SF_DIR):
        if entry.name != "documents.parquet":
            os.symlink(entry.path, os.path.join(target, entry.name))
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    documents.repartition(int(CPUS)).write.parquet(f"{target}/documents.parquet")
    return target


def frequent_words(spark: SparkSession, sf_dir: str, n: int) -> list[str]:
    """The n most frequent words of the documents, as a dictionary of any size."""
    words = with_words(with_norm(X.articles(spark, sf_dir), None)).select(
        F.explode("words_abstract").alias("w")
    )
    counted = words.filter("length(w) > 1").groupBy("w").count()
    return [r["w"] for r in counted.orderBy(F.desc("count"), "w").limit(n).collect()]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = Q.queries()
    sf_dir = laid_out(spark)
    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(lambda name=name: registered[name](spark, sf_dir))
        print(name, seconds[name], file=sys.stderr, flush=True)

    docs = X.articles(spark, sf_dir)
    n_articles = docs.count()
    rates = {}

    def rate(name: str, make) -> None:
        rates[name] = round(n_articles / timed(make), 1)
        print(name, rates[name], file=sys.stderr, flush=True)

    def built(terms: list[str], regex: str = "0", **options) -> TriageEngine:
        rows = [("FUNC", "pos", w, str(i % 5 + 1), "any", regex) for i, w in enumerate(terms)]
        return TriageEngine.build(X.raw_terms(spark, rows), Params(block_order=("FUNC",)), **options)

    words = frequent_words(spark, sf_dir, 1000)
    for n in (10, 100, 1000):
        e = built(words[:n])
        rate(f"hits_{n}_terms", lambda e=e: e.match(docs))
        rate(f"decisions_{n}_terms", lambda e=e: e.decide(docs))
    rate("coverage_1000_terms", lambda: A.term_coverage(e.decide(docs)))
    rate("highlight_1000_terms", lambda: e.highlight(docs))
    phrases = built([f"{w} {words[0]}" for w in words[1:]])
    rate("hits_999_phrases_of_one_word", lambda: phrases.match(docs))
    for n in (1, 200):
        regexes = built([f"{w}[a-z]?" for w in words[:n]], "1")
        rate(f"hits_{n}_regexes", lambda e=regexes: e.match(docs))
    joined = built(words, matching="join", row_key="id")
    stored = joined.store(docs)  # in buckets of the row key, as their owner would keep them
    rate("hits_1000_terms_joined", lambda: joined.match(stored))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "articles_per_sec": rates,
                "articles": n_articles,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
