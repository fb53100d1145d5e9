"""The triage engine: terms and parameters in, decisions as lazy DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import NormRules, rules_from_table
from winnow.operators import highlight as H
from winnow.operators import matching as M
from winnow.operators import results as R
from winnow.operators import terms as T
from winnow.operators.decision import decide
from winnow.operators.scoring import evaluate
from winnow.params import SECTIONS, Params
from winnow.sources.staging import stored_by

ARTICLE_COLUMNS = ("id", *SECTIONS)


@dataclass(frozen=True)
class TriageEngine:
    """Compiled dictionary and parameters; build it once, run it on any number of tables.

    `matching` says how articles meet terms: by "row", with the dictionary in the plan and
    on the driver, or by "join", with the dictionary as a table of any size. For a join,
    `row_key` names an article column that identifies the row.
    """

    params: Params
    term_set: T.TermSet
    rules: NormRules | None = None
    row_key: str | None = None
    matching: str = "row"

    @classmethod
    def build(
        cls,
        raw_terms: DataFrame,
        params: Params | None = None,
        inline: DataFrame | None = None,
        row_key: str | None = None,
        matching: str = "row",
        rules: NormRules | None = None,
    ) -> TriageEngine:
        """Engine from a raw term table, plus terms and rules written in a configuration.

        Normalisation rules of the term table go before `rules`.
        """
        if matching not in ("row", "join"):
            raise ValueError(f"Articles are matched by 'row' or by 'join', not by '{matching}'")
        if matching == "join" and row_key is None:
            raise ValueError("Matching by join needs a row_key that identifies an article")
        params = params or Params()
        terms = T.clean(raw_terms, params)
        if matching == "row":
            # Read and cleaned only once; the plan will hold these terms anyway.
            terms = terms.sparkSession.createDataFrame(terms.toArrow())
        contradicting = T.conflicts(terms).count()
        if contradicting:
            raise ValueError(
                f"Contradicting terms: {contradicting} are positive and something else in the same block; "
                "operators.terms.conflicts lists them"
            )
        if inline is not None:
            terms = inline.unionByName(terms)
        has_rules = any(c.strip().lower() == "normalization_type" for c in raw_terms.columns)
        if has_rules:
            of_table = rules_from_table(T.norm_rules(raw_terms))
            rules = of_table if of_table.enabled or rules is None else rules
        return cls(params, T.route(terms, params.block_order), rules, row_key, matching)

    @property
    def blocks(self) -> tuple[str, ...]:
        return self.term_set.blocks

    @property
    def has_t0(self) -> bool:
        return self.term_set.has_t0

    def with_params(self, **changes) -> TriageEngine:
        """The same dictionary under other scoring or decision parameters."""
        params = self.params.with_(**changes)
        other = TriageEngine(params, self.term_set, self.rules, self.row_key, self.matching)
        if not {"max_gap", "token_unit", "proximity"} & set(changes):
            for name in ("compiled", "match_index", "highlight_index", "match_table", "highlight_table"):
                if name in self.__dict__:
                    other.__dict__[name] = self.__dict__[name]
        return other

    @cached_property
    def compiled(self) -> DataFrame:
        return T.compile_terms(self.term_set, self.rules, self.params)

    @cached_property
    def match_index(self) -> M.KeyIndex:
        return M.KeyIndex.build(M.match_entries(self.compiled), M.MATCH_ENTRY)

    @cached_property
    def highlight_index(self) -> M.KeyIndex:
        return M.KeyIndex.build(H.highlight_entries(self.compiled), H.HIGHLIGHT_ENTRY)

    @cached_property
    def match_table(self) -> M.KeyTable:
        return M.KeyTable.build(M.match_entries(self.compiled), M.MATCH_ENTRY)

    @cached_property
    def highlight_table(self) -> M.KeyTable:
        return M.KeyTable.build(H.highlight_entries(self.compiled), H.HIGHLIGHT_ENTRY)

    def of_kinds(self, *kinds: str) -> TriageEngine:
        """The same engine with the terms of some kinds only."""
        terms = self.term_set.terms.filter(F.col("kind").isin(*kinds))
        term_set = T.TermSet(terms, self.term_set.blocks, self.term_set.has_t0)
        return TriageEngine(self.params, term_set, self.rules, self.row_key, self.matching)

    def store(self, articles: DataFrame, path: str | None = None, buckets: int = 0) -> DataFrame:
        """Articles with their normalised text, in buckets of the row key: matching by join then
        normalises and shuffles no text. `buckets` is as many as there are shuffle partitions, if 0."""
        if self.row_key is None:
            raise ValueError("Articles are stored by a row_key")
        buckets = buckets or int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return stored_by(M.with_norm(articles, self.rules), self.row_key, buckets, path)

    def match(self, articles: DataFrame) -> DataFrame:
        """Adds `hits` and `has_tags`."""
        if self.matching == "row":
            return M.match_narrow(articles, self.match_index, self.rules)
        return M.match_join(articles, self.match_table, self.rules, self.row_key)

    def evaluate(self, articles: DataFrame) -> DataFrame:
        """Adds block evaluations (`evals`) and the pre-screen's outcome (`t0`)."""
        return evaluate(self.match(articles), self.blocks, self.has_t0, self.params)

    def decide(self, articles: DataFrame) -> DataFrame:
        """Adds `Final_Decision` and `Decision_Reason`."""
        return decide(self.evaluate(articles), self.blocks, self.has_t0, self.params)

    def highlight(self, articles: DataFrame) -> DataFrame:
        """Adds the sections with matched text marked."""
        if self.matching == "row":
            words = H.with_original_words(articles)
            found = M.with_candidates(words, self.highlight_index, "")
        else:
            found = M.with_joined_candidates(
                articles, self.highlight_table, self.row_key, H.with_original_words, ""
            )
        return H.marked_sections(found, [c for c in articles.columns if c not in M.NORM_COLUMNS])

    def run(self, articles: DataFrame, id_output: str = "ID", timestamp: bool = True) -> DataFrame:
        """The published result table."""
        R.check_id_output(id_output, self.blocks)
        decided = self.decide(self.highlight(articles))
        return R.wide(decided, self.blocks, self.has_t0, id_output, timestamp)

    def preview(self, articles: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
        """The result table for a sample."""
        return self.run(R.sample_articles(articles, n, seed))

    def hits(self, articles: DataFrame, *keep: str) -> DataFrame:
        return M.hit_rows(self.match(articles), self.blocks, *keep)


def require_articles(articles: DataFrame) -> None:
    """Refuse an empty corpus before anything is written."""
    if articles.isEmpty():
        raise ValueError("The input has no articles")


