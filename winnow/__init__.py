"""Document triage on Spark: transparent rules, weighted terms, explainable decisions."""

from winnow.operators.analytics import run_diff, term_coverage
from winnow.operators.results import sample_articles
from winnow.operators.terms import lint
from winnow.params import Params
from winnow.plans.engine import TriageEngine

__all__ = ["Params", "TriageEngine", "lint", "run_diff", "sample_articles", "term_coverage"]
