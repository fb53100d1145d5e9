"""The registered queries again, as hand-written DuckDB SQL over the same tables.

RE2 has no lookaround: a whole word is written as (^|[^word])...($|[^word]), which says the
same about whether a text matches. Patterns are spelled out here, not taken from the
library, so that the comparison means something.
"""

from __future__ import annotations

W = r"[\p{L}\p{N}_]"
B = r"(^|[^\p{L}\p{N}_])"
E = r"($|[^\p{L}\p{N}_])"
SP = r"[\p{Z}\t\n\x0b\f\r\x1c-\x1f\x{85}]+"

ARTICLES = r"""
docs AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS abstract,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ', ' || source END AS manual_tags
  FROM documents
), raw_sections AS (
  SELECT id, 'title' AS section, 0 AS so, title AS t FROM docs
  UNION ALL SELECT id, 'abstract', 1, abstract FROM docs
  UNION ALL SELECT id, 'manual_tags', 2, manual_tags FROM docs
)"""

SECTIONS = (
    ARTICLES
    + rf""", sections AS MATERIALIZED (
  SELECT id, section, so, trim(regexp_replace(lower(t), '{SP}', ' ', 'g')) AS t FROM raw_sections
)"""
)


def word(body: str) -> str:
    return B + body + E


THIS_THAT = (
    B + r"this([\s\-/.,]+\S+){0,2}[\s\-/.,]+that" + E + "|" + B + r"that([\s\-/.,]+\S+){0,2}[\s\-/.,]+this" + E
)

# block, kind, ord, term, level, match type, pattern, scope, source row
FIXTURE = [
    ("FUNC", "pos", 0, "that", 2, "exact", word("that"), "any", 0),
    ("FUNC", "pos", 1, "with", 3, "exact", word("with"), "any", 1),
    ("FUNC", "pos", 2, "from", 4, "exact", word("from"), "any", 2),
    ("FUNC", "pos", 3, "th*", 5, "exact", B + "th" + W + "*", "any", 3),
    ("FUNC", "pos", 4, "pour", 2, "exact", word("pour"), "any", 4),
    ("FUNC", "pos", 5, "dans", 3, "exact", word("dans"), "any", 5),
    ("FUNC", "pos", 6, "sich", 2, "exact", word("sich"), "any", 6),
    ("FUNC", "pos", 7, "para", 2, "exact", word("para"), "any", 7),
    ("FUNC", "pos", 8, "ción*", 4, "exact", B + "ción" + W + "*", "any", 8),
    ("FUNC", "flag", 9, "than", None, "exact", word("than"), "any", 9),
    ("FUNC", "anti", 10, "thth", None, "exact", word("thth"), "any", 10),
    ("FORM", "pos", 11, "this and that", 1, "exact", word("this and that"), "any", 11),
    ("FORM", "pos", 12, "this", 3, "exact", word("this"), "any", 12),
    ("FORM", "pos", 13, "ther", 4, "exact", word("ther"), "any", 13),
    ("FORM", "pos", 14, "tion", 5, "exact", word("tion"), "any", 14),
    ("FORM", "pos", 15, "avec", 3, "exact", word("avec"), "any", 15),
    ("FORM", "pos", 16, "elle", 4, "exact", word("elle"), "any", 16),
    ("FORM", "pos", 17, "eine", 3, "exact", word("eine"), "any", 17),
    ("FORM", "pos", 18, "mente", 4, "exact", word("mente"), "any", 18),
    ("FORM", "pos", 19, "étion", 2, "exact", word("étion"), "any", 19),
    ("FORM", "pos", 20, "en", 5, "exact", word("en"), "any", 20),
    ("FORM", "pos", 100, "this and that", 1, "proximity", THIS_THAT, "any", 11),
    ("FORM", "flag", 21, "ándo", None, "exact", word("ándo"), "any", 21),
    ("FORM", "flag", 22, "heit", None, "exact", word("heit"), "any", 22),
    ("FORM", "anti", 23, "keit", None, "exact", word("keit"), "any", 23),
    ("T0", "anti", 24, "mit license", None, "exact", word("mit license"), "any", 24),
    ("T0", "flag", 25, "avec", None, "exact", word("avec"), "any", 25),
]
WILDCARDS = [
    ("FUNC", "pos", 0, "th*", 5, "exact", B + "th" + W + "*", "any", 0),
    ("FUNC", "pos", 1, "ción*", 4, "exact", B + "ción" + W + "*", "any", 1),
    ("FUNC", "pos", 2, "*tion", 3, "exact", W + "*tion" + E, "any", 2),
    ("FUNC", "pos", 3, "*igh*", 3, "exact", W + "*igh" + W + "*", "any", 3),
    ("FUNC", "pos", 4, "e*en", 2, "exact", B + "e" + W + "*en" + E, "any", 4),
    ("FORM", "pos", 5, "the th*", 1, "exact", B + "the th" + W + "*", "any", 5),
    ("FORM", "pos", 6, "*ing, the", 1, "exact", W + "*ing, the" + E, "any", 6),
]


def near(a: str, b: str, unit: str = r"\S+") -> str:
    gap = rf"([\s\-/.,]+{unit}){{0,2}}[\s\-/.,]+"
    return f"{B}{a}{gap}{b}{E}|{B}{b}{gap}{a}{E}"


PROXIMITY = [
    ("FUNC", "pos", 0, "this and that", 1, "exact", word("this and that"), "any", 0, ""),
    ("FUNC", "pos", 100, "this and that", 1, "proximity", near("this", "that"), "any", 0, "this+that"),
    ("FUNC", "pos", 1, "pour / dans", 2, "exact", word("pour / dans"), "any", 1, ""),
    ("FUNC", "pos", 101, "pour / dans", 2, "proximity", near("pour", "dans"), "any", 1, "pour+dans"),
    ("FORM", "pos", 2, "sich & eine or auf", 1, "exact", word("sich & eine or auf"), "any", 2, ""),
    ("FORM", "pos", 102, "sich & eine or auf", 1, "proximity", near("sich", "eine"), "any", 2, "sich+eine"),
    ("FORM", "pos", 103, "sich & eine or auf", 1, "proximity", near("eine", "auf"), "any", 2, "eine+auf"),
    ("FORM", "pos", 3, "para or una", 2, "exact", word("para or una"), "abstract", 3, ""),
    ("FORM", "pos", 104, "para or una", 2, "proximity", near("para", "una"), "abstract", 3, "para+una"),
]
REGEXES = [
    ("FUNC", "pos", 0, "th(is|at)", 3, "exact", "th(is|at)", "any", 0),
    ("FUNC", "pos", 1, r"^(the|la|der)\s", 2, "exact", "^(the|la|der) ", "any", 1),
    ("FORM", "pos", 2, r"qu[aeiou]+\s+(?P<w>en|de)", 4, "exact", r"qu[aeiou]+\s+(en|de)", "any", 2),
    ("FORM", "anti", 3, "[0-9]{4}-[0-9]{2}", None, "exact", "[0-9]{4}-[0-9]{2}", "abstract", 3),
]
SCOPED = [
    ("FUNC", "pos", 0, "en", 1, "exact", word("en"), "manual_tags", 0),
    ("FUNC", "pos", 1, "that", 2, "exact", word("that"), "title", 1),
    ("FORM", "pos", 2, "that", 2, "exact", word("that"), "abstract", 2),
    ("FORM", "flag", 3, "src1*", None, "exact", B + "src1" + W + "*", "manual_tags", 3),
    ("T0", "anti", 4, "src7", None, "exact", word("src7"), "manual_tags", 4),
]
BROAD = [
    *FIXTURE,
    ("FUNC", "pos", 26, "*e*", 5, "exact", W + "*e" + W + "*", "any", 26),
    ("FORM", "pos", 27, "qzqzqz", 5, "exact", word("qzqzqz"), "any", 27),
]
NORMALIZED = [
    ("FUNC", "pos", 0, "through", 1, "exact", word("through"), "any", 0),
    ("FUNC", "pos", 1, "it", 2, "exact", word("informatics"), "any", 1),
    ("FORM", "pos", 2, "thorough", 3, "exact", word("thorough"), "any", 2),
    ("FORM", "flag", 3, "informatics", None, "exact", word("informatics"), "any", 3),
]
INLINE = [
    ("FUNC", "pos", 0, "that", 2, "exact", word("that"), "any", 0),
    ("FUNC", "pos", 1, "th*", 5, "exact", B + "th" + W + "*", "any", 0),
    ("FUNC", "pos", 2, "pour", 2, "exact", word("pour"), "any", 0),
    ("FUNC", "flag", 3, "than", None, "exact", word("than"), "any", 0),
    ("FORM", "pos", 4, "this", 3, "exact", word("this"), "any", 0),
    ("FORM", "pos", 5, "en", 5, "exact", word("en"), "abstract", 0),
    ("T0", "anti", 6, "thth", None, "exact", word("thth"), "any", 0),
    ("T0", "flag", 7, "avec", None, "exact", word("avec"), "any", 0),
]
# Inline terms, then the table's: those of the FORM block and the pre-screen.
MERGED = [t for t in INLINE if t[0] != "T0"] + [(*t[:2], t[2] + 1000, *t[3:]) for t in FIXTURE if t[0] != "FUNC"]
FLAGS_ONLY = ("THEN 'bogus'", "THEN 'bogus' WHEN lang = 'fr' AND i % 41 <> 0 AND i % 11 <> 0 THEN 'flag'")
UNIFORM = [t for t in FIXTURE if t[0] != "T0"] + [("VOID", "pos", 26, "qzqzqz", 1, "exact", word("qzqzqz"), "any", 24)]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def hits(terms: list[tuple]) -> str:
    """One scan per term, each with a constant pattern."""
    parts = []
    for block, kind, order, term, level, how, pattern, scope, row, *comps in terms:
        scoped = "" if scope == "any" else f" AND section = {text(scope)}"
        parts.append(
            f"SELECT id, section, so, {text(block)} AS block, {text(kind)} AS kind, {order} AS ord, "
            f"{text(term)} AS term, CAST({'NULL' if level is None else level} AS INTEGER) AS level, "
            f"{text(how)} AS match_type, CAST({row} AS BIGINT) AS source_row, {text(comps[0] if comps else '')} AS components "
            f"FROM sections WHERE t <> '' AND regexp_matches(t, {text(pattern)}){scoped}"
        )
    return SECTIONS + ", hits AS MATERIALIZED (\n" + "\nUNION ALL ".join(parts) + ")"


def evals(terms: list[tuple] = FIXTURE, blocks: tuple[str, ...] = ("FUNC", "FORM"), noise: str = "") -> str:
    """Every block of every article by itself: `ev`."""
    names = ", ".join(f"({text(b)}, {i})" for i, b in enumerate(blocks))
    return (
        hits(terms)
        + f""", blocks(block, bo) AS (VALUES {names}),
lv AS (SELECT DISTINCT id, block, section, level FROM hits WHERE kind = 'pos' AND level IS NOT NULL),
ss AS (
  SELECT id, block, section,
    least(sum(CASE level WHEN 1 THEN 10 WHEN 2 THEN 8 WHEN 3 THEN 6 WHEN 4 THEN 4 ELSE 2 END), 30.0)
      * CASE section WHEN 'title' THEN 2.0 WHEN 'abstract' THEN 1.0 ELSE 1.5 END AS score
  FROM lv GROUP BY id, block, section
), wide_ss AS (
  SELECT id, block,
    CAST(coalesce(sum(score) FILTER (section = 'title'), 0) AS DOUBLE) AS title,
    CAST(coalesce(sum(score) FILTER (section = 'abstract'), 0) AS DOUBLE) AS abstract,
    CAST(coalesce(sum(score) FILTER (section = 'manual_tags'), 0) AS DOUBLE) AS manual_tags
  FROM ss GROUP BY ALL
), h AS (
  SELECT id, block,
    min(level) FILTER (kind = 'pos') AS best_level,
    max(level) FILTER (kind = 'pos') AS worst_level, min(level) FILTER (kind = 'pos' AND level <> 5) AS strong_level,
    count(DISTINCT term) FILTER (kind = 'pos') AS n_terms,
    count(DISTINCT section) FILTER (kind = 'pos') AS n_secs,
    arg_min(term, ord * 3 + so) FILTER (kind = 'anti') AS anti_term,
    arg_min(term, ord * 3 + so) FILTER (kind = 'flag') AS flag_term
  FROM hits GROUP BY ALL
), sc AS (
  SELECT d.id, b.block, b.bo, coalesce(w.title, 0.0) AS title, coalesce(w.abstract, 0.0) AS abstract,
    coalesce(w.manual_tags, 0.0) AS manual_tags, h.best_level, h.strong_level,
    coalesce(h.n_terms, 0) AS n_terms, coalesce(h.n_secs, 0) AS n_secs, h.anti_term, h.flag_term,
    coalesce(w.title, 0.0) + coalesce(w.abstract, 0.0) + coalesce(w.manual_tags, 0.0) AS raw_score,
    d.manual_tags = '' AND raw_score > 0 AS uplift,
    raw_score * CASE WHEN uplift THEN CAST(1.17 AS DOUBLE) ELSE 1.0 END AS final_score,
    CASE h.best_level WHEN 1 THEN 10 WHEN 2 THEN 12 WHEN 3 THEN 18 WHEN 4 THEN 22 END AS approval,
    CASE h.best_level WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 6 WHEN 4 THEN 7 WHEN 5 THEN 12 END AS flagging
  FROM docs d CROSS JOIN blocks b
  LEFT JOIN h ON h.id = d.id AND h.block = b.block
  LEFT JOIN wide_ss w ON w.id = d.id AND w.block = b.block
), ev AS MATERIALIZED (
  SELECT *,
    CASE WHEN anti_term IS NOT NULL THEN 'REJECTED'
      {noise.format(what="'REJECTED'", n_terms="'REJECTED'", n_secs="'REJECTED'") if noise else ""}
      WHEN best_level IS NULL THEN 'REJECTED'
      WHEN final_score >= approval THEN CASE WHEN flag_term IS NULL THEN 'APPROVED' ELSE 'FLAGGED' END
      WHEN final_score > 0 AND final_score >= flagging THEN 'FLAGGED' ELSE 'REJECTED' END AS status,
    CASE WHEN anti_term IS NOT NULL THEN 'Anti-exclusion: ' || anti_term
      {noise.format(
          what="'Noise filter: only weak-level terms found'",
          n_terms="'Noise filter: only ' || n_terms || ' unique term(s)'",
          n_secs="'Noise filter: hits in only ' || n_secs || ' section(s)'") if noise else ""}
      WHEN best_level IS NULL THEN 'No positive terms found'
      WHEN final_score >= approval AND flag_term IS NOT NULL
        THEN 'Downgraded to flagged: anti-flag term ''' || flag_term || ''''
      WHEN final_score >= approval
        THEN printf('Score %.2f >= threshold %d (L%d)', final_score, approval, best_level)
      WHEN final_score > 0 AND final_score >= flagging
        THEN printf('Score %.2f >= flag threshold %d (L%d)', final_score, flagging, best_level)
      ELSE printf('Score %.2f below thresholds (L%d)', final_score, best_level) END AS reason
  FROM sc
), t0 AS (
  SELECT d.id,
    CASE WHEN h.anti_term IS NOT NULL THEN 'REJECTED' WHEN h.flag_term IS NOT NULL THEN 'FLAGGED' ELSE 'PASSED' END AS status,
    CASE WHEN h.anti_term IS NOT NULL THEN 'Global exclusion: ' || h.anti_term
      WHEN h.flag_term IS NOT NULL THEN 'Global flag: ' || h.flag_term
      ELSE 'No global anti-terms triggered' END AS reason,
    'global' AS scope
  FROM docs d LEFT JOIN h ON h.id = d.id AND h.block = 'T0'
)"""
    )


NOISE = """
      WHEN best_level IS NOT NULL AND n_terms < 2 THEN {n_terms}
      WHEN best_level IS NOT NULL AND n_secs < 2 THEN {n_secs}
      WHEN best_level IS NOT NULL AND strong_level IS NULL THEN {what}"""


def masked(
    fail_fast: bool = True, terms: list[tuple] = FIXTURE, blocks: tuple[str, ...] = ("FUNC", "FORM"), noise: str = ""
) -> str:
    """Blocks as far as they are reached: `mv`, with `reached`."""
    later = (
        "coalesce(bool_or(ev.status = 'REJECTED') OVER "
        "(PARTITION BY ev.id ORDER BY bo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"
        if fail_fast
        else "false"
    )
    return (
        evals(terms, blocks, noise)
        + f""", rv AS (SELECT ev.*, t0.status = 'REJECTED' AS stopped, {later} AS late
  FROM ev JOIN t0 ON t0.id = ev.id),
mv AS MATERIALIZED (
  SELECT id, block, bo, NOT (stopped OR late) AS reached,
    CASE WHEN stopped OR late THEN 'NOT_EVALUATED' ELSE status END AS status,
    CASE WHEN stopped THEN 'Global T0 exclusion' WHEN late THEN 'Previous block rejected' ELSE reason END AS reason,
    CASE WHEN stopped OR late THEN 0.0 ELSE raw_score END AS raw_score,
    CASE WHEN stopped OR late THEN 0.0 ELSE final_score END AS final_score,
    CASE WHEN NOT (stopped OR late) THEN best_level END AS best_level,
    CASE WHEN NOT (stopped OR late) THEN flag_term END AS flag_term
  FROM rv)"""
    )


def decided(policy: str = "special", fail_fast: bool = True, terms: list[tuple] = FIXTURE) -> str:
    """Final decisions: `dec`."""
    approved = "list(block ORDER BY bo) FILTER (status = 'APPROVED')"
    names = "coalesce(array_to_string({}, ', '), '')"
    if policy == "strict":
        rules = """
      WHEN n_ok = n THEN ['APPROVED_FINAL', 'All blocks approved (strict policy)']
      WHEN n_flag > 0 THEN ['FLAGGED_FINAL', 'Flagged blocks: ' || flagged]
      ELSE ['REJECTED_FINAL', 'Rejected blocks: ' || rejected]"""
    elif policy == "k_of_n":
        rules = """
      WHEN n_rej > 0 THEN ['REJECTED_FINAL', 'Rejected blocks: ' || rejected]
      WHEN n_ok >= 1 AND n_flag <= 1 THEN ['APPROVED_FINAL', n_ok || '/' || n || ' approved (k_of_n)']
      WHEN n_ok + n_flag > 0 THEN ['FLAGGED_FINAL', n_ok || ' approved, ' || n_flag || ' flagged']
      ELSE ['REJECTED_FINAL', 'No blocks approved or flagged']"""
    else:
        rules = """
      WHEN n_rej > 0 THEN ['REJECTED_FINAL', 'Rejected blocks: ' || rejected]
      WHEN t0_status = 'FLAGGED' THEN ['FLAGGED_FINAL', 'T0: ' || t0_reason]
      WHEN anti_flagged <> '' THEN ['FLAGGED_FINAL', 'Anti-flag in blocks: ' || anti_flagged]
      WHEN n_flag = 1 AND n_ok >= 1 AND n_ok = n - 1 AND least_ok >= 40.0
        THEN ['APPROVED_FINAL', 'Special rule: ' || n_ok || ' approved (scores >= 40.0)']
      WHEN n_flag > 0 THEN ['FLAGGED_FINAL', 'Flagged blocks: ' || flagged]
      WHEN n_ok = n THEN ['APPROVED_FINAL', 'All blocks approved']
      ELSE ['FLAGGED_FINAL', 'Inconclusive evaluation']"""
    return (
        masked(fail_fast, terms)
        + f""", agg AS (
  SELECT id, count(*) AS n, count(*) FILTER (status = 'APPROVED') AS n_ok,
    count(*) FILTER (status = 'FLAGGED') AS n_flag, count(*) FILTER (status = 'REJECTED') AS n_rej,
    min(final_score) FILTER (status = 'APPROVED') AS least_ok,
    {names.format("list(block ORDER BY bo) FILTER (status = 'FLAGGED')")} AS flagged,
    {names.format("list(block ORDER BY bo) FILTER (status = 'REJECTED')")} AS rejected,
    {names.format("list(block ORDER BY bo) FILTER (flag_term IS NOT NULL)")} AS anti_flagged
  FROM mv GROUP BY id
), ruled AS (
  SELECT agg.id, CASE WHEN t0.status = 'REJECTED' THEN ['REJECTED_FINAL', 'T0: ' || t0.reason]{rules} END AS o
  FROM (SELECT agg.*, t0.status AS t0_status, t0.reason AS t0_reason FROM agg JOIN t0 USING (id)) agg
  JOIN t0 ON t0.id = agg.id
), dec AS MATERIALIZED (SELECT id, o[1] AS Final_Decision, o[2] AS Decision_Reason FROM ruled)"""
    )


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


# Statistics work on the rounded scores of the result table.
LONG = """, long AS (
  SELECT block, status, round(final_score, 2) AS score FROM mv
  UNION ALL SELECT 'T0', status, NULL FROM t0
)"""

COVERAGE = """, cov_hits AS (
  SELECT hits.* FROM hits {reached} WHERE kind = 'pos' AND hits.block <> 'T0'
), cov AS (
  SELECT term,
    count(*) FILTER (section = 'title') AS title_hits,
    count(*) FILTER (section = 'abstract') AS abstract_hits,
    count(*) FILTER (section = 'manual_tags') AS manual_tags_hits,
    count(*) AS hits, count(DISTINCT id) AS articles
  FROM cov_hits GROUP BY term
), broad AS (
  SELECT term, articles, hits, articles / (SELECT count(*) FROM docs) * 100 AS pct FROM cov
  WHERE articles > 0.8 * (SELECT count(*) FROM docs) AND (SELECT count(*) FROM docs) >= 10
)"""
REACHED = "JOIN mv ON mv.id = hits.id AND mv.block = hits.block AND mv.reached"


def coverage(reached: bool = True) -> str:
    return masked(True, BROAD) + COVERAGE.format(reached=REACHED if reached else "")


def dead(alias: str) -> str:
    configured = sorted({t[3] for t in BROAD if t[0] != "T0" and t[1] == "pos"})
    values = ", ".join(f"({text(t)})" for t in configured)
    return f"{alias} AS (SELECT term FROM (VALUES {values}) v(term) WHERE term NOT IN (SELECT term FROM cov))"


# A raw term table from the documents, and its cleaning.
RAW_TERMS = r"""
words AS (
  SELECT doc_id, lang, source, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT *, regexp_extract_all(text, '[^ \n]+') AS w FROM documents)
), counted AS (SELECT *, doc_id + pos AS i FROM words),
raw AS (
  SELECT CAST(doc_id * 100000 + pos AS BIGINT) AS source_row,
    trim(CASE WHEN i % 41 = 0 THEN '' WHEN i % 11 = 0 THEN 'GLOBAL' ELSE upper(lang) END) AS block,
    CASE WHEN i % 43 = 0 THEN 'bogus'
      ELSE ['pos', 'pos', 'pos', 'anti', 'flag', 'pos'][i % 6 + 1] END AS kind,
    trim(regexp_replace(CASE WHEN i % 37 = 0 THEN '' WHEN i % 29 = 0 THEN 'e' ELSE word END,
      '^[\p{Z}\t\n\x0b\f\r\x1c-\x1f\x{85}]+|[\p{Z}\t\n\x0b\f\r\x1c-\x1f\x{85}]+$', '', 'g')) AS term,
    trim(['1', '2.0', '', '1.5', 'x', '3', '9', '4', ' 5 '][i % 9 + 1]) AS level_text,
    CAST([1, 2, NULL, NULL, NULL, 3, 9, 4, 5][i % 9 + 1] AS INTEGER) AS level_number,
    ['any', 'title', 'abstract', 'body', 'any'][i % 5 + 1] AS scope_text,
    ['0', 'no', '', '0', 'maybe', '0', '0'][i % 7 + 1] AS regex_text,
    CASE WHEN i % 13 = 0 THEN 'abbreviation' WHEN i % 17 = 0 THEN 'compound_variant'
      WHEN i % 19 = 0 THEN 'other' ELSE '' END AS norm_type,
    CASE WHEN i % 13 = 0 THEN source WHEN i % 17 = 0 THEN lang ELSE '' END AS norm_target
  FROM counted
), usable AS (
  SELECT *, CASE WHEN kind = 'pos' AND level_number BETWEEN 1 AND 5 THEN level_number END AS level,
    CASE WHEN kind <> 'pos' THEN level_text
      WHEN level_number BETWEEN 1 AND 5 THEN CAST(level_number AS VARCHAR) ELSE '' END AS level_key,
    CASE WHEN scope_text = 'body' THEN 'any' ELSE scope_text END AS scope, false AS is_regex
  FROM raw WHERE block <> '' AND term <> '' AND kind <> 'bogus'
), ranked AS (
  SELECT *, row_number() OVER w AS rn, first_value(source_row) OVER w AS first_row FROM usable
  WINDOW w AS (PARTITION BY block, kind, lower(term), scope, level_key ORDER BY source_row)
), clean AS (SELECT * FROM ranked WHERE rn = 1),
rules AS (
  SELECT norm_type AS type, lower(term) AS key, lower(norm_target) AS target, source_row FROM raw
  WHERE norm_type IN ('abbreviation', 'compound_variant') AND norm_target <> '' AND term <> ''
)"""


def lint_sql() -> str:
    known = "block <> '' AND term <> '' AND kind <> 'bogus'"
    rules = [
        ("(block = '' OR term = '') AND norm_type = ''", "empty_field"),
        ("block <> '' AND term <> '' AND kind = 'bogus'", "kind"),
        (f"{known} AND kind = 'pos' AND level_text = ''", "level_missing"),
        (f"{known} AND kind = 'pos' AND level_text IN ('1.5', 'x')", "level_invalid"),
        (f"{known} AND kind = 'pos' AND level_number = 9", "level_unknown"),
        (f"{known} AND kind <> 'pos' AND level_text <> ''", "level_ignored"),
        (f"{known} AND scope_text = 'body'", "scope"),
        (f"{known} AND regex_text = 'maybe'", "is_regex"),
        ("norm_type = 'other'", "rule_type"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT source_row, 'warning' AS severity, {text(code)} AS code FROM raw WHERE {where}"
        for where, code in rules
    )


def _norm_rules_sql() -> str:
    """The rules of `normalize_text`; every boundary rule runs twice, as matches share a boundary."""

    def twice(expr: str, body: str, target: str, flags: str) -> str:
        for _ in range(2):
            expr = f"regexp_replace({expr}, {text(B + body + E)}, {text(chr(92) + '1' + target + chr(92) + '2')}, {text(flags)})"
        return expr

    e = twice("t", "it", "information tech", "gi")
    e = twice(e, "th", "through", "gi")
    e = f"lower({e})"
    for _ in range(2):
        e = f"regexp_replace({e}, {text(B + 'th[.]')}, {text(chr(92) + '1thorough')}, 'g')"
    e = f"replace({e}, ',', ' ;')"
    e = twice(e, "information tech", "informatics", "g")
    return f"trim(regexp_replace({e}, {text(SP)}, ' ', 'g'))"


MANIFEST_ERRORS = """
  SELECT doc_id, array_to_string(list_filter([
    CASE WHEN doc_id % 3 = 0 THEN 'Missing root key: ''schema_id''' END,
    CASE WHEN doc_id % 5 = 0 THEN 'Missing root key: ''generated_at''' END,
    CASE WHEN doc_id % 7 = 0 THEN 'Missing root key: ''configuration''' END,
    'Missing root key: ''artifacts''', 'Missing root key: ''reproducibility''',
    CASE WHEN doc_id % 4 <> 0 THEN 'Version mismatch: expected 2.1, got '
      || ['2.1', '2.0', '1.0', '3.0'][doc_id % 4 + 1] END], lambda x: x IS NOT NULL), '; ') AS errors
  FROM documents"""

DISTRIBUTION = """SELECT Final_Decision, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM dec GROUP BY 1"""

RUNS = """, named AS (
  SELECT id AS doc, lang || '-' || source AS run_id,
    CASE WHEN doc_id % 5 = 0 THEN 'other-' || source ELSE lang || '-' || source END AS other_id FROM docs)"""


def two_runs(by_source: bool = True, second: str = "strict") -> str:
    """Runs `ra` (special) and `rb` in one statement."""
    special = decided("special")
    other = decided(second).removeprefix(masked())
    for name in ("agg", "ruled", "dec"):
        other = other.replace(f", {name} AS (", f", {name}_other AS (").replace(
            f"), {name} AS MATERIALIZED", f"), {name}_other AS MATERIALIZED"
        )
    other = other.replace("FROM agg JOIN t0 USING (id)) agg", "FROM agg_other agg JOIN t0 USING (id)) agg")
    other = other.replace("), ruled AS", "), ruled_other AS").replace("\n), ruled", "\n), ruled")
    other = other.replace("FROM ruled)", "FROM ruled_other)")
    key_a, key_b = ("run_id", "other_id") if by_source else ("doc", "doc")
    return (
        special + other + RUNS
        + f""", ra AS (SELECT {key_a} AS k, Final_Decision AS d FROM dec JOIN named ON named.doc = dec.id),
rb AS (SELECT {key_b} AS k, Final_Decision AS d FROM dec_other JOIN named ON named.doc = dec_other.id),
pairs AS (SELECT coalesce(ra.k, rb.k) AS article_id, coalesce(ra.d, 'MISSING') AS old,
  coalesce(rb.d, 'MISSING') AS new FROM ra FULL OUTER JOIN rb ON ra.k = rb.k)"""
    )


def _packed(block: str, kind: str) -> str:
    if kind == "pos":
        item = (
            "'term=\"' || term || '\" sec=' || section || ' L=' || coalesce(CAST(level AS VARCHAR), 'None') || "
            "' row=' || source_row || ' type=' || match_type || "
            "CASE WHEN match_type = 'proximity' THEN ' comps=this+that' ELSE '' END"
        )
        order, sep = "so, ord", " | "
    else:
        item, order, sep = "term || ':' || section || ':' || source_row", "ord, so", "|"
    return (
        f"coalesce((SELECT string_agg({item}, '{sep}' ORDER BY {order}) FROM hits WHERE hits.id = dec.id "
        f"AND hits.block = '{block}' AND kind = '{kind}'"
        + (f" AND m_{block}.reached" if block != "T0" else "")
        + "), '')"
    )


def results_sql() -> str:
    columns = []
    for b in ("FUNC", "FORM"):
        columns.append(
            f"round(m_{b}.raw_score, 2) AS RawScore_{b}, round(m_{b}.final_score, 2) AS FinalScore_{b}, "
            f"m_{b}.best_level AS BestLevel_{b}, m_{b}.status AS Status_{b}, "
            f"{_packed(b, 'pos')} AS Highlights_{b}, {_packed(b, 'anti')} AS AntiHighlights_{b}, "
            f"{_packed(b, 'flag')} AS Flags_{b}"
        )
    return q(
        decided(),
        "SELECT dec.id AS ID, " + ", ".join(columns)
        + ", Final_Decision, Decision_Reason, '1.0.0' AS triage_version, t0.status AS Status_T0, "
        "t0.reason AS Reason_T0, t0.scope AS Scope_T0, "
        f"{_packed('T0', 'anti')} AS AntiHighlights_T0, {_packed('T0', 'flag')} AS Flags_T0 "
        "FROM dec JOIN t0 ON t0.id = dec.id "
        "JOIN mv m_FUNC ON m_FUNC.id = dec.id AND m_FUNC.block = 'FUNC' "
        "JOIN mv m_FORM ON m_FORM.id = dec.id AND m_FORM.block = 'FORM'",
    )


def highlight_sql() -> str:
    """Marked sections: phrases are first tied into one piece, then pieces are tested whole."""
    tie = r"\x{E000}"
    tied = "t"
    for phrase in (["this", "and", "that"], ["mit", "license"]):
        pattern = "(?i)" + B + " ".join(f"({w})" for w in phrase) + E
        groups = [f"\\{i + 2}" for i in range(len(phrase))]
        target = "\\1" + "\ue000".join(groups) + f"\\{len(phrase) + 2}"
        for _ in range(2):  # neighbouring phrases share a boundary character
            tied = f"regexp_replace({tied}, {text(pattern)}, {text(target)}, 'g')"
    piece = rf"[\p{{L}}\p{{N}}_{tie}]+|[^\p{{L}}\p{{N}}_{tie}]+"
    words = "|".join(
        [f"this{tie}and{tie}that", f"mit{tie}license", f"th{W}*", f"ción{W}*"]
        + "that with from pour dans sich para than thth this ther tion avec elle eine mente étion en ándo heit keit".split()
    )
    marked = (
        f"array_to_string(list_transform(regexp_extract_all({tied}, {text(piece)}), lambda p: "
        f"CASE WHEN regexp_full_match(lower(p), {text(words)}) "
        f"THEN '***' || upper(replace(p, chr(57344), ' ')) || '***' ELSE replace(p, chr(57344), ' ') END), '')"
    )
    return q(
        ARTICLES + f", marked AS (SELECT id, section, {marked} AS m FROM raw_sections)",
        """SELECT id, max(m) FILTER (section = 'title') AS Title_Highlighted,
  max(m) FILTER (section = 'abstract') AS Abstract_Highlighted,
  max(m) FILTER (section = 'manual_tags') AS Tags_Highlighted FROM marked GROUP BY id""",
    )


def highlight_regex_sql() -> str:
    """Pieces that the regex matches, neighbours together, and all other characters one by one."""
    found = "(?:th(?:e*)|z+)+"
    marked = (
        f"array_to_string(list_transform(regexp_extract_all(t, {text('(?is)' + found + '|.')}), lambda p: "
        f"CASE WHEN regexp_full_match(p, {text('(?i)' + found)}) THEN '***' || upper(p) || '***' ELSE p END), '')"
    )
    return q(
        ARTICLES + f", marked AS (SELECT id, section, {marked} AS m FROM raw_sections)",
        """SELECT id, max(m) FILTER (section = 'title') AS Title_Highlighted,
  max(m) FILTER (section = 'abstract') AS Abstract_Highlighted,
  max(m) FILTER (section = 'manual_tags') AS Tags_Highlighted FROM marked GROUP BY id""",
    )


PROFILE = """SELECT f AS field, c AS "column", count(*) AS n_rows, count(*) FILTER (trim(v) = '') AS n_blank,
  false AS missing
FROM (
  SELECT 'id' AS f, 'Article ID' AS c, id AS v FROM docs
  UNION ALL SELECT 'title', 'Document Title', regexp_replace(title, '{sp}', ' ', 'g') FROM docs
  UNION ALL SELECT 'abstract', 'Abstract Note', regexp_replace(abstract, '{sp}', ' ', 'g') FROM docs
  UNION ALL SELECT 'manual_tags', 'Manual Tags', manual_tags FROM docs
) GROUP BY ALL""".format(sp=SP)


def oracle_sql() -> dict[str, str]:
    status = "SELECT id, block, status, reason FROM mv"
    decision = "SELECT id, Final_Decision, Decision_Reason FROM dec"
    cov_columns = "SELECT term, title_hits, abstract_hits, manual_tags_hits, hits, articles FROM cov"
    advice_dead = "'Term ''' || term || ''' had 0 matches - check spelling or remove'"
    advice_broad = (
        "'Term ''' || term || ''' matched ' || articles || '/' || (SELECT count(*) FROM docs) || ' articles (' "
        "|| printf('%.0f', pct) || '%) - may add noise'"
    )
    advice_block = "'Block ''' || block || ''' has no discrimination - all articles are ' || min(status)"
    perf = LONG + """, p AS (SELECT block, count(status) AS n_valid, round(avg(score), 2) AS avg_score,
  max(score) AS max_score FROM long GROUP BY block)"""
    shares = """SELECT block, status, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY block), 2) AS pct FROM long GROUP BY block, status"""
    return {
        "triage": q(decided(), DISTRIBUTION),
        "articles_view": q(ARTICLES, "SELECT id, title, abstract, manual_tags FROM docs"),
        "tag_lists": "SELECT CAST(doc_id AS VARCHAR) AS id, "
        "CASE WHEN doc_id % 2 = 0 THEN lang || ', ' || source ELSE lang END AS manual_tags FROM documents",
        "column_profile": q(ARTICLES, PROFILE),
        "normalize_text": q(ARTICLES, f"SELECT id, section, {_norm_rules_sql()} AS norm FROM raw_sections"),
        "compound_pairs": q(
            SECTIONS,
            r"""SELECT id, section, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS a, parts[i + 1] AS b FROM (
  SELECT id, section, parts, unnest(range(1, len(parts))) AS i FROM (
    SELECT id, section, list_filter(list_transform(
      regexp_split_to_array(t, '\s+(?:and|or)\s+|\s*&\s*|\s*/\s*'), lambda x: trim(x)), lambda x: x <> '') AS parts
    FROM sections))""",
        ),
        "terms_dedup": q(
            RAW_TERMS, "SELECT source_row, block, kind, term, level, scope, is_regex FROM clean"
        ),
        "terms_duplicates": q(
            RAW_TERMS, "SELECT source_row, first_row, block, kind, term FROM ranked WHERE rn > 1"
        ),
        "terms_conflicts": q(
            RAW_TERMS,
            """SELECT block, lower(p.term) AS term, min(p.source_row) AS source_row, o.kind AS other_kind FROM (
  SELECT block, lower(term) AS term, min(source_row) AS source_row, bool_or(kind = 'pos') AS pos
  FROM clean WHERE block <> 'GLOBAL' GROUP BY ALL) p
JOIN (SELECT DISTINCT block, lower(term) AS term, kind FROM clean WHERE kind <> 'pos') o USING (block, term)
WHERE p.pos GROUP BY ALL""",
        ),
        "terms_lint": q(RAW_TERMS, lint_sql()),
        "terms_broad": q(
            RAW_TERMS,
            r"SELECT source_row, block, term FROM clean WHERE kind = 'pos' AND block <> 'GLOBAL' "
            r"AND regexp_full_match(term, '[*?]|\p{L}')",
        ),
        "terms_blocks": q(
            RAW_TERMS,
            "SELECT block, count(*) FILTER (kind = 'pos') AS n_pos, count(*) FILTER (kind = 'anti') AS n_anti, "
            "count(*) FILTER (kind = 'flag') AS n_flag FROM clean GROUP BY block",
        ),
        "terms_block_lint": q(
            RAW_TERMS,
            """SELECT 'warning' AS severity, 'block_ignored' AS code, block || ': ' || count(*) || ' term(s)' AS message
FROM clean WHERE block NOT IN ('GLOBAL', 'EN', 'FR', 'DE') GROUP BY block
UNION ALL SELECT 'warning', 'no_positives', block FROM clean WHERE block <> 'GLOBAL'
GROUP BY block HAVING count(*) FILTER (kind = 'pos') = 0""",
        ),
        "terms_browse": q(
            RAW_TERMS,
            "SELECT CASE block WHEN 'GLOBAL' THEN 'T0' WHEN 'DE' THEN 'de' ELSE block END AS block, kind, term, "
            "CASE WHEN kind = 'pos' THEN level END AS level, scope FROM clean WHERE block <> 'ES'",
        ),
        "norm_rules": q(
            RAW_TERMS, "SELECT type, key, arg_max(target, source_row) AS target FROM rules GROUP BY type, key"
        ),
        "norm_rule_conflicts": q(
            RAW_TERMS,
            "SELECT type, key, arg_max(target, source_row) AS target, max(source_row) AS source_row FROM rules "
            "GROUP BY type, key HAVING count(DISTINCT target) > 1",
        ),
        "term_hits": q(
            hits(FIXTURE), "SELECT id, block, kind, term, level, section, match_type, source_row FROM hits"
        ),
        "wildcard_hits": q(hits(WILDCARDS), "SELECT id, block, term, section FROM hits"),
        "proximity_hits": q(
            hits(PROXIMITY), "SELECT id, term, section, match_type, components FROM hits"
        ),
        "proximity_units": q(
            hits(
                [
                    (block, kind, order, term, level, "proximity", near(*parts.split("+"), unit), scope, row, parts + name)
                    for block, kind, order, term, level, how, _, scope, row, parts in PROXIMITY
                    if how == "proximity"
                    for name, unit in ((" (?P<w>\\S+)", r"\S+"), (r" \w{,4}", rf"{W}{{0,4}}"), (" \\", r"\S+"))
                ]
            ),
            "SELECT id, term, section, split_part(components, ' ', 1) AS components, "
            "split_part(components, ' ', 2) AS unit FROM hits",
        ),
        "regex_hits": q(hits(REGEXES), "SELECT id, block, kind, term, section FROM hits"),
        "scoped_hits": q(hits(SCOPED), "SELECT id, block, kind, term, section FROM hits"),
        "anti_hits": q(
            hits([t for t in FIXTURE if t[1] != "pos"]), "SELECT id, block, kind, term, section FROM hits"
        ),
        "section_scores": q(
            masked(False),
            "SELECT sc.id, sc.block, title, abstract, manual_tags FROM sc "
            "JOIN mv ON mv.id = sc.id AND mv.block = sc.block AND reached",
        ),
        "block_scores": q(
            masked(False),
            "SELECT sc.id, sc.block, round(sc.raw_score, 2) AS raw_score, round(sc.final_score, 2) AS final_score, "
            "sc.best_level, uplift FROM sc JOIN mv ON mv.id = sc.id AND mv.block = sc.block AND reached",
        ),
        "noise_filter": q(masked(False, noise=NOISE), status),
        "block_status": q(masked(False), status),
        "t0_prescreen": q(evals(), "SELECT id, status, reason, scope FROM t0"),
        "fail_fast": q(masked(), status),
        "decision_special": q(decided(), decision),
        "decision_special_all_blocks": q(decided(fail_fast=False), decision),
        "decision_strict": q(decided("strict"), decision),
        "decision_strict_all_blocks": q(decided("strict", False), decision),
        "decision_k_of_n": q(decided("k_of_n"), decision),
        "decision_distribution": q(decided("k_of_n"), DISTRIBUTION),
        "status_distribution": q(masked() + LONG, shares),
        "block_performance": q(masked() + perf, "SELECT block, n_valid, avg_score, max_score FROM p"),
        "score_distribution": q(
            masked() + LONG,
            "SELECT block, round(avg(score), 2) AS mean, round(stddev_samp(score), 2) AS std, min(score) AS min, "
            "max(score) AS max, count(score) AS n_valid FROM long WHERE score IS NOT NULL GROUP BY block",
        ),
        "level_distribution": q(masked(), "SELECT block, best_level, count(*) AS n FROM mv GROUP BY ALL"),
        "run_totals": "SELECT count(*) AS n_total, count(*) FILTER (doc_id % 50 <> 7) AS n_valid, "
        "count(*) FILTER (doc_id % 50 = 7) AS n_error, "
        "round(count(*) FILTER (doc_id % 50 = 7) / count(*), 6) AS error_rate FROM documents",
        "error_rows": q(
            decided(),
            """SELECT dec.id AS ID, Final_Decision, Decision_Reason FROM dec WHERE CAST(dec.id AS INTEGER) % 50 <> 7
UNION ALL SELECT 'ERR_' || (doc_id + 1), 'FLAGGED_FINAL', 'Processing error: bad record'
FROM documents WHERE doc_id % 50 = 7""",
        ),
        "term_hits_joined": q(
            hits(FIXTURE), "SELECT id, block, kind, term, level, section, match_type, source_row FROM hits"
        ),
        "terms_no_positives": q(
            RAW_TERMS.replace(*FLAGS_ONLY),
            "SELECT 'warning' AS severity, 'no_positives' AS code, block AS message FROM clean "
            "WHERE block <> 'GLOBAL' GROUP BY block HAVING count(*) FILTER (kind = 'pos') = 0",
        ),
        "terms_bad_regexes": """SELECT min(doc_id) AS source_row, 'warning' AS severity, 'regex' AS code,
  'block ''A'', term ''' || any_value(source) || CASE doc_id % 4 WHEN 1 THEN '(' ELSE '[b-a]' END || '''' AS message
FROM documents WHERE doc_id % 4 IN (1, 3) GROUP BY source, doc_id % 4""",
        "config_checks": q(
            RAW_TERMS.replace(*FLAGS_ONLY),
            """SELECT CASE WHEN n IS NULL THEN 'error' ELSE 'warning' END AS severity,
  CASE WHEN n IS NULL THEN 'Block ''' || wanted || ''' is asked for, but has no terms'
    ELSE 'Block ''' || wanted || ''' can never approve: no positives' END AS message
FROM (VALUES ('EN'), ('FR'), ('XX')) AS b(wanted)
LEFT JOIN (SELECT block, count(*) FILTER (kind = 'pos') AS n FROM clean GROUP BY block) ON block = wanted
WHERE n IS NULL OR n = 0
UNION ALL SELECT 'error', '''any'' is no decision policy; there are special, strict, k_of_n'
UNION ALL SELECT 'warning', 'LIMITES_APROVADO: level 1 has a threshold below zero (-1)'
UNION ALL SELECT 'warning', 'LIMITES_SINALIZADO: level 3 has a threshold below zero (-2)'""",
        ),
        "csv_exchange": q(
            decided(),
            """SELECT dec.id AS ID, replace(printf('%.2f', round(a.final_score, 2)), '.', ',') AS FinalScore_FUNC,
  coalesce(CAST(b.best_level AS VARCHAR), '') AS BestLevel_FORM, Final_Decision, Decision_Reason
FROM dec JOIN mv a ON a.id = dec.id AND a.block = 'FUNC' JOIN mv b ON b.id = dec.id AND b.block = 'FORM'""",
        ),
        "csv_encodings": q(ARTICLES, "SELECT id, title, abstract, manual_tags FROM docs"),
        "error_gate": """WITH c AS (
  SELECT count(*) FILTER (doc_id % 50 = 7) / count(*) AS rate FROM documents
)
SELECT CAST(max_rate AS DOUBLE) AS max_rate, policy, policy = 'flag' AND max_rate >= 0 AND rate > max_rate AS stops
FROM c, (VALUES (-1.0), (0.0), (0.01), (0.05)) AS l(max_rate), (VALUES ('flag'), ('fail')) AS p(policy)""",
        "merged_terms": q(decided(terms=MERGED), decision),
        "no_blocks": q(
            evals(),
            "SELECT id, 'REJECTED_FINAL' AS Final_Decision, CASE WHEN status = 'REJECTED' THEN 'T0: ' || reason "
            "ELSE 'No domain blocks configured' END AS Decision_Reason FROM t0",
        ),
        "article_detail": q(
            decided(fail_fast=False),
            """SELECT CAST(v.position AS INTEGER) AS position, v.name,
  CASE WHEN length(v.value) > 30 THEN left(v.value, 27) || '...' ELSE v.value END AS value
FROM dec JOIN mv a ON a.id = dec.id AND a.block = 'FUNC' JOIN mv b ON b.id = dec.id AND b.block = 'FORM',
LATERAL (VALUES (0, 'ID', dec.id), (1, 'Final_Decision', Final_Decision), (2, 'Decision_Reason', Decision_Reason),
  (3, 'FinalScore_FUNC', CAST(round(a.final_score, 2) AS VARCHAR)), (4, 'Status_FUNC', a.status),
  (5, 'FinalScore_FORM', CAST(round(b.final_score, 2) AS VARCHAR)), (6, 'Status_FORM', b.status)
) AS v(position, name, value)
WHERE dec.id = '7'""",
        ),
        "stream_decisions": q(decided(), "SELECT Final_Decision, count(*) AS n FROM dec GROUP BY Final_Decision"),
        "normalized_hits": q(
            hits(NORMALIZED).replace(
                SECTIONS,
                ARTICLES + f", sections AS MATERIALIZED (SELECT id, section, so, {_norm_rules_sql()} AS t FROM raw_sections)",
            ),
            "SELECT id, block, kind, term, section FROM hits",
        ),
        "inline_terms": q(decided(terms=INLINE), decision),
        "report_dotted_block": q(
            decided() + perf + ", s AS (" + shares + ")",
            f"""SELECT 'decision' AS part, '' AS block, Final_Decision AS name, CAST(n AS DOUBLE) AS value, pct
FROM ({DISTRIBUTION})
UNION ALL SELECT 'status', replace(block, 'FUNC', 'A.1'), status, n, pct FROM s
UNION ALL SELECT 'score', replace(block, 'FUNC', 'A.1'), 'avg_score', avg_score, NULL FROM p WHERE block <> 'T0'
UNION ALL SELECT 'score', replace(block, 'FUNC', 'A.1'), 'max_score', max_score, NULL FROM p WHERE block <> 'T0'""",
        ),
        "report": q(
            decided() + perf + ", s AS (" + shares + ")",
            f"""SELECT 'decision' AS part, '' AS block, Final_Decision AS name, CAST(n AS DOUBLE) AS value, pct
FROM ({DISTRIBUTION})
UNION ALL SELECT 'status', block, status, n, pct FROM s
UNION ALL SELECT 'score', block, 'avg_score', avg_score, NULL FROM p WHERE block <> 'T0'
UNION ALL SELECT 'score', block, 'max_score', max_score, NULL FROM p WHERE block <> 'T0'""",
        ),
        "term_coverage": q(coverage(), cov_columns),
        "term_coverage_all_blocks": q(coverage(False), cov_columns),
        "coverage_of_results": q(coverage(), cov_columns),
        "dead_terms": q(coverage() + ", " + dead("d"), "SELECT term FROM d"),
        "broad_terms": q(coverage(), "SELECT term, articles, hits, round(pct, 2) AS pct FROM broad"),
        "section_distribution": q(
            coverage(),
            """SELECT 'title' AS section, CAST(coalesce(sum(title_hits), 0) AS BIGINT) AS hits FROM cov
UNION ALL SELECT 'abstract', CAST(coalesce(sum(abstract_hits), 0) AS BIGINT) FROM cov
UNION ALL SELECT 'manual_tags', CAST(coalesce(sum(manual_tags_hits), 0) AS BIGINT) FROM cov""",
        ),
        "block_discrimination": q(
            evals(UNIFORM, ("FUNC", "FORM", "VOID")),
            "SELECT block, min(status) AS status FROM ev GROUP BY block HAVING count(DISTINCT status) = 1",
        ),
        "suggestions": q(
            coverage() + ", " + dead("d"),
            f"""SELECT 'dead' AS about, {advice_dead} AS suggestion FROM d
UNION ALL SELECT 'broad', {advice_broad} FROM broad
UNION ALL SELECT 'block', {advice_block} FROM mv GROUP BY block HAVING count(DISTINCT status) = 1""",
        ),
        "coverage_export": q(
            coverage() + ", " + dead("d"),
            """SELECT term, 'dead' AS status, CAST(0 AS BIGINT) AS hits, CAST(0 AS DOUBLE) AS pct,
  CAST(NULL AS BIGINT) AS articles, CAST(NULL AS BIGINT) AS section_hits FROM d
UNION ALL SELECT term, 'broad', NULL, round(pct, 2), articles, hits FROM broad""",
        ),
        "run_diff": q(
            two_runs(),
            "SELECT article_id, old, new, count(*) AS n FROM pairs WHERE old <> new GROUP BY ALL",
        ),
        "diff_transitions": q(
            two_runs(by_source=False),
            "SELECT old, new, count(*) AS n FROM pairs WHERE old <> new GROUP BY ALL",
        ),
        "run_diff_stored": q(
            two_runs(False, "k_of_n"),
            "SELECT article_id, old, new, count(*) AS n FROM pairs WHERE old <> new GROUP BY ALL",
        ),
        "diff_totals": "SELECT count(*) AS total_a, count(*) AS total_b FROM documents",
        "results": results_sql(),
        "results_page": q(
            decided(),
            """SELECT dec.id AS ID, round(a.final_score, 2) AS FinalScore_FUNC, a.status AS Status_FUNC,
  round(b.final_score, 2) AS FinalScore_FORM, b.status AS Status_FORM, Final_Decision, t0.status AS Status_T0
FROM dec JOIN t0 ON t0.id = dec.id JOIN mv a ON a.id = dec.id AND a.block = 'FUNC'
JOIN mv b ON b.id = dec.id AND b.block = 'FORM'
WHERE Final_Decision = 'REJECTED_FINAL' ORDER BY CAST(dec.id AS INTEGER) LIMIT 50 OFFSET 50""",
        ),
        "highlight": highlight_sql(),
        "manifest_check": MANIFEST_ERRORS,
        "manifest_migration": """SELECT doc_id,
  CASE WHEN doc_id % 4 = 3 THEN 'Unknown source version: 3.0' END AS error,
  CASE WHEN doc_id % 4 <> 3 THEN 0 END AS n_errors,
  CASE WHEN doc_id % 4 <> 3 THEN source END AS input_file,
  CASE WHEN doc_id % 4 <> 3 THEN 'run_' || doc_id END AS execution_id,
  CASE WHEN doc_id % 4 <> 3 THEN 'rsl-triage-protocol-v2.1' END AS schema_id,
  CASE WHEN doc_id % 4 <> 3 THEN '[draft] {' || source END AS note,
  CASE WHEN doc_id % 4 <> 3 THEN n_chars END AS size,
  CASE WHEN doc_id % 4 <> 3 THEN doc_id % 2 = 0 END AS final
FROM documents""",
        "highlight_regex": highlight_regex_sql(),
        "sample_preview": "SELECT least(50, count(*)) AS n_rows, least(50, count(*)) AS n_as_in_run, "
        "least(50, count(*)) AS n_again FROM documents",
        "input_fingerprint": "SELECT count(*) AS n_rows, true AS order_free, true AS tells_nulls FROM documents",
        "run_manifest": "SELECT '2.1' AS protocol_version, '1.0.0' AS triage_version, 'documents' AS input_file, "
        "16 AS hash_length, 'special' AS decision_policy, 'FUNC,FORM' AS blocks, count(*) AS total_articles, "
        "count(*) / 2.0 AS articles_per_second FROM documents",
    }
