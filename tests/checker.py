"""A plain per-article evaluation of the rules, to compare the Spark plans with."""

import re


def norm(text):
    return re.sub(r"\s+", " ", text.lower()).strip()


def bounded(term, body):
    word = lambda c: c.isalnum() or c == "_"
    head = r"(?<!\w)" if word(term[0]) else ""
    tail = r"(?!\w)" if word(term[-1]) else ""
    return head + body + tail


def literal(term):
    return bounded(term, re.escape(term).replace(r"\*", r"\w*"))


def pairs(term):
    parts = [p.strip() for p in re.split(r"(?i)\s+(?:and|or)\s+|\s*&\s*|\s*/\s*", term.strip())]
    parts = [p for p in parts if p]
    return list(zip(parts, parts[1:]))


def near(a, b, gap):
    sep = r"[\s\-/.,]+"
    between = rf"(?:{sep}\S+){{0,{gap}}}{sep}"

    def one(x, y):
        head = r"(?<!\w)" if re.match(r"\w", x[0]) else ""
        tail = r"(?!\w)" if re.match(r"\w", y[-1]) else ""
        return head + re.escape(x) + between + re.escape(y) + tail

    return one(a, b) + "|" + one(b, a)


def compiled(rows, gap=2):
    """(block, kind, term, level, scope, match_type, components, regex) in match order."""
    exact, prox = [], []
    for block, kind, term, level, scope, is_regex in rows:
        text = term if is_regex == "1" else norm(term)
        pattern = term if is_regex == "1" else literal(text)
        lvl = int(level) if level else None
        exact.append((block, kind, term, lvl, scope, "exact", (), re.compile(pattern, re.I)))
        if kind == "pos":
            for a, b in pairs(text):
                prox.append(
                    (block, kind, term, lvl, scope, "proximity", (a, b), re.compile(near(a, b, gap), re.I))
                )
    return exact + prox


def hits(article, terms):
    found = set()
    for section in ("title", "abstract", "manual_tags"):
        text = norm(article[section])
        for block, kind, term, level, scope, how, parts, pattern in terms:
            if text and scope in ("any", section) and pattern.search(text):
                found.add((block, kind, term, level, section, how, parts))
    return found


def highlighted(text, section, rows):
    spans = set()
    for _, _, term, _, scope, is_regex in rows:
        if scope not in ("any", section):
            continue
        patterns = [term] if is_regex == "1" else [literal(term)]
        if is_regex != "1" and norm(term) != term:
            patterns.append(literal(norm(term)))
        for p in patterns:
            spans |= {m.span() for m in re.finditer(p, text, re.I) if m.end() > m.start()}
    merged = []
    for begin, stop in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([begin, stop])
    for begin, stop in reversed(merged):
        text = f"{text[:begin]}***{text[begin:stop].upper()}***{text[stop:]}"
    return text
