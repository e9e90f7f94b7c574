"""Query tokenizers (driver and column forms), stems and small string functions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that search terms drop.
STOP_WORDS = frozenset(
    """the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would
    could should may might can shall not no all each every how what where when who which why i me my we our you your he
    she they show give tell been done made used using work works found also into then than just more some such over only
    out its so up as if look need needs want happen happens affect affected break breaks failing implemented implement
    code file files function method class type fix bug called""".split()
)
# Words that are no symbol names.
COMMON_WORDS = frozenset(
    """the and for with from this that have been will would could should does done make made use used using work works
    find found show call called calling get set add all any how what when where which who why not but are was were has
    had its can did may also into than then them each other some such only same about after before between through
    during without again further once here there both just more most very being having doing system need needs want
    wants like look change changes changed changing layer handle handles handling incoming outgoing data flow flows
    level levels request requests response responses implement implements implementation interface interfaces class
    classes method methods trigger triggers affected affect affects else code failing failed silently decide decides
    return returns returned take takes taken check checks checked create creates created read reads write writes
    written start starts stop stops run runs running""".split()
)
# Shapes of identifiers, without word boundaries.
COMPOUND = r"(?:[a-zA-Z][a-zA-Z0-9]*(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]*)+)"
SNAKE = r"[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+"
CAMEL = r"(?:[A-Z][a-z]+(?:[A-Z][a-z]*)*|[a-z]+(?:[A-Z][a-z]*)+)"
SCREAMING = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"
ACRONYM = r"[A-Z]{2,}"
DOTTED = r"[a-zA-Z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)+"
LOWER = r"[a-z][a-z0-9]{2,}"


def _whole(pattern: str) -> str:
    """Between ASCII word boundaries; every pattern starts and ends with a word character."""
    return rf"(?<![A-Za-z0-9_])({pattern})(?![A-Za-z0-9_])"


def _first_seen(items) -> list[str]:
    return list(dict.fromkeys(items))


def symbol_tokens(query: str) -> list[str]:
    """Identifiers that a query may name, in order of the shapes, without common words."""
    found: list[str] = []
    for shape in (CAMEL, SNAKE, SCREAMING, ACRONYM):
        found += re.findall(_whole(shape), query)
    for dotted in re.findall(_whole(DOTTED), query):
        found += [dotted, *(p for p in dotted.split(".") if len(p) >= 2)]
    found += re.findall(_whole(LOWER), query)
    return [s for s in _first_seen(found) if s.lower() not in COMMON_WORDS]


def search_terms(query: str) -> list[str]:
    """Lower-cased compounds, then their parts, at least three bytes, without stop words."""
    whole = [m.lower() for shape in (COMPOUND, SNAKE) for m in re.findall(_whole(shape), query)]
    split = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", query))
    parts = [w.lower() for w in re.split(r"[^a-zA-Z0-9]+", split) if w]
    return _first_seen([w for w in whole if len(w) >= 3] + [w for w in parts if len(w) >= 3 and w not in STOP_WORDS])


def symbol_tokens_column(text: Column) -> Column:
    """symbol_tokens for a column of texts."""
    every = lambda shape: F.regexp_extract_all(text, F.lit(_whole(shape)), 1)
    dotted = every(DOTTED)
    parts = F.filter(F.flatten(F.transform(dotted, lambda d: F.concat(F.array(d), F.split(d, r"\.")))), lambda p: F.length(p) >= 2)
    found = F.concat(*[every(s) for s in (CAMEL, SNAKE, SCREAMING, ACRONYM)], parts, every(LOWER))
    return F.filter(F.array_distinct(found), lambda t: ~F.lower(t).isin(sorted(COMMON_WORDS)))  # a hash set


def search_terms_column(text: Column) -> Column:
    """search_terms for a column of texts."""
    every = lambda shape: F.transform(F.regexp_extract_all(text, F.lit(_whole(shape)), 1), F.lower)
    split = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.transform(F.regexp_extract_all(split, F.lit("[a-zA-Z0-9]+"), 0), F.lower)
    parts = F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(sorted(STOP_WORDS)))
    return F.array_distinct(F.concat(F.filter(F.concat(every(COMPOUND), every(SNAKE)), lambda w: F.length(w) >= 3), parts))


def titlecase(s: str) -> str:
    return s[:1].upper() + s[1:]


def titlecase_column(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def stem(term: str) -> str:
    t = term.lower()
    n = len(t.encode())
    if t.endswith("ies") and n > 4:
        return t[:-3] + "y"
    if t.endswith("es") and n > 4:
        return t[:-2]
    if t.endswith("ing") and n > 5:
        return t[:-3]
    if t.endswith("ed") and n > 4:
        return t[:-2]
    if t.endswith("s") and not t.endswith("ss") and n > 3:
        return t[:-1]
    return t


def stem_column(term: Column) -> Column:
    t = F.lower(term)
    n = F.octet_length(t)
    cut = lambda k: F.substring(t, F.lit(1), F.length(t) - k)
    ends = lambda s: F.endswith(t, F.lit(s))
    return (
        F.when(ends("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(ends("es") & (n > 4), cut(2))
        .when(ends("ing") & (n > 5), cut(3))
        .when(ends("ed") & (n > 4), cut(2))
        .when(ends("s") & ~ends("ss") & (n > 3), cut(1))
        .otherwise(t)
    )


def stem_groups(terms: list[str]) -> list[list[str]]:
    groups: dict[str, list[str]] = {}
    for t in terms:
        if t:
            groups.setdefault(stem(t), []).append(t)
    return list(groups.values())


def is_distinctive(name: Column) -> Column:
    """Six or more characters with an underscore or an inner capital."""
    return (F.char_length(name) >= 6) & (F.contains(name, F.lit("_")) | name.rlike("(?s)^.+[A-Z]"))


def round9(x: Column) -> Column:
    """Half up at nine places, for values that are not negative."""
    return F.floor(x * 1e9 + 0.5) / 1e9


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cc}", "")


def pluralise(n: int, one: str, many: str | None = None) -> str:
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def any_contains(columns: list[Column], term: str) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(c, F.lit(term))
    return hit


def term_hits(columns: list[Column], terms: list[str]) -> Column:
    """How many of the terms some column contains."""
    total = F.lit(0)
    for t in terms:
        if t:
            total = total + any_contains(columns, t).cast("int")
    return total
