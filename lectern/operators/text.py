"""String normalisers, keys, tokenisers and parsers.

Built-in functions wherever they can express the rule; Arrow-batched functions only for Unicode normalisation, nested markup
and other recursive rules.
"""
from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

HANGUL = "[가-힣]"
#: Suffixes that end an institution's name, remainders that name no department, markers of a company.
INSTITUTION_SUFFIXES = ("대학교병원", "대학교", "대학병원", "대학", "연구원", "연구소", "병원", "학회", "재단", "공사", "공단", "센터", "진흥원", "진흥청", "과학원", "기술원",
                        "연구회", "협회", "주식회사", "농업기술원", "보건환경연구원", "사업단", "연구단", "박물관", "과학관")
NOT_A_DEPARTMENT = ("대학원", "일반대학원", "산업대학원", "특수대학원", "전문대학원", "University", "College", "Graduate School", "대학", "학과", "과")
NATIONAL = ("국립", "농촌진흥청")
#: Markers of a company or other body, which name no institution.
COMPANY = r"\((?:주|재|사|유|합|학)\)|㈜|㈔|㈐|주식회사|재단법인|사단법인|유한회사"
#: Agencies that are written without a space before their unit.
JOINED_AGENCIES = ("농촌진흥청", "국립농촌진흥청", "산림청")
#: Words and tails of a query that say nothing of its topic.
QUERY_TAILS = ("관련", "관한", "대한")
QUERY_NOISE = ("논문", "연구", "자료", "문헌")
#: Characters that have a raised or lowered form.
RAISED = dict(zip("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ"))
LOWERED = dict(zip("0123456789+-=()aeox", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓ"))
#: Tails that mark a sentence, the longest keyword.
SENTENCE_TAILS = ("하였다", "되었다", "있다", "한다", "이다", "였다", "합니다")
KEYWORD_MAX = 60
#: Separators of terms in a keyword field.
SEPARATORS = r"\s+[.·|]\s+|\s*/\s+|\s+/\s*|;\s*|,\s+"


def arrow(kind: str):
    """An Arrow-batched function made when it is first used in a query: workers import this module without a session."""

    def wrap(f):
        return lambda *cols: pandas_udf(f, kind)(*cols)

    return wrap


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[ \\n\\t\\r]+"), "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[ \n\t\r]+"), lambda x: F.trim(x)), lambda x: x != "")


def bm25_text(title: Column, abstract: Column, keywords: Column) -> Column:
    """The title counts twice."""
    return tokens(F.concat_ws(" ", title, title, abstract, keywords))


# Terms and keys


def clean_term_py(value) -> str | None:
    if value is None:
        return None
    out = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(str(value)))).strip(" ;,.")
    return out or None


@arrow("string")
def clean_term(s: pd.Series) -> pd.Series:
    return s.map(clean_term_py)


@arrow("string")
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def folded(c: Column) -> Column:
    """NFKC and casefold: plain lower() where the text is ASCII, the Arrow function only elsewhere."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).otherwise(nfkc_casefold(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)))


_ASCII = r"^[\x00-\x7F]*$"


@arrow("string")
def nfkc_lower(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).lower())


@arrow("array<string>")
def nfkc_lower_each(s: pd.Series) -> pd.Series:
    return s.map(lambda vs: None if vs is None else [None if v is None else unicodedata.normalize("NFKC", v).lower() for v in vs])


def lowered(c: Column) -> Column:
    """NFKC and lower case, by the Arrow function only where the text is not ASCII."""
    return F.when(c.rlike(_ASCII), F.lower(c)).otherwise(nfkc_lower(F.when(~c.rlike(_ASCII), c)))


def lowered_each(c: Column) -> Column:
    plain = F.forall(c, lambda x: F.coalesce(x, F.lit("")).rlike(_ASCII))
    return F.when(plain, F.transform(c, F.lower)).otherwise(nfkc_lower_each(F.when(~plain, c)))


def words_casefold_py(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).split()).casefold()


@arrow("string")
def nfkc_words_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else words_casefold_py(v))


def keyword_key(name: Column, lang: Column) -> Column:
    """`lang:name` with the name's width, white space and case made one; NFKC comes first, since it makes plain spaces of wide ones."""
    plain = F.lower(F.trim(F.regexp_replace(name, r"[\x09-\x0D\x1C-\x20]+", " ")))
    return F.concat(lang, F.lit(":"), F.when(name.rlike(_ASCII), plain).otherwise(nfkc_words_casefold(F.when(~name.rlike(_ASCII), name))))


def display_key(name: Column) -> Column:
    """What makes two spellings of a keyword one: case, white space and width do not count."""
    return F.regexp_replace(lowered(name), r"(?U)\s+", "")


def split_terms_py(value) -> list[str]:
    return [c for x in re.split(SEPARATORS, clean_term_py(value) or "") if (c := clean_term_py(x))]


@arrow("array<string>")
def split_terms(s: pd.Series) -> pd.Series:
    """Terms of a keyword field at its plain separators, each cleaned."""
    return s.map(split_terms_py)


#: A token is neutral if its letters and digits are few, an acronym, a number with a unit, or a formula.
NEUTRAL = (r"^.{0,3}$", r"^(?=.*[A-Z])[A-Z0-9]{1,8}$", r"^[0-9]+[A-Za-z]+$", r"^([A-Z][a-z]?[0-9]*){1,4}$")


def token_language(t: Column) -> Column:
    """ko, en, or neutral for short codes, acronyms and formulas."""
    body = F.regexp_replace(t, "[^A-Za-z0-9]", "")
    neutral = body.rlike("|".join(NEUTRAL))
    return F.when(t.rlike(HANGUL), "ko").when(t.rlike("[A-Za-z]"), F.when(neutral, "neutral").otherwise("en")).otherwise("neutral")


def _kind(token: str) -> str:
    if re.search(HANGUL, token):
        return "ko"
    latin = re.search("[A-Za-z]", token)
    return "en" if latin and not re.search("|".join(NEUTRAL), re.sub("[^A-Za-z0-9]", "", token)) else "neutral"


def language_runs_py(value: str) -> tuple[list[str], list[str]]:
    """Runs of one language; neutral tokens stay with the run before, or go to the first one."""
    out: dict[str, list[str]] = {"ko": [], "en": []}
    run: list[str] = []
    lang = None
    for token in value.split():
        kind = _kind(token)
        if kind not in ("neutral", lang) and lang is not None:
            out[lang].append(" ".join(run))
            run = []
        if kind != "neutral":
            lang = kind
        run.append(token)
    if lang is None:
        lang = "ko" if re.search(HANGUL, value) else "en"
    if run:
        out[lang].append(" ".join(run))
    return out["ko"], out["en"]


def by_language_py(value) -> tuple[list[str], list[str]]:
    """Terms of a keyword field by language: separators, then brackets by script, then runs."""
    ko: list[str] = []
    en: list[str] = []

    def put(term: str) -> None:
        h, lat = bool(re.search(HANGUL, term)), bool(re.search("[A-Za-z]", term))
        if h and lat:
            k, e = language_runs_py(term)
            ko.extend(k)
            en.extend(e)
        elif h:
            ko.append(term)
        elif lat:
            en.append(term)

    for raw in re.split(SEPARATORS, clean_term_py(value) or ""):
        term = clean_term_py(raw)
        if not term:
            continue
        if re.search(HANGUL, term) and re.search("[A-Za-z]", term):
            inner = [clean_term_py(a or b) for a, b in re.findall(r"\(([^()]*)\)|\[([^\[\]]*)\]", term)]
            for x in inner:
                if x:
                    put(x)
            term = clean_term_py(re.sub(r"\(([^()]*)\)|\[([^\[\]]*)\]", lambda m: " " if re.search(f"{HANGUL}|[A-Za-z]", m.group()) else m.group(), term))
            if not term:
                continue
        put(term)

    def once(terms: list[str], lower: bool) -> list[str]:
        seen: dict[str, str] = {}
        for t in terms:
            seen.setdefault(t.casefold(), t.casefold() if lower else t)
        return list(seen.values())

    return once([c for x in ko if (c := clean_term_py(x))], False), once([c for x in en if (c := clean_term_py(x))], True)


@arrow("struct<ko:array<string>,en:array<string>>")
def keywords_by_language(s: pd.Series) -> pd.DataFrame:
    rows = [by_language_py(v) for v in s]
    return pd.DataFrame({"ko": [r[0] for r in rows], "en": [r[1] for r in rows]})


def paper_keywords_py(first, second) -> tuple[list[str], list[str] | None, bool]:
    ko: dict[str, str] = {}
    en: dict[str, str] = {}
    for field in (first, second):
        for value in field if field is not None else ():
            k, e = by_language_py(value)
            for t in k:
                ko.setdefault(t.casefold(), t)
            for t in e:
                en.setdefault(t, t)
    now = list(ko.values()), list(en.values()) or None
    was = tuple(None if f is None else list(f) for f in (first, second))
    return *now, now != was


@arrow("struct<ko:array<string>,en:array<string>,changed:boolean>")
def paper_keywords(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """Both keyword fields of a paper (arrays; null: none) by language, each term once by case, English in lower case (null where there is
    none), and whether that differs from what was there."""
    return pd.DataFrame([paper_keywords_py(a, b) for a, b in zip(first, second)], columns=["ko", "en", "changed"])


@arrow("struct<ko:array<string>,en:array<string>>")
def language_runs(s: pd.Series) -> pd.DataFrame:
    rows = [language_runs_py(v or "") if v else ([], []) for v in s]
    return pd.DataFrame({"ko": [r[0] for r in rows], "en": [r[1] for r in rows]})


@arrow("array<string>")
def bracketed(s: pd.Series) -> pd.Series:
    return s.map(lambda v: [c for a, b in re.findall(r"\(([^()]*)\)|\[([^\[\]]*)\]", v or "") if (c := clean_term_py(a or b))])


def clean_keyword(raw: Column) -> Column:
    """NULL for what cannot be a keyword: too long, without letters or digits, or a sentence."""
    v = F.trim(F.regexp_replace(F.trim(raw), "^[.,;·]+|[.,;·]+$", ""))
    ok = (F.length(v) > 0) & (F.length(v) <= KEYWORD_MAX) & v.rlike("[0-9A-Za-z가-힣]") & ~F.concat(v, F.lit(" ")).rlike("(" + "|".join(SENTENCE_TAILS) + ")[. \\t\\n]")
    return F.when(ok, v)


def person_name(c: Column, organisation: str) -> Column:
    return c.rlike("^[가-힣]{2,6}$") & ~c.rlike(organisation)


# Titles, identifiers


def title_keys(t: Column) -> Column:
    """Four rules that must not be mixed: case and ends; white space; letters and digits only; white space collapsed."""
    low = F.lower(t)
    return F.struct(F.trim(low).alias("plain"), F.regexp_replace(low, "[ \\t\\n\\r]+", "").alias("tight"), F.regexp_replace(low, "[^0-9a-z가-힣]", "").alias("bare"), F.trim(F.regexp_replace(low, "[ \\t\\n\\r]+", " ")).alias("spaced"))


def title_ratio(a: str | None, b: str | None) -> float:
    """Matching-blocks ratio of the titles' letters and digits."""
    x, y = (re.sub("[^0-9a-z가-힣]", "", (t or "").lower()) for t in (a, b))
    return difflib.SequenceMatcher(None, x, y).ratio()


@arrow("double")
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([title_ratio(x, y) for x, y in zip(a, b)])


def may_be_similar(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths of two titles' letters and digits allow a ratio of `least`."""
    n = lambda c: F.length(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z가-힣]", ""))
    return 2.0 * F.least(n(a), n(b)) >= least * (n(a) + n(b))


def title_similarity_from(least: float):
    """title_similarity where it reaches `least`, else NULL: what two titles have of each character bounds their matching blocks."""

    @arrow("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        def of(x, y):
            x, y = (re.sub("[^0-9a-z가-힣]", "", (t or "").lower()) for t in (x, y))
            m = difflib.SequenceMatcher(None, x, y)
            return m.ratio() if m.quick_ratio() >= least and m.ratio() >= least else None

        return pd.Series([of(x, y) for x, y in zip(a, b)], dtype="float64")

    return similarity


def issn(raw: Column) -> Column:
    b = F.upper(F.regexp_replace(raw, "[^0-9Xx]", ""))
    return F.when(b.rlike("^[0-9]{7}[0-9X]$"), F.concat_ws("-", F.substring(b, 1, 4), F.substring(b, 5, 4)))


def bare_doi(doi: Column) -> Column:
    return F.regexp_replace(F.trim(doi), r"(?i)^https?://(dx\.)?doi\.org/", "")


def first_year(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, "(1[89][0-9]{2}|20[0-9]{2})", 1), F.lit("")).try_cast("int")


def parsed_fields(kw: Column, kw2: Column, doi: Column, year: Column, abstract: Column) -> Column:
    parts = lambda c, sep: F.array_join(F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != ""), "|")
    return F.struct(F.when(kw.contains(";"), parts(kw, ";")).otherwise(parts(kw, "[.]")).alias("keywords"), parts(kw2, "[.]").alias("keywords2"), F.when(doi.rlike("^https?://"), doi).alias("doi"),
                    year.try_cast("int").alias("year"), F.trim(F.regexp_replace(abstract, "[ \\n\\t\\r]+", " ")).alias("abstract"))


_WORD = r"[\p{L}\p{N}_]"


def query_key(terms: Column) -> Column:
    """A cache key of a query's keywords: NFKC, lower case, without tails and noise words and marks; sorted, each once."""

    def norm(t: Column) -> Column:
        t = F.regexp_replace(F.trim(t), "(" + "|".join(QUERY_TAILS) + r")(?U:\s*)", " ")
        t = F.regexp_replace(t, f"(?<!{_WORD})(" + "|".join(QUERY_NOISE) + f")(?!{_WORD})", " ")
        t = F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s-]", " ")
        return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))

    keys = F.transform(F.filter(lowered_each(terms), lambda x: x.isNotNull()), norm)
    return F.substring(F.array_join(F.array_sort(F.array_distinct(F.filter(keys, lambda x: x != ""))), "|"), 1, 500)


def short_query(q: Column) -> Column:
    """A single sentence of up to 24 characters."""
    t = F.trim(q)
    return (F.length(t) > 0) & (F.length(t) <= 24) & ~t.rlike("[.!?].") & ~t.contains("\n")


def from_inverted(index: Column) -> Column:
    """Text from a map of word to places."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " ")


# Institutions


def institution_root(raw: Column) -> Column:
    """Up to the suffix that starts first (the longest one there); without one the whole (not Korean) or the first word.

    The name and its best suffix are bound once, so that expressions made of several roots stay small."""

    def ended(first: Column) -> Column:
        ends = [F.when(F.instr(first, s) > 0, F.struct(F.instr(first, s).alias("start"), F.lit(-len(s)).alias("neg"))) for s in INSTITUTION_SUFFIXES]
        return F.struct(first.alias("first"), F.array_min(F.array_compact(F.array(*ends))).alias("best"))

    def root(x: Column) -> Column:
        first, best = x["first"], x["best"]
        upto = F.trim(first.substr(F.lit(1), best["start"] - 1 - best["neg"]))
        return F.when(F.coalesce(first, F.lit("")) == "", None).when(best.isNotNull(), upto).when(~first.rlike(HANGUL), first).otherwise(F.get(F.split(first, "[ ]+"), 0))

    return F.get(F.transform(F.transform(F.array(F.trim(F.get(F.split(raw, "[,/]"), 0))), ended), root), 0)


def institution_dept(raw: Column) -> Column:
    first, root = F.trim(F.get(F.split(raw, "[,/]"), 0)), institution_root(raw)
    rest = F.trim(F.when(first.startswith(root), first.substr(F.length(root) + 1, F.lit(1000))).otherwise(F.replace(first, root, F.lit(""))))
    return F.when((rest != "") & ~rest.isin(*NOT_A_DEPARTMENT), rest)


def same_institution(a: Column, b: Column) -> Column:
    """One name starts at a word boundary of the other; company markers and national prefixes do not count."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), COMPANY, " "))
    tight = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    x, y = tight(clean(a)), tight(clean(b))

    def within(name: Column, other: Column) -> Column:
        words = F.array_remove(F.split(clean(other), r"[\s,/·()]+"), "")
        tails = F.transform(words, lambda w, i: tight(F.array_join(F.slice(words, i + 1, F.size(words)), "")))
        stem = F.regexp_replace(name, f"^{NATIONAL[0]}", "")
        return F.exists(tails, lambda t: t.startswith(stem) | F.regexp_replace(t, "^(" + "|".join(NATIONAL) + ")", "").startswith(stem))

    return (x != "") & (y != "") & ((x == y) | within(x, b) | within(y, a))


#: Words that mark an organisation, strong ones first.
ORG_STRONG = r"(?i)\b(University|Univ\.|Institute|Hospital|Agency|Administration|Corporation|Inc\.?|Ltd\.?|Co\.|LLC|Company|Services)"
ORG_WEAK = r"(?i)\b(College|School|Center|Centre|Academy|Laboratory)\b"


def polished_institution(raw: Column) -> Column:
    """The organisation's part of a romanised address."""
    v = F.trim(raw)
    seg = F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")
    usable = lambda p: F.get(F.filter(seg, lambda x: ~x.rlike("[0-9]{4,}") & x.rlike(p)), 0)
    chosen = F.coalesce(usable(ORG_STRONG), usable(ORG_WEAK), F.get(seg, 0))
    after = F.get(seg, F.array_position(seg, chosen).cast("int"))
    chosen = F.when(after.rlike(r"(?i)^(Ltd\.?|Inc\.?|LLC|Co\.)$"), F.concat_ws(", ", chosen, after)).otherwise(chosen)
    return F.when(v.rlike(HANGUL) | ~v.contains(","), F.nullif(v, F.lit(""))).otherwise(chosen)


def _under_agency(raw: Column) -> Column:
    """What follows a ministry or agency at the start of a name; NULL where none stands there."""
    t = F.trim(raw)
    spaced = F.regexp_extract(t, r"^[가-힣]+(?:청|부|처)\s+(\S.*)$", 1)
    joined = F.regexp_extract(t, "^(?:" + "|".join(JOINED_AGENCIES) + r")(\S.*)$", 1)
    return F.coalesce(F.nullif(spaced, F.lit("")), F.nullif(joined, F.lit("")))


def institution_units(raw: Column) -> Column:
    """The root, and under a ministry or agency the unit's own root."""
    return F.array_distinct(F.array_compact(F.array(institution_root(raw), institution_root(_under_agency(raw)))))


def specific_unit(raw: Column) -> Column:
    """The unit that an affiliation names; NULL where it names only a ministry or agency, as the unit could be any of theirs."""
    bare = F.trim(F.regexp_replace(raw, COMPANY, " "))
    units = institution_units(bare)
    return F.when(_under_agency(bare).isNotNull(), F.when(F.size(units) > 1, F.element_at(units, -1))).when(
        F.size(units) > 0, F.when(~F.get(units, 0).rlike("^[가-힣]+(청|부|처)$"), F.get(units, 0)))


#: Fixed value: the role of a thesis's author.
SOLE_AUTHOR = "단독"
#: What says whether someone studies or works there.
ROLE_SUFFIXES = ("석박사통합과정생?", "석사과정생?", "박사과정생?", "박사후연구원", "대학원생", "학부생", "연구교수", "조교수", "부교수", "교수", "책임연구원", "선임연구원", "연구원", "연구위원", "교사", "학생")


def department_from(raw: Column) -> Column:
    """The department of an affiliation: what is left of it without the root, the unit that it names and the role at its end.

    Department and unit are long expressions, so each is bound once, as a field of the only element of an array."""
    tight = lambda c: F.regexp_replace(c, r"\s+", "")

    def without_unit(x: Column) -> Column:
        dept, unit = x["dept"], x["unit"]
        rest = F.when(dept.startswith(unit), F.trim(dept.substr(F.length(unit) + 1, F.lit(1 << 30)))).otherwise(dept)
        return F.struct(F.trim(F.regexp_replace(rest, r"\s*(" + "|".join(ROLE_SUFFIXES) + r")\s*$", "")).alias("rest"), unit.alias("unit"))

    both = F.array(F.struct(institution_dept(raw).alias("dept"), specific_unit(raw).alias("unit")))
    kept = lambda x: F.when((x["rest"] != "") & ~F.coalesce(tight(x["rest"]) == tight(x["unit"]), F.lit(False)), x["rest"])
    return F.get(F.transform(F.transform(both, without_unit), kept), 0)


# Markup, markers


#: The tags that are known.
_KNOWN = "TEX|SUP|SUB|B|I|P"
#: A pair of known tags with no known tag inside.
_INNERMOST = re.compile(rf"<({_KNOWN})\b[^>]*>((?:(?!</?(?:{_KNOWN})\b).)*)</\1>", re.I | re.S)
_UNPAIRED = re.compile(rf"</?({_KNOWN})\b[^>]*>", re.I)
_AROUND = {"b": ("**", "**"), "i": ("*", "*"), "p": ("", "\n\n")}


def _rendered(m: re.Match) -> str:
    kind, body = m[1].lower(), m[2]
    forms = {"sup": RAISED, "sub": LOWERED}.get(kind, {})
    if forms and set(body) <= set(forms):
        return body.translate(str.maketrans(forms))
    before, after = _AROUND.get(kind, ("", ""))
    return before + body + after


def repaired_py(value: str | None) -> str | None:
    """Entities (escaped twice, too) and known tags become plain text, from the innermost pair outwards; other tags stay."""
    if not value:
        return value
    text, n = html.unescape(html.unescape(value)), 1
    while n:
        text, n = _INNERMOST.subn(_rendered, text)
    text = _UNPAIRED.sub(lambda m: "\n\n" if m[1] in "pP" else "", text)
    lines = [re.sub("[ \t]+", " ", line).strip(" ") for line in re.split("\r\n|\r|\n", text)]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip() or None


@arrow("string")
def repaired(s: pd.Series) -> pd.Series:
    return s.map(repaired_py)


def markers(raw: Column, longest: int = 40) -> Column:
    """struct text, start, end: text without `**` and the place of the first marked phrase; none if unpaired, too long or all of the text."""
    raw = F.coalesce(raw, F.lit(""))
    plain = F.replace(raw, F.lit("**"), F.lit(""))
    body, phrase = F.trim(plain), F.regexp_extract(raw, r"(?s)\*\*(.+?)\*\*", 1)
    start = F.instr(raw, "**") - 1 - (F.length(plain) - F.length(F.ltrim(plain)))
    end = start + F.length(phrase)
    held = body.substr(F.greatest(start + 1, F.lit(1)), F.length(phrase)) == phrase
    ok = (phrase != "") & (start >= 0) & (end <= F.length(body)) & held & (F.length(phrase) <= longest) & ~((start == 0) & (end == F.length(body)))
    return F.struct(body.alias("text"), F.when(ok, start).alias("start"), F.when(ok, end).alias("end"))


def assembled(sents: Column, hard: int = 220, most: int = 200) -> Column:
    """All sentences if they fit, else the longest run of whole first sentences within `most` characters; struct text, complete."""
    every = F.array_join(sents, " ")
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(a, s):
        longer = F.when(a["text"] == "", s).otherwise(F.concat_ws(" ", a["text"], s))
        over = a["full"] | (F.length(longer) > most)
        return F.struct(F.when(over, a["text"]).otherwise(longer).alias("text"), over.alias("full"))

    part = F.aggregate(sents, start, step)
    return F.when(F.length(every) <= hard, F.struct(every.alias("text"), F.lit(True).alias("complete"))).otherwise(
        F.struct(F.when(part["text"] == "", every).otherwise(part["text"]).alias("text"), F.lit(False).alias("complete")))


def reason(sents: Column, hard: int = 220, most: int = 200, longest: int = 40) -> Column:
    """struct text, start, end, complete of sentences with `**` around phrases: all of them up to `hard` characters, else the whole first ones
    within `most`; where the first alone is longer, all of them, not complete. Markers do not count, and go (see `markers`)."""
    size = lambda c: F.length(F.trim(F.replace(c, F.lit("**"), F.lit(""))))
    every = F.array_join(sents, " ")
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(a, s):
        longer = F.when(a["text"] == "", s).otherwise(F.concat_ws(" ", a["text"], s))
        over = a["full"] | (size(longer) > most)
        return F.struct(F.when(over, a["text"]).otherwise(longer).alias("text"), over.alias("full"))

    fits, part = size(every) <= hard, F.aggregate(sents, start, step)["text"]
    m = markers(F.when(fits | (part == ""), every).otherwise(part), longest)
    return F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), fits.alias("complete"))


def best_reasons(candidates: DataFrame, policy: str = "center", low: int = 150, most: int = 200) -> DataFrame:
    """The best candidate (rows id, at, text, complete and any more) of each id; what is complete comes first, the earliest wins a tie.

    `center`: the one nearest to the middle of `low` and `most` characters. `under_max`: the longest of those within `most`, or the shortest
    where none is. Candidates without text do not count; an id with no other has no row."""
    n, cut = F.length("text"), ~F.col("complete")
    if policy == "center":
        key = F.struct(cut, F.abs(n - (low + most) // 2), "at")
    elif policy == "under_max":
        key = F.struct(n > most, cut, F.when(n <= most, -n).otherwise(n), "at")
    else:
        raise ValueError(f"policy {policy} is not known")
    rest = [c for c in candidates.columns if c != "id"]
    return candidates.where("text <> ''").groupBy("id").agg(F.min_by(F.struct(*rest), key).alias("best")).select("id", *[F.col("best")[c].alias(c) for c in rest])


def noun_tokens(text: Column, stop: tuple = ("the", "and", "of"), least: int = 2) -> Column:
    """Fallback where no morphological analyser is given: letter tokens, stop-words out, longest first."""
    t = F.filter(F.transform(tokens(text), lambda x: F.regexp_replace(x, "[^0-9a-z가-힣]", "")), lambda x: (F.length(x) >= least) & ~x.isin(*stop))
    return F.transform(F.array_sort(F.transform(F.array_distinct(t), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), lambda s: s["w"])


#: Words of a query that are no topic.
SEARCH_STOP = ("연구", "논문", "관련", "분야", "자료", "내용", "결과", "최근", "요즘", "추천", "정보", "주제", "검색", "문헌", "학술", "저널")


def plain_nouns(text: str) -> list[tuple[str, int]]:
    """Where no morphological analyser is given: runs of letters of one script, and of digits, count as nouns."""
    return [(m.group(), m.start()) for m in re.finditer("[가-힣]+|[A-Za-z]+|[0-9]+", text)]


def topic_nouns(tokenize=plain_nouns, stop: tuple = SEARCH_STOP):
    """An Arrow function from a text to its topic candidates, longest first, then by first place.

    tokenize: from a text to its nouns with their places; it runs in the workers. Nouns that touch in the text are
    joined to a compound as well, unless one of them is a stop-word."""

    @arrow("array<string>")
    def found(s: pd.Series) -> pd.Series:
        def of(text):
            runs, at = [], {}
            for word, start in tokenize(text or ""):
                if not runs or runs[-1][-1][1] + len(runs[-1][-1][0]) != start:
                    runs.append([])
                runs[-1].append((word, start))
            for run in runs:
                for word, start in run:
                    if len(word) > 1 and word not in stop:
                        at.setdefault(word, start)
                if len(run) > 1 and not {w for w, _ in run} & {*stop}:
                    at.setdefault("".join(w for w, _ in run), run[0][1])
            return sorted(at, key=lambda w: (-len(w), at[w]))

        return s.map(of)

    return found


# Arrays and JSON


def name_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s·,.\-]", ""))


def _name_keys(names: Column) -> Column:
    """name_key of each, by NFKC."""
    return F.transform(lowered_each(names), name_key)


def author_place(name: Column, root: Column, names: Column, insts: Column, second: Column | None = None) -> Column:
    """Place (from 0) of the one author of that name, of several the one whose institution holds the root; else NULL.

    second: the name to look for where the first is blank or stands nowhere."""
    both = F.struct(_name_keys(names).alias("keys"), _name_keys(F.array(name, F.lit(None).cast("string") if second is None else second)).alias("wanted"))

    def of(v: Column) -> Column:
        def place(key: Column) -> tuple[Column, Column]:
            hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(names), F.lit(1)) - 1), lambda i: F.get(v["keys"], i) == key)
            near = F.filter(hits, lambda i: F.contains(F.coalesce(F.get(insts, i), F.lit("")), F.coalesce(root, F.lit("\u0000"))))
            some = (F.coalesce(key, F.lit("")) != "") & (F.size(hits) > 0)
            return some, F.when(F.size(hits) == 1, F.get(hits, 0)).when(F.size(near) == 1, F.get(near, 0))

        (some, at), (more, other) = place(F.get(v["wanted"], 0)), place(F.get(v["wanted"], 1))
        return F.when(some, at).when(more, other)

    # The keys are computed outside of the functions on arrays, which hold no Arrow function.
    return F.get(F.transform(F.array(both), of), 0)


#: An author's part in a paper, as the registry writes it.
PART_FIRST, PART_CORRESPONDING, PART_PARTICIPANT = ("제1", "단독"), "교신", "참여"


def author_roles(division: Column, part: Column, parts: Column) -> Column:
    n = F.size(F.filter(parts, lambda p: p == PART_CORRESPONDING))
    first = F.coalesce((division == "1") | part.isin(*PART_FIRST), F.lit(False))
    corr = F.coalesce(part == PART_CORRESPONDING, F.lit(False))
    other = ~first & ~corr & (F.coalesce(part == PART_PARTICIPANT, F.lit(False)) | (n > 0))
    return F.array_compact(F.array(F.when(first, "first"), F.when(corr, F.when(n > 1, "co_corresponding").otherwise("corresponding")), F.when(other, "participant")))


def in_range(values: Column, count: Column) -> Column:
    return F.filter(values, lambda x: (x >= 1) & (x <= count))


def valid_numbers(values: Column, count: Column) -> Column:
    """1-based numbers in range, each once, in order."""
    return F.array_distinct(in_range(values, count))


def _list_place(value: Column, count: Column) -> Column:
    """The place (from 0) that the first number in a string names in a list of `count`; NULL outside."""
    n = F.regexp_extract(value, "[0-9]+", 0).try_cast("int") - 1
    return F.when((n >= 0) & (n < count), n)


def list_places(values: Column, count: Column) -> Column:
    """Places (from 0) that strings name in a list of `count`, each once, in order."""
    return F.array_distinct(F.array_compact(F.transform(values, lambda v: _list_place(v, count))))


def one_to_one(pairs: Column, n_left: Column, n_right: Column) -> Column:
    """Pairs of places from pairs of strings (arrays): those in range; of pairs that share a side only the first counts."""
    start = F.struct(F.array().cast("array<int>").alias("l"), F.array().cast("array<int>").alias("r"))

    def step(a, p):
        i, j = _list_place(F.get(p, 0), n_left), _list_place(F.get(p, 1), n_right)
        ok = (F.size(p) == 2) & i.isNotNull() & j.isNotNull() & ~F.array_contains(a["l"], F.coalesce(i, F.lit(-1))) & ~F.array_contains(a["r"], F.coalesce(j, F.lit(-1)))
        return F.when(ok, F.struct(F.concat(a["l"], F.array(i)).alias("l"), F.concat(a["r"], F.array(j)).alias("r"))).otherwise(a)

    return F.aggregate(pairs, start, step, lambda a: F.arrays_zip(a["l"].alias("left"), a["r"].alias("right")))


@arrow("string")
def first_json(s: pd.Series) -> pd.Series:
    import json

    def find(v):
        at = (v or "").find("{")
        while at >= 0:
            try:
                return json.dumps(json.JSONDecoder().raw_decode(v[at:])[0], ensure_ascii=False)
            except ValueError:
                at = v.find("{", at + 1)
        return None

    return s.map(find)
