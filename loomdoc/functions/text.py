"""Text correction and small string functions: Column -> Column, nulls stay null. Patterns use explicit ASCII classes, so they read alike in every engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .confusions import CONFUSIONS

S = r"[ \t\n\x0b\f\r]"
#: Characters for one character each, and those for none or several.
ONE_TO_ONE = (
    "\u201c\u201d\u2018\u2019\u2014\u2013\u00a0\u00cd\u00ed\u0146\uf050\uf051\uf052\uf078\uf0a7\uf0b7\uf0d8\uf0e0\uf020\ufffd",
    "\"\"''-- Iin\u2713\u2713\u2713\u2717\u2022\u2022\u27a2\u2709 \u2022",
)
ONE_TO_MANY = [("…", "..."), ("​", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi")]
#: Abbreviations of the domain; the closing dot only counts before a word character.
ABBREVIATIONS = [("U.P.S.C.", "UPSC"), ("I.A.S.", "IAS"), ("I.P.S.", "IPS"), ("I.F.S.", "IFS"), ("C.S.A.T.", "CSAT"), ("N.C.E.R.T.", "NCERT"), ("M.L.A.", "MLA"), ("M.P.", "MP"), ("B.C.E.", "BCE"), ("C.E.", "CE")]
#: Words that recognition splits or runs together.
SPLIT_WORDS = [
    (r"\bV\s+ol\.", "Vol."),
    (r"\bV\s+olume\b", "Volume"),
    (r"\bY\s+ork\b", "York"),
    (r"\bV\s+ernacular", "Vernacular"),
    (r"\bMiddleEastern\b", "Middle Eastern"),
    (r"(?i)\bmiddleeastern\b", "Middle Eastern"),
    (r"\bCentralAsian\b", "Central Asian"),
    (r"\bSouthAsian\b", "South Asian"),
    (r"\bNorthIndia\b", "North India"),
    (r"\bSouthIndia\b", "South India"),
    (r"\bS\s+hah\b", "Shah"),
    (r"\bK\s+han\b", "Khan"),
    (r"\bK\s+hafi\b", "Khafi"),
    (r"\bImreBangha\b", "Imre Bangha"),
    (r"\bPerso\s+-\s+Islamic\b", "Perso-Islamic"),
    (r"\bSabk\s+-\s+i\s+Hindi\b", "Sabk-i Hindi"),
    (r"\bNagari\s+Rekhta\b", "Nagari Rekhta"),
    (r"\bChandarBhan\b", "Chandar Bhan"),
    (r"\bAndhara\s+Pradesh\b", "Andhra Pradesh"),
]
#: Running headers of the domain's booklets, in order of trial.
RUNNING_HEADERS = [
    "Persian Histories and Memoirs",
    "Sources and Literary Traditions",
    "History of India-VII",
    "History of India-VI",
    "History of Modern Europe",
    "History of China",
    "Political Processes",
    "Production and Commercial Practices",
    "State, Society and Religion",
    "Visual Culture",
    "Society and Culture",
    "The 18th Century",
    "Mughal Decline and Disintegration",
    "Sanskrit Kavya Literature, Regional Sources and Travelogues",
    "Indian Ocean Trade Network",
    "Trading Communities and Commercial Practices",
    "Religious Ideas and Movements",
    "Courtly Culture",
    "Women and Gender",
    "Importance and Implications of Biological Variation",
    "Introduction to Biological Diversity",
    "Sources of Genetic Variation",
    "Genetic Polymorphism",
    "Role of Bio-cultural Factors",
    "Ethnic Elements in Indian Population",
    "Classification of Racial Elements in India",
    "Major Races of Mankind",
    "Demographic Anthropology",
    "Indian Demography",
    "Inbreeding and Consanguinity",
    "Biological Diversity in Human Populations",
]
#: Foreign terms that are set in italics.
FOREIGN_TERMS = ["schwerpunkt", "auftragstaktik", "blitzkrieg", "levee en masse", "volk", "volksgemeinschaft", "jihad", "jehad", "ghazi", "Kesselschlacht", "kesselschlacht"]
#: Fixed value: letters that transliteration writes and recognition parts from their word.
DIACRITICS = "ṇṣśñṭḍṛḷṃḥĀāĪīŪūṚṛṜṝḶḷḸḹṂṃḤḥÑñṬṭḌḍṆṇŚśṢṣ"
#: List markers at a line's start.
BULLETS = r"(?m)^[ \t]*(?:[•‣◦⁃▪▫●○’➢▸▹►▻➔→>*]|-{1,2}|–|—)[ \t]+"
#: Openings of questions that carry no content, in order of trial.
QUESTION_OPENINGS = ["what is an", "what is a", "what is", "what are", "explain", "discuss", "define", "describe", "analyze", "meaning of", "about", "write a note on", "write about", "details of", "the", "current status and milestones of", "current status of", "status and milestones of", "status of", "milestones of", "updates on"]
#: Kinds of questions in order of trial: name, words that tell it, length of the answer.
INTENTS = [
    ("differentiate", "diff|difference|differentiate|compare|comparison|versus|vs|distinguish|distinction|tabular|table", 250),
    ("summary", "summar|summary|brief|briefly|short|shortly|gist|nutshell|key points|takeaway|snapshot|overview", 150),
    ("indetail", "in detail|detailed|indetail|critically analyze|critically evaluate|examine|discuss in detail|comprehensive|elaborate|assess|evaluate", 400),
    ("timeline", "timeline|evolution|chronolog|trace the history|historical development|phases of", 300),
    ("explain", "explain|what is|how does|what are|describe|concept of|meaning of|define", 200),
]
DEFAULT_INTENT = ("standard_mains", 250)


def _each(c: Column, rules) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def map_characters(c: Column) -> Column:
    out = F.translate(c, *ONE_TO_ONE)
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), ONE_TO_MANY, out)


def join_hyphens(c: Column) -> Column:
    """Words that a hyphen parts at a line's end."""
    return F.regexp_replace(c, r"(\b[a-zA-Z]{2,})-[ \t\n]*\n[ \t\n]*([a-zA-Z]{2,}\b)", "$1$2")


def shorten_abbreviations(c: Column) -> Column:
    return _each(c, [(r"\b" + a.replace(".", r"\.") + r"\b", b) for a, b in ABBREVIATIONS])


def join_split_words(c: Column) -> Column:
    return _each(c, SPLIT_WORDS)


def normalise_lists(c: Column) -> Column:
    return _each(c, [(BULLETS, "• "), (r"(?m)^[ \t]*([0-9]{1,2})[.)\]:][ \t]+", "$1. ")])


def collapse_repeats(c: Column) -> Column:
    """A word said twice in a row, once; one pass."""
    return F.regexp_replace(c, rf"(?i)\b([a-z]{{3,}}){S}+\1\b", "$1")


def rejoin_diacritics(c: Column) -> Column:
    """Letters with diacritics that recognition parts from their word; the reference's letters, so that a Spanish word with ñ in front joins the one before it too."""
    word, gap = r"([\p{L}\p{N}_])", r"(?U:\s+)"
    return _each(c, [(rf"{word}{gap}([{DIACRITICS}])(?U:\s*){word}", "$1$2$3"), (rf"{word}{gap}([{DIACRITICS}])", "$1$2")])


def squeeze(c: Column) -> Column:
    return _each(c, [(r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")])


def repair_page_ranges(c: Column) -> Column:
    """Page ranges whose first number has three or four digits lose the first."""
    return F.regexp_replace(c, rf"(pp?\.{S}*)[0-9]([0-9]{{2,3}})(-[0-9]{{2,4}})", "$1$2$3")


def repair_urls(c: Column) -> Column:
    r"""Closes all gaps inside URLs: a piece with a dot and letters or a slash belongs to the URL before it, and so on from piece to piece (``\G``: where the last gap ended)."""
    return F.regexp_replace(c, r"(https?://\S*+|\G(?!\A)\S++)\s++(?=\S*(?:\.[a-zA-Z]{2,}|/))", "$1")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c worked out once however often f names it."""
    return F.transform(F.array(c), f)[0]


def repair_confusions(c: Column, pairs: list[tuple[str, str]] = CONFUSIONS) -> Column:
    """What recognition makes of words. Texts without any of it are told by one look, and of the pairs only those are tried whose group is there."""

    def found(some: list[tuple[str, str]]) -> str:
        """One alternation of whole words, so that a place within a word is left at once."""
        whole = [p[2:-2] for p, _ in some if p.startswith(r"\b") and p.endswith(r"\b")]
        return "|".join([*(f"(?:{p})" for p, _ in some if not (p.startswith(r"\b") and p.endswith(r"\b"))), *([rf"\b(?:{'|'.join(whole)})\b"] if whole else [])])

    groups = [pairs[i : i + 16] for i in range(0, len(pairs), 16)]
    tried = lambda x, some: bound(x, lambda y: F.when(y.rlike(found(some)), _each(y, some)).otherwise(y))
    return bound(c, lambda x: F.when(x.rlike(found(pairs)), reduce(tried, groups, x)).otherwise(x))


def _either(phrases: list[str]) -> str:
    return "(?:" + "|".join(re.escape(p) for p in phrases) + ")"


def strip_tail(c: Column, phrases: list[str] = RUNNING_HEADERS) -> Column:
    """Cuts the phrase that ends the text; no phrase ends another."""
    tail = rf"\s*{_either(phrases)}\s*$"
    return bound(c, lambda x: F.when(x.rlike(tail), F.regexp_replace(x, rf"{tail}|\s+$", "")).otherwise(x))


def strip_inline(c: Column, phrases: list[str] = RUNNING_HEADERS) -> Column:
    """Cuts the first place of each phrase that stands between two words."""
    between = rf"(?<=\w)\s+{_either(phrases)}\s+(?=\w)"
    firsts = [(rf"(?s)\A(.*?)(?<=\w)\s+{re.escape(p)}\s+(?=\w)", "$1 ") for p in phrases]
    return bound(c, lambda x: F.when(x.rlike(between), _each(x, firsts)).otherwise(x))


def emphasise(c: Column, terms: list[str] = FOREIGN_TERMS) -> Column:
    return _each(c, [(rf"(?<![*])\b({t})\b(?![*])", r"*$1*") for t in terms])


def repair_ellipsis(c: Column) -> Column:
    return F.trim(_each(c, [(rf"(\b[A-Za-z]{{2,}}){S}*\.\.\.{S}*([A-Za-z]{{2,}}\b)", "$1 $2"), (rf"{S}*\.\.\.{S}*", " ")]))


def corrected(c: Column) -> Column:
    """All corrections in their order, trimmed."""
    steps = [map_characters, join_hyphens, shorten_abbreviations, repair_confusions, join_split_words, normalise_lists, collapse_repeats, rejoin_diacritics, squeeze, repair_urls, repair_page_ranges, strip_tail, strip_inline, emphasise]
    return F.regexp_replace(reduce(lambda x, f: f(x), steps, c), r"\A\s+|\s+\z", "")


def clean_query(c: Column, openings: list[str] = QUESTION_OPENINGS) -> Column:
    """Lower case, without closing punctuation, openings (again and again) and possessive s."""
    t = F.trim(F.regexp_replace(F.trim(F.lower(c)), r"[?.!,;]+$", ""))
    one = "|".join(o.replace(" ", rf"{S}+") + rf"{S}+" for o in openings)
    return F.trim(F.replace(F.regexp_replace(t, f"^(?:{one})+", ""), F.lit("'s"), F.lit("")))


def site_filter(query: Column, sites: Column) -> Column:
    return F.when(F.size(sites) > 0, F.concat(F.lit("("), F.array_join(F.transform(sites, lambda s: F.concat(F.lit("site:"), s)), " OR "), F.lit(") "), query)).otherwise(query)


def intent(q: Column) -> Column:
    """struct(archetype, word_limit, explicit_limit) of a question; 'NNN words' in it overrules the kind's length."""
    t = F.trim(F.lower(q))
    told = F.regexp_extract(t, r"([0-9]{2,4})[ \t]*words?\b", 1)
    said = F.when(told != "", told.cast("int"))
    name, words = F.lit(DEFAULT_INTENT[0]), F.lit(DEFAULT_INTENT[1])
    for kind, tells, n in reversed(INTENTS):
        hit = t.rlike(rf"\b({tells})\b")
        name, words = F.when(hit, kind).otherwise(name), F.when(hit, n).otherwise(words)
    return F.struct(name.alias("archetype"), F.coalesce(F.when(said > 0, said), words).cast("long").alias("word_limit"), F.coalesce(said > 0, F.lit(False)).alias("explicit_limit"))


def token_budget_of(mode: Column, archetype: Column, limit: Column) -> Column:
    """Tokens of an answer: by kind and length for long answers, fixed for the other modes."""
    long = F.when(archetype == "indetail", 2048).when(archetype.isin("summary", "brief"), 800).otherwise(token_budget(limit))
    return F.when(mode == "mains", long).when(mode == "current_affairs", 1200).otherwise(768).cast("long")


def quiz_sentences(c: Column) -> Column:
    """Sentences of 36 to 219 characters, white space squeezed, without those that begin like a heading."""
    s = F.filter(F.split(F.regexp_replace(c, r"\s+", " "), r"(?<=[.?!])\s+"), lambda x: F.length(F.trim(x)).between(36, 219))
    return F.filter(F.transform(s, lambda x: F.trim(x)), lambda x: ~F.lower(x).rlike(r"^(page|chapter|module|paper|figure|table)\b"))


def token_budget(limit: Column) -> Column:
    return F.greatest(F.lit(1024).cast("long"), F.floor(2.5 * limit).cast("long"))


def scrub_citations(c: Column) -> Column:
    """Drops chunk tags in any brackets and what they leave behind."""
    tags = r"(?:chk_[A-Za-z0-9_]+[ \t\n,]*)+"
    return F.trim(_each(c, [(rf"\({tags}\)", ""), (rf"\[{tags}\]", ""), ("chk_[A-Za-z0-9_]+", ""), (rf"\({S}*,?{S}*\)", ""), (rf"{S}+([.,;:!?])", "$1"), ("  +", " ")]))


def citations(c: Column) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[(chk_[A-Za-z0-9_]+)\]"), F.lit(1))))


def simple_page(c: Column, least: int = 50) -> Column:
    """A page's text with runs of line ends and blanks squeezed; null for pages that are too short."""
    t = _each(c, [(r"\n+", "\n"), (" +", " ")])
    return bound(t, lambda x: F.when(F.length(x) > least, x))


def sentences(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), rf"(?<=[.?!]){S}+"), lambda s: s != "")


def decode_redirect(token: Column) -> Column:
    """The target that a redirect carries as base64: the first of four offsets at which a URL comes out."""
    def at(k: int) -> Column:
        part = F.substring(token, F.lit(k + 1), F.length(token))
        text = F.try_to_binary(F.rpad(part, F.length(part) + (4 - F.length(part) % 4) % 4, "="), F.lit("base64")).cast("string")
        return F.when(text.startswith("http"), text)

    return F.coalesce(*[at(k) for k in range(4)])


#: Sites that a trusted one goes by as well.
ALIASES = {"insightsias.com": ["insightsonindia.com"]}


def trusted(url: Column, domains: list[str]) -> Column:
    """The host is one of the domains, or of their aliases, or below one; without domains every host is trusted."""
    if not domains:
        return F.lit(True)
    domains = [x for d in domains for x in (d.lower().strip(), *ALIASES.get(d.lower().strip(), []))]
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1)), "^www\\.", "")
    return reduce(lambda a, d: a | (host == d) | host.endswith(f".{d}"), domains, F.lit(False))
