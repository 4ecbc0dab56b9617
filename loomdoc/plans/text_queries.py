"""Queries of the text functions. The lines of ``documents`` get what the functions repair put in by fixed replacements."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.answers import DIRECTIVES, directive
from ..sources.layout import BLOCKS_SQL, blocks
from .registry import query, table

S = "[ \\t\\n\\x0b\\f\\r]"


def _with(spark, d, expression):
    return blocks(table(spark, d, "documents")).select("doc_id", "seq", F.expr(expression).alias("raw"))


def _sql(expression, result, more=""):
    return f"WITH {BLOCKS_SQL}, t AS (SELECT doc_id, seq, {expression} AS raw FROM blocks) SELECT doc_id, seq, {result} AS text{more} FROM t"


def _nest(c, rules, flags="g"):
    for a, b in rules:
        c = f"regexp_replace({c}, '{a}', '{b}', '{flags}')"
    return c


GLYPHS = "replace(replace(replace(replace(replace(text, 'th', 'ﬁ—'), '. ', '… '), 'on', '“on”'), 'er ', ' '), 'en ', ' �ņ ')"
FROM = "“”‘’—– Ííņ�"
MAPPED = f"translate(raw, '{FROM}', '\"\"''''-- Iin✓✓✓✗••➢✉ •')"
for _a, _b in (("…", "..."), ("​", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi")):
    MAPPED = f"replace({MAPPED}, '{_a}', '{_b}')"


@query(_sql(GLYPHS, MAPPED))
def d1_map_characters(spark, d):
    return _with(spark, d, GLYPHS.replace("'", '"')).select("doc_id", "seq", T.map_characters(F.col("raw")).alias("text"))


HYPHENS = "replace(regexp_replace(text, '[^ -~]', '{0}'), 'er ', 'er- \n ')"  # word borders beyond ASCII differ between the engines


@query(_sql(HYPHENS.replace("'{0}'", "'', 'g'"), "regexp_replace(raw, '(\\b[a-zA-Z]{2,})-[ \\t\\n]*\\n[ \\t\\n]*([a-zA-Z]{2,}\\b)', '\\1\\2', 'g')"))
def d2_join_hyphens(spark, d):
    return _with(spark, d, HYPHENS.replace('{0}', '')).select("doc_id", "seq", T.join_hyphens(F.col("raw")).alias("text"))


SHORT = [("U.P.S.C.", "UPSC"), ("I.A.S.", "IAS"), ("I.P.S.", "IPS"), ("I.F.S.", "IFS"), ("C.S.A.T.", "CSAT"), ("N.C.E.R.T.", "NCERT"), ("M.L.A.", "MLA"), ("M.P.", "MP"), ("B.C.E.", "BCE"), ("C.E.", "CE")]
ABBREVIATED = "replace(replace(text, 'the ', 'U.P.S.C.x '), 'and ', 'M.P.s C.E. ')"


@query(_sql(ABBREVIATED, _nest("raw", [("\\b" + a.replace(".", "\\.") + "\\b", b) for a, b in SHORT])))
def d3_abbreviations(spark, d):
    return _with(spark, d, ABBREVIATED).select("doc_id", "seq", T.shorten_abbreviations(F.col("raw")).alias("text"))


#: Confused words among the lines; letters beyond ASCII are left out, as word borders differ between the engines there.
CONFUSED = "concat(regexp_replace(text, '[^ -~]', ''{0}), case seq % 5 when 0 then ' Thls is nol il' when 1 then ' {{ho Sull-kutl aud New  Dehi, Mughalempire' when 2 then ' easten anthroplogists, tribal  socites' when 3 then ' SOCIAL SCIENCE PART 1 SOCIAL SCIENCE - PART 1' else '' end)"


@query(_sql(CONFUSED.format(", 'g'"), _nest("raw", [(a.replace("'", "''"), b) for a, b in T.CONFUSIONS])))
def d4_confusions(spark, d):
    return _with(spark, d, CONFUSED.format("")).select("doc_id", "seq", T.repair_confusions(F.col("raw")).alias("text"))


SPLIT = "replace(replace(replace(replace(text, 'the ', 'V ol. Y  ork V olume '), 'and ', 'CentralAsian S hah K hafi Perso - Islamic '), 'of ', 'middleeastern NorthIndia ImreBangha '), 'der ', 'Sabk - i Hindi, Nagari  Rekhta, ChandarBhan of Andhara Pradesh, V ernacular ')"
JOINED = [
    ("\\bV\\s+ol\\.", "Vol."),
    ("\\bV\\s+olume\\b", "Volume"),
    ("\\bY\\s+ork\\b", "York"),
    ("\\bV\\s+ernacular", "Vernacular"),
    ("(?i)\\bmiddleeastern\\b", "Middle Eastern"),
    ("\\bCentralAsian\\b", "Central Asian"),
    ("\\bSouthAsian\\b", "South Asian"),
    ("\\bNorthIndia\\b", "North India"),
    ("\\bSouthIndia\\b", "South India"),
    ("\\bS\\s+hah\\b", "Shah"),
    ("\\bK\\s+han\\b", "Khan"),
    ("\\bK\\s+hafi\\b", "Khafi"),
    ("\\bImreBangha\\b", "Imre Bangha"),
    ("\\bPerso\\s+-\\s+Islamic\\b", "Perso-Islamic"),
    ("\\bSabk\\s+-\\s+i\\s+Hindi\\b", "Sabk-i Hindi"),
    ("\\bNagari\\s+Rekhta\\b", "Nagari Rekhta"),
    ("\\bChandarBhan\\b", "Chandar Bhan"),
    ("\\bAndhara\\s+Pradesh\\b", "Andhra Pradesh"),
]


@query(_sql(SPLIT, _nest("raw", JOINED)))
def d5_split_words(spark, d):
    return _with(spark, d, SPLIT).select("doc_id", "seq", T.join_split_words(F.col("raw")).alias("text"))


LISTS = "concat(case seq % 4 when 0 then '  > ' when 1 then '3) ' when 2 then '-- ' else '➢ ' end, text, '\n 12: more')"


@query(_sql(LISTS, _nest("raw", [("(?m)^[ \\t]*(?:[•‣◦⁃▪▫●○’➢▸▹►▻➔→>*]|-{1,2}|–|—)[ \\t]+", "• "), ("(?m)^[ \\t]*([0-9]{1,2})[.)\\]:][ \\t]+", "\\1. ")])))
def d6_list_markers(spark, d):
    return _with(spark, d, LISTS).select("doc_id", "seq", T.normalise_lists(F.col("raw")).alias("text"))


@query()
def d7_repeated_words(spark, d):
    return _with(spark, d, "replace(text, 'the ', 'the the ')").select("doc_id", "seq", T.collapse_repeats(F.col("raw")).alias("text"))


PARTED = "replace(replace(text, 'on', ' ṇ on'), 'er', 'x  ṣ  er')"
LETTER, MARKS = "[\\p{L}\\p{N}_]", "[ṇṣśñṭḍṛḷṃḥĀāĪīŪūṚṛṜṝḶḷḸḹṂṃḤḥÑñṬṭḌḍṆṇŚśṢṣ]"


@query(_sql(PARTED, _nest("raw", [(f"({LETTER})\\s+({MARKS})\\s*({LETTER})", "\\1\\2\\3"), (f"({LETTER})\\s+({MARKS})", "\\1\\2")])))
def d8_rejoined_diacritics(spark, d):
    return _with(spark, d, PARTED).select("doc_id", "seq", T.rejoin_diacritics(F.col("raw")).alias("text"))


WIDE = "replace(replace(text, ' ', '  '), '.', '.\n\n\n\n')"


@query(_sql(WIDE, _nest("raw", [("[ \\t]{2,}", " "), ("\\n{3,}", "\n\n")])))
def d9_squeeze(spark, d):
    return _with(spark, d, WIDE).select("doc_id", "seq", T.squeeze(F.col("raw")).alias("text"))


@query()
def d10_url_gaps(spark, d):
    return _with(spark, d, "replace(text, '. ', ' https://a.org/x y.html /z ')").select("doc_id", "seq", T.repair_urls(F.col("raw")).alias("text"))


RANGES = "replace(text, '. ', concat(' pp. ', cast(1000 + seq * 37 % 9000 as varchar(10)), '-471, p. 45-9. '))"


@query(_sql(RANGES, f"regexp_replace(raw, '(pp?\\.{S}*)[0-9]([0-9]{{2,3}})(-[0-9]{{2,4}})', '\\1\\2\\3', 'g')"))
def d11_page_ranges(spark, d):
    return _with(spark, d, RANGES.replace("varchar(10)", "string")).select("doc_id", "seq", T.repair_page_ranges(F.col("raw")).alias("text"))


#: Running headers, written out for SQL.
PHRASES = """Persian Histories and Memoirs|Sources and Literary Traditions|History of India-VII|History of India-VI|History of Modern Europe|History of China|Political Processes|Production and Commercial Practices|State, Society and Religion|Visual Culture
Society and Culture|The 18th Century|Mughal Decline and Disintegration|Sanskrit Kavya Literature, Regional Sources and Travelogues|Indian Ocean Trade Network|Trading Communities and Commercial Practices|Religious Ideas and Movements|Courtly Culture|Women and Gender
Importance and Implications of Biological Variation|Introduction to Biological Diversity|Sources of Genetic Variation|Genetic Polymorphism|Role of Bio-cultural Factors|Ethnic Elements in Indian Population|Classification of Racial Elements in India|Major Races of Mankind
Demographic Anthropology|Indian Demography|Inbreeding and Consanguinity|Biological Diversity in Human Populations""".replace("\n", "|").split("|")
TAILS = "concat(text, case seq % 5 when 0 then ' Visual Culture ' when 1 then ' The 18th Century' when 2 then ' Sources of Genetic Variation' when 3 then ' Visual Culture Indian Demography' else '' end)"
TAIL = f"\\s*(?:{'|'.join(PHRASES)})\\s*$"


@query(_sql(TAILS, f"CASE WHEN regexp_matches(raw, '{TAIL}') THEN regexp_replace(regexp_replace(raw, '{TAIL}', ''), '\\s+$', '') ELSE raw END"))
def d12_header_tails(spark, d):
    return _with(spark, d, TAILS).select("doc_id", "seq", T.strip_tail(F.col("raw")).alias("text"))


INLINE = "replace(replace(regexp_replace(text, '[^ -~]', ''{0}), ' of ', ' Women and Gender of  History of China '), ' and ', ' Major Races of Mankind and ')"
#: The first place between two words of each phrase in turn, from the text around it.
INLINE_SQL = "raw"
for _p in PHRASES:
    INLINE_SQL = f"regexp_replace({INLINE_SQL}, '(\\w)\\s+{_p}\\s+(\\w)', '\\1 \\2')"


@query(_sql(INLINE.format(", 'g'"), INLINE_SQL))
def d12_inline_headers(spark, d):
    return _with(spark, d, INLINE.format("")).select("doc_id", "seq", T.strip_inline(F.col("raw")).alias("text"))


FOREIGN = "replace(replace(text, 'the ', 'volk *jihad* Kesselschlacht, '), 'der ', 'levee en masse volksgemeinschaft ')"
STEPS, _from = "", "t"
for _i, _t in enumerate(("schwerpunkt", "auftragstaktik", "blitzkrieg", "levee en masse", "volk", "volksgemeinschaft", "jihad", "jehad", "ghazi", "Kesselschlacht", "kesselschlacht")):
    STEPS += f", e{_i} AS (SELECT doc_id, seq, string_split_regex(raw, '[*]?\\b{_t}\\b[*]?') AS p, regexp_extract_all(raw, '[*]?\\b{_t}\\b[*]?') AS m FROM {_from}), f{_i} AS (SELECT doc_id, seq, array_to_string(list_transform(p, lambda x, k: CASE WHEN k = 1 THEN '' WHEN contains(m[k - 1], '*') THEN m[k - 1] ELSE '*' || m[k - 1] || '*' END || x), '') AS raw FROM e{_i})"
    _from = f"f{_i}"


@query(f"WITH {BLOCKS_SQL}, t AS (SELECT doc_id, seq, {FOREIGN} AS raw FROM blocks){STEPS} SELECT doc_id, seq, raw AS text FROM {_from}")
def d13_emphasis(spark, d):
    return _with(spark, d, FOREIGN).select("doc_id", "seq", T.emphasise(F.col("raw")).alias("text"))


@query()
def d14_corrected(spark, d):
    raw = _with(spark, d, "replace(replace(replace(text, 'th', 'ﬁ'), 'the ', 'the the '), 'and ', 'aud V ol. Visual Culture volk ')")
    new = raw.withColumn("text", T.corrected(F.col("raw")))
    return new.select("doc_id", "seq", "text", (F.col("text") != F.col("raw")).alias("was_corrected"), F.when(F.col("text") != F.col("raw"), F.col("raw")).alias("raw_text"))


SNIPPETS = "replace(replace(text, 'er ', '... '), '. ', ' ... . ')"


@query(_sql(SNIPPETS, "trim(" + _nest("raw", [(f"(\\b[A-Za-z]{{2,}}){S}*\\.\\.\\.{S}*([A-Za-z]{{2,}}\\b)", "\\1 \\2"), (f"{S}*\\.\\.\\.{S}*", " ")]) + ")"))
def d16_ellipses(spark, d):
    return _with(spark, d, SNIPPETS).select("doc_id", "seq", T.repair_ellipsis(F.col("raw")).alias("text"))


ASKED = "concat(case seq % 5 when 0 then 'What is the ' when 1 then 'Explain about the ' when 2 then 'Compare in 150 words ' when 3 then 'status of what is a ' else 'Evolution of ' end, text, case when seq % 2 = 0 then '''s rise?.' else ' ' end)"
OPENINGS = "what is an|what is a|what is|what are|explain|discuss|define|describe|analyze|meaning of|about|write a note on|write about|details of|the|current status and milestones of|current status of|status and milestones of|status of|milestones of|updates on"
OPEN = "|".join(o.replace(" ", f"{S}+") + f"{S}+" for o in OPENINGS.split("|"))


@query(_sql(ASKED, f"trim(replace(regexp_replace(trim(regexp_replace(trim(lower(raw)), '[?.!,;]+$', '')), '^(?:{OPEN})+', ''), '''s', ''))"))
def d17_clean_queries(spark, d):
    return _with(spark, d, ASKED.replace("'''s rise", "\"'s rise").replace("rise?.'", 'rise?."')).select("doc_id", "seq", T.clean_query(F.col("raw")).alias("text"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, seq, '(site:a.org OR site:b' || seq || '.in) ' || text AS text FROM blocks")
def d18_site_filter(spark, d):
    b = blocks(table(spark, d, "documents"))
    return b.select("doc_id", "seq", T.site_filter(F.col("text"), F.array(F.lit("a.org"), F.format_string("b%d.in", "seq"))).alias("text"))


DOMAINS = ["example.org", "tionsh.example.net", "ththan.example.net"]
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"


@query(f"SELECT page_id, {' OR '.join(f'{HOST} = {x!r} OR {HOST} LIKE {chr(39)}%.{x}{chr(39)}' for x in DOMAINS)} AS trusted FROM pages")
def d19_trusted_domains(spark, d):
    return table(spark, d, "pages").select("page_id", T.trusted(F.col("url"), DOMAINS).alias("trusted"))


@query("SELECT page_id, url AS target FROM pages")
def d20_decode_redirects(spark, d):
    token = F.concat(F.substring(F.lit("abc"), 1, (F.col("page_id") % 4).cast("int")), F.regexp_replace(F.base64(F.col("url").cast("binary")), r"[=\r\n]", ""))
    return table(spark, d, "pages").select("page_id", T.decode_redirect(token).alias("target"))


#: Words that tell a question's kind, written out for SQL.
TELLING = [
    "diff|difference|differentiate|compare|comparison|versus|vs|distinguish|distinction|tabular|table",
    "summar|summary|brief|briefly|short|shortly|gist|nutshell|key points|takeaway|snapshot|overview",
    "in detail|detailed|indetail|critically analyze|critically evaluate|examine|discuss in detail|comprehensive|elaborate|assess|evaluate",
    "timeline|evolution|chronolog|trace the history|historical development|phases of",
    "explain|what is|how does|what are|describe|concept of|meaning of|define",
]
KIND = "CASE " + " ".join(f"WHEN regexp_matches(q, '\\b({t})\\b') THEN '{{{i}}}'" for i, t in enumerate(TELLING)) + " ELSE '{5}' END"
NAMES = ["differentiate", "summary", "indetail", "timeline", "explain", "standard_mains"]
LENGTHS = ["250", "150", "400", "300", "200", "250"]
TOLD = "nullif(regexp_extract(q, '([0-9]{2,4})[ \\t]*words?\\b', 1), '')::INT"


def _fill(values):
    out = KIND
    for i, v in enumerate(values):
        out = out.replace(f"'{{{i}}}'", v if v.isdigit() else f"'{v}'")
    return out


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT doc_id, seq, trim(lower({ASKED})) AS q FROM blocks), u AS (SELECT *, {_fill(NAMES)} AS archetype, coalesce({TOLD}, {_fill(LENGTHS)})::BIGINT AS word_limit, {TOLD} IS NOT NULL AS explicit_limit FROM t)
  SELECT doc_id, seq, archetype, word_limit, explicit_limit, greatest(1024, floor(2.5 * word_limit)::BIGINT) AS max_tokens FROM u""")
def d21_d22_intents_and_budgets(spark, d):
    i = _with(spark, d, ASKED.replace("'''s rise", "\"'s rise").replace("rise?.'", 'rise?."')).select("doc_id", "seq", T.intent(F.col("raw")).alias("i"))
    return i.select("doc_id", "seq", "i.*", T.token_budget(F.col("i.word_limit")).alias("max_tokens"))


TAGGED = "replace(replace(text, '. ', ' [chk_0001, chk_2_3] . '), ', ', ' (chk_9) , chk_5 ( , ) ')"
TAGS = "(?:chk_[A-Za-z0-9_]+[ \\t\\n,]*)+"


@query(_sql(TAGGED, "trim(" + _nest("raw", [(f"\\({TAGS}\\)", ""), (f"\\[{TAGS}\\]", ""), ("chk_[A-Za-z0-9_]+", ""), (f"\\({S}*,?{S}*\\)", ""), (f"{S}+([.,;:!?])", "\\1"), ("  +", " ")]) + ")"))
def d24_scrub_citations(spark, d):
    return _with(spark, d, TAGGED).select("doc_id", "seq", T.scrub_citations(F.col("raw")).alias("text"))


CITED = "replace(replace(text, '. ', ' [chk_0001] '), ' a ', ' [chk_7a] [chk_0001] ')"


@query(f"WITH {BLOCKS_SQL}, t AS (SELECT doc_id, seq, {CITED} AS raw FROM blocks) SELECT doc_id, seq, array_to_string(list_sort(list_distinct(regexp_extract_all(raw, '\\[(chk_[A-Za-z0-9_]+)\\]', 1))), ',') AS cited FROM t")
def d25_citations(spark, d):
    return _with(spark, d, CITED).select("doc_id", "seq", F.array_join(T.citations(F.col("raw")), ",").alias("cited"))


QUIZ = """WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Chapter one is a heading of some length. ' ELSE '' END || text AS text FROM documents)),
  u AS (SELECT doc_id, trim(unnest(s)) AS sentence, generate_subscripts(s, 1) AS i FROM t), k AS (SELECT * FROM u WHERE length(sentence) > 35 AND length(sentence) < 220 AND NOT regexp_matches(lower(sentence), '^(page|chapter|module|paper|figure|table)\\b'))
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, sentence FROM k"""


@query(QUIZ)
def d27_quiz_sentences(spark, d):
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "Chapter one is a heading of some length. ").otherwise(""), "text")
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.quiz_sentences(text)).alias("i", "sentence")).select("doc_id", (F.col("i") + 1).cast("long").alias("n"), "sentence")


@query(QUIZ)
def d27_sentences(spark, d):
    return d27_quiz_sentences(spark, d)



@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE doc_id % 4 WHEN 0 THEN 2048 WHEN 1 THEN 800 WHEN 2 THEN 800 ELSE greatest(1024, floor(2.5 * (doc_id % 900))::BIGINT) END WHEN 1 THEN 1200 ELSE 768 END::BIGINT AS max_tokens FROM documents""")
def d22_budgets_of_modes(spark, d):
    n = F.col("doc_id")
    mode = F.when(n % 3 == 0, "mains").when(n % 3 == 1, "current_affairs").otherwise("prelims")
    kind = F.when(n % 4 == 0, "indetail").when(n % 4 == 1, "summary").when(n % 4 == 2, "brief").otherwise("explain")
    return table(spark, d, "documents").select("doc_id", T.token_budget_of(mode, kind, n % 900).alias("max_tokens"))


#: Texts with paragraphs: a blank line after each line.
SPACED = "replace(text, chr(10), chr(10) || chr(10))"


SAMPLED = f"""WITH t AS (SELECT doc_id, {SPACED} AS text FROM documents), p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 30) AS ps FROM t),
  k AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS i, len(ps) AS n FROM p WHERE length(text) > 1500 AND len(ps) > 6), s AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM k WHERE i % greatest(1, n // 12) = 0),
  g AS (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY i) AS got FROM s WHERE upto <= 1500 GROUP BY doc_id)
  SELECT doc_id, coalesce(got, left(text, 1500)) AS sampled FROM p LEFT JOIN g USING (doc_id)"""


@query(SAMPLED)
def d26_sampled_contents(spark, d):
    from ..operators.chunking import sampled_content

    return table(spark, d, "documents").select("doc_id", sampled_content(F.replace("text", F.lit("\n"), F.lit("\n\n")), 1500).alias("sampled"))


@query(SAMPLED)
def d26_sampled_paragraphs(spark, d):
    return d26_sampled_contents(spark, d)


#: The directives' texts are the operator's own; which one a question gets, and its length, is SQL.
DIRECTIVES_SQL = "CASE archetype " + " ".join(f"WHEN '{k}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for k, t in DIRECTIVES.items()) + " END"


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT doc_id, seq, trim(lower({ASKED})) AS q FROM blocks), u AS (SELECT *, {_fill(NAMES)} AS archetype, coalesce({TOLD}, {_fill(LENGTHS)})::BIGINT AS word_limit FROM t)
  SELECT doc_id, seq, replace({DIRECTIVES_SQL}, '{{wl}}', word_limit::VARCHAR) AS directive FROM u""")
def d23_directives(spark, d):
    asked = blocks(table(spark, d, "documents")).select("doc_id", "seq", T.intent(F.expr(ASKED)).alias("i"))
    return asked.select("doc_id", "seq", directive(F.col("i")["archetype"], F.col("i")["word_limit"]).alias("directive"))
