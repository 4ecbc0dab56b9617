"""Model responses as rows, questions and their scores, web results as chunks, and the messages that go with an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .chunking import sentence_chunks
from .classes import each, values

BLOCK_TYPES = ["heading", "paragraph", "list_item", "diagram"]
#: What tells a diagram's code.
DIAGRAM_MARKS = ["graph ", "sequenceDiagram", "mindmap", "---SUMMARY---"]
#: The questions of an evaluation set, each with its condition on a chunk's text, in order of trial.
PROBES = [
    ("What are the primary literary and epigraphic sources for reconstructing Ancient Indian Polity?", lambda t, low: F.contains(t, F.lit("Polity")) & F.contains(t, F.lit("Source"))),
    ("How is the theory of the origin of kingship described in ancient Indian political thought?", lambda t, low: F.contains(t, F.lit("Kingship")) | F.contains(low, F.lit("king"))),
    ("What was the structure of the taxation system in Ancient and Early Medieval India?", lambda t, low: F.contains(t, F.lit("Taxation")) | F.contains(low, F.lit("tax"))),
    ("How is statecraft and political philosophy depicted in the Indian Epics?", lambda t, low: F.contains(t, F.lit("Epic")) | F.contains(t, F.lit("Mahabharata"))),
    ("What are the rules regarding Svara and accents in Vaidika Sanskrit?", lambda t, low: F.contains(t, F.lit("Svara or accent")) | F.contains(t, F.lit("Sanskrit language"))),
    ("How are the Vedas divided into Samhita, Brahmana, Aranyaka and Upanishad?", lambda t, low: F.contains(t, F.lit("Dichotomy of Veda")) | F.contains(t, F.lit("divided into"))),
    ("Who organized the initial heap of Vedic texts into structured Vedas?", lambda t, low: F.contains(t, F.lit("Vedavy")) | F.contains(t, F.lit("heap"))),
    ("Overview of Vedic, Epic and Puranic culture of India", lambda t, low: F.contains(t, F.lit("Vedic, Epic and Puranic culture"))),
]


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def unfenced(c: Column) -> Column:
    """A response without the code fence around it."""
    return _stripped(F.regexp_replace(F.regexp_replace(_stripped(c), r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", ""))


def _json(c: Column, schema: str) -> Column:
    """c as JSON, null if it is none; line ends within strings are let through."""
    got = F.from_json(c, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "allowUnquotedControlChars": "true"})
    return F.when(c.startswith("{") & c.endswith("}"), bound(got, lambda x: F.when(x["_bad"].isNull(), x)))


def parse_answer(raw: Column) -> Column:
    """struct(answer, answered, citations, tier) of a response: JSON, JSON within other text, an answer field in broken JSON, or the text itself. Null for an empty response."""
    cited = lambda t: F.sort_array(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\[chk_\w+\]"), F.lit(0))))
    row = lambda a, done, c, n: F.struct(a.alias("answer"), done.alias("answered"), c.alias("citations"), F.lit(n).alias("tier"))

    def judge(t: Column) -> Column:
        schema = "answer string, answered boolean, citations array<string>"
        whole = _json(t, schema)
        inner = _json(F.regexp_extract(t, r"(?s)(\{.*\})", 1), schema)
        short, long = F.regexp_extract(t, r'(?s)"answer"\s*:\s*"(.*?)"\s*,\s*"answered"', 1), F.regexp_extract(t, r'(?s)"answer"\s*:\s*"(.*)"', 1)
        said = F.when(short != "", short).otherwise(long)
        said = _stripped(F.replace(F.replace(said, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')))
        of = lambda j, n: F.when(j.isNotNull(), row(j["answer"], j["answered"], j["citations"], n))
        third = F.when(t.rlike(r'(?s)"answer"\s*:\s*".*"'), row(said, F.lit(True), cited(said), 3))
        return F.coalesce(of(whole, 1), of(inner, 2), third, row(t, F.lit(True), cited(t), 4))

    return F.when(_stripped(raw) != "", bound(unfenced(raw), judge))


def plain_letters(c: Column) -> Column:
    """Words whose letters a response parts by blanks, and whose words by slashes."""
    words = F.filter(F.transform(F.split(c, "/"), lambda w: F.regexp_replace(F.replace(w, F.lit(" "), F.lit("")), r"\A\s+|\s+\z", "")), lambda w: w != "")
    return F.array_join(words, " ")


def parse_blocks(responses: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, at, type, text) of the blocks in page responses: a JSON list, or the first list within other text. Empty blocks drop out; unknown types, and diagrams without code, are paragraphs."""
    schema = "array<struct<type:string,text:string>>"
    t = unfenced(F.col(raw))
    listed = lambda x: F.when(x.startswith("["), F.from_json(x, schema))
    got = bound(t, lambda x: F.coalesce(listed(x), listed(F.regexp_extract(x, r"(?s)\[.*\]", 0))))
    b = responses.select(key, F.posexplode(got).alias("at", "b")).select(key, "at", F.lower(F.coalesce("b.type", F.lit("paragraph"))).alias("type"), _stripped(F.coalesce("b.text", F.lit(""))).alias("text")).where("text <> ''")
    drawn = F.contains(F.lower("text"), F.lit("mermaid"))
    for m in DIAGRAM_MARKS:
        drawn = drawn | F.contains("text", F.lit(m))
    kind = F.when(~F.col("type").isin(BLOCK_TYPES) | ((F.col("type") == "diagram") & ~drawn), "paragraph").otherwise(F.col("type"))
    b = b.withColumn("type", kind)
    return b.withColumn("text", F.when(F.col("type") == "diagram", F.col("text")).otherwise(plain_letters(F.col("text"))))


def parse_questions(responses: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, id, question, options, correct, explanation): a list of questions, or an object that has one under one of four names or is a question itself. Options are padded to four, the right one is taken modulo four."""
    item = "struct<question:string,options:array<string>,correct:int,explanation:string>"
    names = ["questions", "mcqs", "items", "problems"]
    t = unfenced(F.col(raw))

    def items(x: Column) -> Column:
        whole = F.from_json(x, ", ".join(f"{n} array<{item}>" for n in names) + ", question string")
        some = F.coalesce(*[F.when(F.size(whole[n]) > 0, whole[n]) for n in names])
        one = F.when(whole["question"].isNotNull(), F.array(F.from_json(x, item)))
        return F.when(x.startswith("["), F.from_json(x, f"array<{item}>")).when(x.startswith("{"), F.coalesce(some, one))

    q = responses.select(key, F.posexplode(bound(t, items)).alias("id", "q"))
    given = F.coalesce("q.options", F.array(*map(F.lit, "ABCD")))
    pad = F.concat(F.lit("Option "), F.chr(F.lit(65) + F.size(given)))
    options = F.slice(F.concat(given, F.array_repeat(pad, F.greatest(F.lit(0), 4 - F.size(given)))), 1, 4)
    question = F.coalesce("q.question", F.concat(F.lit("Question "), (F.col("id") + 1).cast("string")))
    said = F.coalesce("q.explanation", F.lit("Refer to standard UPSC reference materials."))
    return q.select(key, "id", question.alias("question"), options.alias("options"), F.pmod(F.coalesce("q.correct", F.lit(0)), F.lit(4)).alias("correct"), said.alias("explanation"))


def evaluation_set(chunks: DataFrame) -> DataFrame:
    """(query, expected_chunk_id): each question with the first chunk (by seq) whose text calls for it; a chunk calls for its first question only. chunks: (chunk_id, seq, text)."""
    t, low = F.col("text"), F.lower("text")
    asked = F.lit(None).cast("string")
    for q, tells in reversed(PROBES):
        asked = F.when(tells(t, low), q).otherwise(asked)
    return chunks.select(asked.alias("query"), "chunk_id", "seq").where("query IS NOT NULL").groupBy("query").agg(F.min_by("chunk_id", "seq").alias("expected_chunk_id"))


def active_classes(fixed: list[str], registered: DataFrame) -> DataFrame:
    """(label, place): the fixed classes in their order, then those registered (name, no) that aren't among them, each once."""
    new = registered.where(~F.col("name").isin(fixed)).groupBy(F.col("name").alias("label")).agg(F.min("no").alias("no"))
    new = new.select("label", (F.row_number().over(Window.orderBy("no", "label")) - 1 + len(fixed)).cast("long").alias("place"))  # a row for each class
    spark = registered.sparkSession
    return spark.createDataFrame([(c, i) for i, c in enumerate(fixed)], "label string, place bigint").unionByName(new)


def rebuilt_scores(classified: DataFrame, classes: DataFrame) -> DataFrame:
    """(qid, label, score): the winner has its confidence, the others share the rest alike; a winner that is no class gives no rows. classified: (qid, label, confidence)."""
    labels = values(classes, "label")
    j = classified.where(F.col("label").isin(labels)).select("qid", F.col("label").alias("winner"), "confidence", each(labels, "string").alias("label"))
    rest = F.round((1 - F.col("confidence")) / max(len(labels) - 1, 1), 4)
    return j.select("qid", "label", F.when(F.col("label") == F.col("winner"), F.col("confidence")).otherwise(rest).alias("score"))


def uniform_scores(questions: DataFrame, classes: DataFrame) -> DataFrame:
    """(qid, classification, label, score) where classifying failed: all classes alike, the first named."""
    labels, first = values(classes, "label"), classes.agg(F.min_by("label", "place")).first()[0]
    return questions.select("qid", F.lit(first).cast("string").alias("classification"), each(labels, "string").alias("label"), F.lit(round(1 / max(len(labels), 1), 4)).alias("score"))


def result_rows(found: DataFrame, most: int = 8) -> DataFrame:
    """(qid, source, rank, url, title, snippet): a provider's results with an address, ranked from 0, ``most`` at most. found: (qid, source, at, url, title, snippet)."""
    t = found.where(F.coalesce(F.trim("url"), F.lit("")) != "").withColumns({"title": F.trim("title"), "snippet": F.trim("snippet")})
    t = t.withColumn("rank", (F.row_number().over(Window.partitionBy("qid", "source").orderBy("at")) - 1).cast("long"))
    return t.where(F.col("rank") < most).select("qid", "source", "rank", "url", "title", "snippet")


def web_chunks(merged: DataFrame, least: int = 100, most: int = 180) -> DataFrame:
    """(qid, chunk_id, url, sub_idx, score, text): results (qid, rank, url, title, snippet, text) cut into chunks. Short articles give way to title and snippet; a question's chunks are numbered through."""
    w = Window.partitionBy("qid")
    total = F.count("*").over(w)
    place = F.row_number().over(w.orderBy("rank", "url")) - 1
    text, other = F.trim(F.coalesce("text", F.lit(""))), F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("snippet", F.lit(""))))
    r = merged.select("qid", "url", place.alias("place"), F.round(1 - place / total, 4).alias("score"), F.when(F.length(text) >= least, text).otherwise(_stripped(other)).alias("t")).where("t <> ''")
    c = r.select("qid", "url", "place", "score", F.posexplode(sentence_chunks(F.col("t"), most)).alias("sub_idx", "text"))
    n = F.row_number().over(w.orderBy("place", "sub_idx"))
    return c.select("qid", F.format_string("web_%03d", n).alias("chunk_id"), "url", "sub_idx", "score", "text")


def routing_message(routing: Column, classification: Column, confidence: Column, candidates: Column, citations: Column, sites: Column) -> Column:
    """What a question's log says of its way. confidence in per cent."""
    one = F.format_string("%.1f", confidence)
    n, m = candidates.cast("string"), citations.cast("string")
    say = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    return (
        F.when(routing == "high_confidence", say("Query routed strictly to ", classification, " Database (", one, "% confidence). ", n, " candidate chunks retrieved and reranked. Answer backed by ", m, " source(s). No other database was searched."))
        .when(routing == "medium_confidence", say("Query routed to top-2 databases (History + Anthropology). ", n, " candidate chunks merged and reranked. Answer backed by ", m, " source(s)."))
        .when(routing == "current_affairs_local", say("Query answered directly from local Current Affairs Vector Cache (06:00 AM daily digest). ", n, " candidates retrieved and reranked. Answer backed by ", m, " verified source(s) with <1s latency."))
        .when(routing == "current_affairs_web", say("Current Affairs query routed to live parallel web search (trusted sources: ", F.array_join(F.slice(sites, 1, 4), ", "), "...). ", n, " web articles scraped and reranked. Answer backed by ", m, " source(s)."))
        .otherwise(say("Routing: ", routing, " | Confidence: ", one, "% | Candidates: ", n, " | Citations: ", m))
    )


def with_outcome(message: Column, gated: Column, reason: Column, answered: Column) -> Column:
    tail = F.when(gated, F.concat(F.lit(" [GATED: "), F.coalesce(reason, F.lit("Low relevance score")), F.lit("]"))).when(~answered, " [Result: Insufficient information in knowledge base.]").otherwise(" [Result: Answer successfully generated.]")
    return F.concat(message, tail)


def prompt_name(mode: Column, sub_mode: Column, query: Column, archetype: Column) -> Column:
    """Which prompt a question gets; null for an unknown mode. Prompts of long answers are told apart by the question's archetype."""
    low = F.lower(sub_mode)
    mains = F.concat(F.lit("mains/"), archetype)
    news = F.when((low == "mains") & (query != ""), mains).when(low == "mains", "news/article").when(low.isin("mcq", "explain"), F.concat(F.lit("news/"), low)).otherwise("news/summary")
    return F.when(mode == "mains", mains).when(mode == "current_affairs", news).when(mode == "prelims", "prelims")


#: How an answer of each kind is built; {wl} stands for its length in words.
DIRECTIVES = {
    "differentiate": """\
Target: ~{wl} words. Format exactly as:
1. Overview: 1 sentence summarizing the core distinction.
2. Comparison Table (Markdown, 4-6 rows):
   | Basis | Entity A | Entity B |
   | :--- | :--- | :--- |
   Rows must cover: Definition, Core Characteristics, Scope/Function, Key Differences, Examples/Application from context.
3. Synthesis: 1-2 sentences on the overarching relationship or conclusion.""",
    "summary": """\
Target: ~{wl} words. Be strictly concise. Format exactly as:
1. Snapshot: 1 sentence — the core concept, event, or principle.
2. Key Points: 3-4 bullet points with bold key terms, stages, or facts from context.
3. Bottom Line: 1 concluding takeaway sentence.""",
    "explain": """\
Target: ~{wl} words. Format exactly as:
1. Definition & Core Concept: 1-2 clear sentences defining the concept or topic.
2. Stages / Mechanism / Key Pillars: 2-4 structured bullets explaining the components, stages, or mechanism from context.
3. Significance & Application: 2 bullets on its importance, practical relevance, or impact based on context.""",
    "indetail": """\
Target: ~{wl} words. Format exactly as:
1. Context & Overview: 1-2 sentences grounding the topic and its core scope from context.
2. Multi-Dimensional Analysis: bold sub-headings analyzing the key dimensions present in the context.
3. Critical Insights / Key Characteristics: 2-3 balanced analytical bullets evaluating the topic.
4. Summary & Conclusion: 2 concrete, context-grounded concluding points.""",
    "timeline": """\
Target: ~{wl} words. Format exactly as:
1. Genesis: 1-2 sentences on the origin or starting phase.
2. Milestones: chronological bullets with bold phases/years and the transition each represents from context.
3. Contemporary Relevance: 1-2 sentences on modern status, implications, or application.""",
    "standard_mains": """\
Target: ~{wl} words. Format exactly as:
1. Introduction: 1-2 sentences — clear definition, background, or benchmark from context.
2. Analytical Body: 2-3 sub-headed thematic sections with bold key terms and direct analysis.
3. Conclusion: 2 balanced, context-grounded takeaways.""",
}


def directive(archetype: Column, word_limit: Column) -> Column:
    """The directive of a long answer: its kind's, with its length; kinds without one of their own take the standard one."""
    chosen = F.lit(DIRECTIVES["standard_mains"])
    for kind, text in DIRECTIVES.items():
        chosen = F.when(archetype == kind, text).otherwise(chosen)
    return F.replace(chosen, F.lit("{wl}"), word_limit.cast("string"))
