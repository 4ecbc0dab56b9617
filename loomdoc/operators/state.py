"""Conversation memory, caches with expiry, news days, and the catalogue: tables whose latest state counts. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_messages(chat: DataFrame, n: int = 10, session: str = "session_id", order: str = "id") -> DataFrame:
    """The last n messages of each session."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return chat.withColumn("back", back).where(F.col("back") <= n).drop("back")


NO_HISTORY = "No previous conversation history."


def history(messages: DataFrame, sessions: DataFrame | None = None, session: str = "session_id", order: str = "id") -> DataFrame:
    """(session, history): the messages in order as one text; of JSON content the answer counts. With sessions, those without messages say so."""
    said = F.coalesce(F.get_json_object("content", "$.answer"), F.col("content"))
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(who, F.lit(": "), said).alias("line")))), lambda x: x["line"])
    told = messages.groupBy(session).agg(F.array_join(lines, "\n").alias("history"))
    return told if sessions is None else sessions.select(session).distinct().join(told, session, "left").select(session, F.coalesce("history", F.lit(NO_HISTORY)).alias("history"))


def cache_key(query: Column, mode: Column, sub_mode: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(F.trim(query)), mode, sub_mode), 256)


def cache_lookup(cache: DataFrame, keys: DataFrame, now: float) -> DataFrame:
    """Entries for the keys that have not expired; one that expires now has."""
    return keys.join(cache.where(F.col("expires_at") > now), "cache_key")


def expires(created: Column, mode: Column, ttl: float = 604_800.0, news_ttl: float = 21_600.0) -> Column:
    """When an entry expires: news after six hours, else after a week; null for modes that aren't cached."""
    return F.when(mode == "current_affairs", created + news_ttl).when(mode.isin("prelims", "mains"), created + ttl)


def cache_store(cache: DataFrame, new: DataFrame, most: int | None = None) -> DataFrame:
    """The cache with answered, ungated entries in it (the newest of a key), if asked cut to the newest ``most``: a distributed top-k by creation."""
    every = cache.unionByName(new.where("answered AND NOT gated").drop("answered", "gated"))
    last = F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("created_at")))
    kept = every.withColumn("n", last).where("n = 1").drop("n")
    return kept if most is None else kept.orderBy(F.desc("created_at"), "cache_key").limit(most)


def cache_stats(cache: DataFrame, now: float) -> DataFrame:
    live = F.col("expires_at") > now
    return cache.agg(F.count("*").alias("total"), F.count_if(live).alias("live"), F.count_if(~live).alias("expired"))


def article_id(title: Column, date: Column) -> Column:
    return F.substring(F.md5(F.concat(title, date.cast("string"))), 1, 12)


def new_articles(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Articles of the batch that aren't stored, each once (its first by place)."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("place"))
    return batch.withColumn("n", first).where("n = 1").drop("n").join(stored.select("id").distinct(), "id", "left_anti")


def tag_by_words(text: Column, tags: list[tuple[str, list[str]]], default: str) -> Column:
    """The first tag one of whose words is in the text, as a part of words too."""
    low, out = F.lower(text), F.lit(default)
    for tag, words in reversed(tags):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, tag).otherwise(out)
    return out


def retained(articles: DataFrame, today: Column, days: int) -> DataFrame:
    return articles.where(F.col("date") >= F.date_sub(today, days))


def feed(articles: DataFrame, today: Column, days: int = 5, tag: str | None = None, search: str | None = None) -> DataFrame:
    """Articles of the last days, by date and then the important ones first."""
    a = retained(articles, today, days)
    if tag is not None:
        a = a.where(F.col("tag") == tag)
    if search is not None:
        a = a.where(F.contains(F.lower("title"), F.lit(search.lower())) | F.contains(F.lower("summary"), F.lit(search.lower())))
    return a.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.col("priority") == "high"), "id")).cast("long"))


def client_filter(articles: DataFrame, tag: str = "all", search: str = "") -> DataFrame:
    """The articles of a day that a reader sees: of one tag, unless it is "all", and with the words that are searched for in title or summary, in any case."""
    if tag != "all":
        articles = articles.where(F.col("tag") == tag)
    if search:
        has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(search.lower())), F.lit(False))
        articles = articles.where(has("title") | has("summary"))
    return articles


MESSAGES = "session_id string, role string, content string, at bigint, bucket int"


def append_messages(messages: DataFrame, out: str, buckets: int = 64) -> None:
    """Adds messages (session_id, role, content, at) to a folder in buckets of sessions; those without a session are left out."""
    m = messages.where("coalesce(session_id, '') <> ''").select("session_id", "role", "content", F.col("at").cast("long").alias("at"))
    m.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("bucket").parquet(out)


def messages_of(spark, out: str, sessions: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """The messages of a folder; of some sessions, only their buckets are read."""
    m = spark.read.schema(MESSAGES).parquet(out)
    if sessions is not None:
        m = m.where(F.col("bucket").isin([r["b"] for r in spark.createDataFrame([(s,) for s in sessions], "s string").select(F.pmod(F.xxhash64("s"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]) & F.col("session_id").isin(sessions))  # as many as are named
    return m.drop("bucket")


def latest_status(events: DataFrame) -> DataFrame:
    """(id, status) after the last event of each document."""
    return events.groupBy("id").agg(F.max_by("status", F.struct("at", "no")).alias("status"))


def update_with_coalesce(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """stored with the changes that aren't null."""
    c = changes.select(key, *[F.col(x).alias(f"new_{x}") for x in columns])
    j = stored.join(c, key, "left")
    return j.withColumns({x: F.coalesce(f"new_{x}", x) for x in columns}).drop(*[f"new_{x}" for x in columns])


#: News tags with their words, in order of trial, and the category each counts to.
NEWS_TAGS = [
    ("Polity", ["court", "parliament", "bill", "election", "governor", "constitution", "judicial"]),
    ("Economy", ["gdp", "rbi", "inflation", "budget", "fta", "trade", "rupee", "tax"]),
    ("International", ["india-", "treaty", "summit", "bilateral", "un ", "nato", "g20"]),
    ("Environment", ["forest", "climate", "biodiversity", "pollution", "carbon", "wildlife"]),
    ("Science", ["isro", "space", "ai ", "technology", "research", "satellite", "digital"]),
    ("Defense", ["army", "navy", "missile", "defence", "security", "border"]),
    ("Schemes", ["yojana", "scheme", "mission", "launch", "government program"]),
]
NEWS_CATEGORIES = {
    "Polity": "polity_governance",
    "Economy": "economy",
    "International": "international_relations",
    "Environment": "environment_ecology",
    "Science": "science_technology",
    "Defense": "defense_security",
    "Schemes": "government_schemes",
}
#: Papers of the syllabus with their words, in order of trial.
PAPERS = [
    ("GS-3", ["economy", "rbi", "inflation", "gdp", "tax", "banking", "rupee", "fiscal", "isro", "drdo", "ai", "space", "climate", "environment", "pollution", "wildlife", "security", "defense", "missile"]),
    ("GS-2", ["constitution", "parliament", "supreme court", "high court", "governance", "treaty", "bilateral", "un", "diplomacy", "ambassador", "foreign policy"]),
    ("GS-1", ["culture", "heritage", "monument", "history", "geography", "monsoon", "cyclone", "earthquake", "society", "women"]),
]


def analysed(articles: DataFrame) -> DataFrame:
    """Adds tag, category, summary and priority to (title, content) by rule."""
    tag = tag_by_words(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))), NEWS_TAGS, "Polity")
    a = articles.withColumn("tag", tag)
    category = F.create_map(*[F.lit(x) for pair in NEWS_CATEGORIES.items() for x in pair])[F.col("tag")]
    return a.withColumns({"category": category, "summary": F.substring(F.coalesce("content", F.lit("")), 1, 400), "priority": F.lit("medium")})


def merged_days(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(date, title, overview, n_articles, ids) of the days that new has articles for: the stored ones first, then the new, each in its order. Both: (date, place, id)."""
    every = stored.select("date", F.lit(0).alias("part"), "place", "id").unionByName(new.select("date", F.lit(1).alias("part"), "place", "id"))
    every = every.join(new.select("date").distinct(), "date", "left_semi")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("part", "place", "id"))), lambda x: x["id"])
    title = F.concat(F.lit("UPSC Daily Briefing — "), F.date_format("date", "MMMM dd, yyyy"))
    told = F.concat(F.lit("UPSC news roundup for "), F.col("date").cast("string"), F.lit(" — "), F.col("added").cast("string"), F.lit(" articles from The Hindu and PIB."))
    d = every.groupBy("date").agg(F.count("*").alias("n_articles"), F.count_if(F.col("part") == 1).alias("added"), ids.alias("ids"))
    return d.select("date", title.alias("title"), told.alias("overview"), "n_articles", "ids")


def day_view(articles: DataFrame) -> DataFrame:
    """Articles as they are shown: an empty field counts as missing and gives way to its older name or a default."""
    said = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return articles.withColumns(
        {
            "title": F.coalesce(said("title", "headline"), F.lit("Untitled")),
            "tag": F.coalesce(said("tag", "category"), F.lit("Polity")),
            "summary": F.coalesce(said("summary", "analysis_summary"), F.lit("")),
            "isImportant": F.coalesce("isImportant", F.lit(False)) | F.coalesce("is_most_important", F.lit(False)),
        }
    )


def upsert_days(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """stored with whole days (date) replaced by those that changed has."""
    return stored.join(changed.select("date").distinct(), "date", "left_anti").unionByName(changed)


def purged(stored: DataFrame, dates: list[str]) -> DataFrame:
    """stored without the named days."""
    return stored.where(~F.col("date").cast("string").isin(dates))


def fresh(cache: DataFrame, now: float, ttl: float) -> DataFrame:
    """Articles stored less than ttl seconds ago; an older one counts as absent."""
    return cache.where(F.lit(now) - F.col("stored_at") <= ttl)


def cleared(cache: DataFrame, mode: Column | None = None) -> DataFrame:
    """(removed) entries that clearing takes, all or those of a condition."""
    return cache.agg(F.count("*") if mode is None else F.count_if(mode)).toDF("removed")


def log_rows(calls: DataFrame, query: str = "query", ms: str = "latency_ms", most: int = 80) -> DataFrame:
    """Calls as they are logged: the question on one line, cut to ``most`` characters, and the time to two places."""
    said = F.replace(F.substring(query, 1, most), F.lit("\n"), F.lit(" "))
    return calls.withColumns({query: said, ms: F.round(ms, 2)})


def day_statistics(articles: DataFrame) -> DataFrame:
    """(date, tag, n, important): articles of a day and tag, and those of high priority."""
    return articles.groupBy("date", "tag").agg(F.count("*").alias("n"), F.count_if(F.col("priority") == "high").alias("important"))


def backfilled(articles: DataFrame, stored: DataFrame, days: DataFrame) -> DataFrame:
    """(date, articles, added) for each of the days: its articles, and those that are new to the stored ones. Articles: (place, id, date)."""
    every = articles.groupBy("date").agg(F.count("*").alias("articles"))
    new = new_articles(articles, stored).groupBy("date").agg(F.count("*").alias("added"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return days.join(every, "date", "left").join(new, "date", "left").select("date", zero("articles"), zero("added"))


def storage_counts(**stores: DataFrame) -> DataFrame:
    """(store, rows) of the named tables."""
    out = None
    for name, df in stores.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def deleted_vectors(points: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points (file_id, ...) that stay, and (file_id, deleted): how many each deletion takes, 0 where a file has none."""
    n = gone.select("file_id").distinct().join(points.groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left")
    return points.join(gone.select("file_id").distinct(), "file_id", "left_anti"), n.select("file_id", F.coalesce("n", F.lit(0)).alias("deleted"))


def retries(documents: DataFrame, files: DataFrame, embedded: DataFrame) -> DataFrame:
    """(id, status, reason) of failed documents tried again: skipped without a path or file (path), failed with an error of embedding (id, error), else ingested. documents: (id, status, path)."""
    f = documents.where("status = 'failed'").select("id", "path")
    j = f.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").join(embedded, "id", "left")
    none, lost = F.coalesce("path", F.lit("")) == "", F.col("there").isNull()
    status = F.when(none | lost, "skipped").when(F.col("error").isNotNull(), "failed").otherwise("ingested")
    reason = F.when(none, "no path").when(lost, "file missing").otherwise(F.col("error"))
    return j.select("id", status.alias("status"), reason.alias("reason"))


def retry_counts(tried: DataFrame) -> DataFrame:
    return tried.agg(F.count_if(F.col("status") == "ingested").alias("recovered"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("still_failed"))


def expected_files(inputs: DataFrame, files: DataFrame, suffix: str = "_extracted_preprocessed.json") -> DataFrame:
    """(folder, name, path, there): what each input (folder, name) should have become, and whether that file is listed."""
    stem = F.trim(F.regexp_replace("name", r"\.[^.]*$", ""))
    want = inputs.select("folder", "name", F.concat(stem, F.lit(suffix)).alias("path"))
    return want.join(files.select("path").distinct().withColumn("listed", F.lit(True)), "path", "left").select("folder", "name", "path", F.coalesce("listed", F.lit(False)).alias("there"))


def folder_tallies(outcomes: DataFrame) -> DataFrame:
    """(folder, total, extract_ok, extract_fail, chunk_ok, chunk_fail) from (folder, extracted, chunked); what isn't extracted is never chunked."""
    e, c = F.coalesce("extracted", F.lit(False)), F.coalesce("chunked", F.lit(False))
    return outcomes.groupBy("folder").agg(F.count("*").alias("total"), F.count_if(e).alias("extract_ok"), F.count_if(~e).alias("extract_fail"), F.count_if(e & c).alias("chunk_ok"), F.count_if(e & ~c).alias("chunk_fail"))


def kept_figures(figures: DataFrame, least: int = 60, least_bytes: int = 3000) -> DataFrame:
    """Adds filename to the figures (doc_id, page_num, at, width, height, bytes, ext) that are no fragments; numbers run through a document. A size of 0 is unknown."""
    small = lambda c: (F.col(c) > 0) & (F.col(c) < least)
    f = figures.where(~(small("width") | small("height") | (F.col("bytes") < least_bytes)))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "at"))
    return f.withColumn("filename", F.format_string("fig_p%03d_%02d.%s", "page_num", n, "ext"))
