"""The registered read queries: each is a DataFrame plan over the domain, with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text, vector
from ..operators import filters, model, search, series, topics, upkeep, views
from ..sources.domain import SQL, Domain, day, dealt, moment
from . import artifacts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = datetime(2001, 1, 1)
EVENTS_AS_OF = datetime(2024, 1, 25)
GROUPS = ("1-URGENT", "2-HIGH")


def query(sql: str | None = None, with_domain: bool = True):
    """Registers a function of the domain under its name, and its SQL over the domain's views."""

    def register(f: Callable[[Domain], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = f"WITH {SQL} {sql}" if with_domain else sql
        return f

    return register


r6 = lambda c: F.round(c, 6)


@query("SELECT content_type, subreddit, count(*) AS n, sum(weight) AS weight FROM content GROUP BY 1, 2")
def content_union(d: Domain) -> DataFrame:
    return d.content.groupBy("content_type", "subreddit").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("SELECT strftime(timestamp, '%Y-%m-%d') AS date, subreddit, count(*) AS n FROM content WHERE timestamp >= TIMESTAMP '2000-12-02' GROUP BY 1, 2")
def daily_volume(d: Domain) -> DataFrame:
    return filters.recent(d.content, 30, AS_OF).groupBy(day("timestamp").alias("date"), "subreddit").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (content_type = 'post') AS total_posts, count(*) FILTER (content_type = 'comment') AS total_comments, strftime(max(timestamp), '%Y-%m-%d') AS last_day,
  count(DISTINCT subreddit) AS n_groups FROM content WHERE subreddit IN ('1-URGENT', '2-HIGH') AND timestamp >= TIMESTAMP '1996-01-01' AND timestamp < TIMESTAMP '1999-01-01'""")
def collection_summary(d: Domain) -> DataFrame:
    c = filters.between_days(filters.in_groups(d.content, GROUPS), "1996-01-01", "1998-12-31")
    kind = lambda k: F.count_if(F.col("content_type") == k)
    return c.agg(kind("post").alias("total_posts"), kind("comment").alias("total_comments"), day(F.max("timestamp")).alias("last_day"), F.countDistinct("subreddit").alias("n_groups"))


def _summary(d: Domain, weighted: bool) -> DataFrame:
    w = F.col("weight") if weighted else F.lit(1)
    total = F.sum(w)
    return d.content.groupBy("label").agg(F.count("*").alias("count"), total.cast("long").alias("weighted_count"), r6(F.sum(F.col("confidence") * w) / F.nullif(total, F.lit(0))).alias("mean_confidence")).withColumn("weighted", F.lit(weighted))


@query("SELECT label, count(*) AS count, count(*) AS weighted_count, round(sum(confidence) / count(*), 6) AS mean_confidence, false AS weighted FROM content GROUP BY label")
def sentiment_summary(d: Domain) -> DataFrame:
    return _summary(d, False)


@query("SELECT label, count(*) AS count, CAST(sum(weight) AS BIGINT) AS weighted_count, round(sum(confidence * weight) / nullif(sum(weight), 0), 6) AS mean_confidence, true AS weighted FROM content GROUP BY label")
def sentiment_summary_weighted(d: Domain) -> DataFrame:
    return _summary(d, True)


@query("SELECT subreddit, CAST(date AS VARCHAR) AS date, round(mean_score, 6) AS mean_score, CAST(pos_count AS BIGINT) AS pos_count, CAST(neu_count AS BIGINT) AS neu_count, CAST(neg_count AS BIGINT) AS neg_count FROM daily")
def sentiment_daily(d: Domain) -> DataFrame:
    return series.daily_sentiment(d.content).select("subreddit", day("date").alias("date"), r6("mean_score").alias("mean_score"), "pos_count", "neu_count", "neg_count")


@query("""SELECT subreddit, CAST(date AS VARCHAR) AS date, round(avg(mean_score) OVER (PARTITION BY subreddit ORDER BY date ROWS 6 PRECEDING), 6) AS rolling_7d,
  round(avg(mean_score) OVER (PARTITION BY subreddit ORDER BY date ROWS 29 PRECEDING), 6) AS rolling_30d FROM daily""")
def moving_avg(d: Domain) -> DataFrame:
    return series.trailing_means(series.daily_sentiment(d.content)).select("subreddit", day("date").alias("date"), r6("rolling_7d").alias("rolling_7d"), r6("rolling_30d").alias("rolling_30d"))


@query("""SELECT subreddit, CAST(date AS VARCHAR) AS date, round(mean_score, 6) AS mean_score, round(rolling_7d, 6) AS rolling_7d FROM (SELECT *, avg(mean_score) OVER (PARTITION BY subreddit ORDER BY date ROWS 6 PRECEDING) AS rolling_7d FROM daily)
  WHERE subreddit IN ('1-URGENT', '2-HIGH') AND date BETWEEN DATE '2000-10-03' AND DATE '2001-01-01'""")
def sentiment_daily_joined(d: Domain) -> DataFrame:
    daily = series.daily_sentiment(filters.in_groups(d.content, GROUPS))
    joined = daily.join(series.trailing_means(daily), ["subreddit", "date"], "left").where(F.col("date").between(F.lit("2000-10-03").cast("date"), F.lit("2001-01-01").cast("date")))
    return joined.select("subreddit", day("date").alias("date"), r6("mean_score").alias("mean_score"), r6("rolling_7d").alias("rolling_7d"))


@query("""SELECT subreddit, CAST(date AS VARCHAR) AS date, round(avg(mean_score) OVER (PARTITION BY subreddit ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
  - avg(mean_score) OVER (PARTITION BY subreddit ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS magnitude FROM daily""")
def change_magnitude(d: Domain) -> DataFrame:
    return series.shift_sizes(series.daily_sentiment(d.content)).select("subreddit", day("date").alias("date"), r6("magnitude").alias("magnitude"))


def _event_days(d: Domain) -> DataFrame:
    return d.table("events").groupBy(F.col("event_type").alias("subreddit"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("mean_score"))


@query()
def change_points(d: Domain) -> DataFrame:
    return series.change_points(_event_days(d), penalty=1.0).withColumn("magnitude", r6("magnitude"))


@query()
def forecast(d: Domain) -> DataFrame:
    return series.forecast(_event_days(d))


@query("SELECT topic_id, doc_count, array_to_string(keywords, ' ') AS keywords FROM topics WHERE topic_id <> -1 ORDER BY doc_count DESC, topic_id")
def topics_ranked(d: Domain) -> DataFrame:
    return d.topics.where("topic_id != -1").select("topic_id", "doc_count", F.array_join("keywords", " ").alias("keywords")).orderBy(F.desc("doc_count"), "topic_id")


def _over_time(d: Domain) -> DataFrame:
    return series.weekly_topics(d.assigned)


@query("""SELECT o.topic_id, o.doc_count, CAST(o.week_start AS VARCHAR) AS week_start FROM over_time o JOIN topics t USING (topic_id)
  WHERE o.week_start = (SELECT max(week_start) FROM over_time) AND o.topic_id <> -1 ORDER BY o.doc_count DESC, o.topic_id LIMIT 3""")
def trending_topics(d: Domain) -> DataFrame:
    weeks = _over_time(d)
    last = weeks.agg(F.max("week_start").alias("week_start"))
    now = weeks.join(F.broadcast(last), "week_start").join(d.topic_sizes.select("topic_id"), "topic_id").where("topic_id != -1")
    return now.select("topic_id", "doc_count", day("week_start").alias("week_start")).orderBy(F.desc("doc_count"), "topic_id").limit(3)


@query("SELECT topic_id, count(*) AS doc_count FROM assigned WHERE topic_id <> -1 AND timestamp >= DATE '2024-03-24' GROUP BY topic_id ORDER BY doc_count DESC, topic_id")
def emerging_topics(d: Domain) -> DataFrame:
    new = filters.recent(d.assigned.where("topic_id != -1"), 7, datetime(2024, 3, 31).date())
    return new.groupBy("topic_id").agg(F.count("*").alias("doc_count")).orderBy(F.desc("doc_count"), "topic_id")


@query("SELECT topic_id, CAST(week_start AS VARCHAR) AS week_start, doc_count, round(avg_sentiment, 6) AS avg_sentiment FROM over_time ORDER BY topic_id, week_start")
def topic_over_time(d: Domain) -> DataFrame:
    return _over_time(d).select("topic_id", day("week_start").alias("week_start"), "doc_count", r6("avg_sentiment").alias("avg_sentiment")).orderBy("topic_id", "week_start")


def _heatmap(d: Domain, n: int) -> DataFrame:
    top = d.topic_sizes.where("topic_id != -1").orderBy(F.desc("doc_count"), "topic_id").limit(n).select("topic_id")
    return _over_time(d).join(top, "topic_id", "left_semi").select("topic_id", day("week_start").alias("week_start"), r6("avg_sentiment").alias("avg_sentiment")).orderBy("topic_id", "week_start")


@query("""SELECT topic_id, CAST(week_start AS VARCHAR) AS week_start, round(avg_sentiment, 6) AS avg_sentiment FROM over_time
  WHERE topic_id IN (SELECT topic_id FROM topics WHERE topic_id <> -1 ORDER BY doc_count DESC, topic_id LIMIT 5) ORDER BY 1, 2""")
def topic_heatmap(d: Domain) -> DataFrame:
    return _heatmap(d, 5)


@query("""SELECT topic_id, CAST(week_start AS VARCHAR) AS week_start, round(avg_sentiment, 6) AS avg_sentiment FROM over_time
  WHERE topic_id IN (SELECT topic_id FROM topics WHERE topic_id <> -1 ORDER BY doc_count DESC, topic_id LIMIT 30) ORDER BY 1, 2""")
def topic_heatmap_top30(d: Domain) -> DataFrame:
    """The reference's default number of topics."""
    return _heatmap(d, 30)


@query("""SELECT topic_id, """ + ", ".join(f"""round(max(CASE WHEN week_start = DATE '2024-01-01' + {7 * k} THEN avg_sentiment END), 6) AS week_{k}""" for k in range(12)) + """ FROM over_time WHERE topic_id <> -1 GROUP BY topic_id""")
def topic_heatmap_pivot(d: Domain) -> DataFrame:
    weeks = _over_time(d).where("topic_id != -1").withColumn("week", (F.datediff("week_start", F.lit("2024-01-01").cast("date")) / 7).cast("int"))
    return weeks.groupBy("topic_id").pivot("week", list(range(12))).agg(r6(F.first("avg_sentiment"))).select("topic_id", *(F.col(f"`{k}`").alias(f"week_{k}") for k in range(12)))


@query(""", placed AS (SELECT week_start, row_number() OVER (ORDER BY week_start) - 1 AS place FROM (SELECT DISTINCT week_start FROM over_time WHERE topic_id <> -1 ORDER BY week_start DESC LIMIT 12))
  SELECT topic_id, """ + ", ".join(f"round(max(CASE WHEN place = {k} THEN avg_sentiment END), 6) AS week_{k}" for k in range(12)) + """ FROM over_time LEFT JOIN placed USING (week_start) WHERE topic_id <> -1 GROUP BY topic_id""")
def topic_heatmap_last_weeks(d: Domain) -> DataFrame:
    """The last 12 weeks present; topic_heatmap_pivot has the 12 from 2024-01-01."""
    return views.last_weeks(_over_time(d).where("topic_id != -1").withColumn("avg_sentiment", r6("avg_sentiment")), "avg_sentiment")


@query("SELECT topic_id, CAST(timestamp AS VARCHAR) AS date, round(m, 6) AS mean_sentiment, round(avg(m) OVER (PARTITION BY topic_id ORDER BY timestamp ROWS 6 PRECEDING), 6) AS rolling_7d FROM (SELECT topic_id, timestamp, avg(CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END) AS m FROM assigned WHERE topic_id <> -1 AND label IS NOT NULL GROUP BY 1, 2)")
def topic_sentiment_trends(d: Domain) -> DataFrame:
    return series.topic_trend(d.assigned).select("topic_id", day("date").alias("date"), r6("mean_sentiment").alias("mean_sentiment"), r6("rolling_7d").alias("rolling_7d"))


def _nodes(d: Domain) -> DataFrame:
    return d.topics.where("topic_id != -1").orderBy(F.desc("doc_count"), "topic_id").limit(50).select("topic_id", "doc_count", text.keywords(F.to_json("keywords")).alias("terms"))


STOP = "', '".join(text.GRAPH_STOPWORDS)
NODES = f"nodes AS (SELECT topic_id, doc_count, list_filter(keywords, lambda x: x NOT IN ('{STOP}')) AS terms FROM topics WHERE topic_id <> -1 ORDER BY doc_count DESC, topic_id LIMIT 50)"


@query(f", {NODES} SELECT topic_id, doc_count, array_to_string(terms, ' ') AS terms FROM nodes")
def topic_graph_nodes(d: Domain) -> DataFrame:
    return _nodes(d).select("topic_id", "doc_count", F.array_join("terms", " ").alias("terms"))


@query(f""", {NODES}, pairs AS (SELECT a.topic_id AS source, b.topic_id AS target, len(list_intersect(a.terms, b.terms)) AS c, len(a.terms) AS x, len(b.terms) AS y, list_sort(list_intersect(a.terms, b.terms)) AS s FROM nodes a JOIN nodes b ON a.topic_id < b.topic_id)
  SELECT source, target, round(c / (x + y - c), 4) AS similarity, array_to_string(s, ' ') AS shared FROM pairs WHERE c > 0 AND c / (x + y - c) >= 0.15""")
def topic_graph_edges(d: Domain) -> DataFrame:
    return topics.similarity_edges(_nodes(d), 0.15).withColumn("shared", F.array_join("shared", " "))


@query("""SELECT a.topic_id, count(*) AS doc_count FROM assigned a WHERE a.topic_id <> -1 AND a.subreddit IN ('src1', 'src2') GROUP BY a.topic_id""")
def topic_graph_by_group(d: Domain) -> DataFrame:
    return filters.in_groups(d.assigned.where("topic_id != -1"), ("src1", "src2")).groupBy("topic_id").agg(F.count("*").alias("doc_count"))


@query("""SELECT d.id, d.subreddit, CAST(d.timestamp AS VARCHAR) AS date, p.label, substring(d.text, 1, 220) AS text_preview FROM docs d JOIN predictions p USING (id)
  WHERE contains(lower(d.text), 'the') AND p.label = 'positive' AND d.timestamp >= DATE '2024-01-10' AND d.timestamp < DATE '2024-03-01' ORDER BY d.timestamp DESC, d.id LIMIT 20 OFFSET 10""")
def deep_dive(d: Domain) -> DataFrame:
    found = filters.between_days(d.documents, "2024-01-10", "2024-02-29").where(filters.holds_any(["the"], "text")).join(d.predictions.where("label = 'positive'"), "id")
    rows = filters.page(found, F.desc("timestamp"), F.asc("id"), limit=20, offset=10)
    return rows.select("id", "subreddit", day("timestamp").alias("date"), "label", text.preview(F.col("text"), 220).alias("text_preview"))


@query("SELECT subreddit, round(avg(confidence), 6) AS mean_confidence, count(*) AS total, CAST(sum(CASE WHEN confidence < 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS low_confidence FROM content GROUP BY 1")
def confidence_by_group(d: Domain) -> DataFrame:
    return d.content.groupBy("subreddit").agg(r6(F.avg("confidence")).alias("mean_confidence"), F.count("*").alias("total"), F.sum(F.when(F.col("confidence") < 0.6, 1).otherwise(0)).alias("low_confidence"))


@query("SELECT id, subreddit, label, confidence FROM posts ORDER BY confidence, id LIMIT 50")
def low_confidence(d: Domain) -> DataFrame:
    return d.posts.select("id", "subreddit", "label", "confidence").orderBy("confidence", "id").limit(50)


@query("SELECT CAST(least(floor(confidence * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM content GROUP BY 1")
def confidence_histogram(d: Domain) -> DataFrame:
    return d.content.groupBy(F.least(F.floor(F.col("confidence") * 20), F.lit(19)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT content_type, round(avg(CASE WHEN confidence >= 0.75 THEN 1.0 ELSE 0.0 END), 6) AS share FROM content GROUP BY 1")
def high_confidence_share(d: Domain) -> DataFrame:
    return d.content.groupBy("content_type").agg(r6(F.avg((F.col("confidence") >= 0.75).cast("double"))).alias("share"))


def _listed(rows: dict[str, float]) -> str:
    return ", ".join(f"('{word.replace(chr(39), chr(39) * 2)}', {value})" for word, value in rows.items())


def _scored_sql(source: str) -> str:
    """The lexicon's rules over source(id, text) as views of SQL, the last of them lexicon(id, compound)."""
    step = "({s} + sign({s}) * coalesce(b.boost, 0) * {fade}) * CASE WHEN lower(h.w[h.i - {back}]) IN (SELECT word FROM negations) AND h.i > {back} THEN {turn} ELSE 1.0 END"
    out = f"""valences(word, v) AS (VALUES {_listed(lexicon.VALENCE)}), boosts(word, boost) AS (VALUES {_listed(lexicon.BOOST)}), negations(word) AS (VALUES {", ".join("('" + w.replace("'", "''") + "')" for w in sorted(lexicon.NEGATION))}),
  worded AS (SELECT id, text, regexp_extract_all(coalesce(text, ''), '[A-Za-z'']+') AS w FROM {source}),
  loud AS (SELECT *, len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS up FROM worded),
  places AS (SELECT id, w, up > 0 AND up < len(w) AS loud, unnest(range(1, len(w) + 1)) AS i FROM loud),
  hit0 AS (SELECT h.*, v.v + CASE WHEN h.loud AND h.w[h.i] = upper(h.w[h.i]) AND h.w[h.i] <> lower(h.w[h.i]) AND length(h.w[h.i]) > 1 THEN sign(v.v) * {lexicon.CAPITALS} ELSE 0 END AS s FROM places h JOIN valences v ON v.word = lower(h.w[h.i]))"""
    for k, (back, fade) in enumerate(lexicon.FADE):
        out += f""",
  hit{k + 1} AS (SELECT h.id, h.w, h.loud, h.i, {step.format(s="h.s", fade=fade, back=back, turn=lexicon.REVERSAL)} AS s FROM hit{k} h LEFT JOIN boosts b ON h.i > {back} AND b.word = lower(h.w[h.i - {back}]))"""
    return (
        out
        + f""",
  summed AS (SELECT id, sum(s) AS s FROM hit{len(lexicon.FADE)} GROUP BY id),
  marked AS (SELECT w.id, CASE WHEN s.s <> 0 THEN s.s + sign(s.s) * least(length(w.text) - length(replace(w.text, '!', '')), 4) * {lexicon.MARK} ELSE 0 END AS s FROM worded w LEFT JOIN summed s USING (id)),
  lexicon AS (SELECT id, s / sqrt(s * s + {lexicon.SCALE}) AS compound FROM marked)"""
    )


def _agreement(d: Domain) -> DataFrame:
    both = lexicon.with_compound(dealt(d.documents).join(d.predictions, "id"), "text")
    return both.withColumn("lexicon_sign", lexicon.sign(F.col("compound"))).withColumn("model_sign", series.score_of(F.col("label")))


SIGNS = """CASE WHEN compound > 0.05 THEN 1 WHEN compound < -0.05 THEN -1 ELSE 0 END AS lexicon_sign, CASE label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS model_sign"""


@query(f""", labelled AS (SELECT d.*, p.label, p.confidence FROM docs d JOIN predictions p USING (id)), {_scored_sql("labelled")}, signs AS (SELECT l.*, {SIGNS} FROM labelled l JOIN lexicon USING (id))
  SELECT subreddit, round(avg(CASE WHEN lexicon_sign = model_sign THEN 1.0 ELSE 0.0 END), 6) AS agreement_rate, count(*) AS total FROM signs WHERE subreddit IS NOT NULL GROUP BY 1""")
def lexicon_agreement(d: Domain) -> DataFrame:
    agree = (F.col("lexicon_sign") == F.col("model_sign")).cast("double")
    return _agreement(d).where("subreddit is not null").groupBy("subreddit").agg(r6(F.avg(agree)).alias("agreement_rate"), F.count("*").alias("total"))


@query(f""", labelled AS (SELECT d.*, p.label, p.confidence FROM docs d JOIN predictions p USING (id) ORDER BY d.timestamp DESC, d.id LIMIT 5000), {_scored_sql("labelled")}, signs AS (SELECT l.*, compound, {SIGNS} FROM labelled l JOIN lexicon USING (id))
  SELECT id, subreddit, label, CASE lexicon_sign WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS lexicon_label, confidence, substring(text, 1, 220) AS text_preview FROM signs WHERE lexicon_sign <> model_sign ORDER BY confidence DESC, id LIMIT 50""")
def lexicon_disagreements(d: Domain) -> DataFrame:
    """Of the latest 5,000 scored texts, the 50 of most confidence that the lexicon judges otherwise."""
    latest = d.documents.join(d.predictions, "id").orderBy(F.desc("timestamp"), "id").limit(5000)
    scored = lexicon.with_compound(latest, "text")
    apart = scored.where(lexicon.sign(F.col("compound")) != series.score_of(F.col("label")))
    return apart.orderBy(F.desc("confidence"), "id").limit(50).select("id", "subreddit", "label", lexicon.sign_label(F.col("compound")).alias("lexicon_label"), "confidence", text.preview(F.col("text"), 220).alias("text_preview"))


@query(f", {_scored_sql('docs')} SELECT id, round(compound, 6) AS compound FROM lexicon")
def lexicon_scores(d: Domain) -> DataFrame:
    return lexicon.with_compound(dealt(d.documents), "text").select("id", r6("compound").alias("compound"))


@query("SELECT DISTINCT subreddit FROM content WHERE subreddit IS NOT NULL AND subreddit <> '' ORDER BY 1")
def known_groups(d: Domain) -> DataFrame:
    return d.content.select("subreddit").distinct().where("subreddit is not null and subreddit != ''").orderBy("subreddit")


@query("SELECT strftime(min(timestamp), '%Y-%m-%d') AS start, strftime(max(timestamp), '%Y-%m-%d') AS \"end\" FROM content")
def date_range(d: Domain) -> DataFrame:
    first, last = F.min("timestamp"), F.max("timestamp")
    now = F.current_date()
    return d.content.agg(F.coalesce(day(first), day(F.date_sub(now, 30))).alias("start"), F.coalesce(day(last), day(now)).alias("end"))


CLEAN = "coalesce(text, '')"
for _pattern, _by in text.MARKUP:
    _flags = "gm" if _pattern.startswith("(?m)") else "g"
    CLEAN = f"regexp_replace({CLEAN}, '{_pattern.removeprefix('(?m)')}', '{_by.replace('$', chr(92))}', '{_flags}')"
CLEAN = f"trim(regexp_replace(lower({CLEAN}), '\\s+', ' ', 'g'))"
CLEANED = f", cleaned AS (SELECT id, author, {CLEAN} AS clean_text FROM docs)"
TOKENS = "CASE WHEN clean_text = '' THEN 0 ELSE len(string_split(clean_text, ' ')) END"


def _prepared(d: Domain) -> DataFrame:
    c = dealt(d.documents).select("id", "author", text.clean(text.raw_text(F.lit(None).cast("string"), F.col("text"))).alias("clean_text"))
    return c.withColumn("token_count", text.token_count(F.col("clean_text")))


@query(f"{CLEANED} SELECT id, md5(clean_text) AS digest, length(clean_text) AS n FROM cleaned")
def text_clean(d: Domain) -> DataFrame:
    return _prepared(d).select("id", F.md5("clean_text").alias("digest"), F.length("clean_text").cast("long").alias("n"))


@query(f"{CLEANED} SELECT id, CAST({TOKENS} AS BIGINT) AS token_count FROM cleaned")
def token_count(d: Domain) -> DataFrame:
    return _prepared(d).select("id", F.col("token_count").cast("long").alias("token_count"))


@query(f"""{CLEANED}, t AS (SELECT *, {TOKENS} AS n FROM cleaned) SELECT CASE WHEN author IS NULL OR author = '' OR regexp_matches(lower(author), 'bot$|automoderator|automod|\\[deleted\\]|\\[removed\\]') THEN 'bot'
  WHEN n = 0 THEN 'empty' WHEN n < 10 THEN 'too_short' ELSE 'kept' END AS reason, count(*) AS n FROM t GROUP BY 1""")
def filter_reason(d: Domain) -> DataFrame:
    reason = F.coalesce(text.filter_reason(F.col("author"), F.col("token_count")), F.lit("kept"))
    return _prepared(d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT author, count(*) AS n FROM docs WHERE regexp_matches(lower(author), 'bot$|automoderator|automod') GROUP BY 1")
def is_bot(d: Domain) -> DataFrame:
    return d.documents.where(text.is_bot(F.col("author"))).groupBy("author").agg(F.count("*").alias("n"))


@query("SELECT d.id, d.subreddit FROM docs d WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.id = d.id)")
def unprocessed_anti(d: Domain) -> DataFrame:
    return filters.unprocessed(d.documents, d.predictions, "id").select("id", "subreddit")


@query("SELECT count(*) AS n FROM docs d WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.id = d.id)")
def unscored_not_exists(d: Domain) -> DataFrame:
    return filters.unprocessed(d.documents, d.predictions, "id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)", with_domain=False)
def orphans(d: Domain) -> DataFrame:
    return upkeep.orphans(d.table("orders").select(F.col("o_orderkey").alias("id")), d.table("lineitem"), "id", "l_orderkey")


QUESTION = "and the"


@query(f""", t AS (SELECT id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS w, ['and', 'the'] AS q FROM docs),
  s AS (SELECT id, len(list_intersect(w, q)) / (len(w) + 2 - len(list_intersect(w, q))) AS o, contains(lower(text), '{QUESTION}') AS ph FROM t)
  SELECT id, round(CASE WHEN ph THEN greatest(o, 0.25) ELSE o END, 4) AS score FROM s WHERE ph OR o > 0 ORDER BY score DESC, id LIMIT 25""")
def lexical_search(d: Domain) -> DataFrame:
    return search.lexical_search(dealt(d.documents), QUESTION, 25)


@query("""SELECT e.id, round(greatest(list_cosine_similarity(CAST(e.v AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 0), 4) AS score FROM (SELECT vec_id AS id, embedding AS v FROM embeddings) e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 20""", with_domain=False)
def vector_search(d: Domain) -> DataFrame:
    probe = d.vectors.where("id = 0").first()["vector"]
    return search.vector_search(d.vectors, probe, 20)


@query("""SELECT query_id, id, score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM (SELECT q.vec_id AS query_id, e.vec_id AS id,
  round(greatest(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 0), 4) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE k <= 10""", with_domain=False)
def vector_search_many(d: Domain) -> DataFrame:
    """Every vector whose id is divisible by 100, against all vectors."""
    return search.vector_search_many(d.vectors, d.vectors.where("id % 100 = 0"))


@query(f"SELECT id, 0.25 AS score FROM docs WHERE contains(lower(text), '{QUESTION}') ORDER BY id LIMIT 25")
def phrase_search(d: Domain) -> DataFrame:
    return search.phrase_search(d.documents, QUESTION, 25)


SHOWN = "SELECT f.id, f.score, f.algorithm, f.state, d.subreddit, CAST(d.timestamp AS VARCHAR) AS date, p.label, substring(coalesce(d.text, ''), 1, 240) AS text_preview FROM found f JOIN docs d USING (id) LEFT JOIN predictions p USING (id)"


def _shown(d: Domain, found: DataFrame) -> DataFrame:
    return search.detailed(found, d.documents, d.predictions).select("id", "score", "algorithm", "state", "subreddit", day("date").alias("date"), "label", "text_preview")


@query(f""", q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), found AS (SELECT e.vec_id AS id, round(greatest(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 0), 4) AS score, 'vector_cosine' AS algorithm, 'ready' AS state
  FROM embeddings e, q WHERE e.vec_id IN (SELECT id FROM docs) ORDER BY 2 DESC, 1 LIMIT 50) {SHOWN}""")
def semantic_search(d: Domain) -> DataFrame:
    """The ladder with an encoder at hand (it gives the vector of row 0): vectors decide."""
    return _shown(d, search.semantic_search(d.documents, QUESTION, vectors=d.vectors, encode=lambda _: d.vectors.where("id = 0").first()["vector"]))


@query(f""", t AS (SELECT id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS w, ['and', 'the'] AS q FROM docs),
  s AS (SELECT id, len(list_intersect(w, q)) / (len(w) + 2 - len(list_intersect(w, q))) AS o, contains(lower(text), '{QUESTION}') AS ph FROM t),
  found AS (SELECT id, round(CASE WHEN ph THEN greatest(o, 0.25) ELSE o END, 4) AS score, 'lexical_overlap_fallback' AS algorithm, 'missing_config' AS state FROM s WHERE ph OR o > 0 ORDER BY score DESC, id LIMIT 50) {SHOWN}""")
def semantic_search_without_vectors(d: Domain) -> DataFrame:
    """The ladder where no encoder is configured: words that overlap."""
    return _shown(d, search.semantic_search(dealt(d.documents), QUESTION))


@query(f", found AS (SELECT id, 0.25 AS score, 'like_fallback' AS algorithm, 'error' AS state FROM docs WHERE contains(lower(text), '{QUESTION}') ORDER BY id LIMIT 50) {SHOWN}")
def semantic_search_after_an_error(d: Domain) -> DataFrame:
    """The ladder where the encoder fails: the phrase."""

    def broken(_: str) -> list[float]:
        raise OSError("no encoder")

    return _shown(d, search.semantic_search(d.documents, QUESTION, vectors=d.vectors, encode=broken))


@query("""SELECT e.vec_id AS id, coalesce(a.topic_id, -1) AS topic_id, d.subreddit, p.label, substring(coalesce(d.text, ''), 1, 120) AS preview FROM embeddings e LEFT JOIN assignments a ON a.id = e.vec_id
  LEFT JOIN docs d ON d.id = e.vec_id LEFT JOIN predictions p ON p.id = e.vec_id""")
def embedding_map(d: Domain) -> DataFrame:
    m = d.vectors.select("id").join(d.assignments, "id", "left").join(d.documents, "id", "left").join(d.predictions, "id", "left")
    return m.select("id", F.coalesce("topic_id", F.lit(-1)).alias("topic_id"), "subreddit", "label", text.preview(F.col("text"), 120).alias("preview"))


@query()
def embedding_project_2d(d: Domain) -> DataFrame:
    return vector.projected(d.vectors).select("id", r6("x").alias("x"), r6("y").alias("y"))


@query("""SELECT post_id, count(*) AS n, round(abs(sum(CASE WHEN label = 'positive' THEN 1 ELSE 0 END) - sum(CASE WHEN label = 'negative' THEN 1 ELSE 0 END)) / greatest(count(*), 1), 6) AS spread,
  round(least(sum(CASE WHEN label = 'positive' THEN 1 ELSE 0 END), sum(CASE WHEN label = 'negative' THEN 1 ELSE 0 END)) / greatest(count(*), 1), 6) AS controversy FROM comments GROUP BY 1""")
def thread_analysis(d: Domain) -> DataFrame:
    pos, neg = (F.sum(F.when(F.col("label") == x, 1).otherwise(0)) for x in ("positive", "negative"))
    n = F.greatest(F.count("*"), F.lit(1))
    return d.comments.groupBy("post_id").agg(F.count("*").alias("n"), r6(F.abs(pos - neg) / n).alias("spread"), r6(F.least(pos, neg) / n).alias("controversy"))


@query("""SELECT post_id, id, upvotes FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY upvotes DESC, id, timestamp, author, confidence, label) AS k FROM comments) WHERE k <= 5""")
def thread_top_comments(d: Domain) -> DataFrame:
    order = (F.desc("upvotes"), F.asc("id"), F.asc("timestamp"), F.asc("author"), F.asc("confidence"), F.asc("label"))
    return filters.first_rows(d.comments, ["post_id"], *order, n=5).select("post_id", "id", "upvotes")


EVENTS = """, shifts AS (SELECT subreddit, date, round(avg(mean_score) OVER (PARTITION BY subreddit ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) - avg(mean_score) OVER (PARTITION BY subreddit ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS magnitude FROM daily),
  narrative AS (SELECT subreddit, date, magnitude FROM shifts WHERE magnitude IS NOT NULL ORDER BY abs(magnitude) DESC, subreddit, date LIMIT 20)"""


def _narrative(d: Domain) -> DataFrame:
    shifts = series.shift_sizes(series.daily_sentiment(d.content)).withColumn("magnitude", r6("magnitude")).where("magnitude is not null")
    return shifts.orderBy(F.desc(F.abs("magnitude")), "subreddit", "date").limit(20)


@query(f"""{EVENTS} SELECT subreddit, CAST(date AS VARCHAR) AS peak_date, abs(magnitude) AS peak_anomaly_score, magnitude AS sentiment_delta,
  CASE WHEN magnitude >= 0 THEN 'Positive' ELSE 'Negative' END || ' sentiment shift in r/' || subreddit AS auto_label, CASE WHEN abs(magnitude) >= 1 THEN 'high' WHEN abs(magnitude) >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM narrative""")
def narrative_events(d: Domain) -> DataFrame:
    size = F.abs("magnitude")
    label = F.concat(F.when(F.col("magnitude") >= 0, "Positive").otherwise("Negative"), F.lit(" sentiment shift in r/"), "subreddit")
    severity = F.when(size >= 1, "high").when(size >= 0.5, "medium").otherwise("low")
    return _narrative(d).select("subreddit", day("date").alias("peak_date"), size.alias("peak_anomaly_score"), F.col("magnitude").alias("sentiment_delta"), label.alias("auto_label"), severity.alias("severity"))


@query(f"""{EVENTS} SELECT subreddit, CAST(date AS VARCHAR) AS date, id FROM (SELECT n.subreddit, n.date, p.id, row_number() OVER (PARTITION BY n.subreddit, n.date ORDER BY p.upvotes + p.num_comments DESC, p.id) AS k
  FROM narrative n JOIN posts p ON p.subreddit = n.subreddit AND CAST(p.timestamp AS DATE) = n.date) WHERE k <= 3""")
def event_top_posts(d: Domain) -> DataFrame:
    posts = d.posts.withColumn("date", F.to_date("timestamp")).join(F.broadcast(_narrative(d).select("subreddit", "date")), ["subreddit", "date"])
    return filters.first_rows(posts, ["subreddit", "date"], F.desc(F.col("upvotes") + F.col("num_comments")), F.asc("id"), n=3).select("subreddit", day("date").alias("date"), "id")


@query("""SELECT subreddit, CAST(timestamp AS VARCHAR) AS date, a.topic_id, count(*) AS n FROM assigned a WHERE a.topic_id >= 0 GROUP BY 1, 2, 3""")
def event_terms(d: Domain) -> DataFrame:
    return d.assigned.where("topic_id >= 0").groupBy("subreddit", day("timestamp").alias("date"), "topic_id").agg(F.count("*").alias("n"))


@query("SELECT subreddit, count(*) AS post_count, round(avg(upvotes), 6) AS avg_upvotes, round(avg(num_comments), 6) AS avg_comments, strftime(max(timestamp), '%Y-%m-%d') AS latest_post FROM posts GROUP BY 1")
def group_stats(d: Domain) -> DataFrame:
    return upkeep.group_stats(d.posts).select("subreddit", "post_count", r6("avg_upvotes").alias("avg_upvotes"), r6("avg_comments").alias("avg_comments"), day("latest_post").alias("latest_post"))


@query("SELECT (SELECT count(*) FROM posts) AS total_posts, (SELECT count(*) FROM comments) AS total_comments, (SELECT count(DISTINCT subreddit) FROM posts) AS unique_groups, (SELECT strftime(min(timestamp), '%Y-%m-%d') FROM posts) AS earliest, (SELECT strftime(max(timestamp), '%Y-%m-%d') FROM posts) AS latest")
def data_summary(d: Domain) -> DataFrame:
    p = d.posts.agg(F.count("*").alias("total_posts"), F.countDistinct("subreddit").alias("unique_groups"), day(F.min("timestamp")).alias("earliest"), day(F.max("timestamp")).alias("latest"))
    return p.crossJoin(d.comments.agg(F.count("*").alias("total_comments"))).select("total_posts", "total_comments", "unique_groups", "earliest", "latest")


@query("SELECT strftime(timestamp, '%Y-%m') AS month, content_type, count(*) AS n FROM content GROUP BY 1, 2")
def monthly_counts(d: Domain) -> DataFrame:
    return d.content.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month"), "content_type").agg(F.count("*").alias("n"))


@query("SELECT subreddit, count(*) AS total, count(*) FILTER (timestamp >= TIMESTAMP '2000-12-25') AS last_week FROM content GROUP BY 1")
def detailed_stats(d: Domain) -> DataFrame:
    return d.content.groupBy("subreddit").agg(F.count("*").alias("total"), F.count_if(F.col("timestamp") >= F.lit(datetime(2000, 12, 25))).alias("last_week"))


@query("SELECT count(*) - count(DISTINCT id) AS by_id, count(*) - count(DISTINCT post_id || author || CAST(upvotes AS VARCHAR)) AS by_content FROM comments")
def duplicate_stats(d: Domain) -> DataFrame:
    return upkeep.duplicate_counts(d.comments, "id").select(F.col("duplicates").alias("by_id")).crossJoin(upkeep.duplicate_counts(d.comments, "post_id", "author", "upvotes").select(F.col("duplicates").alias("by_content")))


ORDERED = "timestamp DESC, author DESC, upvotes DESC, label DESC, confidence DESC"


@query(f"SELECT id, author, upvotes, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {ORDERED}) AS k FROM comments) WHERE k = 1")
def dedup_keep_latest(d: Domain) -> DataFrame:
    order = [F.desc(c) for c in ("timestamp", "author", "upvotes", "label", "confidence")]
    return filters.first_rows(d.comments, ["id"], *order).select("id", "author", "upvotes", "label")


@query("SELECT post_id, author, min(id) AS first_id, count(*) AS copies FROM comments GROUP BY 1, 2")
def dedup_keep_first(d: Domain) -> DataFrame:
    return upkeep.first_of_copies(d.comments, ["post_id", "author"], "id")


@query("SELECT id, title, subreddit, upvotes FROM posts WHERE subreddit = '1-URGENT' AND (contains(lower(title), '77') OR contains(lower(title), '99')) ORDER BY timestamp DESC, id LIMIT 30")
def query_posts(d: Domain) -> DataFrame:
    rows = filters.in_groups(d.posts, ("1-URGENT",)).where(filters.holds_any(["77", "99"], "title"))
    return rows.orderBy(F.desc("timestamp"), "id").limit(30).select("id", "title", "subreddit", "upvotes")


@query("SELECT id, author, upvotes FROM comments WHERE post_id = 'p1' ORDER BY upvotes DESC, id, author LIMIT 100")
def query_comments(d: Domain) -> DataFrame:
    return d.comments.where("post_id = 'p1'").orderBy(F.desc("upvotes"), "id", "author").limit(100).select("id", "author", "upvotes")


@query("SELECT id FROM posts WHERE subreddit = '2-HIGH' AND timestamp BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
def existing_ids_timeframe(d: Domain) -> DataFrame:
    return filters.in_groups(d.posts, ("2-HIGH",)).where(F.col("timestamp").between(F.lit(datetime(1997, 1, 1)), F.lit(datetime(1997, 6, 30)))).select("id")


@query("""SELECT w.subreddit, strftime(b.last, '%Y-%m-%d %H:%M:%S') AS last_collection, b.last IS NOT NULL AS completed FROM (SELECT DISTINCT subreddit FROM batches) w LEFT JOIN
  (SELECT subreddit, max(collection_timestamp) AS last FROM batches WHERE batch_status = 'completed' AND collection_timestamp >= TIMESTAMP '2024-01-24' GROUP BY 1) b USING (subreddit)""")
def resume_state(d: Domain) -> DataFrame:
    state = upkeep.resume_state(d.batches.select("subreddit"), d.batches, EVENTS_AS_OF)
    return state.select("subreddit", moment("last_collection").alias("last_collection"), "completed")


@query("SELECT count(*) AS collections, CAST(coalesce(sum(posts_collected), 0) AS BIGINT) AS total_posts, CAST(coalesce(sum(comments_collected), 0) AS BIGINT) AS total_comments, round(coalesce(avg(posts_collected), 0), 6) AS avg_posts, round(coalesce(avg(comments_collected), 0), 6) AS avg_comments FROM batches")
def efficiency_stats(d: Domain) -> DataFrame:
    e = upkeep.efficiency(d.batches)
    return e.select("collections", "total_posts", "total_comments", r6("avg_posts").alias("avg_posts"), r6("avg_comments").alias("avg_comments"))


@query("SELECT batch_id, subreddit, batch_status FROM batches ORDER BY collection_timestamp DESC, batch_id LIMIT 40")
def batch_history(d: Domain) -> DataFrame:
    return d.batches.orderBy(F.desc("collection_timestamp"), "batch_id").limit(40).select("batch_id", "subreddit", "batch_status")


@query("SELECT batch_id, subreddit FROM batches WHERE batch_status = 'failed' AND collection_timestamp >= TIMESTAMP '2024-01-24'")
def failed_batches(d: Domain) -> DataFrame:
    return filters.recent(d.batches.where("batch_status = 'failed'"), 1, EVENTS_AS_OF, "collection_timestamp").select("batch_id", "subreddit")


@query("SELECT subreddit, strftime(max(collection_timestamp), '%Y-%m-%d %H:%M:%S') AS last FROM batches GROUP BY 1")
def last_collection(d: Domain) -> DataFrame:
    return d.batches.groupBy("subreddit").agg(moment(F.max("collection_timestamp")).alias("last"))


@query("SELECT id, subreddit, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM docs")
def upsert_merge(d: Domain) -> DataFrame:
    old = d.documents.select("id", "subreddit", F.lit("old").alias("version"))
    return upkeep.upserted(old, old.where("id % 3 = 0").withColumn("version", F.lit("new")), ["id"])


@query("SELECT side, count(*) AS n FROM (SELECT CASE WHEN subreddit IN ('1-URGENT', '2-HIGH') OR subreddit IS NULL THEN 'stays' ELSE 'moves' END AS side FROM posts) GROUP BY 1")
def split_complement(d: Domain) -> DataFrame:
    stays, moves = upkeep.split_by_group(d.posts, list(GROUPS))
    return stays.select(F.lit("stays").alias("side")).union(moves.select(F.lit("moves").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT content_type, count(*) AS n FROM content WHERE timestamp >= TIMESTAMP '2000-01-01' OR timestamp IS NULL GROUP BY 1")
def retention_delete(d: Domain) -> DataFrame:
    return upkeep.retained(d.content, datetime(2000, 1, 1)).groupBy("content_type").agg(F.count("*").alias("n"))


@query(f", {_scored_sql('docs')} SELECT CASE WHEN compound > 0.5 THEN 'positive' WHEN compound < -0.5 THEN 'negative' ELSE 'neutral' END AS label, count(*) AS n FROM lexicon WHERE abs(compound) > 0.5 OR abs(compound) < 0.1 GROUP BY 1")
def weak_labels(d: Domain) -> DataFrame:
    scored = lexicon.with_compound(dealt(d.documents), "text").select(lexicon.weak_label(F.col("compound")).alias("label"))
    # the undecided go after they were counted: a test before would be pushed down to the texts, which would be scored for it once more
    return scored.groupBy("label").agg(F.count("label").alias("n")).where("n > 0")


@query("""SELECT l.label, round(CASE WHEN s > 0 THEN tp / s ELSE 0.0 END, 6) AS precision, round(CASE WHEN r > 0 THEN tp / r ELSE 0.0 END, 6) AS recall, round(CASE WHEN s + r > 0 THEN 2 * tp / (s + r) ELSE 0.0 END, 6) AS f1, r AS support FROM (
  SELECT x.label, count(*) FILTER (a = x.label AND b = x.label) AS tp, count(*) FILTER (a = x.label) AS r, count(*) FILTER (b = x.label) AS s
  FROM (SELECT label AS a, CASE WHEN confidence < 0.3 THEN 'neutral' ELSE label END AS b FROM content) c, (SELECT unnest(['positive', 'neutral', 'negative']) AS label) x GROUP BY x.label) l""")
def f1_report(d: Domain) -> DataFrame:
    judged = d.content.select("label", F.when(F.col("confidence") < 0.3, "neutral").otherwise(F.col("label")).alias("predicted"))
    return model.f1_report(judged).select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@query("""SELECT id, label, round(list_max(p), 6) AS confidence FROM (SELECT id, (['negative', 'neutral', 'positive'])[list_position(p, list_max(p))] AS label, p FROM (SELECT id, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p FROM
  (SELECT id, [CAST(id % 7 AS DOUBLE), CAST(id % 5 AS DOUBLE) + 0.5, CAST(id % 3 AS DOUBLE) + 0.25] AS z FROM docs)))""")
def softmax_argmax(d: Domain) -> DataFrame:
    logits = F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5) + F.lit(0.5), (F.col("id") % 3) + F.lit(0.25))
    p = d.documents.select("id", logits.alias("z")).select("id", vector.softmax(F.col("z")).alias("p"))
    return p.select("id", vector.best_label(F.col("p"), ["negative", "neutral", "positive"]).alias("label"), r6(F.array_max("p")).alias("confidence"))


CTFIDF = """, sizes AS (SELECT topic_id, sum(n) AS size FROM words GROUP BY 1), corpus AS (SELECT word, sum(n) AS total FROM words GROUP BY 1),
  scored AS (SELECT w.topic_id, w.word, w.n / s.size * ln(1 + (SELECT avg(size) FROM sizes) / c.total) AS score FROM words w JOIN sizes s USING (topic_id) JOIN corpus c USING (word)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, word) AS place FROM scored)"""


@query(f"{CTFIDF} SELECT topic_id, place, word, round(score, 6) AS score FROM ranked WHERE place <= 10")
def ctfidf_keywords(d: Domain) -> DataFrame:
    return topics.topic_keywords(d.assigned).withColumn("score", r6("score")).withColumn("place", F.col("place").cast("long"))


@query(f"""{CTFIDF}, top AS (SELECT topic_id, place, word FROM ranked WHERE place <= 10), held AS (SELECT t.topic_id, t.place, a.id FROM top t JOIN assigned a ON a.topic_id = t.topic_id AND contains(lower(a.text), t.word)),
  one AS (SELECT topic_id, place, count(*) AS d1 FROM held GROUP BY 1, 2), two AS (SELECT x.topic_id, x.place AS pa, y.place AS pb, count(*) AS d2 FROM held x JOIN held y ON x.topic_id = y.topic_id AND x.id = y.id AND x.place > y.place GROUP BY 1, 2, 3)
  SELECT p.topic_id, round(exp(avg(ln((coalesce(d2, 0) + 1) / (coalesce(d1, 0) + 1)))), 6) AS coherence_score FROM (SELECT x.topic_id, x.place AS pa, y.place AS pb FROM top x JOIN top y ON x.topic_id = y.topic_id AND x.place > y.place) p
  LEFT JOIN two ON two.topic_id = p.topic_id AND two.pa = p.pa AND two.pb = p.pb LEFT JOIN one ON one.topic_id = p.topic_id AND one.place = p.pb GROUP BY 1""")
def umass_coherence(d: Domain) -> DataFrame:
    return topics.coherence(d.assigned, topics.topic_keywords(d.assigned)).withColumn("coherence_score", r6("coherence_score"))


@query("SELECT CAST(sum(CASE WHEN doc_count % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS coherent, round(avg(CASE WHEN doc_count % 2 = 0 THEN 0.7 ELSE 0.3 END), 6) AS mean_coherence, sum(CASE WHEN doc_count % 2 = 0 THEN 1 ELSE 0 END) >= 3 AS passed FROM topics WHERE topic_id <> -1")
def coherence_gate(d: Domain) -> DataFrame:
    marked = d.topic_sizes.withColumn("coherence_score", F.when(F.col("doc_count") % 2 == 0, 0.7).otherwise(0.3))
    return topics.gate(marked, least=3).withColumn("mean_coherence", r6("mean_coherence"))


@query()
def topic_clusters(d: Domain) -> DataFrame:
    return topics.clustered(d.vectors, 10).groupBy("topic_id").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'canceled') AS canceled, count(*) AS total, strftime(max(CASE WHEN status = 'succeeded' THEN ts END), '%Y-%m-%d %H:%M:%S') AS latest_success, 'ready' AS state FROM artifacts""")
def artifact_freshness(d: Domain) -> DataFrame:
    f = artifacts.freshness(d.artifacts, EVENTS_AS_OF)
    return f.select(*artifacts.STATUSES, "total", moment("latest_success").alias("latest_success"), "state")


@query("SELECT artifact_id, status FROM artifacts WHERE status IN ('queued', 'stale') OR status = 'running' AND ts + INTERVAL 10 MINUTE <= TIMESTAMP '2024-01-25'")
def artifact_claimable(d: Domain) -> DataFrame:
    return artifacts.claimable(d.artifacts, EVENTS_AS_OF).select("artifact_id", "status")


@query("SELECT artifact_id, upper(substring(kind, 1, 1)) || replace(substring(kind, 2), '_event', ' Event') AS title, status, CASE WHEN status = 'failed' THEN 'high' WHEN status IN ('running', 'queued') THEN 'medium' ELSE 'low' END AS severity FROM artifacts ORDER BY ts DESC, artifact_id LIMIT 50")
def activity_feed(d: Domain) -> DataFrame:
    return artifacts.activity(d.artifacts).drop("updated_at")


@query("SELECT kind, artifact_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, artifact_id) AS k FROM artifacts WHERE status = 'succeeded') WHERE k = 1")
def latest_artifacts(d: Domain) -> DataFrame:
    return filters.first_rows(d.artifacts.where("status = 'succeeded'"), ["kind"], F.desc("created_at"), F.asc("artifact_id")).select("kind", "artifact_id")


@query("SELECT CAST(date AS VARCHAR) AS date, round(avg(mean_score), 6) AS score, CAST(sum(pos_count + neu_count + neg_count) AS BIGINT) AS volume FROM daily GROUP BY daily.date ORDER BY daily.date DESC LIMIT 36")
def signal_stream(d: Domain) -> DataFrame:
    """Unweighted mean of group means, and counts, of the last 36 days."""
    by_day = series.daily_sentiment(d.content).groupBy("date").agg(r6(F.avg("mean_score")).alias("score"), F.sum(F.col("pos_count") + F.col("neu_count") + F.col("neg_count")).alias("volume"))
    return by_day.orderBy(F.desc("date")).limit(36).select(day("date").alias("date"), "score", "volume")


@query("SELECT label, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM content GROUP BY label")
def label_share(d: Domain) -> DataFrame:
    counts = d.content.groupBy("label").agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select("label", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("share"))


@query("""SELECT strftime(timestamp, '%Y-%m') AS month, """ + ", ".join(f"count(*) FILTER (subreddit = '{g}') AS g{g[0]}" for g in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM content GROUP BY 1")
def volume_pivot(d: Domain) -> DataFrame:
    """A column for each group that is present."""
    p = d.content.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).pivot("subreddit").count()
    return p.select("month", *(F.coalesce(F.col(f"`{g}`"), F.lit(0)).alias(f"g{g[0]}") for g in p.columns if g != "month"))


@query("""SELECT k AS chunk, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(7 * k AS INTEGER)), '%Y-%m-%d') AS start, strftime(least(TIMESTAMP '2024-01-01' + to_days(CAST(7 * k + 7 AS INTEGER)), TIMESTAMP '2024-02-01'), '%Y-%m-%d') AS "end" FROM range(0, 5) t(k)""", with_domain=False)
def chunk_time_frame(d: Domain) -> DataFrame:
    return upkeep.chunks_of(datetime(2024, 1, 1), datetime(2024, 2, 1), 7, d.spark).select(F.col("chunk").cast("long").alias("chunk"), day("start").alias("start"), day("end").alias("end"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1", with_domain=False)
def json_props(d: Domain) -> DataFrame:
    return d.table("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("SELECT author, count(*) AS n FROM content GROUP BY 1 ORDER BY n DESC, author LIMIT 20")
def top_authors(d: Domain) -> DataFrame:
    return d.content.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(20)


@query("SELECT subreddit, round(quantile_cont(length(text), 0.25), 4) AS p25, round(quantile_cont(length(text), 0.5), 4) AS p50, round(quantile_cont(length(text), 0.9), 4) AS p90 FROM docs GROUP BY 1")
def length_percentiles(d: Domain) -> DataFrame:
    p = F.percentile(F.length("text"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)))
    return d.documents.groupBy("subreddit").agg(p.alias("p")).select("subreddit", *(F.round(F.get("p", F.lit(i)), 4).alias(n) for i, n in enumerate(("p25", "p50", "p90"))))


@query("SELECT t AS threshold, round(avg(CASE WHEN abs(confidence - 0.5) > t THEN 1.0 ELSE 0.0 END), 6) AS share FROM content, (SELECT CAST(unnest([0.1, 0.25, 0.4]) AS DOUBLE) AS t) GROUP BY 1")
def threshold_yield(d: Domain) -> DataFrame:
    cuts = (0.1, 0.25, 0.4)
    one = d.content.agg(*(F.avg((F.abs(F.col("confidence") - 0.5) > t).cast("double")).alias(f"t{i}") for i, t in enumerate(cuts)))
    pairs = F.array(*(F.struct(F.lit(t).alias("threshold"), r6(F.col(f"t{i}")).alias("share")) for i, t in enumerate(cuts)))
    return one.select(F.explode(pairs).alias("x")).select("x.*")


@query("SELECT topic_id, CAST(week_start AS VARCHAR) AS week_start, CASE WHEN avg_sentiment IS NULL THEN 'none' WHEN avg_sentiment >= 0.35 THEN 'very_positive' WHEN avg_sentiment >= 0.1 THEN 'positive' WHEN avg_sentiment > -0.1 THEN 'neutral' WHEN avg_sentiment > -0.35 THEN 'negative' ELSE 'very_negative' END AS tone FROM over_time")
def topic_tone(d: Domain) -> DataFrame:
    return _over_time(d).select("topic_id", day("week_start").alias("week_start"), views.tone(F.col("avg_sentiment")).alias("tone"))


@query("SELECT id, round((x - lo) / greatest(hi - lo, 1e-4), 6) AS x FROM (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), (SELECT min(CAST(embedding[1] AS DOUBLE)) AS lo, max(CAST(embedding[1] AS DOUBLE)) AS hi FROM embeddings)", with_domain=False)
def map_scatter(d: Domain) -> DataFrame:
    points = d.vectors.select("id", F.get("vector", F.lit(0)).cast("double").alias("x"))
    return views.min_max(points, "x").select("id", r6("x").alias("x"))


@query("SELECT id, round(x / greatest(top, 1e-9), 6) AS x FROM (SELECT vec_id AS id, CAST(embedding[2] AS DOUBLE) AS x FROM embeddings), (SELECT max(abs(CAST(embedding[2] AS DOUBLE))) AS top FROM embeddings)", with_domain=False)
def normalised_axis(d: Domain) -> DataFrame:
    points = d.vectors.select("id", F.get("vector", F.lit(1)).cast("double").alias("x"))
    return views.max_abs(points, "x").select("id", r6("x").alias("x"))


@query(f""", {NODES}, e AS (SELECT a.topic_id AS s, b.topic_id AS t FROM nodes a JOIN nodes b ON a.topic_id <> b.topic_id WHERE len(list_intersect(a.terms, b.terms)) > 0
  AND len(list_intersect(a.terms, b.terms)) / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))) >= 0.15) SELECT s AS node, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY t) AS neighbours, count(*) AS degree FROM e GROUP BY s""")
def topic_neighbours(d: Domain) -> DataFrame:
    return views.neighbours(topics.similarity_edges(_nodes(d), 0.15)).select("node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("neighbours"), "degree")


@query("SELECT label, count(*) AS n, CASE label WHEN 'positive' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END AS place FROM content GROUP BY label ORDER BY place")
def label_donut(d: Domain) -> DataFrame:
    return views.in_label_order(d.content.groupBy("label").agg(F.count("*").alias("n"))).orderBy("place")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS recent FROM events", with_domain=False)
def request_rate(d: Domain) -> DataFrame:
    return views.request_rate(d.table("events")).select("event_id", "recent")


@query("SELECT t.topic_id, t.topic_id IN (SELECT topic_id FROM assigned WHERE timestamp >= DATE '2024-03-24') AS emerging FROM topics t")
def topics_emerging_flag(d: Domain) -> DataFrame:
    return views.flagged(d.topic_sizes.select("topic_id"), filters.recent(d.assigned, 7, datetime(2024, 3, 31).date()), "topic_id", "emerging")


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\b[a-z]{{3,}}\\b')) AS word FROM docs WHERE lang = 'en') WHERE word NOT IN ('{STOP}') GROUP BY word ORDER BY n DESC, word LIMIT 100")
def word_frequencies(d: Domain) -> DataFrame:
    return views.word_counts(d.documents.where("lang = 'en'"), text.GRAPH_STOPWORDS)


@query("SELECT CAST(week_start AS VARCHAR) AS week_start, count(DISTINCT topic_id) AS topics, CAST(sum(doc_count) AS BIGINT) AS docs FROM over_time GROUP BY over_time.week_start")
def topics_by_week(d: Domain) -> DataFrame:
    return _over_time(d).groupBy("week_start").agg(F.countDistinct("topic_id").alias("topics"), F.sum("doc_count").alias("docs")).withColumn("week_start", day("week_start"))


@query("SELECT p.id, coalesce((SELECT subreddit FROM posts WHERE posts.id = 'p' || p.id), (SELECT subreddit FROM docs WHERE docs.id = p.id)) AS subreddit FROM predictions p")
def group_lookup(d: Domain) -> DataFrame:
    """The group of a prediction: that of the post of its id, else that of the document."""
    first = d.posts.select("id", F.col("subreddit").alias("a"))
    second = d.documents.select("id", F.col("subreddit").alias("b"))
    p = d.predictions.select("id", F.concat(F.lit("p"), "id").alias("pid"))
    return p.join(first.withColumnRenamed("id", "pid"), "pid", "left").join(second, "id", "left").select("id", F.coalesce("a", "b").alias("subreddit"))


@query("SELECT label, split, n FROM (SELECT label, 'train' AS split, CAST(floor(count(*) * 0.8) AS BIGINT) AS n FROM predictions GROUP BY 1 UNION ALL SELECT label, 'validation', CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) FROM predictions GROUP BY 1) WHERE n > 0")
def stratified_split(d: Domain) -> DataFrame:
    return model.stratified_split(d.predictions).groupBy("label", "split").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'patched' ELSE subreddit END AS label FROM docs")
def point_update(d: Domain) -> DataFrame:
    """New labels of some rows over the old ones."""
    new = d.documents.where("id % 4 = 0").select("id", F.lit("patched").alias("new"))
    return d.documents.join(new, "id", "left").select("id", F.coalesce("new", "subreddit").alias("label"))


@query("SELECT id, subreddit, 'old' AS version FROM docs WHERE id % 2 = 0 UNION ALL SELECT id, subreddit, 'new' FROM docs WHERE id % 2 = 1 AND id % 3 = 0")
def insert_ignore(d: Domain) -> DataFrame:
    rows = d.documents.select("id", "subreddit")
    return upkeep.inserted(rows.where("id % 2 = 0").withColumn("version", F.lit("old")), rows.where("id % 3 = 0").withColumn("version", F.lit("new")), ["id"])


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, event_id % 2 = 1 AS flag, strftime(ts, '%Y-%m-%d') AS d FROM events", with_domain=False)
def migration_types(d: Domain) -> DataFrame:
    raw = d.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.when(F.col("event_id") % 2 == 1, "1").otherwise("0").alias("flag"), day("ts").alias("d"))
    out = upkeep.migrated(raw, timestamps=("iso",), dates=("d",), flags=("flag",))
    return out.select("event_id", F.date_format("iso", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), "flag", day("d").alias("d"))


@query("SELECT doc_id AS id, trim(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1]) AS headline FROM documents", with_domain=False)
def headlines(d: Domain) -> DataFrame:
    return d.documents.select("id", text.first_line(F.col("text")).alias("headline"))


@query("SELECT page_id, regexp_replace(replace(url, '://', '://user:pw@'), '//[^/@]*@', '//***@') AS url FROM pages", with_domain=False)
def redacted_urls(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", text.redacted(F.replace("url", F.lit("://"), F.lit("://user:pw@"))).alias("url"))


@query("""SELECT topic_id, CASE WHEN len(u) = 0 THEN 'Unlabeled cluster' ELSE array_to_string(u[1:3], ' / ') END AS label, doc_count FROM
  (SELECT topic_id, doc_count, list_filter(keywords, lambda w: w NOT IN ('""" + "', '".join(text.LABEL_STOPWORDS) + """') AND length(w) > 2) AS u FROM topics)""")
def cluster_labels(d: Domain) -> DataFrame:
    return d.topics.select("topic_id", text.cluster_label(F.col("keywords")).alias("label"), "doc_count")


@query("SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM predictions) AS scored, (SELECT count(*) FROM docs d WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.id = d.id)) AS waiting, (SELECT count(*) FROM assignments WHERE topic_id >= 0) AS assigned")
def step_freshness(d: Domain) -> DataFrame:
    """What each step of the pipeline has done and still has to do."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(d.documents, "documents"), n(d.predictions, "scored"), n(filters.unprocessed(d.documents, d.predictions, "id"), "waiting"), n(d.assignments.where("topic_id >= 0"), "assigned")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


@query("SELECT 1 AS reachable", with_domain=False)
def health(d: Domain) -> DataFrame:
    return d.spark.sql("SELECT 1 AS reachable")


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1", with_domain=False)
def thread_sizes(d: Domain) -> DataFrame:
    return d.table("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("SELECT n_name AS nation, r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", with_domain=False)
def authors_by_region(d: Domain) -> DataFrame:
    c, n, r = (d.table(t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("customers"))
