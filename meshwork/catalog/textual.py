"""Queries on text, queries and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.catalog.registry import TOKENS, query, read
from meshwork.functions import entities, text
from meshwork.functions import query as parsing
from meshwork.plans.staging import spread
from meshwork.sources.files import TEMPLATES, test_queries

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(r"""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS clean,
  trim(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n\n+', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS spaced,
  CASE WHEN length(text) <= 100 THEN text ELSE text[1:97] || '...' END AS short FROM documents""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.clean_text("text").alias("clean"), text.normalize_whitespace("text").alias("spaced"), text.truncate_text("text", 100).alias("short"))


@query(r"""SELECT page_id, regexp_replace(url || ' by @someone ' || url, 'https?://[a-zA-Z0-9$-_@.&+!*\\(),%]+', '', 'g') AS unlinked,
  regexp_replace('@one and ' || url || ' @two_3', '@[0-9A-Za-z_]+', '', 'g') AS unmentioned FROM pages""")
def strip_links(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    both = F.concat("url", F.lit(" by @someone "), "url")
    return pages.select("page_id", text.remove_urls(both).alias("unlinked"), text.remove_mentions(F.concat(F.lit("@one and "), "url", F.lit(" @two_3"))).alias("unmentioned"))


@query("""SELECT item_id, array_to_string(list_filter([trim(coalesce(text, '')), '', '  x ', trim(CAST(item_id AS VARCHAR))], lambda f: trim(f) <> ''), '-') AS combined_raw,
  trim(coalesce(text, '')) || '-x-' || CAST(item_id AS VARCHAR) AS combined FROM benchmark""")
def combine_fields(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "benchmark")
    raw = F.array_join(F.filter(F.array(F.trim("text"), F.lit(""), F.lit("  x "), F.col("item_id").cast("string")), lambda f: F.trim(f) != ""), "-")
    return b.select("item_id", raw.alias("combined_raw"), text.combine_fields("text", F.lit(""), F.lit("  x "), F.col("item_id").cast("string"), separator="-").alias("combined"))


@query("""WITH n AS (SELECT DISTINCT source, lang, source || '_' || lang AS x FROM documents)
SELECT source, lang, lower(x) || '@company.com' AS username, lower('@' || x) || '' AS mention, replace(lower(x), '_', '-') || '-team' AS team,
  'company.com' AS domain, true AS is_email, true AS is_mention, false AS is_channel FROM n""")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat_ws("_", "source", "lang")
    name, mention = text.normalize_username(F.concat(F.lit("@"), x)), F.lower(F.concat(F.lit("@"), x))
    rows = read(spark, d, "documents").select("source", "lang").distinct()
    return rows.select("source", "lang", name.alias("username"), mention.alias("mention"), text.normalize_team_name(F.concat(F.lit("#"), x)).alias("team"), text.email_domain(name).alias("domain"), text.is_email(name).alias("is_email"), text.is_mention(mention).alias("is_mention"), text.is_channel(mention).alias("is_channel"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS pos FROM w),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p FROM x WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY doc_id, word)
SELECT doc_id, word, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS INTEGER) AS rank FROM c QUALIFY rank <= 10""")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return text.keywords(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]')) AS INTEGER) AS tokens, CAST(len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]')) + 7 AS INTEGER) AS request FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = text.token_estimate("text")
    return read(spark, d, "documents").select("doc_id", n.alias("tokens"), text.message_tokens(n).alias("request"))


@query()
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    """Chunking is sequential and has no SQL; tests hold it against a plain version."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(text.chunk_text()(F.col("text"))).alias("part", "chunk"))


_VARIED = """q AS (SELECT item_id, CASE item_id % 8
  WHEN 0 THEN w[1] WHEN 1 THEN w[1] || ' ' || w[2] WHEN 2 THEN 'How ' || text WHEN 3 THEN '"' || w[1] || ' ' || w[2] || '"'
  WHEN 4 THEN w[1] || ' and ' || w[2] || ' ' || w[3] WHEN 5 THEN array_to_string(w[1:6], '  ') WHEN 6 THEN 'source:chat channel:#dev author:a@b.c date:2024-01-02 ' || w[1] || ' ' || w[2] || ' ' || w[3] ELSE w[1] || '-' || w[2] END AS query
  FROM (SELECT item_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda t: t <> '') AS w FROM benchmark))"""


def varied_queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts made into queries of all kinds."""
    w = F.filter(F.split("text", r"[ \t\n]+"), lambda t: t != "")
    kind, one, two, three = F.col("item_id") % 8, w[0], w[1], w[2]
    q = (
        F.when(kind == 0, one)
        .when(kind == 1, F.concat_ws(" ", one, two))
        .when(kind == 2, F.concat(F.lit("How "), "text"))
        .when(kind == 3, F.concat(F.lit('"'), one, F.lit(" "), two, F.lit('"')))
        .when(kind == 4, F.concat(one, F.lit(" and "), two, F.lit(" "), three))
        .when(kind == 5, F.array_join(F.slice(w, 1, 6), "  "))
        .when(kind == 6, F.concat(F.lit("source:chat channel:#dev author:a@b.c date:2024-01-02 "), one, F.lit(" "), two, F.lit(" "), three))
        .otherwise(F.concat(one, F.lit("-"), two))
    )
    return read(spark, d, "benchmark").select("item_id", q.alias("query"))


@query(f"""WITH {_VARIED}, n AS (SELECT *, trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS normalized FROM q),
t AS (SELECT *, list_filter(string_split(normalized, ' '), lambda x: length(x) > 1) AS terms FROM n),
i AS (SELECT *, CASE WHEN normalized = '' THEN 'empty' WHEN regexp_matches(lower(query), '^(who|what|when|where|why|how|which)') THEN 'question'
  WHEN contains(query, '"') OR contains(query, '''') THEN 'exact_phrase'
  WHEN regexp_matches(lower(query), ' and | or | not |[+]|-') THEN 'boolean' WHEN len(terms) <= 2 THEN 'keyword' ELSE 'semantic' END AS intent FROM t)
SELECT item_id, normalized, array_to_string(terms, '|') AS terms, intent,
  CASE WHEN intent IN ('question', 'semantic') THEN 'hybrid_rrf' WHEN intent = 'keyword' AND len(terms) = 1 THEN 'bm25' WHEN intent = 'keyword' THEN 'hybrid_weighted' WHEN intent IN ('exact_phrase', 'boolean') THEN 'bm25' ELSE 'hybrid_rrf' END AS strategy,
  regexp_extract(query, '(?i)source:(\\w+)', 1) AS source, regexp_extract(query, '(?i)channel:(#?\\w+)', 1) AS channel, regexp_extract(query, '(?i)author:([\\w@.]+)', 1) AS author, regexp_extract(query, '(?i)date:(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS date_,
  trim(regexp_replace(regexp_replace(query, '(?i)(source:\\w+|channel:#?\\w+|author:[\\w@.]+|date:\\d{{4}}-\\d{{2}}-\\d{{2}})', '', 'g'), '\\s+', ' ', 'g')) AS remaining
FROM i""")
def query_parse(spark: SparkSession, d: str) -> DataFrame:
    p = parsing.parse(F.col("query"))
    rows = varied_queries(spark, d).select("item_id", "query", p.alias("p"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("item_id", "p.normalized", F.array_join("p.terms", "|").alias("terms"), "p.intent", F.col("p.recommended_strategy").alias("strategy"), blank("p.filters.source").alias("source"), blank("p.filters.channel").alias("channel"), blank("p.filters.author").alias("author"), blank("p.filters.date").alias("date_"), parsing.without_filters(F.col("query")).alias("remaining"))


_FIXED = " UNION ALL ".join(f"SELECT 'q{i:04d}' AS query_id, '{q}' AS query_text, '{c}' AS category, {i} AS n" for i, (c, q) in enumerate((c, q) for c, qs in TEMPLATES.items() for q in qs))


@query(f"""WITH own AS (SELECT 'm' || CAST(doc_id AS VARCHAR) AS query_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''), 1, 5), ' ') AS query_text, 'generated' AS category, doc_id + 1000000 AS n FROM documents)
SELECT query_id, query_text, category FROM ({_FIXED} UNION ALL SELECT * FROM own WHERE query_text <> '') ORDER BY n LIMIT 60""")
def generated_queries(spark: SparkSession, d: str) -> DataFrame:
    return test_queries(read(spark, d, "documents"), 60, "doc_id", "text")


@query(r"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS email FROM documents WHERE text LIKE '%@%')
SELECT DISTINCT doc_id, lower(email) AS email FROM e""")
def entities_email(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.explode(entities.people(F.col("text"), F.lit(None).cast("string"))).alias("p"))
    return found.where("p.source = 'email'").select("doc_id", F.col("p.normalized").alias("email"))


@query()
def entities_people(spark: SparkSession, d: str) -> DataFrame:
    """Look-around of mentions is beyond the oracle's regular expressions; tests pin it."""
    author = F.concat(F.lit("user_"), (F.col("doc_id") % 50).cast("string"))
    return read(spark, d, "documents").select("doc_id", F.explode(entities.people(F.col("text"), author)).alias("p")).select("doc_id", "p.*")


_DEPTS = ", ".join(f"'{x}'" for x in sorted(entities.DEPARTMENTS))


@query(f"""WITH x AS (SELECT event_id, event_type || CASE event_id % 4 WHEN 0 THEN '-platform' WHEN 1 THEN '' WHEN 2 THEN '_data' ELSE '-backend-security' END AS channel,
  CASE event_id % 3 WHEN 0 THEN 'ask the security people about design' WHEN 1 THEN 'nothing to see' ELSE 'qa and backend are testing' END AS content FROM events),
named AS (SELECT *, list_filter([{_DEPTS}], lambda d: contains(lower(channel), d)) AS c, list_filter([{_DEPTS}], lambda d: regexp_matches(content, '(^|[^a-z0-9_])' || d || '($|[^a-z0-9_])')) AS k FROM x),
t AS (SELECT event_id, list_concat([CASE WHEN len(c) > 0 THEN c[1] || '-team' ELSE channel || '-team' END], list_transform(k, lambda d: d || '-team')) AS all_ FROM named)
SELECT event_id, array_to_string(list_sort(list_distinct(all_)), ',') AS teams FROM t""")
def entities_teams(spark: SparkSession, d: str) -> DataFrame:
    e, k = spread(read(spark, d, "events").select("event_id", "event_type")), F.col("event_id")
    channel = F.concat("event_type", F.when(k % 4 == 0, "-platform").when(k % 4 == 1, "").when(k % 4 == 2, "_data").otherwise("-backend-security"))
    content = F.when(k % 3 == 0, "ask the security people about design").when(k % 3 == 1, "nothing to see").otherwise("qa and backend are testing")
    names = F.transform(entities.teams(content, channel), lambda t: t["normalized"])
    return e.select("event_id", F.array_join(F.sort_array(names), ",").alias("teams"))


_TERMS = ", ".join(f"'{x}'" for x in sorted(entities.TERMS))
_VERBS = ", ".join(f"'{x}'" for x in sorted(entities.VERBS))
_TALK = "CASE event_id % 5 WHEN 0 THEN 'PROJ-' || CAST(event_id % 7 AS VARCHAR) || ' moves the API to oauth2' WHEN 1 THEN 'We are building CI/CD for the database, OK' WHEN 2 THEN 'testing and fixing REST calls, JWT and SSO' WHEN 3 THEN 'nothing' ELSE 'the migration of docker to kubernetes; monitoring' END"


def _talk() -> F.Column:
    k = F.col("event_id")
    return F.when(k % 5 == 0, F.concat(F.lit("PROJ-"), (k % 7).cast("string"), F.lit(" moves the API to oauth2"))).when(k % 5 == 1, "We are building CI/CD for the database, OK").when(k % 5 == 2, "testing and fixing REST calls, JWT and SSO").when(k % 5 == 3, "nothing").otherwise("the migration of docker to kubernetes; monitoring")


@query(f"""WITH x AS (SELECT event_id, {_TALK} AS c FROM events),
p AS (SELECT event_id, list_concat(list_transform(regexp_extract_all(c, '[A-Z]{{2,10}}-[0-9]+'), lambda s: lower(s)),
  list_filter([{_TERMS}], lambda t: regexp_matches(lower(c), '(^|[^a-z0-9_])' || t || '($|[^a-z0-9_])')),
  list_transform(list_filter(regexp_extract_all(c, '\\b[A-Z]{{2,6}}\\b'), lambda a: a NOT IN ('I', 'A', 'AN', 'THE', 'OK', 'PR', 'MR')), lambda a: lower(a))) AS all_ FROM x)
SELECT event_id, array_to_string(list_sort(list_distinct(all_)), ',') AS projects FROM p""")
def entities_projects(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform(entities.projects(_talk()), lambda p: p["normalized"])
    return spread(read(spark, d, "events").select("event_id")).select("event_id", F.array_join(F.sort_array(names), ",").alias("projects"))


@query(f"""WITH x AS (SELECT event_id, {_TALK} AS c FROM events)
SELECT event_id, array_to_string(list_filter([{_TERMS}, {_VERBS}], lambda t: regexp_matches(lower(c), '(^|[^a-z0-9_])' || t || '($|[^a-z0-9_])')), ',') AS topics FROM x""")
def topics(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform(entities.topics(_talk()), lambda t: t["normalized"])
    return spread(read(spark, d, "events").select("event_id")).select("event_id", F.array_join(names, ",").alias("topics"))


@query(f"SELECT t AS term, count(*) AS n FROM (SELECT unnest(list_distinct({TOKENS.format('text')})) AS t FROM conversations) WHERE length(t) > 6 GROUP BY t HAVING count(*) > 1")
def frequent_terms(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "conversations").select(F.explode(F.array_distinct(text.tokens("text"))).alias("term"))
    return words.where(F.length("term") > 6).groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
