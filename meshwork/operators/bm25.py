"""BM25 over a table of texts.

Only the query's terms are ever looked at: one pass yields the corpus statistics as a single row (partial
aggregates, no shuffle of texts), a second scores; top-k is a partial heap in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshwork.functions.text import token_count, tokens
from meshwork.plans.staging import stage

# Saturation and length weight.
K1, B = 1.5, 0.75


def collection_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: documents, tokens and mean length."""
    sized = docs.select(token_count(text).alias("dl"))
    return sized.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(term, df) of all terms; a term counts once for each document."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, doc_id, tf, dl): the inverted index, to be written once and partitioned by term."""
    return _post(_exploded(docs, doc_id, text))


def _exploded(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("t"))
    return t.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))


def _post(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def idf(n: Column, df: Column) -> Column:
    """Never below 0: terms in half of the documents or more count nothing."""
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5))))


def length_norm(dl: Column, avgdl: Column, b: float = B) -> Column:
    return F.when(avgdl == 0, 1.0).otherwise(1 - b + b * dl / F.nullif(avgdl, F.lit(0.0)))


def term_score(weight: Column, tf: Column, norm: Column, k1: float = K1) -> Column:
    return F.coalesce(F.try_divide(weight * tf * (k1 + 1), tf + k1 * norm), F.lit(0.0))


def _counted(docs: DataFrame, text: str, terms: list[str], *keep: str) -> DataFrame:
    """Length and the count of each term of every text, from one split."""
    t = docs.select(*keep, tokens(text).alias("_t"))
    return t.select(*keep, F.size("_t").alias("_dl"), *[(F.size("_t") - F.size(F.array_remove("_t", term))).alias(f"_tf{i}") for i, term in enumerate(terms)])


def score(docs: DataFrame, query: str, doc_id: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, corpus: DataFrame | None = None, explain: bool = False) -> DataFrame:
    """(doc_id, score) of every document that holds a term; repeated query terms count again.

    Statistics come from ``corpus`` (all documents) even where ``docs`` is filtered.
    """
    asked = query.lower().split()
    terms = sorted(set(asked))
    if not terms:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    # Texts are read once: what is counted of them is staged, and statistics and scores come from the counts.
    every = corpus if corpus is not None else docs
    counts = stage(_counted(every, text, terms, *([doc_id] if corpus is None else [])), "counts")
    held = counts if corpus is None else stage(_counted(docs, text, terms, doc_id), "held")
    stats = counts.agg(F.count("*").alias("_n"), F.coalesce(F.avg("_dl"), F.lit(0.0)).alias("_avgdl"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    held = held.withColumnRenamed(doc_id, "doc_id").where(" or ".join(f"_tf{i} > 0" for i in range(len(terms))))
    both = held.crossJoin(F.broadcast(stats))  # one row of statistics
    norm = length_norm(F.col("_dl"), F.col("_avgdl"), b)
    parts = [F.struct(F.lit(t).alias("term"), F.col(f"_tf{i}").cast("bigint").alias("tf"), F.col(f"_df{i}").alias("df"), idf(F.col("_n"), F.col(f"_df{i}")).alias("idf"), (term_score(idf(F.col("_n"), F.col(f"_df{i}")), F.col(f"_tf{i}"), norm, k1) * asked.count(t)).alias("score")) for i, t in enumerate(terms)]
    total = sum((p.getField("score") for p in parts), F.lit(0.0))
    found = both.select("doc_id", total.alias("score"), *([F.col("_dl").alias("dl"), F.array(*parts).alias("terms")] if explain else []))
    return found


def top_k(scored: DataFrame, k: int, by: str = "score", key: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc(by), key).limit(k)


def score_queries(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank) for a table of queries (query_id, query): one plan for all of them.

    Query terms are joined with the postings on the term; a term of the queries that most documents hold is
    split by adaptive execution. Rank limits are applied per query before the final sort.
    """
    asked = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # Only tokens that some query asks for are counted and shuffled; what they leave is staged, as it is read twice.
    wanted = stage(_post(_exploded(docs, doc_id, text).join(asked.select("term").distinct(), "term", "left_semi")), "postings")
    dfs = wanted.groupBy("term").agg(F.count("*").alias("df"))
    stats = collection_stats(docs, text)
    scored = asked.join(wanted, "term").join(dfs, "term").crossJoin(F.broadcast(stats))
    norm = length_norm(F.col("dl"), F.col("avgdl"), b)
    one = term_score(idf(F.col("n_docs"), F.col("df")), F.col("tf"), norm, k1) * F.col("times")
    total = scored.groupBy("query_id", "doc_id").agg(F.sum(one).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
