"""Span-to-chunk similarity: sparse token bags by equi-join, dense vectors in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.functions.text import bag_tokens, content_hash
from spanloom.operators import blocks
from spanloom.schema import TOP_CANDIDATES


def _held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row: behind a generator it is not copied into the lambdas that read it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def token_bags(texts: DataFrame, text: str, bag: str = "bag") -> DataFrame:
    """Adds a text's tokens as an array of (token, n). Each row counts its own: nothing is shuffled."""
    tokens = _held(texts, "_s", F.sort_array(bag_tokens(F.col(text))))
    # where each run of equal tokens begins
    begins = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    runs = _held(tokens, "_at", F.when(F.size("_s") > 0, begins).otherwise(F.array().cast("array<int>")))
    counted = F.transform(
        "_at", lambda i, k: F.struct(F.get("_s", i).alias("token"), (F.coalesce(F.get("_at", k + 1), F.size("_s")) - i).cast("bigint").alias("n"))
    )
    return _held(runs, bag, counted).drop("_s", "_at")


def squared_norm(bag: str = "bag") -> Column:
    return F.aggregate(bag, F.lit(0).cast("bigint"), lambda s, t: s + t["n"] * t["n"])


def token_vectors(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, token, n: whole-number counts, so sums don't depend on their order."""
    return token_bags(texts.select(*key, text), text).select(*key, F.explode("bag").alias("t")).select(*key, "t.*")


def sparse_scores(spans: DataFrame, chunks: DataFrame, scope: list[str], span_key: list[str], chunk_key: list[str]) -> DataFrame:
    """scope, span_key, chunk_key, sim of pairs that share a token: an equi-join on scope and token.

    ``spans`` has scope, span_key, text; ``chunks`` has scope, chunk_key, chunk. Pairs that share
    no token have similarity 0 and are not made. Norms travel with the tokens, texts stay behind;
    a token that many spans or chunks hold is split by the adaptive skew join.
    """
    a = token_bags(spans.select(*scope, *span_key, "text"), "text").withColumn("a", squared_norm())
    b = token_bags(chunks.select(*scope, *chunk_key, "chunk"), "chunk").withColumn("b", squared_norm())
    left = a.select(*scope, *span_key, "a", F.explode("bag").alias("t")).select(*scope, *span_key, "a", "t.*")
    right = b.select(*scope, *chunk_key, "b", F.explode("bag").alias("t")).select(*scope, *chunk_key, "b", "t.token", F.col("t.n").alias("m"))
    dots = left.join(right, [*scope, "token"]).groupBy(*scope, *span_key, *chunk_key, "a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    sim = F.col("dot") / F.sqrt(F.col("a").cast("double") * F.col("b").cast("double"))
    return dots.select(*scope, *span_key, *chunk_key, sim.alias("sim"))


def best_per_source(scores: DataFrame, span_key: list[str], uri: str = "uri", order: tuple[str, ...] = ("cand_ord",)) -> DataFrame:
    """The best candidate of each span and uri; the first candidate wins a tie. Pre-aggregated."""
    rest = [c for c in scores.columns if c not in (*span_key, uri, "sim")]
    place = F.struct("sim", *[(-F.col(o)).alias(f"o{k}") for k, o in enumerate(order)])
    return scores.groupBy(*span_key, uri).agg(F.max_by(F.struct("sim", *rest), place).alias("_b")).select(*span_key, uri, "_b.*")


def rank(candidates: DataFrame, span_key: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """Adds ``rank``: similarity first, then the order columns; kept up to ``most``."""
    by = Window.partitionBy(*span_key).orderBy(F.desc("sim"), *order)
    ranked = candidates.withColumn("rank", F.row_number().over(by))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def with_zero_candidates(
    best: DataFrame, spans: DataFrame, pool: DataFrame, scope: list[str], span_key: list[str], most: int = TOP_CANDIDATES
) -> DataFrame:
    """Adds candidates of similarity 0: as many of the pool's first uris as can still be ranked.

    ``pool`` has scope, uri, uri_ord and what else ``best`` has of a uri.
    """
    by = Window.partitionBy(*scope).orderBy("uri_ord")
    first = pool.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= most).drop("_r")
    keys = [*scope, *span_key]
    zero = spans.select(*keys).join(first, scope).join(best.select(*keys, "uri"), [*keys, "uri"], "left_anti")
    return best.unionByName(zero.withColumn("sim", F.lit(0.0)), allowMissingColumns=True)


def embed_cache_misses(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """content_hash, text of the distinct texts that the cache lacks."""
    hashed = texts.select(content_hash(F.col(text)).alias("content_hash"), F.col(text).alias("text"))
    return hashed.join(cache.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed, text: str = "text") -> DataFrame:
    """content_hash, vec of every distinct text: from the cache, or by ``embed`` (a function of DataFrames)."""
    hashed = texts.select(content_hash(F.col(text)).alias("content_hash")).distinct()
    new = embed(embed_cache_misses(texts, cache, text)).select("content_hash", "vec")
    return cache.join(hashed, "content_hash", "left_semi").select("content_hash", "vec").unionByName(new)


def dense_best(
    queries: DataFrame, pool: DataFrame, query_id: str = "vec_id", pool_id: str = "vec_id", vector: str = "embedding",
    uri: str | None = "label", least: float | None = None,
) -> DataFrame:
    """query_id, uri, sim, cand_ord: each query's best pool row of each uri (all other rows, if uri is None).

    ``least`` leaves out lower similarities. The best of each uri are kept before anything is shuffled.
    """
    every = F.lit(0).alias("_all")
    asked = queries.select(every, F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).alias("v"))
    name = F.col(uri or pool_id).cast("string").alias("uri")
    given = pool.select(every, F.col(pool_id).cast("bigint").alias("cand_ord"), name, F.col(vector).alias("v"))
    found = blocks.products(asked, given, ["_all"], ["query_id"], ["cand_ord", "uri"], "v", "uri" if uri else None, ("cand_ord",), least).drop("_all")
    return best_per_source(found, ["query_id"]) if uri else found.where("query_id <> cand_ord")
