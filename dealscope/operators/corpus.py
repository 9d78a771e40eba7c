"""Text corpus: chunks, vectors, nearest neighbours, contexts, links, similar questions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscope import fixed_values as fv
from dealscope.functions import text as tx
from dealscope.functions.ordering import first_per_group
from dealscope.functions.vectors import cosine_of, distance, dot

QUERY_BLOCK = 64


def chunks(df: DataFrame, prefix: Column, text: str, *keep: str, size=fv.CHUNK_WORDS, overlap=fv.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk with id ``{prefix}_{i}``; chunking is local to the row."""
    worded = df.withColumn("_prefix", prefix).withColumn("_words", tx.words(F.col(text)))
    pieces = worded.select(
        "_prefix", *keep, F.posexplode(tx.chunk_array(F.col("_words"), size, overlap)).alias("chunk_no", "chunk")
    )
    return pieces.select(
        F.concat_ws("_", "_prefix", F.col("chunk_no").cast("string")).alias("id"), *keep, "chunk_no", "chunk"
    )


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Text blocks between blank lines."""
    return df.select(key, F.posexplode(tx.block_array(F.col(text))).alias("block_no", "content"))


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks by id, the newer load wins; ids absent from the new load stay."""
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)))
    rest = [F.col(c) for c in both.columns if c not in ("id", "_load")]
    order = [F.col("_load").desc(), *rest]
    return first_per_group(both, ["id"], order).drop("_load")


def embed(
    df: DataFrame, text: str, fn: Callable | None = None, name: str = "vector", native: bool = False
) -> DataFrame:
    """Vectors for a text column: the character vector, or a batch function of the caller.

    The default counts the bytes of a whole Arrow batch at once, beside digests that Spark works out; ``native`` is
    the JVM expression (43 text replacements a row, about ten times slower), where no Python worker is wanted.
    """
    if native:
        lowered = df.withColumn("_low", F.lower(text))
        return lowered.withColumn(name, tx.character_vector(text, "_low")).drop("_low")
    if fn:
        return df.withColumn(name, F.pandas_udf(fn, "array<float>")(F.col(text)))

    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = tx.character_vectors_of(batch.column("_text"), batch.column("_digest"))
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, vectors], names=schema.names)

    digest = F.unhex(F.md5(F.col(text))).alias("_digest")
    return df.select(*[f.name for f in kept], F.col(text).alias("_text"), digest).mapInArrow(run, schema)


def question_vectors(spark: SparkSession, questions: list[str]) -> list[tuple[int, list[float]]]:
    """Character vectors of the asked questions (the caller's list, not table data)."""
    rows = spark.createDataFrame(list(enumerate(questions)), "query_id int, question string")
    got = embed(rows, "question").orderBy("query_id").collect()
    return [(r["query_id"], list(r["vector"])) for r in got]


def nearest(
    corpus: DataFrame,
    key: str,
    vector: str,
    queries: list[tuple[int, list[float]]],
    k: int = fv.SEARCH_RESULTS,
    metric: str = "l2",
    max_distance: float | None = None,
) -> DataFrame:
    """The ``k`` nearest corpus rows per asked vector.

    The asked vectors are literals in the plan, so the corpus is scanned once per
    block of queries, nothing is joined, and only ``k`` rows per query leave each
    task. Blocks keep the plan small for long query lists.
    """
    parts = []
    for start in range(0, len(queries), QUERY_BLOCK):
        block = ", ".join(
            f"struct({qid} AS query_id, array({', '.join(f'{float(x)!r}D' for x in v)}) AS asked, "
            f"{math.sqrt(sum(float(x) ** 2 for x in v))!r}D AS size)"
            for qid, v in queries[start : start + QUERY_BLOCK]
        )
        # a row's norm is worked out once, not once per asked vector
        sized = corpus.withColumn("_size", F.sqrt(dot(F.col(vector), F.col(vector)))) if metric == "cosine" else corpus
        pairs = sized.withColumn("_q", F.explode(F.expr(f"array({block})")))
        if metric == "cosine":
            apart = 1 - cosine_of(F.col(vector), F.col("_q.asked"), F.col("_size") * F.col("_q.size"))
        else:
            apart = distance(F.col(vector), F.col("_q.asked"), metric)
        pairs = pairs.withColumn("distance", apart)
        pairs = pairs.select(
            F.col("_q.query_id").alias("query_id"),
            "distance",
            *[c for c in corpus.columns if c != vector],
        )
        if max_distance is not None:
            pairs = pairs.filter(F.col("distance") <= max_distance)
        parts.append(first_per_group(pairs, ["query_id"], [F.col("distance"), F.col(key)], k))
    return reduce(DataFrame.unionByName, parts)


def assemble_context(
    hits: DataFrame, key: str, text: str, source: str, date: str | None = None, max_chars: int = fv.MAX_CONTEXT_CHARS
) -> DataFrame:
    """``[file (date)]`` blocks of the at most k hits per question, cut to ``max_chars`` characters."""
    dated = F.lit("")
    if date:
        dated = F.when(F.coalesce(F.col(date), F.lit("")) != "", F.concat(F.lit(" ("), F.col(date), F.lit(")"))).otherwise("")
    block = F.concat(F.lit("["), F.col(source), dated, F.lit("]\n"), F.col(text))
    ordered = F.array_sort(F.collect_list(F.struct("distance", key, block.alias("block"))))
    return hits.groupBy("query_id").agg(ordered.alias("_b")).select(
        "query_id",
        F.substring(F.array_join(F.col("_b.block"), fv.NOTE_SEPARATOR), 1, max_chars).alias("document_context"),
    )


def benchmark_text(category: str) -> str:
    """The benchmark section of one category of the fixed table."""
    data = fv.BENCHMARKS[category]
    lines = [f"{fv.BENCHMARK_LABEL}{category.replace('_', ' ').title()}:"]
    lines += [f"  {metric.replace('_', ' ')}: {value}" for metric, value in data.items()]
    return "\n".join(lines)


def benchmark_categories(question: Column) -> Column:
    """Benchmark categories whose keyword is in the question, in keyword order.

    The keyword list is fixed, so this is a row-local expression and not a join.
    """
    q = F.lower(question)
    hits = [
        F.when(F.contains(q, F.lit(word)), F.array(*[F.lit(c) for c in categories])).otherwise(
            F.array().cast("array<string>")
        )
        for word, categories in fv.BENCHMARK_KEYWORDS
    ]
    return F.array_distinct(F.concat(*hits))


def benchmark_context(question: Column, max_chars: int = fv.MAX_BENCHMARK_CHARS) -> Column:
    """The matching benchmark sections, cut to ``max_chars`` characters; null if none."""
    texts = F.create_map(*[x for c in fv.BENCHMARKS for x in (F.lit(c), F.lit(benchmark_text(c)))])
    sections = F.transform(benchmark_categories(question), lambda c: F.element_at(texts, c))
    joined = F.substring(F.array_join(sections, "\n\n"), 1, max_chars)
    return F.when(F.size(sections) > 0, joined)


def retrieval_bundle(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Text context, benchmark context and flag per question."""
    return questions.join(contexts, "query_id", "left").select(
        "query_id",
        F.coalesce("document_context", F.lit("")).alias("document_context"),
        benchmark_context(F.col("question")).alias("benchmark_context"),
        benchmark_context(F.col("question")).isNotNull().alias("has_benchmark"),
    )


# --- similar questions -----------------------------------------------------------


def similar_patterns(
    questions: DataFrame,
    patterns: DataFrame,
    threshold: float = fv.QUESTION_SIMILARITY,
    n: int = 3,
) -> DataFrame:
    """Up to ``n`` stored patterns per question with word Jaccard of at least ``threshold``.

    Exact prefix-filter join. Token sets are reduced to distinct ones first, so a
    third of all rows asking the same thing is one set; per pattern set only the
    best ``n`` codes can appear in a result. Tokens are ordered by the number of sets
    that hold them, so a phrase that a third of the questions share comes last and
    makes no candidates; two sets that reach the threshold share one of their first
    ``size - ceil(threshold * size) + 1`` tokens, lie in the same or adjacent size
    bands, and behind the first token they share both have enough tokens left to
    reach it. All three are exact bounds. Candidate rows carry set digests, the tokens
    join back only for the surviving pairs.
    """
    asked = _with_token_set(questions.select("question_id", "question"))
    stored = _with_token_set(patterns.select("code", "question"))
    best_codes = first_per_group(
        stored.select("set_id", "code").distinct(), ["set_id"], [F.col("code").desc()], n
    )
    asked_sets = asked.select("set_id", "tokens").dropDuplicates(["set_id"])
    stored_sets = stored.select("set_id", "tokens").dropDuplicates(["set_id"])
    counts = _token_counts(asked_sets.unionByName(stored_sets))
    other = _prefixes(_rare_first(stored_sets, counts), threshold).withColumnsRenamed(
        {"set_id": "other_id", "size": "other_size", "pos": "other_pos"}
    )
    size, other_size = F.col("size"), F.col("other_size")
    # tokens two sets must share, and at most share from this one on if it is the first
    least = (size + other_size) * (threshold / (1 + threshold)) - 1e-6
    left = F.least(size - F.col("pos"), other_size - F.col("other_pos"))
    pairs = (
        _prefixes(_rare_first(asked_sets, counts), threshold, spread=True)
        .join(other.hint("merge"), ["token", "band"])
        .filter((size * threshold <= other_size + 1e-9) & (other_size * threshold <= size + 1e-9) & (left >= least))
        .select("set_id", "other_id")
        .distinct()
    )
    scored = (
        pairs.join(asked_sets, "set_id")
        .join(stored_sets.withColumnsRenamed({"set_id": "other_id", "tokens": "other"}), "other_id")
        .withColumn("similarity", tx.jaccard(F.col("tokens"), F.col("other")))
        .filter(F.col("similarity") >= threshold)
        .select("set_id", "other_id", "similarity")
    )
    with_codes = scored.join(best_codes.withColumnRenamed("set_id", "other_id"), "other_id")
    top = first_per_group(
        with_codes, ["set_id"], [F.col("similarity").desc(), F.col("code").desc()], n
    ).select("set_id", "similarity", "code")
    return asked.select("question_id", "set_id").join(top, "set_id").select(
        "question_id", "code", "similarity"
    )


def _with_token_set(df: DataFrame) -> DataFrame:
    """Distinct tokens and the digest of the token set."""
    return (
        df.withColumn("tokens", F.array_sort(tx.tokens(F.col("question"))))
        .filter(F.size("tokens") > 0)
        .withColumn("set_id", F.unhex(F.md5(F.array_join("tokens", " "))))
        .drop("question")
    )


def _token_counts(sets: DataFrame) -> DataFrame:
    """(token, sets): the number of sets that hold a token."""
    return sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("sets"))


def _rare_first(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Tokens of each set in one global order: those of the fewest sets first, longest first among them.

    The counts are joined by shuffle: a vocabulary has no bound, and a token of every set is one row a set.
    """
    cells = sets.select("set_id", F.explode("tokens").alias("token")).join(counts.hint("merge"), "token")
    place = F.struct("sets", (-F.length("token")).alias("l"), "token")
    ordered = F.transform(F.array_sort(F.collect_list(place)), lambda p: p["token"])
    return cells.groupBy("set_id").agg(ordered.alias("tokens"))


def _prefixes(sets: DataFrame, threshold: float, spread: bool = False) -> DataFrame:
    """(set_id, size, pos, token, band) rows of the prefix tokens.

    Sizes whose ratio is within the threshold differ by at most one band, because a
    band is a hair wider than the threshold; ``spread`` adds the two neighbours.
    """
    size = F.size("tokens")
    keep = size - F.ceil(size * F.lit(threshold) - 1e-9).cast("int") + 1
    width = math.log(1 / threshold) * (1 + 1e-6) if threshold < 1 else 1.0
    band = F.floor(F.log(size.cast("double")) / width).cast("int")
    out = sets.select(
        "set_id", size.alias("size"), band.alias("band"), F.posexplode(F.slice("tokens", F.lit(1), keep)).alias("pos", "token")
    )
    if not spread:
        return out
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    return out.select("set_id", "size", "pos", "token", near.alias("band"))


# --- links and articles -------------------------------------------------------------


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Absolute links of each page, first use of each, page order kept in ``pos``."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?\bhref\s*=\s*(["'])(.*?)\1"""), F.lit(2))
    found = pages.select(
        key, tx.site_root(F.col("url")).alias("site"), F.posexplode(F.array_distinct(hrefs)).alias("pos", "href")
    )
    scheme = F.regexp_extract("site", "^([A-Za-z]+:)", 1)
    absolute = (
        F.when(F.col("href").startswith("//"), F.concat(scheme, "href"))
        .when(F.col("href").startswith("/"), F.concat("site", "href"))
        .when(F.col("href").rlike("(?i)^https?://"), F.col("href"))
    )
    return found.withColumn("link", absolute).filter(F.col("link").isNotNull()).drop("href")


def cap_per_source(items: DataFrame, source: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` items of each source; only ``n`` per source leave each task."""
    return first_per_group(items, [source], [F.col(c) for c in order], n)


def page_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags become blanks, runs of blanks one."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def article_records(pages: DataFrame, company: Column) -> DataFrame:
    """Article text for the corpus and its file name; a page without text gives its title."""
    title = F.substring(tx.strip(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)), 1, 200)
    body = page_text(F.coalesce("html", F.lit("")))
    return pages.withColumn("title", title).withColumn("company", company).select(
        "page_id",
        "company",
        "title",
        tx.slug(F.col("title")).alias("slug"),
        F.concat(F.lit("["), F.col("company"), F.lit(" News]\nTitle: "), F.col("title"), F.lit("\n\n"), F.when(body != "", body).otherwise(F.col("title"))).alias("record"),
    )


def source_summary(found: DataFrame, registry: DataFrame, source: str) -> DataFrame:
    """Items found, new and without a title per source."""
    known = registry.select("url_hash").distinct().withColumn("_known", F.lit(True))
    return found.join(known, "url_hash", "left").groupBy(source).agg(
        F.count("*").alias("found"),
        F.count_if(F.col("_known").isNull()).alias("new"),
        F.count_if(F.col("title") == "").alias("errors"),
    )
