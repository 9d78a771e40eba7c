"""Text corpus queries on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.functions import text as tx
from dealscope.functions.vectors import cosine
from dealscope.operators import corpus as cp
from dealscope.operators import vector_index as vi
from dealscope.plans import bindings as b
from dealscope.plans.bindings import PHRASES, table, with_sql
from dealscope.plans.registry import query

_WORDS = r"regexp_extract_all(text, '[^\s\p{Z}]+')"
_TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_CHUNKS = f"""w AS (SELECT doc_id, source, {_WORDS} AS ws FROM documents),
chunks AS (SELECT doc_id, source, CAST(i // 450 AS INT) AS chunk_no, array_to_string(ws[i + 1 : i + 500], ' ') AS chunk
 FROM (SELECT doc_id, source, ws, unnest(range(0, len(ws), 450)) AS i FROM w))"""


def _vector_sql(text: str) -> str:
    low = f"lower({text})"
    chars = [f"(length({low}) - length(replace({low}, '{c}', ''))) / greatest(1, length({low}))::DOUBLE" for c in fv.EMBEDDING_CHARS]
    digest = [f"('0x' || substring(md5({text}), {2 * i + 1}, 2))::INT / 255::DOUBLE" for i in range(16)]
    return f"[{', '.join(chars + digest + ['0::DOUBLE'] * (64 - len(chars) - 16))}]"


def _chunks(spark, sf):
    docs = table(spark, sf, "documents")
    return cp.chunks(docs, F.concat(F.lit("doc_"), F.col("doc_id")), "text", "doc_id", "source")


@query("x9_word_chunks", "X9", f"""WITH {_CHUNKS}
SELECT 'doc_' || doc_id || '_' || chunk_no AS id, doc_id, source, chunk_no, md5(chunk) AS chunk_md5, length(chunk) AS n_chars FROM chunks""")
def word_chunks(spark, sf):
    return _chunks(spark, sf).select(
        "id", "doc_id", "source", "chunk_no", F.md5("chunk").alias("chunk_md5"),
        F.length("chunk").cast("bigint").alias("n_chars"),
    )


@query("x10_text_blocks", "X10", r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', E'.\n\n'), E'\n\n'),
  lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS bs FROM documents)
SELECT doc_id, CAST(i AS INT) AS block_no, bs[i + 1] AS content FROM (SELECT doc_id, bs, unnest(range(0, len(bs))) AS i FROM s)""")
def text_blocks(spark, sf):
    spaced = table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))
    return cp.blocks(spaced, "doc_id", "text")


@query("x11_character_vectors", "X11", f"""
WITH v AS (SELECT doc_id, {_vector_sql('text')} AS v FROM documents)
SELECT doc_id, CAST(i AS INT) AS dim, round(v[i + 1], 9) AS value FROM (SELECT doc_id, v, unnest(range(0, 64)) AS i FROM v)""")
def character_vectors(spark, sf):
    vectors = cp.embed(table(spark, sf, "documents").select("doc_id", "text"), "text")
    # outer: every vector has entries, and the size test of posexplode would build it twice
    return vectors.select("doc_id", F.posexplode_outer("vector").alias("dim", "value")).withColumn(
        "value", F.round("value", 9)
    )


_EDGE = r"[^\p{L}\p{N}_]"


@query("x12_question_intents", "X12", with_sql("questions") + " SELECT conv_id, turn, CASE " + " ".join(
    f"WHEN regexp_matches(lower(question), '(^|{_EDGE})({'|'.join(words)})($|{_EDGE})') THEN '{name}'"
    for name, words in fv.INTENT_KEYWORDS) + " ELSE 'aggregation' END AS intent FROM questions")
def question_intents(spark, sf):
    return b.questions(spark, sf).select("conv_id", "turn", tx.intent(F.col("question")).alias("intent"))


@query("x7_question_similarity", "X7", with_sql("questions") + f""", t AS (SELECT conv_id, turn, {_TOKENS.format('question')} AS a, {_TOKENS.format('phrase')} AS p FROM questions)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(p) = 0 THEN 0 ELSE len(list_intersect(a, p)) / len(list_distinct(list_concat(a, p)))::DOUBLE END, 9) AS similarity FROM t""")
def question_similarity(spark, sf):
    a, p = tx.tokens(F.col("question")), tx.tokens(F.col("phrase"))
    return b.questions(spark, sf).select("conv_id", "turn", F.round(tx.jaccard(a, p), 9).alias("similarity"))


@query("x8_label_cosine", "X8", """
WITH u AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), l AS (SELECT label, list(x ORDER BY i) AS centre FROM c GROUP BY 1)
SELECT vec_id, e.label, round(list_dot_product(embedding::DOUBLE[], centre) /
 (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(centre, centre))), 6) AS similarity
FROM embeddings e JOIN l ON e.label = l.label""")
def label_cosine(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return (
        vectors.join(_centres(vectors), "label")
        .select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("similarity"))
    )


def _centres(vectors):
    """Mean vector per label; per task one partial mean per (label, dimension)."""
    cells = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda s: s["x"]).alias("centre"))


def _knn_sql(dist: str) -> str:
    return f"""WITH u AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), l AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM c GROUP BY 1),
d AS (SELECT query_id, vec_id, {dist} AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM d WHERE distance <= 1.2)
SELECT CAST(query_id AS INT) AS query_id, vec_id, round(distance, 6) AS distance FROM r WHERE rn <= 5"""


_COSINE = "1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"


def _nearest(metric):
    def plan(spark, sf):
        vectors = table(spark, sf, "embeddings")
        asked = [(r["label"], list(r["centre"])) for r in _centres(vectors).collect()]
        hits = cp.nearest(vectors.select("vec_id", "embedding"), "vec_id", "embedding", asked, 5, metric, 1.2)
        return hits.withColumn("distance", F.round("distance", 6))

    return plan


query("d18_nearest_cosine", "D18 X8", _knn_sql(_COSINE))(_nearest("cosine"))
query("d18_nearest_l2", "D18", _knn_sql("list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"))(_nearest("l2"))

_ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PHRASES)) + ") t(query_id, question))"
_HITS = f"""WITH {_CHUNKS}, {_ASKED},
cv AS (SELECT doc_id, source, chunk_no, chunk, 'doc_' || doc_id || '_' || chunk_no AS id, {_vector_sql('chunk')} AS v FROM chunks),
qv AS (SELECT query_id, question, {_vector_sql('question')} AS q FROM asked),
d AS (SELECT query_id, id, source, chunk, round(list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM cv, qv),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM d WHERE distance <= 1.2),
hits AS (SELECT * FROM r WHERE rn <= 5),
ctx AS (SELECT query_id, substring(string_agg('[' || source || ']' || chr(10) || chunk, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY distance, id), 1, 4000) AS document_context
 FROM hits GROUP BY 1)"""


def _search(spark, sf):
    corpus = cp.embed(_chunks(spark, sf).select("id", "source", "chunk"), "chunk")
    return cp.nearest(
        corpus, "id", "vector", cp.question_vectors(spark, list(PHRASES)), max_distance=fv.MAX_DISTANCE
    ).withColumn("distance", F.round("distance", 9))


@query("d18_chunk_search", "D18 X11", _HITS + " SELECT query_id, id, source, round(distance, 6) AS distance FROM hits")
def chunk_search(spark, sf):
    return _search(spark, sf).select("query_id", "id", "source", F.round("distance", 6).alias("distance"))


@query("m17_context_text", "M17", _HITS + " SELECT query_id, document_context FROM ctx")
def context_text(spark, sf):
    return cp.assemble_context(_search(spark, sf), "id", "chunk", "source")


_BENCH = "bench(pos, word, category, txt) AS (VALUES " + ", ".join(
    "({}, '{}', '{}', '{}')".format(i * 10 + j, word, c, cp.benchmark_text(c).replace("'", "''"))
    for i, (word, cats) in enumerate(fv.BENCHMARK_KEYWORDS) for j, c in enumerate(cats)) + ")"
_BENCH_CTX = """m AS (SELECT qid, category, min(pos) AS pos, any_value(txt) AS txt FROM q JOIN bench ON contains(lower(question), word) GROUP BY 1, 2),
bc AS (SELECT qid, substring(string_agg(txt, chr(10) || chr(10) ORDER BY pos), 1, 2000) AS benchmark_context, string_agg(category, ',' ORDER BY pos) AS categories FROM m GROUP BY 1)"""


@query("d15_benchmark_context", "D15 A17 X23", with_sql("questions") + f""", {_BENCH}, q AS (SELECT conv_id * 100 + turn AS qid, question FROM questions), {_BENCH_CTX}
SELECT q.qid AS question_id, coalesce(categories, '') AS categories, benchmark_context FROM q LEFT JOIN bc ON q.qid = bc.qid""")
def benchmark_context(spark, sf):
    return b.questions(spark, sf).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"),
        F.array_join(cp.benchmark_categories(F.col("question")), ",").alias("categories"),
        cp.benchmark_context(F.col("question")).alias("benchmark_context"),
    )


@query("m18_retrieval_bundle", "M18", _HITS + f""", {_BENCH}, q AS (SELECT query_id AS qid, question FROM asked), {_BENCH_CTX}
SELECT query_id, coalesce(document_context, '') AS document_context, benchmark_context, benchmark_context IS NOT NULL AS has_benchmark
FROM asked LEFT JOIN ctx USING (query_id) LEFT JOIN bc ON query_id = qid""")
def retrieval_bundle(spark, sf):
    asked = spark.createDataFrame(list(enumerate(PHRASES)), "query_id int, question string")
    return cp.retrieval_bundle(asked, cp.assemble_context(_search(spark, sf), "id", "chunk", "source"))


_QUESTIONS = f"""{with_sql("questions")}, {_CHUNKS},
cv AS MATERIALIZED (SELECT source, chunk, 'doc_' || doc_id || '_' || chunk_no AS id, {_vector_sql('chunk')} AS v FROM chunks),
qv AS MATERIALIZED (SELECT conv_id * 100 + turn AS question_id, question, {_vector_sql('question')} AS q FROM questions),
dq AS (SELECT DISTINCT q FROM qv),
d AS (SELECT q, id, source, chunk, round(list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM cv, dq),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS rn FROM d WHERE distance <= 1.2),
hits AS (SELECT question_id, question, id, source, chunk, distance FROM r JOIN qv USING (q) WHERE rn <= 5)"""


def _asked(spark, sf):
    return b.questions(spark, sf).select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), "question")


def _question_search(spark, sf):
    chunks = _chunks(spark, sf).select("id", "source", "chunk")
    index = vi.build_index(cp.embed(chunks.select("id", "chunk"), "chunk"), "id", "vector")
    found = vi.search(cp.embed(_asked(spark, sf), "question"), "question_id", "vector", index, max_distance=fv.MAX_DISTANCE)
    return found, chunks


@query("d18_question_index", "D18 X11", _QUESTIONS + " SELECT question_id, id, round(distance, 6) AS distance FROM hits")
def question_index(spark, sf):
    """A table of questions against all chunks by the vector index."""
    hits = _question_search(spark, sf)[0].hits
    return hits.select(F.col("question").alias("question_id"), F.col("key").alias("id"), F.round("distance", 6).alias("distance"))


@query("d18_pairs_computed", "D18", _QUESTIONS + """ SELECT (SELECT count(*) FROM qv) AS questions, (SELECT count(*) FROM cv) AS corpus,
 (SELECT count(*) FROM qv) * (SELECT count(*) FROM cv) AS all_pairs, true AS fewer""")
def pairs_computed(spark, sf):
    """The pairs that the index looks at stay below questions x corpus."""
    work = _question_search(spark, sf)[0].work
    return work.select("questions", "corpus", "all_pairs", (F.col("pairs_computed") < F.col("all_pairs")).alias("fewer"))


_NEIGHBOURS = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id AS question, b.vec_id AS key, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY distance, key) AS rn FROM d)
SELECT question, key, round(distance, 6) AS distance FROM r WHERE rn <= 10"""


@query("d18_neighbour_graph", "D18", _NEIGHBOURS)
def neighbour_graph(spark, sf):
    """The ten nearest vectors of every vector, itself included."""
    vectors = table(spark, sf, "embeddings")
    index = vi.build_index(vectors, "vec_id", "embedding")
    hits = vi.search(vectors, "vec_id", "embedding", index, k=10).hits
    return hits.select("question", "key", F.round("distance", 6).alias("distance"))


@query("m18_question_bundles", "M18 M17 D15", f"""{_QUESTIONS}, {_BENCH}, q AS (SELECT question_id AS qid, question FROM qv), {_BENCH_CTX},
ctx AS (SELECT question_id, substring(string_agg('[' || source || ']' || chr(10) || chunk, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY distance, id), 1, 4000) AS document_context
 FROM hits GROUP BY 1)
SELECT question_id AS query_id, coalesce(document_context, '') AS document_context, benchmark_context, benchmark_context IS NOT NULL AS has_benchmark
FROM qv LEFT JOIN ctx USING (question_id) LEFT JOIN bc ON question_id = qid""")
def question_bundles(spark, sf):
    """Contexts for every question of the table."""
    found, chunks = _question_search(spark, sf)
    hits = found.hits.select(F.col("question").alias("query_id"), F.col("key").alias("id"), "distance").join(chunks, "id")
    contexts = cp.assemble_context(hits, "id", "chunk", "source")
    return cp.retrieval_bundle(_asked(spark, sf).withColumnRenamed("question_id", "query_id"), contexts)


@query("d17_similar_questions", "D17 X7", with_sql("questions") + f""",
t AS (SELECT conv_id * 100 + turn AS question_id, {_TOKENS.format('question')} AS a FROM questions),
p AS (SELECT DISTINCT 'code_' || conv_id || '_' || turn AS code, {_TOKENS.format("question || ' again'")} AS s FROM questions),
j AS (SELECT question_id, code, len(list_intersect(a, s)) / len(list_distinct(list_concat(a, s)))::DOUBLE AS similarity FROM t, p),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, code DESC) AS rn FROM j WHERE similarity >= 0.85)
SELECT question_id, code, round(similarity, 9) AS similarity FROM r WHERE rn <= 3""")
def similar_questions(spark, sf):
    # a stored pattern is a question with one word more
    q = b.questions(spark, sf)
    asked = q.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), "question")
    stored = q.select(
        F.format_string("code_%d_%d", "conv_id", "turn").alias("code"),
        F.concat("question", F.lit(" again")).alias("question"),
    )
    return cp.similar_patterns(asked, stored).withColumn("similarity", F.round("similarity", 9))


@query("m16_chunk_upsert", "M16 W8", f"""WITH {_CHUNKS},
n AS (SELECT doc_id, 'new ' || text AS text, source FROM documents WHERE lang = 'en'),
w2 AS (SELECT doc_id, source, {_WORDS} AS ws FROM n),
c2 AS (SELECT doc_id, CAST(i // 450 AS INT) AS chunk_no, array_to_string(ws[i + 1 : i + 500], ' ') AS chunk FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 450)) AS i FROM w2)),
u AS (SELECT doc_id, chunk_no, chunk FROM c2 UNION ALL SELECT doc_id, chunk_no, chunk FROM chunks a WHERE NOT EXISTS (SELECT 1 FROM c2 WHERE c2.doc_id = a.doc_id AND c2.chunk_no = a.chunk_no))
SELECT 'doc_' || doc_id || '_' || chunk_no AS id, doc_id, md5(chunk) AS chunk_md5 FROM u""")
def chunk_upsert(spark, sf):
    docs = table(spark, sf, "documents")
    changed = docs.filter(F.col("lang") == "en").withColumn("text", F.concat(F.lit("new "), F.col("text")))
    name = F.concat(F.lit("doc_"), F.col("doc_id"))
    merged = cp.upsert_chunks(
        cp.chunks(docs, name, "text", "doc_id"), cp.chunks(changed, name, "text", "doc_id")
    )
    return merged.select("id", "doc_id", F.md5("chunk").alias("chunk_md5"))


_LINKS = r"""l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, list_transform(regexp_extract_all(html, '(?is)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*'')', 1), lambda q: q[2:-2]) AS hs FROM pages),
d AS (SELECT page_id, site, h, min(i) AS i FROM (SELECT page_id, site, unnest(hs) AS h, unnest(range(0, len(hs))) AS i FROM l) GROUP BY 1, 2, 3),
k AS (SELECT page_id, site, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos,
 CASE WHEN starts_with(h, '//') THEN split_part(site, '//', 1) || h WHEN starts_with(h, '/') THEN site || h WHEN regexp_matches(lower(h), '^https?://') THEN h END AS link FROM d),
links AS (SELECT * FROM k WHERE link IS NOT NULL)"""


@query("x19_page_links", "X19", f"WITH {_LINKS} SELECT * FROM links")
def page_links(spark, sf):
    return cp.links(table(spark, sf, "pages"))


@query("w10_links_per_site", "W10 X19", f"""WITH {_LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id, pos) AS rn FROM links)
SELECT page_id, site, pos, link FROM r WHERE rn <= 20""")
def links_per_site(spark, sf):
    return cp.cap_per_source(cp.links(table(spark, sf, "pages")), "site", ["page_id", "pos"], 20)


_ARTICLES = r"""a AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS company, substring(md5(url), 1, 16) AS url_hash,
 left(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 200) AS title,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'),
 '(?is)<title\b.*?</title>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages)"""


def _articles(spark, sf):
    pages = table(spark, sf, "pages")
    return cp.article_records(pages, F.regexp_extract("url", r"^https?://([^/?#]+)", 1))


@query("m19_article_records", "M19 X18", f"""WITH {_ARTICLES}
SELECT page_id, company, title, left(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g'), 60) AS slug,
 '[' || company || ' News]' || chr(10) || 'Title: ' || title || chr(10) || chr(10) || CASE WHEN body <> '' THEN body ELSE title END AS record FROM a""")
def article_records(spark, sf):
    return _articles(spark, sf)


@query("m19_source_summary", "M19", f"""WITH {_ARTICLES}
SELECT company, count(*) AS found, count(*) FILTER (url NOT LIKE 'http://%') AS new, count(*) FILTER (title = '') AS errors FROM a GROUP BY 1""")
def source_summary(spark, sf):
    hashed = table(spark, sf, "pages").select("page_id", "url", tx.short_hash(F.col("url")).alias("url_hash"))
    found = _articles(spark, sf).join(hashed, "page_id")
    return cp.source_summary(found, hashed.filter(F.col("url").startswith("http://")), "company")


