"""Queries over vectors, retrieval, manifests and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import incremental as I
from ..operators import search as S
from ..session import cut_lineage, load, once

K, LEAST = 15, 0.3


def _vectors(spark, d):
    return once(load(spark, d, "vectors").where("vec_no is not null").select("vec_no", "vector", "chunk_no", "indexed_at"), "vec_no", "indexed_at").where("vector is not null")


def _every(df, key):
    return df.where(F.pmod(key, F.lit(100)) == 0)


def vector_topk(spark, d):
    e = load(spark, d, "embeddings")
    found = S.exact_search(e, _every(e, "vec_id"), "vec_id", "embedding", k=K)
    return found.select("query", "key", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def vector_threshold(spark, d):
    v = cut_lineage(_vectors(spark, d))
    return S.exact_search(v, _every(v, "vec_no"), "vec_no", "vector", least=LEAST).select("query", "key", F.round("similarity", 6).alias("similarity"))


def vector_norms(spark, d):
    return _vectors(spark, d).select("vec_no", F.round(S.norm(F.col("vector")), 6).alias("norm"))


def vector_mixed_dims(spark, d):
    """Each vector against its own first half: lengths differ."""
    half = F.slice("vector", F.lit(1), F.greatest(F.lit(1), F.floor(F.size("vector") / 2).cast("int")))
    return _vectors(spark, d).where("size(vector) > 0").select("vec_no", F.round(S.cosine(F.col("vector"), half), 6).alias("similarity"))


def _questions(spark, d):
    return _every(load(spark, d, "documents").where("title is not null"), "doc_id").select(F.col("doc_id").alias("question_id"), F.col("title").alias("question"))


def symbol_vocabulary(spark, d):
    from ..functions.text import symbols

    return load(spark, d, "documents").select("doc_id", F.size(symbols(F.col("text"))).cast("long").alias("symbols"))


def symbol_topk(spark, d):
    hits = S.symbol_search(load(spark, d, "documents"), _questions(spark, d), "doc_id", "text", "question", k=20)
    return hits.select("question_id", F.col("key").alias("doc_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def hybrid_search(spark, d):
    docs = load(spark, d, "documents")
    q = _questions(spark, d)
    hits = S.symbol_search(docs, q, "doc_id", "text", "question", k=20)
    return S.hybrid(hits, docs, q, "doc_id", "title", "question").select("question_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def _retrieved(spark, d):
    v = cut_lineage(_vectors(spark, d))
    hits = S.exact_search(v, _every(v, "vec_no"), "vec_no", "vector", k=3 * K, least=0.05)
    chunk = once(load(spark, d, "chunk").where("chunk_no is not null").select("chunk_no", "chunk_type", "filename", "name", "content", "indexed_at"), "chunk_no", "indexed_at")
    named = hits.join(v.select(F.col("vec_no").alias("key"), "chunk_no"), "key").join(chunk, "chunk_no")
    return S.retrieve(named, F.col("chunk_type") == "document", k=K)


def rag_retrieve(spark, d):
    return _retrieved(spark, d).select("query", "key", "chunk_type", F.col("place").cast("long").alias("place"))


def rag_sources(spark, d):
    return S.sources(_retrieved(spark, d)).select("query", "filename", "name", F.col("source_no").cast("long").alias("source_no"))


def rag_prompt(spark, d):
    p = S.prompts(_retrieved(spark, d), F.concat(F.lit("what is like "), F.col("query").cast("string"), F.lit("?")))
    return p.select("query", F.length("prompt").cast("long").alias("length"), F.md5("prompt").alias("md5"))


def rag_full_prompt(spark, d):
    """Prompts with a pinned text and the two queries before as history."""
    r = _retrieved(spark, d)
    asked = lambda c: F.concat(F.lit("what is like "), c.cast("string"), F.lit("?"))
    turns = r.select("query").distinct().select("query", F.explode(F.array(F.lit(2), F.lit(1))).alias("back")).where("query >= 100 * back")
    turns = turns.select("query", (-F.col("back")).alias("turn"), asked(F.col("query") - 100 * F.col("back")).alias("asked"), F.lit("see the sources").alias("answered"))
    p = S.full_prompts(r, asked(F.col("query")), turns, "corvane", pinned="nothing pinned")
    return p.select("query", F.length("prompt").cast("long").alias("length"), F.md5("prompt").alias("md5"))


def chunk_embed_pending(spark, d):
    return I.pending(load(spark, d, "chunk"), load(spark, d, "vectors").where("vector is not null"), "chunk_no")


def _manifests(spark, d):
    """What the scan has now, against the kept index."""
    now = once(load(spark, d, "source_file").where("file_id is not null").select("file_id", F.col("filename").alias("path"), F.octet_length("content").cast("long").alias("size"), "scanned_at"), "file_id", "scanned_at")
    index = I.newest(load(spark, d, "file_index"))
    return now.join(index.select("path", "mtime"), "path", "left").select("path", "mtime", "size"), index


def manifest_diff(spark, d):
    return I.changed(*_manifests(spark, d)).select("path", "size", "is_new")


def upsert_last_wins(spark, d):
    """Chunks by id: the last indexed row holds."""
    c = load(spark, d, "chunk").where("id is not null").select("id", "chunk_no", "start_line", F.struct("indexed_at", "chunk_no").alias("seq"))
    return I.upsert(c.where("chunk_no % 2 = 0"), c.where("chunk_no % 2 <> 0"), "id", "seq").select("id", "chunk_no")


def stream_index(spark, d):
    """The index as the streaming run leaves it."""
    from ..streaming.index import run_once

    return run_once(spark, load(spark, d, "chunk").schema, f"{d}/chunk.parquet", "id", "indexed_at", "chunk_no").select("id", "chunk_no")


def eval_metrics(spark, d):
    """A suite made from documents: the answer is the text, the title's words are expected."""
    docs = load(spark, d, "documents").where("title is not null")
    cases = docs.select(
        F.col("doc_kind").alias("category"), F.col("lang").alias("difficulty"), F.col("text").alias("answer"), F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != "").alias("expected"), (F.pmod("doc_id", F.lit(3)) == 0).alias("must_cite"), F.lit(1).alias("min_sources"), F.regexp_count("text", F.lit("`[^`\n]+`")).alias("n_sources")
    )
    return E.metrics(E.judged(cases))


QUERIES = {f.__name__: f for f in (vector_topk, vector_threshold, vector_norms, vector_mixed_dims, symbol_vocabulary, symbol_topk, hybrid_search, rag_retrieve, rag_sources, rag_prompt, rag_full_prompt, chunk_embed_pending, manifest_diff, upsert_last_wins, stream_index, eval_metrics)}

V = "v AS (SELECT vec_no, arg_max(vector, indexed_at) AS x, arg_max(chunk_no, indexed_at) AS chunk_no FROM vectors WHERE vec_no IS NOT NULL AND vector IS NOT NULL GROUP BY 1)"
N = "n AS (SELECT vec_no, chunk_no, x::DOUBLE[] AS x, len(x) AS d, sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) AS l FROM v)"
COS = "CASE WHEN b.l > 0 THEN list_dot_product(a.x, b.x) / (a.l * b.l) ELSE 0 END"
SYM = "list_filter(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9_]+'), lambda w: w <> ''), lambda w: list_concat([w], string_split(w, '_'), regexp_extract_all(w, '[a-z]+'))))), lambda s: s <> '')"
HITS = f"""q AS (SELECT doc_id AS question_id, title AS question FROM documents WHERE title IS NOT NULL AND doc_id % 100 = 0), ds AS (SELECT doc_id, {SYM.format(t="text")} AS s FROM documents), dw AS (SELECT doc_id, unnest(s) AS w FROM ds), qs AS (SELECT question_id, {SYM.format(t="question")} AS s FROM q), qw AS (SELECT question_id, len(s) AS m, unnest(s) AS w FROM qs),
 c AS (SELECT question_id, m, doc_id, count(*) AS c FROM qw JOIN dw USING (w) GROUP BY 1, 2, 3), h AS (SELECT question_id, doc_id, round(c / sqrt(len(s) * m), 9) AS similarity FROM c JOIN ds USING (doc_id)),
 hits AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, doc_id) AS rank FROM h WHERE similarity >= 0.05 QUALIFY rank <= 20)"""
RAG = f"""{V}, {N}, s AS (SELECT a.vec_no AS query, b.vec_no AS key, b.chunk_no, {COS} AS sim FROM n a JOIN n b ON a.d = b.d WHERE a.vec_no % 100 = 0 AND a.l > 0),
 t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, key) AS rank FROM s WHERE sim >= 0.05 QUALIFY rank <= {3 * K}),
 ch AS (SELECT * FROM chunk WHERE chunk_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_no ORDER BY indexed_at DESC) = 1),
 u AS (SELECT query, key, rank, chunk_type, filename, name, content, chunk_type = 'document' AS doc FROM t JOIN ch USING (chunk_no)), w AS (SELECT *, row_number() OVER (PARTITION BY query, doc ORDER BY rank) AS kr FROM u),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN doc AND kr <= 3 THEN 0 WHEN NOT doc THEN 1 ELSE 2 END, rank) AS place FROM w QUALIFY place <= {K})"""
NOW = "now AS (SELECT filename AS path, strlen(content)::BIGINT AS size FROM (SELECT * FROM source_file WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC) = 1)), idx AS (SELECT path, arg_max(size, (mtime, size)) AS size FROM file_index WHERE path IS NOT NULL GROUP BY 1)"
SQL = {
    "vector_topk": f"WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS x, len(embedding) AS d, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS key, {COS} AS sim FROM n a JOIN n b ON a.d = b.d WHERE a.vec_id % 100 = 0 AND a.l > 0) SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, key) AS rank, round(sim, 6) AS similarity FROM s WHERE sim >= 0 QUALIFY rank <= {K}",
    "vector_threshold": f"WITH {V}, {N} SELECT a.vec_no AS query, b.vec_no AS key, round({COS}, 6) AS similarity FROM n a JOIN n b ON a.d = b.d WHERE a.vec_no % 100 = 0 AND a.l > 0 AND {COS} >= {LEAST}",
    "vector_norms": f"WITH {V}, {N} SELECT vec_no, round(l, 6) AS norm FROM n",
    "vector_mixed_dims": f"WITH {V}, {N}, h AS (SELECT vec_no, l, x[1:greatest(1, d // 2)] AS x FROM n WHERE d > 0), k AS (SELECT vec_no, l, list_dot_product(x, x) AS s, sqrt(list_dot_product(x, x)) AS m FROM h) SELECT vec_no, round(CASE WHEN l * m > 0 THEN s / (l * m) ELSE 0 END, 6) AS similarity FROM k",
    "symbol_vocabulary": f"SELECT doc_id, len({SYM.format(t='text')})::BIGINT AS symbols FROM documents",
    "symbol_topk": f"WITH {HITS} SELECT question_id, doc_id, round(similarity, 6) AS similarity, rank FROM hits",
    "hybrid_search": f"""WITH {HITS}, lit AS (SELECT question_id, d.doc_id AS doc_id, lower(title) = lower(question) AS e FROM documents d JOIN q ON title IS NOT NULL AND question <> '' AND contains(lower(title), lower(question))),
      f AS (SELECT coalesce(h.question_id, l.question_id) AS question_id, coalesce(h.doc_id, l.doc_id) AS doc_id, coalesce(similarity, 0) AS similarity, round(0.6 * coalesce(similarity, 0) + 0.4 * (l.doc_id IS NOT NULL)::INT + 0.2 * coalesce(e, FALSE)::INT, 9) AS score FROM hits h FULL JOIN lit l ON l.question_id = h.question_id AND l.doc_id = h.doc_id)
      SELECT question_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, similarity DESC, doc_id) AS place FROM f QUALIFY place <= 20""",
    "rag_full_prompt": f"""WITH {RAG}, c AS (SELECT query, string_agg('### 上下文 ' || place || ' (' || coalesce(filename, '') || ' - ' || chunk_type || ')' || chr(10) || '```' || chr(10) || coalesce(content, '') || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY place) AS c FROM r GROUP BY query),
      p AS (SELECT query, replace('{(S.PERSONA.format(project="corvane") + S.PINNED + "nothing pinned" + chr(10) + S.CONTEXT).replace(chr(10), "~~")}', '~~', chr(10)) || c || CASE WHEN query >= 100 THEN '## 对话历史' || chr(10) || chr(10) || CASE WHEN query >= 200 THEN '问：what is like ' || (query - 200) || '?' || chr(10) || '答：see the sources' || chr(10) || chr(10) ELSE '' END || '问：what is like ' || (query - 100) || '?' || chr(10) || '答：see the sources' || chr(10) || chr(10) ELSE '' END || '## 问题' || chr(10) || 'what is like ' || query || '?' || chr(10) AS p FROM c)
      SELECT query, length(p) AS length, md5(p) AS md5 FROM p""",
    "rag_retrieve": f"WITH {RAG} SELECT query, key, chunk_type, place FROM r",
    "rag_sources": f"WITH {RAG}, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query, filename, name ORDER BY place) = 1) SELECT query, filename, name, row_number() OVER (PARTITION BY query ORDER BY place) AS source_no FROM f",
    "rag_prompt": f"WITH {RAG}, p AS (SELECT query, string_agg('[' || place || '] ' || coalesce(filename, '') || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || 'Question: what is like ' || query || '?' AS p FROM r GROUP BY query) SELECT query, length(p) AS length, md5(p) AS md5 FROM p",
    "chunk_embed_pending": "SELECT DISTINCT chunk_no FROM chunk WHERE chunk_no NOT IN (SELECT chunk_no FROM vectors WHERE vector IS NOT NULL AND chunk_no IS NOT NULL)",
    "manifest_diff": f"WITH {NOW} SELECT now.path, now.size, idx.path IS NULL AS is_new FROM now LEFT JOIN idx ON idx.path = now.path WHERE idx.path IS NULL OR idx.size IS DISTINCT FROM now.size",
    "upsert_last_wins": "SELECT id, arg_max(chunk_no, (indexed_at, chunk_no)) AS chunk_no FROM chunk WHERE id IS NOT NULL GROUP BY 1",
    "stream_index": "SELECT id, arg_max(chunk_no, (indexed_at, chunk_no)) AS chunk_no FROM chunk WHERE id IS NOT NULL GROUP BY 1",
    "eval_metrics": """WITH c AS (SELECT doc_kind AS category, lang AS difficulty, lower(text) AS a, list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda w: w <> '') AS e, doc_id % 3 = 0 AS must_cite, len(regexp_extract_all(text, '`[^`\\n]+`')) AS n FROM documents WHERE title IS NOT NULL),
      j AS (SELECT category, difficulty, must_cite, must_cite AND n >= 1 AS cited, (CASE WHEN len(e) > 0 THEN len(list_filter(e, lambda w: contains(a, w))) = len(e) ELSE a = '' OR contains(a, 'sorry') OR contains(a, 'insufficient') END) AND (NOT must_cite OR n >= 1) AS passed FROM c)
      SELECT category, difficulty, count(*) AS total, sum(passed::BIGINT)::BIGINT AS passed, sum((NOT passed)::BIGINT)::BIGINT AS failed, round(CASE WHEN sum(must_cite::BIGINT) > 0 THEN sum(cited::BIGINT) / sum(must_cite::BIGINT) END, 6) AS citation_rate FROM j GROUP BY GROUPING SETS ((), (category), (difficulty))""",
}
