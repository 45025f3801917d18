"""Exact vector search, hybrid ranking and retrieval for prompts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import symbols
from ..session import spread


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def cosine(query: Column, record: Column) -> Column:
    """Products and the record's norm over the shorter length, the query's norm over its whole; 0
    for a record that is zero."""
    n = F.least(F.size(query), F.size(record))
    a, b = F.slice(query, F.lit(1), n), F.slice(record, F.lit(1), n)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = norm(query) * norm(b)
    return F.when(both > 0, dot / both).otherwise(0.0)


def exact_search(records: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 0, least: float = 0.0, groups: int = 0) -> DataFrame:
    """(query, key, similarity[, rank]) of the records that are at least `least` similar, the k best
    of each query if k > 0; ties by key. Query and record vectors must be of one length; others
    never match. Zero queries have no result, zero records a similarity of 0.

    Records are spread over groups (one per 100,000 rows and one per core at least, unless given), queries go to each of them; a task multiplies blocks of both
    and hands on no more than the k best of its group.
    """
    rows = records.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    groups = groups or max(records.sparkSession.sparkContext.defaultParallelism, rows.count() // 100_000)
    left = asked.select("key", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(0).alias("role"))
    right = rows.select("key", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("grp"), F.lit(1).alias("role"))
    meeting = left.unionByName(right).where("dim > 0").repartition("dim", "grp").sortWithinPartitions("dim", "grp", "role", "key")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            role, keys, dim = table.column("role").to_numpy(), table.column("key").to_numpy(), table.column("dim")[0].as_py()
            flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            cut = int((role == 0).sum())
            q, m = flat[:cut], flat[cut:]
            qn, mn = np.sqrt((q * q).sum(1)), np.sqrt((m * m).sum(1))
            # Blocks of queries such that a block's products stay within a few million numbers.
            step = max(1, min(256, 4_000_000 // max(1, len(m))))
            for start in range(0, cut if len(m) else 0, step):
                part = slice(start, min(cut, start + step))
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.where(mn[None, :] > 0, (q[part] @ m.T) / (qn[part][:, None] * mn[None, :]), 0.0)
                s[~(qn[part] > 0)] = np.nan
                keep = s >= least
                if k and s.shape[1] > k:
                    edge = -np.partition(np.where(keep, -s, np.inf), k - 1, axis=1)[:, k - 1]
                    keep &= s >= np.where(np.isfinite(edge), edge, -np.inf)[:, None] - 1e-12
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:cut][part][i]), pa.array(keys[cut:][j]), pa.array(s[i, j])], ["query", "key", "similarity"])

        for batch in batches:
            dims, grps = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            cuts = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (grps[1:] != grps[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b <= a:
                    continue
                now = (dims[a], grps[a])
                if at is not None and now != at:
                    yield from flush()
                    held.clear()
                at = now
                held.append(batch.slice(a, b - a))
        yield from flush()

    found = meeting.select("key", "v", "dim", "grp", "role").mapInArrow(score, "query long, key long, similarity double")
    if not k:
        return found
    best = W.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def symbol_search(docs: DataFrame, questions: DataFrame, key: str, text: str, question: str, k: int = 20, least: float = 0.05) -> DataFrame:
    """(question_id, key, similarity, rank): cosine of the sets of symbols, by an inverted list. Only
    words of the questions get into it; sets are made once per document, and a word that every text
    has is spread over parts by document, to each of which the questions that ask for it go."""
    asked = questions.select("question_id", symbols(F.col(question)).alias("ws")).select("question_id", F.size("ws").alias("m"), F.explode("ws").alias("w"))
    parts = docs.sparkSession.sparkContext.defaultParallelism
    q = asked.select("question_id", "m", "w", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    listed = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", symbols(F.col("text")).alias("ws"))
    d = listed.select("key", F.size("ws").alias("n"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), F.explode("ws").alias("w"))
    d = d.join(asked.select("w").distinct(), "w", "left_semi")
    common = q.join(d, ["part", "w"]).groupBy("question_id", "m", "key", "n").agg(F.count("*").alias("c"))
    scored = common.select("question_id", "key", F.round(F.col("c") / F.sqrt(F.col("n") * F.col("m")), 9).alias("similarity")).where(F.col("similarity") >= least)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("similarity"), "key"))).where(F.col("rank") <= k)


def hybrid(hits: DataFrame, docs: DataFrame, questions: DataFrame, key: str, title: str, question: str, most: int = 20) -> DataFrame:
    """(question_id, key, score, place): the semantic hits and every document whose title contains the
    question: six tenths of the similarity, four for a title that contains the question, two more for
    one that equals it. hits: question_id, key, similarity. Equal scores go by similarity, then key."""
    told = docs.where(F.col(title).isNotNull()).select(F.col(key).alias("key"), F.lower(title).alias("t"))
    asked = questions.where(F.col(question).isNotNull() & (F.col(question) != "")).select("question_id", F.lower(question).alias("q"))
    literal = told.join(asked, F.contains("t", "q")).select("question_id", "key", F.lit(1.0).alias("contains"), (F.col("t") == F.col("q")).cast("double").alias("equals"))
    both = hits.select("question_id", "key", "similarity").join(literal, ["question_id", "key"], "full")
    value = lambda c: F.coalesce(c, F.lit(0.0))
    scored = both.withColumn("score", F.round(0.6 * value("similarity") + 0.4 * value("contains") + 0.2 * value("equals"), 9))
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.desc(value("similarity")), "key")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("question_id", "key", "score", "place")


def retrieve(hits: DataFrame, is_document: Column, k: int = 15, documents: int = 3) -> DataFrame:
    """Of the 3k nearest hits of each query up to min(3, k) documents first, then code, then the other
    documents, k in all. Needs query and rank; adds place."""
    near = hits.where(F.col("rank") <= 3 * k).withColumn("doc", is_document)
    kind = F.row_number().over(W.partitionBy("query", "doc").orderBy("rank"))
    bucket = F.when(F.col("doc") & (F.col("kind_rank") <= min(documents, k)), 0).when(~F.col("doc"), 1).otherwise(2)
    placed = near.withColumn("kind_rank", kind).withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(bucket, "rank")))
    return placed.where(F.col("place") <= k).drop("doc", "kind_rank")


def sources(results: DataFrame) -> DataFrame:
    """The first result of each (query, filename, name), in the order of the results."""
    first = F.row_number().over(W.partitionBy("query", "filename", "name").orderBy("place"))
    return results.withColumn("_n", first).where("_n = 1").withColumn("source_no", F.row_number().over(W.partitionBy("query").orderBy("place"))).drop("_n")


def prompts(results: DataFrame, question: Column) -> DataFrame:
    """(query, prompt): numbered context blocks in order, then the question."""
    block = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce("filename", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    grouped = results.withColumn("_b", F.struct("place", block.alias("t"))).groupBy("query", question.alias("question")).agg(F.array_sort(F.collect_list("_b")).alias("bs"))
    return grouped.select("query", F.concat(F.array_join(F.transform("bs", lambda b: b["t"]), "\n\n"), F.lit("\n\nQuestion: "), "question").alias("prompt"))


# The words of a full prompt.
PERSONA = "你是 {project} 项目的代码助手，帮助开发者理解代码库。用简洁自然的语言直接回答问题，不要使用\"基于提供的代码上下文\"等模板化开头。引用源码时标注文件路径。如有相关的百科文章，在回答末尾用\"相关文章：\"列出文章名称。用提问者使用的语言回答。\n"
BACKGROUND, PINNED, CONTEXT, HISTORY, QUESTION = "\n## 项目背景\n", "\n## 项目概况（始终可用）\n", "\n## 代码上下文\n\n", "## 对话历史\n\n", "## 问题\n"


def full_prompts(results: DataFrame, question: Column, turns: DataFrame, project: str, background: str = "", pinned: str = "") -> DataFrame:
    """(query, prompt): persona, background and pinned text where there are any, numbered contexts, the
    conversation so far, and the question. turns: query, turn, asked, answered; a query without turns
    has no history."""
    block = F.concat(F.lit("### 上下文 "), F.col("place").cast("string"), F.lit(" ("), F.coalesce("filename", F.lit("")), F.lit(" - "), "chunk_type", F.lit(")\n```\n"), F.coalesce("content", F.lit("")), F.lit("\n```\n\n"))
    grouped = results.withColumn("_b", F.struct("place", block.alias("t"))).groupBy("query", question.alias("question")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda b: b["t"]), "").alias("contexts"))
    said = turns.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("问："), "asked", F.lit("\n答："), "answered", F.lit("\n\n")).alias("t")))), lambda x: x["t"]), "").alias("history"))
    head = PERSONA.format(project=project) + (f"{BACKGROUND}{background}\n" if background else "") + (f"{PINNED}{pinned}\n" if pinned else "") + CONTEXT
    history = F.when(F.col("history").isNotNull(), F.concat(F.lit(HISTORY), "history")).otherwise("")
    return grouped.join(said, "query", "left").select("query", F.concat(F.lit(head), "contexts", history, F.lit(QUESTION), "question", F.lit("\n")).alias("prompt"))
