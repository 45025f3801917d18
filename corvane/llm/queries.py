"""Queries over the problems' operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.search import exact_search
from .common import cut_lineage, latest_rows, load
from .credentials import credentials, redacted
from .docpairs import documented_functions
from .handwritten import not_handwritten
from .mixing import left_out, mixed, shares
from .neardup import all_pairs, groups, near_duplicates
from .packing import fill_report, packed
from .splitting import split_oversized
from .syntax import extension, invalid_rates, parsed
from .tokens import VOCABULARY, sized
from .truncation import rates, truncated
from .vectors import most_similar, similar_pairs, unit_vectors, unpacked

LIMIT, OVERLAP = 4000, 200


def _sizes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Documents with their sizes; the vocabulary's path can be set for the session."""
    return sized(load(spark, d, "documents"), "doc_id", "text", *more, vocabulary=spark.conf.get("spark.corvane.vocabulary", VOCABULARY))


def _p1(spark: SparkSession, d: str) -> DataFrame:
    return parsed(load(spark, d, "source_file"), "file_id", "filename", "content", "scanned_at", "repo")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).where("not valid").select("file_id")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_rates(_p1(spark, d), "repo", "language")


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file's verdict beside what the symbol scan made of it."""
    at = F.coalesce("scanned_at", F.lit("1900-01-01").cast("timestamp"))
    scan = load(spark, d, "file_result").where("file_id is not null").groupBy("file_id").agg(F.max_by("classes", at).alias("classes"))
    counts = scan.select("file_id", F.coalesce(F.size("classes"), F.lit(0)).alias("classes"), F.coalesce(F.size(F.filter("classes", lambda c: F.coalesce(c["end_line"], F.lit(0)) == 0)), F.lit(0)).alias("unclosed_classes"))
    return _p1(spark, d).join(counts, "file_id", "left")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = similar_pairs(load(spark, d, "vectors"), "vec_no", "vector", "indexed_at", threshold=0.92)
    return all_pairs(links, members).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return most_similar(load(spark, d, "vectors"), "vec_no", "vector", "indexed_at", k=10)


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the ten nearest of each query, by brute force over all rows, p2_neighbours has."""
    vectors = load(spark, d, "vectors")
    units = cut_lineage(unit_vectors(vectors, "vec_no", "vector", "indexed_at"))
    rows = units.select("key", "dim", unpacked(F.col("unit")).alias("v"))
    exact = exact_search(rows, rows.where("key % 100 = 0"), "key", "v", k=11, least=-1.0).where("query <> key")
    exact = exact.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "key"))).where("n <= 10")
    got = most_similar(vectors, "vec_no", "vector", "indexed_at", k=10)
    hit = exact.join(got.select("query", F.col("neighbour").alias("key"), F.lit(1).alias("hit")), ["query", "key"], "left")
    return hit.agg(F.count("*").alias("nearest"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


def p3_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Redaction keeps the length of every text."""
    return p3_redacted(spark, d).select("chunk_no", F.length("content").cast("long").alias("length"))


def p4_joined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every text, put together again without their overlaps."""
    pieces = p4_pieces(spark, d).where("chunk_no is not null")
    per = pieces.groupBy("chunk_no").agg(F.array_sort(F.collect_list(F.struct("start", "end", "piece"))).alias("xs"), F.max(F.col("end") - F.col("start")).alias("longest"))
    # What a piece adds begins where the one before it ended.
    rest = F.transform("xs", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substr(x["piece"], F.try_element_at(F.col("xs"), i)["end"] - x["start"] + 1)))
    return per.select("chunk_no", F.md5(F.array_join(rest, "")).alias("md5"), (F.col("longest") <= LIMIT).alias("within"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials(load(spark, d, "chunk"), "chunk_no", "content", "indexed_at").select("chunk_no", "line_no").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(load(spark, d, "chunk"), "chunk_no", "content", "indexed_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(load(spark, d, "chunk"), "chunk_no", "content", LIMIT, OVERLAP, only_oversized=True)
    return pieces.where("n_pieces > 1 and chunk_no is not null").select("chunk_no").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Code is cut at its functions: their lines in the file, brought to the chunk's own lines."""
    chunk = latest_rows(load(spark, d, "chunk").select("chunk_no", "content", "file_id", "filename", "chunk_type", "start_line", "indexed_at"), "chunk_no", "indexed_at")
    code = F.when(F.col("chunk_type").isin("class", "function", "module"), F.nullif(extension(F.col("filename")), F.lit("")))
    return split_oversized(chunk.withColumn("ext", code), "chunk_no", "content", LIMIT, OVERLAP, extension="ext")


def _p5(spark: SparkSession, d: str) -> DataFrame:
    # The table of libraries has a fixed size.
    libraries = [r[0] for r in load(spark, d, "lib_item").where("lib_name is not null").select("lib_name").collect()]
    return not_handwritten(load(spark, d, "source_file"), "file_id", "filename", "content", libraries)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).where("reason is not null").select("file_id").distinct()


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).groupBy(F.coalesce("reason", F.lit("handwritten")).alias("reason"), "told_by").agg(F.count("*").alias("files"))


def _p6(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(load(spark, d, "chunk"), "chunk_no", "content", "indexed_at", width=3, threshold=0.7, least=40, weighted=False)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return all_pairs(*_p6(spark, d)).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(*_p6(spark, d)).select(F.col("key").alias("chunk_no"), "group_id")


def _p6_weighted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Multisets of five words, at the operator's own threshold of 0.8."""
    return near_duplicates(load(spark, d, "chunk"), "chunk_no", "content", "indexed_at")


def p6_weighted_links(spark: SparkSession, d: str) -> DataFrame:
    return _p6_weighted(spark, d)[0].select("a", "b", F.round("similarity", 6).alias("similarity"))


def p6_weighted_members(spark: SparkSession, d: str) -> DataFrame:
    return _p6_weighted(spark, d)[1].select(F.col("key").alias("chunk_no"), "rep")


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(load(spark, d, "source_file"), load(spark, d, "file_result"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select("file_id", F.col("start_line").cast("long").alias("start_line")).distinct()


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)


def _p8(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    sizes = cut_lineage(_sizes(spark, d))
    # The table of containers has a fixed size; each row is a packing of its own.
    targets = load(spark, d, "pack_target").where("pack_name is not null and capacity_tokens is not null").collect()
    return [(t["pack_name"], t["capacity_tokens"], packed(sizes, "doc_id", t["capacity_tokens"])) for t in targets]


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [a.withColumn("pack_name", F.lit(name)) for name, _, a in _p8(spark, d)])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [fill_report(a, c).withColumn("pack_name", F.lit(name)) for name, c, a in _p8(spark, d)])


def _p9(spark: SparkSession, d: str) -> DataFrame:
    return mixed(_sizes(spark, d, "source"), load(spark, d, "mix_target"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(cut_lineage(_p9(spark, d)), load(spark, d, "mix_target"))


def p9_left_out(spark: SparkSession, d: str) -> DataFrame:
    return left_out(_sizes(spark, d, "source"), load(spark, d, "mix_target"))


def _p10(spark: SparkSession, d: str) -> DataFrame:
    return truncated(load(spark, d, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d).where("cut").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(_p10(spark, d), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rates, p1_files, p2_found, p2_neighbours, p2_recall, p3_found, p3_redacted, p3_lengths, p4_found, p4_pieces, p4_joined, p5_found, p5_reasons, p6_found, p6_groups, p6_weighted_links, p6_weighted_members, p7_found, p7_pairs, p8_pack, p8_fill, p9_mix, p9_shares, p9_left_out, p10_found, p10_rates)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH once AS (SELECT vec_no, arg_max(vector, indexed_at) AS v FROM vectors WHERE vector IS NOT NULL GROUP BY 1),
            u AS (SELECT vec_no, len(v) AS n, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM once)
            SELECT x.vec_no AS vec_a, y.vec_no AS vec_b FROM u x JOIN u y ON x.n = y.n AND x.vec_no < y.vec_no
            WHERE x.l > 0 AND y.l > 0 AND list_dot_product(x.v::DOUBLE[], y.v::DOUBLE[]) >= 0.92 * x.l * y.l""",
        "p4_found": "SELECT DISTINCT chunk_no FROM chunk WHERE length(content) > 4000 AND chunk_no IS NOT NULL",
        "p6_found": """
            WITH once AS (SELECT chunk_no, arg_max(content, indexed_at) AS content FROM chunk WHERE chunk_no IS NOT NULL GROUP BY 1),
            words AS (SELECT chunk_no, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+') AS w FROM once),
            sh AS (SELECT DISTINCT chunk_no, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
                   FROM (SELECT chunk_no, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
            n AS (SELECT chunk_no, count(*) AS n FROM sh GROUP BY 1 HAVING count(*) >= 40),
            c AS (SELECT x.chunk_no AS chunk_a, y.chunk_no AS chunk_b, count(*) AS k
                  FROM sh x JOIN sh y ON x.s = y.s AND x.chunk_no < y.chunk_no
                  WHERE x.chunk_no IN (SELECT chunk_no FROM n) AND y.chunk_no IN (SELECT chunk_no FROM n) GROUP BY 1, 2)
            SELECT chunk_a, chunk_b FROM c JOIN n p ON p.chunk_no = chunk_a JOIN n q ON q.chunk_no = chunk_b
            WHERE k >= 0.7 * (p.n + q.n - k)""",
        "p2_recall": """
            WITH once AS (SELECT vec_no, arg_max(vector, indexed_at) AS v FROM vectors WHERE vector IS NOT NULL GROUP BY 1),
            u AS (SELECT vec_no, len(v) AS n FROM once WHERE list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)) > 0),
            k AS (SELECT n, count(*) AS k FROM u GROUP BY 1)
            SELECT sum(least(10, k - 1))::BIGINT AS nearest, TRUE AS reached FROM u JOIN k USING (n) WHERE vec_no % 100 = 0""",
        "p3_lengths": "SELECT chunk_no, length(arg_max(content, indexed_at)) AS length FROM chunk WHERE chunk_no IS NOT NULL GROUP BY 1",
        "p4_joined": "SELECT chunk_no, md5(content) AS md5, TRUE AS within FROM (SELECT chunk_no, arg_max(content, indexed_at) AS content FROM chunk WHERE chunk_no IS NOT NULL GROUP BY 1) WHERE content IS NOT NULL",
        "p6_weighted_links": WEIGHTED + """, d AS (SELECT DISTINCT rep FROM m), r AS (SELECT rep AS chunk_no, e, n FROM d JOIN c ON c.chunk_no = rep), t AS (SELECT chunk_no, sum(n) AS n FROM r GROUP BY 1),
            p AS (SELECT x.chunk_no AS a, y.chunk_no AS b, sum(least(x.n, y.n)) AS k FROM r x JOIN r y ON x.e = y.e AND x.chunk_no < y.chunk_no GROUP BY 1, 2)
            SELECT a, b, round(k / (s.n + t.n - k), 6)::DOUBLE AS similarity FROM p JOIN t s ON s.chunk_no = a JOIN t ON t.chunk_no = b WHERE k >= 0.8 * (s.n + t.n - k)""",
        "p6_weighted_members": WEIGHTED + " SELECT chunk_no, rep FROM m",
    }


#: Counts of all runs of five words, and the smallest number with the same counts.
WEIGHTED = """
    WITH once AS (SELECT chunk_no, arg_max(content, indexed_at) AS content FROM chunk WHERE chunk_no IS NOT NULL GROUP BY 1),
    words AS (SELECT chunk_no, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+') AS w FROM once),
    c AS (SELECT chunk_no, array_to_string(w[i:i + 4], ' ') AS e, count(*) AS n FROM (SELECT chunk_no, w, unnest(range(1, len(w) - 3)) AS i FROM words) GROUP BY 1, 2),
    g AS (SELECT chunk_no, md5(string_agg(e || ' ' || n, '|' ORDER BY e)) AS h FROM c GROUP BY 1),
    m AS (SELECT chunk_no, min(chunk_no) OVER (PARTITION BY h) AS rep FROM g)"""
