"""From files to symbols, graph, chunks and ranks, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_name
from ..operators import chunks, graph, parsing
from ..session import cut_lineage


@dataclass
class Knowledge:
    """What is known of a code collection."""

    symbols: DataFrame
    nodes: DataFrame
    edges: DataFrame
    ranks: DataFrame
    roles: DataFrame
    chunks: DataFrame


def build(files: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> Knowledge:
    """files has filename and content. Symbols are parsed once and kept, all else is derived."""
    symbols = cut_lineage(parsing.parse_files(files.withColumn("key", F.col("filename")), "key", "filename", "content").drop("key"))
    nodes = cut_lineage(symbols.select(module_name(F.col("filename")).alias("name")).distinct())
    imports = symbols.select(module_name(F.col("filename")).alias("src"), F.inline("imports")).select("src", "module", "is_relative")
    edges = cut_lineage(graph.resolve_imports(imports, nodes))
    ranks = graph.pagerank(nodes, edges, rounds=rounds, tolerance=tolerance)
    return Knowledge(symbols, nodes, edges, ranks, graph.roles(nodes, edges, ranks), chunks.file_chunks(symbols))
