"""Diagrams as ordered lines: every line is a row with a sort key, numbered at last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import looked_up, without_self
from ..functions.text import ALONE, BUSINESS, CORE, ENTRY, SUPPORT, UTILITY, directory
from ..session import global_rank
from .selection import ranked_within

# Class names, styles and legends of the roles, in the order in which they are shown.
STYLES = (
    (ENTRY, "entry", "fill:#e1f5fe,stroke:#01579b,stroke-width:2px", "🔵 入口层"),
    (CORE, "core", "fill:#fff3e0,stroke:#e65100,stroke-width:2px", "🟠 核心领域"),
    (UTILITY, "util", "fill:#f3e5f5,stroke:#4a148c,stroke-width:1px", "🟣 工具库"),
    (SUPPORT, "support", "fill:#e8f5e9,stroke:#1b5e20,stroke-width:1px", "🟢 支撑模块"),
    (BUSINESS, "business", "fill:#f5f5f5,stroke:#424242,stroke-width:1px", "⚫ 业务模块"),
    (ALONE, "independent", "fill:#fffde7,stroke:#f57f17,stroke-width:1px", "🟡 独立模块"),
)
TIERS = (ENTRY, CORE, BUSINESS, SUPPORT, UTILITY, ALONE)


def escaped(name: Column) -> Column:
    """A name as an identifier of a flow chart."""
    return F.translate(name, " -:/<>,.", "________")


def short(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/]*)$", 1)


def label(name: Column, role: Column) -> Column:
    return F.when(F.coalesce(role, F.lit("")) == "", name).otherwise(F.concat(short(name), F.lit("<br/>"), role))


def class_of(role: Column) -> Column:
    return looked_up({r: c for r, c, _, _ in STYLES}, role)


def role_of(style: Column) -> Column:
    """The role that a style class stands for."""
    return looked_up({c: r for r, c, _, _ in STYLES}, style)


def lines(df: DataFrame, part: int, line: Column, a: Column | None = None, b: Column | None = None, c: Column | None = None) -> DataFrame:
    key = lambda x: F.coalesce(x.cast("string"), F.lit("")) if x is not None else F.lit("")
    return df.select(F.lit(part).alias("part"), key(a).alias("a"), key(b).alias("b"), key(c).alias("c"), line.alias("line"))


def fixed(spark, part: int, *texts: str) -> DataFrame:
    rows = [(part, f"{i:03}", "", "", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "part int, a string, b string, c string, line string")


def numbered(*parts: DataFrame) -> DataFrame:
    """(line_no, line) of all parts in the order of their keys."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return global_rank(out, *[F.asc(k) for k in ("part", "a", "b", "c")], name="line_no").select("line_no", "line")


def styling(roles: DataFrame, part: int) -> list[DataFrame]:
    """Style classes of the roles in use, the classes of the nodes, and the legend: four parts."""
    spark = roles.sparkSession
    table = spark.createDataFrame([(r, f"{i}", c, s, text) for i, (r, c, s, text) in enumerate(STYLES)], "role string, i string, style string, css string, text string")
    used = table.join(roles.select("role").distinct(), "role", "left_semi")
    marked = roles.withColumn("style", class_of(F.col("role"))).where("style <> ''")
    mark = escaped(F.concat(F.lit("legend_"), "style"))
    return [
        fixed(spark, part, "    %% 节点角色标注：按模块职责着色"),
        lines(used, part + 1, F.concat(F.lit("    classDef "), "style", F.lit(" "), "css"), F.col("i")),
        lines(marked, part + 2, F.concat(F.lit("    class "), escaped(F.col("name")), F.lit(" "), "style"), escaped(F.col("name"))),
        fixed(spark, part + 3, "    subgraph 图例"),
        lines(used, part + 4, F.concat(F.lit("        "), mark, F.lit("["), "text", F.lit("]:::legend")), F.col("i"), F.lit("0")),
        lines(used, part + 4, F.concat(F.lit("        class "), mark, F.lit(" "), "style"), F.col("i"), F.lit("1")),
        fixed(spark, part + 5, "    end"),
    ]


def architecture(roles: DataFrame, edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(line_no, line): folders as subgraphs, other modules by themselves, a click line for each, role
    styles and legend, and the edges; edges on cycles are dotted. roles: name, role; cyclic: src, dst."""
    spark = roles.sparkSession
    placed = roles.withColumn("dir", directory(F.col("name")))
    node = F.concat(escaped(F.col("name")), F.lit("["), label(F.col("name"), F.col("role")), F.lit("]"))
    inner, outer = placed.where("dir <> '.'"), placed.where("dir = '.'")
    dirs = inner.select("dir").distinct()
    dotted = edges.join(cyclic.select("src", "dst", F.lit(True).alias("on")).distinct(), ["src", "dst"], "left")
    arrow = F.concat(F.lit("    "), escaped(F.col("src")), F.when(F.col("on"), F.lit(" -.-> ")).otherwise(F.lit(" --> ")), escaped(F.col("dst")))
    return numbered(
        fixed(spark, 0, "%% 架构图：展示项目模块间的依赖关系与层级结构", "graph TD"),
        lines(dirs, 1, F.concat(F.lit("    subgraph "), escaped(F.col("dir"))), F.col("dir"), F.lit("0")),
        lines(inner, 1, F.concat(F.lit("        "), node), F.col("dir"), F.lit("1"), F.col("name")),
        lines(dirs, 1, F.lit("    end"), F.col("dir"), F.lit("2")),
        lines(outer, 2, F.concat(F.lit("    "), node), F.col("name")),
        lines(roles, 3, F.concat(F.lit("    click "), escaped(F.col("name")), F.lit(" \"javascript:navigateToModule('"), "name", F.lit("')\"")), F.col("name")),
        *styling(roles, 4),
        lines(dotted, 10, arrow, F.col("src"), F.col("dst")),
    )


def top_level(tops: DataFrame, edges: DataFrame) -> DataFrame:
    """(line_no, line): top folders with the number of their modules. tops: name, modules."""
    node = F.concat(F.lit("    "), escaped(F.col("name")), F.lit("["), "name", F.when(F.col("modules") > 0, F.concat(F.lit("<br/><i>"), F.col("modules").cast("string"), F.lit(" 个子模块</i>"))).otherwise(""), F.lit("]"))
    return numbered(fixed(tops.sparkSession, 0, "%% 顶层架构概览：展示各顶层模块包之间的依赖关系与角色分工", "graph TD"), lines(tops, 1, node, F.col("name")), lines(edges, 2, F.concat(F.lit("    "), escaped(F.col("src")), F.lit(" --> "), escaped(F.col("dst"))), F.col("src"), F.col("dst")))


def layered(roles: DataFrame, edges: DataFrame, per_pair: int = 3) -> DataFrame:
    """(line_no, line): modules by tier, and up to `per_pair` edges between each two tiers."""
    spark = roles.sparkSession
    texts = {r: text for r, _, _, text in STYLES}
    table = spark.createDataFrame([(r, f"{i}", texts[r]) for i, r in enumerate(TIERS)], "role string, i string, text string")
    used = table.join(roles.select("role").distinct(), "role", "left_semi")
    placed = roles.join(table, "role")
    across = edges.join(roles.select(F.col("name").alias("src"), F.col("role").alias("from_role")), "src").join(roles.select(F.col("name").alias("dst"), F.col("role").alias("to_role")), "dst").where("from_role <> to_role")
    kept = ranked_within(across, ["from_role", "to_role"], F.asc("src"), F.asc("dst")).where(F.col("place") <= per_pair)
    return numbered(
        fixed(spark, 0, "%% 分层架构图：按职责角色组织模块，展示系统的分层结构与跨层依赖", "graph LR"),
        lines(used, 1, F.concat(F.lit("    subgraph "), escaped(F.col("role")), F.lit('["'), "text", F.lit('"]')), F.col("i"), F.lit("0")),
        lines(placed, 1, F.concat(F.lit("        "), escaped(F.col("name")), F.lit('["'), short(F.col("name")), F.lit('"]')), F.col("i"), F.lit("1"), F.col("name")),
        lines(used, 1, F.lit("    end"), F.col("i"), F.lit("2")),
        lines(kept, 2, F.concat(F.lit("    "), escaped(F.col("src")), F.lit(" --> "), escaped(F.col("dst"))), F.col("src"), F.col("dst")),
    )


def classes(found: DataFrame, bases: DataFrame) -> DataFrame:
    """(line_no, line): classes with their methods, then who extends whom. found: name, module,
    methods; bases: name, base."""
    spark = found.sparkSession
    method = lambda m: F.concat(F.lit("        +"), m["name"], F.lit("("), F.array_join(without_self(m["params"]), ", "), F.lit(")"), F.when(F.coalesce(m["return_type"], F.lit("")) != "", F.concat(F.lit(" "), m["return_type"])).otherwise(""))
    listed = found.select("name", F.posexplode(F.transform(F.coalesce("methods", F.array()), method)).alias("i", "text"))
    return numbered(
        fixed(spark, 0, "%% 类图：展示项目中类的定义、属性及继承/实现关系", "classDiagram"),
        lines(found, 1, F.concat(F.lit("    %% "), "name", F.lit(" 来自 "), "module", F.lit(" 模块")), F.col("name"), F.lit("0")),
        lines(found, 1, F.concat(F.lit("    class "), escaped(F.col("name")), F.lit(" {")), F.col("name"), F.lit("1")),
        lines(listed, 1, F.col("text"), F.col("name"), F.lit("2"), F.lpad(F.col("i").cast("string"), 6, "0")),
        lines(found, 1, F.lit("    }"), F.col("name"), F.lit("3")),
        lines(bases, 2, F.concat(F.lit("    "), escaped(F.col("name")), F.lit(" --|> "), escaped(F.col("base"))), F.col("name"), F.col("base")),
    )
