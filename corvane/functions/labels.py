"""Labels by ordered rules: the first rule that holds gives the label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a function does by the start of its name, in the order of the rules.
ACTIONS = (
    (("get_", "fetch_"), "数据查询"),
    (("create_", "add_", "new_"), "数据创建"),
    (("update_", "modify_", "set_"), "数据更新"),
    (("delete_", "remove_"), "数据删除"),
    (("validate_", "check_", "verify_"), "数据校验"),
    (("authenticate", "login"), "身份认证"),
    (("register", "signup"), "用户注册"),
    (("send_", "notify_"), "消息发送"),
    (("process_", "handle_"), "业务处理"),
    (("save_", "store_", "write_"), "数据持久化"),
    (("load_", "read_"), "数据加载"),
    (("parse_", "extract_"), "数据解析"),
    (("format_", "render_"), "数据渲染"),
    (("run", "main", "execute"), "主流程执行"),
)
# Themes of modules by words in their names, in the order of the rules.
THEMES = (
    (("cmd", "main", "entry", "bootstrap"), "入口与命令行"),
    (("api", "handler", "route", "router", "controller", "gateway"), "接口与路由"),
    (("service", "usecase", "biz", "logic", "workflow", "processor"), "业务逻辑与服务"),
    (("model", "entity", "domain", "schema", "types", "dto", "vo"), "数据模型与实体"),
    (("repo", "dao", "db", "database", "store", "storage", "persist"), "数据访问与存储"),
    (("config", "middleware", "client", "server", "transport", "infra", "platform", "core"), "配置与基础设施"),
    (("util", "helper", "common", "shared", "lib", "toolkit", "extension", "plugin"), "工具与辅助函数"),
    (("test", "spec", "mock", "fixture", "benchmark"), "测试与验证"),
    (("view", "ui", "component", "page", "template", "front"), "视图与 UI"),
)
OTHER_THEME = "其他"
# Media types and highlighting names by extension, the main extension of a language.
MEDIA = {"md": "text/markdown", "html": "text/html", "css": "text/css", "js": "application/javascript", "json": "application/json", "png": "image/png", "svg": "image/svg+xml", "pdf": "application/pdf"}
HIGHLIGHT = {"py": "python", "go": "go", "js": "javascript", "ts": "typescript", "java": "java", "rs": "rust", "cpp": "cpp", "cc": "cpp", "c": "c", "h": "c", "hpp": "cpp"}
MAIN_EXTENSION = {"python": ".py", "go": ".go", "javascript": ".js", "typescript": ".ts", "rust": ".rs", "java": ".java", "cpp": ".cpp", "c": ".c", "ruby": ".rb", "php": ".php", "swift": ".swift", "kotlin": ".kt"}
# Words of architecture in texts about a project.
ARCHITECTURE = ("架构", "设计", "分层", "组件", "模块", "技术栈", "依赖", "architecture", "layer", "component", "module", "stack", "design", "pattern", "framework", "infrastructure", "middleware", "plugin", "microservice", "monolith", "frontend", "backend")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def first_rule(rules, holds, otherwise: Column) -> Column:
    """The label of the first rule of which a word holds."""
    out = None
    for words, label in rules:
        test = any_of([holds(w) for w in words])
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def action(name: Column) -> Column:
    return first_rule(ACTIONS, name.startswith, F.concat(name, F.lit(" 操作")))


def theme(module: Column) -> Column:
    low = F.lower(module)
    return first_rule(THEMES, low.contains, F.lit(OTHER_THEME))


def looked_up(table: dict[str, str], key: Column, otherwise: str = "") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(otherwise))


def masked(value: Column) -> Column:
    """A secret with only its ends shown; short ones not at all."""
    return F.when(F.length(value) <= 8, F.lit("****")).otherwise(F.concat(F.substring(value, 1, 4), F.lit("****"), F.right(value, F.lit(4))))


def without_self(params: Column) -> Column:
    """A parameter list without the receiver."""
    return F.filter(F.coalesce(params, F.array()), lambda p: ~p.isin("self", "cls"))


def rules_sql(rules, test: str, otherwise: str) -> str:
    """The same rules as a SQL expression; test has {w} for a word."""
    cases = " ".join("WHEN " + " OR ".join(test.replace("{w}", w) for w in words) + f" THEN '{label}'" for words, label in rules)
    return f"CASE {cases} ELSE {otherwise} END"
