"""First-match cascades and multi-label rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.functions.paths import basename, extension


def cascade(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The value of the first rule that holds; a null condition doesn't."""
    out = None
    for holds, value in rules:
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out.otherwise(otherwise)


def labels(*rules: tuple[Column, str]) -> Column:
    """The values of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(holds, value) for holds, value in rules)))


# File names, directories and extensions by language, category and tool.
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".md": "Markdown", ".mdx": "Markdown", ".scss": "SCSS", ".sass": "SCSS", ".css": "CSS", ".html": "HTML", ".sh": "Shell", ".ps1": "PowerShell", ".txt": "Text",
}
#: (category, how a path is held against the values, values); the first that fits counts.
CATEGORIES = (
    ("generated", "directory", ("node_modules", "dist", "coverage", ".git", ".cache", "generated")),
    ("manifest", "name", ("package.json", "pnpm-workspace.yaml", "pnpm-lock.yaml", "package-lock.json", "yarn.lock")),
    ("documentation", "stem", ("readme", "changelog")), ("documentation", "directory", ("docs", "doc")), ("documentation", "extension", (".md", ".mdx")),
    ("example", "directory", ("example", "examples", "demo", "demos", "playground", "stories")),
    ("test", "directory", ("test", "tests", "__tests__")), ("test", "infix", ("test", "spec")),
    ("build", "directory", ("build", "scripts")), ("build", "start", ("vite.config.", "rollup.config.", "webpack.config.", "rspack.config.", "vitest.config.", "jest.config.", "esbuild.", "gulpfile.")), ("build", "name", ("makefile",)),
    ("config", "tsconfig", ("tsconfig",)), ("config", "part", ("eslint", "prettier", "editorconfig")), ("config", "name", (".env.example",)),
    ("style", "extension", (".scss", ".sass", ".css", ".less", ".styl")),
    ("source", "extension", (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte")),
    ("asset", "extension", (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".mp3", ".mp4")),
)
#: The same for the tools that configuration files belong to.
TOOLS = (
    ("typescript", "start", ("tsconfig",)), ("vite", "start", ("vite.",)), ("rollup", "start", ("rollup.",)), ("eslint", "part", ("eslint",)), ("prettier", "part", ("prettier",)),
    ("vitest", "start", ("vitest.",)), ("jest", "start", ("jest.",)), ("pnpm", "name", ("pnpm-workspace.yaml",)), ("pnpm", "start", ("pnpm-lock",)), ("node", "part", ("lock", "package.json")),
)


def _fits(path: Column, how: str, values: tuple[str, ...]) -> Column:
    """Whether a path in lower case fits one of the values: any of its directories (or its name), its name as a whole, before
    its first dot, before its extension, at its start or somewhere, its extension, or a start with .json at the end."""
    base = basename(path)
    any_of = lambda test: F.exists(F.array(*map(F.lit, values)), test)
    return {
        "directory": lambda: F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, values))),
        "name": lambda: base.isin(*values),
        "stem": lambda: F.substring_index(base, ".", 1).isin(*values),
        "infix": lambda: F.element_at(F.concat(F.array(F.lit(""), F.lit("")), F.split(base, r"\.")), -2).isin(*values) & (F.size(F.split(base, r"\.")) > 2),
        "start": lambda: any_of(lambda v: F.startswith(base, v)),
        "part": lambda: any_of(lambda v: F.contains(base, v)),
        "extension": lambda: extension(path).isin(*values),
        "tsconfig": lambda: any_of(lambda v: F.startswith(base, v)) & F.endswith(base, F.lit(".json")),
    }[how]()


def by_table(path: Column, table: tuple[tuple[str, str, tuple[str, ...]], ...], otherwise: str) -> Column:
    """The first entry of a table like CATEGORIES that a path fits."""
    return cascade(*((_fits(F.lower(path), how, values), name) for name, how, values in table), otherwise=otherwise)


def file_category(path: Column) -> Column:
    return by_table(path, CATEGORIES, "other")


def config_tool(path: Column) -> Column:
    return by_table(path, TOOLS, "unknown")


def lookup(key: Column, table: dict[str, str], otherwise: str) -> Column:
    """A literal map; for tables of more than a few dozen keys join a dimension instead."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(otherwise))


def language(path: Column) -> Column:
    return F.when(F.lower(basename(path)) == "makefile", "Text").otherwise(lookup(extension(F.lower(path)), LANGUAGES, "Unknown"))


# Words of two languages that speak for what a task asks, and what forbids.
INTENT_WORDS = {
    "understand": "了解 理解 分析 understand explain",
    "use": "使用 引用 接入 use import",
    "add": "新增 添加 创建 add create",
    "modify": "修改 调整 change modify",
    "fix": "修复 解决 fix",
    "validate": "验证 校验 validate verify",
    "migrate": "迁移 migrate",
    "debug": "定位 调试 排查 debug",
    "document": "文档 说明 document",
    "test": "测试 test",
}
FORBIDS = ("不要", "不得", "禁止", "不允许", "do not", "don't", "must not")
#: What forbids, and what it forbids: all up to the end of the clause.
NEGATIVE = rf"(?i)(?:{'|'.join(FORBIDS)})\s*([^。；;\n]+)"


def _any_word(words: str) -> str:
    """A pattern for words in Latin letters with their endings, and for others anywhere."""
    latin = [w for w in words.split() if w.isascii()]
    return "|".join([rf"\b(?:{'|'.join(latin)})(?:s|es|d|ed|ing)?\b", *(w for w in words.split() if not w.isascii())])


def intents(text: Column) -> Column:
    asked = F.regexp_replace(F.lower(text), NEGATIVE, " ")
    return labels(*((asked.rlike(_any_word(words)), name) for name, words in INTENT_WORDS.items()))


def negative_constraints(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NEGATIVE})"), 1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))


def scope_reasons(**checks: tuple[Column, Column]) -> Column:
    """Names of the checks whose allowed value (null: any) differs from the actual one; empty means in scope."""
    return F.array_compact(F.array(*(F.when(want.isNotNull() & ~want.eqNullSafe(have), name) for name, (want, have) in checks.items())))
