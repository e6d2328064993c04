"""String, path and pattern functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def camel_split(c: Text) -> Column:
    """Words of a camelCase or PascalCase name, separated by spaces."""
    return F.regexp_replace(F.regexp_replace(col(c), "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def camel_words(c: Text) -> Column:
    return F.split(F.lower(camel_split(c)), r"[\s_.]+")


def name_token(c: Text) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def name_tail(c: Text) -> Column:
    """What follows the last dot or colon."""
    return F.regexp_extract(col(c), r"([^.:]*)$", 1)


def qualifiers(c: Text) -> Column:
    """Parts of a qualified name, at ``::``, dots and slashes."""
    return F.filter(F.split(col(c), r"::|[./]"), lambda x: x != "")


def last_qualifier(c: Text) -> Column:
    return F.coalesce(F.try_element_at(qualifiers(c), F.lit(-1)), col(c))


def canonical(c: Text) -> Column:
    return F.array_join(qualifiers(c), "::")


def last_two(c: Text) -> Column:
    """The last two ``::`` segments."""
    parts = F.split(col(c), "::")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "::")


def pascal(c: Text) -> Column:
    """kebab-case to PascalCase."""
    return F.array_join(F.transform(F.split(col(c), "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def basename(c: Text) -> Column:
    return F.substring_index(col(c), "/", -1)


def dirname(c: Text) -> Column:
    """The directory of a path, ``.`` at the root."""
    c = col(c)
    return F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(c: Text) -> Column:
    return F.lower(F.regexp_extract(basename(c), r"(\.[^.]*)$", 1))


def normal_path(c: Text) -> Column:
    """A relative path without ``.`` and with ``..`` folded into what precedes."""
    parts = F.filter(F.split(F.regexp_replace(col(c), r"\\", "/"), "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    push = lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), up(acc)).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(parts, empty, push), "/")


def distance(a: Text, b: Text, most: int) -> Column:
    """Edit distance, or -1 where it exceeds ``most``."""
    return F.levenshtein(col(a), col(b), most)


def truncated(c: Text, most: int, mark: str = "…") -> Column:
    return F.when(F.char_length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit(mark))).otherwise(col(c))


def truncated_at_line(c: Text, most: int) -> Column:
    """At most ``most`` characters, ended at the last whole line if there is one."""
    head = F.substring(col(c), 1, most)
    whole = F.regexp_replace(head, r"\n[^\n]*\z", "")
    return F.when(F.char_length(col(c)) <= most, col(c)).when(F.contains(head, F.lit("\n")), whole).otherwise(head)


def lines(c: Text, start: int, count: int) -> Column:
    """``count`` lines from line ``start``, from 1."""
    return F.array_join(F.slice(F.split(col(c), "\n"), start, count), "\n")


def proximity(a: Text, b: Text) -> Column:
    """15 for each leading directory that two paths share, 80 at most."""
    x, y = F.split(dirname(a), "/"), F.split(dirname(b), "/")
    same = F.zip_with(F.slice(x, F.lit(1), F.least(F.size(x), F.size(y))), F.slice(y, F.lit(1), F.least(F.size(x), F.size(y))), lambda p, q: (p == q) & (p != "."))
    shared = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda acc, s: F.struct((acc["on"] & s).alias("on"), (acc["n"] + (acc["on"] & s).cast("int")).alias("n")))
    return F.least(shared["n"] * 15, F.lit(80))


# -- patterns -----------------------------------------------------------------


def glob_regex(pattern: str, anchored: bool = True) -> str:
    """``*`` within a segment, ``**`` across segments, ``?`` one character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(p) for p in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$" if anchored else out


def wildcard_regex(pattern: str) -> str:
    """An anchored pattern over names: ``*`` any characters, ``?`` one."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def path_globs(path: Text, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Any include and no exclude, ignoring case; a pattern without slash matches
    a file name in any directory."""

    def any_of(patterns) -> Column:
        out = F.lit(False)
        for p in patterns:
            p = p.strip().replace("\\", "/")
            if p:
                out |= normal.rlike("(?i)" + glob_regex(p if "/" in p else f"**/{p}"))
        return out

    normal = F.regexp_replace(col(path), r"\\", "/")
    return (any_of(include) if any(p.strip() for p in include) else F.lit(True)) & ~any_of(exclude)


# -- classes of paths (the patterns are fixed values) -------------------------

_LANGUAGES = {
    "typescript": ".ts .mts .cts", "tsx": ".tsx", "javascript": ".js .mjs .cjs .xsjs .xsjslib", "jsx": ".jsx", "python": ".py .pyw", "go": ".go", "rust": ".rs",
    "java": ".java", "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp .hxx .hh .ipp .inl .tcc", "csharp": ".cs", "razor": ".cshtml .razor", "php": ".php .module .install .theme .inc",
    "yaml": ".yml .yaml", "twig": ".twig", "ruby": ".rb .rake", "swift": ".swift", "kotlin": ".kt .kts", "dart": ".dart", "liquid": ".liquid", "svelte": ".svelte", "vue": ".vue",
    "pascal": ".pas .dpr .dpk .lpr .dfm .fmx", "scala": ".scala .sc", "lua": ".lua", "luau": ".luau", "objc": ".m .mm", "xml": ".xml", "properties": ".properties",
}
EXTENSIONS = {e: lang for lang, es in _LANGUAGES.items() for e in es.split()}

GENERATED = (
    r"\.pb\.go$|\.pulsar\.go$|_grpc\.pb\.go$|_mocks?\.go$|^mock_[^/]+\.go$|\.generated\.[jt]sx?$|\.gen\.[jt]sx?$|\.pb\.[jt]s$|_pb\.[jt]s$|_grpc_pb\.[jt]s$|_pb2(_grpc)?\.py$|_pb2\.pyi$|\.pb\.(cc|h)$|"
    r"(^|/)ob_inner_table_schema\.\d+_\d+\.cpp$|(^|/)ob_inner_table_schema(_constants)?\.h$|(^|/)ob_inner_table_schema\.(vt|lob)\.cpp$|(^|/)ob_inner_table_schema_misc\.ipp$|(^|/)ob_load_inner_table_schema\.cpp$|"
    r"\.g\.cs$|Grpc\.cs$|OuterClass\.java$|Grpc\.java$|\.pb\.swift$|\.g\.dart$|\.freezed\.dart$|\.pb\.dart$|\.pbgrpc\.dart$|\.chopper\.dart$|\.generated\.rs$"
)
LOW_VALUE = (
    r"(^|/)(tests?|__tests?__|spec)/|_test\.go$|(^|/)test_[^/]+\.py$|_test\.py$|_spec\.rb$|_test\.rb$|\.(test|spec)\.[jt]sx?$|(test|spec|tests)\.(java|kt|scala)$|(tests?|spec)\.cs$|tests?\.swift$|_test\.dart$"
)
TEST_NAME_LOWER = r"^test[_.]|[._-](test|tests|spec|specs)\.[a-z0-9]+$"
TEST_NAME = r"(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$"
TEST_DIR_LOWER = r"/(tests|test|__tests__|spec|specs|testlib|testing)/|^(test|tests|spec|specs)/|(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/"
TEST_DIR = r"(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/"
IGNORED_DIRS = (
    "node_modules bower_components jspm_packages web_modules .yarn .pnpm-store .next .nuxt .svelte-kit .turbo .vite .parcel-cache .angular .docusaurus storybook-static .vinxi .nitro out-tsc "
    ".vercel .netlify .wrangler dist build out .output coverage .nyc_output __pycache__ __pypackages__ .venv venv .pixi .pdm-build .mypy_cache .pytest_cache .ruff_cache .tox .nox .hypothesis "
    ".ipynb_checkpoints .eggs .gradle vendor .build Pods Carthage DerivedData .swiftpm .dart_tool .pub-cache .cxx .externalNativeBuild vcpkg_installed .bloop .metals lua_modules .luarocks __history __recovery .cache"
).split()
IGNORED = "(^|/)(" + "|".join(map(re.escape, IGNORED_DIRS)) + r"|[^/]*\.egg-info|cmake-build-[^/]*|bazel-[^/]*)/"


def is_generated(path: Text) -> Column:
    return col(path).rlike(GENERATED)


def is_test(path: Text) -> Column:
    p, name = col(path), basename(path)
    return F.lower(name).rlike(TEST_NAME_LOWER) | name.rlike(TEST_NAME) | F.lower(p).rlike(TEST_DIR_LOWER) | p.rlike(TEST_DIR)


def is_low_value(path: Text) -> Column:
    return F.lower(col(path)).rlike(LOW_VALUE) | is_generated(path)


def is_ignored(path: Text) -> Column:
    return col(path).rlike(IGNORED)


def language_of(path: Text, content: Text | None = None) -> Column:
    """The language by extension; ``.h`` files by what they contain, if given.
    Null where it is none."""
    ext = extension(path)
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    found = F.try_element_at(table, ext)
    if content is None:
        return found
    text = col(content)
    objc = text.rlike(r"(?m)^\s*(@interface|@protocol|@class|#import)\b")
    cpp = text.rlike(r"(?m)^\s*(class\s+\w+|namespace\s+\w+|template\s*<|public:|private:|protected:)|\bstd::|\bconstexpr\b|\bvirtual\b")
    return F.when((ext == ".h") & objc, "objc").when((ext == ".h") & cpp, "cpp").otherwise(found)


def is_source(path: Text) -> Column:
    return language_of(path).isNotNull()


def is_distinctive(token: Text) -> Column:
    """A token that looks like an identifier: an underscore, a digit, or a
    capital after the first character."""
    return col(token).rlike(r"[_0-9]|^.+[A-Z]")


def query_guard(text: Text) -> Column:
    """Why a query is no symbol name: cjk, hex, digits, question, space; or null."""
    t = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    return (
        F.when(t.rlike("[一-鿿]"), "cjk").when(t.rlike("^0x[0-9A-Fa-f]+$"), "hex").when(t.rlike("^[0-9]+$"), "digits").when(t.rlike("[?？]"), "question").when(t.rlike(r"\s"), "space")
    )


CONFIG_LANGUAGES = ("yaml", "properties", "xml", "toml", "json")


def is_config_leaf(language: Text = "language", kind: Text = "kind") -> Column:
    """Leaves of configuration files, whose values are never shown."""
    return col(language).isin(*CONFIG_LANGUAGES) & col(kind).isin("constant", "property", "field", "variable")


def shown_source(text: Text) -> Column:
    """A node's source, or only its name where the source may hold a secret."""
    return F.when(is_config_leaf(), F.coalesce("signature", "qualified_name", "name")).otherwise(col(text))


def json_list(c: Text) -> Column:
    """A JSON list of strings; null where it is none."""
    return F.from_json(col(c), "array<string>")
