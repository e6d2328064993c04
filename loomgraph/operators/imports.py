"""What import statements name: modules, packages, namespaces and include paths.

Rules give (import_id, path) for files, (import_id, target) for nodes. They are
joins by equality on paths that are worked out beforehand; the statements
themselves are read from source text by patterns, one row a binding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import Graph
from . import resolve as R

JS = ("javascript", "jsx", "typescript", "tsx", "vue", "svelte")
PYTHON_ENDINGS = (".py", "/__init__.py")
LUA_ENDINGS = (".lua", "/init.lua")


@dataclass(frozen=True)
class Imports:
    """bindings: (file_path, local, exported, module); reexports: (file_path,
    exported, module, name), ``*`` for all; aliases: (prefix, target)."""

    bindings: DataFrame
    reexports: DataFrame | None = None
    aliases: DataFrame | None = None


# -- statements in source text ------------------------------------------------


def _matches(source: DataFrame, pattern: str, *names: str) -> DataFrame:
    groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    z = source.select("file_path", "language", F.explode(F.arrays_zip(*groups)).alias("z"))
    return z.select("file_path", "language", *(F.col("z").getField(n).alias(n) for n in names))


def _listed(rows: DataFrame, column: str) -> DataFrame:
    """One row for each ``name`` or ``name as local`` of a list."""
    one = F.explode(F.split(F.regexp_replace(column, r"[(){}]", ""), ",")).alias("_one")
    each = rows.select("file_path", "module", one).withColumn("_one", F.regexp_replace(F.trim("_one"), r"^type\s+", "")).filter("_one <> ''")
    name, local = F.regexp_extract("_one", r"^([\w$*]+)", 1), F.regexp_extract("_one", r"\sas\s+([\w$]+)", 1)
    return each.select("file_path", F.when(local != "", local).otherwise(name).alias("local"), name.alias("exported"), "module").filter("exported <> ''")


def bindings(contents: DataFrame) -> DataFrame:
    """contents: (file_path, language, text). (file_path, local, exported, module):
    what names imports bring into a file; exported ``*`` for a whole module,
    ``default`` for a default."""
    of = lambda *languages: contents.filter(F.col("language").isin(*languages))
    js, py, go, jvm, php = of(*JS), of("python"), of("go"), of("java", "kotlin", "scala"), of("php")
    q = r"""['"]([^'"\n]+)['"]"""
    whole = lambda rows, local: rows.select("file_path", local.alias("local"), F.lit("*").alias("exported"), "module")
    last = F.regexp_extract("module", r"([\w-]+)$", 1)
    alias = lambda c, other: F.when(F.col(c) != "", F.col(c)).otherwise(other)
    parts = [
        _listed(_matches(js, rf"import\s+(?:[\w$]+\s*,\s*)?(\{{[^}}]*\}})\s*from\s*{q}", "names", "module"), "names"),
        _matches(js, rf"import\s+([\w$]+)\s*(?:,\s*\{{[^}}]*\}}\s*)?from\s*{q}", "local", "module").select("file_path", "local", F.lit("default").alias("exported"), "module"),
        whole(_matches(js, rf"import\s+\*\s+as\s+([\w$]+)\s+from\s*{q}", "local", "module"), F.col("local")),
        whole(_matches(js, rf"(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*{q}\s*\)", "local", "module"), F.col("local")),
        _listed(_matches(js, rf"(?:const|let|var)\s+(\{{[^}}]*\}})\s*=\s*require\(\s*{q}\s*\)", "names", "module").withColumn("names", F.regexp_replace("names", r"\s*:\s*", " as ")), "names"),
        _listed(_matches(py, r"(?m)^\s*from\s+([.\w]+)\s+import\s+(\([^)]*\)|[^\n#(]+)", "module", "names"), "names"),
        whole(_matches(py, r"(?m)^\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?", "module", "as"), alias("as", F.col("module"))),
        whole(_matches(go, r"(?m)^\s*(?:import\s+)?([\w.]*)\s*\"([^\"\s]+)\"\s*$", "as", "module"), alias("as", last)),
        _matches(jvm, r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\.(\w+)(?:\s+as\s+(\w+))?\s*;?\s*$", "package", "exported", "as").select("file_path", alias("as", F.col("exported")).alias("local"), "exported", F.concat_ws(".", "package", "exported").alias("module")),
        _matches(php, r"(?m)^\s*use\s+([\w\\]+)\\(\w+)(?:\s+as\s+(\w+))?\s*;", "package", "exported", "as").select("file_path", alias("as", F.col("exported")).alias("local"), "exported", F.concat_ws("\\", "package", "exported").alias("module")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def reexports(contents: DataFrame) -> DataFrame:
    """(file_path, exported, module, name): ``export {a as b} from 'm'`` gives b as a
    of m, ``export * from 'm'`` gives ``*``."""
    js = contents.filter(F.col("language").isin(*JS))
    q = r"""['"]([^'"\n]+)['"]"""
    named = _listed(_matches(js, rf"export\s+(?:type\s+)?(\{{[^}}]*\}})\s*from\s*{q}", "names", "module"), "names")
    named = named.select("file_path", F.col("local").alias("exported"), "module", F.col("exported").alias("name"))
    every = _matches(js, rf"export\s+\*\s+from\s*{q}", "module").select("file_path", F.lit("*").alias("exported"), "module", F.lit("*").alias("name"))
    return named.unionByName(every).distinct()


# -- modules to files and nodes -----------------------------------------------


def package_of(module: Column | str = "module") -> Column:
    """The package of a bare module: its first segment, two for a scoped one."""
    m = X.col(module)
    return F.when(m.startswith("@"), F.regexp_extract(m, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(m, r"^([^/]+)", 1))


def external_modules(modules: DataFrame, found: DataFrame) -> DataFrame:
    """(import_id, package) of the bare modules that no file of the project answers."""
    bare = modules.filter(~F.col("module").rlike(r"^[./]"))
    return bare.join(found.select("import_id"), "import_id", "left_anti").select("import_id", package_of().alias("package"))


def workspace_aliases(packages: DataFrame) -> DataFrame:
    """packages: (name, directory). Aliases by which :func:`resolve.module_files`
    finds a workspace's packages and what is below them."""
    below = packages.select(F.concat("name", F.lit("/")).alias("prefix"), F.concat("directory", F.lit("/")).alias("target"))
    return packages.select(F.col("name").alias("prefix"), F.col("directory").alias("target")).unionByName(below)


def go_packages(modules: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """roots: (prefix, directory) of Go modules. (import_id, directory): the directory
    of an imported package, if it has Go files; the longest prefix wins."""
    starts = F.transform(F.sequence(F.lit(1), F.size(F.split("module", "/"))), lambda k: F.array_join(F.slice(F.split("module", "/"), F.lit(1), k), "/"))
    hit = modules.withColumn("prefix", F.explode(starts)).join(roots, "prefix")
    w = Window.partitionBy("import_id").orderBy(F.desc(F.length("prefix")), "directory")
    best = hit.withColumn("r", F.row_number().over(w)).filter("r = 1")
    path = F.regexp_replace(F.concat_ws("/", F.nullif("directory", F.lit("")), F.nullif(F.substr("module", F.length("prefix") + 2), F.lit(""))), "/+$", "")
    has = files.filter(F.col("path").endswith(".go")).select(X.dirname("path").alias("directory")).distinct()
    return best.select("import_id", path.alias("directory")).join(has, "directory", "left_semi").select("import_id", "directory")


def go_members(refs: DataFrame, used: DataFrame, nodes: DataFrame) -> DataFrame:
    """used: (file_path, local, directory). ``local.Name`` is the exported symbol of
    that name in the package's directory; the first by id."""
    r = refs.withColumn("local", F.regexp_extract("reference_name", r"^(\w+)\.", 1)).withColumn("name", F.regexp_extract("reference_name", r"^\w+\.([A-Z]\w*)$", 1)).filter("name <> ''")
    own = nodes.filter((F.col("language") == "go") & ~F.col("kind").isin("import", "file")).select("name", X.dirname("file_path").alias("directory"), F.col("id").alias("target"))
    hit = r.join(used, ["file_path", "local"]).join(own, ["directory", "name"])
    return hit.groupBy("ref_id").agg(F.min("target").alias("target")).select("ref_id", "target", F.lit(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))


def php_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """includes: (import_id, module, file_path). The file beside the including one or
    below the root; a path that is not there leads nowhere."""
    tries = F.array(F.struct(F.lit(0).alias("place"), R.relative_path().alias("path")), F.struct(F.lit(1).alias("place"), X.normal_path(F.col("module")).alias("path")))
    each = includes.select("import_id", F.inline(tries)).join(files.select("path"), "path", "left_semi")
    return each.groupBy("import_id").agg(F.min_by("path", "place").alias("path"))


def jvm_imports(modules: DataFrame, nodes: DataFrame) -> DataFrame:
    """modules: (import_id, module), fully qualified. (import_id, target): the type of
    that qualified name; else the one of that name in a file whose path ends in it."""
    m = modules.select("import_id", "module").withColumn("_name", X.name_tail("module")).withColumn("_path", F.replace("module", F.lit("."), F.lit("/")))
    t = nodes.filter(F.col("kind").isin(*R.TYPE_KINDS)).select(F.col("id").alias("target"), F.col("name").alias("_name"), X.canonical("qualified_name").alias("_qualified"), "file_path")
    stem = F.regexp_replace("file_path", r"\.(java|kt|kts|scala)$", "")
    both = m.join(t, "_name").withColumn("place", F.when(F.col("_qualified") == X.canonical("module"), 0).when((stem == F.col("_path")) | stem.endswith(F.concat(F.lit("/"), F.col("_path"))), 1))
    return both.filter("place is not null").groupBy("import_id").agg(F.min(F.struct("place", "target"))["target"].alias("target"))


def rust_paths(uses: DataFrame, files: DataFrame) -> DataFrame:
    """uses: (import_id, module, file_path) with module as ``crate::a::b``, ``self::``
    or ``super::``. (import_id, path): the file of the longest leading path."""
    parts = F.split("module", "::")
    head, here = F.element_at(parts, 1), X.dirname("file_path")
    is_root = X.basename("file_path").isin("mod.rs", "lib.rs", "main.rs")
    own = F.when(is_root, here).otherwise(F.regexp_replace("file_path", r"\.rs$", ""))
    crate = F.regexp_extract("file_path", r"^((?:.*/)?src)/", 1)
    base = F.when(head == "crate", crate).when(head == "self", own).when(head == "super", X.dirname(own))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    sizes = F.sequence(F.size(rest), F.lit(1), F.lit(-1))
    tries = F.flatten(F.transform(sizes, lambda k: F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs")), lambda end: F.struct((-k).alias("place"), F.concat_ws("/", base, F.concat(F.array_join(F.slice(rest, F.lit(1), k), "/"), end)).alias("path")))))
    each = uses.filter(F.size(rest) > 0).filter(base.isNotNull()).select("import_id", F.inline(tries)).join(files.select("path"), "path", "left_semi")
    return each.groupBy("import_id").agg(F.min(F.struct("place", "path"))["path"].alias("path"))


def lua_requires(modules: DataFrame, files: DataFrame) -> DataFrame:
    """``require 'a.b'``: a/b.lua or a/b/init.lua."""
    return R.module_files(modules, files, LUA_ENDINGS)


def python_modules(modules: DataFrame, files: DataFrame) -> DataFrame:
    """Absolute modules by their dots; leading dots go up from the file's directory."""
    dots = F.length(F.regexp_extract("module", r"^(\.+)", 1))
    rest = F.replace(F.regexp_extract("module", r"^\.*(.*)$", 1), F.lit("."), F.lit("/"))
    up = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest)
    return R.module_files(modules.withColumn("module", F.when(dots > 0, up).otherwise(F.col("module"))), files, PYTHON_ENDINGS)


def module_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(import_id, target): the file nodes of whole modules."""
    f = nodes.filter(F.col("kind") == "file").groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("target"))
    return found.join(f, "path").select("import_id", "target")


def usings(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Razor: declared (path, namespace) in ``_Imports.razor`` or a file itself;
    (path, namespace) of what is in sight of each file: its own, and that of the
    imports files of its directory and all above it."""
    own = declared.filter(~F.col("path").rlike(r"(^|/)_Imports\.razor$"))
    shared = declared.filter(F.col("path").rlike(r"(^|/)_Imports\.razor$")).select(X.dirname("path").alias("_dir"), "namespace")
    parts = F.filter(F.split(X.dirname("path"), "/"), lambda x: x != ".")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")))
    seen = files.select("path", F.explode(above).alias("_dir")).join(shared, "_dir").select("path", "namespace")
    return seen.unionByName(own.join(files.select("path"), "path", "left_semi").select("path", "namespace")).distinct()


def strategy(g: Graph, imports: Imports) -> DataFrame:
    """Rows of the import strategy for :func:`resolve.resolve`: references to bound
    names, through re-exports, and Go's and the JVM's package members."""
    files = g.files.select("path")
    modules = R.cut(imports.bindings.select("file_path", "module").distinct().withColumn("import_id", F.xxhash64("file_path", "module")))
    python = modules.join(g.files.filter(F.col("language") == "python").select(F.col("path").alias("file_path")), "file_path", "left_semi")
    other = modules.join(python.select("import_id"), "import_id", "left_anti")
    found = R.cut(python_modules(python, files).unionByName(R.module_files(other, files, aliases=imports.aliases)))
    at = modules.join(found, "import_id").select("file_path", "module", "path")
    mapping = imports.bindings.join(at, ["file_path", "module"]).select("file_path", "local", "exported", "path")
    chased = None
    if imports.reexports is not None:
        more = imports.reexports.select("file_path", "module").distinct().withColumn("import_id", F.xxhash64("file_path", "module"))
        to = more.join(R.module_files(more, files, aliases=imports.aliases), "import_id").select("file_path", "module", F.col("path").alias("to_path"))
        chased = imports.reexports.join(to, ["file_path", "module"]).select(F.col("file_path").alias("path"), "exported", "to_path", F.col("name").alias("to_name"))
    refs = g.refs.filter(F.col("status") == "pending")
    named = R.imported(refs, mapping.filter("exported <> '*'"), g.nodes, chased)
    types = jvm_imports(modules.select("import_id", "module"), g.nodes).join(modules, "import_id")
    bound = imports.bindings.join(types.select("file_path", "module", "target"), ["file_path", "module"]).select("file_path", F.col("local").alias("reference_name"), "target")
    jvm = refs.select("ref_id", "file_path", "reference_name").join(bound, ["file_path", "reference_name"]).groupBy("ref_id").agg(F.min("target").alias("target"))
    return named.unionByName(jvm.select("ref_id", "target", F.lit(0.95).alias("confidence"), F.lit("import").alias("resolved_by")))
