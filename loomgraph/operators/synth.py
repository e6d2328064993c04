"""Derived edges: rules that join what is known of nodes with each other.

Every rule gives rows of the edge schema with provenance ``heuristic`` and
``synthesizedBy`` in their metadata. Rules read one snapshot of the graph, and
what they give is merged once, the first rule winning for a pair. Fan-out is
bounded by counting a group before it is joined, never after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import EDGES, Graph, conform
from .resolve import TYPE_KINDS
from .storage import absent, cut

FANOUT, EVENT_FANOUT, CHANNEL = 40, 6, 8

# Names of what registers and what dispatches (fixed values).
REGISTRAR = r"^(on[A-Z]\w*|subscribe|addListener|addEventListener|register|watch|listen|addCallback)$"
DISPATCHER = r"(?i)(emit|trigger|notify|dispatch|fire|publish|flush)"


def made(rows: DataFrame, by: str, kind: str = "calls", **meta: Column) -> DataFrame:
    """Edges of (source, target[, line])."""
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    rows = rows.withColumn("metadata", F.create_map(F.lit("synthesizedBy"), F.lit(by), *pairs)).withColumn("kind", F.lit(kind)).withColumn("provenance", F.lit("heuristic"))
    return conform(rows, EDGES)


def capped(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group (the rules' own limit of fan-out)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def few(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Rows of groups of at most ``most``; counted before anything is joined."""
    return rows.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most).drop("_n"), by, "left_semi")


#: Rows of one key and side that one piece of :func:`spread` holds.
PIECE = 1000


def spread(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The join of ``a`` and ``b``, all pairs of a key. A key that many rows of both have
    gives pairs by the square: its rows are dealt into pieces, and every piece of one side
    meets every piece of the other in a group of its own, so no task has the whole key."""

    def pieces(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / PIECE).alias(name))

    n = cut(pieces(a, "_na").join(pieces(b, "_nb"), on).filter("_na > 1 or _nb > 1"))
    if n.isEmpty():
        return a.join(b, on)

    def dealt(df: DataFrame, mine: str, other: str, me: str, it: str) -> DataFrame:
        count = lambda x: F.coalesce(F.col(x), F.lit(1))
        df = df.join(n, on, "left").withColumn(me, F.pmod(F.xxhash64(*df.columns), count(mine)))
        return df.withColumn(it, F.explode(F.sequence(F.lit(0), count(other) - 1).cast("array<bigint>"))).drop("_na", "_nb")

    return dealt(a, "_na", "_nb", "_pa", "_pb").join(dealt(b, "_nb", "_na", "_pb", "_pa"), [*on, "_pa", "_pb"]).drop("_pa", "_pb")


def _members(g: Graph, kinds: tuple[str, ...] = ("method", "function")) -> DataFrame:
    e = g.edges.filter(F.col("kind") == "contains").select(F.col("source").alias("owner"), F.col("target").alias("id")).distinct()
    return e.join(g.nodes.filter(F.col("kind").isin(*kinds)), "id")


def _types(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("kind").isin(*TYPE_KINDS))


def receiver_contains(g: Graph) -> DataFrame:
    """Go: a method whose receiver type is in another file of its directory, unless
    a type holds it already. ``qualified_name`` is ``Type::method``."""
    m = g.nodes.filter((F.col("language") == "go") & (F.col("kind") == "method")).withColumn("type_name", F.element_at(F.split("qualified_name", "::"), 1)).filter(F.size(F.split("qualified_name", "::")) > 1)
    held = g.edges.filter(F.col("kind") == "contains").join(_types(g).select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    free = m.join(held.distinct(), "id", "left_anti").select(F.col("id").alias("target"), "type_name", X.dirname("file_path").alias("dir"))
    t = g.nodes.filter((F.col("language") == "go") & F.col("kind").isin("struct", "class", "type_alias", "interface")).groupBy(F.col("name").alias("type_name"), X.dirname("file_path").alias("dir")).agg(F.min("id").alias("source"))
    return conform(free.join(t, ["type_name", "dir"]).withColumn("kind", F.lit("contains")), EDGES)


def satisfies(g: Graph, types: tuple[str, ...] = ("struct", "class"), language: str | None = "go", most: int = FANOUT, by: str = "implicit-interface", kind: str = "implements") -> DataFrame:
    """A type with every method of an interface implements it, the first ``most`` types
    by id. Division by counting: methods met of each set of methods that types have,
    against those of each set that interfaces have."""
    m = _members(g)
    m = m if language is None else m.filter(F.col("language") == language)

    def sets(owners: DataFrame, name: str) -> DataFrame:
        own = m.join(owners.select(F.col("id").alias("owner")), "owner", "left_semi").groupBy(F.col("owner").alias(name)).agg(F.sort_array(F.collect_set("name")).alias("names"))
        return cut(own.withColumn(f"{name}_set", F.sha2(F.to_json("names"), 256)))

    want = sets(_types(g).filter(F.col("kind") == "interface"), "target")
    have = sets(_types(g).filter(F.col("kind").isin(*types)), "source")
    # equal sets of methods are divided once: sets met against the size of each
    few_want, few_have = (x.select(f"{n}_set", "names").dropDuplicates([f"{n}_set"]) for x, n in ((want, "target"), (have, "source")))
    sizes = few_want.select("target_set", F.size("names").alias("n"))
    met = few_want.select("target_set", F.explode("names").alias("name")).join(few_have.select("source_set", F.explode("names").alias("name")), "name")
    full = met.groupBy("source_set", "target_set").agg(F.count(F.lit(1)).alias("m")).join(sizes, "target_set").filter("m = n")
    fits = capped(full.join(have, "source_set").select("target_set", "source"), ["target_set"], ["source"], most)
    return made(fits.join(want, "target_set").select("source", "target"), by, kind)


def override(g: Graph, languages: tuple[str, ...] = ("cpp", "c"), kinds: tuple[str, ...] = ("extends",), by: str = "override", most: int = FANOUT) -> DataFrame:
    """A method of a base calls the method of the same name in a derived type."""
    up = g.edges.filter(F.col("kind").isin(*kinds)).select(F.col("source").alias("derived"), F.col("target").alias("base")).distinct()
    m = _members(g).filter(F.col("language").isin(*languages)).select("owner", "id", "name")
    b, d = m.select(F.col("owner").alias("base"), F.col("id").alias("source"), "name"), m.select(F.col("owner").alias("derived"), F.col("id").alias("target"), "name")
    rows = up.join(b, "base").join(d, ["derived", "name"]).filter("source <> target").select("source", "target").distinct()
    return made(capped(rows, ["source"], ["target"], most), by)


def interface_dispatch(g: Graph, languages: tuple[str, ...] = ("java", "kotlin", "csharp", "swift", "typescript", "tsx", "php", "scala", "dart", "go", "rust", "python")) -> DataFrame:
    return override(g, languages, ("implements", "extends"), "interface-dispatch")


def declarations(g: Graph, languages: tuple[str, ...] = ("c",), kinds: tuple[str, ...] = ("function",), header: str = r"\.(h|hpp|hh|hxx)$", by: str = "decl-def", key: str = "name") -> DataFrame:
    """A header's declaration and the definition of the same name in another file."""
    n = g.nodes.filter(F.col("language").isin(*languages) & F.col("kind").isin(*kinds)).withColumn("_key", X.last_two("qualified_name") if key == "qualified_name" else F.col("name"))
    from ..functions.cpp import parameter_key

    said = F.coalesce("is_declaration", F.lit(False))
    own = ["_key", "kind"]
    if key == "qualified_name":  # worked out once for each node, not for each pair
        n, own = n.withColumn("_open", F.col("signature").isNull()).withColumn("_takes", parameter_key("signature", "name")), [*own, "_open", "_takes"]
    d = n.filter(said & F.col("file_path").rlike(header)).select(F.col("id").alias("source"), *own, F.col("file_path").alias("at")).distinct()
    f = n.filter(~said).select(F.col("id").alias("target"), *own, F.col("file_path").alias("in")).distinct()
    if key == "qualified_name":
        d, f = cut(d), cut(f)
        pairs = [(d.filter("not _open").drop("_open"), f.filter("not _open").drop("_open"), ["_key", "kind", "_takes"])]
        pairs += [(a.drop("_open", "_takes"), b.drop("_open", "_takes"), ["_key", "kind"]) for a, b in ((d.filter("_open"), f), (d.filter("not _open"), f.filter("_open")))]
    else:
        pairs = [(d, f, own)]
    rows = None
    for a, b, on in pairs:
        r = spread(a, b, on).filter("at <> in").select("source", "target")
        rows = r if rows is None else rows.unionByName(r)
    # pairs are as many as they are different, unless an id has several rows
    again = [x for x, i in ((d, "source"), (f, "target")) if not x.groupBy(i).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()]
    return made(rows.distinct() if again else rows, by, "defines")


def cpp_declarations(g: Graph) -> DataFrame:
    return declarations(g, ("cpp", "c"), ("function", "method"), by="cpp-decl-def", key="qualified_name")


def variable_declarations(g: Graph) -> DataFrame:
    return declarations(g, ("c", "cpp"), ("variable", "constant"), by="variable-decl-def")


def expect_actual(g: Graph) -> DataFrame:
    """Kotlin: an expected symbol and the actual one of the same name elsewhere."""
    k = g.nodes.filter((F.col("language") == "kotlin") & F.col("qualified_name").isNotNull())
    e = k.filter(F.array_contains("decorators", "expect")).select(F.col("id").alias("source"), "qualified_name", F.col("kind").alias("ek"), F.col("file_path").alias("at"))
    a = k.filter(F.array_contains("decorators", "actual")).select(F.col("id").alias("target"), "qualified_name", F.col("kind").alias("ak"), F.col("file_path").alias("in"))
    fits = (F.col("ek") == F.col("ak")) | F.col("ek").isin("class", "interface") & F.col("ak").isin("class", "interface", "type_alias")
    return made(spread(e, a, ["qualified_name"]).filter("at <> in").filter(fits).select("source", "target"), "expect-actual")


def stub_implementation(g: Graph, most: int = FANOUT) -> DataFrame:
    """gRPC: a generated interface whose methods a hand-written type has."""
    stub = g.nodes.filter((F.col("kind") == "interface") & X.is_generated("file_path"))
    own = g.nodes.filter(~(F.col("kind") == "interface") | X.is_generated("file_path"))
    return satisfies(Graph(stub.unionByName(own), g.edges), language=None, most=most, by="grpc-stub", kind="calls")


def sibling_render(g: Graph, languages: tuple[str, ...] = ("javascript", "jsx", "typescript", "tsx"), sets: str = "setState", renders: str = "render", by: str = "re-render") -> DataFrame:
    """A method that calls ``sets`` leads to the ``renders`` of the same class."""
    setters = g.edges.filter(F.col("kind") == "calls").join(g.nodes.filter(F.col("name") == sets).select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    if g.refs is not None:
        setters = setters.unionByName(g.refs.filter(F.col("reference_name").rlike(rf"(^|\.){sets}$")).select(F.col("from_node_id").alias("id")))
    m = _members(g).filter(F.col("language").isin(*languages))
    a = m.join(setters.distinct(), "id", "left_semi").select("owner", F.col("id").alias("source"))
    b = m.filter(F.col("name") == renders).select("owner", F.col("id").alias("target"))
    return made(a.join(b, "owner").filter("source <> target").select("source", "target").distinct(), by)


def flutter_rebuild(g: Graph) -> DataFrame:
    return sibling_render(g, ("dart",), "setState", "build", "flutter-rebuild")


def channel(emits: DataFrame, handles: DataFrame, most: int = EVENT_FANOUT, by: str = "event-emitter") -> DataFrame:
    """emits: (id, event, line), handles: (id, event). Events that more than
    ``most`` nodes emit or handle are no channel."""
    e, h = few(emits.select("id", "event").distinct(), ["event"], most), few(handles.select("id", "event").distinct(), ["event"], most)
    rows = e.withColumnRenamed("id", "source").join(h.withColumnRenamed("id", "target"), "event").filter("source <> target")
    at = emits.groupBy(F.col("id").alias("source"), "event").agg(F.min("line").alias("line"))
    return made(rows.join(at, ["source", "event"]), by, event=F.col("event"))


_EVENT = r"""\.(?:emit|fire|dispatch|trigger|publish)\(\s*['"]([^'"]+)['"]"""
_HANDLER = r"""\.(?:on|once|addListener|addEventListener|subscribe)\(\s*['"]([^'"]+)['"]\s*,\s*(?:this\.)?(\w+)"""


def occurrences(source: DataFrame, pattern: str, *names: str) -> DataFrame:
    """source: (id, file_path, text). A row of (id, file_path, names) a match."""
    groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    z = source.select("id", "file_path", F.arrays_zip(*groups).alias("z")).select("id", "file_path", F.explode("z").alias("z"))
    return z.select("id", "file_path", *(F.col("z").getField(n).alias(n) for n in names))


def event_emitter(g: Graph, source: DataFrame, most: int = EVENT_FANOUT, by: str = "event-emitter") -> DataFrame:
    """source: (id, file_path, text) of callables. Emitted events to the functions
    that are registered for them, in the same file if there is such a one."""
    emits = occurrences(source.filter(F.contains("text", F.lit("("))), _EVENT, "event").withColumn("line", F.lit(None).cast("int"))
    wants = occurrences(source, _HANDLER, "event", "name")
    n = g.nodes.filter(F.col("kind").isin("function", "method")).select("name", F.col("id").alias("target"), F.col("file_path").alias("at"))
    c = wants.join(n, "name").withColumn("r", F.row_number().over(Window.partitionBy("id", "event", "name").orderBy(F.desc(F.col("at") == F.col("file_path")), "target"))).filter("r = 1")
    return channel(emits, c.select(F.col("target").alias("id"), "event"), most, by)


def observers(source: DataFrame, g: Graph) -> DataFrame:
    """A dispatcher that reads a field leads to the registrars that write it, in the
    same file."""
    n = g.nodes.filter(F.col("kind").isin("method", "function")).select("id", "name")
    fields = occurrences(source, r"this\.(\w+)", "field").distinct().join(n, "id")
    d = few(fields.filter(F.col("name").rlike(DISPATCHER)).select(F.col("id").alias("source"), "file_path", "field"), ["file_path", "field"], CHANNEL)
    r = few(fields.filter(F.col("name").rlike(REGISTRAR)).select(F.col("id").alias("target"), "file_path", "field"), ["file_path", "field"], CHANNEL)
    return made(d.join(r, ["file_path", "field"]).filter("source <> target").select("source", "target", "field").distinct(), "field-observer", field=F.col("field"))


def closures(source: DataFrame, g: Graph) -> DataFrame:
    """A collection that one callable appends to and another goes through and calls."""
    adds = few(occurrences(source, r"(\w+)\s*(?:\.append|\.push|\.add|\+=)\s*\(", "field").distinct(), ["file_path", "field"], CHANNEL)
    runs = few(occurrences(source, r"for\s*\(?\s*(?:\w+\s+)?\w+\s+(?:in|of|:)\s+(?:this\.|self\.)?(\w+)", "field").distinct(), ["file_path", "field"], CHANNEL)
    rows = runs.withColumnRenamed("id", "source").join(adds.withColumnRenamed("id", "target"), ["file_path", "field"]).filter("source <> target")
    return made(rows.select("source", "target", "field").distinct(), "closure-collection", field=F.col("field"))


def tag_children(g: Graph, source: DataFrame, pattern: str = r"<([A-Z]\w*)", most: int = 30, by: str = "jsx-child") -> DataFrame:
    """A component whose text has the tag of another renders it; a tag's node in
    the same file comes first, then by id; at most ``most`` for one parent."""
    tags = occurrences(source, pattern, "name").distinct()
    n = g.nodes.filter(F.col("kind").isin("component", "function", "class")).select("name", F.col("id").alias("target"), F.col("file_path").alias("at"), "kind")
    c = tags.join(n, "name").filter("id <> target")
    w = Window.partitionBy("id", "name").orderBy(F.desc(F.col("at") == F.col("file_path")), F.desc(F.col("kind") == "component"), "target")
    first = c.withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("id").alias("source"), "target")
    return made(capped(first.distinct(), ["source"], ["target"], most), by)


def vue_template(g: Graph, source: DataFrame) -> DataFrame:
    """Tags in kebab or Pascal case, and ``@event="handler"`` in the same file."""
    tags = occurrences(source, r"<([A-Za-z][\w-]*)", "tag").withColumn("name", F.when(F.col("tag").contains("-"), X.pascal("tag")).otherwise(F.col("tag")))
    n = g.nodes.filter(F.col("kind").isin("component", "class")).groupBy("name").agg(F.min("id").alias("target"))
    children = tags.join(n, "name").select(F.col("id").alias("source"), "target")
    calls = occurrences(source, r"""(?:@|v-on:)[\w.-]+=['"](\w+)""", "name")
    h = g.nodes.filter(F.col("kind").isin("function", "method", "variable")).groupBy("name", "file_path").agg(F.min("id").alias("target"))
    handlers = calls.join(h, ["name", "file_path"]).select(F.col("id").alias("source"), "target")
    return made(children.unionByName(handlers).filter("source <> target").distinct(), "vue-template")


def native_events(g: Graph, native: DataFrame, script: DataFrame) -> DataFrame:
    """Events that native code sends and script code listens to."""
    sends = occurrences(native, r"""(?:sendEventWithName:\s*@?|\.emit\(|sendEvent\()\s*"([^"]+)\"""", "event").withColumn("line", F.lit(None).cast("int"))
    hears = occurrences(script, r"""addListener\(\s*['"]([^'"]+)['"]""", "event")
    return channel(sends, hears, by="native-event")


def cross_platform(g: Graph, languages: tuple[str, ...] = ("swift", "kotlin", "java", "objc"), key: str = "qualified_name", by: str = "cross-platform", called_from: tuple[str, ...] | None = None, most: int = FANOUT) -> DataFrame:
    """Methods of one name in two native languages, both ways; ``called_from``
    keeps those that code in these languages calls."""
    n = g.nodes.filter(F.col("kind").isin("method", "function") & F.col("language").isin(*languages)).select("id", "language", X.name_token(key).alias("key")).filter("key <> ''")
    if called_from is not None:
        called = g.edges.filter(F.col("kind") == "calls").join(g.nodes.filter(F.col("language").isin(*called_from)).select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
        n = n.join(n.join(called.distinct(), "id", "left_semi").select("key").distinct(), "key", "left_semi")
    n = few(n, ["key"], most)
    rows = n.select(F.col("id").alias("source"), "key", F.col("language").alias("a")).join(n.select(F.col("id").alias("target"), "key", F.col("language").alias("b")), "key").filter("a <> b")
    return made(rows.select("source", "target").distinct(), by)


SUFFIXES = ("", "View", "ComponentView", "Manager", "ViewManager")


def native_component(g: Graph) -> DataFrame:
    """A component and the native class of its name with one of five endings."""
    c = g.nodes.filter(F.col("kind") == "component").select(F.col("id").alias("source"), F.explode(F.array(*(F.concat("name", F.lit(s)) for s in SUFFIXES))).alias("name"))
    n = g.nodes.filter(F.col("kind").isin("class", "struct", "interface") & F.col("language").isin("objc", "cpp", "java", "kotlin", "swift")).select("name", F.col("id").alias("target"))
    return made(c.join(n, "name").select("source", "target").distinct(), "native-component")


def mapper_statements(g: Graph) -> DataFrame:
    """MyBatis: the sole method ``Class::name`` of a statement of that name."""
    tail = X.last_two("qualified_name")
    x = g.nodes.filter((F.col("language") == "xml") & (F.col("kind") == "method")).select(F.col("id").alias("target"), tail.alias("key"))
    j = g.nodes.filter(F.col("language").isin("java", "kotlin") & (F.col("kind") == "method")).select(F.col("id").alias("source"), tail.alias("key"))
    sole = j.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source")).filter("n = 1")
    return made(x.join(sole, "key").select("source", "target"), "mapper")


def middleware(g: Graph, handlers: DataFrame, dispatchers: tuple[str, ...] = ("Next",), most: int = FANOUT) -> DataFrame:
    """handlers: (id) that are registered. The dispatcher of a chain leads to the
    first ``most`` of them."""
    d = g.nodes.filter((F.col("kind") == "method") & F.col("name").isin(*dispatchers)).orderBy("id").limit(most).select(F.col("id").alias("source"))
    h = handlers.select(F.col("id").alias("target")).distinct().orderBy("target").limit(most)
    return made(h.join(F.broadcast(d), F.col("source") != F.col("target")), "middleware")  # ``most`` rows a side


def paired_files(g: Graph, pairs: tuple[tuple[str, str], ...] = ((r"\.(dfm|fmx)$", ".pas"),), by: str = "form-unit", kind: str = "references") -> DataFrame:
    """A file and the one of the same path with another ending."""
    f = g.nodes.filter(F.col("kind") == "file").select("id", "file_path")
    t = f.select(F.col("id").alias("target"), F.col("file_path").alias("path"))
    rows = None
    for pattern, ending in pairs:
        r = f.filter(F.col("file_path").rlike(pattern)).withColumn("path", F.regexp_replace("file_path", pattern, ending)).join(t, "path").select(F.col("id").alias("source"), "target")
        rows = r if rows is None else rows.unionByName(r)
    return made(rows, by, kind)


def page_loaders(g: Graph) -> DataFrame:
    """SvelteKit: a page or layout and the loader beside it."""
    f = g.nodes.filter(F.col("kind") == "file").select("id", "file_path")
    name = X.basename("file_path")
    page = f.filter(name.rlike(r"^\+(page|layout)\.svelte$")).select(F.col("id").alias("source"), X.dirname("file_path").alias("dir"), F.regexp_extract(name, r"^\+(page|layout)", 1).alias("what"))
    load = f.filter(name.rlike(r"^\+(page|layout)(\.server)?\.(js|ts)$")).select(F.col("id").alias("target"), X.dirname("file_path").alias("dir"), F.regexp_extract(name, r"^\+(page|layout)", 1).alias("what"))
    return made(page.join(load, ["dir", "what"]).select("source", "target"), "page-loader")


def merge(*passes: DataFrame) -> DataFrame:
    """One edge for each (source, target): of the first pass that has it."""
    every = None
    for i, p in enumerate(passes):
        p = p.withColumn("_pass", F.lit(i))
        every = p if every is None else every.unionByName(p)
    keyed = every.withColumn("_seq", F.struct("_pass", "kind", F.coalesce("line", F.lit(-1))))
    w = Window.partitionBy("source", "target").orderBy("_seq")
    return keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_pass", "_seq")


#: Rules that need no source text, with the languages that call for them.
RULES = (
    (override, ("cpp", "c")), (cpp_declarations, ("cpp",)), (declarations, ("c",)), (variable_declarations, ("c", "cpp")), (interface_dispatch, None), (expect_actual, ("kotlin",)),
    (stub_implementation, None), (sibling_render, ("javascript", "jsx", "typescript", "tsx")), (flutter_rebuild, ("dart",)), (native_component, None), (mapper_statements, ("xml",)),
    (paired_files, ("pascal",)), (page_loaders, ("svelte",)),
)
_SCRIPT = ("javascript", "jsx", "typescript", "tsx")
_NATIVE = ("objc", "cpp", "java", "kotlin", "swift")


def _of(source: DataFrame, g: Graph, languages: tuple[str, ...]) -> DataFrame:
    return source.join(g.nodes.filter(F.col("language").isin(*languages)).select("id"), "id", "left_semi")


#: Rules over the text of callables, with the languages that call for them.
TEXT_RULES = (
    (lambda g, s: observers(s, g), None), (lambda g, s: closures(s, g), None), (lambda g, s: event_emitter(g, s), None), (lambda g, s: tag_children(g, _of(s, g, _SCRIPT)), _SCRIPT),
    (lambda g, s: vue_template(g, _of(s, g, ("vue",))), ("vue",)), (lambda g, s: native_events(g, _of(s, g, _NATIVE), _of(s, g, _SCRIPT)), _SCRIPT),
    (lambda g, s: middleware(g, registered(g, _of(s, g, ("go",)))), ("go",)), (lambda g, s: cross_platform(g, called_from=_SCRIPT), _SCRIPT),
)


def registered(g: Graph, source: DataFrame) -> DataFrame:
    """(id) of the functions that ``Use`` and its like are given in the text."""
    named = occurrences(source, r"\.(?:Use|GET|POST|PUT|PATCH|DELETE|Any)\([^)\n]*?\b([A-Za-z_]\w*)\s*\)", "name").select("name").distinct()
    return g.nodes.filter(F.col("kind").isin("function", "method")).join(named, "name", "left_semi").select("id")


def synthesize(g: Graph, source: DataFrame | None = None) -> DataFrame:
    """New edges of all rules for the languages that are there; of those over text
    where ``source`` (id, file_path, text) of the callables is given. Receiver
    containment and satisfied interfaces come first, as later rules build on them."""
    have = {r["language"] for r in g.nodes.select("language").distinct().collect()}  # a closed set
    early = cut(receiver_contains(g)) if "go" in have else None  # read by every rule
    if early is not None:
        g = g.with_edges(g.edges.unionByName(early))
        also = cut(satisfies(g))
        g, early = g.with_edges(g.edges.unionByName(also)), early.unionByName(also)
    passes = [rule(g) for rule, languages in RULES if languages is None or have & set(languages)]
    if source is not None:
        passes += [rule(g, source) for rule, languages in TEXT_RULES if languages is None or have & set(languages)]
    late = absent(merge(*passes).select(*EDGES.names), g.edges, "source", "target")
    return late if early is None else early.unionByName(late)


def scoped_declarations(g: Graph, changed: DataFrame) -> DataFrame:
    """The C and C++ rules again for the names that changed files have (paths)."""
    names = g.nodes.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("name").distinct()
    near = g.nodes.join(names, "name", "left_semi").unionByName(_types(g)).dropDuplicates(["id"])
    part = Graph(near, g.edges)
    return merge(override(part), cpp_declarations(part), declarations(part), variable_declarations(part)).select(*EDGES.names)


def enclosing(points: DataFrame, g: Graph, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """points: (point_id, file_path, line). The innermost callable around each, the
    latest start winning. Each line of a file is asked for once, and meets each range of
    lines once: a range falls into one or two bins as wide as the next power of two."""
    n = g.nodes.filter(F.col("kind").isin(*kinds)).groupBy("file_path", "start_line", "end_line").agg(F.min("id").alias("id")).filter("start_line <= end_line")
    n = n.withColumn("_k", F.length(F.bin(F.col("end_line").cast("long") - F.col("start_line")))).withColumn("_bin", F.explode(F.expr("sequence(shiftright(cast(start_line as bigint), _k), shiftright(cast(end_line as bigint), _k))")))
    asked = points.select("file_path", "line").distinct().join(n.select("file_path", "_k").distinct(), "file_path").withColumn("_bin", F.expr("shiftright(cast(line as bigint), _k)"))
    hit = asked.join(n, ["file_path", "_k", "_bin"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = hit.groupBy("file_path", "line").agg(F.min(F.struct((-F.col("start_line").cast("long")).alias("from"), "end_line", "id")).alias("_b"))
    return points.join(best, ["file_path", "line"]).groupBy("point_id").agg(F.min("_b").alias("_b")).select("point_id", "_b.id")
