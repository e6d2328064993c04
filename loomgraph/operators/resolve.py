"""References to names, resolved to nodes by ranked joins.

Each strategy gives candidate rows (ref_id, target, confidence, stage); one row
of each reference is chosen by a window. Reference names are joined by equality,
so work is in proportion to matches, not to references times nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import CALLABLE, Graph
from .storage import cut, stored

#: Languages that share a type system (fixed values).
FAMILIES = {"java": "jvm", "kotlin": "jvm", "scala": "jvm", "swift": "apple", "objc": "apple", "typescript": "web", "tsx": "web", "javascript": "web", "jsx": "web", "c": "c", "cpp": "c", "csharp": "dotnet", "razor": "dotnet"}
# Names that a language or its library defines.
JS_NAMES = """
console window document global process Promise Array Object String Number Boolean Date Math JSON RegExp Error Map Set
setTimeout setInterval clearTimeout clearInterval fetch require module exports __dirname __filename
useState useEffect useContext useReducer useCallback useMemo useRef useLayoutEffect useImperativeHandle useDebugValue
""".split()
JS_PREFIXES = ("console.", "Math.", "JSON.")
PYTHON_NAMES = """
print len range str int float list dict set tuple open input type isinstance hasattr getattr setattr super self cls None True False
""".split()
PYTHON_TYPES = "list dict set tuple str int float bool bytes bytearray frozenset object super".split()
PYTHON_METHODS = """
append extend insert remove pop clear sort reverse copy update keys values items get add discard union intersection difference
split join strip lstrip rstrip replace lower upper startswith endswith find index count encode decode format isdigit isalpha isalnum
read write readline readlines close flush seek
""".split()
GO_NAMES = """
make new len cap append copy delete close panic recover print println complex real imag error nil true false iota
int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 string bool byte rune any
""".split()
GO_PACKAGES = """
fmt os io net http log math sort sync time path bytes strings strconv errors context json xml csv html template regexp reflect
runtime testing flag bufio crypto encoding filepath hash mime rand signal sql syscall unicode unsafe atomic binary debug exec heap
ring scanner tar zip gzip zlib tls url user pprof trace ast build parser printer token types cgo plugin race ioutil
utilruntime utilwait utilnet
""".split()
PASCAL_PREFIXES = ("System.", "Winapi.", "Vcl.", "Fmx.", "Data.", "Datasnap.", "Soap.", "Xml.", "Web.", "REST.", "FireDAC.", "IBX.", "IdHTTP", "IdTCP", "IdSSL")
#: Names of one character set that a candidate joins one by one; above, by directory.
HOT = 64
TYPE_KINDS = ("class", "struct", "interface", "trait", "protocol", "enum")
INSTANTIABLE = ("class", "struct", "enum")
STAGES = ("import", "framework", "file-path", "qualified-name", "method", "exact-match", "fuzzy")


def family(language: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    return F.try_element_at(table, X.col(language))


def same_family(a: Column | str, b: Column | str) -> Column:
    a, b = X.col(a), X.col(b)
    return (a == b) | F.coalesce(family(a) == family(b), F.lit(False))


def crosses(a: Column | str, b: Column | str) -> Column:
    """Two different known families."""
    return family(a).isNotNull() & family(b).isNotNull() & ~same_family(a, b)


def language_gate(kind: Column | str = "reference_kind", own: Column | str = "language", other: Column | str = "c_language", path: Column | str = "file_path") -> Column:
    """Types are used and made in their own family only (Objective-C++ may make C
    and C++ types); imports never cross two known families."""
    kind, own, other = X.col(kind), X.col(own), X.col(other)
    mixed = (own == "objc") & other.isin("c", "cpp") & F.lower(X.col(path)).endswith(".mm")
    return F.when(kind == "references", same_family(own, other)).when(kind == "instantiates", same_family(own, other) | mixed).when(kind == "imports", ~crosses(own, other)).otherwise(True)


def external(refs: DataFrame, nodes: DataFrame | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """References without what their language or its library defines, and without
    ``names``. Python's method names count only where no node has the name, or the
    receiver's with a capital; names of the C library stay, as projects define them."""
    n, lang = F.col("reference_name"), F.col("language")
    head = F.regexp_extract(n, r"^([^.]+)\.", 1)
    tail = F.when(head != "", F.substr(n, F.length(head) + 2))
    begins = lambda prefixes: _either([n.startswith(p) for p in prefixes])
    js = lang.isin("typescript", "javascript", "tsx", "jsx") & (n.isin(*JS_NAMES) | begins(JS_PREFIXES))
    go = (lang == "go") & (n.isin(*GO_NAMES) | head.isin(*GO_PACKAGES))
    other = (lang == "pascal") & begins(PASCAL_PREFIXES) | lang.isin("c", "cpp") & n.startswith("std::")
    python = (lang == "python") & (n.isin(*PYTHON_NAMES) | head.isin(*PYTHON_TYPES))
    out = refs.filter(~F.coalesce(js | go | other | python, F.lit(False)))
    out = out.filter(~n.isin(*names)) if names else out
    if nodes is None:
        return out
    owner = F.when(tail.isin(*PYTHON_METHODS), F.concat(F.upper(F.substring(head, 1, 1)), F.substr(head, F.lit(2)))).when(n.isin(*PYTHON_METHODS), n)
    asked = out.withColumn("_needs", F.when(lang == "python", owner))
    there = nodes.select(F.col("name").alias("_needs"), F.lit(True).alias("_there")).distinct()
    return asked.join(there, "_needs", "left").filter("_needs is null or _there").select(*refs.columns)


def _either(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out |= c
    return out


def constructible(kind: Column | str = "c_kind", language: Column | str = "language") -> Column:
    """What a language can make an instance of: classes and structs everywhere, other
    kinds in the languages that have an expression for it."""
    kind, language = X.col(kind), X.col(language)
    some = {"type_alias": ("c", "cpp"), "interface": ("java",), "trait": ("scala",), "enum_member": ("rust",)}  # fixed values
    return kind.isin("class", "struct") | _either([(kind == k) & language.isin(*of) for k, of in some.items()])


def gates() -> Column:
    """Language and kind gates between a reference and a candidate (c_...)."""
    return language_gate() & ((F.col("reference_kind") != "instantiates") | constructible())


def name_parts(name: Column | str = "reference_name") -> Column:
    """What a reference could be found by: the whole, each part, the last part, a
    capitalised receiver, a file name."""
    n = X.col(name)
    parts = X.qualifiers(n)
    head = F.try_element_at(parts, F.lit(1))
    return F.array_distinct(F.filter(F.concat(F.array(n, X.name_tail(n), X.basename(n), F.concat(F.upper(F.substring(head, 1, 1)), F.substr(head, F.lit(2)))), parts), lambda x: x.isNotNull() & (x != "")))


def known(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References of which some part is the name of a node."""
    each = refs.select("ref_id", F.explode(name_parts()).alias("name"))
    ids = each.join(nodes.select("name").distinct(), "name", "left_semi").select("ref_id").distinct()
    return refs.join(ids, "ref_id", "left_semi")


def _candidates(refs: DataFrame, nodes: DataFrame, on: Column | str, by: str) -> DataFrame:
    """Rows of references with the nodes whose ``by`` is their ``on``; the nodes'
    columns begin with c_."""
    cols = ("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "is_exported")
    c = nodes.select(F.col(by).alias("_key"), *(F.col(x).alias(f"c_{x}") for x in cols))
    r = refs.withColumn("_key", X.col(on))
    return r.join(c, "_key").drop("_key").filter(gates())


def _sole(refs: DataFrame, nodes: DataFrame, on: dict[str, Column]) -> DataFrame:
    """(ref_id, language, c_id, c_language) of references that one node alone fits.
    ``on``: columns of the nodes, with what of the references must equal them. Nodes
    are counted by what the gates look at and the counts joined, so a name that many
    have costs as much as one that few have."""
    c = nodes.groupBy(*on, F.col("kind").alias("c_kind"), F.col("language").alias("c_language")).agg(F.count(F.lit(1)).alias("_m"), F.min("id").alias("c_id"))
    r = refs.select("ref_id", "reference_kind", "language", "file_path", *(v.alias(k) for k, v in on.items()))
    hit = r.join(c, list(on)).filter(gates()).groupBy("ref_id").agg(F.sum("_m").alias("n"), *(F.min(x).alias(x) for x in ("language", "c_id", "c_language")))
    return hit.filter("n = 1").drop("n")


def score(proximity: Column | None = None) -> Column:
    """How well a candidate fits: file, directories, language, kind, export, and
    nearness within the file."""
    kind, c_kind = F.col("reference_kind"), F.col("c_kind")
    same_file = F.col("c_file_path") == F.col("file_path")
    near = F.greatest(F.lit(0.0), 20 - F.abs(F.col("c_start_line") - F.col("line")) / 10)
    fits = F.when((kind == "calls") & c_kind.isin(*CALLABLE), 25).when((kind == "instantiates") & constructible(), 25)
    fits = fits.when((kind == "decorates") & c_kind.isin(*CALLABLE), 25).when((kind == "decorates") & c_kind.isin("class", "interface"), 15).otherwise(0)
    return (
        F.when(same_file, 100).otherwise(0) + (X.proximity("file_path", "c_file_path") if proximity is None else proximity) + F.when(F.col("c_language") == F.col("language"), 50).otherwise(-80)
        + fits + F.when(F.coalesce("c_is_exported", F.lit(False)), 10).otherwise(0) + F.when(same_file & F.col("c_start_line").isNotNull() & F.col("line").isNotNull(), near).otherwise(0.0)
    )


def _order() -> list[Column]:
    return [F.col(c) for c in ("c_name", "c_qualified_name", "c_kind", "c_file_path", "c_start_line", "c_id")]


_CAND = ("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "is_exported")


def _branches(path: str) -> Column:
    """The directories above a path, by number of segments from 0; six, as more add
    nothing to the proximity of two paths."""
    parts = F.filter(F.split(X.dirname(path), "/"), lambda x: x != ".")
    return F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(6))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def exact_name(refs: DataFrame, nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(ref_id, target, confidence): the sole candidate, or the best by score.

    A name with more than ``hot`` nodes is not joined node by node: of its nodes
    below a directory the first of each language, kind and visibility stands for
    the others, as they score alike from outside. A reference meets those of its own
    directories, and the nodes of its own file."""
    nodes = nodes.filter(~F.col("kind").isin("import", "file")).select(*_CAND)
    asked = refs.select(F.col("reference_name").alias("name")).distinct()
    nodes = cut(nodes.join(asked, "name", "left_semi"))
    counts = cut(nodes.groupBy("name", "language", "kind").agg(F.count(F.lit(1)).alias("n")))
    many = cut(counts.groupBy("name").agg(F.sum("n").alias("n")).filter(F.col("n") > hot).select("name"))
    plain = _candidates(refs.join(many.withColumnRenamed("name", "reference_name"), "reference_name", "left_anti"), nodes.join(many, "name", "left_anti"), "reference_name", "name")
    w = Window.partitionBy("ref_id")
    plain = plain.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("score", score())
    kept = ["ref_id", "n", "score", "language", "file_path", *(f"c_{c}" for c in _CAND)]
    every = plain.select(*kept)
    if not many.isEmpty():
        r = refs.join(many.withColumnRenamed("name", "reference_name"), "reference_name", "left_semi")
        own = nodes.join(many, "name", "left_semi")
        # from outside its file a node's score does not depend on the line: each such question is answered once
        asks = ["reference_name", "reference_kind", "language", "file_path"]
        r = r.withColumn("_ask", F.struct(*asks))  # of which parts may be null
        each = cut(r.select("_ask", *asks).distinct())
        c = counts.join(many, "name", "left_semi").select(F.col("name").alias("reference_name"), F.col("language").alias("c_language"), F.col("kind").alias("c_kind"), F.col("n").alias("m"))
        total = each.join(c, "reference_name").filter(gates()).groupBy("_ask").agg(F.sum("m").alias("n"))
        first = F.min(F.struct("name", "qualified_name", "kind", "file_path", "start_line", "id")).alias("_first")
        far = own.withColumn("_branch", F.explode(_branches("file_path"))).groupBy("name", "_branch", "language", "kind", "is_exported").agg(first)
        far = far.select(F.col("name").alias("reference_name"), "_branch", F.col("language").alias("c_language"), F.col("kind").alias("c_kind"), F.col("is_exported").alias("c_is_exported"), *(F.col(f"_first.{x}").alias(f"c_{x}") for x in ("name", "qualified_name", "file_path", "start_line", "id")))
        paths = each.select("*", F.lit(None).cast("int").alias("line"), F.posexplode(_branches("file_path")).alias("_depth", "_branch"))
        met = paths.join(far, ["reference_name", "_branch"]).filter("c_file_path <> file_path").filter(gates()).withColumn("score", score(F.least(F.col("_depth") * 15, F.lit(80))))
        top = met.withColumn("r", F.row_number().over(Window.partitionBy("_ask").orderBy(F.desc("score"), *_order()))).filter("r = 1")
        answers = cut(total.join(top.select("_ask", "score", *(f"c_{c}" for c in _CAND)), "_ask"))
        here = own.select(F.col("name").alias("reference_name"), *(F.col(x).alias(f"c_{x}") for x in _CAND))
        near = r.join(here.withColumn("file_path", F.col("c_file_path")), ["reference_name", "file_path"]).filter(gates()).withColumn("score", score()).join(total, "_ask")
        hot_rows = r.select("ref_id", "language", "file_path", "_ask").join(answers, "_ask")
        every = every.unionByName(hot_rows.select(*kept)).unionByName(near.select(*kept))
    best = every.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), *_order()))).filter("r = 1")
    same = F.col("c_language") == F.col("language")
    sole = F.when(same, 0.9).otherwise(0.5)
    several = F.when(X.proximity("file_path", "c_file_path") >= 30, 0.7).otherwise(0.4)
    return best.filter((F.col("n") == 1) | (F.col("score") > -1)).select("ref_id", F.col("c_id").alias("target"), F.when(F.col("n") == 1, sole).otherwise(several).alias("confidence"), F.lit("exact-match").alias("resolved_by"))


def qualified_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sole node of a qualified name, or the sole one whose qualified name ends
    in it at a segment."""
    q = refs.filter(F.col("reference_name").rlike(r"::|\.")).withColumn("_wanted", X.canonical("reference_name")).withColumn("_last", X.last_qualifier("reference_name"))
    n = nodes.select("id", "kind", "language", "name", X.canonical("qualified_name").alias("_canonical"))
    whole = _sole(q, n, {"_canonical": F.col("_wanted")})
    # a suffix has the same last segment; every suffix of such a node is a key of its own
    near = n.join(q.select(F.col("_last").alias("name")).distinct(), "name", "left_semi").filter(F.contains("_canonical", F.lit("::")))
    at = F.filter(F.sequence(F.lit(1), F.length("_canonical")), lambda i: F.substr("_canonical", i, F.lit(2)) == "::")
    part = _sole(q, near.withColumn("_suffix", F.explode(F.transform(at, lambda i: F.substr("_canonical", i + 2)))), {"name": F.col("_last"), "_suffix": F.col("_wanted")})
    sole = whole.withColumn("confidence", F.lit(0.95)).unionByName(part.withColumn("confidence", F.lit(0.85)))
    best = sole.withColumn("r", F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("confidence")))).filter("r = 1")
    return best.select("ref_id", F.col("c_id").alias("target"), "confidence", F.lit("qualified-name").alias("resolved_by"))


def file_path(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References to files: by whole path, by suffix with the nearest winning, or
    by a sole file name."""
    p = refs.filter((F.col("reference_kind") != "instantiates") & F.col("reference_name").rlike(r"/|\.[A-Za-z][A-Za-z0-9]{0,3}$")).withColumn("_path", X.normal_path("reference_name"))
    files = nodes.filter(F.col("kind") == "file")
    c = _candidates(p, files.withColumn("_base", X.basename("file_path")), X.basename("_path"), "_base")
    conf = F.when((F.col("c_file_path") == F.col("_path")) | (F.col("c_qualified_name") == F.col("_path")), 0.95).when(F.col("c_file_path").endswith(F.col("_path")), 0.85).when(F.count(F.lit(1)).over(Window.partitionBy("ref_id")) == 1, 0.7)
    near = F.when(X.dirname("c_file_path") == X.dirname("file_path"), 1000).otherwise(0) + X.proximity("file_path", "c_file_path") + F.when(same_family("c_language", "language"), 5).otherwise(0)
    ranked = c.withColumn("confidence", conf).filter("confidence is not null").withColumn("near", near)
    w = Window.partitionBy("ref_id").orderBy(F.desc("confidence"), F.desc("near"), *_order())
    return ranked.withColumn("r", F.row_number().over(w)).filter("r = 1").select("ref_id", F.col("c_id").alias("target"), "confidence", F.lit("file-path").alias("resolved_by"))


def supertypes(g: Graph, most: int = 4, of: DataFrame | None = None) -> DataFrame:
    """(type, super, depth) within ``most`` steps, the type itself at 0; with ``of``
    (type), of these types only."""
    up = g.edges.filter(F.col("kind").isin("extends", "implements")).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    types = g.nodes.filter(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("type")) if of is None else of
    out = front = types.select("type", F.col("type").alias("super"), F.lit(0).alias("depth"))
    for d in range(1, most + 1):
        front = front.join(up, F.col("super") == F.col("a")).select("type", F.col("b").alias("super"), F.lit(d).alias("depth")).distinct()
        out = out.unionByName(front)
    return out.groupBy("type", "super").agg(F.min("depth").alias("depth"))


def members(g: Graph) -> DataFrame:
    """(owner, id, name, return_type) of methods and functions within types."""
    e = g.edges.filter(F.col("kind") == "contains").select(F.col("source").alias("owner"), F.col("target").alias("id"))
    return e.join(g.nodes.filter(F.col("kind").isin(*CALLABLE)).select("id", "name", "return_type", "language"), "id")


def _owners(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("type"), F.col("name").alias("type_name"), F.col("language").alias("type_language"))


def _inherited(g: Graph, asked: DataFrame) -> DataFrame:
    """asked: (type_name, member). (type_name, type_language, member, depth, target):
    the nearest member of that name which types of that name have or inherit, the
    least id of equally near ones: one row however many types and members there are."""
    owners = _owners(g).join(asked.select("type_name").distinct(), "type_name", "left_semi")
    has = members(g).select(F.col("owner").alias("super"), F.col("id").alias("target"), F.col("name").alias("member"))
    has = has.join(asked.select("member").distinct(), "member", "left_semi").groupBy("super", "member").agg(F.min("target").alias("target"))
    via = supertypes(g, of=owners.select("type").distinct()).join(has, "super").join(owners, "type")
    best = via.groupBy("type_name", "type_language", "member").agg(F.min(F.struct("depth", "target")).alias("_b"))
    return best.select("type_name", "type_language", "member", "_b.depth", "_b.target")


def _word_pairs(name: str) -> Column:
    """Every two distinct words of a name; names share two words where they share a pair."""
    words = F.array_sort(F.array_distinct(X.camel_words(name)))
    return F.flatten(F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda b: F.concat_ws("\0", a, b))))


def method(refs: DataFrame, g: Graph, types: DataFrame | None = None) -> DataFrame:
    """``receiver.member``: on the class of that name, a capitalised receiver, the
    receiver's inferred type (types: ref_id, type_name), a member that is the only
    one of its name, or one whose class shares two words with the receiver."""
    r = refs.withColumn("receiver", F.regexp_extract("reference_name", r"([A-Za-z_]\w*)(?:\.|::|->)\w+$", 1)).withColumn("member", F.regexp_extract("reference_name", r"(\w+)$", 1)).filter("receiver <> ''").select("ref_id", "language", "receiver", "member")
    capital = F.concat(F.upper(F.substring("receiver", 1, 1)), F.substr("receiver", F.lit(2)))
    asks = r.select("ref_id", "language", "member", F.explode(F.array(*(F.struct(n.alias("type_name"), F.lit(c).alias("confidence"), F.lit(False).alias("inferred")) for n, c in ((F.col("receiver"), 0.85), (capital, 0.8))))).alias("_a")).select("ref_id", "language", "member", "_a.*")
    if types is not None:
        asks = asks.unionByName(r.join(types, "ref_id").select("ref_id", "language", "member", "type_name", F.lit(0.9).alias("confidence"), F.lit(True).alias("inferred")))
    asks = cut(asks)
    via = _inherited(g, asks.select("type_name", "member").distinct())
    found = [asks.join(via, ["type_name", "member"]).filter(F.col("inferred") | same_family("type_language", "language")).select("ref_id", "target", "confidence", "depth")]
    named = members(g).select(F.col("owner").alias("type"), F.col("name").alias("member"), F.col("id").alias("target")).join(r.select("member").distinct(), "member", "left_semi").join(_owners(g), "type")
    # members are counted by name and language, and the counts joined
    few = named.groupBy("member", "type_language").agg(F.count(F.lit(1)).alias("_m"), F.min("target").alias("target"))
    sole = r.join(few, "member").filter(same_family("type_language", "language")).groupBy("ref_id").agg(F.sum("_m").alias("n"), F.min("target").alias("target")).filter("n = 1")
    found.append(sole.select("ref_id", "target", F.lit(0.7).alias("confidence"), F.lit(0).alias("depth")))
    alike = named.select("member", "type_language", "target", F.explode(_word_pairs("type_name")).alias("_pair")).groupBy("member", "_pair", "type_language").agg(F.min("target").alias("target"))
    shared = r.select("ref_id", "language", "member", F.explode(_word_pairs("receiver")).alias("_pair")).join(alike, ["member", "_pair"]).filter(same_family("type_language", "language"))
    found.append(shared.groupBy("ref_id").agg(F.min("target").alias("target")).select("ref_id", "target", F.lit(0.65).alias("confidence"), F.lit(0).alias("depth")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    w = Window.partitionBy("ref_id").orderBy(F.desc("confidence"), "depth", "target")
    return every.withColumn("r", F.row_number().over(w)).filter("r = 1").select("ref_id", "target", "confidence", F.lit("method").alias("resolved_by"))


def return_types(g: Graph) -> DataFrame:
    """(inner_name, type_name): the types that callables of a name return."""
    back = F.regexp_extract("return_type", r"(\w+)\W*$", 1).alias("type_name")
    return g.nodes.filter(F.col("kind").isin(*CALLABLE) & F.col("return_type").isNotNull()).select(F.col("name").alias("inner_name"), back).distinct()


def chain(refs: DataFrame, g: Graph) -> DataFrame:
    """``inner().member``: a member of what ``inner`` returns, or of its supertypes."""
    r = refs.withColumn("inner_name", F.regexp_extract("reference_name", r"(\w+)\(\)(?:\.|::|->)\w+$", 1)).withColumn("member", F.regexp_extract("reference_name", r"(\w+)$", 1)).filter("inner_name <> ''")
    r = r.select("ref_id", "language", "inner_name", "member")
    # equal questions are answered once
    asks = cut(r.select("inner_name", "member", "language").distinct().join(return_types(g), "inner_name"))
    hit = asks.join(_inherited(g, asks.select("type_name", "member").distinct()), ["type_name", "member"]).filter(same_family("type_language", "language"))
    best = hit.groupBy("inner_name", "member", "language").agg(F.min(F.struct("depth", "target")).alias("_b"))
    near = r.join(best, ["inner_name", "member", "language"]).groupBy("ref_id").agg(F.min("_b").alias("_b"))
    return near.select("ref_id", F.col("_b.target").alias("target"), F.lit(0.85).alias("confidence"), F.lit("chain").alias("resolved_by"))


def fuzzy(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sole callable of the name without regard to case."""
    low = nodes.filter(F.col("kind").isin(*CALLABLE, "class")).withColumn("_low", F.lower("name"))
    c = _sole(refs, low, {"_low": F.lower("reference_name")})
    return c.select("ref_id", F.col("c_id").alias("target"), F.when(F.col("c_language") == F.col("language"), 0.5).otherwise(0.3).alias("confidence"), F.lit("fuzzy").alias("resolved_by"))


def near_name(refs: DataFrame, nodes: DataFrame, most: int = 2) -> DataFrame:
    """Distinct names within ``most`` edits of a reference's lower-case name: joined
    by their deletions, never as all pairs. A string within two edits of another
    shares with it some form with at most two characters left out."""

    def forms(c: Column) -> Column:
        gone = lambda s: F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
        once = F.array_distinct(F.concat(F.array(c), gone(c)))
        out = once
        for _ in range(most - 1):
            out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, gone))))
        return out

    names = nodes.select(F.lower("name").alias("near")).filter("length(name) > 2").distinct().withColumn("form", F.explode(forms(F.col("near"))))
    asked = refs.select(F.lower("reference_name").alias("low")).filter("length(low) > 2").distinct().withColumn("form", F.explode(forms(F.col("low"))))
    met = asked.join(names, "form").select("low", "near").distinct()
    return met.withColumn("distance", F.levenshtein("low", "near", most)).filter("distance >= 0")


def choose(*found: DataFrame) -> DataFrame:
    """One row of each reference. An import or framework of 0.9 or more comes
    first; else the highest confidence, the earlier strategy in a tie."""
    every = None
    for i, f in enumerate(found):
        f = f.select("ref_id", "target", F.col("confidence").cast("decimal(4,2)").alias("confidence"), "resolved_by", F.lit(i).alias("stage"))
        every = f if every is None else every.unionByName(f)
    sure = F.col("resolved_by").isin("import", "framework") & (F.col("confidence") >= 0.9)
    w = Window.partitionBy("ref_id").orderBy(F.desc(sure), F.desc("confidence"), "stage", "target")
    return every.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "stage")


def first_hit(*found: DataFrame) -> DataFrame:
    """One row of each reference: of the first strategy that has one."""
    every = None
    for i, f in enumerate(found):
        f = f.select("ref_id", "target", F.col("confidence").cast("decimal(4,2)").alias("confidence"), "resolved_by", F.lit(i).alias("stage"))
        every = f if every is None else every.unionByName(f)
    w = Window.partitionBy("ref_id").orderBy("stage", F.desc("confidence"), "target")
    return every.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "stage")


def resolve(g: Graph, more: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(ref_id, target, confidence, resolved_by) of the pending references that can
    be resolved. ``more``: rows of import and framework strategies. References and
    nodes are cut once, not planned again for each strategy."""
    wanted = ("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "is_exported", "return_type", "signature")
    nodes = stored(g.nodes, *wanted)
    refs = cut(known(external(g.refs.filter(F.col("status") == "pending"), nodes), nodes))
    g = Graph(nodes, g.edges, g.files, refs)
    made = F.col("reference_kind") == "instantiates"
    plain = refs.filter(~made)
    names = first_hit(file_path(plain, nodes), qualified_name(refs, nodes), method(plain, g), chain(plain, g), exact_name(refs, nodes), fuzzy(refs, nodes))
    return choose(*more, names) if more else names


def promoted(resolved: DataFrame, g: Graph) -> DataFrame:
    """Edges of resolved references; extending an interface implements it, calling
    a class makes one."""
    kind, target = F.col("reference_kind"), F.col("target_kind")
    new = F.when((kind == "extends") & target.isin("interface", "protocol", "trait"), "implements").when((kind == "calls") & target.isin("class", "struct"), "instantiates").otherwise(kind)
    r = g.refs.select("ref_id", F.col("from_node_id").alias("source"), "reference_kind", "reference_name", "line", "col")
    t = g.nodes.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))
    meta = F.create_map(F.lit("resolvedBy"), F.col("resolved_by"), F.lit("confidence"), F.col("confidence").cast("string"), F.lit("reference"), F.col("reference_name"))
    return resolved.join(r, "ref_id").join(t, "target").select("source", "target", new.alias("kind"), meta.alias("metadata"), "line", "col", F.lit(None).cast("string").alias("provenance"))


def parked(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """The queue afterwards: resolved rows go, the rest have failed, with the tail
    by which a new symbol may call them back."""
    return refs.join(resolved.select("ref_id"), "ref_id", "left_anti").withColumn("status", F.lit("failed")).withColumn("name_tail", X.name_tail("reference_name"))


def retryable(refs: DataFrame, new_names: DataFrame, most: int = 500) -> DataFrame:
    """Failed references whose tail is a new name, unless too many share it."""
    failed = refs.filter(F.col("status") == "failed")
    few = failed.groupBy("name_tail").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("name_tail")
    names = new_names.select(F.col("name").alias("name_tail")).distinct()
    return failed.join(few.join(names, "name_tail", "left_semi"), "name_tail", "left_semi").withColumn("status", F.lit("pending"))


def final_gates(resolved: DataFrame, g: Graph) -> DataFrame:
    """Resolved rows whose target passes the gates of language and kind; what imports
    and frameworks found is not judged by its kind."""
    r = g.refs.select("ref_id", "reference_kind", "language", "file_path")
    c = g.nodes.select(F.col("id").alias("target"), F.col("kind").alias("c_kind"), F.col("language").alias("c_language"))
    both = resolved.join(r, "ref_id").join(c, "target")
    return both.filter(language_gate() & (F.col("resolved_by").isin("import", "framework") | (F.col("reference_kind") != "instantiates") | constructible())).select(*resolved.columns)


def field_types(g: Graph) -> DataFrame:
    """(owner, receiver, type_name): fields and properties of types with the type
    that their signature declares, as Java and Kotlin write it."""
    inside = g.edges.filter(F.col("kind") == "contains").select(F.col("source").alias("owner"), F.col("target").alias("id"))
    f = g.nodes.filter(F.col("kind").isin("field", "property") & F.col("language").isin("java", "kotlin") & F.col("signature").isNotNull())
    before = F.regexp_extract("signature", r"\b([A-Z]\w*)(?:<[^;=]*>)?(?:\[\])*\s+\w+\s*(?:[;=].*)?$", 1)
    after = F.regexp_extract("signature", r"\w+\s*:\s*([A-Z]\w*)", 1)
    typed = inside.join(f.select("id", F.col("name").alias("receiver"), F.when(F.col("language") == "kotlin", after).otherwise(before).alias("type_name")), "id")
    return typed.filter("type_name <> ''").select("owner", "receiver", "type_name")


def receivers_by_field(refs: DataFrame, g: Graph) -> DataFrame:
    """(ref_id, type_name): the declared type of the receiver, where it is a field of
    the class that holds the calling method. For :func:`method`'s ``types``."""
    inside = g.edges.filter(F.col("kind") == "contains").select(F.col("source").alias("owner"), F.col("target").alias("from_node_id"))
    r = refs.withColumn("receiver", F.regexp_extract("reference_name", r"^(?:this\.)?([A-Za-z_]\w*)\.\w+$", 1)).filter("receiver <> ''")
    hit = r.join(inside, "from_node_id").join(field_types(g), ["owner", "receiver"])
    return hit.groupBy("ref_id").agg(F.min("type_name").alias("type_name"))


def conformance(g: Graph, deferred: DataFrame) -> DataFrame:
    """Chains and members again, when inheritance edges are there."""
    return first_hit(chain(deferred, g), method(deferred, g))


# -- imports ------------------------------------------------------------------


def relative_path(module: Column | str = "module", path: Column | str = "file_path") -> Column:
    return X.normal_path(F.concat_ws("/", X.dirname(path), X.col(module)))


def module_files(imports: DataFrame, files: DataFrame, endings: tuple[str, ...] = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".py", "/index.ts", "/index.js", "/__init__.py"), aliases: DataFrame | None = None) -> DataFrame:
    """imports: (import_id, module, file_path). (import_id, path): the file that a
    module names; relative modules against their directory, others by the longest
    alias (prefix, target), and the first ending that is a file."""
    asked = imports.withColumn("_base", F.when(F.col("module").startswith("."), relative_path()).otherwise(F.regexp_replace("module", r"\.(?=\w)", "/")))
    bases = asked.select("import_id", "_base", F.lit(1).alias("_by"))
    if aliases is not None:
        starts = F.transform(F.sequence(F.lit(0), F.length("module")), lambda n: F.substring("module", F.lit(1), n))
        hit = asked.withColumn("prefix", F.explode(starts)).join(aliases, "prefix")
        w = Window.partitionBy("import_id").orderBy(F.desc(F.length("prefix")), "target")
        best = hit.withColumn("r", F.row_number().over(w)).filter("r = 1")
        bases = bases.unionByName(best.select("import_id", X.normal_path(F.concat("target", F.substr("module", F.length("prefix") + 1))).alias("_base"), F.lit(0).alias("_by")))
    tries = bases.select("import_id", "_by", "_base", F.posexplode(F.array(*map(F.lit, endings))).alias("_place", "_ending")).withColumn("path", F.concat("_base", "_ending"))
    w = Window.partitionBy("import_id").orderBy("_by", "_place")
    return tries.join(files.select("path"), "path", "left_semi").withColumn("r", F.row_number().over(w)).filter("r = 1").select("import_id", "path")


def imported(refs: DataFrame, mapping: DataFrame, nodes: DataFrame, reexports: DataFrame | None = None, most: int = 8) -> DataFrame:
    """mapping: (file_path, local, exported, path); reexports: (path, exported,
    to_path, to_name), exported ``*`` for all. Follows at most ``most`` re-exports."""
    at = refs.withColumn("local", F.regexp_extract("reference_name", r"^(\w+)", 1)).join(mapping, ["file_path", "local"]).select("ref_id", "language", "path", F.col("exported").alias("name"))
    symbols = nodes.filter(~F.col("kind").isin("import", "file")).select(F.col("file_path").alias("path"), "name", F.col("id").alias("target"), "is_exported")
    found = at.join(symbols, ["path", "name"]).select("ref_id", "target", F.lit(0).alias("depth"))
    if reexports is not None:
        front = cut(at)
        for d in range(1, most + 1):
            named = front.join(reexports.filter("exported <> '*'").withColumnRenamed("exported", "name"), ["path", "name"]).select("ref_id", "language", F.col("to_path").alias("path"), F.col("to_name").alias("name"))
            every = front.join(reexports.filter("exported = '*'"), "path").select("ref_id", "language", F.col("to_path").alias("path"), "name")
            front = cut(named.unionByName(every).distinct())
            if front.isEmpty():
                break
            found = found.unionByName(front.join(symbols, ["path", "name"]).select("ref_id", "target", F.lit(d).alias("depth")))
    w = Window.partitionBy("ref_id").orderBy("depth", "target")
    return found.withColumn("r", F.row_number().over(w)).filter("r = 1").select("ref_id", "target", F.when(F.col("depth") == 0, 0.92).otherwise(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))


def included(refs: DataFrame, files: DataFrame, directories: tuple[str, ...] = ()) -> DataFrame:
    """#include: the file beside the including one, or under an include directory."""
    r = refs.filter(F.col("reference_kind") == "imports")
    tries = F.array(F.struct(relative_path("reference_name").alias("path"), F.lit(0.92).alias("confidence")), *(F.struct(X.normal_path(F.concat(F.lit(d + "/"), "reference_name")).alias("path"), F.lit(0.9).alias("confidence")) for d in directories))
    each = r.select("ref_id", F.posexplode(tries).alias("_place", "_t")).select("ref_id", "_place", "_t.path", "_t.confidence")
    w = Window.partitionBy("ref_id").orderBy("_place")
    return each.join(files.select("path"), "path", "left_semi").withColumn("r", F.row_number().over(w)).filter("r = 1").select("ref_id", "path", "confidence")
