"""Rule packs of web, mobile and bridge frameworks for the extractor.

A pack says in which languages it looks, and what a match gives: a ``route`` or
``component`` node, and the name of what handles it as a reference. Patterns are
fixed values, written for the common forms of each framework; ``install()``
registers all packs, and a pack of the same name replaces an earlier one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import Rule, register

_Q = r"""['"]([^'"]*)['"]"""
_VERBS = "get|post|put|patch|delete|options|head|any|all"


@dataclass(frozen=True)
class Pack:
    name: str
    languages: tuple[str, ...]
    #: (kind, pattern): group 1 is the node's name, group 2 its handler, if any.
    patterns: tuple[tuple[str, str], ...]

    def rule(self) -> Rule:
        compiled = [(kind, re.compile(p, re.M)) for kind, p in self.patterns]

        def extract(path: str, text: str):
            nodes, refs = [], []
            for kind, p in compiled:
                at, line = 0, 1
                for m in p.finditer(text):  # matches are in order: lines are counted on
                    line += text.count("\n", at, m.start())
                    at = m.start()
                    nodes.append((kind, m[1], line))
                    if p.groups > 1 and m[2]:
                        refs.append((m[2], "references", line))
            return nodes, refs

        return Rule(self.name, self.languages, extract)


JS = ("javascript", "typescript", "jsx", "tsx")
PACKS = (
    Pack("laravel", ("php",), (("route", rf"Route::(?:{_VERBS})\(\s*{_Q}\s*,\s*\[?\s*\\?([\w\\]+)"),)),
    Pack("drupal", ("yaml", "php"), (("route", r"^\s*path:\s*['\"]?([^'\"\n]+)['\"]?\s*\n(?:.*\n){0,3}?\s*_(?:controller|form):\s*['\"]?([\w\\:]+)"), ("route", r"function\s+\w+_(menu|theme|form_alter|node_\w+)\(()"))),
    Pack("express", JS, (("route", rf"\b(?:app|router)\.(?:{_VERBS}|use)\(\s*{_Q}\s*,(?:.*,)?\s*([\w.]+)\s*\)"),)),
    Pack("nestjs", ("typescript",), (("route", r"@(?:Get|Post|Put|Patch|Delete)\(\s*['\"]?([^'\")]*)['\"]?\s*\)\s*(?:\n\s*@[^\n]*)*\s*(?:async\s+)?(\w+)\("),)),
    Pack("react", JS, (("component", r"(?:export\s+(?:default\s+)?)?(?:function|const)\s+([A-Z]\w*)\s*[=(:]"), ("route", rf"<Route[^>]*\bpath={_Q}[^>]*(?:element=\{{<|component=\{{)(\w+)"))),
    Pack("svelte", ("svelte",), (("component", r"<([A-Z]\w*)"),)),
    Pack("vue", ("vue", *JS), (("component", r"\bname:\s*['\"]([A-Z]\w*)['\"]"), ("route", rf"\bpath:\s*{_Q}[^}}]*?component:\s*(\w+)"))),
    Pack("django", ("python",), (("route", rf"\b(?:path|re_path|url)\(\s*r?{_Q}\s*,\s*([\w.]+)"),)),
    Pack("flask", ("python",), (("route", rf"@\w+\.route\(\s*{_Q}[^)]*\)\s*(?:\n\s*@[^\n]*)*\n\s*(?:async\s+)?def\s+(\w+)"),)),
    Pack("fastapi", ("python",), (("route", rf"@\w+\.(?:{_VERBS})\(\s*{_Q}[^)]*\)\s*(?:\n\s*@[^\n]*)*\n\s*(?:async\s+)?def\s+(\w+)"),)),
    Pack("rails", ("ruby",), (("route", rf"^\s*(?:{_VERBS})\s+{_Q}\s*(?:,\s*to:|=>)\s*['\"]([\w#/]+)"), ("route", r"^\s*resources?\s+:(\w+)()"))),
    Pack("spring", ("java", "kotlin"), (("route", rf"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?{_Q}[^)]*\)\s*(?:\n\s*@[^\n]*)*\n\s*(?:public\s+|fun\s+)?[\w<>\[\], ?]*?(\w+)\("),)),
    Pack("play", ("scala", "java"), (("route", r"^(?:GET|POST|PUT|DELETE)\s+(\S+)\s+([\w.]+)"),)),
    Pack("go-web", ("go",), (("route", r"\.(?:GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Delete|HandleFunc|Handle)\(\s*\"([^\"]*)\"\s*,(?:.*,)?\s*([\w.]+)\s*\)"),)),
    Pack("rust-web", ("rust",), (("route", rf"#\[(?:get|post|put|patch|delete)\(\s*\"([^\"]*)\"[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("route", r"\.route\(\s*\"([^\"]*)\"\s*,\s*(?:web::)?(?:get|post|put|delete)\(\)?(?:\.to\()?([\w:]+)"))),
    Pack("aspnet", ("csharp",), (("route", r"\[Http(?:Get|Post|Put|Patch|Delete)\(?\"?([^\")\]]*)\"?\)?\]\s*(?:\n\s*\[[^\n]*)*\n\s*public\s+[\w<>\[\]., ?]*?(\w+)\("), ("route", r"\.Map(?:Get|Post|Put|Delete)\(\s*\"([^\"]*)\"\s*,\s*(\w+)"))),
    Pack("swiftui", ("swift",), (("component", r"struct\s+(\w+)\s*:\s*(?:\w+,\s*)*View\b"),)),
    Pack("uikit", ("swift",), (("component", r"class\s+(\w+)\s*:\s*UI\w*(?:ViewController|View|Cell)\b"),)),
    Pack("vapor", ("swift",), (("route", r"\b(?:app|routes|router)\.(?:get|post|put|delete)\(\s*\"([^\"]*)\"[^)]*?(?:use:\s*(\w+))?\s*\)"),)),
    Pack("react-native", ("objc", "java", "kotlin"), (("component", r"RCT_EXPORT_MODULE\((\w*)\)"), ("method", r"RCT_EXPORT_METHOD\((\w+)"), ("method", r"@ReactMethod\s+(?:public\s+|fun\s+)?(?:void\s+|\w+\s+)?(\w+)\("))),
    Pack("expo-modules", ("swift", "kotlin"), (("component", r"\bName\(\s*\"(\w+)\"\s*\)"), ("method", r"\b(?:Async)?Function\(\s*\"(\w+)\""))),
    Pack("fabric", JS, (("component", r"codegenNativeComponent(?:<[^>]*>)?\(\s*['\"](\w+)['\"]"),)),
    Pack("cargo-workspace", ("toml",), (("module", r"^name\s*=\s*\"([\w-]+)\""),)),
)


def install(names: tuple[str, ...] | None = None) -> list[Rule]:
    """Register the packs, or those of the given names."""
    made = [p.rule() for p in PACKS if names is None or p.name in names]
    for r in made:
        register(r)
    return made


# -- hooks: which packs apply, which references they answer --------------------

#: What in a project's files says that it uses a framework: a pattern of paths and
#: one of text (this library's own choice of signs).
SIGNS = {
    "laravel": (r"(^|/)composer\.json$|(^|/)artisan$", r"laravel/framework|#!/usr/bin/env php"),
    "drupal": (r"\.info\.yml$", r"core_version_requirement"),
    "express": (r"(^|/)package\.json$", r"\"express\""),
    "nestjs": (r"(^|/)package\.json$", r"\"@nestjs/core\""),
    "react": (r"(^|/)package\.json$", r"\"react\""),
    "svelte": (r"(^|/)package\.json$", r"\"svelte\""),
    "vue": (r"(^|/)package\.json$", r"\"(vue|nuxt)\""),
    "django": (r"(^|/)(manage\.py|requirements\.txt|pyproject\.toml)$", r"(?i)django"),
    "flask": (r"\.(py|txt|toml)$", r"(?i)\bflask\b"),
    "fastapi": (r"\.(py|txt|toml)$", r"(?i)\bfastapi\b"),
    "rails": (r"(^|/)Gemfile$", r"['\"]rails['\"]"),
    "spring": (r"(^|/)(pom\.xml|build\.gradle(\.kts)?)$", r"springframework"),
    "play": (r"(^|/)(build\.sbt|plugins\.sbt|conf/routes)$", r"(?s)."),
    "go-web": (r"(^|/)go\.mod$", r"gin-gonic/gin|labstack/echo|go-chi/chi|gorilla/mux|gofiber/fiber"),
    "rust-web": (r"(^|/)Cargo\.toml$", r"(?m)^(actix-web|axum|rocket|warp)\b"),
    "aspnet": (r"\.csproj$", r"Microsoft\.NET\.Sdk\.Web|AspNetCore"),
    "swiftui": (r"\.swift$", r"(?m)^import SwiftUI"),
    "uikit": (r"\.swift$", r"(?m)^import UIKit"),
    "vapor": (r"(^|/)Package\.swift$", r"vapor/vapor"),
    "react-native": (r"(^|/)package\.json$", r"\"react-native\""),
    "expo-modules": (r"(^|/)(package|expo-module\.config)\.json$", r"expo-modules-core|\"platforms\""),
    "fabric": (r"\.[jt]sx?$", r"codegenNativeComponent"),
    "cargo-workspace": (r"(^|/)Cargo\.toml$", r"(?m)^\[workspace\]"),
}
#: Forms of handler names that a framework's routes have: a pattern with the owner and
#: the member, and how the owner's class or file is called.
HANDLERS = {
    "rails": (r"^(?:\w+/)*(\w+)#(\w+)$", "pascal-controller"),
    "laravel": (r"^(?:\w+\\\\)*(\w+)@(\w+)$", "class"),
    "django": (r"^(?:\w+\.)*(\w+)\.(\w+)$", "file"),
    "play": (r"^(?:\w+\.)*(\w+)\.(\w+)$", "class"),
    "drupal": (r"^(?:\\\\?\w+\\\\)*(\w+)::(\w+)$", "class"),
}


def detected(contents: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """contents: (path, text). (pack): the packs whose sign some file shows. One scan
    for all packs."""
    hits = [F.when(F.col("path").rlike(at) & F.col("text").rlike(says), F.lit(name)) for name, (at, says) in SIGNS.items() if names is None or name in names]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return contents.select(F.explode(found).alias("pack")).distinct()


def claimed(refs: DataFrame, packs: tuple[str, ...]) -> DataFrame:
    """(ref_id, pack, owner, member) of references in the form of a pack's handlers;
    they are not to be dropped as unknown names before the pack has seen them."""
    out = None
    for name in packs:
        pattern, _ = HANDLERS[name]
        owner, member = (F.regexp_extract("reference_name", pattern, i) for i in (1, 2))
        rows = refs.select("ref_id", F.lit(name).alias("pack"), owner.alias("owner"), member.alias("member")).filter("member <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def resolved_handlers(refs: DataFrame, nodes: DataFrame, packs: tuple[str, ...]) -> DataFrame:
    """(ref_id, target, confidence, resolved_by): claimed references to the member of
    that class, or in that file; rows for the index's ``claims``."""
    claims = claimed(refs, packs)
    camel = F.array_join(F.transform(F.split("owner", "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    ways = {name: HANDLERS[name][1] for name in packs}
    way = F.try_element_at(F.create_map(*(F.lit(x) for pair in ways.items() for x in pair)), F.col("pack"))
    asked = claims.withColumn("way", way).withColumn("key", F.when(F.col("way") == "pascal-controller", F.concat(camel, F.lit("Controller"))).otherwise(F.col("owner")))
    n = nodes.filter(F.col("kind").isin("method", "function")).select("name", F.col("id").alias("target"), F.regexp_extract(F.coalesce("qualified_name", "name"), r"(\w+)(?:::|\.)\w+$", 1).alias("class"), F.regexp_extract("file_path", r"(\w+)\.\w+$", 1).alias("file"))
    met = asked.join(n, F.col("member") == F.col("name")).filter(F.when(F.col("way") == "file", F.col("key") == F.col("file")).otherwise(F.col("key") == F.col("class")))
    best = met.groupBy("ref_id").agg(F.min("target").alias("target"))
    return best.select("ref_id", "target", F.lit(0.9).alias("confidence"), F.lit("framework").alias("resolved_by"))


def prefixed_routes(routes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """routes: (path, name, ...), prefixes: (path, prefix). Routes of a file with the
    prefix that its controller has, joined by one slash."""
    p = prefixes.groupBy("path").agg(F.min("prefix").alias("prefix"))
    name = F.regexp_replace(F.concat(F.lit("/"), F.coalesce("prefix", F.lit("")), F.lit("/"), F.col("name")), "/{2,}", "/")
    return routes.join(p, "path", "left").withColumn("name", F.when(F.length(name) > 1, F.regexp_replace(name, "/$", "")).otherwise(name)).drop("prefix")


# -- names across languages ---------------------------------------------------


def selector_base(selector: Column) -> Column:
    """The Swift base name of an Objective-C selector: its first part up to a
    preposition (``tableViewWithStyle:`` gives ``tableView``)."""
    first = F.substring_index(selector, ":", 1)
    return F.coalesce(F.nullif(F.regexp_extract(first, r"^(.+?)(?:With|For|At|In|From|To|By|Of|On|Using)[A-Z]", 1), F.lit("")), first)


def setter_property(selector: Column) -> Column:
    """The property that ``setName:`` sets; null for other selectors."""
    name = F.regexp_extract(selector, r"^set([A-Z]\w*):$", 1)
    return F.when(name != "", F.concat(F.lower(F.substring(name, 1, 1)), F.substr(name, F.lit(2))))


def property_setter(name: Column) -> Column:
    """The selector that sets a property: ``name`` gives ``setName:``."""
    return F.concat(F.lit("set"), F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)), F.lit(":"))


def selectors_of(name: Column, labels: Column) -> Column:
    """The selectors that a Swift function of these argument labels may have in
    Objective-C: the base name with each label, the first behind ``With`` or a
    preposition, or as a part of its own; a base without labels is itself."""
    first = F.element_at(labels, 1)
    head = F.concat(F.upper(F.substring(first, 1, 1)), F.substr(first, F.lit(2)))
    rest = F.array_join(F.transform(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.concat(x, F.lit(":"))), "")
    with_first = F.array(F.concat(name, F.lit("With"), head, F.lit(":"), rest), F.concat(name, head, F.lit(":"), rest), F.concat(name, F.lit(":"), first, F.lit(":"), rest))
    return F.when(F.size(labels) == 0, F.array(name)).when(first == "_", F.array(F.concat(name, F.lit(":"), rest))).otherwise(with_first)


def receiver_types(source: DataFrame) -> DataFrame:
    """source: (id, text). (id, receiver, type_name): declared types of locals and
    fields, in the forms ``Type name``, ``name: Type``, ``name = new Type(``,
    ``auto name = Type(``; the first in the text wins."""
    forms = (
        (r"\b([A-Z]\w*)(?:<[^<>;]*>)?[\s*&]+([a-z_]\w*)\s*[;=,)]", 2, 1), (r"\b([a-z_]\w*)\s*:\s*([A-Z]\w*)", 1, 2), (r"\b([a-z_]\w*)\s*:?=\s*(?:new\s+|&)?([A-Z]\w*)\s*[({]", 1, 2),
    )
    every = None
    for i, (pattern, who, what) in enumerate(forms):
        z = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(who)).alias("r"), F.regexp_extract_all("text", F.lit(pattern), F.lit(what)).alias("t"))
        rows = source.select("id", F.posexplode(z).alias("at", "z")).select("id", F.col("z.r").alias("receiver"), F.col("z.t").alias("type_name"), F.struct(F.lit(i).alias("form"), "at").alias("o"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("id", "receiver").agg(F.min_by("type_name", "o").alias("type_name"))
