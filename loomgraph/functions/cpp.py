"""Functions that no built-in expresses: Arrow-batched, never row by row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NOISE = re.compile(r"\b(?:const|volatile|struct|class|enum|typename|register|inline|static|extern|virtual)\b|\s+")
_NAMED = re.compile(r"(?:(?<=[\w>\]])[ ]+|(?<=[&*])[ ]*)[A-Za-z_]\w*(?=(?:\[[^\]]*\])*$)")

_WORD, _OPENS = re.compile(r"[\w$]"), re.compile(r"\s*(?=\()")


def _parameters(signature: str, name: str | None = None) -> str | None:
    """What a signature takes, without names, qualifiers and default values: from
    the first parenthesis after ``name``, where that is given and found as a word."""
    found, at = None, signature.find(name) if name else -1
    while at >= 0 and not found:  # a pattern of each name would have to be compiled
        end = at + len(name)
        if not (at and _WORD.match(signature, at - 1)) and not _WORD.match(signature, end):
            found = _OPENS.match(signature, end)
        at = signature.find(name, at + 1)
    start = found.end() if found else signature.find("(")
    if start < 0:
        return None
    depth, parts, at = 0, [], start + 1
    for i in range(start, len(signature)):
        c = signature[i]
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth == 1 or depth == 0:
            parts.append(signature[at:i])
            at = i + 1
            if depth == 0:
                break
    out = []
    for p in parts:
        p = p.split("=")[0].strip()
        if p in ("", "void"):
            continue
        p = " ".join(_NOISE.sub(" ", p).split())
        p = _NAMED.sub("", p)
        out.append(re.sub(r"\s*([*&<>,\[\]])\s*", r"\1", p))
    return ",".join(out)


@F.pandas_udf(T.StringType())
def parameter_key(signature: pd.Series, name: pd.Series) -> pd.Series:
    """The types of a C or C++ signature's parameters; null without parentheses. The
    name tells where they begin: ``operator()(int)`` takes an int."""
    return pd.Series([None if s is None else _parameters(s, n) for s, n in zip(signature, name)], dtype=object)


_COMMENTS = {
    "slash": re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S),
    "hash": re.compile(r'"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*'),
    "dash": re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|--\[\[.*?\]\]|--[^\n]*', re.S),
}
_STYLE = {lang: "hash" for lang in ("python", "ruby", "yaml", "properties")} | {lang: "dash" for lang in ("lua", "luau")}


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "/#-" else m[0]


@F.pandas_udf(T.StringType())
def without_comments(text: pd.Series, language: pd.Series) -> pd.Series:
    """Source with comments blanked: every other character keeps its place."""
    return pd.Series([None if t is None else _COMMENTS[_STYLE.get(lang, "slash")].sub(_blank, t) for t, lang in zip(text, language)], dtype=object)
