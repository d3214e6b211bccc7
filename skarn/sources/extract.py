"""Symbols, imports and edges of source files.

Python is parsed by the standard library.  The other languages are read by a
small lexer: comments and strings are blanked, braces are matched, and patterns
find declarations, imports, bases and calls.  A file that can't be read becomes
an error row and never stops a job.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import language_of


@dataclass
class Extract:
    """symbols: (name, kind, start_line, end_line, exported); imports: (source, names); edges: (kind, from, target, line)."""

    symbols: list[tuple[str, str, int, int, bool]] = field(default_factory=list)
    imports: list[tuple[str, list[str]]] = field(default_factory=list)
    edges: list[tuple[str, str | None, str, int]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def python_source(text: str) -> Extract:
    out = Extract()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        out.errors.append(f"E_PARSE_ERROR: line {getattr(e, 'lineno', None) or 1}")
        return out

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            base = dotted(node.value)
            return f"{base}.{node.attr}" if base else node.attr
        return None

    def walk(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.symbols.append((child.name, "function", child.lineno, child.end_lineno, not child.name.startswith("_")))
                inner = child.name
            elif isinstance(child, ast.ClassDef):
                out.symbols.append((child.name, "class", child.lineno, child.end_lineno, not child.name.startswith("_")))
                out.edges += [("extends", child.name, name, child.lineno) for b in child.bases if (name := dotted(b))]
            elif isinstance(child, ast.Import):
                out.imports += [(a.name, [a.asname or a.name.split(".")[0]]) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out.imports.append(("." * child.level + (child.module or ""), [a.name for a in child.names]))
            elif isinstance(child, ast.Call) and (name := dotted(child.func)):
                out.edges.append(("calls", owner, name, child.lineno))
            walk(child, inner)

    walk(tree, None)
    return out


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_RUST = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)  # a quote alone is a lifetime


def blanked(text: str, language: str) -> str:
    """The text with comments and strings as spaces: places and lines stay."""
    return (_RUST if language == "rust" else _BLANK).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_ID = r"[A-Za-z_$][\w$]*"
#: language -> (kind, pattern whose group 1 is the name), in the order in which a place is claimed
_DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        ("class", rf"\b(?:abstract\s+)?class\s+({_ID})"),
        ("interface", rf"\binterface\s+({_ID})"),
        ("enum", rf"\benum\s+({_ID})"),
        ("type", rf"\btype\s+({_ID})\s*(?:<[^=]*>)?\s*="),
        ("function", rf"\bfunction\s*\*?\s*({_ID})"),
        ("function", rf"\b(?:const|let|var)\s+({_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|{_ID}\s*=>)"),
        ("variable", rf"\b(?:const|let|var)\s+({_ID})"),
        ("function", rf"(?m)^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?({_ID})\s*(?:<[^>(]*>)?\([^()]*\)\s*(?::[^{{;=\n]+)?\{{"),
    ],
    "go": [
        ("function", rf"(?m)^func\s+(?:\([^)]*\)\s*)?({_ID})"),
        ("class", rf"\btype\s+({_ID})(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", rf"\btype\s+({_ID})(?:\[[^\]]*\])?\s+interface\b"),
        ("type", rf"(?m)^type\s+({_ID})\s+"),
    ],
    "java": [
        ("class", rf"\b(?:class|record)\s+({_ID})"),
        ("interface", rf"\binterface\s+({_ID})"),
        ("enum", rf"\benum\s+({_ID})"),
        ("function", rf"(?m)^(?![ \t]*(?:return|throw|new|else)\b)[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?[\w$.\[\]<>, ?]+\s+({_ID})\s*\([^()]*\)\s*(?:throws\s[^{{;]+)?[{{;]"),
    ],
    "rust": [
        ("function", rf"\bfn\s+({_ID})"),
        ("class", rf"\bstruct\s+({_ID})"),
        ("enum", rf"\benum\s+({_ID})"),
        ("interface", rf"\btrait\s+({_ID})"),
        ("type", rf"\btype\s+({_ID})\s*="),
    ],
    "kotlin": [
        ("module", r"(?m)^package\s+([\w.]+)"),
        ("function", rf"\bfun\s+(?:<[^>]*>\s*)?((?:{_ID}\.)?{_ID})\s*\("),
        ("interface", rf"\binterface\s+({_ID})"),
        ("enum", rf"\benum\s+class\s+({_ID})"),
        ("class", rf"\b(?:class|object)\s+({_ID})"),
        ("type", rf"\btypealias\s+({_ID})"),
        ("variable", rf"\b(?:val|var)\s+({_ID})"),
    ],
    "dart": [
        ("class", rf"\b(?:class|mixin|extension)\s+({_ID})"),
        ("enum", rf"\benum\s+({_ID})"),
        ("type", rf"\btypedef\s+({_ID})"),
        ("function", rf"(?m)^[ \t]*(?:(?:static|external|factory|const)\s+)*(?:[\w<>?,\[\] ]+\s+)?((?:{_ID}\.)?{_ID})\s*\([^()]*\)\s*(?:async\*?\s*)?(?:\{{|=>)"),
        ("function", rf"(?m)^(?![ \t]*(?:return|await|throw|new|else|yield)\b)[ \t]*[\w<>?,\[\]]+\s+({_ID})\s*\([^()]*\)\s*;"),
        ("variable", rf"(?m)^(?:const|final)\s+(?:[\w<>?]+\s+)?({_ID})\s*="),
    ],
    "csharp": [
        ("module", r"\bnamespace\s+([\w.]+)"),
        ("class", rf"\b(?:class|struct|record)\s+({_ID})"),
        ("interface", rf"\binterface\s+({_ID})"),
        ("enum", rf"\benum\s+({_ID})"),
        ("type", rf"\bdelegate\s+[\w<>\[\]?]+\s+({_ID})"),
        ("function", rf"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|partial)\s+)+(?:[\w<>\[\]?.,]+\s+)?({_ID})\s*(?:<[^>]*>)?\([^()]*\)\s*(?::\s*(?:base|this)\([^)]*\)\s*)?(?:\{{|=>|;)"),
        ("variable", rf"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|readonly)\s+)+[\w<>\[\]?.,]+\s+({_ID})\s*(?:\{{|=|;)"),
    ],
}
_DECLARATIONS["javascript"] = _DECLARATIONS["typescript"]

#: language -> pattern of an import in the plain text (group 1: source)
_IMPORTS = {
    "typescript": r"(?m)^\s*(?:import|export)\b\s*([\w$*{},\s]*?)\s*['\"]([^'\"]+)['\"]",
    "go": r"(?m)^\s*(?:import\s+)?((?:[\w.]+\s+)?)\"([\w./-]+)\"\s*$",
    "java": r"(?m)^\s*import\s+((?:static\s+)?)([\w.*]+)\s*;",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+()([\w:{}, *]+);",
    "kotlin": r"(?m)^\s*import\s+()([\w.*]+)(?:\s+as\s+\w+)?",
    "dart": r"(?m)^\s*(?:import|export|part of|part)\s+()['\"]?([^'\";\s]+)['\"]?",
    "csharp": r"(?m)^\s*(?:global\s+)?using\s+((?:static\s+)?(?:\w+\s*=\s*)?)([\w.]+)\s*;",
}
_IMPORTS["javascript"] = _IMPORTS["typescript"]
_NOT_CALLS = set("if for while switch catch return function new typeof await super this fn match loop when else do throw sizeof using lock nameof base constructor import require assert in is as def class func fun".split())


def _bases(language: str, code: str) -> Iterator[tuple[str, str, str, int]]:
    """kind, from, target, position"""
    names = lambda part: [re.sub(r"[<(].*", "", x, flags=re.S).strip() for x in re.split(r",(?![^<]*>)", part) if x.strip()]
    if language in ("typescript", "javascript", "java", "dart"):
        for m in re.finditer(rf"\b(?:class|interface|mixin|record|enum)\s+({_ID})(?:<[^{{]*?>)?([^{{;]*)\{{", code):
            for kind, word in (("extends", r"extends|on"), ("implements", r"implements|with")):
                for part in re.findall(rf"\b(?:{word})\s+(.*?)(?=\b(?:extends|implements|with|on)\b|$)", m[2], re.S):
                    yield from ((kind, m[1], n, m.start()) for n in names(part) if n)
    elif language == "go":
        for m in re.finditer(rf"\btype\s+({_ID})\s+(?:struct|interface)\s*\{{([^}}]*)\}}", code):
            yield from (("extends", m[1], x[1], m.start()) for x in re.finditer(r"(?m)^\s*\*?([\w.]+)\s*$", m[2]))
    elif language == "rust":
        yield from (("implements", m[2], m[1], m.start()) for m in re.finditer(r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)", code))
    elif language == "kotlin":
        for m in re.finditer(rf"\b(?:class|object|interface)\s+({_ID})(?:<[^>]*>)?(?:\s*\([^()]*\))?\s*:\s*([^{{\n]+)", code):
            yield from (("extends" if "(" in x else "implements", m[1], names(x)[0], m.start()) for x in re.split(r",(?![^(<]*[)>])", m[2]) if names(x))
    elif language == "csharp":
        for m in re.finditer(rf"\b(?:class|struct|record|interface)\s+({_ID})(?:<[^>]*>)?(?:\s*\([^()]*\))?\s*:\s*([^{{\n]+)", code):
            yield from (("implements" if re.match(r"I[A-Z]", n.split(".")[-1]) else "extends", m[1], n, m.start()) for n in names(m[2]))


def braced_source(text: str, language: str) -> Extract:
    out, code = Extract(), blanked(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect.bisect_right(starts, at)
    close, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
        else:
            out.errors.append(f"E_PARSE_ERROR: line {line(m.start())}")
            break
    if stack:
        out.errors.append(f"E_PARSE_ERROR: line {line(stack[-1])}")
    opens, claimed, spans = sorted(close), set(), []
    for kind, pattern in _DECLARATIONS[language]:
        for m in re.finditer(pattern, code):
            name, at = m[1], m.start(1)
            if at in claimed or name in _NOT_CALLS:
                continue
            claimed.add(at)
            ends = code.find("\n", m.end() - 1)
            k = bisect.bisect_left(opens, m.end() - 1)
            brace = opens[k] if k < len(opens) else -1
            body = brace >= 0 and not re.search(r";|\n\s*\n", code[m.end() : brace]) and kind not in ("module", "variable", "type")
            end = close[brace] if body else (ends if ends >= 0 else len(code))
            before = code[max(code.rfind("\n", 0, at), 0) : at]
            shown = bool(re.search(r"\b(export|pub|public)\b", before)) or language in ("go",) and name[0].isupper() or language in ("kotlin", "dart") and "private" not in before and name[0] != "_"
            out.symbols.append((name, kind, line(m.start(1)), line(end if body else max(end - 1, at)), shown))
            spans.append((m.start(), end, name, kind))
    seen_imports = set()
    for m in re.finditer(_IMPORTS[language], text):
        if (m[2], line(m.start(2))) not in seen_imports and (language != "go" or "import" in text[: m.end()]):
            seen_imports.add((m[2], line(m.start(2))))
            out.imports.append((m[2].strip(), [n for n in re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"\b(type|static|as|from)\b", " ", m[1]))]))
    out.edges += [(kind, frm, target, line(at)) for kind, frm, target, at in _bases(language, code)]
    functions = sorted((a, b, n) for a, b, n, k in spans if k == "function")
    for m in re.finditer(rf"((?:{_ID}(?:\.|::))*{_ID})(!?)\s*\(", code):
        name = m[1]
        last = m.start() + max(name.rfind("."), name.rfind(":")) + 1
        if last in claimed or m.start() in claimed or name.split(".")[-1] in _NOT_CALLS or name in _NOT_CALLS:
            continue
        inside = [f for f in functions if f[0] <= m.start() <= f[1]]
        owner = min(inside, key=lambda f: f[1] - f[0])[2] if inside else None
        out.edges.append(("calls", owner, name, line(m.start())))
    out.symbols.sort(key=lambda s: (s[2], s[0]))
    return out


def extract(text: str, language: str) -> Extract:
    try:
        if language == "python":
            return python_source(text)
        if language in _DECLARATIONS:
            return braced_source(text, language)
        return Extract()
    except Exception as e:  # a source no pattern foresaw is an error row, not the end of a job
        return Extract(errors=[f"E_PARSE_ERROR: {type(e).__name__}"])


_SCHEMA = (
    "path string, language string, symbols array<struct<name: string, kind: string, start_line: int, end_line: int, exported: boolean>>, "
    "imports array<struct<source: string, names: array<string>>>, edges array<struct<kind: string, from_symbol: string, target: string, line: int>>, errors array<string>"
)


def extract_files(files: DataFrame) -> DataFrame:
    """One row per file (path, content): its language, symbols, imports, edges and errors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content, language in zip(pdf["path"], pdf["content"], pdf["language"], strict=True):
                e = extract(content or "", language)
                rows.append(
                    (
                        path,
                        language,
                        [dict(zip(("name", "kind", "start_line", "end_line", "exported"), s, strict=True)) for s in e.symbols],
                        [dict(zip(("source", "names"), i, strict=True)) for i in e.imports],
                        [dict(zip(("kind", "from_symbol", "target", "line"), x, strict=True)) for x in e.edges],
                        e.errors,
                    )
                )
            yield pd.DataFrame(rows, columns=["path", "language", "symbols", "imports", "edges", "errors"])

    return files.select("path", "content", language_of(F.col("path")).alias("language")).mapInPandas(run, _SCHEMA)
