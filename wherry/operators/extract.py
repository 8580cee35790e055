"""Symbol and call extraction from source text.

Python is parsed with the standard library's ``ast``; other languages use one declarative table of line patterns with
brace or indentation scopes. Type-aware resolution is partial: a call gives its dotted name, and the joins resolve names.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

SYMBOLS = "path string, name string, qualified_name string, kind string, start int, end int, signature string, docstring string, body string"
CALLS = "path string, caller string, callee string, line int"


@dataclass(frozen=True)
class Profile:
    """Patterns of one language: each has a group ``name``; containers open a scope, callables may lie in one."""

    containers: tuple[tuple[str, str], ...]
    callables: tuple[tuple[str, str], ...]
    comment: str = r"^\s*(//|/\*|\*)"
    separator: str = "."


_BRACE_CALL = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|override|async|virtual|suspend|inline|export|default|unsafe|pub(?:\([a-z]+\))?)\s+)*"
PROFILES: dict[str, Profile] = {
    "go": Profile((("type", r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\b"),), (("method", r"^func\s+\(\s*\w*\s*\*?(?P<scope>\w+)[^)]*\)\s*(?P<name>\w+)\s*\("), ("function", r"^func\s+(?P<name>\w+)\s*[\[(]"))),
    "typescript": Profile((("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)")), (("function", _BRACE_CALL + r"function\s*\*?\s*(?P<name>\w+)\s*[<(]"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("method", r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<name>\w+)\s*\([^;]*\)\s*(?::\s*[^{]+)?\{"))),
    "java": Profile((("class", _BRACE_CALL + r"(?:class|enum|record)\s+(?P<name>\w+)"), ("interface", _BRACE_CALL + r"interface\s+(?P<name>\w+)")), (("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\([^;{]*\)\s*(?:throws\s+[\w,\s.]+)?\{"),)),
    "rust": Profile((("type", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:struct|enum|trait)\s+(?P<name>\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)")), (("function", _BRACE_CALL + r"fn\s+(?P<name>\w+)\s*[<(]"),), separator="::"),
    "ruby": Profile((("class", r"^\s*(?:class|module)\s+(?P<name>[A-Z]\w*)"),), (("method", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)"),), comment=r"^\s*#"),
    "php": Profile((("class", _BRACE_CALL + r"(?:class|trait|interface)\s+(?P<name>\w+)"),), (("function", _BRACE_CALL + r"function\s+&?(?P<name>\w+)\s*\("),), separator="\\"),
    "kotlin": Profile((("class", _BRACE_CALL + r"(?:data\s+|sealed\s+|open\s+)*(?:class|object|interface)\s+(?P<name>\w+)"),), (("function", _BRACE_CALL + r"fun\s+(?:<[^>]+>\s+)?(?:\w+\.)?(?P<name>\w+)\s*\("),)),
    "scala": Profile((("class", r"^\s*(?:case\s+)?(?:class|object|trait)\s+(?P<name>\w+)"),), (("function", r"^\s*(?:override\s+|private\s+|protected\s+|final\s+)*def\s+(?P<name>\w+)"),)),
    "c": Profile((("type", r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{"),), (("function", r"^(?!\s*(?:if|for|while|switch|return|else)\b)[A-Za-z_][\w\s*&:<>,]*?\b(?P<name>\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{"),)),
}
for _same, _as in (("tsx", "typescript"), ("javascript", "typescript"), ("csharp", "java"), ("cpp", "c")):
    PROFILES[_same] = PROFILES[_as]
# Words before a bracket that are no calls.
NO_CALLS = frozenset("if for while switch catch return function func fn def class new sizeof typeof await match when else elif select case defer go print len append make cap panic range and or not in is lambda except with assert".split())
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)*)\s*\(")


def _end_of(lines: list[str], start: int, indented: bool) -> int:
    """Last line of a scope that opens at ``start``: balanced braces, or the end of a deeper indentation."""
    if not indented:
        depth, opened = 0, False
        for i in range(start, len(lines)):
            code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[i])
            depth += code.count("{") - code.count("}")
            opened = opened or "{" in code
            if opened and depth <= 0:
                return i
            if not opened and (code.rstrip().endswith(";") or i > start + 8):
                break
        return start if not opened else len(lines) - 1
    base = len(lines[start]) - len(lines[start].lstrip())
    last = start
    for i in range(start + 1, len(lines)):
        if not lines[i].strip():
            continue
        deep = len(lines[i]) - len(lines[i].lstrip())
        if deep <= base:
            return i if lines[i].strip() == "end" else last
        last = i
    return last


def _doc_above(lines: list[str], start: int, comment: str) -> str:
    """The contiguous comment block above a line; attributes are stepped over."""
    i, found = start - 1, []
    while i >= 0 and re.match(r"^\s*(@\w|#\[|\[\w)", lines[i]):
        i -= 1
    while i >= 0 and re.match(comment, lines[i]):
        found.append(lines[i].strip())
        i -= 1
    return "\n".join(reversed(found))


def _python(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    lines, symbols, calls = source.split("\n"), [], []
    module = path.rsplit("/", 1)[-1].removesuffix(".py")
    bases: dict[str, list[str]] = {}
    methods: dict[str, set[str]] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            bases[node.name] = [b.id for b in node.bases if isinstance(b, ast.Name)]
            methods[node.name] = {x.name for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))}

    def owner(cls: str, name: str) -> str | None:
        """The class that defines a method, over the base classes breadth first."""
        queue, seen = [cls], set()
        while queue:
            c = queue.pop(0)
            if c in seen:
                continue
            seen.add(c)
            if name in methods.get(c, ()):
                return c
            queue += bases.get(c, [])
        return None

    def dotted(f: ast.expr) -> str | None:
        parts = []
        while isinstance(f, ast.Attribute):
            parts.append(f.attr)
            f = f.value
        return ".".join([f.id, *reversed(parts)]) if isinstance(f, ast.Name) else None

    def visit(node: ast.AST, scope: str, cls: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                name = f"{scope}.{child.name}"
                kind = "class" if is_class else "method" if cls and scope.endswith(cls) else "function"
                symbols.append((path, child.name, name, kind, child.lineno, child.end_lineno, lines[child.lineno - 1].strip(), ast.get_docstring(child) or "", "\n".join(lines[child.lineno - 1 : child.end_lineno])))
                if not is_class:
                    seen = set()
                    for x in ast.walk(child):
                        callee = dotted(x.func) if isinstance(x, ast.Call) else None
                        if callee and callee.split(".")[0] in ("self", "cls") and cls and callee.count(".") == 1:
                            home = owner(cls, callee.split(".")[1])
                            callee = f"{module}.{home}.{callee.split('.')[1]}" if home else None
                        if callee and callee not in seen and callee not in NO_CALLS:
                            seen.add(callee)
                            calls.append((path, name, callee, x.lineno))
                visit(child, name, child.name if is_class else None)
            else:
                visit(child, scope, cls)

    visit(tree, module, None)
    return symbols, calls


def _profiled(path: str, source: str, profile: Profile, indented: bool) -> tuple[list[tuple], list[tuple]]:
    lines, symbols, calls = source.split("\n"), [], []
    module = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    open_scopes: list[tuple[int, str]] = []
    containers = [(k, re.compile(p)) for k, p in profile.containers]
    callables = [(k, re.compile(p)) for k, p in profile.callables]
    for i, line in enumerate(lines):
        open_scopes = [s for s in open_scopes if s[0] >= i]
        if re.match(profile.comment, line):
            continue
        for group, patterns in ((0, containers), (1, callables)):
            hit = next(((k, m) for k, p in patterns if (m := p.match(line))), None)
            if not hit:
                continue
            kind, m = hit
            end = _end_of(lines, i, indented)
            scope = m.groupdict().get("scope") or profile.separator.join(s for _, s in open_scopes)
            name = m["name"]
            qualified = ".".join(x for x in (module, scope, name) if x)
            if kind != "impl":
                kind = "method" if kind == "function" and scope else kind
                symbols.append((path, name, qualified, kind, i + 1, end + 1, line.strip().rstrip("{").strip(), _doc_above(lines, i, profile.comment), "\n".join(lines[i : end + 1])))
            if group == 0:
                open_scopes.append((end, name))
            else:
                seen = set()
                for j in range(i, end + 1):
                    text = lines[j][m.end() :] if j == i else lines[j]
                    if re.match(profile.comment, text):
                        continue
                    for c in _CALL.findall(text):
                        if c not in seen and c.split(".")[-1] not in NO_CALLS:
                            seen.add(c)
                            calls.append((path, qualified, c.replace("::", "."), j + 1))
            break
    return symbols, calls


def extract_source(path: str, language: str | None, source: str | None) -> tuple[list[tuple], list[tuple]]:
    """(symbols, calls) of one file; unknown languages give none."""
    if not source or not language:
        return [], []
    if language == "python":
        return _python(path, source)
    profile = PROFILES.get(language)
    return _profiled(path, source, profile, language == "ruby") if profile else ([], [])


def _run(files: DataFrame, which: int, schema: str) -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, lang, s in zip(pdf["path"], pdf["language"], pdf["source"]) for r in extract_source(p, lang, s)[which]]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "language", "source").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, source)."""
    return _run(files, 0, SYMBOLS)


def calls(files: DataFrame) -> DataFrame:
    """Calls of files, each callee once for a caller, with its first line."""
    return _run(files, 1, CALLS)
