"""Functions of Python source that need a parser or a scanner: Arrow UDFs and a table function."""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from . import constants as K
from .prefilter import fold, possible

TRIPLE = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'')
SCAN = re.compile(r"""\\.|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|(#[^\n]*)""", re.S)
IMPORT = re.compile(r"^\s*(?:from\s+\S+\s+)?import\s")
LITERAL = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")


def parses(code: str | None) -> bool:
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
        return False
    return True


def blank(match: re.Match) -> str:
    return re.sub(r"[^\n]", " ", match[0])


def strip_comments(code: str | None) -> str | None:
    """Code with triple-quoted strings and comments blanked, of the same length and lines; '#' inside strings stays."""
    if code is None:
        return None
    bare = TRIPLE.sub(blank, code)
    return SCAN.sub(lambda m: " " * len(m[0]) if m[1] else m[0], bare)


def near(code: str, offset: int, window: int, pattern: re.Pattern, clean, skip=None) -> bool:
    """Whether pattern is found within window lines of an offset, in lines that clean() has rid of what does not count."""
    lines = TRIPLE.sub(blank, code).split("\n")
    at = code.count("\n", 0, offset)
    part = [clean(x) for x in lines[max(0, at - window) : at + window + 1] if skip is None or not skip.match(x)]
    return bool(pattern.search("\n".join(part)))


def _java(pattern: str) -> re.Pattern:
    return re.compile(pattern)


REQUEST = _java(K.REQUEST_NEAR)
SECURITY = _java(K.SECURITY_NEAR)


def request_near(code: str, offset: int, window: int = 20) -> bool:
    return near(code, offset, window, REQUEST, lambda x: re.sub("#.*$", "", x))


def security_near(code: str, offset: int, window: int = 10) -> bool:
    return near(code, offset, window, SECURITY, lambda x: LITERAL.sub("", re.sub("#.*$", "", x)), IMPORT)


SINKS = {c: [_java(p) for p in ps] for c, ps in K.SINKS.items()}
TEST_PATH = _java(K.TEST_PATH)
SUPPRESSED = _java(K.SUPPRESSED)


def is_test(path: str | None) -> bool:
    if not path:
        return False
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    return bool(TEST_PATH.search(path) or base.startswith("test_") or base.endswith("_test.py") or base == "conftest.py")


def gate(code: str | None, cwe: str | None, path: str | None, context: frozenset = frozenset()) -> tuple[bool, str | None]:
    """(passes, pattern) of the whole sink gate: comments do not count, marked lines are suppressed, and some classes need
    request data or (classes in context) security words near the sink."""
    patterns = SINKS.get(cwe)
    if not patterns:
        return True, None
    if cwe in K.TEST_EXCLUDED and is_test(path):
        return False, None
    code = code or ""
    low = fold(code)
    # blanks take the place of comments, so that what the whole code lacks, it lacks without them
    patterns = [p for p in patterns if possible(p.pattern, low)]
    if not patterns:
        return False, None
    bare = strip_comments(code)
    for p in patterns:
        for m in p.finditer(bare):
            line = code[code.rfind("\n", 0, m.start()) + 1 : (code + "\n").index("\n", m.start())]
            if SUPPRESSED.search(line):
                continue
            if cwe in context and not security_near(code, m.start()):
                continue
            if cwe in K.NEEDS_REQUEST and not request_near(code, m.start()):
                continue
            return True, p.pattern
    return False, None


def routes(code: str | None) -> list[str]:
    """Source of each function that is decorated with a call of route, decorators included: of an object's .route(...), or of a bare route(...)."""
    if not parses(code):
        return []
    lines, out = code.split("\n"), []
    for node in ast.walk(ast.parse(code)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            marks = [ast.unparse(d) for d in node.decorator_list]
            if any(".route(" in d or d.startswith("route(") for d in marks):
                first = min(d.lineno for d in node.decorator_list)
                out.append("\n".join(lines[first - 1 : node.end_lineno]))
    return out


def chain(node: ast.AST) -> str:
    """a.b.c of an attribute chain, or an empty text."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else ""


def imports(code: str | None) -> list[dict]:
    """The imports of a module's top level, in order: of `import a.b as c` the module a.b and the alias c, of `from m import n as c` also the name n; a relative import has the dots before its module."""
    out = []
    for node in ast.parse(code).body if parses(code) else ():
        if isinstance(node, ast.Import):
            out += [{"module": a.name, "name": None, "alias": a.asname} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [{"module": "." * node.level + (node.module or ""), "name": a.name, "alias": a.asname} for a in node.names]
    return out


def insert_import(code: str | None, module: str, name: str | None = None) -> str | None:
    """Code with `import module`, or `from module import name`, behind its docstring and its imports from the future, unless it has one already; code that does not parse stays as it is."""
    if not parses(code):
        return code
    if any(x["module"] == module and (x["name"] == name if name else True) for x in imports(code)):
        return code
    lines, at = code.splitlines(keepends=True), 0
    for i, node in enumerate(ast.parse(code).body):
        docstring = i == 0 and isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)
        if not docstring and not (isinstance(node, ast.ImportFrom) and node.module == "__future__"):
            break
        at = node.end_lineno
    if at and not lines[at - 1].endswith(("\n", "\r")):
        lines[at - 1] += "\n"
    lines.insert(at, f"from {module} import {name}\n" if name else f"import {module}\n")
    new = "".join(lines)
    return new if parses(new) else code


def changed_lines(before: str | None, after: str | None) -> list[dict]:
    """Removed and added lines of a difference without context."""
    out = []
    for x in difflib.unified_diff((before or "").splitlines(), (after or "").splitlines(), n=0, lineterm=""):
        if x[:1] in "+-" and not x.startswith(("+++", "---")):
            out.append({"op": "added" if x[0] == "+" else "removed", "text": x[1:].strip()})
    return out


def locate(code: str | None, cwe: str | None, recorded: str | None) -> dict:
    """Line and pattern of a row's sink: the recorded pattern first (ignored if it is broken), then the catalogue."""
    tries = []
    if recorded:
        try:
            tries.append(re.compile(recorded, re.I | re.S))
        except re.error:
            pass
    for p in [*tries, *SINKS.get(cwe, ())]:
        if m := p.search(code or ""):
            return {"line": code.count("\n", 0, m.start()) + 1, "pattern": p.pattern}
    return {"line": None, "pattern": None}


CREDENTIAL = _java(K.CREDENTIAL)


def redact(code: str | None) -> str | None:
    """Code whose first literal credential is read from the environment instead, os imported behind the imports of the first 20 lines."""
    m = CREDENTIAL.search(code or "")
    if m is None:
        return code
    key = m["key"].lower()
    name = next((v for hint, v in K.CREDENTIAL_NAMES.items() if hint in key), K.CREDENTIAL_DEFAULT)
    out = f"{code[: m.start('val')]}os.environ['{name}']{code[m.end('val') :]}"
    lines = out.splitlines()
    if any(x.strip() == "import os" or x.strip().startswith("import os,") for x in lines[:20]):
        return out
    at = max((i + 1 for i, x in enumerate(lines[:20]) if x.startswith(("import ", "from "))), default=0)
    return "\n".join([*lines[:at], "import os", *lines[at:]])


@pandas_udf(T.BooleanType())
def is_valid_python(code: pd.Series) -> pd.Series:
    return code.map(parses).astype(bool)


@pandas_udf(T.StringType())
def strip_comments_udf(code: pd.Series) -> pd.Series:
    return code.map(strip_comments)


@pandas_udf(T.StringType())
def redact_udf(code: pd.Series) -> pd.Series:
    return code.map(redact)


@pandas_udf(T.StructType().add("ok", T.BooleanType()).add("pattern", T.StringType()))
def full_gate(code: pd.Series, cwe: pd.Series, path: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([gate(*x) for x in zip(code, cwe, path, strict=True)], columns=["ok", "pattern"])


@pandas_udf(T.ArrayType(T.StringType()))
def routes_udf(code: pd.Series) -> pd.Series:
    return code.map(routes)


@pandas_udf(T.ArrayType(T.StructType().add("op", T.StringType()).add("text", T.StringType())))
def changed_lines_udf(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([changed_lines(b, a) for b, a in zip(before, after, strict=True)])


@pandas_udf(T.ArrayType(T.StructType().add("module", T.StringType()).add("name", T.StringType()).add("alias", T.StringType())))
def imports_udf(code: pd.Series) -> pd.Series:
    return code.map(imports)


@pandas_udf(T.StructType().add("line", T.IntegerType()).add("pattern", T.StringType()))
def locate_udf(code: pd.Series, cwe: pd.Series, recorded: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([locate(*x) for x in zip(code, cwe, recorded, strict=True)], columns=["line", "pattern"]).astype({"line": "Int32"})


def calls_table():
    """A table function: (call, line) of every call in a source text; nothing if it does not parse."""

    @udtf(returnType="call: string, line: int")
    class Calls:
        def eval(self, code: str) -> Iterator[tuple[str, int]]:
            if parses(code):
                for node in ast.walk(ast.parse(code)):
                    if isinstance(node, ast.Call):
                        yield chain(node.func), node.lineno

    return Calls
