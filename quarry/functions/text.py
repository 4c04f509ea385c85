"""Text and code predicates as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

#: Lines end with \\r\\n, \\n or \\r.
NEWLINE = r"\r\n|\n|\r"


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))


def first_of(text: Column, named: dict[str, list[str]]) -> Column:
    """The first name, in order, one of whose patterns is found; else null."""
    return F.coalesce(*(F.when(any_of(text, patterns), F.lit(name)) for name, patterns in named.items()))


def code_hash(code: Column) -> Column:
    return F.substring(F.sha2(code, 256), 1, 16)


def framework(code: Column) -> Column:
    return F.coalesce(first_of(code, {k: [v] for k, v in K.FRAMEWORKS.items()}), F.lit("unknown"))


def is_web(code: Column) -> Column:
    return any_of(code, [*K.FRAMEWORKS.values(), K.REQUEST_TAINT])


def imports_flask(code: Column) -> Column:
    low = F.lower(code)
    return low.contains("from flask") | low.contains("import flask")


def vulnerability(snippet: Column) -> Column:
    return first_of(snippet, K.UNSAFE)


def is_secure(snippet: Column, kind: Column) -> Column:
    """Reads user input, has no unsafe pattern and some safe form of its kind."""
    safe = reduce(lambda a, b: a | b, [(kind == k) & any_of(snippet, p) for k, p in K.SECURE.items()], F.lit(False))
    return snippet.rlike(K.TAINT_SOURCE) & vulnerability(snippet).isNull() & F.coalesce(safe, F.lit(False))


def is_test_path(path: Column) -> Column:
    base = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    named = base.rlike(r"^test_") | base.rlike(r"_test\.py$") | (base == "conftest.py")
    return F.coalesce(path.rlike(K.TEST_PATH) | named, F.lit(False))


def blank_keep_newlines(text: Column) -> Column:
    """A text of blanks with the same lines and length."""
    return F.regexp_replace(text, r"[^\n]", " ")


def lines(text: Column) -> Column:
    return F.split(text, NEWLINE)


def code_lines(text: Column) -> Column:
    """How many lines are neither blank nor comments."""
    return F.size(F.filter(lines(text), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#"))))


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: F.trim(x) != ""))


def normalize(text: Column) -> Column:
    """Unix line ends, no trailing blanks on lines, no blank edges."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, r"[ \t]+(\n|$)", "$1"), r"^[ \t\n]+|[ \t\n]+$", "")


def extract_cve(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)CVE-[0-9]{4}-[0-9]{4,7}", 0)), F.lit(""))


def without_literals(code: Column) -> Column:
    """Code without triple-quoted strings and comments."""
    bare = F.regexp_replace(F.regexp_replace(code, r"(?s)\"\"\".*?\"\"\"", ""), r"(?s)'''.*?'''", "")
    return F.regexp_replace(bare, r"#[^\n]*", "")


def executable_lines(code: Column) -> Column:
    return nonblank_lines(without_literals(code))


def is_attack_script(code: Column) -> Column:
    server = code.rlike(r"(?i)(from flask|import flask)") | code.rlike(K.TAINT_AUDIT)
    return ~server & code.rlike(r"\brequests\.(get|post|put)\s*\(") & code.rlike(r"(?i)(target_url|victim|http://|https://)")


def normalize_class(raw: Column) -> Column:
    """The target class of a class id in any spelling, or null."""
    number = F.regexp_extract(F.upper(F.trim(raw.cast("string"))), r"^(?:CWE-)?([0-9]+)", 1)
    return fold(number)


def fold(number: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in K.FOLD.items() for x in kv)), number)


def rule_class(rule: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in K.RULES.items() for x in kv)), F.upper(F.trim(rule)))


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<think\b[^>]*>.*?</think>", ""))


def verdict_line(text: Column) -> Column:
    """The line that holds a model's verdict: the first if it is one, else the last that is one, else null."""
    full = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != "")
    is_verdict = lambda x: x.rlike(r"(?i)^(CWE[-\s]?[0-9]+|safe)")
    first = F.try_element_at(full, F.lit(1))
    return F.when(is_verdict(first), first).otherwise(F.try_element_at(F.filter(full, is_verdict), F.lit(-1)))


def parse_response(text: Column) -> Column:
    """The predicted classes of a model's answer, an array of one or none."""
    number = F.regexp_extract(verdict_line(text), r"(?i)^CWE[-\s]?([0-9]+)", 1)
    return F.array_compact(F.array(fold(number)))


def stable_seed(*parts: Column) -> Column:
    """A 32-bit seed of the parts joined by ':'; the same in every process."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long")


def slug(cve: Column, ghsa: Column, code: Column) -> Column:
    return F.coalesce(F.lower(F.nullif(cve, F.lit(""))), F.lower(F.nullif(ghsa, F.lit(""))), F.concat(F.lit("nocve-"), code_hash(code)))


def sink_lines(code: Column, patterns: list[str]) -> Column:
    """array<struct<line, text>> of the lines that hold one of the patterns."""
    numbered = F.transform(lines(code), lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("text")))
    return F.filter(numbered, lambda x: any_of(x.text, patterns))


def excerpt(code: Column, line: Column, window: int = 8) -> Column:
    """Numbered lines around a line, which has a mark."""
    numbered = F.transform(lines(code), lambda x, i: F.concat(F.when(i + 1 == line, F.lit("> ")).otherwise(F.lit("  ")), (i + 1).cast("string"), F.lit(": "), x))
    start = F.greatest(line - window, F.lit(1))
    return F.array_join(F.slice(numbered, start, line + window - start + 1), "\n")


def issue_key(issue: Column) -> Column:
    """An issue without its details in brackets."""
    return F.trim(F.element_at(F.split(issue, r"\("), 1))


def skip_reason(reason: Column, most: int = 80) -> Column:
    """A long reason up to its colon."""
    return F.when(F.length(reason) > most, F.element_at(F.split(reason, ":"), 1)).otherwise(reason)


def names_python(descriptions: Column, references: Column, hints: str = r"(?i)\bpython\b|pypi\.org|\bdjango\b|\bflask\b|\.py\b") -> Column:
    """Whether a description (struct<lang, value>, English ones count) or a reference (a link) hints at the language."""
    told = F.exists(descriptions, lambda d: (d.lang == "en") & d.value.rlike(hints))
    linked = F.exists(references, lambda u: u.rlike(hints))
    return F.coalesce(told, F.lit(False)) | F.coalesce(linked, F.lit(False))


def recorded_line(code: Column, pattern: Column) -> Column:
    """The line of the first match of a pattern that each row has of its own; null without a match."""
    at = F.regexp_instr(code, pattern)
    return F.when(at > 0, F.size(F.split(F.substr(code, F.lit(1), at), "\n"))).cast("int")


def has_import(imports: Column, module: str, alias: str | None = None) -> Column:
    """Whether imports (see syntax.imports) have a module: by any name, or with alias under that name. Names taken from the module count too."""
    plain = lambda x: x["name"].isNull() & ((F.coalesce(x["alias"], x["module"]) == alias) if alias else F.lit(True))
    return F.exists(imports, lambda x: (x["module"] == module) & (x["name"].isNotNull() | plain(x)))


def has_from_import(imports: Column, module: str, name: str) -> Column:
    """Whether imports take a name from a module."""
    return F.exists(imports, lambda x: (x["module"] == module) & F.coalesce(x["name"] == name, F.lit(False)))


def call_matches(call: Column, target: str) -> Column:
    """Whether the dotted name of a call is the target; a target without a dot is compared with its last part. Calls without a dotted name match nothing."""
    same = (call == target) if "." in target else (F.substring_index(call, ".", -1) == target)
    return F.coalesce((call != "") & same, F.lit(False))
