"""Syntax-tree transforms as plug-ins: variants of labelled samples that keep their meaning, and safe twins.

Variants probe how robust detectors are on a labelled test corpus. A plug-in rewrites a tree in place with a seeded generator and says
whether it changed anything; parsing, choice, checking and writing are done here, inside Arrow UDFs. Where nothing applies, the
text stays as it was; otherwise it is what ast.unparse() writes.
"""

from __future__ import annotations

import ast
import functools
import hashlib
import random
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import constants as K
from ..functions.syntax import chain, parses
from ..functions.text import code_hash

Rewrite = Callable[[ast.AST, random.Random], int]


@dataclass(frozen=True)
class Transform:
    """A rewrite of a module's first function, or of the whole module; it returns how many places it changed."""

    name: str
    rewrite: Rewrite
    whole_module: bool = False
    cwe: str | None = None


MUTATORS: dict[str, Transform] = {}
SANITIZERS: dict[str, list[Transform]] = {}


def register(t: Transform) -> Transform:
    known = [m.name for m in MUTATORS.values()] + [s.name for rules in SANITIZERS.values() for s in rules]
    if t.name in known:
        raise ValueError(f"there is a transform {t.name} already")
    if t.cwe is None:
        MUTATORS[t.name] = t
    else:
        SANITIZERS.setdefault(t.cwe, []).append(t)
    return t


def _mutator(name: str, whole_module: bool = False):
    return lambda f: register(Transform(name, f, whole_module)).rewrite


def _sanitizer(name: str, cwe: str):
    return lambda f: register(Transform(name, f, True, cwe)).rewrite


def seed_of(*parts) -> int:
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def first_function(tree: ast.Module):
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    return next((n for n in tree.body if isinstance(n, kinds)), None) or next((n for n in ast.walk(tree) if isinstance(n, kinds)), None)


def _docstring(fn) -> int:
    return 1 if fn.body and isinstance(fn.body[0], ast.Expr) and isinstance(fn.body[0].value, ast.Constant) and isinstance(fn.body[0].value.value, str) else 0


def _is_docstring(parent, node) -> bool:
    return isinstance(parent, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and parent.body and parent.body[0] is node


class _Editor(ast.NodeTransformer):
    """Replaces each node that edit() returns something for."""

    def __init__(self, edit, limit: int = 1 << 30):
        self.edit, self.limit, self.n = edit, limit, 0

    def visit(self, node):
        node = self.generic_visit(node)
        if self.n < self.limit and (new := self.edit(node)) is not None:
            self.n += 1
            return ast.copy_location(new, node)
        return node


def _edit(tree: ast.AST, edit, limit: int = 1 << 30) -> int:
    e = _Editor(edit, limit)
    for name, value in list(ast.iter_fields(tree)):
        if isinstance(value, list):
            setattr(tree, name, [e.visit(x) if isinstance(x, ast.AST) else x for x in value])
        elif isinstance(value, ast.AST):
            setattr(tree, name, e.visit(value))
    ast.fix_missing_locations(tree)
    return e.n


def _add_import(tree: ast.Module, line: str) -> None:
    new = ast.parse(line).body[0]
    if not any(ast.dump(x) == ast.dump(new) for x in tree.body):
        at = _docstring(tree)
        while at < len(tree.body) and isinstance(tree.body[at], ast.ImportFrom) and tree.body[at].module == "__future__":
            at += 1
        tree.body.insert(at, new)


def _expr(text: str, **parts: ast.AST) -> ast.expr:
    """A parsed expression in which names are replaced by given nodes."""
    tree = ast.parse(text, mode="eval")
    _edit(tree, lambda n: parts.get(n.id) if isinstance(n, ast.Name) else None)
    return tree.body


# variants


@_mutator("dead_code_injection")
def _dead_code(fn, rng):
    size = len(fn.body)
    least, most = next(x for top, x in ((1, (1, 1)), (5, (1, 2)), (20, (2, 3)), (1 << 30, (3, 4))) if size <= top)
    n = rng.randint(least, most)
    for i in range(n):
        v = f"_unused_{rng.randrange(1 << 16):04x}"
        text = rng.choice([f"{v} = {rng.randrange(100)}", f"if False:\n    {v} = None", f"{v} = [{i}, {i + 1}]", f"for {v} in ():\n    pass"])
        fn.body.insert(rng.randint(_docstring(fn), len(fn.body)), ast.parse(text).body[0])
    return n


@_mutator("string_split")
def _string_split(fn, rng):
    skip = {id(fn.body[0].value)} if _docstring(fn) else set()
    for node in ast.walk(fn):
        for a in ("annotation", "returns"):
            if isinstance(getattr(node, a, None), ast.AST):
                skip |= {id(x) for x in ast.walk(getattr(node, a))}
        if isinstance(node, ast.JoinedStr):
            skip |= {id(x) for x in node.values}
        if isinstance(node, ast.FormattedValue) and node.format_spec is not None:
            skip.add(id(node.format_spec))
        if isinstance(node, ast.MatchValue):
            skip |= {id(x) for x in ast.walk(node)}

    def long(x):
        return isinstance(x, ast.Constant) and isinstance(x.value, str) and len(x.value) >= 6

    def pieces(x):
        """A long literal in pieces; a formatted value as a string of its own, so that its format stays."""
        if isinstance(x, ast.FormattedValue):
            return [ast.JoinedStr([x])]
        if not long(x):
            return [x]
        cuts = sorted(rng.sample(range(1, len(x.value)), min(3, rng.randint(1, 3))))
        return [ast.Constant(x.value[a:b]) for a, b in zip([0, *cuts], [*cuts, None], strict=True)]

    def edit(node):
        if id(node) in skip:
            return None
        values = node.values if isinstance(node, ast.JoinedStr) else [node]
        if not any(map(long, values)):
            return None
        return functools.reduce(lambda a, b: ast.BinOp(a, ast.Add(), b), [p for v in values for p in pieces(v)])

    return _edit(fn, edit, 8)


@_mutator("variable_rename")
def _variable_rename(fn, rng):
    stored = {n.id for n in ast.walk(fn) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    fixed = {x for n in ast.walk(fn) if isinstance(n, (ast.Global, ast.Nonlocal)) for x in n.names}
    fixed |= {a.arg for n in ast.walk(fn) if isinstance(n, ast.arguments) for a in [*n.posonlyargs, *n.args, *n.kwonlyargs, n.vararg, n.kwarg] if a}
    inner = {n.name for n in ast.walk(fn) if n is not fn and isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    names = sorted(stored - fixed - inner)
    if not names or any(isinstance(n, ast.Call) and chain(n.func) in ("locals", "vars", "eval", "exec") for n in ast.walk(fn)):
        return 0
    chosen = rng.sample(names, max(1, round(len(names) * rng.uniform(0.5, 1.0))))
    used = {n.id for n in ast.walk(fn) if isinstance(n, ast.Name)} | fixed | inner
    new = {}
    for name in chosen:
        alike = [x for x in K.SYNONYMS.get(name, K.SYNONYMS.get(name.lower(), ())) if x not in used]
        to, i = rng.choice(alike) if alike else f"var_{seed_of(name, 0) % 10_000}", 0
        while to in used:
            i += 1
            to = f"var_{seed_of(name, i) % 10_000}"
        used.add(to)
        new[name] = to
    for n in ast.walk(fn):
        if isinstance(n, ast.Name) and n.id in new:
            n.id = new[n.id]
        elif isinstance(n, ast.ExceptHandler) and n.name in new:
            n.name = new[n.name]
    return len(new)


SINK_NAMES = {name for names in K.SINK_CALLS.values() for name in names}


@_mutator("wrapper_extraction")
def _wrapper(fn, rng):
    calls = [n for s in fn.body[_docstring(fn) :] for n in ast.walk(s) if isinstance(n, ast.Call) and chain(n.func) and chain(n.func) not in ("super", "locals", "vars", "globals")]
    inside = {id(c) for s in fn.body for n in ast.walk(s) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)) for c in ast.walk(n)}
    assigned = {n.id for n in ast.walk(fn) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    calls = [c for c in calls if id(c) not in inside and chain(c.func).split(".")[0] not in assigned]
    if not calls:
        return 0
    named = [c for c in calls if chain(c.func).split(".")[-1] in SINK_NAMES]
    call = rng.choice(named or calls)
    awaited = any(isinstance(n, ast.Await) and n.value is call for n in ast.walk(fn))
    name = f"_wrap_{seed_of(chain(call.func)) % 10_000}"
    head = "async def" if awaited else "def"
    helper = ast.parse(f"{head} {name}(*_a, **_kw):\n    return {'await ' if awaited else ''}{chain(call.func)}(*_a, **_kw)").body[0]
    call.func = ast.Name(name, ast.Load())
    fn.body.insert(_docstring(fn), helper)
    return 1


ATTRIBUTE_SINKS = {f"{module}.{name}" for module, names in K.HIDDEN_CALLS.items() for name in names}


def _is_sink(call: ast.AST) -> bool:
    if not isinstance(call, ast.Call):
        return False
    if isinstance(call.func, ast.Name):
        return call.func.id in K.HIDDEN_BUILTINS
    return isinstance(call.func, ast.Attribute) and (call.func.attr in K.HIDDEN_METHODS or chain(call.func) in ATTRIBUTE_SINKS)


@_mutator("sink_attr_obfuscate", True)
def _attr_obfuscate(tree, rng):
    def edit(n):
        if _is_sink(n) and isinstance(n.func, ast.Attribute):
            n.func = _expr(f"getattr(_v, {n.func.attr!r})", _v=n.func.value)
            return n
        return None

    return _edit(tree, edit)


@_mutator("sink_via_globals", True)
def _via_globals(tree, rng):
    """Built-in sinks are looked up by name in their module. What is written in their place is not looked at again."""

    def edit(n):
        if _is_sink(n) and isinstance(n.func, ast.Name):
            n.func = _expr(f"__import__('builtins').__dict__[{n.func.id!r}]")
            return n
        return None

    return _edit(tree, edit)


@_mutator("taint_through_dict", True)
def _through_dict(tree, rng):
    def edit(n):
        if _is_sink(n):
            for i, a in enumerate(n.args):
                if not isinstance(a, (ast.Constant, ast.Starred)):
                    n.args[i] = _expr("{'k': _v}['k']", _v=a)
                    return n
        return None

    return _edit(tree, edit)


# safe twins


def _called(names: set[str], last: bool = False):
    def test(n) -> bool:
        if not isinstance(n, ast.Call):
            return False
        name = chain(n.func) or (n.func.attr if isinstance(n.func, ast.Attribute) else "")
        return (name.split(".")[-1] if last else name) in names

    return test


def _is_wrapped(node: ast.AST, name: str) -> bool:
    return isinstance(node, ast.Call) and chain(node.func).split(".")[-1] == name


@_sanitizer("sql_fstring_to_params", "CWE-89")
def _sql_fstring(tree, rng):
    runs = _called({"execute", "executemany", "executescript", "raw"}, True)

    def edit(n):
        if runs(n) and n.args and isinstance(n.args[0], ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in n.args[0].values):
            values = n.args[0].values
            text = "".join(v.value if isinstance(v, ast.Constant) else "?" for v in values).replace("'?'", "?").replace('"?"', "?")
            n.args[:1] = [ast.Constant(text), ast.Tuple([v.value for v in values if isinstance(v, ast.FormattedValue)], ast.Load())]
            return n
        return None

    return _edit(tree, edit)


@_sanitizer("sql_percent_to_params", "CWE-89")
def _sql_percent(tree, rng):
    runs = _called({"execute", "executemany", "executescript", "raw"}, True)

    def edit(n):
        if runs(n) and n.args and isinstance(n.args[0], ast.BinOp) and isinstance(n.args[0].op, ast.Mod) and isinstance(n.args[0].left, ast.Constant) and isinstance(n.args[0].left.value, str):
            right = n.args[0].right
            n.args[:1] = [n.args[0].left, right if isinstance(right, ast.Tuple) else ast.Tuple([right], ast.Load())]
            return n
        return None

    return _edit(tree, edit)


@_sanitizer("markup_to_escape", "CWE-79")
def _markup(tree, rng):
    marks = _called({"Markup", "mark_safe"}, True)

    def edit(n):
        if marks(n):
            n.func = ast.Name("escape", ast.Load())
            return n
        return None

    n = _edit(tree, edit)
    if n:
        _add_import(tree, "from html import escape")
    return n


@_sanitizer("template_escape_argument", "CWE-79")
def _template(tree, rng):
    renders = _called({"render_template_string"}, True)

    def edit(n):
        if renders(n) and n.args and not _is_wrapped(n.args[0], "escape"):
            n.args[0] = _expr("escape(_v)", _v=n.args[0])
            return n
        return None

    n = _edit(tree, edit)
    if n:
        _add_import(tree, "from html import escape")
    return n


@_sanitizer("path_basename", "CWE-22")
def _path(tree, rng):
    def wrap(node):
        return None if _is_wrapped(node, "basename") or isinstance(node, ast.Constant) else _expr("os.path.basename(_v)", _v=node)

    def edit(n):
        if _called({"open", "send_file"}, True)(n) and n.args:
            a = n.args[0]
            if isinstance(a, ast.Call) and chain(a.func).split(".")[-1] == "join" and a.args:
                if (new := wrap(a.args[-1])) is not None:
                    a.args[-1] = new
                    return n
            elif (new := wrap(a)) is not None:
                n.args[0] = new
                return n
        elif _called({"send_from_directory"}, True)(n) and len(n.args) > 1 and (new := wrap(n.args[1])) is not None:
            n.args[1] = new
            return n
        return None

    n = _edit(tree, edit)
    if n:
        _add_import(tree, "import os")
    return n


@_sanitizer("os_system_to_run", "CWE-78")
def _os_system(tree, rng):
    n = _edit(tree, lambda n: _expr("subprocess.run(shlex.split(_v), shell=False, check=True)", _v=n.args[0]) if _called({"os.system", "os.popen"})(n) and n.args else None)
    if n:
        _add_import(tree, "import shlex")
        _add_import(tree, "import subprocess")
    return n


@_sanitizer("shell_true_to_false", "CWE-78")
def _shell_true(tree, rng):
    def edit(n):
        if _called({"run", "call", "check_output", "check_call", "Popen"}, True)(n):
            for k in n.keywords:
                if k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True:
                    k.value = ast.Constant(False)
                    if n.args and not isinstance(n.args[0], (ast.List, ast.Tuple)):
                        n.args[0] = _expr("shlex.split(_v)", _v=n.args[0])
                    return n
        return None

    n = _edit(tree, edit)
    if n:
        _add_import(tree, "import shlex")
    return n


@_sanitizer("eval_to_literal", "CWE-94")
def _eval(tree, rng):
    first = min((c for c in ast.walk(tree) if _called({"eval", "exec"})(c)), key=lambda c: (c.lineno, c.col_offset), default=None)
    if first is None:
        return 0
    first.func = _expr("ast.literal_eval")
    _add_import(tree, "import ast")
    ast.fix_missing_locations(tree)
    return 1


@_sanitizer("yaml_safe_load", "CWE-502")
def _yaml(tree, rng):
    def edit(n):
        if _called({"yaml.load", "yaml.unsafe_load", "yaml.full_load"})(n):
            n.func = _expr("yaml.safe_load")
            n.args, n.keywords = n.args[:1], [k for k in n.keywords if k.arg != "Loader"]
            return n
        return None

    return _edit(tree, edit)


@_sanitizer("pickle_to_json", "CWE-502")
def _pickle(tree, rng):
    names = {f"{m}.{f}" for m in ("pickle", "cPickle", "marshal", "dill") for f in ("load", "loads")}

    def edit(n):
        if _called(names)(n):
            n.func = _expr(f"json.{n.func.attr}")
            return n
        return None

    n = _edit(tree, edit)
    if n:
        _add_import(tree, "import json")
    return n


@_sanitizer("url_allow_list", "CWE-918")
def _allow_list(tree, rng):
    fetch, changed = _called({"get", "post", "put", "delete", "head", "patch", "request", "urlopen"}, True), 0
    for fn in [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]:
        if any(_is_wrapped(n, "urlparse") for n in ast.walk(fn)):
            continue
        for i, statement in enumerate(fn.body):
            call = next((n for n in ast.walk(statement) if fetch(n) and n.args), None)
            if call is not None:
                check = ast.parse("if urlparse(str(_url)).hostname not in ALLOWED_HOSTS:\n    raise ValueError('host is not allowed')").body[0]
                _edit(check, lambda n, url=call.args[0]: url if isinstance(n, ast.Name) and n.id == "_url" else None)
                fn.body.insert(i, check)
                changed += 1
                break
    if changed:
        at = next((i for i, s in enumerate(tree.body) if not isinstance(s, (ast.Import, ast.ImportFrom)) and not (i == 0 and _docstring(tree))), len(tree.body))
        tree.body.insert(at, ast.parse("ALLOWED_HOSTS = frozenset()").body[0])
        _add_import(tree, "from urllib.parse import urlparse")
    return changed


# application


def _attempt(source: str, transforms: list[Transform], rng: random.Random) -> tuple[str, list[str], list[str]]:
    """(text, names that applied, reasons of the others): each change that does not parse again is taken back."""
    applied, reasons, text = [], [], source
    for t in transforms:
        tree = ast.parse(text)
        place = tree if t.whole_module else first_function(tree)
        if place is None:
            reasons.append(f"{t.name}: no function")
            continue
        try:
            n = t.rewrite(place, rng)
            new = ast.unparse(ast.fix_missing_locations(tree)) if n else text
        except Exception as e:  # a plug-in may fail in any way
            reasons.append(f"{t.name}: raised {type(e).__name__}")
            continue
        if not n:
            reasons.append(f"{t.name}: not applicable")
        elif not parses(new):
            reasons.append(f"{t.name}: round trip")
        else:
            text = new
            applied.append(t.name)
    return text, applied, reasons


def mutate(source: str | None, names: list[str], seed: int, least: int = 1, most: int = 3) -> tuple[str | None, list[str], list[str]]:
    """Applies a seeded choice of least to most of the named mutators in seeded order."""
    return _mutated(source, names, seed, least, most) if parses(source) else (source, [], ["does not parse"])


def _mutated(source: str, names: list[str], seed: int, least: int, most: int) -> tuple[str, list[str], list[str]]:
    """mutate() of a text that is known to parse."""
    rng = random.Random(seed)
    pool = [MUTATORS[n] for n in names]
    if not pool:
        return source, [], []
    k = rng.randint(min(least, len(pool)), min(most, len(pool)))
    return _attempt(source, rng.sample(pool, k), rng)


def variants(source: str | None, names: list[str], seeds: list[int]) -> list[tuple[str | None, list[str], list[str]]]:
    """Named variants of one text, which is parsed once to see that it can be: the text itself for clean, two or three mutators for composed, else a single one."""
    fine = any(n != "clean" for n in names) and parses(source)

    def one(name: str, seed: int):
        if name == "clean":
            return source, [], []
        if not fine:
            return source, [], ["does not parse"]
        return _mutated(source, K.MUTATORS, seed, 2, 3) if name == "composed" else _mutated(source, [name], seed, 1, 1)

    return [one(n, s) for n, s in zip(names, seeds, strict=True)]


def variant(source: str | None, name: str, seed: int) -> tuple[str | None, list[str], list[str]]:
    return variants(source, [name], [seed])[0]


def sanitize(source: str | None, cwe: str, seed: int) -> dict:
    """A safe twin by one rule of the class, chosen by the seed among those that apply."""
    out = {"success": False, "source": source, "rule": None, "n_rewritten": 0, "reason": None}
    if not parses(source):
        return out | {"reason": "does not parse"}
    rules = SANITIZERS.get(cwe, [])
    if not rules:
        return out | {"reason": f"no rules for {cwe}"}
    rng = random.Random(seed)
    for rule in rng.sample(rules, len(rules)):
        tree = ast.parse(source)
        try:
            n = rule.rewrite(tree, rng)
            new = ast.unparse(ast.fix_missing_locations(tree)) if n else source
        except Exception as e:
            return out | {"rule": rule.name, "reason": f"raised {type(e).__name__}"}
        if n:
            if not parses(new):
                return out | {"rule": rule.name, "reason": "round trip"}
            if new.strip() == source.strip():
                return out | {"rule": rule.name, "reason": "identical"}
            return {"success": True, "source": new, "rule": rule.name, "n_rewritten": n, "reason": None}
    return out | {"reason": "no applicable rule"}


VARIANT = T.StructType().add("variant_code", T.StringType()).add("applied", T.ArrayType(T.StringType())).add("reasons", T.ArrayType(T.StringType()))
TWIN = T.StructType().add("success", T.BooleanType()).add("source", T.StringType()).add("rule", T.StringType()).add("n_rewritten", T.IntegerType()).add("reason", T.StringType())


@pandas_udf(TWIN)
def sanitize_udf(code: pd.Series, cwe: pd.Series, sample_id: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sanitize(c, w, seed_of(i, w)) for c, w, i in zip(code, cwe, sample_id, strict=True)])


#: Rows whose variants are made and sent at once.
VARIANT_ROWS = 128


def spread(rows: DataFrame) -> DataFrame:
    """Rows for dear work in Python: those that few large files hold are dealt out to all tasks first, others stay where they are."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def variant_inputs(samples: DataFrame, with_canonical: bool = False) -> DataFrame:
    """The rows that variants are made of: vulnerable test rows with code, no hard negatives and, unless asked for, no canonical ones."""
    kept = (F.col("split") == "test") & F.col("cwe").isNotNull() & (F.col("cwe") != "safe") & ~F.coalesce("is_hard_negative", F.lit(False)) & F.col("code").isNotNull()
    return samples.filter(kept if with_canonical else kept & ~F.coalesce(F.col("source") == "canonical", F.lit(False)))


def build_variants(samples: DataFrame, names: list[str] | None = None) -> DataFrame:
    """id, variant, variant_code, applied, reasons of each sample (id, code) in each variant. A text goes to Python and is checked once for all its variants."""
    names = K.VARIANTS if names is None else names

    def run(batches):
        for batch in batches:
            # some rows at a time, as each gives as many texts as there are variants
            for at in range(0, batch.num_rows, VARIANT_ROWS):
                part = batch.slice(at, VARIANT_ROWS)
                rows = [(i, n, *x) for i, code in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for n, x in zip(names, variants(code, names, [seed_of(i, n) for n in names]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "variant", "variant_code", "applied", "reasons"])

    text, texts = pa.string(), pa.list_(pa.string())
    kinds = [text, text, text, texts, texts]
    return spread(samples.select(F.col("id").cast("string").alias("id"), "code")).mapInArrow(run, "id string, variant string, variant_code string, applied array<string>, reasons array<string>")


def success_rates(variants: DataFrame) -> DataFrame:
    """variant, applied, n, rate."""
    ok = F.size("applied") > 0
    return variants.groupBy("variant").agg(F.count_if(ok).alias("n_applied"), F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("rate"))


def augment(samples: DataFrame, epoch: Column, least: int = 1, most: int = 3, holdout: tuple[str, ...] = ()) -> DataFrame:
    """Samples (id, code, is_hard_negative) with code of a training epoch; hard negatives stay, held-out mutators are never used."""
    names = [n for n in K.MUTATORS if n not in holdout]

    @pandas_udf(VARIANT)
    def run(code: pd.Series, sample_id: pd.Series, at: pd.Series, skip: pd.Series) -> pd.DataFrame:
        rows = [(c, [], ["hard negative"]) if s else mutate(c, names, seed_of(i, e), least, most) for c, i, e, s in zip(code, sample_id, at, skip, strict=True)]
        return pd.DataFrame(rows, columns=["variant_code", "applied", "reasons"])

    return samples.withColumn("x", run("code", "id", epoch, "is_hard_negative")).select("*", "x.*").drop("x")


def hard_negatives(samples: DataFrame, existing: DataFrame) -> DataFrame:
    """Safe twins of vulnerable samples (id, code, cwe, repo, cve_id) that have none in existing (parent_sample_id): rows of class safe
    that keep repository and advisory, and for the others the reason."""
    open_rows = samples.filter((F.col("cwe") != "safe") & (F.trim("code") != "")).join(existing.select(F.col("parent_sample_id").alias("id")), "id", "left_anti")
    x = spread(open_rows).withColumn("x", sanitize_udf.asNondeterministic()("code", "cwe", "id"))
    new_id = F.concat(F.lit("hardneg_"), F.col("x.rule"), F.lit("_"), code_hash(F.col("x.source")))
    return x.select(F.when(F.col("x.success"), new_id).alias("id"), F.col("id").alias("parent_sample_id"), F.lit("safe").alias("cwe"), F.col("cwe").alias("parent_cwe"), "repo", "cve_id", F.col("x.source").alias("code"), F.col("x.rule").alias("sanitization_transform"), F.col("x.success").alias("is_hard_negative"), F.col("x.reason").alias("reason"))


def twin_counters(twins: DataFrame) -> DataFrame:
    """counter, key, n of hard_negatives(): attempts, successes and failures in all, successes by class and by rule, failures by reason."""
    ok = F.col("is_hard_negative")
    one = lambda name, key, when: F.struct(F.lit(name).alias("counter"), key.alias("key"), when.alias("on"))
    every = F.array(one("attempted", F.lit("all"), F.lit(True)), one("succeeded", F.lit("all"), ok), one("failed", F.lit("all"), ~ok), one("class", F.col("parent_cwe"), ok), one("rule", F.col("sanitization_transform"), ok), one("reason", F.col("reason"), ~ok))
    return twins.select(F.explode(every).alias("x")).select("x.*").filter("on").groupBy("counter", "key").agg(F.count(F.lit(1)).alias("n"))
