import ast
import random

import pytest

from quarry.functions import syntax
from quarry.operators import transforms as T
from quarry.functions import constants as K

CODE = [
    'def find(cur, name):\n    """Docs stay."""\n    query = f"SELECT * FROM users WHERE n = \'{name}\'"\n    cur.execute(query)\n    return cur.fetchall()\n',
    "import os\n\nasync def run(cmd):\n    result = await shell(cmd)\n    if result:\n        os.system(cmd)\n    return 'finished now'\n",
    "class A:\n    def m(self, x):\n        total = 0\n        for i in range(x):\n            for j in range(i):\n                total += j\n        try:\n            value = eval(str(total))\n        except ValueError as error:\n            value = None\n        return value\n",
    "import pickle, yaml\n\ndef load(raw):\n    a = pickle.loads(raw)\n    b = yaml.load(raw, Loader=yaml.Loader)\n    return a, b\n",
    "import requests\n\ndef fetch(url):\n    return requests.get(url).text\n",
]


@pytest.mark.parametrize("seed", [0, 1, 42, 999])
@pytest.mark.parametrize("name", K.MUTATORS)
def test_mutators_keep_code_valid_and_seeded(name, seed):
    changed = 0
    for code in CODE:
        out, applied, _ = T.variant(code, name, seed)
        assert (out, applied) == T.variant(code, name, seed)[:2]
        ast.parse(out)
        assert (out == code) == (not applied)
        changed += bool(applied)
        if applied and "Docs stay" in code:
            assert ast.get_docstring(ast.parse(out).body[0]) == "Docs stay."
    assert changed >= 1


def test_renaming_and_splitting_keep_results():
    code = 'def f(n):\n    total, label = 0, "some long text here"\n    for i in range(n):\n        total += i * i\n    return label + str(total)\n'
    for name in ("variable_rename", "string_split", "dead_code_injection", "wrapper_extraction"):
        for seed in range(20):
            out, applied, _ = T.variant(code, name, seed)
            scope = {}
            exec(compile(out, "x", "exec"), scope)
            assert applied and scope["f"](9) == "some long text here204", (name, seed, out)


def test_sink_forms_still_call_the_sink():
    code = "def g(x):\n    return eval(x)\n"
    for name in ("sink_via_globals", "taint_through_dict"):
        out, applied, _ = T.variant(code, name, 1)
        scope = {}
        exec(compile(out, "x", "exec"), scope)
        assert applied and scope["g"]("1 + 2") == 3


def test_composed_and_bad_input():
    out, applied, reasons = T.variant(CODE[2], "composed", 5)
    assert 1 <= len(applied) + len(reasons) <= 3 and ast.parse(out)
    assert T.variant("def (", "string_split", 1) == ("def (", [], ["does not parse"])
    assert T.mutate("x = 1\n", ["string_split"], 1)[2] == ["string_split: no function"]


def test_a_failing_plugin_is_taken_back():
    def broken(fn, rng):
        raise RuntimeError

    def wrong(fn, rng):
        fn.body = []
        return 1

    names = ["broken_test", "wrong_test"]
    try:
        for n, f in zip(names, (broken, wrong), strict=True):
            T.register(T.Transform(n, f))
        with pytest.raises(ValueError):
            T.register(T.Transform("broken_test", broken))
        out, applied, reasons = T.mutate(CODE[0], names, 1, 2, 2)
        assert out == CODE[0] and not applied and len(reasons) == 2
    finally:
        for n in names:
            T.MUTATORS.pop(n, None)


@pytest.mark.parametrize(
    ("cwe", "code", "part"),
    [
        ("CWE-89", "cur.execute(f\"SELECT a FROM t WHERE b = '{x}'\")", "cur.execute('SELECT a FROM t WHERE b = ?', (x,))"),
        ("CWE-89", "cur.execute('SELECT %s' % x)", "cur.execute('SELECT %s', (x,))"),
        ("CWE-79", "y = Markup(x)", "y = escape(x)"),
        ("CWE-79", "render_template_string(x, a=1)", "render_template_string(escape(x), a=1)"),
        ("CWE-22", "open(os.path.join(d, x))", "open(os.path.join(d, os.path.basename(x)))"),
        ("CWE-22", "send_from_directory(d, x)", "send_from_directory(d, os.path.basename(x))"),
        ("CWE-78", "os.system(x)", "subprocess.run(shlex.split(x), shell=False, check=True)"),
        ("CWE-78", "subprocess.run(x, shell=True)", "subprocess.run(shlex.split(x), shell=False)"),
        ("CWE-94", "a = eval(x) + eval(y)", "a = ast.literal_eval(x) + eval(y)"),
        ("CWE-502", "yaml.load(x, Loader=L)", "yaml.safe_load(x)"),
        ("CWE-502", "pickle.loads(x)", "json.loads(x)"),
        ("CWE-918", "def f(u):\n    requests.get(u)", "if urlparse(str(u)).hostname not in ALLOWED_HOSTS:"),
    ],
)
def test_safe_twins(cwe, code, part):
    out = T.sanitize(code, cwe, 3)
    assert out["success"] and part in out["source"] and out["n_rewritten"] >= 1
    ast.parse(out["source"])


def test_twins_that_cannot_be():
    assert T.sanitize("x = 1", "CWE-89", 1)["reason"] == "no applicable rule"
    assert T.sanitize("def (", "CWE-89", 1)["reason"] == "does not parse"
    assert T.sanitize("x = 1", "CWE-1", 1)["reason"] == "no rules for CWE-1"
    assert set(T.SANITIZERS) == set(K.TARGETS) and sum(map(len, T.SANITIZERS.values())) == 11


def test_hard_negatives_only_for_open_parents(spark):
    rows = [("a", "cur.execute('%s' % x)", "CWE-89", "r", "CVE-1"), ("b", "os.system(x)", "CWE-78", "r", None), ("c", "x = 1", "safe", None, None)]
    out = T.hard_negatives(spark.createDataFrame(rows, "id string, code string, cwe string, repo string, cve_id string"), spark.createDataFrame([("b",)], "parent_sample_id string")).collect()
    assert [(r["parent_sample_id"], r["cwe"], r["parent_cwe"], r["is_hard_negative"]) for r in out] == [("a", "safe", "CWE-89", True)]


def test_comments_are_blanked_in_place():
    code = 'a = "#no"  # yes\n"""doc # x\ny"""\nb = \'it\\\'s # no\'\n'
    out = syntax.strip_comments(code)
    assert len(out) == len(code) and out.count("\n") == code.count("\n") and '"#no"' in out and "yes" not in out and "doc" not in out and "# no" in out


def test_gate_needs_request_near():
    far = "def f(p):\n" + "    x = 1\n" * 40 + "    open(p)\n"
    assert syntax.gate(far, "CWE-22", None) == (False, None)
    assert syntax.gate("p = request.args['p']\n" + "x = 1\n" * 19 + "open(p)\n", "CWE-22", None)[0]
    assert not syntax.gate("p = request.args['p']\n" + "x = 1\n" * 20 + "open(p)\n", "CWE-22", None)[0]
    assert syntax.gate("y = pickle.loads(x)  # nosec", "CWE-502", None) == (False, None)
    assert syntax.gate("# pickle.loads(x)", "CWE-502", None) == (False, None)
    assert syntax.gate("anything", "safe", None) == (True, None)
    assert not syntax.gate("x = eval(y)", "CWE-94", None, frozenset(["CWE-94"]))[0]
    assert syntax.gate("password = 1\nx = eval(y)", "CWE-94", None, frozenset(["CWE-94"]))[0]


def test_differences_and_redaction():
    assert syntax.changed_lines("a\nb\n", "a\nc\n") == [{"op": "removed", "text": "b"}, {"op": "added", "text": "c"}]
    assert "os.environ['API_KEY']" in syntax.redact("api_key = 'abcdefgh1234'\n")
    assert random.Random(T.seed_of("a", 1)).random() == random.Random(T.seed_of("a", 1)).random()


def test_formatted_strings_are_split_and_mean_the_same():
    code = "def f(x, y):\n    a = f'SELECT * FROM t WHERE n = {x!r:>8} AND m = {y}'\n    return a + f'{x:{y}}' + f'ab{x}'\n"
    want = {}
    exec(code, want)
    seen = set()
    for seed in range(6):
        out, applied, _ = T.mutate(code, ["string_split"], seed)
        got = {}
        exec(out, got)
        assert applied == ["string_split"] and got["f"](7, 3) == want["f"](7, 3) and "SELECT * FROM t WHERE n = " not in out
        seen.add(out)
    assert len(seen) > 1


def test_renamed_variables_get_other_words():
    code = "def f(a):\n    query = a + 1\n    zz = query * 2\n    statement = zz\n    return query + zz + statement\n"
    names = set()
    for seed in range(12):
        out, applied, _ = T.mutate(code, ["variable_rename"], seed)
        got = {}
        exec(out, got)
        assert got["f"](5) == 30
        names |= {n.id for n in ast.walk(ast.parse(out)) if isinstance(n, ast.Name)}
    assert names & {"sql_text"} and any(n.startswith("var_") for n in names)


def test_all_listed_sinks_are_hidden():
    from quarry.functions import constants as K

    hidden = lambda code, name: T.variant(code, name, 1)[0]
    for module, names in K.HIDDEN_CALLS.items():
        for n in names:
            code = f"def f(x):\n    {module}.{n}(x)\n"
            assert hidden(code, "sink_attr_obfuscate") == f"def f(x):\n    getattr({module}, '{n}')(x)"
            assert "x}['k']" in hidden(code, "taint_through_dict")
    for n in K.HIDDEN_METHODS:
        assert hidden(f"def f(x):\n    a.b().{n}(x)\n", "sink_attr_obfuscate") == f"def f(x):\n    getattr(a.b(), '{n}')(x)"
    for n in K.HIDDEN_BUILTINS:
        code = f"def f(x):\n    {n}(x)\n"
        assert hidden(code, "sink_via_globals") == f"def f(x):\n    __import__('builtins').__dict__['{n}'](x)"
        assert hidden(code, "sink_attr_obfuscate") == code
    for code in ("def f(x):\n    open(x)\n", "def f(x):\n    a.requests.get(x)\n", "def f(x):\n    os.path(x)\n"):
        assert hidden(code, "sink_via_globals") == hidden(code, "sink_attr_obfuscate") == hidden(code, "taint_through_dict") == code
    scope = {}
    exec(hidden("def f(x):\n    return __import__(x)\n", "sink_via_globals"), scope)
    assert scope["f"]("math").pi > 3


def test_variants_of_a_frame_equal_those_of_a_row(spark):
    from quarry.functions import constants as K

    rows = [(f"s{i}", CODE[i % len(CODE)] if i % 7 else None) for i in range(300)] + [("bad", "def (")]
    got = T.build_variants(spark.createDataFrame(rows, "id string, code string")).collect()
    assert len(got) == len(rows) * len(K.VARIANTS)
    code = dict(rows)
    for r in got:
        assert (r["variant_code"], r["applied"], r["reasons"]) == T.variant(code[r["id"]], r["variant"], T.seed_of(r["id"], r["variant"]))
    assert T.build_variants(spark.createDataFrame([], "id string, code string")).collect() == []


def test_variants_are_made_of_vulnerable_test_rows(spark):
    rows = [("a", "CWE-89", "test", "s", False, "x"), ("b", "safe", "test", "s", False, "x"), ("c", None, "test", "s", False, "x"), ("d", "CWE-89", "train", "s", False, "x"), ("e", "CWE-89", "test", "s", True, "x"), ("f", "CWE-89", "test", "canonical", None, "x"), ("g", "CWE-89", "test", None, None, "x"), ("h", "CWE-89", "test", "s", False, None)]
    df = spark.createDataFrame(rows, "id string, cwe string, split string, source string, is_hard_negative boolean, code string")
    assert sorted(r["id"] for r in T.variant_inputs(df).collect()) == ["a", "g"]
    assert sorted(r["id"] for r in T.variant_inputs(df, True).collect()) == ["a", "f", "g"]


def test_routes_are_calls_of_route_alone():
    code = "@app.route('/a')\n@login\ndef a(): pass\n@route('/b')\nasync def b(): pass\n@app.get('/c')\ndef c(): pass\n@app.route\ndef d(): pass\n@x(app.route('/e'))\ndef e(): pass\n"
    assert [r.split("\n")[0] for r in syntax.routes(code)] == ["@app.route('/a')", "@route('/b')", "@x(app.route('/e'))"]
    assert syntax.routes("def (") == []


def test_imports_and_where_new_ones_go():
    code = "import os.path as p, sys\nfrom a.b import c as d, e\nfrom . import f\nfrom ..g import h\ndef x():\n    import z\n"
    assert [(i["module"], i["name"], i["alias"]) for i in syntax.imports(code)] == [("os.path", None, "p"), ("sys", None, None), ("a.b", "c", "d"), ("a.b", "e", None), (".", "f", None), ("..g", "h", None)]
    assert syntax.imports("def (") == [] == syntax.imports(None)
    assert syntax.insert_import("x = 1\n", "json") == "import json\nx = 1\n"
    head = "'''doc\nmore'''\nfrom __future__ import annotations\n"
    assert syntax.insert_import(head + "x = 1", "json", "loads") == head + "from json import loads\nx = 1"
    assert syntax.insert_import("'''doc'''", "json") == "'''doc'''\nimport json\n"
    for have in ("import json\n", "from json import loads\n", "import json as j\n"):
        assert syntax.insert_import(have, "json") == have
    assert syntax.insert_import("from json import loads\n", "json", "dumps").startswith("from json import dumps\n")
    assert syntax.insert_import("def (", "json") == "def ("


def test_imports_and_calls_as_columns(spark):
    from pyspark.sql import functions as F

    from quarry.functions import text as X

    rows = [("import os as o\nimport yaml\nfrom flask import request\n",), ("x = (",), (None,), ("",)]
    x = F.col("x")
    got = spark.createDataFrame(rows, "code string").select(syntax.imports_udf("code").alias("x")).select(X.has_import(x, "os"), X.has_import(x, "os", "o"), X.has_import(x, "os", "os"), X.has_import(x, "yaml", "yaml"), X.has_import(x, "flask"), X.has_from_import(x, "flask", "request"), X.has_from_import(x, "yaml", "load")).collect()
    assert [tuple(r) for r in got] == [(True, True, False, True, True, True, False)] + [(False,) * 7] * 3
    calls = spark.createDataFrame([("pickle.loads",), ("a.pickle.loads",), ("loads",), ("",), (None,)], "c string")
    assert [r[0] for r in calls.select(X.call_matches(F.col("c"), "pickle.loads")).collect()] == [True, False, False, False, False]
    assert [r[0] for r in calls.select(X.call_matches(F.col("c"), "loads")).collect()] == [True, True, True, False, False]


def test_reports_name_classes_in_tags_and_lists(spark):
    from pyspark.sql import functions as F

    from quarry.operators import detectors

    report = '{"runs":[{"tool":{"driver":{"rules":[{"id":"a","properties":{"cwe":["CWE-78","CWE-77","x"]}},{"id":"b","properties":{"tags":["external/cwe/cwe-089"]}},{"id":"c","properties":{"cwe":["CWE-22"]}}]}},"results":[{"ruleId":"a"},{"ruleId":"b"}]}]}'
    got = spark.createDataFrame([(report,)], "r string").select(F.array_sort(F.array_distinct(detectors.sarif_report(F.col("r")))).alias("c")).first()["c"]
    assert got == ["CWE-78", "CWE-89"]
