"""Code rows derived from the documents table, at any scale: one of a few short programs for each document, with the document's whole text as docstring or comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .relations import _list, label, literal, read

#: {n} is the document's number. BROKEN does not parse, all others do.
PROGRAMS = [
    "from flask import request\n\ndef find(cur):\n    name = request.args['q{n}']\n    cur.execute(f\"SELECT * FROM t WHERE n = {name}\")\n    return cur\n",
    "def find(cur, part):\n    query = \"SELECT a FROM t{n} WHERE b = \" + part\n    rows = cur.execute(query)\n    first = rows[0]\n    return first\n",
    "def show(x):\n    y = mark_safe(x)\n    z = [y, {n}]\n    w = z[0]\n    return w\n",
    "import os\n\ndef go(request):\n    # CVE-2021-1000{n}\n    os.system(request.form['c'])\n    done = {n}\n    return done\n",
    "def load(request):\n    size = {n}\n    with open(request.args['p']) as f:\n        data = f.read(size)\n        return data\n",
    "def load(name):\n    with open(name) as f:\n        return f.read()\n" + "".join(f"step{i} = {i}\n" for i in range(24)) + "def late(request):\n    return request.args['p{n}']\n",
    "import pickle\n\ndef load(raw):\n    data = pickle.loads(raw)\n    data['n'] = {n}\n    return data\n",
    "import requests\n\ndef go(target_url):\n    payload = dict(a={n})\n    requests.post(target_url, payload)\n    return payload\n",
    "def total(xs):\n    out = {n}\n    for x in xs:\n        out += x\n    return out\n",
    "'''eval(x) is only named here, see cve-2019-12345'''\nx = {n}\n\n\n\n",
    "def calc(request):\n    x = request.json['e']\n    y = eval(x)\n    z = y + {n}\n    return z\n",
    "import yaml\n\ndef read(request):\n    data = yaml.load(request.data)\n    data['n'] = {n}\n    return data\n",
    "def run(cur, q):\n    a = {n}\n    cur.execute(q)  # nosec\n    b = a\n    return b\n",
    "def broken(:\n    a = {n}\n    b = 2\n    c = eval(a)\n    return c\n",
    "\n  \n",
]
BROKEN = 13
PATHS = ["src/app/main.py", "tests/unit/main.py", "src/test_main.py", "lib/conftest.py", "docs/build.py", "latest/contest.py", "app/view.py"]


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc_id, shape (number of the program), cwe, source, path, is_hard_negative, cve_id, code, code_after."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    shape = i % len(PROGRAMS)
    program = F.replace(F.element_at(F.array(*map(F.lit, PROGRAMS)), (shape + 1).cast("int")), F.lit("{n}"), i.cast("string"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\\r]', " ")
    mode = F.floor(i / len(PROGRAMS)) % 3
    code = F.when(mode == 0, F.concat(F.lit('"""'), text, F.lit('"""\n'), program)).when(mode == 1, F.concat(program, F.lit("# "), F.regexp_replace(text, "\n", "\n# "), F.lit("\n"))).otherwise(program)
    rows = d.select(
        F.concat(F.lit("doc_"), i.cast("string")).alias("id"),
        "doc_id",
        shape.alias("shape"),
        label(i % 8).alias("cwe"),
        F.when(i % 6 == 0, "vudenc").when(i % 7 == 0, "canonical").otherwise(F.col("source")).alias("source"),
        F.element_at(F.array(*map(F.lit, PATHS)), (i % len(PATHS) + 1).cast("int")).alias("path"),
        (i % 11 == 0).alias("is_hard_negative"),
        F.when(i % 4 != 0, F.concat(F.lit("CVE-2000-"), i.cast("string"))).alias("cve_id"),
        code.alias("code"),
    )
    after = F.when(i % 4 == 0, None).when(i % 4 == 1, F.replace("code", F.lit("    "), F.lit("\t"))).when(i % 4 == 2, F.replace("code", F.lit("("), F.lit("( "))).otherwise("pass\n")
    return rows.withColumn("code_after", after)


SNIPPETS_SQL = f"""v_raw_code AS (
  SELECT *, doc_id % {len(PROGRAMS)} AS shape, (doc_id // {len(PROGRAMS)}) % 3 AS mode,
    replace(([{", ".join(map(literal, PROGRAMS))}])[(doc_id % {len(PROGRAMS)} + 1)::INT], '{{n}}', doc_id::VARCHAR) AS program,
    regexp_replace(coalesce(text, ''), '["\\\\\\r]', ' ', 'g') AS t FROM documents),
v_code AS (
  SELECT 'doc_' || doc_id AS id, doc_id, shape, ({_list(K.LABELS)})[(doc_id % 8 + 1)::INT] AS cwe,
    CASE WHEN doc_id % 6 = 0 THEN 'vudenc' WHEN doc_id % 7 = 0 THEN 'canonical' ELSE source END AS source,
    ({_list(PATHS)})[(doc_id % {len(PATHS)} + 1)::INT] AS path, doc_id % 11 = 0 AS is_hard_negative,
    CASE WHEN doc_id % 4 <> 0 THEN 'CVE-2000-' || doc_id END AS cve_id,
    CASE mode WHEN 0 THEN '\"\"\"' || t || '\"\"\"' || chr(10) || program WHEN 1 THEN program || '# ' || replace(t, chr(10), chr(10) || '# ') || chr(10) ELSE program END AS code
  FROM v_raw_code),
v_snippets AS (
  SELECT *, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN replace(code, '    ', chr(9)) WHEN 2 THEN replace(code, '(', '( ') ELSE 'pass' || chr(10) END AS code_after FROM v_code)"""
