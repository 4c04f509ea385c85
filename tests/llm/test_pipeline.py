"""The pipeline's stages against brute force, each on its own input."""

import random
import re

import pytest

import corpus_pipeline as P
from quarry.llm import queries
from test_decontaminate import brute as leaks
from test_jaccard import brute as groups
from test_suffix_dedup import brute_words as repeats

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of clean documents with planted junk, copies, near copies, repeated passages and benchmark windows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9)))
    words = [word() for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    clean = [prose(rng.randrange(40, 160)) for _ in range(120)]
    passage, leak = prose(90), prose(25)
    short = " ".join(rng.choice([w for w in words if len(w) < 6]) for _ in range(55))
    line = prose(14)
    rows, marks = [], []
    for i, t in enumerate(clean):
        rows.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", "src2"])))
        marks.append((i, 1, 0))
    for i in range(60):
        rows.append((200 + i, " | ".join(w.upper() + "!!" for w in prose(40).split()), "en", "src0"))
        marks.append((200 + i, 0, 0))
    near = clean[3].split()
    near[7] = "changed"
    rows += [(300, clean[0], "en", "src1"), (301, " ".join(near), "en", "src1"), (302, prose(60) + "\n" + passage, "fr", "src2"), (303, passage + " " + prose(50), "fr", "src2"), (304, prose(30) + " " + leak + " " + prose(30), "en", "src3"), (305, clean[5], None, None), (305, clean[5], None, None)]
    rows += [(306, f"{prose(70)} {short} {prose(30)}", "en", "src1"), (307, f"{short}\n{prose(80)}", "en", "src2"), (308, f"{line}\n{prose(80)}", "en", "src2"), (309, f"{prose(60)}\n{line}", "en", "src2"), (310, clean[9], "en", "src2"), (310, prose(90), "en", "src2")]
    assert len(short.encode()) < 400
    sf = str(tmp_path_factory.mktemp("tables"))
    full = [(i, t, a, b, len(t)) for i, t, a, b in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak.upper()), (2, prose(15)), (3, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


@pytest.fixture(scope="module")
def steps(spark, folder):
    """Rows before each stage and after the last."""
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in P.STAGES:
        df = stage(spark, out[-1], folder)
        out.append(spark.createDataFrame(df.collect(), df.schema))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_return_the_columns_of_documents(steps):
    assert [n for n, _ in P.STAGES] == ["quality_filter", "near_duplicate_filter", "repeated_string_filter", "decontamination_filter", "source_mix"] and P.ORACLE_SQL is None
    assert all(s.columns == COLUMNS and s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_quality_keeps_clean_documents(steps):
    kept = {r["doc_id"] for r in rows(steps[1])}
    assert {i for i in kept if 200 <= i < 260} == set() and len({i for i in kept if i < 120}) == 120 and {302, 303, 304} <= kept


def test_one_of_each_near_duplicate_group_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    single = [r for r in before if r["doc_id"] != 310]
    assert sorted(r["doc_id"] for r in after if r["doc_id"] != 310) == sorted({c for _, _, c in groups(single, 5, 80)})
    kept = {r["doc_id"] for r in after}
    assert {0, 3, 5} <= kept and not {300, 301, 305} & kept


def test_rows_that_repeat_an_id_are_judged_by_their_texts(steps):
    before, after = ([r["text"] for r in rows(s) if r["doc_id"] == 310] for s in steps[1:3])
    assert len(before) == 2 and len(after) == 1 and after[0] not in {r["text"] for r in rows(steps[1]) if r["doc_id"] == 9}


def test_repeated_passages_go(steps):
    before, after = rows(steps[2]), {r["doc_id"]: r for r in rows(steps[3])}
    for r, text in zip(before, repeats([r["text"] for r in before], 50), strict=True):
        if text != r["text"] and not text.strip():
            assert r["doc_id"] not in after
        else:
            assert after[r["doc_id"]]["text"] == text and after[r["doc_id"]]["n_chars"] == len(text)
    whole = {r["doc_id"]: r["text"] for r in before}
    assert len(after[302]["text"]) < 450 and len(after[306]["text"]) < len(whole[306]) - 200 and len(after[307]["text"]) < len(whole[307]) - 200
    assert all(after[i]["text"] == whole[i] for i in (7, 308, 309))


def test_documents_with_test_windows_go(spark, steps, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = rows(steps[3])
    hit = {r["doc_id"] for r, w in zip(before, leaks([r["text"] for r in before], items, 10), strict=True) if w[1]}
    assert hit == {304} and {r["doc_id"] for r in rows(steps[4])} == {r["doc_id"] for r in before} - hit


def test_mix_takes_half_of_the_tokens(steps):
    total = sum(len(re.findall(r"\S+", r["text"])) for r in rows(steps[4]))
    out = rows(steps[5])
    assert abs(sum(r["used_tokens"] for r in out) - total / 2) <= 15 and all(r["text"] for r in out)


def test_run_chains_the_stages(spark, folder, steps):
    assert sorted(map(str, rows(P.run(spark, folder)))) == sorted(map(str, rows(steps[5])))


def test_stages_on_odd_tables(spark, docs, empty, tmp_path):
    for name, ddl in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    for start, least in ((docs, 30), (empty, 0)):
        df = start
        for name, stage in P.STAGES[1:]:
            out = stage(spark, df, str(tmp_path))
            df = spark.createDataFrame(out.collect(), out.schema)
            assert set(start.columns) <= set(df.columns), name
        assert df.count() >= least


def test_queries_equal_their_sql(spark):
    import duckdb
    from test_queries import TABLES, rows as plain

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert set(queries.oracle_sql()) <= set(queries.queries())
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        got = plain(df.columns, df.collect())
        want = con.execute(sql)
        assert got == plain([c[0] for c in want.description], want.fetchall()), name


def test_native_operators_have_no_python_in_their_plans(spark):
    for name in ("op3_source_mixing", "op7_chat_formatting"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
