"""The pipeline's stages, each held to brute force on its own input, and the
entry's guard."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from marketweave.llm import quality
from marketweave.llm.queries import QUERIES, word_vocabulary
from test_llm_operators import CLASH, SCHEMA, _brute_components, _shares, corpus, words

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage over a small corpus with odd rows and odd columns."""
    base = corpus(90, 3)
    clean = [(2000 + i, " ".join(f"w{i}x{k}" for k in range(60)) + "\nfoot of every page", "en", "a", 1) for i in range(30)]
    d = spark.createDataFrame([*base, *clean], SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASH}).repartition(3)
    out, frame = [], d
    for name, stage in P.STAGES:
        got = stage(spark, frame, "")
        rows = got.collect()
        out.append((name, frame.columns, [r.asDict() for r in frame.collect()], got.columns, [r.asDict() for r in rows]))
        frame = spark.createDataFrame(rows, got.schema)
    return out


def test_columns_pass_through(stages):
    for name, before, _, after, rows in stages[:-1]:
        assert before == after, name
        assert all(r["kept"] == "own kept" and r["_row"] == "own _row" for r in rows)


def test_quality_stage_drops_what_the_rules_reject(spark, stages):
    _, _, before, _, after = stages[0]
    d = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before], "doc_id long, text string, lang string, source string")
    want = Counter((r.doc_id, r.text) for r in quality.quality_rules(d).filter("kept").collect())
    assert Counter((r["doc_id"], r["text"]) for r in after) == want
    assert all(any(r["doc_id"] == 2000 + i for r in after) for i in range(30))


def test_line_stage_drops_lines_by_share(stages):
    _, _, before, _, after = stages[1]
    of = {}
    for r in before:
        of.setdefault(r["source"], []).append(r)
    want = Counter()
    for rows in of.values():
        n = Counter(x for r in rows for x in {line.strip(" \t\r\x0b\x0c") for line in (r["text"] or "").split("\n")} if x)
        for r in rows:
            keep = [x for x in (r["text"] or "").split("\n") if not (x.strip(" \t\r\x0b\x0c") and n[x.strip(" \t\r\x0b\x0c")] >= 3 and 100 * n[x.strip(" \t\r\x0b\x0c")] > 10 * len(rows))]
            want[r["doc_id"], "\n".join(keep)] += 1
    assert Counter((r["doc_id"], r["text"] or "") for r in after) == want
    assert not any("foot of every page" in (r["text"] or "") for r in after if r["source"] == "a")


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    _, _, before, _, after = stages[2]
    rows = list({r["doc_id"]: r["text"] for r in before}.items())
    want = {i for i, _, c, own in _brute_components(rows, 5, 80) if own}
    assert sorted(r["doc_id"] for r in after) == sorted(want)


def test_mixing_stage_meets_targets(stages):
    _, _, before, _, after = stages[3]
    sizes, taken, each = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(words(r["text"]))
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
        each[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    target = _shares(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    assert all(n <= 3 * size[i] for i, n in each.items())


def test_packing_stage_holds_every_token(stages):
    from tokenizers import Tokenizer
    _, _, before, _, after = stages[4]
    tok = Tokenizer.from_file(word_vocabulary())
    want = sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r["length"] for r in after) == want
    used = Counter()
    for r in after:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096 and len(used) <= want / 4096 * 1.1 + 2


def test_empty_table_runs_through(spark):
    d = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        d = stage(spark, d, "")
        assert d.count() == 0


def test_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{k}" for k in range(40))
    rows = [(None, t, "en", "a", 1), (None, t, "en", "a", 1), (3, t, "en", "a", 1), (3, t, "en", "a", 1), (4, t, "en", None, 1)]
    out = P.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert Counter(r.doc_id for r in out.collect()) == {None: 2, 3: 1}


def test_entry_lists_every_operator_once():
    import __spark_entry__ as E
    names = [k.split("_")[0] for k in E.queries() if k.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and len(QUERIES) == 13
    assert "pipeline" in E.queries() and 4 <= len(P.STAGES) <= 5


def test_library_works_without_these_folders(tmp_dir):
    for f in ("marketweave", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(ROOT, f)
        if os.path.isdir(src):
            shutil.copytree(src, os.path.join(tmp_dir, f), ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif f != "corpus_pipeline.py":
            shutil.copy(src, tmp_dir)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"],
                          cwd=tmp_dir, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": tmp_dir})
    assert said.stdout.split()[1:] == ["False", "True"], said.stderr


def test_a_unique_text_outlives_copies_under_its_id(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = c + " more"
    rows = [(3, a, "en", "a", 1), (5, a, "en", "a", 1), (5, b, "en", "a", 1), (5, b, "en", "b", 1), (9, c, "en", "a", 1), (9, near, "en", "a", 1),
            (9, d, "en", "a", 1), (8, d, "en", None, 1), (None, a, "en", "a", 1), (4, None, "en", "a", 1), (4, "", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_row", F.lit("own"))
    out = P.near_dedup_stage(spark, docs, "")
    got = Counter((r.doc_id, "c" if r.text in (c, near) else r.text) for r in out.collect())
    assert out.columns == docs.columns and got == {(3, a): 1, (5, b): 1, (9, "c"): 1, (8, d): 1, (None, a): 1, (4, None): 1, (4, ""): 1}
