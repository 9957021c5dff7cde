import os
import shutil
import subprocess
import sys

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.check import compare, duck

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 200
    assert df.columns[0] == "doc_id"


def test_registry_consistent():
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 80


def test_imports_without_the_training_data_operators(tmp_path):
    """The registry works when their folder and the pipeline are gone."""
    for name in ("__spark_entry__.py", "textprofile"):
        src, dst = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(src):
            shutil.copytree(src, dst, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, dst)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    n, ops, ok = said.stdout.split()
    assert int(n) >= 80 and ops == "0" and ok == "True", said.stderr


ORACLE_SAMPLE = ["clean_text", "lexicon_emotion", "recent_posts", "readability_grades", "vocab_build",
                 "stratified_folds", "kfold_shuffled", "zscore_features", "pool_windows", "embed_hashing",
                 "src_arff", "feature_join", "importance_topk", "chunk_mean_by_counts"]


def test_oracle_sample_small(spark):
    con = duck(SF_SMALL)
    qs, ors = E.queries(), E.oracle_sql()
    bad = []
    for n in ORACLE_SAMPLE:
        res = compare(spark, n, qs[n], ors[n], SF_SMALL, con)
        if res["status"] != "ok":
            bad.append(res)
    assert not bad, bad
