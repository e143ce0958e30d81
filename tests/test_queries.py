"""Every query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from turnloom.plans import queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"smile_sentiment_lmm", "synchrony_lmm", "permutation_test"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return a == b


def key(row):
    return [f"{x:.6f}" if isinstance(x, float) else str(x) for x in row]


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DIR)
    want = duck.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)
    b = sorted(want.fetchall(), key=key)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - SLOW))
def test_has_rows(spark, name):
    assert plans.QUERIES[name](spark, DIR).count() > 0


def test_result_tables(spark):
    from turnloom.plans import analyses

    smile = plans.QUERIES["smile_sentiment_lmm"](spark, DIR)
    assert smile.columns == list(analyses.SMILE_RESULT) and len(smile.columns) == 43
    for r in smile.collect():
        assert r.q_source == "lr" and r.perm_n_valid == 0 and r.n_turns == r.n_turns_positive + r.n_turns_neutral + r.n_turns_negative
        assert r.method == "not_fittable" or (0 <= r.lr_pval <= r.q_value_fdr <= 1 and 0 < r.resid_shapiro_w <= 1 and r.sigma2_resid > 0)
    sync = plans.QUERIES["synchrony_lmm"](spark, DIR)
    assert sync.columns == list(analyses.SYNC_RESULT) and len(sync.columns) == 50
    rows = sync.collect()
    assert [r.transform for r in rows] == ["identity", "binary", "fisherz"]
    for r in rows:
        if r.estimate is not None and r.se:
            assert math.isclose(r.z, r.estimate / r.se) and 0 <= r.p_lrt <= 1 and 0 <= r.p_wald <= 1 and r.lrt_stat >= 0
            assert r.lrt_stat < 3 * r.z**2 + 3 and r.n_obs == r.n_positive + r.n_negative
            assert r.odds_ratio is None if r.transform == "fisherz" else math.isclose(r.odds_ratio, math.exp(r.estimate))


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_permutation_p(spark):
    r = plans.QUERIES["permutation_test"](spark, DIR).first()
    assert r.perm_n_valid <= 3000 and (r.perm_p is None or 1 / (r.perm_n_valid + 1) <= r.perm_p <= 1)


def test_no_copy_of_the_rows_is_left_behind(spark):
    """Everything but the training-data part imports and names its queries where that part is missing."""
    import subprocess
    import sys
    import tempfile
    from pathlib import Path
    from shutil import copytree, ignore_patterns

    root = Path(entry.__file__).parent
    with tempfile.TemporaryDirectory() as folder:
        copytree(root, f"{folder}/r", ignore=ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.md"))
        code = "import __spark_entry__ as e; q = e.queries(); assert 'turn_rows' in q and not any(k.startswith('op') and '_' in k and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
        assert subprocess.run([sys.executable, "-c", code], cwd=f"{folder}/r", env={"PATH": os.environ["PATH"]}, check=False).returncode == 0
