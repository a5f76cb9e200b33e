"""Physical-plan assertions: the scale properties the design relies on."""
from petrel.plans import catalog as Q

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_outside_the_two_python_stages(spark):
    for name in ["vocab_index", "enc_pad_pre", "model_nb_counts", "ens_weighted", "stat_histogram"]:
        p = plan(Q.QUERIES[name](spark, SF))
        assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p and "MapInPandas" not in p, name


def test_no_single_partition_exchange_over_corpus(spark):
    """The only single-partition exchanges allowed are the one over the table of
    per-partition row counts used for dense numbering (one row per partition)
    and the ones over the capped head of the vocabulary."""
    for name in ["enc_sequences", "vocab_counts", "tok_minlen", "model_nb_counts", "vocab_index"]:
        lines = plan(Q.QUERIES[name](spark, SF)).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "keys=[_pid" in lines[i + 1] or "TakeOrderedAndProject" in lines[i + 1], (name, lines[i:i + 3])


def test_point_lookup_pushed_to_scan(spark):
    df = Q.sec_point_lookup(spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,42)" in p


def test_topk_per_code_is_limited_before_shuffle(spark):
    s = Q.bars_latest_per_code(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in s


def test_capped_vocab_is_a_top_k(spark):
    """No sort of the whole vocabulary where a cap is known, and no forced broadcast."""
    p = plan(Q.enc_sequences(spark, SF))
    assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p
