"""Randomised properties against brute force on small inputs (hypothesis)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sigframe.operators import epochs as E
from sigframe.operators import intervals as IV
from sigframe.operators.ordering import ordered_index

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

ann_rows = st.lists(st.tuples(st.sampled_from(["A", "B"]), st.integers(0, 300), st.integers(0, 130)),
                    min_size=1, max_size=12)
sample_ts = st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(0, 4500)), min_size=1, max_size=60)


@SETTINGS
@given(ann_rows, sample_ts)
def test_interval_join_is_brute_force(spark, anns, samples):
    ann = spark.createDataFrame([(p, float(o), float(d), f"s{i}") for i, (p, o, d) in enumerate(anns)],
                                "patient string, onset double, duration double, description string")
    sm = spark.createDataFrame([(p, t / 10.0) for p, t in samples], "patient string, t double")
    got = sorted((r["patient"], r["t"], r["condition"]) for r in IV.label_samples_by_chunks(sm, ann).collect())
    want = []
    for i, (p, o, d) in enumerate(anns):
        for k in range(int(d // 30)):
            lo = o + 30.0 * k
            want += [(sp, t / 10.0, f"s{i}") for sp, t in samples if sp == p and lo <= t / 10.0 < lo + 30.0]
    assert got == sorted(want)


keyed = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "x", "y"]), st.integers(-50, 50)),
                 min_size=1, max_size=80)


@SETTINGS
@given(keyed, st.booleans(), st.sampled_from([3, 10, 1000]))
def test_ordered_index_is_sorted_position(spark, rows, desc, per_bucket):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v int, id int")
    got = {r["id"]: r["i"] for r in ordered_index(df, ["k"], ["v", "id"], out="i", descending=desc,
                                                   rows_per_bucket=per_bucket).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        ids = sorted(((v, i) for i, (k, v) in enumerate(rows) if k == key), reverse=desc)
        want.update({i: pos for pos, (_, i) in enumerate(ids)})
    assert got == want


epoch_rows = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(0, 4)), min_size=1, max_size=50,
                      unique_by=lambda r: (r[0], r[1]))


@SETTINGS
@given(epoch_rows)
def test_epoch_assembly_is_brute_force(spark, rows):
    n = 8
    df = spark.createDataFrame([(f"R{r}", t // n, float(t), float(t * 2), float(-t), float(t % 3), lab)
                                for r, t, lab in rows],
                               "patient string, epoch bigint, time float, fpzcz float, pzoz float, "
                               "horizontal float, label int").repartition(4)
    got = {(r["patient"], r["epoch"]): (r["fpzcz"], r["label_mean"], r["label_first"], r["n_samples"])
           for r in E.assemble_epochs(df, n=n).collect()}
    want = {}
    for key in {(f"R{r}", t // n) for r, t, _ in rows}:
        members = sorted((t, lab) for r, t, lab in rows if (f"R{r}", t // n) == key)
        labels = [lab for _, lab in members]
        want[key] = ([float(t * 2) for t, _ in members], int(sum(labels) / len(labels)), labels[0], len(members))
    assert got == want


tied = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "x"]), st.integers(0, 2),
                          st.one_of(st.none(), st.integers(0, 4))), min_size=1, max_size=120)


@SETTINGS
@given(tied, st.booleans())
def test_ordered_index_with_heavy_ties(spark, rows, desc):
    df = spark.createDataFrame([(k, v, w, i) for i, (k, v, w) in enumerate(rows)],
                               "k string, v int, w int, id int")
    got = {r["id"]: r["i"] for r in ordered_index(df, ["k"], ["v", "w", "id"], out="i", descending=desc,
                                                   rows_per_bucket=4).collect()}

    def sort_key(r):
        i, (k, v, w) = r
        # NULLs first ascending, last descending, as Spark orders them
        wk = (0, 0) if w is None else (1, w)
        return (v, wk, i)

    want = {}
    for key in {k for k, _, _ in rows}:
        members = sorted(((i, (k, v, w)) for i, (k, v, w) in enumerate(rows) if k == key), key=sort_key,
                         reverse=desc)
        want.update({i: pos for pos, (i, _) in enumerate(members)})
    assert got == want
