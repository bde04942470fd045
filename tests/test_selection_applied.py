"""The drop list applied to train and test, and checks of what was stored."""

from panelscope.operators import selection as S

KEYS = ("client_id", "date_target", "target")


def tables(spark):
    rows = [(str(i), 1 + i % 2, float(i), 0.0, float(i % 3), float(i), None if i < 5 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "client_id string, date_target int, target double, zeros double, a double, "
                                     "twin double, sparse double")
    return df.filter("date_target = 1"), df.filter("date_target = 2")


def found(df):
    return {r["check_name"]: r["n_violations"] for r in df.collect()}


def stored(spark, tmp_path):
    train, test = tables(spark)
    features = ["zeros", "a", "twin", "sparse"]
    decisions = S.selection_decisions(S.column_profile(train, features, features), ["twin"], [], ["sparse"])
    return S.store_selection(train, test, decisions, str(tmp_path / "selection"))


def test_stored_tables_lack_what_was_removed(spark, tmp_path):
    train, test = stored(spark, tmp_path)
    assert train.columns == test.columns == ["client_id", "date_target", "target", "a", "sparse"]
    assert train.count() == test.count() == 100
    got = {(r["split"], r["column_name"]): (r["position"], r["n_rows"], r["n_known"])
           for r in S.stored_columns(train, test).collect()}
    assert got["train", "sparse"] == (5, 100, 97) and got["test", "sparse"] == (5, 100, 98) and len(got) == 10
    assert S.drop_list(spark.read.parquet(str(tmp_path / "selection" / "decisions"))) == ["twin", "zeros"]


def test_broken_tables_are_found_out(spark, tmp_path):
    train, test = stored(spark, tmp_path)
    check = lambda a, b: found(S.validate_selection(a, b, ["zeros", "a", "twin", "sparse"], ["twin"], KEYS))
    assert set(check(train, test).values()) == {0}
    full, _ = tables(spark)
    assert check(full, test) == {"no_near_zero_left": 1, "no_rfm_duplicate_left": 1, "train_test_aligned": 2,
                                 "targets_and_keys_present": 0}
    assert check(train, test.drop("target", "a")) == {
        "no_near_zero_left": 0, "no_rfm_duplicate_left": 0, "train_test_aligned": 2, "targets_and_keys_present": 1}
