import duckdb

from duplexa.llm.preference import SQL, paired_by_answer, paired_by_id, preference_format


def render(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def test_common_prefix_and_masks(spark):
    rows = [
        (0, 0, "system", "s"), (0, 1, "user", "u"), (0, 2, "assistant", "good é"), (0, 3, "user", "more"), (0, 4, "assistant", None),
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "bad"),
        (2, 0, "user", "alone"), (4, 0, "user", "x"), (5, 0, "user", "x"),
        (7, None, None, "y"), (7, 3, "assistant", "z"), (7, 3, "assistant", "z"), (None, 0, "user", "lost"),
    ]
    got = {r.pair_id: r for r in preference_format(paired_by_id(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int"))).collect()}
    assert set(got) == {0, 1, 2, 3}
    r = got[0]
    assert r.n_common == 2 and r.prompt == render("system", "s") + render("user", "u")
    assert r.chosen == render("assistant", "good é") + render("user", "more") + render("assistant", "") and r.rejected == render("assistant", "bad")
    marked = [r.chosen[slice(*map(int, s.split(":")))] for s in r.chosen_mask.split(",")]
    assert marked == ["good é<|end|>\n", "<|end|>\n"]
    assert r.rejected[slice(*map(int, r.rejected_mask.split(":")))] == "bad<|end|>\n"
    assert got[1].rejected is None and got[1].n_common == 0 and got[1].chosen == render("user", "alone")
    assert got[2].n_common == 1 and got[2].chosen == got[2].rejected == "" and got[2].chosen_mask == ""
    assert got[3].rejected == render("unknown", "y") + 2 * render("assistant", "z") and got[3].rejected_mask.count(":") == 2
    assert preference_format(paired_by_id(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_pairs_by_answer_have_a_common_prompt(spark):
    long = "word " * 400_000
    rows = [
        (0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"), (0, 3, "assistant", "last0"), (0, 4, "user", "bye"), (1, 5, "assistant", "last1"), (1, 4, None, None),
        (2, 0, "user", "no answer"), (3, 0, "user", "q3"), (3, 1, "assistant", long), (6, 0, "assistant", "lone"), (None, 0, "user", "lost"), (-1, 0, "assistant", "x"), (-2, 0, "user", "y"), (-2, 0, "user", "y"), (-2, 1, "assistant", "x"),
    ]
    got = {r.pair_id: r for r in preference_format(paired_by_answer(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, last int"))).collect()}
    assert set(got) == {0, 1, 2, 3, 6, -1, -2}
    r = got[0]
    assert r.n_common == 3 and r.prompt == render("user", "q0") + render("assistant", "a0") + render("user", "more")
    assert r.chosen == render("assistant", "last0") and r.rejected == render("assistant", "last1") and r.chosen_mask == r.rejected_mask == "14:27"
    assert got[1].prompt == render("unknown", "") and got[1].rejected == render("assistant", "last0")
    assert got[2].rejected is None and got[3].rejected is None and got[6].rejected is None and got[3].chosen == render("user", "q3") + render("assistant", long)
    assert got[-2].n_common == 3 and got[-2].chosen == got[-2].rejected == "" and got[-1].n_common == 1


def test_equals_sql(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    own = preference_format(paired_by_answer(spark.read.parquet(path))).toPandas().sort_values("pair_id").reset_index(drop=True)
    assert (own.n_common > 0).mean() > 0.9
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}'")
    want = con.sql(SQL).df().sort_values("pair_id").reset_index(drop=True)[own.columns]
    assert own.astype(object).where(own.notna(), None).equals(want.astype(object).where(want.notna(), None))
