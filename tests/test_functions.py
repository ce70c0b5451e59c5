from datetime import date

from pyspark.sql import functions as F

from dayledger.functions import stats as st
from dayledger.functions import text as tx
from dayledger.operators import checks
from dayledger.operators import reports as rp
from dayledger.operators.ordered import last_known, numbered, running_sums
from dayledger.operators.profile import profile
from dayledger.operators.spec import CountsWith, Dataset, Duration, ListStats, NullPattern, Rows, TextCounts, ValueCounts
from dayledger.sources.tables import written


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_minify(spark):
    values = [0, 7, 999, 1000, 9994, 12345, 999_000, 1_234_567, 45_600_000, 1_500_000_000, 2 * 10**12, 3 * 10**13, None]
    assert column(spark, values, "long", tx.minify) == ["0", "7", "999", "1.00K", "9.99K", "12.3K", "999K", "1.23M", "45.6M", "1.50B", "2.00T", "30.00T", None]


def test_humanize(spark):
    values = ["STATEMENT_CATEGORY_SCOPE_OF_PLATFORM_SERVICE", "KEYWORD_AGE_SPECIFIC_RESTRICTIONS_MINORS", "EU", "EEA_NO_IS", None, "4-NOT SPECIFIED", "a1b ÉTÉ o'neil", ""]
    assert column(spark, values, "string", tx.humanize) == ["Scope of Platform Service", "Age-Specific Restrictions Minors", "EU", "EU+LI+NO", "—None—", "4-Not Specified", "A1B Été O'Neil", ""]


def test_lists(spark):
    values = ['["A","B"]', "[A,,B]", "[]", "", None]
    assert column(spark, values, "string", tx.parse_list) == [["A", "B"], ["A", "B"], [], [], None]
    assert column(spark, values, "string", lambda c: tx.empty_to_null(tx.parse_list(c))) == [["A", "B"], ["A", "B"], None, None, None]


def test_upper_limit(spark):
    values = [None, 0, 7, 100, 101, 110, 998, 1000, 1001, 54321, 10**9 + 1]
    for digits, floor in ((2, 100), (1, 50), (3, 1)):
        def plain(v):
            v = max(v or 0, floor)
            step = 10 ** max(0, len(str(v)) - digits)
            return -(-v // step) * step
        assert column(spark, values, "long", lambda c: tx.upper_limit(c, digits, floor)) == [plain(v) for v in values]


def test_normalize(spark):
    assert column(spark, ["cyber-violence", " KEYWORD_ADULT toys"], "string", lambda c: tx.normalize_code(c, "KEYWORD_")) == ["KEYWORD_CYBER_VIOLENCE", "KEYWORD_ADULT_TOYS"]


ROWS = [
    (date(2024, 1, 1), "a", "x", ["k", "l"], "t", 10, 30, None),
    (date(2024, 1, 1), "a", None, [], None, 50, 20, "e"),
    (date(2024, 1, 1), None, "x", None, "t", None, 5, "e"),
    (date(2024, 1, 2), "a", "y", ["k"], "", 0, 0, "e"),
]
SPECS = Dataset((Rows(), ValueCounts("x"), TextCounts("t"), ListStats("l"), NullPattern("p", ("v", "t"), ("vv", "tt")), Duration("d", "s", "e"), CountsWith("v", "x")))


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "day date, platform string, v string, l array<string>, t string, s0 int, e0 int, x string")
    return df.withColumns({"s": F.timestamp_seconds("s0"), "e": F.timestamp_seconds("e0")})


def test_profile(spark):
    got = {(r.start_date.day, r.platform, r.column, r.entity, r.variant, r.text): (r["count"], r.min, r.mean, r.max) for r in profile(table(spark), SPECS).collect()}
    assert got[1, "a", "rows", None, None, None] == (2, None, None, None)
    assert got[1, None, "rows", None, None, None] == (1, None, None, None)
    assert got[1, "a", "v", None, None, None][0] == 1 and got[1, "a", "v", "with_end_date", None, None][0] == 1
    assert (1, "a", "v", "with_end_date", "x", None) not in got
    assert got[1, "a", "l", "elements", None, None][0] == 2 and got[1, "a", "l", "elements_per_row", None, None] == (None, None, None, 2)
    assert got[1, "a", "l", None, None, None][0] == 1 and got[1, "a", "l", None, "k", None][0] == 1
    assert got[1, "a", "d", None, None, None] == (1, 20, 20, 20) and got[1, "a", "d", "null_bc_negative", None, None][0] == 1
    assert got[1, "a", "p", "vv_tt", None, None][0] == 1 and got[1, "a", "p", "tt", None, None][0] == 0
    assert got[2, "a", "t", None, None, ""][0] == 1


def test_gathered_rows(spark):
    """Rows of many small strata and of one large one, gathered first: a task counts whole strata, and the statistics are the same."""
    df = spark.range(0, 6000, numPartitions=8).selectExpr("date'2024-01-01' day", "cast(if(id < 2000, 0, id % 1000) as string) platform", "if(id % 5 = 0, 'x', 'y') c")
    specs = (Rows(), ValueCounts("c"))
    plain, gathered = (profile(df, Dataset(specs, gather=g)) for g in (False, True))
    assert sorted(map(str, plain.collect())) == sorted(map(str, gathered.collect()))
    plan = gathered._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "RebalancePartitions" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_gathered_rows_move_once(spark, monkeypatch):
    """Gathered counts are whole and need no shuffle after that of the rows; columns made from others are not moved, and strata too large for a task are counted with partial sums."""
    from dayledger.operators import profile as p

    df = spark.range(0, 9000, numPartitions=8).selectExpr("if(id % 7 = 0, null, date'2024-01-01') day", "cast(if(id < 4000, 0, nullif(id % 1000, 5)) as string) platform", "concat('a b ', id % 3) t", "id unused")
    made = {"words": F.split("t", " "), "upper": F.upper("t"), "other": F.upper("platform")}
    specs = (Rows(), ListStats("words"), ValueCounts("upper"), NullPattern("n", ("words", "platform"), ("w", "p")))
    data = lambda gather: Dataset(specs, gather=gather, made=made)
    columns, narrow = p.needed(df, data(True))
    assert columns == ["day", "platform", "t"] and set(narrow.made) == {"words", "upper"}
    want = sorted(map(str, profile(df, data(False)).collect()))
    gathered = profile(df, narrow)
    assert sorted(map(str, gathered.collect())) == want
    plan = gathered._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    moved = next(line for line in gathered._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation" in line)
    assert "unused" not in moved and "words" not in moved and "upper" not in moved
    monkeypatch.setattr(p, "PART", 1000)  # the stratum of 3,000 rows and more is large
    assert sorted(map(str, profile(df, data(True)).collect())) == want
    monkeypatch.setattr(p, "PART", 1)
    assert sorted(map(str, profile(df, data(True)).collect())) == want
    assert profile(df.limit(0), data(True)).count() == 0


def test_summary_reads_statistics_once(spark):
    """All sections come from one scan of the statistics; what they are made of is the size of the summary."""
    rows = spark.range(0, 600, numPartitions=3).selectExpr("date_add(date'2024-01-01', cast(id % 40 as int)) day", "cast(id % 5 as string) platform", "cast(id % 3 as string) v", "timestamp_seconds(id) s", "timestamp_seconds(id * id) e")
    stats, scans = profile(rows, Dataset((Rows(), ValueCounts("v"), Duration("d", "s", "e")))), []

    def write(df):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 600"))
        return written(df)

    got = {(r.section, r.variable): r.value for r in rp.summary(stats, write).collect()}
    assert sum(scans) == 1
    assert got[1, "rows"] == "600" and got[1, "v.1"] == "200" and got[2, "platform.3.rows"] == "120" and got[3, "platform.3.start_date"] == "2024-01-04"
    whole = st.merge(stats, ["column", "variant"])
    assert checks.same_rows(st.total(st.sums(stats, ["column", "variant", "platform"]), ["column", "variant"]), whole)


def test_merge_law(spark):
    """The profile of a whole is the merge of its parts' profiles."""
    whole = st.finalize(profile(table(spark, ROWS * 3), SPECS))
    parts = st.finalize(profile(table(spark, ROWS), SPECS).unionByName(profile(table(spark, ROWS * 2), SPECS)))
    assert checks.same_rows(whole, parts)


def test_merge_without_values(spark):
    rows = spark.createDataFrame([("k", None, None, None, None), ("m", 2, 1, 3, 5), ("m", 1, 2, 4, 9)], "key string, count long, min long, mean long, max long")
    got = {r.key: r for r in st.merge(rows, ["key"]).collect()}
    assert tuple(got["k"]) == ("k", 0, None, None, None) and tuple(got["m"]) == ("m", 3, 1, 3, 9)
    assert {r.key: r.mean for r in st.merge(rows, ["key"], mean="terms", null_as_zero=True).collect()} == {"k": 0, "m": 2 + 1}


def test_empty_table(spark):
    assert profile(table(spark, ROWS).limit(0), SPECS).count() == 0
    assert st.finalize(profile(table(spark, ROWS).limit(0), SPECS)).count() == 0


def test_predicate(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", "y")], "platform string, tag string")
    count = lambda **k: df.where(st.predicate(**k)).count()
    assert [count(), count(tag=None), count(tag=st.PRESENT), count(tag="x"), count(tag=[None, "y"]), count(platform="a", tag=None)] == [3, 1, 2, 1, 2, 1]


def test_gaps_need_neighbours(spark):
    days = spark.createDataFrame([("a", date(2024, 1, d)) for d in (1, 2, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)] + [("b", date(2024, 1, 1)), (None, date(2024, 1, 9)), (None, date(2024, 1, 1))], "k string, d date")
    assert [tuple(r) for r in rp.outages(days, "k", "d").collect()] == [("a", date(2024, 1, 2), date(2024, 1, 5), 2)]


def test_audit(spark):
    manifest = spark.createDataFrame([(date(2024, 1, 1), 2), (date(2024, 1, 3), 2)], "release date, batch_count long")
    files = spark.createDataFrame([(date(2024, 1, 1), 0, "d", "d"), (date(2024, 1, 1), 2, "d", "e"), (date(2024, 1, 3), 0, "d", "d"), (date(2024, 1, 9), 0, "d", "d")], "release date, batch int, digest string, expected string")
    got = sorted((r.release.day, r.problem) for r in checks.audit(manifest, files).collect())
    assert got == [(1, "digest"), (1, "missing batch"), (2, "missing day"), (3, "batch count"), (9, "unknown day")]
    assert [r.release.day for r in checks.complete_days(manifest, files).collect()] == [1]


def test_specs_of_ones_own(spark):
    """A declaration needs a column and slots; anything else is an error."""
    import pytest

    from dayledger.operators.spec import Slot

    class Longest:
        column = "t"

        def slots(self):
            return [Slot((("longest", "max"), ("letters", "sum")), x=F.char_length("t"))]

    got = {(r.start_date.day, r.platform, r.entity): (r["count"], r.max) for r in profile(table(spark), Dataset((Longest(),))).collect()}
    assert got == {(1, "a", "longest"): (None, 1), (1, "a", "letters"): (1, None), (1, None, "longest"): (None, 1), (1, None, "letters"): (1, None), (2, "a", "longest"): (None, 0), (2, "a", "letters"): (0, None)}
    with pytest.raises(TypeError):
        profile(table(spark), Dataset(("rows",)))
    Longest.slots = lambda self: [Slot(((None, "median"),))]
    with pytest.raises(ValueError):
        profile(table(spark), Dataset((Longest(),)))
    assert profile(table(spark), Dataset(())).count() == 0


def test_one_scan(spark, tmp_path):
    """The profile reads its source once, however many declarations there are."""
    table(spark).write.parquet(str(tmp_path / "t"))
    plan = profile(spark.read.parquet(str(tmp_path / "t")), SPECS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_summary_keeps_texts_apart(spark):
    rows = [(date(2024, 1, 1), "a", None, None, "x" * 70 + end, 0, 5, None) for end in ("a", "b", "b", "")] + [(date(2024, 1, 1), "a", None, None, t, 9, 5, None) for t in ("a |  b", None)]
    got = [tuple(r) for r in rp.summary(profile(table(spark, rows), Dataset((Rows(), TextCounts("t"), Duration("d", "s", "e"))))).collect()]
    texts = {(r[3], r[4], r[5]) for r in got if r[4] is not None}
    assert texts == {("t." + "x" * 70 + "…", "x" * 70 + "a", "1"), ("t." + "x" * 70 + "…", "x" * 70 + "b", "2"), ("t." + "x" * 70, "x" * 70, "1"), ("t.a  b", "a |  b", "1")}
    got.sort(key=lambda r: r[2])
    assert [r[2] for r in got] == list(range(1, 14))
    plain = [("d.count", "4"), ("d.min", "5"), ("d.mean", "5"), ("d.max", "5"), ("d.null_bc_negative", "2"), ("rows", "6")]
    by_count = [("t." + "x" * 70 + "…", "2"), ("t." + "x" * 70 + "…", "1"), ("t." + "x" * 70, "1"), ("t.a  b", "1"), ("t.is_null", "1")]
    assert [(r[3], r[5]) for r in got] == plain + by_count + [("platform.a.rows", "6"), ("platform.a.start_date", "2024-01-01")]


def test_numbers_over_ranges(spark):
    """Rows are numbered over several ranges and uneven groups, with ties and null groups."""
    rows = [(None if i % 3 == 0 else "ab"[i % 7 == 0], (i * 37) % 100) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    parts = []

    def keep(placed):
        parts.append(placed.select("__part").distinct().count())
        return written(placed)

    got = numbered(df, [F.desc("x")], "k", ["g"], keep).collect()
    for g in (None, "a", "b"):
        own = sorted((r.k, r.x) for r in got if r.g == g)
        assert [k for k, _ in own] == list(range(1, len(own) + 1)) and [x for _, x in own] == sorted((x for h, x in rows if h == g), reverse=True)
    assert len(got) == 500 and written(df).count() == 500


def test_running_values_by_blocks(spark):
    rows = [("f", b, i, (b * 10 + i) if i % 4 == 1 and b != 2 else None) for b in range(4) for i in range(6)] + [(None, 0, 0, None), (None, 5, 0, 3)]
    df = spark.createDataFrame(rows, "k string, b long, i int, v int").repartition(3)
    sums = {(r.k, r.b, r.i): (r.n, r.s) for r in running_sums(df, ["k"], "b", ["i"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    last = {(r.k, r.b, r.i): r.was for r in last_known(df, ["k"], "b", ["i"], "was", F.col("v")).collect()}
    for key in ("f", None):
        n, s, was = 0, 0, None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            n, s, was = n + 1, s + (r[3] or 0), was if r[3] is None else r[3]
            assert sums[r[:3]] == (n, s) and last[r[:3]] == was


def test_orders(spark):
    """Orders that a comparison of sorted rows can't see."""
    stats = profile(table(spark, [(date(2024, 1, 1), p, v, None, t, 0, 0, None) for p, v, t in (("b", "x", "m"), ("A", "y", "m"), ("a", "y", "n"), ("a", "z", None), ("a", None, None))]), Dataset((ValueCounts("v"), TextCounts("t"))))
    assert [(r.variant, r["count"]) for r in rp.value_counts(stats, "v").collect()] == [("y", 2), ("z", 1), ("x", 1), (None, 1)]
    assert [(r.text, r["count"]) for r in rp.text_usage(stats, ["t"]).collect()] == [("␀", 2), ("m", 2), ("n", 1)]
    order = spark.createDataFrame([("b", 0), ("A", 1), ("a", 2)], "platform string, ordinal int")
    assert [r.platform for r in st.canonical_order(stats.where("column = 'v'"), order).collect()] == ["b", "A", "a", "a", "a"]
    days = spark.createDataFrame([(p, date(2024, 1, d)) for p in ("b", "A", "a") for d in (1, 2, 5, *range(6, 26), 28)], "k string, d date")
    assert [(r.k, r.before.day) for r in rp.outages(days, "k", "d").collect()] == [("A", 2), ("A", 25), ("a", 2), ("a", 25), ("b", 2), ("b", 25)]


def test_cumulative_platforms(spark):
    rows = [(date(2024, m, 1), p, v, None, None, 0, 0, None) for m, p, v in ((1, "a", None), (1, None, "k"), (2, "a", "j"), (3, "b", "k"), (3, "a", "k"))]
    got = sorted(tuple(r)[1:] + (r.period.month,) for r in rp.cumulative_platforms(profile(table(spark, rows), Dataset((ValueCounts("v"),))), "v", "k").collect())
    assert got == sorted([("all", 1, 1, 1), ("all", 0, 1, 2), ("all", 1, 2, 3), ("with keywords", 0, 0, 1), ("with keywords", 1, 1, 2), ("with keywords", 1, 2, 3), ("k", 0, 0, 1), ("k", 0, 0, 2), ("k", 2, 2, 3)])


def test_category_text(spark):
    from dayledger.operators import distill

    df = spark.createDataFrame([("A", None), ("B", '["A_LONG"]'), ("B", '["C"]'), ("B", None)], "category string, category_addition string")
    assert [r[0] for r in df.select(distill.by_category_text("A")).collect()] == [True, True, False, False]
    assert checks.single_category(df).first()[0] is None and checks.single_category(df.where("category = 'B'")).first()[0] == "B"


def test_names_with_illegal_characters(spark):
    names, domain = spark.createDataFrame([("one",), ('o"ne',), ("o\\ne",)], "name string"), spark.createDataFrame([("One",), ('O"ne',)], "value string")
    assert {r.name: r.value for r in checks.find_canonical(names, domain).collect()} == {"one": "One", 'o"ne': None, "o\\ne": None}
