import random

from stepweave import catalog
from stepweave.operators import algebra, compare

SF = "/root/testdata/sf0.001"


def aligned(a, b, least=0.5):
    """The three passes one pair at a time."""
    left, right, out = dict(a), dict(b), set()
    for how, key in (("name", lambda s: s[0] and s[0].lower()), ("content", lambda s: s[1])):
        for i in sorted(left):
            k = key(left[i])
            j = next((j for j in sorted(right) if k is not None and key(right[j]) == k), None)
            if j is not None:
                out.add((i, j, how))
                del left[i], right[j]
    score = lambda x, y: len(x & y) / len(x | y) if x | y else 0
    pairs = sorted((-score(set(x[2]), set(y[2])), i, j) for i, x in left.items() for j, y in right.items())
    for s, i, j in pairs:
        if -s >= least and i in left and j in right:
            out.add((i, j, "tables"))
            del left[i], right[j]
    return out | {(i, None, "none") for i in left} | {(None, j, "none") for j in right}


def test_alignment_equals_greedy_choice(spark):
    rng = random.Random(3)
    schema = "step long, name string, content string, tables array<string>"
    for n in (0, 1, 14):
        side = lambda: {i: (rng.choice([None, "A", "a", f"n{i}"]), rng.choice([None, "x", "y", f"c{rng.random()}"]), rng.sample("pqrst", rng.randint(0, 4))) for i in range(n)}
        a, b = side(), side()
        frames = [spark.createDataFrame([(i, *v) for i, v in x.items()], schema) for x in (a, b)]
        got = [tuple(r) for r in compare.align_steps(*frames).collect()]
        assert len(got) == len(set(got))
        assert set(got) == aligned(a, b)


def test_alignment_query_names_every_step_once(spark):
    got = catalog.queries()["step_alignment"](spark, SF).toPandas()
    assert got["a"].dropna().is_unique and got["b"].dropna().is_unique


def test_field_diff_and_twins_with_nulls(spark):
    rows = spark.createDataFrame([("A", "1", None), ("a", "1", "x"), ("b", "2", "x"), ("B", "2", "x"), (None, "3", "y")], "name string, item string, v string")
    assert {r.group_key: r.verdict for r in compare.twins(rows, "name", "v").collect()} == {"a": "divergent", "b": "identical"}
    assert {r.item: r.all_equal for r in compare.field_diff(rows, "item", "v").collect()} == {"1": False, "2": True, "3": True}


def test_census_falls_back_to_words_that_occur(spark):
    rows = spark.createDataFrame([("sepsis screening",), ("screening of sepsis",), ("wait_time",), (None,)], "name string")
    exact, left_out = algebra.census(rows, ["name"], "sepsis screening")
    assert (exact.count(), left_out) == (1, [])
    some, left_out = algebra.census(rows, ["name"], "screening sepsis nothing")
    assert (some.count(), left_out) == (2, ["nothing"])
    assert algebra.census(rows, ["name"], "zz yy")[0].count() == 0
    assert algebra.census(rows, ["name"])[0].count() == 4
    assert algebra.census(rows, ["name"], "time")[0].count() == 1


def test_registry_and_numbers(spark):
    claims = spark.createDataFrame([(1, "3 of 45"), (2, None)], "k int, t string")
    facts = spark.createDataFrame([(1, "45 patients")], "k int, t string")
    found = algebra.Registry()
    first = found.add("numbers", algebra.ungrounded_numbers(claims, facts, "k", "t"), True, "claims")
    assert first.ref == "R1" and [tuple(r) for r in spark.sql("SELECT * FROM R1").collect()] == [(1, "3")]


def test_readiness_of_nothing(spark):
    row = algebra.readiness([("parse", spark.createDataFrame([], "x int"), "x = 1", 0.9, True)]).first()
    assert (row.value, row.passed) == (0.0, False)


def test_medians_and_fuzzy_names_against_loops(spark):
    import random
    from statistics import median

    from stepweave.operators import algebra, lookups

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, rng.random()])) for _ in range(80)] + [("none", None)]
    got = {r.g: (r.n, r["median"]) for r in algebra.latency(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in {r[0] for r in rows}:
        values = [v for x, v in rows if x == g and v is not None]
        assert got[g][0] == len(values) and (got[g][1] is None if not values else abs(got[g][1] - median(values)) < 1e-12)
    words = ["ed", "sepsis", "sep", "psi", "report", "reporting", "los", "x", "xy", "daily"]
    make = lambda n: sorted({" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(n)})
    keys, names = make(25), make(25)
    out = {r.key: (r.name, round(r.score, 9)) for r in lookups.fuzzy_matches(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    held = lambda w, v: w == v or (len(w) >= 3 and len(v) >= 3 and (w in v or v in w))
    want = {}
    for k in keys:
        scored = [(sum(any(held(w, v) for v in n.split()) for w in set(k.split())) / len(set(k.split())), n) for n in names]
        best = [(-s, n) for s, n in scored if s >= 0.5]
        if best:
            want[k] = (min(best)[1], round(-min(best)[0], 9))
    assert out == want and want


def test_alignment_measures_only_what_can_overlap(spark):
    """Sets that share a rare table by chance are no candidates, and no pair at the limit is lost, nulls included."""
    rng = random.Random(11)
    a = {k: rng.sample(range(400), rng.choice([1, 2, 30, 60])) for k in range(80)} | {80: [None], 81: [None, 5], 82: [None, *range(20)]}
    b = {k: rng.sample(x, -(-2 * len(x) // 3)) + [1000 + k, *range(2000, 2000 + len(x) // 3)] for k, x in a.items()} | {90: [None], 91: [None, 5]}
    frames = [spark.createDataFrame(list(x.items()), f"{s} long, t_{s} array<int>") for x, s in ((a, "a"), (b, "b"))]
    alike = lambda x, y: 2 * len(x & y) >= len(x | y)
    want = {(i, j) for i, x in a.items() for j, y in b.items() if alike(set(x), set(y))}
    got = [tuple(r) for r in compare.candidates(*frames, 0.5).collect()]
    shared = sum(bool(set(x) & set(y)) for x in a.values() for y in b.values())
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(want) > 30 and 3 * len(got) < shared


def test_steps_that_read_an_unnamed_table(spark):
    side = spark.createDataFrame([(1, None, None, [None]), (2, None, None, [None, "x"])], "step long, name string, content string, tables array<string>")
    assert {tuple(r) for r in compare.align_steps(side, side).collect()} == {(1, 1, "tables"), (2, 2, "tables")}
