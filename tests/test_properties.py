"""Randomised equivalences."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.errors import FilterSyntaxError
from lamina.functions import predicate as P
from lamina.functions import routing as R
from lamina.operators.engine import Engine

LEAF = st.builds(P.Comparison, st.sampled_from("ab"), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), st.integers(-5, 5))
TREE = st.recursive(LEAF, lambda t: st.one_of(st.builds(P.And, t, t), st.builds(P.Or, t, t), st.builds(P.Not, t)), max_leaves=8)


def text(t):
    match t:
        case P.And(a, b):
            return f"({text(a)} AND {text(b)})"
        case P.Or(a, b):
            return f"({text(a)} OR {text(b)})"
        case P.Not(a):
            return f"NOT ({text(a)})"
    return f"{t.name} {t.op} {t.value}"


@given(TREE)
def test_text_and_tree_agree(tree):
    assert P.parse(text(tree)) == tree


@given(st.text(alphabet="ab=<>!&|()\"' 12.-andort", max_size=25))
def test_any_text_parses_or_is_refused(s):
    try:
        tree = P.parse(s)
    except FilterSyntaxError:
        return
    assert P.columns(tree)


@settings(max_examples=15, deadline=None)
@given(TREE)
def test_filters_follow_sql(spark, tree):
    values = [None, -5, -1, 0, 3, 5]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a int, b int")
    df.createOrReplaceTempView("ab")
    key = lambda r: (str(r.a), str(r.b))
    assert sorted(map(key, P.apply(df, text(tree)).collect())) == sorted(map(key, spark.sql(f"SELECT * FROM ab WHERE {text(tree)}").collect()))


@given(st.floats(0, 1), st.floats(1, 1e9), st.floats(1, 1e4), st.integers(0, 500))
def test_routes_always_decide(share, rows, width, deltas):
    for kind in ("point_get", "range_scan", "full_scan", "aggregate"):
        assert R.route(kind, share, rows, width, deltas).path in ("delta", "columnar", "merge")


def test_random_histories_match_a_model(spark, tmp_path):
    """Every snapshot of a random history equals a dictionary's, before and after compaction."""
    r = random.Random(8)
    e = Engine(spark, str(tmp_path / "db"))
    t = e.create("t", spark.createDataFrame([], "id long, v long").schema, "id")
    model, states = {}, {}
    for step in range(7):
        x = e.begin()
        what = r.choice(["insert", "update", "delete"]) if model else "insert"
        after = dict(model)
        if what == "insert":
            new = {k: r.randrange(100) for k in r.sample(range(100), 6) if k not in model}
            t.insert(spark.createDataFrame(list(new.items()), "id long, v long"), x)
            after |= new
        else:
            cut = r.choice(sorted(model))
            hit = [k for k in model if k >= cut]
            if what == "update":
                t.update(f"id >= {cut}", {"v": step}, x)
                after |= dict.fromkeys(hit, step)
            else:
                t.delete(f"id >= {cut}", x)
                after = {k: v for k, v in model.items() if k < cut}
        if r.random() < 0.25:
            e.rollback(x)
        else:
            states[e.commit(x)] = model = after
    read = lambda s: {q.id: q.v for q in t.scan(as_of=s).collect()}
    assert all(read(s) == want for s, want in states.items())
    middle = sorted(states)[len(states) // 2]
    t.compact(middle, files=2)
    assert all(read(s) == want for s, want in states.items() if s >= middle)
