"""Core operators on small frames: nulls, ties, repeated rows, empty tables, clashing names."""

import datetime as dt

from pyspark.sql import functions as F

from lodestone.functions.text import parsed_date, product_key, sentences, tokens
from lodestone.functions.urls import canonical, host, host_suffixes
from lodestone.operators.components import connected_components
from lodestone.operators.retrieval import bm25_scores, lexical_scores, nearest
from lodestone.operators.series import last_per_hour, last_two_days, politeness, top_k
from lodestone.operators.units import checked, converted, title_amount
from lodestone.operators.upsert import insert_ignore, latest, merged, pending
from lodestone.session import materialise, release


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_upserts_keep_first_and_last(spark):
    df = spark.createDataFrame([("k", 1, "a", 10), ("k", 2, "b", None), (None, 3, "c", 5)], "key string, seq int, name string, price int")
    assert rows(merged(df, ["key"], [F.col("seq")], ["price"])) == [("k", 1, "a", None), (None, 3, "c", 5)]
    assert rows(latest(df, ["key"], [F.col("seq")])) == [("k", 2, "b", None), (None, 3, "c", 5)]
    assert rows(insert_ignore(df, ["key"], [F.col("seq")])) == [("k", 1, "a", 10), (None, 3, "c", 5)]
    assert rows(latest(df.where("false"), ["key"], [F.col("seq")])) == []
    assert rows(pending(df, df.where("key = 'k'"), ["key"]), "seq") == [(3,)]


def test_series(spark):
    t = dt.datetime(2026, 1, 1, 10)
    df = spark.createDataFrame([("a", 1, t, 5.0), ("a", 2, t, 6.0), ("a", 3, t + dt.timedelta(days=2), 7.0), ("b", 4, t, None)], "k string, id int, ts timestamp, price double")
    assert [(r.k, r.id) for r in last_per_hour(df, ["k"], "ts", "id").orderBy("id").collect()] == [("a", 2), ("a", 3), ("b", 4)]
    two = {r.k: (r.cur_id, r.prev_id) for r in last_two_days(df, ["k"], "ts", "id").collect()}
    assert two == {"a": (3, 2), "b": (4, None)}
    assert rows(top_k(df, ["k"], [F.desc("price"), F.col("id")], 1), "k", "id") == [("a", 3), ("b", 4)]


def test_politeness_equals_the_recurrence(spark):
    arrivals = [0, 1, 1, 7, 8, 8, 30]
    df = spark.createDataFrame([("h", n, t) for n, t in enumerate(arrivals)], "h string, n int, t int")
    got = [r.start for r in politeness(df, "h", F.col("t"), "n", 3).orderBy("n").collect()]
    want, last = [], None
    for t in arrivals:
        last = t if last is None else max(t, last + 3)
        want.append(last)
    assert got == want


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(7, 7), (None, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert {got[n] for n in range(41)} == {0} and {got[n] for n in range(100, 140)} == {100}
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_text_expressions(spark):
    df = spark.createDataFrame([(1, "The Fast-Track price's 9 v2.0 up. Next One? yes"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r for r in df.select("id", tokens(F.col("t")).alias("w"), sentences(F.col("t")).alias("s")).collect()}
    assert got[1].w == ["fast-track", "price's", "v2.0", "up.", "next", "one", "yes"] and len(got[1].s) == 2
    assert got[2].w == [] and got[2].s == [] and got[3].w == []
    keys = spark.createDataFrame([("The new Headset X with X",), ("!!",), ("Model",)], "n string").select(product_key(F.col("n"))).collect()
    assert [r[0] for r in keys] == ["headphones x", "unknown", "model"]
    dates = spark.createDataFrame([("2026-01-17",), ("27/12/2025",), ("02 Mar 2026",), ("March 08, 2026",), ("last week",), (None,), ("03/25/2025",), ("Mar 5, 2025",), ("2025-03-05T10:00:00Z",), (" ",)], "d string").select(parsed_date(F.col("d"))).collect()
    assert [r[0] and r[0].isoformat() for r in dates] == ["2026-01-17", "2025-12-27", "2026-03-02", "2026-03-08", None, None, "2025-03-25", "2025-03-05", "2025-03-05", None]


def test_urls(spark):
    df = spark.createDataFrame([("HTTPS://www.A.example:80/x/?utm_source=q&b=1#f",), ("not a url",), (None,)], "u string")
    got = df.select(host(F.col("u")), canonical(F.col("u"))).collect()
    assert tuple(got[0]) == ("a.example", "https://www.a.example:80/x?b=1") and got[1][0] == "" and got[2][1] is None
    more = [("HTTPS://Shop.Example/A/?UTM_Source=x&b=1", "https://shop.example/A?b=1"), ("https://a.example", "https://a.example/"), (" http://a.example/?q=a%20b&e&t=~*# ", "http://a.example/?q=a+b&e=&t=~%2A"), ("//h.example/x//", "https://h.example/x")]
    assert [r[0] for r in spark.createDataFrame(more, "u string, want string").select(canonical(F.col("u"))).collect()] == [w for _, w in more]
    assert spark.range(1).select(host_suffixes(F.lit("a.b.example"))).first()[0] == ["a.b.example", "b.example"]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma delta"), (3, None)], "id int, t string")
    queries = spark.createDataFrame([("q", "beta gamma"), ("none", "the")], "q string, text string")
    assert [(r.query, r.doc) for r in lexical_scores(docs, "id", "t", queries, "q", "text").orderBy("doc").collect()] == [("q", 1), ("q", 2)]
    assert all(r.score > 0 for r in bm25_scores(docs, "id", "t", queries, "q", "text").collect())
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "id int, v array<double>")
    assert rows(nearest(v, "id", "v", v.where("id in (1, 4)"), 1), "query", "neighbour") == [(1, 2)]
    assert nearest(v, "id", "v", v.where("false"), 1).count() == 0


def test_title_amounts(spark):
    titles = ["X – ₹4,133.18", "X 12,50 EUR", "X, only 9900 cents", "X 4.6465万円", "X 0.87 thousand BRL", "was $9.99", "R$1.335,99 X", "X 0.5 lakh INR", "27-inch", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    amount, currency = title_amount(F.col("t"))
    got = [(None if r[0] is None else round(r[0], 2), r[1]) for r in df.select(amount, currency).collect()]
    assert got == [(4133.18, "INR"), (12.5, "EUR"), (99.0, None), (46465.0, "JPY"), (870.0, "BRL"), (None, None), (1335.99, "BRL"), (50000.0, "INR"), (None, None), (None, None)]


def test_units_on_a_small_market(spark):
    t = dt.datetime(2026, 1, 5)
    offer = lambda i, price, currency="USD", title=None, rate=1.0, usd=None, url="u": (i, url, "Echo 1234 kettle 1 L", "B", "B", "US", "S", price, currency, title, rate, price if usd is None else usd, "2026-01-05T00:00:00Z", t)
    data = [offer(i, 50.0 + i % 3, title=f"Echo – ${50 + i % 3}.00") for i in range(60)] + [offer(100, 5100.0, title="Echo 5100 cents", usd=51.0), offer(101, 50.0, "usd"), offer(102, 50.0, rate=2.0), offer(103, 50.0, usd=5000.0), offer(104, 0.0), offer(105, None, None, usd=0.0)]
    schema = "id long, canonical_url string, product_name string, brand string, competitor string, region string, seller string, price double, currency string, listing_title string, exchange_rate double, normalized_price_usd double, exchange_rate_timestamp string, scraped_at timestamp"
    rates = spark.createDataFrame([("USD", dt.date(2026, 1, 5), 1.0), ("EUR", dt.date(2026, 1, 5), 1.1)], "currency string, rate_date date, usd_per_unit double")
    got = {r.id: r for r in checked(spark.createDataFrame(data, schema), rates).collect()}
    assert len(got) == 66 and got[100].unit == "minor" and round(got[100].amount, 2) == 51.0
    bad = {i for i, r in got.items() if r.bad_currency or r.bad_price or r.bad_rate or r.bad_usd}
    assert bad == {100, 101, 102, 103, 105}


def test_doubtful_units_go_to_review(spark):
    cols = "id long, canonical_url string, price double, currency string, unit double, source string, confidence double, t_currency string, home string, rate double, home_rate double, exchange_rate double, normalized_price_usd double"
    row = lambda i, unit, source, confidence: (i, "u", 5000.0, "USD", unit, source, confidence, None, "USD", 1.0, 1.0, 1.0, 50.0)
    df = spark.createDataFrame([row(1, 1.0, "forest", 0.95), row(2, 1.0, "forest", 0.5), row(3, 1.0, "title", 1.0), row(4, 1.0, "forest", None)], cols)
    got = {r.id: r for r in converted(df).collect()}
    assert [got[i].review for i in (1, 2, 3, 4)] == [False, True, False, True]
    assert got[1].amount == got[3].amount == 50.0 and got[1].bad_price and not got[1].bad_usd
    assert got[2].amount is None and got[2].amount_usd is None and not got[2].bad_price and not got[2].bad_usd


def test_scratch_is_removed(spark):
    import os

    df = materialise(spark.range(3))
    folder = df.inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    assert df.count() == 3 and os.path.isdir(folder)
    release(spark)
    assert not os.path.isdir(folder)


def test_admission_equals_a_fold(spark):
    import random

    from lodestone.operators.limits import admitted

    r = random.Random(4)
    data = [(f"u{r.randrange(3)}", n, r.randrange(400)) for n in range(300)] + [(None, 900, 1), ("u0", 901, None)]
    got = {x.n: x.admitted for x in admitted(spark.createDataFrame(data, "u string, n int, t int"), "u", "t", "n", 3, 20).collect()}
    passed = {}
    for u, n, t in sorted((x for x in data if x[0] and x[2] is not None), key=lambda x: (x[0], x[2], x[1])):
        mine = [p for p in passed.get(u, []) if p > t - 20]
        assert got[n] == (len(mine) < 3)
        passed[u] = mine + [t] * got[n]
    assert len(got) == 302 and not got[900] and not got[901]


def test_captures_that_differ_late_are_both_kept(spark, tmp_path):
    from lodestone.plans.stores import insert_evidence

    same = "x" * 60_000
    data = [(1, "r", "u", same + "a", "t"), (2, "r", "u", same + "b", "t"), (3, "r", "u", same + "a", "t"), (4, "r", "u", None, "t")]
    spark.createDataFrame(data, "id long, run_id string, source_url string, content string, scraped_at string").write.parquet(f"{tmp_path}/raw_evidence.parquet")
    assert rows(insert_evidence(spark, str(tmp_path)), "id") == [(1,), (2,)]
