import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfed.operators import codec, coordination, exchange, federated, health, joins, models, peers, timers, vector_index
from loomfed.operators.folds import ordered_fold


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


CONTRIBUTIONS = "round long, peer string, seq long, i int, v double, num_samples long"


def test_fedavg_replaces_rejects_and_poisons(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 0, 100.0, 1), (1, "a", 2, 0, 1.0, 1), (1, "b", 1, 0, 4.0, 2), (1, "c", 1, 0, 9.0, 0), (1, "d", 1, 0, 9.0, None), (2, "a", 1, 0, float("nan"), 1), (2, "b", 1, 0, 1.0, 1)],
        CONTRIBUTIONS,
    )
    got = {r["round"]: (r["v"], r["num_samples"]) for r in federated.fedavg(df).collect()}
    assert got[1] == (3.0, 3) and math.isnan(got[2][0])
    assert rows(federated.contribute(df)[1], "peer", "reason") == [("c", "BadInput"), ("d", "BadInput")]
    assert federated.fedavg(df.limit(0)).count() == 0


def test_hierarchical_equals_flat(spark):
    df = spark.createDataFrame([(1, f"p{k}", 1, i, float(k * (i + 1)), k % 4 + 1) for k in range(20) for i in range(3)], CONTRIBUTIONS)
    flat = {r["i"]: (r["v"], r["num_samples"]) for r in federated.aggregate(df).collect()}
    deep = {r["i"]: (r["v"], r["num_samples"]) for r in federated.hierarchical(df.withColumn("g", F.substring("peer", 2, 1)), "g").collect()}
    assert all(deep[i][1] == flat[i][1] and deep[i][0] == pytest.approx(flat[i][0]) for i in flat)


VECTORS = [(b + 1, [b + 0.0, b + 0.1, b + 0.2, b + 0.3]) for b in range(5)]


def test_index_add_search_remove(spark, monkeypatch):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [2.0, 2.1, 2.2, 2.3])], "query_id long, embedding array<float>")
    want = [(0, 1, 3), (0, 2, 2), (0, 3, 4)]
    assert rows(vector_index.search(v, q, 3), "query_id", "rank", "vec_id") == want
    monkeypatch.setattr(vector_index, "BROADCAST_QUERIES", 0)
    assert rows(vector_index.search(v, q, 3), "query_id", "rank", "vec_id") == want
    assert rows(vector_index.search(vector_index.remove(v, v.filter("vec_id = 3")), q, 1), "vec_id") == [(2,)]
    assert vector_index.add(v, spark.createDataFrame([(5, [9.0] * 4), (6, [9.0] * 4)], v.schema)).count() == 6
    centres = vector_index.train(v, 2)
    assert len(centres) == 2 and rows(vector_index.search_ivf(v, q, centres, 3, probes=2), "query_id", "rank", "vec_id") == want


def test_inverted_file_deals_lists_and_meets_every_vector(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(9))
    x = np.repeat(rng.normal(size=(60, 6)).round(1), 5, 0)  # ties
    own = [(n, v.tolist()) for n, v in enumerate(x)] + [(900, None), (901, [math.nan] * 6), (902, [1.0, 2.0]), (903, [1e200] * 6), (904, [0.0, None, 0.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(own, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 4 = 0 or vec_id > 900").withColumnRenamed("vec_id", "query_id")
    finite = [(n, np.array(e)) for n, e in own if n < 900 or n == 903]
    want = []
    for n, e in [(n, e) for n, e in finite if n % 4 == 0 or n > 900]:
        d = sorted((math.sqrt(math.fsum(((e - o) ** 2).tolist())), m) for m, o in finite)
        want += [(n, r + 1, m) for r, (gap, m) in enumerate(x for x in d if math.isfinite(x[0]))][:7]
    want = sorted([*want, (902, 1, 902)])
    monkeypatch.setattr(vector_index, "LIST_ROWS", 20, raising=False)
    monkeypatch.setattr(vector_index, "LIST_QUERIES", 30, raising=False)
    monkeypatch.setattr(vector_index, "STEP_ROWS", 8)
    centres = vector_index.train(v.filter("vec_id < 300"), 5)
    assert rows(vector_index.search_ivf(v, q, centres, 7, probes=2), "query_id", "rank", "vec_id") == want
    assert rows(vector_index.search_ivf(v, q, [], 7), "query_id", "rank", "vec_id") == want
    assert rows(vector_index.search(v, q, 7), "query_id", "rank", "vec_id") == want


def test_registered_inverted_file_loses_no_neighbour(spark):
    import __spark_entry__

    for sf in ("sf0.001", "sf0.01"):
        own = __spark_entry__.queries()
        want, got = (set(rows(own[name](spark, f"/root/testdata/{sf}"), "query_id", "vec_id")) for name in ("index_search", "index_ivf"))
        assert len(want & got) / len(want) == 1.0 and len(got) == len(want)


def test_codec_is_within_half_a_step(spark):
    v = spark.createDataFrame([(k, [k * 0.37, -k * 1.0, 5.0]) for k in range(50)], "vec_id long, embedding array<double>")
    c = codec.train(v)
    out = codec.decode(codec.encode(v, c), c)
    step = c.first()["scale"]
    for r in out.collect():
        assert all(abs(a - b) <= s / 2 + 1e-12 for a, b, s in zip(r["embedding"], r["decoded"], step, strict=True)) and max(r["code"]) <= 255


def test_model_descends_and_batches_are_numbered(spark):
    df = spark.createDataFrame([(k, k / 10, 3.0 * k / 10 + 1) for k in range(100)], "id long, x double, y double")
    model = models.LinearModel({"x": 0.0})
    losses = []
    for _ in range(4):
        losses.append(model.compute_loss(df, "y").first()[0])
        model = model.step(df, "y", 0.02)
    assert losses == sorted(losses, reverse=True) and set(model.params()) == {"bias", "x"}
    line = models.fit_line(df, "x", "y").first()
    assert line["slope"] == pytest.approx(3) and line["intercept"] == pytest.approx(1)
    source = models.BatchSource(df, ["id"], 30)
    assert rows(source.batches(), "id", "position", "batch_id") == [(k, k, k // 30) for k in range(100)]
    assert source.next_batch(3).count() == 10 and source.on_data_loaded().first()["batches"] == 4
    sparse = models.BatchSource(df.selectExpr("id * id * 1000003 - 5 AS id", "x"), ["id", "x"], 30)
    assert [p for _, p in rows(sparse.batches(), "id", "position")] == list(range(100))
    assert "Exchange SinglePartition" not in sparse.batches()._jdf.queryExecution().toString()
    empty, n = models.BatchSource(df.limit(0), ["id"], 30).numbered()
    assert n == 0 and empty.count() == 0


def test_peers(spark):
    view = spark.createDataFrame([(k,) for k in [1, 2, 3, 3, 9, 8]], "peer long")
    a = rows(peers.select_random(view, 3, 1), "peer")
    assert len(a) == 3 and a == rows(peers.select_random(view.repartition(5), 3, 1), "peer")
    assert peers.select_random(view, 99, 1).count() == 5
    assert rows(peers.select_near(view, 8, 2), "peer") == [(8,), (9,)]
    ann = spark.createDataFrame([(0, 1, "a", ["x"]), (50, 2, "a", ["x"]), (10, 3, "b", ["y"]), (60, 4, "c", [])], "ts_ns long, id long, peer string, addresses array<string>")
    reg, bad = peers.register(ann, 90)
    assert rows(peers.live(reg, 100), "peer") == [("a",)] and rows(peers.live(reg, 99), "peer") == [("a",), ("b",)]
    assert rows(bad, "peer", "reason") == [("c", "BadInput")]
    assert rows(peers.throttle_announces(ann, 50), "id", "sent") == [(1, True), (2, True), (3, True), (4, True)]
    assert rows(peers.throttle_announces(ann, 51).filter("peer = 'a'"), "id", "sent") == [(1, True), (2, False)]


def test_address_book(spark):
    entries = spark.createDataFrame([("c", 0, "1"), ("c", 1, "2"), ("c", 2, "1"), ("c", 3, "3"), ("s", 0, "9")], "peer string, pos long, address string")
    book = peers.insert_addresses(entries)
    assert {r["peer"]: r["addresses"] for r in book.collect()} == {"c": ["1", "2", "3"], "s": ["9"]}
    found = peers.lookup(spark.createDataFrame([("c",), ("x",)], "peer string"), book)
    assert rows(found, "peer", "status") == [("c", "ok"), ("x", "NotRegistered")]
    many, bad = peers.insert_many(spark.createDataFrame([("c", 1, ["2", "1"]), ("c", 2, ["1", "4"]), ("d", 3, [])], "peer string, seq long, addresses array<string>"))
    assert many.first()["addresses"] == ["2", "1", "4"] and rows(bad, "peer", "reason") == [("d", "BadInput")]


def test_the_book_counts_references(spark):
    """A drop of an unknown peer is refused and changes nothing; pruning addresses leaves the count."""
    acts = [("a", "drop", []), ("a", "add", ["1", "1", "2"]), ("a", "add", ["3", "1"]), ("a", "forget", ["1"]), ("a", "drop", []), ("a", "forget", ["2"]), ("a", "forget", ["3"]),
            ("b", "add", []), ("b", "register", ["9"]), ("b", "add", ["8"]), ("c", "add", ["7"]), ("a", "drop", []), ("c", "add", ["7"]), ("c", "register", ["6"])]
    df = spark.createDataFrame([("n", k, k, *a) for k, a in enumerate(acts)], "book string, ts long, id long, peer string, action string, given array<string>")
    folded = peers.address_book(df, 2)
    got = [(r["status"], r["refs"], "".join(r["addresses"])) for r in folded.orderBy("id").collect()]
    assert got == [("UnknownPeer", 0, ""), ("ok", 1, "12"), ("ok", 2, "123"), ("ok", 2, "23"), ("ok", 1, "23"), ("ok", 1, "3"), ("ok", 1, ""), ("EmptyAddressList", 0, ""), ("UnknownPeer", 0, ""),
                   ("ok", 1, "8"), ("Full", 0, ""), ("ok", 0, ""), ("ok", 1, "7"), ("ok", 1, "76")]
    assert rows(peers.reference_counts(folded), "peer", "refs") == [("b", 1), ("c", 1)]


def test_handshakes_and_constant_views(spark):
    books = spark.createDataFrame([("x", "s", ["1"], 2), ("x", "t", ["5"], 1)], "client string, peer string, addresses array<string>, refs long")
    clients = spark.createDataFrame([("x",), ("y",)], "peer string")
    got = peers.merge_handshakes(books, peers.handshake(clients, server="s", addresses=["2", "1"]))
    assert sorted((r["client"], r["peer"], "".join(r["addresses"]), r["refs"]) for r in got.collect()) == [("x", "s", "12", 3), ("x", "t", "5", 1), ("y", "s", "21", 1)]
    assert peers.merge_handshakes(books, peers.handshake(clients, server="s")).count() == 2
    view = peers.ConstantView(spark, ["a", "b", "b", "c"])
    assert rows(view.random(2, 5), "peer") == rows(view.random(2, 5), "peer") and view.random(9, 1).count() == 3
    with pytest.raises(ValueError, match="no peers"):
        peers.ConstantView(spark, []).random(1, 1)


def test_exchange(spark):
    messages = spark.createDataFrame([(1, "x", ["a", "b", "zz"], 5), (2, "y", [], 5), (3, "z", ["a"], None)], "req_id long, payload string, peers array<string>, deadline_ns long")
    book = spark.createDataFrame([("a", ["1"]), ("b", ["2"]), ("e", [])], "peer string, addresses array<string>")
    ok, bad = exchange.send(messages, book)
    assert rows(ok, "req_id", "peer", "deadline_ns") == [(1, "a", 5), (1, "b", 5), (3, "a", exchange.STATIC_BUDGET_NS)]
    assert rows(bad, "req_id", "peer", "reason") == [(1, "zz", "NotRegistered")]
    with pytest.raises(ValueError, match="child"):
        exchange.bundle(messages, "b", [])
    with pytest.raises(ValueError, match="3"):
        exchange.unbundle(exchange.bundle(messages, "b", ["req_id", "payload", "peers"]), "b", 2)


def test_timers(spark):
    assert rows(timers.interval(spark, 100, 251, 50), "tick", "ts_ns") == [(0, 100), (1, 150), (2, 200), (3, 250)]
    assert timers.interval(spark, 5, 5, 1).count() == 0
    plan = [("schedule", 9), ("schedule", 4), ("schedule", 7), ("schedule", 1), ("poll", 0), ("schedule", 6), ("poll", 0)]
    df = spark.createDataFrame([("n", 10 * (k == 6) + k, k, a, m) for k, (a, m) in enumerate(plan)], "node string, ts_ns long, id long, action string, maturity_ns long")
    got = [(r["fired"], r["dropped"]) for r in timers.scheduler(df, 3).orderBy("id").collect()]
    assert got == [([], False), ([], False), ([], False), ([], True), ([1], False), ([], False), ([5, 2, 0], False)]


def acts(spark, name, *events):
    return spark.createDataFrame([(k, k, "k", *e) for k, e in enumerate(events)], f"ts long, id long, {name} string, action string, payload string")


def test_limits_queues_holds(spark):
    df = acts(spark, "name", ("acquire", ""), ("acquire", ""), ("release", ""), ("acquire", ""), ("release", ""), ("release", ""), ("acquire", ""))
    assert rows(coordination.limit(df, 1), "id", "granted", "inflight") == [(0, True, 1), (1, False, 1), (3, True, 1), (6, True, 1)]
    q = acts(spark, "queue", ("enqueue", "a"), ("enqueue", "b"), ("enqueue", "c"), ("dequeue", None), ("dequeue", None), ("dequeue", None))
    assert [tuple(r) for r in coordination.serialize(q, 2).orderBy("id").select("taken", "dropped", "depth").collect()] == [(None, False, 1), (None, False, 2), (None, True, 2), ("b", False, 1), ("c", False, 0), (None, False, 0)]
    h = acts(spark, "slot", ("stash", "a"), ("stash", "b"), ("flush", None), ("flush", None), ("stash", "c"), ("flush", None))
    assert rows(coordination.hold(h).fillna("-"), "id", "taken") == [(2, "b"), (3, "-"), (5, "c")]
    stashes = [("a", "stash", "1"), ("b", "stash", "2"), ("c", "stash", "3"), ("a", "stash", "4"), ("a", "flush", None), ("c", "stash", "5"), ("c", "flush", None), ("a", "flush", None)]
    t = spark.createDataFrame([("n", k, k, *e) for k, e in enumerate(stashes)], "node string, ts long, id long, slot string, action string, payload string")
    got = [(r["taken"], r["dropped"]) for r in coordination.hold_table(t, 2).orderBy("id").collect()]
    assert got == [(None, False), (None, False), (None, True), (None, False), ("4", False), (None, False), ("5", False), (None, False)]
    queue = [("push", 0), ("push", 1), ("push", 2), ("drain", 3), ("push", 4), ("drain", 5), ("drain", 6), ("push", 7)]
    o = spark.createDataFrame([("p", k, k, a) for a, k in queue], "peer string, ts_ns long, id long, action string")
    assert rows(health.outbound_queue(o, 2).fillna(-1), "id", "status", "drained_by") == [(0, "dropped", -1), (1, "shipped", 3), (2, "shipped", 3), (4, "shipped", 5), (7, "queued", -1)]
    assert health.outbound_queue(o, None).filter("status = 'dropped'").count() == 0


def test_deadline_check_deals_rows_by_their_number(spark, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(joins, "PART_ROWS", 1_000)
    out = __spark_entry__.queries()["deadline_check"](spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 3_000  # four shuffle partitions would have 15,000 each
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_latches_and_deadlines(spark):
    df = spark.createDataFrame([(1, 1, "g", 5), (2, 2, "g", 6), (3, 3, "h", 7), (4, 4, "", 8), (5, 5, "", 9)], "ts long, id long, g string, value long")
    assert rows(coordination.first_arrival(df, ["g"]), "id") == [(1,), (3,), (4,), (5,)]
    then, late = (spark.createDataFrame(r, "exec_id long, ts long") for r in ([(1, 5), (2, 9), (3, 4)], [(1, 7), (2, 8), (3, 4), (4, 1)]))
    assert rows(coordination.deadline_match(then, late), "exec_id", "winner", "ts") == [(1, "then", 5), (2, "timeout", 8), (3, "then", 4), (4, "timeout", 1)]
    ok, bad = coordination.deadline_check(df, F.col("ts"), F.lit(3))
    assert rows(ok, "id") == [(1,), (2,)] and rows(bad, "id", "reason")[0] == (3, "Timeout")
    assert [x.count() for x in coordination.deadline_check(df, F.col("ts"), F.lit(None).cast("long"))] == [5, 0]
    with pytest.raises(ValueError, match="reserved"):
        coordination.app_emit(df, "infra.x")
    assert rows(coordination.record(df, 2, "g", ["ts"]), "id") == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(coordination.record(df, 1, "g", ["ts"], names=2), "id") == [(2,), (3,)]
    assert rows(coordination.gate_dispatch(df.withColumn("exec_id", F.lit(1)), 3, input_col="g"), "ready_ts") == [(4,)]


def link(spark, *ok):
    return spark.createDataFrame([(k, k, "p", o) for k, o in enumerate(ok)], "ts_ns long, id long, peer string, ok boolean")


def test_backoff_and_governor(spark):
    df = link(spark, False, False, False, False, False, True, False)
    got = [r["delay_ns"] for r in health.backoff(df).orderBy("id").collect()]
    assert got == [10_000_000 * 2**k for k in range(5)] + [0, 10_000_000]
    assert rows(health.governor(df), "id", "state") == [(4, "down"), (5, "up")]
    capped = spark.range(1).select(health.backoff_delay(F.lit(10_000)))
    assert capped.first()[0] == health.BACKOFF_CAP_NS


def test_round_trip_times(spark):
    df = spark.createDataFrame([("s", 1, 800), ("s", 2, 1600)], "site string, seq long, sample_ns long")
    assert rows(health.rtt_ema(df), "srtt", "rttvar", "budget_ns", "warm") == [(800, 400, 2400, False), (900, 500, 2900, False)]


def test_failure_detection(spark):
    df = spark.createDataFrame([(t, k, "p") for k, t in enumerate([0, 10, 20, 30, 530, 540])], "ts_ns long, id long, peer string")
    states = rows(health.scan_phi(health.phi_accrual(df)), "id", "state")
    assert states == [(4, "down"), (5, "up")]


def test_pressure_and_requests(spark):
    seq = [(0, 10), (1, 80), (2, 80), (20, 80), (40, 80), (60, 80), (61, 10)]
    df = spark.createDataFrame([(t, k, "p", d, False) for k, (t, d) in enumerate(seq)] + [(70, 9, "p", 80, True)], "ts_ns long, id long, peer string, depth int, back boolean")
    got = [r["verdict"] for r in health.backpressure(df, 100, 10, recovered="back").orderBy("id").collect()]
    assert got == ["pass", "notice", "suppress", "notice", "notice", "drop", "pass", "notice"]
    req, ans = spark.createDataFrame([(1, 0), (2, 0), (3, 90)], "req_id long, ts_ns long"), spark.createDataFrame([(1, 8), (1, 5)], "req_id long, ts_ns long")
    assert rows(health.request_tracker(req, ans, 100, 50).fillna(-1), "req_id", "rtt_ns", "status") == [(1, 5, "done"), (2, -1, "stale"), (3, -1, "inflight")]


def test_gates(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "a", "x"), (3, 3, "b", "x")], "ts long, id long, src_peer string, payload string")
    assert rows(health.dedup_gate(df), "id") == [(1,), (3,)] and rows(health.dedup_gate(df, ["payload"]), "id") == [(1,)]
    window = spark.createDataFrame([(k, k, "r", p) for k, p in enumerate("abcabda")], "ts long, id long, r string, p string")
    assert rows(health.dedup_count_window(window, "r", "p", 2), "id") == [(0,), (1,), (2,), (3,), (4,), (5,), (6,)]
    assert rows(health.dedup_count_window(window, "r", "p", 3), "id") == [(0,), (1,), (2,), (5,), (6,)]
    attempts = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3), ("d", 5, 4)], "peer string, ts_ns long, id long")
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "peer string")
    state = spark.createDataFrame([("c", 1, 6), ("d", 1, 5), ("c", 7, 900)], "peer string, ts_ns long, next_retry_ns long")
    out = health.peer_health_gate(attempts, one("a"), one("a", "c", "d"), state)
    assert rows(out.fillna("-").fillna(-1), "peer", "reason", "retry_ns") == [("a", "Blocked", -1), ("b", "NotAllowed", -1), ("c", "Cooldown", 6), ("d", "-", -1)]
    assert rows(health.peer_health_gate(attempts, one("a")).fillna("-"), "peer", "reason")[:2] == [("a", "Blocked"), ("b", "-")]


def test_gates_look_at_the_state_of_their_time(spark):
    """A failure in the future does not bar an attempt in the past, and a success clears."""
    state = spark.createDataFrame([("a", 1, 4), ("a", 8, 900), ("a", 950, None), ("b", 5, 7)], "peer string, ts_ns long, next_retry_ns long")
    attempts = spark.createDataFrame([("a", t, t) for t in (0, 1, 3, 4, 7, 8, 899, 900, 940, 951)] + [("b", 4, 104), ("b", 5, 105), ("b", 7, 107), ("c", 1, 201)], "peer string, ts_ns long, id long")
    assert [i for (i,) in rows(health.backoff_gate(attempts, state), "id")] == [0, 4, 7, 104, 107, 201, 900, 940, 951]
    assert health.backoff_gate(attempts, state.limit(0)).count() == 14


def test_a_hot_key_is_folded_without_gathering_it(spark):
    df = spark.range(20_000).selectExpr("0 AS k", "id")
    out = ordered_fold(df, ["k"], ["id"], lambda: 0, lambda s, r: (s + r["id"], {"total": s + r["id"]}), "total long")
    assert out.agg(F.max("total")).first()[0] == sum(range(20_000))
