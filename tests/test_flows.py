from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowframe.functions import bits, types
from flowframe.operators import combine, joins, metrics, ordered, replicate, routing, rsm, sync
from flowframe.plans.catalog import FlowCatalog
from flowframe.plans.config import load, parse
from flowframe.plans.spec import FlowSpec
from flowframe.sources import delimited, relations

PAIR = (("key", "INT"), ("value", "INT"))


def spec(**changes):
    return FlowSpec(**({"name": "f", "kind": "shuffle", "columns": PAIR, "targets": (1, 2)} | changes))


@pytest.mark.parametrize(
    "changes",
    [
        {"name": ""}, {"kind": "other"}, {"targets": ()}, {"targets": (1, 1)}, {"key": 10}, {"key": "none"}, {"columns": (("a", "INT"), ("a", "INT"))},
        {"columns": (("a", "TEXT"),)}, {"sources": 0}, {"kind": "combine"}, {"kind": "combine", "aggregate": "median"},
    ],
)
def test_bad_definitions_fail(changes):
    with pytest.raises(ValueError):
        spec(**changes)


def test_layout_is_packed():
    assert [r[2:] for r in types.layout([("a", "TINYINT"), ("b", "BIGUINT"), ("c", "INT")])] == [(0, 1), (1, 8), (9, 4)]
    assert spec().tuple_size == 8


def test_key_routing_example(spark):
    rows = spark.createDataFrame([(3, 10), (8, 20)], "key int, value int")
    assert dict(routing.shuffle(rows, spec()).select("key", "target_id").collect()) == {3: 2, 8: 1}


def test_alternating_explicit_targets(spark):
    rows = spark.range(1000).select((F.col("id") % 2 + 1).alias("value"))
    out = routing.shuffle(rows, spec(columns=(("value", "BIGINT"),)), routing.explicit("value"), physical=True)
    seen = out.withColumn("p", F.spark_partition_id()).groupBy("target_id", "p").count().collect()
    assert sorted((r.target_id, r["count"]) for r in seen) == [(1, 500), (2, 500)]
    assert len({r.p for r in seen}) == 2


def test_unknown_target_fails_when_checked(spark):
    rows = spark.createDataFrame([(1, 9)], PAIR[0][0] + " int, value int")
    with pytest.raises(Exception, match="no target 9"):
        routing.shuffle(rows, spec(), routing.explicit("value"), check=True).collect()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20), st.integers(1, 9))
def test_unsigned_mod(spark, keys, n):
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", types.unsigned_mod(F.col("k"), n).alias("m"), types.unsigned(F.col("k")).alias("u")).collect()
    assert all(r.m == (r.k % 2**64) % n and int(r.u) == r.k % 2**64 for r in rows)


def test_wrapping(spark):
    r = spark.createDataFrame([(300, 70000)], "a long, b long").select(types.wrap(F.col("a"), 8).alias("x"), types.wrap(F.col("b"), 16).alias("y"), types.wrap_long(F.lit(Decimal(2**63)).cast("decimal(38,0)")).alias("z")).first()
    assert tuple(r) == (44, 4464, -(2**63))


def test_packing_round_trip(spark):
    rows = spark.range(0, 5000, 7).select(F.col("id").alias("k"), (F.col("id") % 1000).alias("v"))
    k, v = bits.unpack_pair(bits.pack_pair(F.col("k"), F.col("v")))
    rk, rv = bits.unpack_radix(bits.pack_radix(F.col("k"), F.col("v"), 4), bits.radix(F.col("k"), 4), 4)
    assert rows.where((k != F.col("k")) | (v != F.col("v")) | (rk != F.col("k")) | (rv != F.col("v"))).count() == 0
    assert [bits.next_power_of_two(n) for n in (0, 1, 3, 8, 9)] == [1, 1, 4, 8, 16]


def test_node_ranges_agree(spark):
    got = {r.id: r.n for r in spark.range(16).select("id", bits.node_of_partition(F.col("id"), 16, 3).alias("n")).collect()}
    assert all(got[p] == node for node in (1, 2, 3) for p in bits.partitions_of_node(node, 16, 3))


def test_catalog(spark):
    flows = FlowCatalog(spark)
    flows.register(spec(name="flow_a", sources=2))
    with pytest.raises(ValueError):
        flows.register(spec(name="flow_a"))
    rows = spark.createDataFrame([(3, 10)], "key int, value int")
    flows.bind("flow_a", rows, rows)
    assert spark.sql("select sum(value) s from flow_a").first().s == 20
    flows.drop("flow_a")
    with pytest.raises(LookupError):
        flows.get("flow_a")
    flows.register(spec(name="flow_a"))
    assert flows.names() == ["flow_a"]
    with pytest.raises(ValueError, match="unknown nodes"):
        FlowCatalog(spark, nodes=(1, 2)).register(spec(nodes=(1, 3)))


def test_settings_are_loaded(spark, tmp_path):
    (tmp_path / "flow.conf").write_text("# c\nSegments = 8\n")
    load(spark, str(tmp_path / "flow.conf"))
    assert spark.conf.get("flowframe.segments") == "8"


def test_settings_file():
    assert parse("# c\n A = 1\n;x=2\nB=  two words \nbad\n") == {"A": "1", "B": "two words"}


def test_replicate_and_empty(spark):
    rows = spark.range(100)
    out = replicate.replicate(rows, (1, 2))
    assert out.groupBy("target_id").agg(F.sum("id")).collect() == [(1, 4950), (2, 4950)] or out.count() == 200
    assert replicate.replicate(rows.where("false"), (1, 2)).count() == 0


@settings(max_examples=2, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=40))
def test_ordered_helpers_match_python(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    seq = {r.i: r.seq for r in ordered.sequence(rows, "v", "i", ranges=4).collect()}
    assert seq == {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    parts = rows.withColumn("g", F.when(F.col("v") % 3 != 0, F.col("v") % 3))
    own = {r.i: (r.g, r.n, r.top, r.low) for r in ordered.running_min(ordered.running_max(ordered.sequence(parts, "i", name="n", by="g", ranges=4), "i", "v", name="top", by=("g",), ranges=4), "i", "v", by=("g",), ranges=4).collect()}
    for i, (g, n, top, low) in own.items():
        past = [v for k, v in enumerate(values[:i]) if own[k][0] == g]
        assert (n, top, low) == (len(past), max(past, default=None), min(past, default=None))
    high = {r.i: r.high for r in ordered.running_max(rows, "i", "v", ranges=4).collect()}
    assert high == {i: max(values[:i], default=None) for i in range(len(values))}
    before = {r.i: r.before for r in ordered.running_sum(rows, "i", "v", ranges=4).collect()}
    assert before == {i: sum(values[:i]) for i in range(len(values))}


def test_gaps_and_late_rows(spark):
    got = spark.createDataFrame([(0, 0), (1, 1), (2, 4), (3, 3), (4, 4), (5, 6)], "arrival long, seq long")
    assert [r.seq for r in replicate.drop_late(got, "arrival").orderBy("arrival").collect()] == [0, 1, 4, 6]
    assert [tuple(r) for r in replicate.gaps(got.select("seq")).orderBy("gap_start").collect()] == [(2, 2, 1), (5, 5, 1)]
    sent = spark.range(7).select(F.col("id").alias("seq"))
    assert {r.seq for r in replicate.delivery_status(sent, got.select("seq")).where("status = 'LOST'").collect()} == {2, 5}
    assert replicate.loss_limit(64, 2) == 29


def test_combine_wide_means(spark):
    rows = spark.createDataFrame([([float(i) for i in range(128)],), ([float(i + 128) for i in range(128)],)], "v array<double>")
    got = combine.combine_vectors(rows, "mean", "v").collect()
    assert {r.pos: r.value for r in got} == {i: i + 64.0 for i in range(128)}
    assert all(r.tuples_consumed == 2 for r in got)


def test_zero_seed(spark):
    rows = spark.createDataFrame([(-3.0,), (-5.0,)], "x double")
    assert rows.agg(combine.aggregate("max", F.col("x"), True), combine.aggregate("min", F.col("x"), True), combine.aggregate("mult", F.col("x"))).first() == (0, -5, 15)


def test_sync_order_is_round_robin(spark):
    lengths = {0: 5, 1: 2, 2: 4}
    rows = spark.createDataFrame([(s, i, 10 * s + i) for s, n in lengths.items() for i in range(n)], "s int, i int, x int")
    left, expected = {s: list(range(n)) for s, n in lengths.items()}, []
    while any(left.values()):
        expected += [10 * s + left[s].pop(0) for s in sorted(left) if left[s]]
    got: dict = {}
    for r in combine.sync_windows(rows, "s", "i", 3).collect():
        got.setdefault(r.window_id, set()).add(r.x)
    assert got == {k: set(expected[3 * k : 3 * k + 3]) for k in range(4)}


def test_integer_running_mean(spark):
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate((1, 2, 6))], "w int, i int, x int")
    assert combine.running_integer_mean(rows, "x", "i", ["w"]).first().mean == 2


@pytest.mark.parametrize("bits_", [None, 2])
def test_radix_join_counts_multiplicities(spark, bits_):
    left = spark.createDataFrame([(1,), (1,), (2,), (5,)], "a long")
    right = spark.createDataFrame([(1,), (2,), (2,), (3,)], "b long")
    joined = joins.radix_join(left, right, "a", "b", bits_)
    assert joins.match_count(joined).first().matches == 4
    assert joins.match_count(joins.replicate_join(left, right, "a", "b")).first().matches == 4
    assert joins.match_count(joins.replicate_join(left, right, "a", "b", rows=1)).first().matches == 4
    assert [r.b for r in joins.unmatched(right, left, "b", "a").collect()] == [3]
    assert "ShuffledHashJoin" in joined._jdf.queryExecution().toString()


def test_radix_bits_of_the_known_configuration():
    assert joins.radix_bits(2_048_000_000) == (8, 8)


def test_generated_relations(spark):
    left, right = relations.pkfk(spark, 103, 1030, 4)
    assert (left.count(), right.count(), left.select("key").distinct().count()) == (103, 1030, 103)
    assert right.agg(F.max("key")).first()[0] <= 103
    assert [r.key for r in relations.foreign_keys(spark, 5, 2, 4).orderBy("key").collect()] == [2, 2, 3, 3, 4]


def test_packed_files(spark, tmp_path):
    rows = relations.primary_keys(spark, 5, 25)
    relations.write_packed(rows, str(tmp_path / "p"))
    assert relations.read_packed(spark, str(tmp_path / "p")).orderBy("key").collect() == rows.collect()
    told = relations.write_binary(relations.random_order(rows, 3).coalesce(2), str(tmp_path / "raw"))
    assert told.agg(F.sum("rows")).first()[0] == 20
    back = relations.read_binary(spark, str(tmp_path / "raw"))
    assert back.orderBy("key").collect() == rows.collect()
    assert relations.read_binary(spark, str(tmp_path / "raw"), 1, 2).count() == 2 * told.where("rows > 2").count()
    (tmp_path / "r.bin").write_bytes(b"".join(k.to_bytes(8, "little") + (k * 2).to_bytes(8, "little") for k in range(10)))
    assert [tuple(r) for r in relations.read_binary(spark, str(tmp_path / "r.bin"), 2, 3).orderBy("key").collect()] == [(2, 4), (3, 6), (4, 8)]
    made = [relations.read_or_make(spark, str(tmp_path / "c"), lambda: spark.range(3)).count() for _ in range(2)]
    assert made == [3, 3]


def test_delimited(spark, tmp_path):
    line = F.lit("a|b|c")
    got = spark.range(1).select(delimited.field(line, 1), delimited.field(line, 9), delimited.varchar_length(F.lit("varchar(25)")), delimited.varchar_length(F.lit("int")), delimited.words(F.lit("x, y"))).first()
    assert tuple(got) == ("b", "c", 25, None, ["x", "y"])
    delimited.split_files(spark.range(10), str(tmp_path / "t"), 2, "id")
    assert delimited.read_tbl(spark, str(tmp_path / "t"), "id long").count() == 10
    delimited.append_log(spark.createDataFrame([(1, 2)], "a int, b int"), str(tmp_path / "log"))
    delimited.append_log(spark.createDataFrame([(3, 4)], "a int, b int"), str(tmp_path / "log"))
    assert delimited.read_log(spark, str(tmp_path / "log")).count() == 2
    delimited.write_latencies(spark.range(3), "id", 7, str(tmp_path / "lat"))
    assert {r.value for r in spark.read.text(str(tmp_path / "lat")).collect()} == {"0", "1", "2", "throughput 7"}


def test_log_operators(spark):
    log = spark.createDataFrame([(1, "READ", 7, None), (2, "WRITE", 7, 10), (3, "WRITE", 7, 11), (4, "READ", 7, None)], "slot long, op string, key long, value long")
    assert {r.slot: r.result for r in rsm.kv_reads(log).collect()} == {1: None, 4: 11}
    assert {r.slot: r.result for r in rsm.kv_reads(log, "first").collect()} == {1: None, 4: 10}
    assert rsm.kv_state(log, "first").first().value == 10
    assert tuple(rsm.gapless_until(log.where("slot <> 3")).first()) == (2, 4)
    assert tuple(rsm.gapless_until(log.where("slot > 1")).first()) == (0, 4)
    assert tuple(rsm.verify(log, log.where("slot <> 2")).first()) == (4, 0, 1)
    acks = spark.createDataFrame([(1, 1, 1, 5, False), (1, 2, 1, 5, True), (1, 3, 1, 6, False), (1, 4, 1, 5, False)], "reqid int, t int, viewid int, slot int, leader boolean")
    assert rsm.leader_quorum(acks, 5, "reqid", "t").first().asDict() == {"reqid": 1, "viewid": 1, "slot": 5, "agreeing": 3, "leader_agrees": True, "committed": True}
    assert rsm.quorum_commit(acks, 5, "reqid", "t").first().t == 3


def test_percentile_place(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)], "g string, v int")
    assert metrics.percentiles(rows, "v", "g", (0.5, 0.9)).orderBy("percentile").select("latency").collect() == [(5,), (9,)]
    out, seen = metrics.counted(rows, "n")
    out.collect()
    assert seen.get["rows"] == 10


def test_lead_gaps(spark):
    got = spark.createDataFrame([(2, "READ", 7, None), (3, "WRITE", 7, 1), (6, "READ", 8, None)], "slot long, op string, key long, value long")
    acks = spark.createDataFrame([(1, 2), (1, 2), (4, 2), (4, 3), (5, 4), (5, 5), (5, 2)], "slot long, replica int")
    out = {r.slot: (r.op, r.acks, r.agreed) for r in rsm.lead_gaps(got, acks, 5).collect()}
    assert out == {1: ("NOOP", 1, False), 2: ("READ", 0, True), 3: ("WRITE", 0, True), 4: ("NOOP", 2, True), 5: ("NOOP", 3, True), 6: ("READ", 0, True)}
    assert rsm.lead_gaps(got.where("false"), acks, 5).count() == 0


@pytest.mark.parametrize("kind", ["TINYINT", "SMALLINT", "INT", "BIGINT", "BIGUINT"])
def test_whole_number_arithmetic(spark, kind):
    import itertools

    bits_ = 8 * types.TYPES[kind][0]
    signed = kind != "BIGUINT"
    low, high = (-(2 ** (bits_ - 1)), 2 ** (bits_ - 1) - 1) if signed else (0, 2**64 - 1)
    some = sorted({low, low + 1, high, high - 1, 0, 1, 7, high // 3} | ({-1, -7} if signed else set()))
    pairs = [(Decimal(a), Decimal(b)) for a, b in itertools.product(some, some)]
    t = types.TYPES[kind][1]
    rows = spark.createDataFrame(pairs, "a decimal(20,0), b decimal(20,0)").select(F.col("a").cast(t).alias("a"), F.col("b").cast(t).alias("b"))
    ops = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: None if b == 0 else abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)}

    def fit(x):
        return x if x is None else (x - low) % 2**bits_ + low

    for op, plain in ops.items():
        for r in rows.select("a", "b", types.arithmetic(op, kind, F.col("a"), F.col("b")).alias("x"), types.arithmetic(op, kind, F.col("a"), 1000).alias("y")).collect():
            a, b = int(r.a), int(r.b)
            assert (r.x if r.x is None else int(r.x)) == fit(plain(a, b)), (op, a, b)
            assert int(r.y) == fit(plain(a, 1000)), (op, a)
    assert rows.select(types.lesser(kind, F.col("a"), F.col("b")).alias("x")).agg(F.min("x")).first()[0] == low


def test_floating_arithmetic_and_defaults(spark):
    rows = spark.createDataFrame([(1.5, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 3.0)], "a double, b double").coalesce(1)
    got = [r.x for r in rows.select(types.arithmetic("/", "DOUBLE", F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3] == 1 / 3
    narrow = rows.select(types.arithmetic("*", "FLOAT", F.col("a").cast("float"), 3).alias("x"), *[types.default_value(k).alias(k) for k in types.TYPES])
    assert narrow.first().x == 4.5 and all(narrow.schema[k].dataType == t for k, (_, t) in types.TYPES.items()) and set(narrow.first()[1:]) == {0}


def test_typed_arithmetic_of_all_pairs_matches_sql(spark, tmp_path):
    import duckdb

    from flowframe import catalogue

    events, got = tmp_path / "events.parquet", tmp_path / "got.parquet"
    # ids repeat their pairs of tiny values after 256 * 251 rows; -128 / -1 is at 48640
    spark.range(256 * 251).selectExpr("id AS event_id", "id / 7.0D AS value").write.parquet(str(events))
    catalogue.QUERIES["typed_arithmetic"](spark, str(tmp_path)).write.parquet(str(got))
    assert spark.read.parquet(str(got)).where("event_id = 48640").first().div8 == 128
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS FROM '{events}/*.parquet'")
        db.execute(f"CREATE TABLE want AS {catalogue.ORACLE_SQL['typed_arithmetic']}")
        db.execute(f"CREATE TABLE got AS SELECT {', '.join(r[0] for r in db.execute('DESCRIBE want').fetchall())} FROM '{got}/*.parquet'")
        assert db.execute("SELECT count(*) FROM got").fetchall() == [(256 * 251,)]
        for one, other in (("want", "got"), ("got", "want")):
            assert db.execute(f"FROM {one} EXCEPT ALL FROM {other}").fetchall() == []


def test_consumer_of_each_target(spark):
    import pyarrow as pa

    routed = routing.shuffle(spark.range(100).select(F.col("id").alias("key"), F.col("id").alias("value")), spec())
    out = routing.consume(routed, lambda target, batches: (pa.RecordBatch.from_arrays([pa.array([target] * b.num_rows), b.column("key")], ["t", "k"]) for b in batches), "t long, k long").collect()
    assert len(out) == 100 and all(r.t == r.k % 2 + 1 for r in out)


def test_barrier(spark):
    rows = sync.counts_seen(spark.range(10), 3).collect()
    assert sorted(map(tuple, rows)) == [(k, 3, 10) for k in range(3)]
    assert sync.barrier_map(spark.range(4).repartition(2), "n long", lambda it: [(len(list(it)),)]).agg(F.sum("n")).first()[0] == 4
