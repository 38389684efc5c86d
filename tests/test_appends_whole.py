from collections import defaultdict

from tidelog import queries
from tidelog.sources.derived import activity_log


def test_appends_run_over_all_orders(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "events.parquet"))
    known = min(int(r.event_id) for r in events.select("event_id").collect())
    keys = [3, 7, 4000, 4001, 4004, 9_000, 9_000, 70_007, known + (-known % 7), 1_000_000]
    orders = [(k, (11 * i) % 40) for i, k in enumerate(keys)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))

    log = activity_log(spark, str(tmp_path)).select("bounded_context", "aggregate_type", "aggregate_id", "aggregate_version", "event_id").collect()
    heads, ids, versions, conflicts = {}, {r.event_id for r in log}, [], set()
    for r in log:
        heads[tuple(r)[:3]] = max(r.aggregate_version, heads.get(tuple(r)[:3], 0))
    put, uses = defaultdict(int), defaultdict(list)
    for key, customer in sorted(orders):
        who = (*(("Identity", "User") if customer % 2 == 0 else ("Sales", "Order")), str(customer))
        event_id = str(key) if key % 7 == 0 else f"n-{key}"
        put[who] += 1
        versions.append((*who, event_id, key, heads.get(who, 0) + put[who]))
        uses[event_id].append(who)
        if customer % 3 == 1 and who in heads or customer % 3 == 2 and heads.get(who) != 2:
            conflicts.add((*who, None, "version"))
    conflicts |= {(*(min(w[i] for w in who) for i in range(3)), e, "event_id") for e, who in uses.items() if len(who) > 1 or e in ids}

    columns = ("bounded_context", "aggregate_type", "aggregate_id", "event_id")
    got = queries.QUERIES["append_versions"](spark, str(tmp_path)).select(*columns, "ordinal", "aggregate_version").collect()
    assert sorted(map(tuple, got)) == sorted(versions)
    got = queries.QUERIES["append_conflicts"](spark, str(tmp_path)).select(*columns, "reason").collect()
    assert sorted(map(tuple, got), key=str) == sorted(conflicts, key=str)
