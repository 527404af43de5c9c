"""Newest turns within the budget, leading assistant turns dropped."""
from quire.operators.memory import conversation_tail


def test_tail(spark):
    rows = [(1, 0, "user", "a b c"), (1, 1, "assistant", "d e"), (1, 2, "user", "f"),
            (1, 3, "assistant", "g h i j"),
            (2, 0, "user", "x " * 10),                       # alone over the budget
            (3, 0, "assistant", "a"), (3, 1, "user", "b"), (3, 2, "assistant", "c")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["turn"]) for r in conversation_tail(conv, budget=7).collect())
    # conv 1: running from newest 4,5,7,10 -> turns 3,2,1 fit; turn 1 is a leading assistant turn
    # conv 3: all fit; turn 0 is a leading assistant turn
    assert got == [(1, 2), (1, 3), (3, 1), (3, 2)]


def test_tail_matches_brute_force(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", "system"]),
                         " ".join("w" for _ in range(rnd.randint(1, 6)))))
    budget = 9
    want = set()
    for c in range(40):
        turns = sorted([r for r in rows if r[0] == c], key=lambda r: -r[1])
        kept, total = [], 0
        for r in turns:
            total += len(r[3].split())
            if total > budget:
                break
            kept.append(r)
        kept = sorted(kept, key=lambda r: r[1])
        while kept and kept[0][2] == "assistant":
            kept.pop(0)
        want |= {(r[0], r[1]) for r in kept}
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]) for r in conversation_tail(conv, budget=budget).collect()}
    assert got == want


def _by_hand(rows, budget, count):
    want = set()
    for c in {r[0] for r in rows}:
        kept, total = [], 0
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: -r[1]):
            total += count(r[3])
            if total > budget:
                break
            kept.append((r[0], r[1], r[2], total))
        kept.reverse()
        while kept and kept[0][2] == "assistant":
            kept.pop(0)
        want |= {(r[0], r[1], r[3]) for r in kept}
    return want


def test_a_callers_counter_matches_brute_force(spark):
    import random
    from pyspark.sql import functions as F
    rnd = random.Random(8)
    rows = [(c, t * rnd.randint(1, 3) * 1000 + t, rnd.choice(["user", "assistant", "system"]), "w" * rnd.randint(0, 4))
            for c in range(30) for t in range(rnd.randint(1, 60))]
    rows = list({r[:2]: r for r in rows}.values())
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget in (0, 20, 1000):
        got = conversation_tail(conv, budget, count_tokens=F.length).collect()
        assert {(r["conv_id"], r["turn"], r["running"]) for r in got} == _by_hand(rows, budget, len)
        assert len(got) == len({(r["conv_id"], r["turn"]) for r in got})


def test_a_million_turns_are_not_one_task(spark):
    from pyspark.sql import functions as F
    n = 1_000_000
    conv = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.when(F.col("id") % 4 == 0, "abc").otherwise("").alias("text"))
    # Shuffled joins and small partitions, as with turns of full size.
    for_size = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64",
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in for_size}
    for k, v in for_size.items():
        spark.conf.set(k, v)
    try:
        tail = conversation_tail(conv, budget=3 * 100_000, count_tokens=F.length)
        sizes = [r[0] for r in tail.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = tail.agg(F.count("*"), F.min("turn"), F.max("running")).first()
    # the 100,000 newest turns with text and all empty ones from the next older text on, less leading assistant turns
    assert got[1] == n - 4 * 100_000 - 2 and got[0] == n - got[1] and got[2] == 300_000
    assert max(sizes) <= n / 8
