import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from storefront.llm import conversation_trie, running
from storefront.llm.conversation_trie import forked_trie, prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_turns(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in convs.items()}


def plain_forks(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, children, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            min(members[n]),
            len(n),
            min(members[n[:-1]]) if n else -1,
            len(members[n]),
            len(children[n]),
            leaves[n],
            saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n in members
    )


def got(rows):
    return sorted(tuple(-1 if r[n] is None else r[n] for n in NAMES) for r in rows.collect())


def talks(seed=5):
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        first = "hot" if c % 3 == 0 else f"first {rng.randrange(12)}"
        turns = [first, *(f"t{rng.randrange(3)} é" for _ in range(rng.randrange(0, 7)))]
        rows += [(c, n, "user" if n % 2 == 0 else "assistant", t) for n, t in enumerate(turns)]
    for c in (200, 201):  # the same, long
        rows += [(c, n, "user", f"step {n}") for n in range(30)]
    rows += [(202, n, "user", f"step {n}") for n in range(20)]
    rows += [(203, n, "user", f"own {n}") for n in range(60)]
    rows += [(300, 0, None, None), (300, None, "system", None), (301, 1, "user", "a"), (301, 1, "system", "a")]
    rows += [(302, 0, "user", "same"), (302, 0, "user", "same"), (None, 0, "user", "nobody"), (-7, 0, "user", "below"), (-5, 0, "user", "zero")]
    rows += [(303, 0, "user", "x" * 200_000), (304, 0, "user", ""), (305, 0, "", "user")]
    rng.shuffle(rows)
    return rows


def test_against_plain_version(spark):
    rows = talks()
    table = spark.createDataFrame(rows, COLUMNS).repartition(7)
    assert got(prefix_trie(table)) == plain_trie(plain_turns(rows))
    assert got(forked_trie(table)) == plain_trie(plain_forks(plain_turns(rows)))


def test_hot_conversation_and_node_in_many_ranges(spark, monkeypatch):
    """One conversation and one node span several ranges; pieces are small."""
    monkeypatch.setattr(conversation_trie, "PIECE", 40)
    rows = [(1, n, "user", f"turn {n % 4}") for n in range(900)]
    rows += [(c, 0, "user", "all the same") for c in range(10, 700)]
    table = spark.createDataFrame(rows, COLUMNS).repartition(5)
    expected = plain_turns(rows)
    nodes = got(prefix_trie(table))
    assert [n for n in nodes if n[1] < 3] == [n for n in plain_trie({**expected, 1: expected[1][:3]}) if n[1] < 3]
    assert len(nodes) == 902 and max(n[1] for n in nodes) == 900


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 5, 9, 12]), n, rng.randrange(1 << 60)) for n in range(4000)]
    table = spark.createDataFrame(rows, "k long, o long, v long").repartition(6)
    ranges = running.in_ranges(table, "k", table["o"])
    sums = {r["o"]: r["v"] for r in running.running(ranges.withColumn("v", ranges["v"] % 1000), "k", ["v"], running.SUM).collect()}
    xors = {r["o"]: r["v"] for r in running.running(ranges, "k", ["v"], running.XOR).collect()}
    total, mixed = defaultdict(int), defaultdict(int)
    for k, o, v in rows:
        total[k] += v % 1000
        mixed[k] ^= v
        assert (sums[o], xors[o]) == (total[k], mixed[k])


def test_odd_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert prefix_trie(none).collect() == [] and forked_trie(none).collect() == []
    nobody = spark.createDataFrame([(None, 0, "user", "x")], COLUMNS)
    assert forked_trie(nobody).collect() == []
    rows = [(7, None, None, None)]
    clash = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS depth", "2 AS k1", "3 AS place", "'x' AS ids", "4 AS n_convs")
    assert got(prefix_trie(clash)) == plain_trie(plain_turns(rows))
    assert got(forked_trie(clash)) == plain_trie(plain_forks(plain_turns(rows)))


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_query_on_its_table(spark, scale):
    from storefront.llm.queries import op12_peeled_trie

    folder = f"/root/testdata/{scale}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_peeled_trie(spark, folder)) == plain_trie(plain_forks(plain_turns(rows)))
