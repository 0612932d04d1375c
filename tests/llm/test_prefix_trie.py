"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tradewake.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string, depth int, name string, i int, least long, n string"


def brute(rows):
    """Rows (conv_id, turn, role, text) to all nodes, sorted."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), name, role, text))
    own = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        s = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(s) + 1):
            members[s[:d]].append((conv, len(s) == d))
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    totals = {}
    for s in sorted(members, key=len, reverse=True):
        saved = (len(members[s]) - 1) * len(s[-1][1]) if s else 0
        below = [totals[c] for c in children[s]]
        totals[s] = (sum(x for x, _ in below) or 1, saved + sum(y for _, y in below))
    return sorted(
        (
            min(members[s])[0],
            len(s),
            min(members[s[:-1]])[0] if s else None,
            len(members[s]),
            len(children[s]),
            *totals[s],
            hashlib.sha256(",".join(str(c) for c, end in sorted(members[s]) if end).encode()).hexdigest(),
        )
        for s in members
    )


def built(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "a", 2, 3, "b") for r in rows], KIND)
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(spark, frame.repartition(3)).collect())


def grown(seed, convs, longest, texts):
    """Conversations that branch off each other at any turn."""
    draw = random.Random(seed)
    told, rows = [], []
    for conv in draw.sample(range(1000), convs):
        start = draw.choice(told)[: draw.randint(0, longest)] if told and draw.random() < 0.8 else []
        more = draw.randint(0 if start else 1, longest - len(start))
        s = [*start, *((draw.choice(("user", "assistant", "")), draw.choice(texts)) for _ in range(more))]
        told.append(s)
        rows += [(conv, turn, *t) for turn, t in enumerate(s)]
    return rows


def test_short_conversations(spark):
    rows = grown(1, 150, 7, ["", "a", "bc", "é😀"])
    assert built(spark, rows) == brute(rows)


def test_long_conversations(spark):
    rows = grown(2, 40, 70, ["yes", "no"])
    want = brute(rows)
    assert max(r[1] for r in want) > 64
    assert built(spark, rows) == want


def test_one_group_holds_most_conversations(spark):
    same = [(conv, turn, "user", f"turn {turn}") for conv in range(5000, 5600) for turn in range(8)]
    rows = same + grown(3, 30, 5, ["x"])
    assert built(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [
        (None, 0, "user", "of no conversation"),
        (5, None, None, None),
        (5, 0, "user", "x"),
        (5, 0, "user", "x"),
        (5, 0, "user", "a tie"),
        (5, -3, "assistant", ""),
        (100, 7, "", "x" * 200_000),
        (101, 7, "", "x" * 200_000),
        (-7, 1, "user", "negative"),
        (0, 1, "1", "2:3"),
        (0, 2, "12", ":3"),
        *((c, 0, "user", "one turn") for c in [*range(200, 230), *range(331, 340)]),
    ]
    want = brute(rows)
    assert any(r[1] == 0 and r[7] != prefix_trie.EMPTY for r in want)
    assert built(spark, rows) == want


def test_conversations_without_any_turn_left(spark):
    rows = [(c, 0, "user", "x") for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6]
    want = brute(rows)
    assert len(want) == 1
    assert built(spark, rows) == want
    assert built(spark, []) == []


def test_pieces_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    frame = spark.range(-50, 70).select(
        F.lit(3).cast("long").alias("depth"), (F.col("id") % 2).alias("conv_id"), F.col("id").alias("member")
    )
    got = {r["conv_id"]: r["ends_sha256"] for r in prefix_trie.end_digests(frame).collect()}
    for key in (-1, 0, 1):
        ids = [i for i in range(-50, 70) if (abs(i) % 2) * (1 if i > 0 else -1) == key]
        assert got[key] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_conversations_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS", 4)
    rows = grown(4, 40, 30, ["yes", "no"])
    # A chain in which each conversation branches off the one before, and copies of its end.
    chain = [(c, t, "user", f"{min(t, 2 * c)}") for c in range(2000, 2012) for t in range(2 * (c - 1998))]
    chain += [(c, t, "user", f"{t}") for c in range(2100, 2112) for t in range(c - 2098)]
    assert built(spark, rows + chain) == brute(rows + chain)


def test_jobs_do_not_grow_with_the_longest_conversation(spark, monkeypatch):
    """Each table, join and exchange takes the driver's memory."""
    saved, save = [], prefix_trie.Scratch.save
    monkeypatch.setattr(prefix_trie.Scratch, "save", lambda self, frame, name: saved.append(name) or save(self, frame, name))

    def steps(turns):
        saved.clear()
        rows = [(c, t, "user", f"{t % 7} {t > c}", 1, "a", 2, 3, "b") for c in (1, 2, 40) for t in range(turns)]
        plan = prefix_trie.prefix_trie(spark, spark.createDataFrame(rows, KIND))._jdf.queryExecution().optimizedPlan()
        return len(saved), plan.toString().count("Join")

    assert steps(3) == steps(300)
    tables, joins = steps(300)
    assert tables <= 7 and joins <= 3
