"""Each operator against a brute-force version, on the small tables and on edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.conftest import PASSAGE, WORDS, edge_rows, frame_of
from tradewake.llm import (
    chat,
    cotraining,
    decontamination,
    language_id,
    license_scan,
    near_dedup,
    packing,
    quality_rules,
    sharding,
    substrings,
    tokens,
)
from tradewake.llm.components import components
from tradewake.llm.shared import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


def got(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


EDGES = [(i, t) for i, t, *_ in edge_rows()]


# 1: shards


def test_further_shard_takes_rows_only_into_itself(documents):
    placed = sharding.assign_shards(documents, [1.0] * 24, [1.0] * 25)
    moved = placed.where("shard != grown_shard")
    assert moved.where("grown_shard != 24").count() == 0
    assert 0 < moved.count() < 0.15 * placed.count()


def test_weights_set_the_shares(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    placed = sharding.assign_shards(keys, [1.0, 2.0, 0.0, 5.0], [1.0, 2.0, 0.0, 2.0])
    count = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert set(count) == {0, 1, 3}
    assert abs(count[3] / 20_000 - 5 / 8) < 0.02
    # A lower weight of shard 3 moves rows out of it only.
    assert placed.where("shard != grown_shard and shard != 3").count() == 0


def test_shards_of_edge_cases(spark, edges, no_documents):
    placed = {}
    for r in sharding.assign_shards(edges, [1.0] * 3, [1.0] * 4).collect():
        placed.setdefault(r["doc_id"], set()).add((r["size"], r["text_crc32"], r["shard"], r["grown_shard"]))
    for i, text in EDGES:
        raw = (text or "").encode()
        ((size, crc, _, _),) = placed[i]
        assert (size, crc) == (len(raw) + 8, zlib.crc32(raw))
    assert sharding.assign_shards(no_documents, [1.0], [1.0]).count() == 0


def test_slots_have_no_gaps_even_with_repeats(spark, tmp_path):
    hot = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("t").alias("text"))
    hot.union(spark.range(100).select("id", F.lit("u"))).write.parquet(f"{tmp_path}/documents.parquet")
    slots = defaultdict(list)
    for r in sharding.op1_rendezvous_shards(spark, str(tmp_path)).collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 3100
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# 2: co-training


def test_quality_of_unlabelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = cotraining.quality_scores(spark, docs, labels.where("doc_id % 3 != 0"))
    asked = scored.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = np.mean([r["kept"] == (r["quality"] == 1) for r in asked])
    assert scored.count() == 1000 and len(asked) > 100 and right > 0.85


def test_exchange_uses_all_sure_documents_and_helps_with_few_labels(spark, monkeypatch):
    """Thirty labels of each class: the exchange changes the views and their balanced accuracy."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    by = Window.partitionBy("quality").orderBy(F.md5(F.col("doc_id").cast("string")))
    some = labels.withColumn("k", F.row_number().over(by)).where("k <= 30").drop("k")
    rest = labels.join(some.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("quality").alias("truth"))

    def balanced(rounds):
        told = cotraining.quality_scores(spark, docs, some, rounds=rounds).join(rest, "doc_id").collect()
        good, truth = (np.array([r[c] for r in told]) for c in ("kept", "truth"))
        return (np.mean(good[truth == 1]) + np.mean(~good[truth == 0])) / 2

    assert balanced(3) > balanced(0) > 0.9
    rows = docs.select("doc_id", "text", "lang", "source", F.length("text").cast("double").alias("chars"))
    a, b, _ = cotraining.train(Scratch(spark), rows, some, "quality", 0)
    monkeypatch.setattr(cotraining, "SURE", 0.0)
    sums = rows.repartition(7).mapInArrow(cotraining._sure_sums((a, b), np.array([5, 6])), cotraining._SUMS)
    added = sums.repartition("by", "y", "cell").mapInArrow(cotraining._added_sums, cotraining._SUMS).collect()
    assert len(added) <= 4 * cotraining.CELLS
    # However sure: each view gives every other document to both classes once.
    assert Counter({(r["by"], r["y"]): 0 for r in added}) | sum((Counter({(r["by"], r["y"]): r["n"]}) for r in added), Counter()) == Counter(
        {(by, y): docs.count() - 2 for by in (0, 1) for y in (0, 1)}
    )


def test_quality_of_edge_cases(spark, edges, no_documents):
    kind = "doc_id long, quality int, toxic int, text string"
    none = spark.createDataFrame([(1, None, 0, "x"), (None, 1, 0, "x"), (2, 5, 0, "x")], kind)
    scored = cotraining.quality_scores(spark, edges, none).collect()
    assert len(scored) == len(EDGES) and all(r["score"] == 0.5 and r["kept"] for r in scored)
    some = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(15)], kind)
    assert cotraining.quality_scores(spark, edges, some).count() == len(EDGES)
    assert cotraining.quality_scores(spark, no_documents, some).count() == 0


# 3: near-duplicates


def test_near_duplicates_equal_brute_force(spark, documents, rows, edges, no_documents):
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    assert got(near_dedup.near_duplicates(spark, documents), *columns) == sorted(brute.near_duplicates(rows))
    found = got(near_dedup.near_duplicates(spark, edges), *columns)
    assert found == sorted(brute.near_duplicates(EDGES))
    assert near_dedup.near_duplicates(spark, no_documents).count() == 0


def test_large_group_of_near_copies_and_chains(spark):
    def text(kind, changed):
        return " ".join(f"{kind}{j}" if j not in changed else f"{kind}x{changed[j]}" for j in range(200))

    rows = [(i, text("hub", {i % 180 + 5: i})) for i in range(400)]
    # Each differs from the next in 2 places; the first and the last are far apart.
    rows += [(1000 + i, text("chain", {k: 1 for k in range(5, 5 + 12 * i, 6)})) for i in range(20)]
    rows += [(2000 + i, text(f"alone{i}v", {})) for i in range(50)]
    found = near_dedup.near_duplicates(spark, frame_of(spark, [(*r, "en", "a") for r in rows]).repartition(5))
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    assert got(found, *columns) == sorted(brute.near_duplicates(rows))


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    for n in (40, 300, 3000):
        for _ in range(40):
            both = rng.integers(0, 2**64, int(n * 6 / 7), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, n - len(both), dtype=np.uint64)])) for _ in "ab")
            s, t = (near_dedup.odd_sketch(near_dedup.samples(x)).view(np.uint64) for x in (a, b))
            p, q = (near_dedup.set_parity(x).view(np.uint64) for x in (a, b))
            assert np.bitwise_count(s ^ t).sum() <= near_dedup.LIMIT
            assert np.bitwise_count(p ^ q).sum() <= near_dedup.set_limit(np.array([len(a) + len(b)]))[0]


def test_member_is_found_where_the_hub_is_nearest_but_not_similar(spark):
    rows = []
    for s in (2, 41, 114, 138):  # hub and member are near copies; only the member reaches 0.75 with the third
        hub = [f"s{s}w{j}" for j in range(330)]
        member = [*hub[:40], f"s{s}m", *hub[41:]]
        third = [f"s{s}x{j}" if 50 <= j < 131 and (j - 50) % 9 == 0 else w for j, w in enumerate(member)]
        rows += [(3 * s + k, " ".join(w)) for k, w in enumerate((hub, member, third))]
    found = near_dedup.near_duplicates(spark, frame_of(spark, [(*r, "en", "a") for r in rows]))
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(rows))


def test_one_of_each_group_stays_and_null_ids_stay(spark, edges):
    kept = near_dedup.without_near_duplicates(spark, edges)
    assert kept.columns == edges.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == sorted({c for _, _, c, _ in brute.near_duplicates(EDGES)})
    nameless = frame_of(spark, [(None, "some words of no document at all", "en", "a"), (None, None, "en", "a")])
    assert near_dedup.without_near_duplicates(spark, nameless).count() == 2


def test_components_of_a_long_chain(spark):
    links = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    links = links.union(links.where("a % 7 = 0").select("b", "a")).union(spark.createDataFrame([(900, 800), (3, 3)], "a long, b long"))
    found = got(components(Scratch(spark), links, "c"), "node", "component")
    assert found == sorted([(i, 0) for i in range(501)] + [(800, 800), (900, 800)])


# 4: licenses


def test_licenses_equal_brute_force(spark, edges, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = {(r["doc_id"], r["license"]) for r in license_scan.license_notices(spark, docs).collect()}
    assert found == brute.license_pairs(plain, license_scan.NOTICES) and len(found) > 10
    assert license_scan.license_notices(spark, edges).count() == 0
    assert license_scan.license_notices(spark, no_documents).count() == 0


def test_every_notice_is_found_at_any_place(spark):
    rows = []
    for k, notice in enumerate(license_scan.NOTICES.values()):
        for shift in range(0, 40, 3):
            rows.append((100 * k + shift, " ".join(WORDS[:shift]) + " " + notice + " " + " ".join(WORDS[: k * 9]), "en", "a"))
    found = license_scan.license_notices(spark, frame_of(spark, rows)).collect()
    names = list(license_scan.NOTICES)
    exact = {(r["doc_id"], r["license"]): r for r in found}
    for i, *_ in rows:
        r = exact[i, names[i // 100]]
        assert r["containment"] == 1.0 and r["place"] == i % 100


def test_whole_license_texts_and_short_notices(spark):
    texts = license_scan.license_texts()
    assert {"MIT-text", "BSD-text", "Apache-2.0-text", "GPL-3.0-text"} <= set(texts)
    rows, want = [], set()
    for k, (name, text) in enumerate(texts.items()):
        w = text.split()
        cut = len(w) // 8
        changed = " ".join(["other", "words"] * (cut // 2) + w[cut:])  # without its opening
        rows += [(10 * k, f"{' '.join(WORDS[:30])} {text} {' '.join(WORDS[30:60])}", "en", "a"), (10 * k + 1, changed, "en", "a"),
                 (10 * k + 2, " ".join(w[:cut]), "en", "a")]
        want |= {(10 * k, name), (10 * k + 1, name)}
    rows += [(900, "All Rights Reserved", "en", "a"), (901, "by us. All rights reserved. More", "en", "a"), (902, "all rights", "en", "a"), (903, "reserved", "en", "a")]
    notices = license_scan.SHORT_NOTICES | texts
    found = {(r["doc_id"], r["license"]): r for r in license_scan.license_notices(spark, frame_of(spark, rows), notices).collect()}
    short = {(i, "All-rights-reserved") for i in (900, 901)}
    assert {k for k in found if k[0] >= 900} == short
    assert {k for k in found if k[0] < 900 and k[1] != "All-rights-reserved"} == want
    for k, name in enumerate(texts):
        r = found[10 * k, name]
        assert r["containment"] == 1.0 and r["place"] == 30
    assert found[901, "All-rights-reserved"]["place"] == 2


# 5: packing


def test_packing_round_trip(spark, documents, rows):
    special = spark.createDataFrame([(-1, "a <|endoftext|> b"), (-2, "x<|endoftext|><|endoftext|>\n é")], "doc_id long, text string")
    documents = documents.select("doc_id", "text").union(special)
    rows = [*rows, *(tuple(r) for r in special.collect())]
    whole = Tokenizer.from_file(tokens.VOCABULARY)
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in packing.pack_documents(spark, documents).collect():
        own = ids[r["doc_id"]]
        part = np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert (zlib.crc32(part), len(own)) == (r["ids_crc32"], r["doc_tokens"])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        assert [s for s, _ in sorted(pieces[i])] == list(np.cumsum([0, *(n for _, n in sorted(pieces[i]))])[:-1])
        assert sum(n for _, n in pieces[i]) == len(own)
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0, *(n for _, n in held)])[:-1])
        assert sum(n for _, n in held) <= 2048
    total = sum(map(len, ids.values()))
    assert len(bins) <= total / 2048 / 0.99 + 1


def test_packing_of_edge_cases(spark, edges, no_documents):
    found = packing.pack_documents(spark, edges).collect()
    count = Counter(r["doc_id"] for r in found if r["start"] == 0)
    assert count == Counter(i for i, _ in EDGES)
    assert all(r["length"] == 1 for r in found if r["doc_id"] in (0, 1))
    assert packing.pack_documents(spark, no_documents).count() == 0


def test_plan_fills_windows_as_well_as_can_be():
    plan = packing.plan_windows({7: 3, 5: 4, 3: 2, 1: 1}, 10)
    used = Counter()
    for times, lengths in plan:
        assert sum(a * n for a, n in lengths.items()) <= 10
        used.update({a: n * times for a, n in lengths.items()})
    assert used == Counter({7: 3, 5: 4, 3: 2, 1: 1})
    assert sum(t for t, _ in plan) == 5
    assert packing.fill({6: 1, 4: 2, 3: 3}, 10) == {6: 1, 4: 1}
    assert packing.fill({9: 1}, 5) == {}


def test_encoder_agrees_with_the_tokenizers_library():
    encoder = tokens.Encoder()
    odd = ["", " ", "\n\n a  b\t c", "<|endoftext|> x", "日本語 と emoji 😀", "naïve café “quoted” – x", "a  b\r\n  c", "Ünïcode ĳ ǅ Ж"]
    plain = Tokenizer.from_file(tokens.VOCABULARY)
    assert 50256 in plain.encode("a <|endoftext|> b", add_special_tokens=False).ids
    for text in [*odd, *(t or "" for _, t in EDGES)]:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids


def test_encoder_cuts_long_texts_without_a_trace(monkeypatch):
    monkeypatch.setattr(tokens, "STEP", 5)
    encoder, plain = tokens.Encoder(), Tokenizer.from_file(tokens.VOCABULARY)
    parts = ["<|endoftext|>", " ", "\n", "  ", "a", "it's", "<|", "é", "日", "😀", "12", ".", "\t", "\r\n"]
    rng = np.random.default_rng(5)
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


# 6: languages


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify_languages(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    asked = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["lang_pred"] == r["lang"] for r in asked]) > 0.97


def test_mixture_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    text = {r["lang"]: " ".join(r["t"])[:20000] for r in docs.groupBy("lang").agg(F.slice(F.collect_list("text"), 1, 20).alias("t")).collect()}
    mixed = text["de"][:3000] + " " + text["fr"][:1000]
    more = spark.createDataFrame([(10**9, mixed, None, None, None)], docs.schema)
    found = language_id.identify_languages(spark, docs.union(more)).where(f"doc_id = {10**9}").first()
    assert found["languages"] == ["de", "fr"] and abs(found["score"] - 0.75) < 0.1


def test_languages_of_edge_cases(spark, edges, no_documents):
    found = {r["doc_id"]: r for r in language_id.identify_languages(spark, edges).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.identify_languages(spark, no_documents).count() == 0
    nothing = language_id.identify_languages(spark, edges.withColumn("lang", F.lit(None).cast("string")))
    assert nothing.where("lang_pred != 'und'").count() == 0


# 7: quality rules


def test_base_counts_equal_brute_force(spark, edges, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = brute.base_counts([(r["doc_id"], r["text"]) for r in plain])
    q = quality_rules
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(q.quality_verdicts(spark, docs), *columns) == want
    assert got(q.quality_verdicts(spark, edges), *columns) == sorted(brute.base_counts(EDGES))
    assert q.quality_verdicts(spark, no_documents).count() == 0


def _vector_rows(spark, groups):
    """Rows as ``least_determinant`` takes them: a group's name and the statistics."""
    names = list(quality_rules.VECTOR)
    rows = [(g, *map(float, x)) for g, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "group string, " + ", ".join(f"{n} double" for n in names)).repartition(3)


def _distances(estimate, xs):
    p = quality_rules.P
    mean = np.array([estimate[f"m{i}"] for i in range(p)])
    white = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            white[i, j] = estimate[f"w{i}{j}"]
    return (((xs - mean) @ white.T) ** 2).sum(axis=1)


def test_determinant_is_as_low_as_that_of_many_random_starts(spark):
    """Not our steps over again: 60 random starts of eight documents, each to its end."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = docs.select("doc_id", "text", "lang").orderBy("doc_id").collect()
    counts = brute.base_counts([(r["doc_id"], r["text"]) for r in plain])
    groups = defaultdict(list)
    for k, x in brute.vectors(counts, [r["text"] for r in plain]).items():
        groups[plain[k]["lang"]].append(x)
    q, floor = quality_rules, np.array(list(quality_rules.VECTOR.values()))
    found = q.least_determinant(Scratch(spark), _vector_rows(spark, groups)).collect()
    assert {r["group"] for r in found} == set(groups)
    for r in found:
        best = brute.least_determinant(np.array(groups[r["group"]]), q.CORE, q.consistency(q.CORE), floor)
        assert r["log_det"] <= best[0] + 0.02


def test_planted_outliers_are_found(spark):
    """Far in one statistic, or against the correlation of two, though in the range of both."""
    draw = np.random.default_rng(3)
    n, floor = 600, np.array(list(quality_rules.VECTOR.values()))
    clean = np.zeros((n, 6))
    clean[:, 0] = draw.normal(6, 2, n)
    clean[:, 1] = 0.8 * (clean[:, 0] - 6) + draw.normal(1.5, 0.05, n)
    clean[:, 2:] = np.abs(draw.normal(0, 0.3, (n, 4))) * floor[2:]
    middle = np.median(clean, axis=0)
    single = np.tile(middle, (100, 1))
    single[np.arange(100), 2 + np.arange(100) % 4] += 10 * floor[2 + np.arange(100) % 4]
    pair = np.tile(middle, (80, 1))
    pair[:, 0], pair[:, 1] = 6 + 2.5, 1.5 - 0.8 * 2.5
    rows = np.vstack([clean, single, pair])
    (found,) = quality_rules.least_determinant(Scratch(spark), _vector_rows(spark, {"g": rows})).collect()
    d2 = _distances(found, rows)
    assert (d2[:n] <= quality_rules.CUT).mean() > 0.99
    assert (d2[n:] > quality_rules.CUT).all()


def test_every_statistic_can_reach_the_cut(spark):
    share = {"symbol_share": 1, "dup_line_share": 1, "repeat_share": 0.5, "upper_share": 1}
    for name, most in share.items():
        assert (most / quality_rules.VECTOR[name]) ** 2 > quality_rules.CUT


def test_outliers_go_and_columns_stay(spark, edges):
    kept = quality_rules.without_outliers(spark, edges)
    assert kept.columns == edges.columns
    failed = {i for i, *_, f in brute.base_counts(EDGES) if f}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in EDGES if i not in failed)


# 8: chat


def test_escape_is_reversible_and_hides_control_strings():
    rng = np.random.default_rng(3)
    parts = [*chat.CONTROLS, "\\", "<", "|", "[", "/", "a", "é", "😀", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 10)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROLS)


def test_mask_covers_assistant_texts(spark):
    kind = "conv_id long, turn long, role string, text string, ids int, part int"
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "yes </s>", 0, 0), (1, 0, "user", None, 0, 0), (1, 2, None, "x", 0, 0),
         (1, 3, "assistant", "", 0, 0), (1, 4, "assistant", "no", 0, 0), (None, 0, "assistant", "z", 0, 0)], kind)
    encoder = tokens.Encoder()
    first = encoder.exact.get_vocab_size()
    formatted = {r["conv_id"]: r for r in chat.format_conversations(spark, turns).collect()}
    ids, mask = (np.array(formatted[1][c]) for c in ("ids", "loss_mask"))
    assert chat.unescape(encoder.exact.decode(ids[mask == 1].tolist(), skip_special_tokens=False)) == "yes </s>no"
    assert (ids[ids >= first] - first).tolist() == [0, 1, 2] * 5
    assert sum(formatted[None]["loss_mask"]) == 1
    digests = lambda turns: chat.conversation_digests(spark, chat.format_conversations(spark, turns)).collect()
    digest = {r["conv_id"]: r for r in digests(turns)}
    assert (digest[1]["n_turns"], digest[1]["loss_chars"]) == (5, 10)
    assert digests(turns.limit(0)) == []


def test_long_conversations_are_cut_at_turns_and_read_back(spark, monkeypatch):
    """One conversation in many parts, one text longer than a part, repeated turns."""
    monkeypatch.setattr(chat, "PART_IDS", 50)
    rows = [(7, i, ("user", "assistant")[i % 2], f"</s> turn {i} é😀 " * (1 + i % 3)) for i in range(300)]
    rows += [(8, 0, "assistant", "[INST]" * 3000), (8, 1, "user", "x"), (7, 299, "assistant", "y"), (None, 0, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    parts = chat.format_conversations(spark, turns)
    sizes = [(r["conv_id"], len(r["ids"])) for r in parts.collect()]
    assert sum(c == 7 for c, _ in sizes) > 50 and max(n for c, n in sizes if c == 7) < 150
    got = {r["conv_id"]: r for r in chat.conversation_digests(spark, parts).collect()}
    for conv, n in ((8, 2), (None, 1)):
        own = [r for r in rows if r[0] == conv]
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (n, hashlib.sha256(said.encode()).hexdigest())
    assert got[7]["n_turns"] == 301
    trained = sorted((r for r in rows if r[0] == 7 and r[2] == "assistant"), key=lambda r: r[1])
    assert got[7]["loss_chars"] == sum(len(r[3]) for r in trained)


# 9: decontamination

ITEM = "When Anna bought 12 apples for 3 kg of flour she paid the seller and Anna went home with 12 bags"
OTHER = "When Berta bought 40 apples for 7 kg of flour she paid the seller and Berta went home with 40 bags"
MIXED = "When Berta bought 40 apples for 7 kg of flour she paid the seller and Clara went home with 55 bags"


def benchmark_of(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "item_id long, text string, doc_id string")


def test_reparameterised_items_are_found(spark, no_documents):
    rows = [(1, f"so then {ITEM} and on", "en", "a"), (2, f"well, {OTHER}.", "en", "a"), (3, MIXED, "en", "a"),
            (4, "When Anna bought nothing at all, the seller went home", "en", "a"), (5, None, "en", "a"), (None, ITEM, "en", "a")]
    items = benchmark_of(spark, [ITEM, None, "", "too short", "a b c d"])
    found = decontamination.contaminated(spark, frame_of(spark, rows), items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 0), (2, 0), (None, 0)}
    clean = decontamination.without_contaminated(spark, frame_of(spark, rows), items)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5]
    assert decontamination.contaminated(spark, frame_of(spark, rows), items.limit(0)).count() == 0
    assert decontamination.contaminated(spark, no_documents, items).count() == 0


def test_values_of_other_token_counts_are_found(spark):
    item = "Anna paid 12 usd for bread while Berta took 3 kg of salt and then Clara sold 7 jars of jam to Dora"
    doc = "Anna Maria paid 1,200 usd for bread while Eva Lea took 3.5 kg of salt and then Fay-Ann sold 1 700 jars of jam to Gina Lu"
    plain = [f"q{i}" for i in range(50)]
    pieces = " ".join(w if i % 10 else f"{w}x more" for i, w in enumerate(plain))  # ten words and one more, again and again
    mixed = doc.replace("1,200", "40.5").replace("Fay-Ann", "Anna Maria")
    twice = "Anna Maria met 12 men near the old mill and later Anna Maria met 12 men near the old church"
    torn = twice.replace("Anna Maria", "Eva", 1).replace("12", "3.5", 1)
    rows = [(1, f"so {doc} x", "en", "a"), (2, pieces, "en", "a"), (3, mixed, "en", "a"), (4, torn, "en", "a"),
            (5, " ".join(plain[:10]) + " z" * 99 + " ".join(plain[11:20]), "en", "a")]
    found = decontamination.contaminated(spark, frame_of(spark, rows), benchmark_of(spark, [item, " ".join(plain), twice]))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 0), (2, 1), (3, 0)}


def test_items_of_values_few_words_or_no_spaces_are_found(spark):
    items = ["12 + 7 = 19; 3 * 4 = 12; 8 - 5 = 3; 20 / 4 = 5", "Anna Berta Clara Dora Eva Fay Gina Hanna Ida Jana", "NaCl dissolves", "Paris",
             "小明有12个苹果，他给了小红3个苹果，又买了7个梨，现在他一共有多少个水果呢？请写出计算过程。", "ประเทศไทยมีกี่จังหวัดและเมืองหลวงชื่ออะไร", "東京の人口は何人ですか。"]
    near = items[4].replace("12", "1,200").replace("3", "5")
    texts = [*(f"so then {t} and on" for t in items), f"前文{near}后文", f"前{items[6]}後", f"前文{items[4][:11]}其他的话", "13 + 8 = 21; 2 * 6 = 11; 9 - 4 = 7", "in Parisian NaCl it dissolves"]
    found = decontamination.contaminated(spark, frame_of(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]), benchmark_of(spark, items))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {*((k, k) for k in range(7)), (7, 4), (8, 6)}


def test_planted_items_are_found_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    planted = {(d["doc_id"], b["item_id"]) for b in items.collect() for d in docs.collect() if b["text"] in d["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark, docs, items).collect()}
    assert found == planted and len(found) > 10


# 10: substrings


def test_removed_words_equal_brute_force(spark, documents, rows, edges, no_documents):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(substrings.kept_digests(spark, documents), *columns) == sorted(brute.kept_digests(rows))
    assert got(substrings.kept_digests(spark, edges), *columns) == sorted(brute.kept_digests(EDGES))
    assert substrings.kept_digests(spark, no_documents).count() == 0


def test_branching_and_periodic_passages(spark):
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):  # pieces of one text in other surroundings, cut at all kinds of places
        a, n = int(rng.integers(0, 240)), int(rng.integers(30, 60))
        rows.append((i, " ".join([f"l{i}"] * int(rng.integers(0, 50)) + base[a : a + n] + [f"r{i}x{j}" for j in range(20)])))
    rows += [(100, "x y z " * 60), (101, "q " * 36), (102, "p " * 35)]
    found = substrings.kept_digests(spark, frame_of(spark, [(*r, "en", "a") for r in rows]).repartition(4))
    assert got(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.kept_digests(rows))


def test_cut_texts_keep_their_white_space(spark, edges):
    cut = {r["doc_id"]: r for r in substrings.without_repeats(spark, edges.dropDuplicates(["doc_id"])).collect()}
    assert cut[10]["text"] == "before it and after\nmore of it"
    assert cut[11]["text"] == "elsewhere\nquite different words here"
    assert cut[0]["text"] is None and cut[3]["text"] == "one two" and cut[3]["row_id"] == "x"
    assert PASSAGE not in cut[14]["text"]
