import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strataline.functions import exact
from strataline.operators import merge, observe, runs
from strataline.plans import pgm, planner, profile
from strataline.plans.store import BlockSnapshot, LevelError, RetiredLevel, Store, functional_merge
from strataline.sources import artifacts, manifest, workloads
from strataline.sources import profile_documents as documents
from strataline.streaming.resumable import NotDone, ResumableMerge, stream_index

DATA = profile.LevelData(4, [1000 + r for r in range(64)], [f"v{r}" for r in range(64)], 16, [0, 1, 2, 3], 0, None)


@pytest.mark.parametrize(
    ("lo", "hi", "key", "probes", "reads", "pos", "found"),
    [
        (0, 10, 1025, [5, 7, 8, 9, 9], [0], 10, False),
        (14, 30, 1025, [22, 26, 24, 25, 24], [0, 1], 25, True),
        (2, 20, 1025, [11, 15, 17, 18, 19, 19], [0, 1], 20, False),
        (5, 40, 1025, [22, 31, 26, 24, 25, 25, 24], [0, 1, 2], 25, True),
        (0, 64, 1005, [32, 16, 8, 4, 6, 5, 4], [1, 2, 3, 0], 5, True),
        (7, 7, 1000, [], [], 7, False),
        (25, 26, 1026, [25], [1], 26, True),
    ],
)
def test_literal_traces(lo, hi, key, probes, reads, pos, found):
    got = profile.search(DATA, key, lo, hi, True)
    assert (got.probes, got.reads, got.pos, got.found) == (probes, reads, pos, found)


def test_full_level_search_and_profile_rules():
    data = profile.LevelData(3, [1000 + r for r in range(16)], [f"f{r}" for r in range(16)], 4, [0, 1, 2, 3], 0, None)
    assert profile.lookup(data, 1000).reads == [2, 1, 0]
    assert profile.lookup(data, 9999).pos == 16
    for wrong in ({"prp_key": 3}, {"layout": "static_prp"}, {"layout": "static_prp", "prp_key": 0}, {"epsilon": 8}):
        with pytest.raises(profile.ProfileError):
            profile.Profile(**wrong)
    levels = profile.Levels(profile.Profile(items=4, label="test"), {3: [(1000, "a")], 5: [], 6: [(k, f"b{k - 2000}") for k in range(2000, 2004)]})
    got = levels.query(2002)
    assert (got["searched"], got["skipped"], got["paths"], got["value"]) == ([3, 6], [4, 5], ["full_level", "pgm_bounded"], "b2")
    assert levels.truth(2002)["hit_item_rank"] == 2


def test_planner_literals():
    cfg = planner.PlanConfig()
    z = planner.bin_capacity(cfg)
    assert z == 16 and planner.factor(z, cfg) == 0.12829670090910578 and planner.decay(512) == 0.9743040866542517
    assert [planner.bin_count(planner.factor(z, cfg), n) for n in (0, 1, 8, 16, 64, 512)] == [0, 1, 2, 3, 9, 66]
    assert planner.bin_capacity(planner.PlanConfig(security_lambda=3)) == 2
    ws = planner.weights(4, 1.0)
    assert planner.convolved(ws, 2)[0] == ws[0] * ws[0] and len(planner.convolved(ws, 3)) == 13
    plan = planner.allocate(64, planner.PlanConfig(seed=3))
    assert sum(plan.loads) >= 64 and plan == planner.allocate(64, planner.PlanConfig(seed=3))
    with pytest.raises(planner.ShortCapacity):
        planner.allocate(64, cfg, lambda: 0)
    with pytest.raises(planner.PlanError):
        planner.PlanConfig(privacy_epsilon=float("nan"))
    assert planner.interior_index(5000, 1.0, 0.5) < 5000  # far beyond where plain weights overflow


def run_of(spark, keys, tag):
    return spark.createDataFrame([(k, f"{tag}{k}") for k in keys], "key long, value string")


@pytest.mark.parametrize(
    ("a", "b", "n", "dup"),
    [(range(2000, 2012), range(2006, 2018), 18, 6), ([], [1, 2], 2, 0), ([5], [5], 1, 1), (range(0, 12, 2), range(1, 12, 2), 12, 0), ([-9, -4, 0, 7], [-7, -4, 0, 9], 6, 2), ([], [], 0, 0)],
)
def test_newer_wins(spark, a, b, n, dup):
    merged = merge.newer_wins(run_of(spark, a, "s"), run_of(spark, b, "t"))
    row = merge.counts(merged).first()
    assert (row["output"], row["discarded"]) == (n, dup)
    assert {r["key"]: r["value"] for r in merged.collect()} == {k: f"t{k}" for k in b} | {k: f"s{k}" for k in a}


def test_newer_null_wins(spark):
    newer = spark.createDataFrame([(1, None)], "key long, value string")
    assert merge.newer_wins(newer, run_of(spark, [1], "t")).first()["value"] is None


def test_resumable_merge_steps(spark):
    job = ResumableMerge(4, run_of(spark, [1, 3, 5, 7], "s"), 5, run_of(spark, [2, 3, 6, 7], "t"), 2)
    with pytest.raises(NotDone):
        job.finalize()
    steps = [job.advance(2) for _ in range(3)]
    seen = [tuple(s[k] for k in ("i", "j", "r", "blocks", "done")) for s in steps]
    assert seen == [(1, 1, 2, 1, False), (3, 2, 4, 2, False), (4, 4, 6, 3, True)]
    assert job.advance(9) == job.progress()
    assert [r["value"] for r in job.finalize().orderBy("key").collect()] == ["s1", "t2", "s3", "s5", "t6", "s7"]
    for wrong in ((4, 6), (2, 0), (3, 3)):
        with pytest.raises(merge.MergeIdentity):
            merge.check_levels(*wrong)


def test_streamed_index_equals_batch(spark, tmp_path):
    from strataline.plans import pgm

    keys = [n * n * n % 10_007 for n in range(60)]
    keys = sorted(set(keys))
    for i in range(0, len(keys), 20):
        spark.createDataFrame([(1, k) for k in keys[i : i + 20]], "level int, key long").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i:03}"))
    source = spark.readStream.schema("level int, key long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_index(source, 1).writeStream.outputMode("update").format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT * FROM online ORDER BY n DESC").first()
    assert (last["n"], last["segments"]) == (len(keys), len(pgm.build(keys, 1).segments))


def test_store_trace_and_errors(spark):
    store = Store(spark, 3, 2)
    old = store.create(run_of(spark, range(8), "o"))
    new = store.create(run_of(spark, range(6, 12), "n"))
    with pytest.raises(LevelError):
        store.lookup(old, 1)
    store.build_index(old)
    store.build_index(new)
    assert store.query([new, old], 7)["value"] == "n7" and store.query([new, old], 2)["value"] == "o2"
    store.take_events()
    n, o = list(store.levels[new].slots), list(store.levels[old].slots)
    out = store.merge(new, old)
    x = store.levels[out].slots
    assert store.take_events() == [("READ", s) for s in n + o] + [("WRITE", s) for s in x] + [("READ", s) for s in x] + [("WRITE", s) for s in n + o]
    assert len(x) == 4 and store.active() == [out]
    with pytest.raises(RetiredLevel):
        store.query([old], 1)
    store.relocate(out, 0)
    assert [e[0] for e in store.take_events()] == ["READ", "WRITE", "WRITE"]
    with pytest.raises(runs.DuplicateKey):
        store.create(run_of(spark, [1, 1], "d"))


@pytest.mark.parametrize("family", ["UMQ"])
def test_workload_document_transcript_and_metrics(spark, family, tmp_path):
    doc = workloads.run(spark, workloads.generate(family, 1))
    assert doc["final"]["correctness_ok"] is True
    artifacts.write(doc, str(tmp_path / "run.json"))
    seen = artifacts.transcript(artifacts.load(str(tmp_path / "run.json")))
    artifacts.check_transcript(seen)
    assert artifacts.forbidden_fields(seen) == [] and "key" in artifacts.forbidden_fields({"a": [{"key": 1}]})
    labelled = artifacts.label(seen, {o["index"]: "QClass0" for o in seen["operations"] if o["class"] == "QUERY"})
    assert labelled["equality_channel"] == "M1"
    found = artifacts.metrics(spark, seen)
    assert found["merges"] and found == artifacts.metrics(spark, labelled)
    for change in ({"extra": 1}, {"summary": {}}, {"equality_channel": "M1"}):
        with pytest.raises(artifacts.ContractError):
            artifacts.check_transcript(seen | change)
    broken = json.loads(json.dumps(doc))
    broken["operations"][0]["read_count"] = False
    with pytest.raises(artifacts.ContractError):
        artifacts.transcript(broken)
    assert artifacts.main([str(tmp_path / "none.json")]) == 2


def test_scripts_are_seeded():
    for family in workloads.FAMILIES:
        assert workloads.generate(family, 7).ops == workloads.generate(family, 7).ops
    with pytest.raises(workloads.WorkloadError):
        workloads.generate("X", 1)
    assert len(profile.passive_queries("domain_uniform", 1, 5, domain=(0, 9))) == 5
    with pytest.raises(profile.ProfileError):
        profile.passive_queries("record_uniform", 1, 5)


def test_empty_operations_count(spark):
    ops = spark.createDataFrame([(0, "QUERY"), (1, "QUERY")], "op_index long, class string")
    events = spark.createDataFrame([], "op_index long, class string, seq long, operation string, slot_id long")
    row = observe.pairs(ops, events).first()
    assert (row["jaccard"], row["set_equal"], row["sequence_equal"]) == (0.0, True, True)
    assert observe.operation_metrics(ops, events).first()["span"] is None


def test_store_changes_blocks_and_slots(spark):
    store = Store(spark, 3, 1)
    level = store.create(run_of(spark, range(0, 12, 2), "a"))
    store.build_index(level)
    store.take_events()
    assert [r["key"] for r in store.read_block(level, 1).collect()] == [6, 8, 10] and [r["key"] for r in store.scan(level).collect()] == list(range(0, 12, 2))
    assert store.take_events() == [("READ", 1), ("READ", 0), ("READ", 1)]
    store.attach(level, run_of(spark, [20, 21], "b"))
    with pytest.raises(LevelError):  # the index went with the change
        store.lookup(level, 20)
    for wrong in ([22], [5], []):  # behind a partial block, below the level, of no records
        with pytest.raises(ValueError):
            store.attach(level, run_of(spark, wrong, "c"))
    store.append(level, run_of(spark, [1, 3], "d"))
    assert [(r["key"], r["block_rank"]) for r in store.scan(level).collect()] == [(k, i // 3) for i, k in enumerate([0, 1, 2, 3, 4, 6, 8, 10, 20, 21])]
    with pytest.raises(ValueError):
        store.remove(level, 0)
    gone = store.levels[level].slots[-1]
    store.remove(level, 3)
    assert store.owner(gone) is None and store.owner(store.levels[level].slots[0]) == (level, 0)
    with pytest.raises(ValueError):
        store.clear(gone)
    store.take_events()
    store.build_index(level)
    assert json.loads(store.events_json()) == [{"seq": i, "operation": "READ", "slot_id": s} for i, s in enumerate(store.levels[level].slots)]
    assert store.event_table().count() == 3
    answers, reads = store.lookup_many(level, spark.createDataFrame([(k,) for k in range(-2, 24)], "key long"))
    keys = [0, 1, 2, 3, 4, 6, 8, 10, 20]
    for r in answers.collect():
        assert (r["found"], r["lower_bound"]) == (r["key"] in keys, sum(k < r["key"] for k in keys)) and r["lo"] <= r["lower_bound"] <= r["hi"]
    wanted = {r["key"]: (0 if r["first_block"] is None else r["last_block"] - r["first_block"] + 1) for r in answers.collect()}
    assert {r["key"]: r["count"] for r in reads.groupBy("key").count().collect()} == {k: n for k, n in wanted.items() if n}


def test_runs_mappings_and_inserts(spark):
    given = spark.createDataFrame([(k, i) for i, k in enumerate([1, 4, 4, 9])], "key long, at long")
    with pytest.raises(runs.UnsortedRun):
        runs.strict(given, "at")
    assert [r["rank"] for r in runs.strict(given.where("at <> 2"), "at").orderBy("key").collect()] == [0, 1, 3]
    mapping = spark.createDataFrame([(1, 10), (2, 20)], "block_id long, slot_id long")
    same = spark.createDataFrame([(1, 10), (3, 30)], "block_id long, slot_id long")
    assert runs.assign(mapping, same).count() == 3 and runs.unassign(mapping, same).count() == 1
    with pytest.raises(ValueError):
        runs.assign(mapping, spark.createDataFrame([(4, 20)], "block_id long, slot_id long"))
    owners = {r["slot_id"]: (r["block_id"], r["in_use"]) for r in runs.slot_owners(spark.createDataFrame([(10,), (11,)], "slot_id long"), mapping).collect()}
    assert owners == {10: (1, True), 11: (None, False)}
    packed = runs.blocks(runs.packed(runs.ranked(run_of(spark, [1, 5, 9, 20], "a")), 3))
    more = spark.createDataFrame([(0, 4, "x"), (1, 30, "y"), (1, 25, "z"), (7, 1, "w")], "block_rank long, key long, value string")
    kept, refused = runs.insert(packed, more, 3)
    assert {r["block_rank"]: [x["key"] for x in r["items"]] for r in kept.collect()} == {0: [1, 5, 9], 1: [20, 25, 30]}
    assert {(r["block_rank"], r["key"], r["fault"]) for r in refused.collect()} == {(0, 4, "full"), (7, 1, "no block")}
    with pytest.raises(ValueError):
        BlockSnapshot(0, kept.where("block_rank = 1"), 3)  # ranks that don't begin at 0 are a gap
    snap = BlockSnapshot(0, kept, 3)
    assert snap.rank_range(1) == (3, 6) and [r["key"] for r in snap.slice(2, 4).orderBy("rank").collect()] == [9, 20]
    many = spark.createDataFrame([(float(i),) for i in range(0, 3000, 3)], "key double")
    cuts = [float(i) for i in range(5, 2990, 5)]  # more than one tree
    assert all(r["n"] == sum(c <= r["key"] for c in cuts) for r in many.select("key", runs.cut_column(many["key"], cuts).alias("n")).collect())


def test_merges_come_to_the_same_records_and_segments(spark):
    newer, older = run_of(spark, range(0, 40, 3), "n"), run_of(spark, range(0, 40, 2), "o")
    records, segments = functional_merge(newer, older, 4, 1)
    seen, job = [], ResumableMerge(1, newer, 2, older, 4, lambda df: seen.extend(df.orderBy("rank").collect()))
    while not job.advance(5)["done"]:
        assert job.state_report()["bounded"]
    rows = lambda xs: [(r["key"], r["value"], r["block_rank"]) for r in xs]
    assert rows(seen) == rows(job.finalize().orderBy("rank").collect()) == rows(records.orderBy("rank").collect())
    assert segments.count() == len(pgm.build(sorted({*range(0, 40, 3), *range(0, 40, 2)}), 1).segments)


def test_pair_summary_needs_no_pairs(spark):
    queries = spark.createDataFrame([(i, "QUERY") for i in range(9)], "op_index long, class string")
    traces = {0: [1, 2], 1: [2, 1], 2: [1, 2], 3: [7], 4: [], 5: [], 6: [2, 3, 9], 7: [9, 9], 8: [7]}
    events = spark.createDataFrame([(i, "QUERY", s, "READ", x) for i, xs in traces.items() for s, x in enumerate(xs)], "op_index long, class string, seq long, operation string, slot_id long")
    pairs = observe.pairs(queries, events).collect()
    got = observe.pair_summary(queries, events).first()
    js = [r["jaccard"] for r in pairs]
    assert got["pair_count"] == 36 and got["mean_jaccard"] == pytest.approx(sum(js) / 36, abs=1e-6) and (got["max_jaccard"], got["min_jaccard"]) == (max(js), min(js))
    assert (got["intersecting"], got["set_equal"], got["sequence_equal"]) == tuple(sum(map(bool, x)) for x in zip(*[(r["intersection"], r["set_equal"], r["sequence_equal"]) for r in pairs], strict=True))
    alike = observe.pair_summary(queries.where("op_index IN (0, 2)"), events).first()
    assert (alike["pair_count"], alike["mean_jaccard"], alike["min_jaccard"], alike["sequence_equal_rate"]) == (1, 1.0, 1.0, 1.0)
    none = observe.pair_summary(queries.limit(0), events).first()
    assert (none["pair_count"], none["mean_jaccard"], none["min_jaccard"]) == (0, 0.0, 0.0)


def test_draws_of_bins(spark):
    cfg = planner.PlanConfig(seed=5)
    z = planner.bin_capacity(cfg)
    loads = planner.drawn_loads(spark, 5000, cfg)
    found = [r["sampled_load"] for r in loads.collect()]
    ws = planner.weights(z, cfg.privacy_epsilon)
    assert len(found) == planner.bin_count(planner.factor(z, cfg), 5000) and 0 <= min(found) <= max(found) <= z
    assert sum(found) / len(found) == pytest.approx(sum(i * w for i, w in enumerate(ws)) / sum(ws), abs=0.2)
    ns = spark.range(1, 60).crossJoin(spark.range(40).select((F.col("id") / 40).alias("u")))
    rows = ns.select("id", "u", planner.picked_index(F.col("id"), 1.0, F.col("u")).alias("i")).collect()
    assert all(abs(r["i"] - planner.interior_index(r["id"], 1.0, r["u"])) == 0 for r in rows)
    ws = planner.weights(4, 1.0)
    assert [planner.draw(planner.stream(1, "x"), ws) for _ in range(3)] == [planner.draw(planner.stream(1, "x"), ws)] * 3
    assert planner.to_uint32(-1.0) == 0 and planner.to_uint32(2.0**40) == planner.UINT32 and planner.to_uint32(7.9) == 7
    # The first eight bytes of sha256 of seed, a pipe character and purpose, as a generator's seed
    assert planner.stream(3, "bin loads").random() == random.Random(int.from_bytes(hashlib.sha256(b"3|bin loads").digest()[:8], "big")).random()
    noise = [planner.laplace(planner.stream(i, "noise"), 2.0) for i in range(4000)]
    assert abs(sum(noise) / len(noise)) < 0.2 and sum(map(abs, noise)) / len(noise) == pytest.approx(2.0, abs=0.2)
    wrong = planner.bin_intervals(loads, 5000, z).withColumn("rank_stop", F.col("rank_stop") + F.when(F.col("bin_index") == 7, 1).otherwise(0))
    assert {r["bin_index"] for r in planner.plan_violations(wrong, 5000, z).collect()} == {7}
    assert [r["s"] for r in spark.range(-1, 2).select(exact.sign(F.col("id")).alias("s")).orderBy("id").collect()] == [-1, 1, 1]


def test_profile_documents(spark, tmp_path):
    levels = profile.Levels(profile.Profile(layout="static_prp", prp_key=9), profile.default_scenario())
    assert all(profile.inverse(profile.inverse(d.place)) == d.place for d in levels.levels.values())
    keys = [3_000_000, 3_000_001, 6_000_300, 3_000_000]
    whole = documents.artifact(levels, keys)
    seen = documents.transcript(whole)
    assert whole["verified"] and [o["class"] for o in seen["operations"]] == ["BUILD_INITIAL"] * 4 + ["BUILD_PGM"] + ["QUERY"] * 4
    labels = documents.equality_labels(spark, whole)
    assert [labels[i] for i in sorted(labels)] == ["QClass0", "QClass1", "QClass2", "QClass0"]
    assert documents.view(seen)["equality_channel"] == "M0" and documents.view(seen, labels)["operations"][5]["query_equality_class"] == "QClass0"
    truth = documents.truth(spark, levels, keys)
    assert len(truth["slots"]) == sum(d.blocks for d in levels.levels.values())
    records = [(lv, r) for lv, d in levels.levels.items() for r in range(len(d.keys))]
    found = profile.slots_of_records(spark.createDataFrame(records, "level long, rank long"), profile.slot_truth(spark, levels)).collect()
    assert {(r["level"], r["rank"]): r["slot_id"] for r in found} == {(lv, r): levels.levels[lv].region + levels.levels[lv].place[r // 256] for lv, r in records}
    for q in truth["queries"]:
        if q["found"]:
            assert levels.levels[q["hit_level"]].region + levels.levels[q["hit_level"]].place[q["hit_block_rank"]] == q["hit_slot_id"]
    broken = [{"summary": {}}, {"extra": 1}, {"operations": seen["operations"][1:]}, {"operations": seen["operations"][::-1]}, {"profile": {**seen["profile"], "seed": 1}}]
    stray = json.loads(json.dumps(seen["operations"]))
    stray[-1]["events"][0]["slot_id"] = 999
    write = json.loads(json.dumps(seen["operations"]))
    write[-1]["events"][0]["operation"] = "WRITE"
    for change in (*broken, {"operations": stray}, {"operations": write}):
        with pytest.raises(artifacts.ContractError):
            documents.check_transcript({**seen, **change})
    with pytest.raises(artifacts.ContractError):
        documents.view(seen, {0: "QClass0"})
    paths = {n: str(tmp_path / n) for n in ("artifact", "transcript", "truth", "view")}
    assert documents.main([*(x for n, p in paths.items() for x in (f"--{n}", p)), "--queries", "5"]) == 0
    documents.check_transcript(json.loads((tmp_path / "transcript").read_text()))
    assert documents.main(["--layout", "static_prp"]) == 2


def test_files_are_held_against_a_manifest(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "1"), ("sub/b.txt", "2"), ("c.txt", "3")):
        (root / name).write_text(text)
    of = lambda t: hashlib.sha256(t.encode()).hexdigest()
    good = f"# files\n{of('1')}  a.txt\n\n{of('2')} *sub/b.txt\n"
    (tmp_path / "m").write_text(good + f"{of('3')}  c.txt\n")
    assert manifest.main([str(root), str(tmp_path / "m")]) == 0
    (tmp_path / "m").write_text(good + f"{of('x')}  gone.txt\n{of('1')}  a.txt\n")
    found = manifest.violations(manifest.digests(spark, str(root)), manifest.read(spark, str(tmp_path / "m")))
    assert {tuple(r) for r in found.collect()} == {("gone.txt", "missing"), ("c.txt", "not listed"), ("a.txt", "listed twice")}
    assert manifest.main([str(root), str(tmp_path / "m")]) == 1


def test_scripts_and_runs_differ(spark):
    script = spark.createDataFrame([(0, "QUERY", 5), (1, "MERGE", None)], "op_index long, kind string, key long")
    same = script.select("op_index", F.col("kind").alias("class"))
    assert [tuple(r) for r in observe.labels_of_script(script, same).collect()] == [(0, "QClass0")]
    for wrong in (same.limit(1), same.withColumn("class", F.lit("QUERY"))):
        with pytest.raises(observe.ScriptMismatch):
            observe.labels_of_script(script, wrong)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_of_several_blocks_are_those_of_sets(spark, seed, monkeypatch):
    monkeypatch.setattr(observe, "BLOCK", 7)
    monkeypatch.setattr(observe, "WIDE", 3)
    rng = random.Random(seed)
    traces = {i * 5 - 60: [rng.choice([rng.randrange(8), rng.randrange(-(10**12), 10**12) // 10**11]) for _ in range(rng.choice([0, 1, 3, 12, 30]))] for i in range(50)}
    traces |= {1000: traces[-60], 1001: list(reversed(traces[-60]))}
    queries = spark.createDataFrame([(i, "QUERY") for i in traces], "op_index long, class string")
    events = spark.createDataFrame([(i, "QUERY", s, "READ", x) for i, xs in traces.items() for s, x in enumerate(xs)], "op_index long, class string, seq long, operation string, slot_id long")
    found = observe.pairs(queries, events)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # pairs are neither shuffled nor met one by one
    want = {}
    for a in traces:
        for b in traces:
            if a < b:
                x, y = set(traces[a]), set(traces[b])
                want[a, b] = (len(x & y), len(x | y), round(len(x & y) / max(1, len(x | y)), 6), x == y, traces[a] == traces[b])
    assert found.count() == len(want)
    assert {(r["a"], r["b"]): tuple(r)[2:] for r in found.collect()} == want


@pytest.mark.parametrize(("joined", "block"), [(0, 7), (0, 2048), (10**9, 7)])
def test_pair_summary_is_that_of_all_pairs(spark, joined, block, monkeypatch):
    monkeypatch.setattr(observe, "BLOCK", block)
    rng = random.Random(block)
    traces = {i: [rng.randrange(12) for _ in range(rng.choice([0, 1, 2, 9, 30]))] for i in range(60)}
    traces |= {i + 60: traces[i] for i in range(0, 60, 4)}
    queries = spark.createDataFrame([(i, "QUERY") for i in traces], "op_index long, class string")
    events = spark.createDataFrame([(i, "QUERY", s, "READ", x) for i, xs in traces.items() for s, x in enumerate(xs)], "op_index long, class string, seq long, operation string, slot_id long")
    pairs = observe.pairs(queries, events).collect()
    monkeypatch.setattr(observe, "JOINED", joined)
    got = observe.pair_summary(queries, events).first()
    js = [r["jaccard"] for r in pairs]
    assert got["pair_count"] == len(pairs) and got["mean_jaccard"] == pytest.approx(sum(js) / len(js), abs=1e-6) and (got["max_jaccard"], got["min_jaccard"]) == (max(js), min(js))
    assert (got["intersecting"], got["set_equal"], got["sequence_equal"]) == tuple(sum(map(bool, x)) for x in zip(*[(r["intersection"], r["set_equal"], r["sequence_equal"]) for r in pairs], strict=True))


def test_hot_slots_are_not_joined_pair_by_pair(spark):
    queries = spark.createDataFrame([(i, "QUERY") for i in range(40)], "op_index long, class string")
    events = spark.createDataFrame([(i, "QUERY", s, "READ", x) for i in range(40) for s, x in enumerate((0, 1, i + 2))], "op_index long, class string, seq long, operation string, slot_id long")
    found = observe.pair_summary(queries, events)
    assert "slot_id" not in found._jdf.queryExecution().optimizedPlan().toString()  # sets meet in blocks
    assert (found.first()["pair_count"], found.first()["intersecting"], found.first()["mean_jaccard"]) == (780, 780, 0.5)
