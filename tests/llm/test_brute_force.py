"""The corpus operators and the pipeline against plain Python, decision by decision."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataline.llm import common, fingerprint, language_id, media, mixing, near_dedup, packing, quality, url_filter

M = (1 << 64) - 1
ODD = ["", None, "a", "  ", "12 34", "same words here now ok yes", "same words here now ok yes", "x" * 3000, "é😀  中文\x1c b\xa0c", "İ. Σ, they'll"]
CLASHING = ["row", "doc_text", "__id", "__node", "node", "id", "score", "copies", "rejected", "predicted", "size", "s", "of", "place", "kept", "doc.dot"]


def some_text(rng, n):
    return "".join(rng.choice("abcdeé ß中12,.\n\t-ÀΣ İ") for _ in range(n))


# --- language ----------------------------------------------------------------


def plain_grams(text, cfg):
    s = [c for c in f" {' '.join(text.lower().split())} " if c.isalpha() or c == " "]
    out = []
    if not any(c.isalpha() for c in s):
        return out
    for n in range(cfg.min_n, cfg.max_n + 1):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if g.count(" ") < min(n, 3) and " " not in g[1:-1]:
                h = 0
                for c in g:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) & M
                h = h * 0xD6E8FEB86659FD93 & M
                out.append((h ^ h >> 29) % cfg.buckets)
    return out


def test_language_equals_plain_grams_and_softmax():
    rng, cfg = random.Random(1), language_id.LanguageConfig(buckets=512, dim=4, epochs=2)
    texts = [some_text(rng, rng.randrange(60)) for _ in range(60)]
    for t in texts:
        assert Counter(int(x) for part in language_id.grams(t, cfg) for x in part) == Counter(plain_grams(t, cfg))
    rows = [(np.array(plain_grams(t, cfg), cfg.gram_type), "ab"["中" in t]) for t in texts]
    models = [language_id.train(rows, c) for c in (cfg, language_id.LanguageConfig(buckets=512, dim=4, epochs=2, folded=1))]
    for t in texts:
        found = [language_id.predict_text(t, m) for m in models]
        assert found[0][0] == found[1][0] and found[0][1] == pytest.approx(found[1][1], abs=1e-4)  # folded or not
        ids = plain_grams(t, cfg)
        if not ids:
            assert found[0] == ("und", 0.0, True)
            continue
        m = models[0]
        z = [(sum(float(m.table[i][k]) for i in ids) / len(ids) + m.bias[k]) / m.temperature for k in range(len(m.labels))]
        p = [np.exp(x - max(z)) / sum(np.exp(y - max(z)) for y in z) for x in z]
        assert found[0][1] == pytest.approx(max(p)) and found[0][0] == m.labels[int(np.argmax(p))] and found[0][2] == (max(p) < m.threshold)


def test_language_learns_from_whole_long_texts_and_from_all_languages(spark):
    rng = random.Random(2)
    names = [f"l{k:03}" for k in range(300)]
    rows = [(i, " ".join(rng.choice("bcdfghjklm") + chr(0x4E00 + k) for _ in range(8)), lang) for i, (k, lang) in enumerate([(k, x) for k, x in enumerate(names) for _ in range(6)])]
    rows.append((10**6, "zz " * 30_000 + "end", "long"))
    cfg = language_id.LanguageConfig(train_grams=500)
    sample = language_id.sample_labelled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), cfg)
    assert {y for _, y in sample} >= {*names} - {n for n in names if all(zlib.crc32(str(i).encode()) % 3 == 1 for i, _, y in rows if y == n)}
    assert max(len(ids) for ids, _ in sample) <= 500 and ("long" in {y for _, y in sample}) == (zlib.crc32(b"1000000") % 3 != 1)


# --- quality -----------------------------------------------------------------


def plain_features(text, said, n):
    words, raw = (text or "").split(), (text or "").encode()
    marks = ".,;:?'\"-()"
    low, up, dig, space = (sum(f(chr(b)) for b in raw if b < 128) for f in (str.islower, str.isupper, str.isdigit, lambda c: c in "\t\n\v\f\r "))
    high, bar, ends = sum(b > 127 for b in raw), raw.count(b"|"), sum(chr(b) in marks for b in raw)
    other = sum(32 < b < 127 and not chr(b).isalnum() and chr(b) not in marks + "|" for b in raw)
    size, letters = max(1, len(raw)), max(1, low + up + high)
    stats = [up / letters, dig / size, other / size, bar / size, space / size, high / size] + [0.0] * 8
    counts = Counter(zlib.crc32(w.encode()) % n for w in words)
    if words:
        hashed, lines = [zlib.crc32(w.encode()) % n for w in words], text.split("\n")
        stats[6] = min(sum(map(len, words)) / len(words), 40) / 10
        stats[7] = sum(len(w) <= 3 for w in words) / len(words)
        stats[8] = len(counts) / min(len(words), n)
        stats[9] = sum(a == b for a, b in zip(hashed, hashed[1:], strict=False)) / (len(words) - 1) if len(words) > 1 else 0
        stats[10] = min(1, 10 * len(lines) / len(words))
        stats[11] = 1 - len(set(lines)) / len(lines)
        stats[12] = min(1.0, 10 * ends / len(words))
        stats[13] = sum(w.isupper() for w in words) / len(words)
    stats += [np.log1p(len(text or "")) / 12, np.log1p(len(words)) / 10, np.log1p(max(0, said or 0)) / 12, said is None, said is not None and said != len(text or "")]
    norm = np.sqrt(sum(c * c for c in counts.values()))
    return {**{k: c / norm for k, c in counts.items()}, **{n + i: float(x) for i, x in enumerate(stats)}}


def test_quality_features_and_training_equal_plain_ones():
    rng, cfg = random.Random(3), quality.QualityConfig(buckets=64, rank=3, epochs=2)
    texts = [(None, None), ("", 0), *((some_text(rng, rng.randrange(80)) + rng.choice(["", "|A B!|\nA\nA"]), rng.choice([None, 5, 80])) for _ in range(20))]
    seen, data = quality.Buckets(64), []
    for i, (t, said) in enumerate(texts):
        ids, x = quality.features(t, said, seen)
        want = plain_features(t, said, 64)
        assert dict(zip(ids.tolist(), x.tolist(), strict=True)) == pytest.approx(want)
        data.append((ids, x, i % 2))
    fm, size = quality.train(data, cfg), 64 + len(quality.STATS)
    draws = np.random.default_rng(cfg.seed)
    w, v, w0 = [0.0] * size, draws.normal(0, 0.02, (size, 3)).tolist(), np.log((11 + 0.5) / (11 + 0.5))
    g0, gw, gv = 1e-6, [1e-6] * size, [[1e-6] * 3 for _ in range(size)]
    for _ in range(cfg.epochs):
        for i in draws.permutation(len(data)):
            ids, xs, y = data[i]
            pairs = list(zip(ids.tolist(), xs.tolist(), strict=True))
            z = w0 + sum(w[j] * x for j, x in pairs) + sum(sum(v[a][f] * v[b][f] for f in range(3)) * x * u for k, (a, x) in enumerate(pairs) for b, u in pairs[:k])
            d = 1 / (1 + np.exp(-z)) - y
            s = [sum(v[j][f] * x for j, x in pairs) for f in range(3)]
            steps = [(j, d * x + cfg.decay * w[j], [d * (x * s[f] - v[j][f] * x * x) + cfg.decay * v[j][f] for f in range(3)]) for j, x in pairs]
            g0 += d * d
            w0 -= cfg.rate * d / np.sqrt(g0)
            for j, dw, dv in steps:
                gw[j] += dw * dw
                w[j] -= cfg.rate * dw / np.sqrt(gw[j])
                for f in range(3):
                    gv[j][f] += dv[f] ** 2
                    v[j][f] -= 0.3 * cfg.rate * dv[f] / np.sqrt(gv[j][f])
    assert fm.w0 == pytest.approx(w0) and fm.w == pytest.approx(w) and fm.v == pytest.approx(np.array(v))


# --- fingerprints ------------------------------------------------------------


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_level(names):
    runs = []
    for n in names:
        if runs and runs[-1][0] == n:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
    names = [mix(n + c * 0xD1B54A32D192ED03 & M) if c > 1 else n for n, c in runs]
    low = lambda x: (x & -x).bit_length() - 1
    label = []
    for i, n in enumerate(names):
        k = low(n ^ names[i - 1]) if i and n != names[i - 1] else 0
        label.append(2 * k + (n >> k & 1))
    for _ in range(3):
        new = [label[0] & 1]
        for a, b in zip(label, label[1:], strict=False):
            k = low(a ^ b) if a != b else 0
            new.append(2 * k + (b >> k & 1))
        label = new
    starts = [0] + [i for i in range(1, len(names) - 1) if label[i] > label[i - 1] and label[i] > label[i + 1]]
    out = []
    for a, z in zip(starts, [*starts[1:], len(names)], strict=True):
        total = 0
        for p, n in enumerate(names[a:z]):
            total += mix(n) * pow(0x9E3779B97F4A7C15, p % 64 + 1, 1 << 64) + p // 64
        out.append(mix(total & M))
    return out


def plain_sketch(text, cfg):
    out = {}
    names = [mix(ord(c)) for c in text]
    for level in range(1, cfg.last_level + 1):
        if not names:
            break
        names = plain_level(names)
        if level >= cfg.first_level:
            for n in names:
                h = mix(n + level & M)
                at = (level, h % cfg.registers)
                out[at] = min(out.get(at, M), h)
    return {at: min(mix(h) >> 48, 0xFFFE) for at, h in out.items()}


def plain_likeness(a, b):
    either = {*a, *b}
    return sum(a.get(k) == b.get(k) for k in either) / len(either) if either else 1.0


def test_fingerprints_and_likeness_equal_plain_parsing(spark):
    rng, cfg = random.Random(4), fingerprint.FingerprintConfig()
    base = some_text(rng, 900)
    texts = ["", "a", "aaaa", "ab" * 200, base, base[:700] + some_text(rng, 200), some_text(rng, 50), "zz" + base, None, base]
    ids = list(range(0, 70, 7))
    found = {r["doc_id"]: r for r in fingerprint.compare_with_next(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)).collect()}
    whole = [t or "" for t in texts]
    for i, t in enumerate(whole):
        after = whole[i - 1]  # descending ids, and the first after the last
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        mine, theirs, nexts = (plain_sketch(x, cfg) for x in (t, edited, after))
        r = found[ids[i]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for sketch, text in ((mine, r["fingerprint"]), (theirs, r["edited_fingerprint"])):
            want = "".join(f"{sketch.get((lv, c), 0xFFFF):04x}" for lv in range(cfg.first_level, cfg.last_level + 1) for c in range(cfg.registers))
            assert text == ("" if not sketch else want)
        assert r["near_edited"] == pytest.approx(plain_likeness(mine, theirs)) and r["near_next"] == pytest.approx(plain_likeness(mine, nexts))
    with pytest.raises(TypeError):
        fingerprint.compare_with_next(spark.createDataFrame([("x", "t")], "doc_id string, text string"))


def test_unlike_long_texts_do_not_agree_by_chance():
    rng, cfg = np.random.default_rng(5), fingerprint.FingerprintConfig()
    one, other = ("".join(map(chr, rng.integers(97, 123, 400_000))) for _ in range(2))
    a, b = fingerprint.sketches([one], cfg), fingerprint.sketches([other], cfg)
    assert fingerprint.likeness(a, b)[0] < 0.3  # short phrases are shared; those of the last levels are not
    assert fingerprint.likeness(a[:, -24:], b[:, -24:])[0] == 0


# --- near duplicates ---------------------------------------------------------


def test_near_copies_with_repeats_are_found(spark):
    """Recall against all pairs, where texts repeat shingles and pairs lie on both sides of the bound."""
    rng, texts = random.Random(6), []
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts.append(base * rng.randint(1, 3) + base[:20])
        for _ in range(3):
            copy = [w if rng.random() > rng.choice([0.005, 0.02, 0.05]) else "new" for w in base]
            texts.append(copy * rng.randint(1, 4) + copy[: rng.randrange(60)])
    cfg, seen = near_dedup.NearConfig(), near_dedup.Words()
    sets = [near_dedup.shingles(" ".join(t), cfg, seen) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [(i, j) for i in range(len(texts)) for j in range(i) if max(near_dedup.similarities(sets[i], sets[j])) >= cfg.similarity]
    for i, j in links:
        parent[find(i)] = find(j)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    caught = sum(found[i] == found[j] for i, j in links)
    assert len(links) > 30 and caught >= 0.99 * len(links)
    assert all(find(i) == find(j) for i in found for j in found if found[i] == found[j])


def test_blocks_of_contested_buckets_lose_no_link(spark):
    """Chains, whose ends are not alike, in blocks of a few rows; few bands, so that buckets hold several groups."""
    rng, texts = random.Random(7), []
    for _ in range(6):
        words = [f"v{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(9):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
    rng.shuffle(texts)
    cfg, seen = near_dedup.NearConfig(block_rows=3, hub_pairs=2, broadcast_hubs=0), near_dedup.Words()
    sets = [near_dedup.shingles(t, cfg, seen) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if max(near_dedup.similarities(sets[i], sets[j])) >= cfg.similarity:
                parent[find(i)] = find(j)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cfg).collect()}
    assert all((found[i] == found[j]) == (find(i) == find(j)) for i in found for j in found)


# --- mixing, urls, media -----------------------------------------------------


@pytest.mark.parametrize("few", [0, 100_000])
def test_mix_goes_on_until_nothing_fits(spark, few):
    """Long documents of falling length stand in the way one after the other."""
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(400 - 9 * k, "a") for k in range(40)] + [(k % 3 + 1, "a") for k in range(50)] + [(900, "b"), (1, "b")])]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.MixConfig(few_rows=few, broadcast_bytes=0 if few == 0 else 8 << 20)).collect()
    per = {r["doc_id"]: r for r in found}
    for s in "ab":
        mine = [per[i] for i, _, x in rows if x == s]
        rest = mine[0]["target"] - sum(r["taken"] for r in mine)
        left = [r["size"] for r in mine if r["copies"] < 3 and r["copies"] == min(x["copies"] for x in mine)]
        assert rest >= 0 and (rest <= 0.001 * mine[0]["target"] or all(n > rest for n in left))


def test_urls_are_cut_at_the_first_mark(spark):
    rows = [(1, "http://good.com/fr/a\x01bad.org/x", None), (2, "http://a.b.c.example.org/en/2://q?x", ""), (3, "x" * 200_000 + "://h/", ""), (4, "http://" + "a." * 100_000 + "com/fr/", ""), (5, "http://z.net/1", ""), (5, "http://y.net/2", "")]
    pages = spark.createDataFrame([(*r, "x", 1.0, "h") for r in rows], "page_id long, url string, html string, host string, trust double, rule string")
    found = url_filter.filter_urls(pages).collect()
    assert len(found) == 6 and {r["host"] for r in found if r["page_id"] == 5} == {"z.net", "y.net"}
    by = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in found}
    assert by[1] == ("good.com", "/fr/a\x01bad.org/x", "com/fr/") and by[2] == ("a.b.c.example.org", "/en/2://q", "org/") and by[3] == ("h", "/", None)
    edges = {(r["source"], r["target"]) for r in url_filter.host_edges(pages).collect()}
    chain = ["a.b.c.example.org", "b.c.example.org", "c.example.org", "example.org"]
    assert edges == {(x, y) for a, b in zip(chain, chain[1:], strict=False) for x, y in ((a, b), (b, a))}  # a host too long for a name has none


def test_damaged_media_are_rows_with_an_error(spark):
    rng = random.Random(8)
    good = media.mux(rng.randbytes(9000), media.MediaConfig())
    for _ in range(4000):
        b = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b) if rng.random() < 0.3 else 400)] = rng.randrange(256)
        b = b[: rng.randrange(len(b))] if rng.random() < 0.2 else b
        try:
            media.payload(bytes(b), media.parse(bytes(b)), 1)
        except media.MatroskaError:
            pass
    stored = spark.createDataFrame([(1, 3, bytes(good)), (2, None, None), (3, 4, b"zz")], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: r for r in media.read(stored).collect()}
    assert rows[1]["error"] is None and rows[1]["payload_bytes"] == 9000 and rows[2]["error"] == "no file" and rows[3]["error"] and rows[3]["feature"] is None
    assert {r["doc_id"] for r in media.packets(stored).collect()} == {1}
    of = lambda x: media.feature(x, media.parse(media.mux(x, media.MediaConfig())))
    assert of(b"a" * 64) != of(b"b" * 64) and of(b"a" * 64) == of(b"a" * 64)
    assert of(bytes([128, 130, 120, 128])).startswith("samples=4;sum=-6;peak=8;crossings=2;steps=20;energy=0,4,64,0;")


# --- the pipeline ------------------------------------------------------------


@pytest.fixture(scope="module")
def wide(spark):
    """Odd rows with columns whose names any operator might use for its own."""
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 3 else "s", None, *["x"] * len(CLASHING)) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None,) * len(rows[0])], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_odd_rows_empty_tables_and_clashing_names(spark, small, wide, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, wide, small)
    rows = out.collect()
    assert stage(spark, wide.limit(0), small).count() == 0
    if k < 4:
        assert out.columns == wide.columns and {r["row"] for r in rows} <= {"x", None}
    if name == "near_dedup":
        assert len(rows) == len({r["text"] or "" for r in wide.collect()})
    if name == "packing":
        assert len(rows) >= wide.count()


def test_pipeline_equals_its_decisions_taken_one_by_one(spark, small, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 140").toPandas().to_dict("records")
    for i in range(12):  # exact and near copies
        words = docs[i * 9]["text"].split(" ")
        if i % 2 and len(words) > 40:
            words[rng.randrange(len(words))] = "changed"
        docs.append({**docs[i * 9], "doc_id": 1000 + i, "text": " ".join(words)})
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    spark.createDataFrame([tuple(d[f] for f in schema.names) for d in docs], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    table = lambda n: spark.read.parquet(str(tmp_path / f"{n}.parquet"))
    frame = lambda ds: spark.createDataFrame([tuple(d[f] for f in schema.names) for d in ds], schema)

    lang = language_id.train(language_id.sample_labelled(table("documents"), language_id.LanguageConfig()), language_id.LanguageConfig())
    docs = [d for d in docs if not language_id.predict_text(d["text"], lang)[2]]
    cfg = quality.QualityConfig()
    fm = quality.train(quality.sample_labelled(frame(docs), table("labels"), cfg), cfg)
    docs = [d for d in docs if fm.score(*quality.features(d["text"], d["n_chars"], quality.Buckets(cfg.buckets))) >= 0.5]
    near, seen = near_dedup.NearConfig(), near_dedup.Words()
    sets = [near_dedup.shingles(d["text"], near, seen) for d in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if docs[i]["text"] == docs[j]["text"] or max(near_dedup.similarities(sets[i], sets[j])) >= near.similarity:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = [min((d for d, r in zip(docs, root, strict=True) if r == k), key=lambda d: d["doc_id"]) for k in sorted(set(root))]
    con = duckdb.connect()
    documents = frame(docs).toPandas()  # read by the query below
    con.register("documents", documents)
    copies = {r[0]: r[-1] for r in con.sql(mixing.oracle(rounds=12)).fetchall()}
    library, want, lengths = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter(), Counter()
    for d in docs:
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        for i, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[d["doc_id"], i, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += copies[d["doc_id"]]
            lengths[len(part)] += copies[d["doc_id"]]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == +want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and min(parts)[0] == 0 and sum(n for _, n in parts) <= 4096
    full = lengths.pop(4096, 0)
    assert len(by) == full + packing.plan_bins({k: n for k, n in lengths.items() if n}, 4096)[1]


def test_stages_are_deleted_when_they_are_read(spark):
    before = common.stage_paths()
    one = common.durable(spark.range(3), "test")
    two = common.durable(spark.range(4), "test")
    assert common.stages_since(before, two) == [one.stage_path]
    common.discard(one)
    assert one.stage_path not in common.stage_paths() and two.count() == 4
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.read.parquet(one.stage_path).count()
    common.discard(two)
