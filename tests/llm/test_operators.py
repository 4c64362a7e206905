"""Operators against brute force on small tables, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionlens.llm import ann, exact_dedup, html_text, licenses, mixing, packing, quality, secrets, set_join, simhash, toxicity
from sessionlens.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, _keep string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").collect()]
    rows += [(1000 + i, rows[3][1], "src1") for i in range(6)] + [(2000, None, None), (2001, "", "src2"), (2002, " \n", "src2"), (2003, "one two", "src3")]
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "x") for i, t, s in rows], SCHEMA).repartition(5).cache()


def collected(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = collected(exact_dedup.exact_dedup(docs, keep="max"))
    for i, t in texts.items():
        same = [j for j, u in texts.items() if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(set(texts.values()))


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs.collect()}
    root = {i: i for i in fps}
    for _ in fps:
        after = {i: min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3) for i in fps}
        if after == root:
            break
        root = after
    got = collected(simhash.simhash_components(docs))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fps[i]:016x}", root[i]) for i in fps}


@pytest.mark.parametrize(("radius", "crowded", "similarity", "small"), [(3, 8, None, 100_000), (3, 12, 0.8, 0), (6, 256, 0.8, 100_000)])
def test_near_links_have_all_components(spark, monkeypatch, radius, crowded, similarity, small):
    monkeypatch.setattr(simhash, "SMALL", small)  # 0: joins go by salted keys
    r = np.random.default_rng(1)
    base = [*r.integers(-(2**62), 2**62, 4), *(r.integers(0, 2**20, 8) << 40)]  # values that share 40 bits are crowded, and split on the others
    fps = [int(b ^ np.bitwise_or.reduce([np.int64(1) << np.int64(k) for k in r.choice(60, r.integers(0, 4), False)] or [np.int64(0)])) for b in base for _ in range(8)]
    texts = [" ".join(f"w{k}" if r.random() < 0.985 else f"x{r.integers(0, 99)}" for k in range(120)) for _ in fps]
    if similarity:  # in dense values sketches decide: texts are far above the similarity, or far below
        texts = [" ".join(f"{'ab'[r.random() < 0.5]}{k}" if i % 4 == 0 else f"w{k}" for k in range(120)) for i in range(len(fps))]
    sets = [set_join.shingle_set(t, 5) for t in texts]
    nodes = spark.createDataFrame([(i, fp, simhash.sketch(t)) for i, (fp, t) in enumerate(zip(fps, texts, strict=True))], "node long, fp long, sk binary")
    whole = spark.createDataFrame([(i, simhash.short_set(s)) for i, s in enumerate(sets)], "node long, set binary")
    links = {tuple(x) for x in simhash.near_links(nodes, radius, pairs=4 * crowded, crowded=crowded, block=16, similarity=similarity, sets_of=lambda wanted: whole.join(wanted, "node")).collect()}

    def parts(pairs):
        root = list(range(len(fps)))
        for _ in range(40):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    def alike(a, b):
        return similarity is None or len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= similarity

    n = range(len(fps))
    want = {(a, b) for a in n for b in n if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= radius and alike(a, b)}
    assert want and links <= want and parts(links) == parts(want)


def test_dense_values_change_no_component(spark):
    """Texts about the similarity itself: their sets decide in dense values and others, and in components of one block or several."""
    r = np.random.default_rng(5)
    sets = [set_join.shingle_set(" ".join(f"w{k}" if r.random() < 0.985 else f"x{r.integers(99)}" for k in range(200)), 5) for _ in range(90)]
    sketches = [bytes((s[:, None] * simhash._DRAW[None, : simhash.SKETCH]).min(axis=0).astype(">u8").view(np.uint8)[1::8].tolist()) for s in sets]
    nodes = spark.createDataFrame([(i, int(i % 3), k) for i, k in enumerate(sketches)], "node long, fp long, sk binary")
    whole = spark.createDataFrame([(i, simhash.short_set(s)) for i, s in enumerate(sets)], "node long, set binary")
    want = simhash.set_forest(pd.DataFrame({"root": 0, "node": range(90), "fp": 0, "lo": 0, "hi": 0, "set": [simhash.short_set(s) for s in sets]}), 7, 0, 0.8)
    assert 20 < len(want) < 85

    def parts(pairs):
        root = list(range(90))
        for _ in range(90):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    of = lambda wanted: whole.join(wanted, "node")
    for pairs in (16, 1 << 30):
        assert parts([tuple(x) for x in simhash.near_links(nodes, 7, pairs=pairs, crowded=8, block=16, similarity=0.8, sets_of=of).collect()]) == parts(want)
    every = spark.createDataFrame([(0, i) for i in range(1, 90)], "a long, b long")
    assert parts([tuple(x) for x in simhash.alike(every, simhash.short_sketches(nodes), 7, 0.8, of, block=20).collect()]) == parts(want)


def test_equal_fingerprints_of_unlike_texts_stay_apart(spark):
    line = " ".join(f"word{i}" for i in range(9))
    texts = [" ".join([line] * 40 + [f"{c}{i}" for i in range(100)]) for c in "abcd"]
    got = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=0.8)
    assert got.count() == 4


def test_drop_near_copies_by_similarity(spark):
    r = np.random.default_rng(3)
    texts = [[f"w{x}" for x in r.integers(0, 4000, 300)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    for i, w in enumerate(texts):  # one word changed of 300 (similarity 0.97); 60 changed (below 0.3)
        near, far = list(w), list(w)
        near[150] = "changed"
        for k in range(0, 300, 5):
            far[k] = "far"
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(far))]
    rows += [(None, "no id"), (400, None), (401, ""), (402, "one two"), (402, "one two")]
    kept = [x["doc_id"] for x in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert len([i for i in kept if i is not None and 100 <= i < 200]) <= 1  # within 7 bits but for rare chance
    assert {i for i in kept if i is not None and not 100 <= i < 200} == {*range(30), *range(200, 230), 400, 402}
    assert kept.count(None) == 1 and kept.count(402) == 1


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces = packing.pack_documents(docs, tokenizer_path()).collect()
    of, seq = {}, {}
    for p in pieces:
        of.setdefault(p["doc_id"], []).append(p)
        assert p["row"] == of[p["doc_id"]][0]["row"]
        seq.setdefault(p["sequence_id"], []).append(p)
    assert of.keys() == ids.keys()
    for i, ps in of.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[i])
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    tokens = sum(map(len, ids.values()))
    assert len(seq) * 2048 <= 1.05 * tokens + 2048  # padding of a twentieth at most


def test_mixing(docs):
    mix = mixing.mix_sources(docs, block=16)
    rows = mix.documents.collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    slots = sorted(mix.schedule.collect(), key=lambda r: r["position"])
    need = Counter(r["source_no"] for r in slots)
    seen, total = Counter(), len(slots)
    for t, r in enumerate(slots, 1):  # every prefix of the schedule holds each source's share, within a few slots
        seen[r["source_no"]] += 1
        assert all(abs(seen[s] - t * n / total) <= 4 for s, n in need.items())

    # by hand: a source's words in shuffled order, its slots in theirs
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    of_slot = {(r["source_no"], r["rank"]): r for r in slots}
    assert len(of_slot) == total
    sizes = {r["doc_id"]: r["size"] for r in rows}
    for no, s in enumerate(names):
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        stream = [r["doc_id"] for r in own for _ in range(r["size"])]
        blocks = -(-len(stream) // 16)
        taken, first, copies = Counter(), {}, {}
        for rank in range(need[no]):
            slot = of_slot[no, rank]
            for d in stream[rank % blocks * 16 :][: slot["words"]]:
                taken[d] += 1
                first[d] = min(first.get(d, slot["position"]), slot["position"])
                e = copies.setdefault(d, {}).setdefault(rank // blocks, [slot["position"], 0])
                e[0], e[1] = min(e[0], slot["position"]), e[1] + 1
        assert {r["doc_id"]: (r["taken"], r["first_position"]) for r in own} == {r["doc_id"]: (taken[r["doc_id"]], first.get(r["doc_id"])) for r in own}
        assert all([(c["epoch"], c["position"], c["words"]) for c in r["copies"]] == [(e, *v) for e, v in sorted(copies.get(r["doc_id"], {}).items())] for r in own)

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = sorted([(c["position"], r["doc_id"], c["words"]) for r in rows for c in r["copies"]] + [(-1, r["doc_id"], 0) for r in rows if not r["size"]])
    got = mixing.apply_mix(docs, mix).collect()
    assert [r["doc_id"] for r in got] == [d for _, d, _ in want]
    for r, (_, d, n) in zip(got, want, strict=True):
        assert r["text"] == texts[d] if n == sizes[d] else r["text"].split(" ") == [w for w in re.split(r"[\x20\x09-\x0D]+", texts[d]) if w][:n]


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(e).count() == simhash.simhash_components(e).count() == secrets.scan_secrets(e).count() == 0
    assert mixing.mix_sources(e).documents.count() == packing.pack_documents(e, tokenizer_path()).count() == 0


@pytest.fixture(scope="module")
def rough(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} token:abc{i}" for i in range(60_000))
    rows = [(None, "some text", "en", "s"), (None, None, None, None), (1, long, "en", None), (2, "", None, "s"), (3, "same", "en", "s"), (3, "same", "en", "s"), (4, "same", None, "t")]
    return spark.createDataFrame([(*r, None, 7, "x") for r in rows], SCHEMA).repartition(3).cache()


def test_rough_rows(rough):
    n = rough.count()
    dedup = exact_dedup.exact_dedup(rough).collect()
    assert len(dedup) == n and sum(r["kept"] for r in dedup) == 4 and {r["group_size"] for r in dedup if r["doc_id"] in (3, 4)} == {3}
    parts = simhash.simhash_components(rough).collect()
    assert len(parts) == n and {r["component_id"] for r in parts if r["doc_id"] in (3, 4)} == {3}
    found = secrets.scan_secrets(rough).collect()
    assert len(found) == n and sum(len(r["spans"]) for r in found) == sum(len(f"abc{i}") >= 6 for i in range(60_000))
    mix = mixing.mix_sources(rough).documents.collect()
    assert len(mix) == n and all(r["taken"] <= 2 * r["size"] for r in mix)
    assert mixing.apply_mix(rough, mixing.mix_sources(rough)).columns == rough.columns
    pieces = packing.pack_documents(rough, tokenizer_path()).collect()
    totals = {}
    for p in pieces:
        totals[p["doc_id"]] = totals.get(p["doc_id"], 0) + p["length"]
    assert totals[2] == 1 and totals[1] == next(p["doc_tokens"] for p in pieces if p["doc_id"] == 1)


def test_licenses_inherit_from_the_nearest_directory(spark):
    mit, apache = licenses.NOTICES["MIT"], licenses.NOTICES["Apache-2.0"]
    rows = [("a/LICENSE", mit), ("a/b/LICENSE", "x\n" + apache), ("a/b/c/one.txt", "plain"), ("a/two.txt", None), ("a/b/own.py", mit), ("z/three.txt", ""), (None, mit), ("a/two.txt", None), ("a/b/COPYING", "no notice")]
    got = licenses.scan_licenses(spark.createDataFrame([(*r, 1.0) for r in rows], "path string, text string, score double")).collect()
    assert len(got) == len(rows)
    by = {r["path"]: (r["license"], r["how"], r["from_dir"]) for r in got}
    assert by["a/b/c/one.txt"] == ("Apache-2.0", "inherited", "a/b") and by["a/two.txt"] == ("MIT", "inherited", "a")
    assert by["a/b/own.py"] == ("MIT", "header", None) and by["z/three.txt"] == by[None] == (None, "none", None)


def test_classifiers_and_pages_on_rough_rows(spark, rough):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for got in (quality.classify_quality(rough, labels), toxicity.classify_toxicity(rough, labels), quality.classify_quality(rough, labels.limit(0)), toxicity.classify_toxicity(rough, labels.limit(0))):
        rows = got.collect()
        assert len(rows) == rough.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.keep_good(rough, labels.limit(0)).columns == rough.columns
    pages = spark.createDataFrame([(1, None, "<p>a</p>"), (2, "http://h/x", None), (2, "http://h/x", None), (None, "http://[", ""), (3, "http://h/y", "<p>" + "word " * 200_000 + "</p>")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in html_text.main_text(pages).collect())
    assert got == [(0, 0), (1, 1), (2, 0), (2, 0), (3, 5 * 200_000 - 1)]


def rows_of_joins(spark, first, keys):
    """Rows that inner joins by `keys` made in all executions from number `first` on."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for at in range(first, store.executionsCount()):
        run = store.executionsList(at, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and keys.fullmatch(node.desc()):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


def test_probes_are_summed_before_they_meet_counted_values(spark):
    """The join that finds dense values makes a row a value at most, however many probes ask for it."""
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 11, 1500)).astype(np.int64)  # few bits vary: values have many members, probes meet many of them
    nodes = spark.createDataFrame([(i, int(x) * 0x10000100001) for i, x in enumerate(fps)], "node long, fp long")
    first = spark._jsparkSession.sharedState().statusStore().executionsCount()
    links = simhash.near_links(nodes, 3, pairs=1 << 30)  # none is dense
    assert links.count() > len(fps)
    assert 0 < rows_of_joins(spark, first, re.compile(r".*Join \[part#\w+, key#\w+\], \[part#\w+, key#\w+\], Inner(, Build\w+)?(, false)?.*", re.S)) < 4 * len(fps)
