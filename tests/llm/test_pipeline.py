import hashlib
import importlib
import re
import struct
import sys

import pytest
import xxhash

import corpus_pipeline
from quillsift.llm import mixing, quality, sentencepiece_codec, simhash

from test_text_models import targets_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the output of every stage, written and read again."""
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(top / str(k)))
        done = spark.read.parquet(str(top / str(k)))
        out.append((name, docs, done))
        docs = done
    return out


def test_all_but_the_last_return_documents(stages):
    for _, before, after in stages[:-1]:
        assert sorted(after.columns) == sorted(corpus_pipeline.COLUMNS) and dict(after.dtypes) == dict(before.dtypes)


def test_quality_stage(spark, stages):
    _, before, after = stages[0]
    want = {r["doc_id"] for r in quality.quality(before, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"] == 1}
    assert {r["doc_id"] for r in after.collect()} == want and 0 < len(want) < before.count()


def test_exact_stage_against_brute_force(stages):
    _, before, after = stages[1]
    best = {}
    for r in before.collect():
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(best.values())


def test_near_stage_against_brute_force(stages):
    _, before, after = stages[2]
    bits = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in before.collect()}
    label = {k: k for k in bits}
    for _ in bits:
        moved = False
        for a in bits:
            for b in bits:
                if (bits[a] ^ bits[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], moved = label[b], True
        if not moved:
            break
    assert {r["doc_id"] for r in after.collect()} == {k for k in bits if label[k] == k}


def test_mix_stage_follows_its_plan(stages):
    _, before, after = stages[3]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.plan(before, whole=True).collect() if r["taken"]}
    got = {}
    for r in after.collect():
        assert r["text"] == texts[r["doc_id"]]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want


def test_last_stage_and_run(spark, stages):
    _, before, after = stages[4]
    assert after.count() == before.count() and after.where("NOT round_trip").count() == 0
    key = lambda rows: sorted((r["doc_id"], hashlib.md5(str(r["ids"]).encode()).hexdigest()) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(after.collect())


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "same text", "en", "a", 9), (1, "same text", "en", "a", 9), (2, "same text", "en", "a", 9), (2, "same text", "en", "a", 9), (None, "no id", "en", None, 5), (3, None, None, None, None), (4, "", "en", "b", 0), (5, "same text", "en", "a", 9), (5, "other", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.drop_copies(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in once.collect()) == [(0, "no id"), (4, ""), (5, "other"), (5, "same text")]
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    # of the five rows that say the same the first stays, once; of the two without words, the one of the smaller id
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near.collect()) == [(0, "no id"), (1, "same text"), (3, ""), (5, "other")]
    unique = docs.where("doc_id IN (1, 3, 4)").distinct()
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, unique, SF).collect()) == [1, 4]
    mixed = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, docs, SF).collect()]
    want = {}
    for r in mixing.plan(docs, whole=True).collect():
        if r["taken"]:
            key = r["doc_id"], r["mark"]
            want[key] = want.get(key, 0) + r["taken"] // r["size"]
    got = {}
    for i, t in mixed:
        key = i, struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest((t or "").encode(), 42)))[0]
        got[key] = got.get(key, 0) + 1
    assert got == want and len(want) >= 3
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix, corpus_pipeline.token_ids):
        assert stage(spark, docs.limit(0), SF).collect() == []


LONG = "many words that go on " * 20000
ODD = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, LONG, "en", "a", 9), (4, LONG, "en", None, 9), (4, LONG, "en", None, 9), (None, "no id at all", "en", "b", 1), (None, "none here either, you see", "en", "b", 1), (7, "\n \t", "en", "b", 3)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_every_stage_takes_odd_rows(spark, name, stage):
    """Nulls in every column, empty and very long texts, repeated rows, an empty table, extra columns with clashing names."""
    clash = "component string, key string, kept string, n string, row string, position string, score string, predicted string, ids string, own_sha256 string"
    docs = spark.createDataFrame([(*r, *"abcdefghij") for r in ODD], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    got = stage(spark, docs, SF)
    rows = got.collect()
    assert stage(spark, docs.limit(0), SF).collect() == []
    if stage is corpus_pipeline.token_ids:
        assert len(rows) == len(ODD) and all(r["round_trip"] for r in rows)
        return
    assert got.columns == list(corpus_pipeline.COLUMNS) and {(r["doc_id"], r["text"]) for r in rows} <= {r[:2] for r in ODD}
    texts = sorted(r["text"] or "" for r in rows)
    if stage is corpus_pipeline.drop_copies:
        assert texts == sorted({r[1] or "" for r in ODD})
    if stage is corpus_pipeline.drop_near_copies:
        assert texts.count(LONG) == 1 and sum(not t.strip() for t in texts) == 1
    if stage is corpus_pipeline.mix:
        assert {r["doc_id"] for r in rows} <= {3, 4, None}


def test_the_whole_pipeline_against_brute_force(spark):
    """The last stage's ids are the encoded texts of what the first four keep, worked out in plain Python from the classifier's answers on."""
    docs = [(r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = {r["doc_id"] for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"] == 1}
    best = {}
    for i, t, s in docs:
        if i in good and i >= best.get(t, (-1,))[0]:
            best[t] = (i, t, s)
    bits = {i: simhash.fingerprint(t) for i, t, _ in best.values()}
    label = {i: i for i in bits}
    for _ in bits:
        joined = {a: min(label[b] for b in bits if (bits[a] ^ bits[b]).bit_count() <= 3) for a in bits}
        if joined == label:
            break
        label = joined
    left = [(i, t, s) for i, t, s in best.values() if label[i] == i]
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in left}
    sizes = {}
    for i, _, s in left:
        sizes[s] = sizes.get(s, 0) + words[i]
    targets, want = targets_brute(sizes), {}
    for s in sizes:
        done, target = 0, targets[s]
        passes = int(target // sizes[s])
        rest = int(target - passes * sizes[s])
        for i in sorted((i for i, _, x in left if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            partly = max(0, min(words[i], rest - done))
            if n := passes + (2 * partly > words[i]):
                want[i] = n if words[i] else 0
            done += words[i]
    encoder, texts = sentencepiece_codec.Encoder(sentencepiece_codec.load()), {i: t for i, t, _ in left}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r["ids"] == encoder.encode(texts[r["doc_id"]]).tolist()
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in want.items() if n}


def test_entry_without_the_llm_parts(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert "scan_flat" in entry.queries() and "pipeline" not in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.undo()
    entry = importlib.reload(entry)
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in entry.queries()) != 1] == []
