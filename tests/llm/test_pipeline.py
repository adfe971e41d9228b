"""The stages keep what they should, and the last packs all that is left."""

import os

import pytest

pytest.importorskip("weftline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        rows = after.collect()
        kept[name] = {r.doc_id for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    order = [n for n, _ in corpus_pipeline.STAGES[:-1]]
    for a, b in zip(order, order[1:]):
        assert kept[b] <= kept[a]
    assert kept["secrets"] == kept["decontamination"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & kept["toxicity"]) < 0.5 * len(toxic)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == kept["secrets"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_on_awkward_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    names = ["overlap", "toxicity", "row", "spans", "id", "component_id", "ids"]
    extra = ", ".join(f"{n} string" for n in names)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    long = "lorem ipsum dolor sit amet " * 3000
    texts = [(1, None), (1, None), (2, ""), (None, "no id"), (3, "twice the very same row of text"), (3, "twice the very same row of text"), (4, "twice the very same row of text"), (5, long), (6, "token = k2J8s5Lw9r here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *["mine"] * len(names)) for i, t in texts], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    rows = kept.collect()
    # only the copies are gone, and the secret
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in rows) == [(0, "no id"), (1, ""), (1, ""), (2, ""), (3, "twice"), (5, "lorem"), (6, "*****")]
    assert all(r.overlap == r.row == r.ids == "mine" for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {None, 1, 2, 3, 5, 6} and all(len(r.ids) == 4 * r.length for r in packed)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_duplicates_and_contamination_against_brute_force(spark):
    """What the second and third stage keep of the smallest tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    sets = {}
    for i, r in rows.items():
        w = (r.text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    stages = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stages["near_duplicates"](spark, docs, SF).collect()} == {i for i in sets if find(i) == i}
    import re

    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        n = min(13, len(w))
        windows.update({tuple(w[k : k + n]): n for k in range(len(w) - n + 1) if n})
    clean = set()
    for i, r in rows.items():
        w, hit = split(r.text), set()
        for n in set(windows.values()):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    assert {r.doc_id for r in stages["decontamination"](spark, docs, SF).collect()} == clean
