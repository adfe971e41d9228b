"""Brute-force versions of what SQL cannot say, and what each operator does with awkward tables."""

import collections
import hashlib
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest

pytest.importorskip("weftline.llm")

from pyspark.sql import functions as F  # noqa: E402

from weftline.llm import common, decontaminate, fingerprint, html_wrapper, jaccard_join, license_scan, lm_score, packing, secret_scan, suffix_dedup, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BENCH, LABELS, PAGES = "item_id long, text string", "doc_id long, quality int, toxic int", "page_id long, url string, html string"


def frame(spark, rows, owner=None):
    return spark.createDataFrame([(i, t, "en", owner or f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)


LONG = "lorem ipsum dolor sit amet " * 8000
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (None, None), (None, "no id here"), (4, "same row twice over"), (4, "same row twice over"), (5, LONG), (6, LONG + "tail"), (7, "\u00e9" * 3 + "\U0001f600 \x00 \u2028x")]


@pytest.fixture(scope="module")
def awkward(spark):
    """With columns that the operators might want for themselves."""
    names = ["overlap", "toxicity", "licenses", "row", "spans", "id", "held", "shard", "bucket", "fingerprint", "canon", "sig", "component", "host", "main", "n_hit", "y"]
    return frame(spark, AWKWARD).select("*", *[F.lit("mine").alias(n) for n in names])


def test_awkward_tables_and_names(spark, awkward):
    n, ids = len(AWKWARD), collections.Counter(i for i, _ in AWKWARD)
    bench = spark.createDataFrame([(1, "same row twice over"), (None, None), (2, "")], BENCH)
    got = decontaminate.find_overlaps(awkward, bench)
    assert "_overlap" in got.columns and got.columns[: len(awkward.columns)] == awkward.columns
    rows = got.collect()
    assert len(rows) == n and sum(r._overlap.n_hit for r in rows) == 8 and all(r.overlap == "mine" for r in rows)
    found = jaccard_join.similar_components(awkward).collect()
    assert collections.Counter(r.doc_id for r in found) == ids
    assert {r.doc_id: r.component_id for r in found}[6] == 5 and {r.doc_id: r.n_shingles for r in found}[1] == 0
    kept = jaccard_join.representatives(awkward)
    assert kept.columns == awkward.columns and collections.Counter(r.doc_id for r in kept.collect()) == {1: 1, 2: 1, 3: 1, None: 2, 4: 1, 5: 1, 7: 1}
    model = toxicity.train(awkward, spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 1, 1), (None, 1, 1), (5, 1, None)], LABELS), keep=lambda c: c > 0)
    scored = toxicity.add_score(awkward, model).collect()
    assert len(scored) == n and all(0 <= r._toxicity.score <= 1 and r.toxicity == "mine" for r in scored)
    assert suffix_dedup.remove_repeats(awkward).count() == n
    assert fingerprint.compare_with_next(awkward).count() == n and fingerprint.exact_groups(awkward).count() == n
    assert lm_score.score(awkward, steps=2).count() == n
    got = license_scan.find_licenses(awkward).collect()
    assert len(got) == n and all(r._licenses.found == [] and r.licenses == "mine" for r in got)
    assert collections.Counter(r.doc_id for r in secret_scan.scan(awkward).collect()) == ids
    masked = secret_scan.mask(awkward)
    assert masked.columns == awkward.columns and masked.count() == n
    pages = spark.createDataFrame([(1, None, None), (1, "http://a.example", ""), (2, "HTTP://A.EXAMPLE/x", "<p>x")], PAGES).select("*", F.lit("mine").alias("host"), F.lit("mine").alias("main"), F.lit("mine").alias("path"), F.lit("mine").alias("both"))
    got = html_wrapper.add_text(pages).collect()
    assert len(got) == 3 and {r._main.text for r in got} == {"", "x"} and all(r.main == r.host == r.path == r.both == "mine" for r in got)


def test_awkward_packing(spark, awkward):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    got = packing.pack(awkward, path).collect()
    tokens = collections.Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens[1] == tokens[2] == tokens[3] == 1 and tokens[5] > 40_000 and set(tokens) == {i for i, _ in AWKWARD}


def test_no_training_fold(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lm_score.score(frame(spark, [(i, "a b") for i in held]), steps=2).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.n_tokens == 3 and r.score < 0 for r in got) and len(got) == 3


def test_intermediate_tables_are_shared_and_deleted(spark, tmp_path):
    made = common.checkpointed(spark.range(5))
    assert made._weftline_table.startswith(common.shared_folder(spark)) and made.count() == 5
    common.release(made)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(made._weftline_table).count()


def test_with_class(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(9999, None)], "id long, k string")
    classes = rows.where("k <> 'k3'").groupBy("k").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    got = {r.id: r.least for r in common.with_class(rows, classes, ["k"], "n").collect()}
    assert got == {**{i: 1 if i % 3 else i for i in range(3000)}, 3: None, 9999: None}


def test_window_tables_against_plain_search():
    rnd = random.Random(3)
    words = [b"a", b"b", b"c", b"d"]
    for _ in range(200):
        block = [(k, " ".join(x.decode() for x in rnd.choices(words, k=rnd.randrange(0, 9)))) for k in range(4)]
        text = rnd.choices(words, k=40)
        tables = decontaminate._tables(block, 5)
        spans, ids = decontaminate.scan(text, tables)
        hit, want = set(), set()
        for k, t in block:
            w = t.encode().split()
            m = min(5, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                for j in range(len(text) - m + 1):
                    if text[j : j + m] == w[i : i + m]:
                        hit.update(range(j, j + m))
                        want.add(str(k))
        assert ids == want and {x for a, z in spans for x in range(a, z)} == hit


def test_similarity_of_exactly_the_bound(spark):
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, "x " + tail), (2, "y " + tail)]  # 8 of 10 shingles
    assert {r.component_id for r in jaccard_join.similar_components(frame(spark, rows)).collect()} == {1}
    rows = [(1, "x " + tail), (2, "y " + tail + " z")]  # 8 of 11
    assert {r.component_id for r in jaccard_join.similar_components(frame(spark, rows)).collect()} == {1, 2}


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, a + " end"), (9, b + " end"), (8, c), (7, c), (7, c)]
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(frame(spark, rows)).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 8: 7, 7: 7}  # equal ids are one node
    kept = sorted((r.doc_id, r.text[0]) for r in jaccard_join.representatives(frame(spark, rows)).collect())
    assert kept == [(3, "a"), (5, "b"), (7, "c")]  # each text has one that is like it
    assert [r.doc_id for r in jaccard_join.representatives(frame(spark, [(1, "x y"), (1, "x y"), (2, "x y")])).collect()] == [1]


def test_swaps():
    assert toxicity.swaps({b"old", b"young", b"man"}) == [{b"old", b"young", b"girl"}, {b"old", b"young", b"woman"}]
    assert toxicity.swaps({b"black", b"coffee"}) == [] and toxicity.swaps({b"muslim", b"friend"}) == [{b"christian", b"friend"}, {b"atheist", b"friend"}]
    assert toxicity.swaps({b"femmes"}) == [{b"hommes"}] and toxicity.swaps(set()) == []


def test_toxicity_fit_against_a_plain_minimiser():
    rnd = np.random.default_rng(1)
    rows = [(int(y), sorted(rnd.choice(6, 3, replace=False).tolist())) for y in rnd.integers(0, 2, 80)]
    pairs = [([0], [1]), ([2], [3]), ([0, 4], [5])]
    strength = np.array([1.0, -0.8, 0.5, 0.3, -0.4, 0.9])

    def loss(bias, w):  # w: weights of the features themselves
        z = np.array([bias + sum(w[f] for f in fs) for _, fs in rows])
        y = np.array([r[0] for r in rows])
        gap = np.array([sum(w[i] for i in plus) - sum(w[i] for i in minus) for minus, plus in pairs])
        return np.mean(np.logaddexp(0, z) - y * z) + 2.0 * np.mean(gap**2) + 0.5 * 1e-3 * np.sum((w / strength) ** 2) / len(w)

    bias, w = toxicity.fit(rows, pairs, strength, counterfactual=2.0, steps=3000, rate=0.02)
    best = loss(bias, w)
    for i in range(6):
        for step in (-0.02, 0.02):
            moved = w.copy()
            moved[i] += step
            assert loss(bias, moved) > best - 1e-6
    assert loss(bias + 0.02, w) > best - 1e-6 and loss(bias - 0.02, w) > best - 1e-6


def test_html_names_and_tags():
    page = "<body><div class=site-notice>Cookies!</div><article><p class=notice-text>One</p><p id='ad-hoc'>Two</p><div class='related-work'>Three</div><div class='ad'>Buy</div><img alt=don't src=x.png><section class=comments>Nice!</section><p title=\"a > b\">Four</p></article><div id=footer-links>Imprint</div></body>"
    assert html_wrapper.extract(page) == "One\nTwo\nThree\nFour"
    assert html_wrapper.extract("<p class='open>lost</p><p>kept</p>") in ("kept", "lost\nkept")
    assert html_wrapper.extract("a < b &lt; c <3 <!-- x --> d <br/>e") == "a < b < c <3 d e"
    assert html_wrapper.extract("<p>x<p>y<ul><li>1<li>2</ul>z") == "x\ny\n1\n2\nz"
    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        html_wrapper.extract("<p a=\"b>x</p>" * n + "<a '" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2  # in proportion, not to the square


def test_html_without_hosts(spark):
    rows = [(1, None, "<div class=a>Same</div><div class=b>One</div>"), (2, "nowhere", "<div class=a>Same</div><div class=b>Two</div>")]
    got = {r.page_id: r.text for r in html_wrapper.add_text(spark.createDataFrame(rows, PAGES)).select("page_id", "main.text").collect()}
    assert got == {1: "Same\nOne", 2: "Same\nTwo"}


def test_html_pages_of_known_content(spark):
    """Sites of several layouts, whose articles are known, with varied furniture."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    layouts = [
        ("<header class=top><a href=/>{site}</a></header><nav><ul><li>Home<li>About</ul></nav><main><h1>{title}</h1>{body}</main><aside>More from {site}</aside><footer>Imprint {site}</footer>", "{site}"),
        ("<div id=cookie-banner>We use cookies</div><div class=wrap><div class='post'><h2>{title}</h2>{body}</div><div class=promo>Buy {site}</div></div><div class=site-footer>{site} 2024</div>", "{site}"),
        ("<body><div>{site} daily</div><table><tr><td><div class=story><h1>{title}</h1>{body}</div></td></tr></table><div>Subscribe to our newsletter</div><form><input value=x>Search</form></body>", "{site}"),
    ]
    rows, want = [], {}
    for s, (layout, _) in enumerate(layouts):
        for k in range(6):
            title, body = f"{word()} {word()}", [" ".join(word() for _ in range(12)) for _ in range(3)]
            html = layout.format(site=f"Site{s}", title=title, body="".join(f"<p>{b}</p>" for b in body))
            rows.append((10 * s + k, f"http://s{s}.example/{k}", f"<html><head><title>{title}</title></head>{html}</html>"))
            want[10 * s + k] = "\n".join([title, *body])
    got = {r.page_id: r.text for r in html_wrapper.add_text(spark.createDataFrame(rows, PAGES)).select("page_id", "main.text").collect()}
    assert got == want


def plain_canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", folded).strip()


def test_fingerprints_name_the_same_texts(spark):
    rnd = random.Random(6)
    parts = ["Stra\u00dfe", "STRASSE", "\ufb01ne", "fine", "\u00c5", "A\u030a", " ", "  ", "\n", "x", "\u2126", "\u03a9", "\u0130"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(4)))) for i in range(150)]
    first: dict[str, int] = {}
    for i, t in rows:
        first.setdefault(plain_canonical(t), i)
    got = fingerprint.exact_groups(frame(spark, rows)).collect()
    assert {r.doc_id: r.group_id for r in got} == {i: first[plain_canonical(t)] for i, t in rows}
    assert len({r.fingerprint for r in got}) == len(first)


def test_fingerprint_collisions_are_told_apart_by_bytes(spark, monkeypatch):
    import weftline.llm.fingerprint as module

    docs = frame(spark, [(1, "one"), (2, "two"), (3, "ONE"), (4, "two "), (5, "three")])
    printed = lambda d, **k: d.withColumn("p", F.struct(F.lit("same").alias("fingerprint")))
    monkeypatch.setattr(module, "add_fingerprint", printed)
    real = module.annotate
    monkeypatch.setattr(module, "annotate", lambda *a: real(*a).withColumn("c", F.struct(F.col("c.canon").alias("canon"), F.lit("same").alias("mark"))))
    assert {r.doc_id: r.group_id for r in module.exact_groups(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


def test_many_rows_of_one_id(spark):
    docs = frame(spark, [(7, f"text number {i}") for i in range(40)] + [(8, "other")])
    got = fingerprint.compare_with_next(docs).collect()
    texts = sorted([f"text number {i}" for i in range(40)]) + ["other"]
    edited = [t[: len(t) - len(t) // 4] + texts[(k + 1) % 41][: len(t) // 4] for k, t in enumerate(texts)]
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edited)


def test_packing_leaves_little_padding():
    rnd = random.Random(5)
    packer = packing.Packer(0)
    total = 0
    for k in range(3000):
        n = int(min(9000, rnd.expovariate(1 / 600))) + 1
        packer.add(k, b"\1\0\0\0" * n)
        total += n
    if packer.held:
        packer.deal()
    used = {r[5] for r in packer.rows}
    assert sum(r[2] for r in packer.rows) == total and total / (2048 * len(used)) > 0.98


def test_another_tokenizer_is_not_taken_for_the_known_one(tmp_path):
    import json

    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    form = json.loads(open(path, encoding="utf-8").read())
    assert packing.Encoder(path).known
    form["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(form), encoding="utf-8")
    encoder, text = packing.Encoder(str(other)), "year 2024, it's a1b2!!"
    assert not encoder.known
    assert list(memoryview(encoder(text)).cast("I")) == Tokenizer.from_file(str(other)).encode(text, add_special_tokens=False).ids


def test_licenses_against_plain_search():
    """Wordings put in anywhere, wrapped anywhere: found by looking for their words in a row."""
    rnd = random.Random(9)
    scanner = license_scan.Scanner()
    every = [(name, w) for name, ws in license_scan.TEMPLATES.items() for w in ws]
    for _ in range(25):
        picked = rnd.sample(every, rnd.randrange(0, 3))
        parts = [" ".join(rnd.choice(["alpha", "beta", "permission", "gamma"]) for _ in range(rnd.randrange(3, 30)))]
        for _, w in picked:
            parts += [w, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randrange(20, 40)))]
        words = " ".join(parts).split(" ")
        width = rnd.choice([7, 12, 10**6])
        text = "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))
        plain = " ".join(license_scan.words(text))
        want = {name for name, w in every if f" {' '.join(license_scan.words(w))} " in f" {plain} "}
        assert {f["license"] for f in scanner.scan(text)[1] if not f["differences"]} >= want


def test_levels_of_evidence_sum_to_one():
    rnd = np.random.default_rng(2)
    p = rnd.dirichlet(np.ones(50))
    for _ in range(3):  # counts of 50 outcomes after one history
        n = rnd.integers(0, 9, 50)
        p = lm_score.stacked(p, n, np.full(50, n.sum()), 1.7)
        assert abs(p.sum() - 1) < 1e-12 and (p > 0).all()
    assert (lm_score.stacked(p, np.zeros(50, int), np.zeros(50, int), 1.7) == p).all()


def test_class_gradient_is_that_of_the_likelihood():
    rnd = np.random.default_rng(3)
    weights = rnd.normal(scale=0.1, size=(lm_score.ROWS, lm_score.CLASSES))
    history, counts, features = np.array([5, 700, 9000]), rnd.integers(0, 4, (3, lm_score.CLASSES)).astype(float), lm_score._feature_rows()
    grad, value = lm_score.gradient(weights, history, counts, features)
    logp = lm_score.class_log_probs(weights, features[history])
    assert np.allclose(np.exp(logp).sum(1), 1)
    for row, col in ((features[5][1], 3), (features[700][2], 50), (0, 7)):
        moved = weights.copy()
        moved[row, col] += 1e-5
        assert (lm_score.gradient(moved, history, counts, features)[1] - value) / 1e-5 == pytest.approx(grad[row, col], abs=1e-3)


def test_secrets_against_plain_patterns(spark):
    rnd = random.Random(10)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "hunter2xyz", "ab", "AKIA", "ABCDEFGHIJKLMNOP1", "0123456789abcdef", "89abcdef", "\u00e9", "\U0001f600", "\n", "X1y2Z3w4V5u6T7s8R9q0", "+/_.-"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))) for i in range(400)] + [(999, None)]
    named = [
        ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    want = {}
    for i, t in rows:
        spans = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(named) for m in p.finditer(t or "") if len(m[g]) >= least]
        want[i] = [f"{named[k][0]}:{a}:{z}" for a, k, z in sorted(spans)]
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.secrets if s.base] for r in secret_scan.scan(frame(spark, rows)).collect()}
    assert got == want


def test_verdicts_by_owners_repositories_and_looks(spark):
    docs = [(i, "token = q7W3k9Zp2x") for i in range(60)] + [(100, "password = changeme1"), (101, "token = k2J8s5Lw9r"), (102, "secret = aaaaaa11")]
    got = {r.doc_id: r.secrets[0] for r in secret_scan.scan(frame(spark, docs, owner="one")).collect()}
    assert (got[0].verdict, got[0].n_owners, got[0].n_repos) == ("example", 1, 60)  # in many repositories of one owner
    assert [got[i].verdict for i in (100, 101, 102)] == ["placeholder", "owned", "placeholder"]
    masked = {r.doc_id: r.text for r in secret_scan.mask(frame(spark, docs, owner="one").repartition(7)).collect()}
    assert masked[101] == "*" * 18 and masked[100] == "password = changeme1" and masked[5] == "token = q7W3k9Zp2x"
