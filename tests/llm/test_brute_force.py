"""What SQL cannot express, against plain versions that go by the letter of the method."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from codeloom.llm import labelled, license_scan, pfair, quality_cnn, shared, toxicity
from codeloom.llm.decontaminate import benchmark_hits, clean
from codeloom.llm.jaccard_join import JaccardJoin
from pyspark.sql import functions as F


def corpus(seed=4, n=60):
    r = random.Random(seed)
    words = ["rain", "falls", "on", "stone", "Wände", "rest", "near", "water", "gromb", "plox"]
    texts, labels = [], []
    for _ in range(n):
        bad = r.random() < 0.4
        texts.append(" ".join(r.choice(words if bad else words[:8]) for _ in range(r.randrange(0, 25))))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_by_sets_of_grams():
    texts, labels = corpus()
    pos, neg = sum(labels), len(labels) - sum(labels)
    grams = [{k: {t[i : i + k] for i in range(len(t) - k + 1)} for k in toxicity.SIZES} for t in texts]
    ratio = {}
    for k in toxicity.SIZES:
        p, q = Counter(), Counter()
        for g, y in zip(grams, labels, strict=True):
            (p if y else q).update(g[k])
        every = {x for x in p if p[x] >= 2} | {x for x in q if q[x] >= max(5, neg // 200)}
        assert len(every) <= 2 * toxicity.MOST_FEATURES // len(toxicity.SIZES), "all are chosen"
        a, b = sum(p[x] + 1 for x in every), sum(q[x] + 1 for x in every)
        ratio |= {x: math.log((p[x] + 1) / a) - math.log((q[x] + 1) / b) for x in every}
    names = sorted(ratio)
    x = np.array([[ratio[n] if n in g[len(n)] else 0.0 for n in names] for g in grams])
    y, w, b = np.array(labels, float), np.zeros(len(names)), math.log(pos / neg)
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, 151):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        g = np.append(x.T @ e / len(y) + 1e-3 * w, e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    others = [*texts, "", "gromb", "a", "plox plox rain", "Ω" * 9, "gromb " * 200000]
    shown = np.array([[ratio[n] if n in t else 0.0 for n in names] for t in others])
    want = 1 / (1 + np.exp(-np.clip(shown @ w + b, -30, 30)))
    model = toxicity.NbLinear.fit(texts, labels)
    assert len(model.hashes) == len(names)
    assert model.score(others) == pytest.approx(want, rel=1e-6)


def test_toxicity_across_steps(monkeypatch):
    texts, labels = corpus()
    model = toxicity.NbLinear.fit(texts, labels)
    whole = model.score([t * 5 for t in texts])
    monkeypatch.setattr(toxicity, "STEP", 16)
    assert model.score([t * 5 for t in texts]) == pytest.approx(whole)


def test_scores_without_labels():
    assert toxicity.NbLinear.fit([], []).score(["", "text"]) == pytest.approx([0.5, 0.5])
    for labels in ([0, 0], [1, 1]):
        assert all(0 <= s <= 1 for s in toxicity.NbLinear.fit(["some text", "other text"], labels).score(["", "some text", "x"]))
        assert all(0 <= s <= 1 for s in quality_cnn.ByteCnn.fit(["some text", "other text"], labels, epochs=1, least_steps=1).score(["", "some text", "x"]))
    assert all(0 <= s <= 1 for s in quality_cnn.ByteCnn.fit([], []).score(["", "text"]))


def plain_answers(net, text):
    """The pooled answers of a text by loops: windows of 16 bytes, one every 8, in chunks of 64."""
    size = max(-(-len(text) // 8), 2) * 8
    raw, p = text.ljust(size, b"\0"), net.p
    answers = []
    for a in range(0, size - 8, 8):
        x = np.concatenate([p["e"][c] for c in raw[a : a + 16]])
        answers.append(x @ p["w"] + p["b"])
    chunks = [np.maximum(np.max(answers[k : k + 64], axis=0), 0) for k in range(0, len(answers), 64)]
    return np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])


def test_quality_by_loops():
    net, r = quality_cnn.ByteCnn(), random.Random(2)
    texts = ["", "a", "Grüße aus Köln", *("".join(chr(r.randrange(32, 300)) for _ in range(n)) for n in (7, 8, 9, 100, 519, 520, 521, 528, 2000))]
    want = [1 / (1 + math.exp(-float(plain_answers(net, t.encode()).astype(float) @ net.p["u"] + net.p["c"][0]))) for t in texts]
    assert net.score(texts) == pytest.approx(want, rel=1e-5)


def test_quality_gradients_by_differences(monkeypatch):
    net, y, weight = quality_cnn.ByteCnn(), np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.5, 2.0])
    r = random.Random(1)
    texts = [bytes(r.choice(b"abcdefg \n") for _ in range(n)) for n in (1400, 5, 1700)]  # without windows that repeat: a maximum that two reach has no gradient
    exact = quality_cnn.ByteCnn()
    exact.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        both = np.array([plain_answers(exact, t) for t in texts])
        z = both @ exact.p["u"] + exact.p["c"]
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / len(texts))

    whole = net.gradients(texts, y, weight)
    monkeypatch.setattr(quality_cnn, "SPAN", 1)
    parts = net.gradients(texts, y, weight)
    for name, grad in whole.items():
        assert parts[name] == pytest.approx(grad, rel=1e-3, abs=1e-6), name
        for i in np.argsort(-np.abs(grad).reshape(-1))[:3].tolist() + [r.randrange(grad.size) for _ in range(3)]:
            spot, h = np.unravel_index(i, grad.shape), 1e-5
            if name == "e" and spot[0] == 0:
                continue
            exact.p[name][spot] += h
            up = loss()
            exact.p[name][spot] -= 2 * h
            down = loss()
            exact.p[name][spot] += h
            assert grad[spot] == pytest.approx((up - down) / (2 * h), rel=2e-2, abs=1e-5), (name, spot)


def test_training_sample_is_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (10 * i)) for i in range(60)] + [(3, "copy")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    held = {r["doc_id"] for r in docs.where(labelled.held_out()).collect()}
    texts, y = labelled.training_sample(docs, labels, "toxic", 1000)
    known = {int(t.split()[0]): v for t, v in zip(texts, y, strict=True) if t != "copy"}
    assert not held & set(known) and len(texts) == 60 - len(held) and known.get(4, 1) == 1 and all(v == (k % 2 or k == 4) for k, v in known.items())
    some, _ = labelled.training_sample(docs, labels, "toxic", 1000, most_bytes=2000)
    assert some and sum(len(t.encode()) for t in some) <= 2000 and set(some) < set(texts)
    assert len(labelled.training_sample(docs, labels, "toxic", 5)[0]) == 5


def dice_of(part, template):
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t))
    a, b = (set(zip(w, w[1:], strict=False)) for w in (words(part), words(template)))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licenses_against_every_template(spark):
    r = random.Random(8)
    filler = [f"word{i}" for i in range(50)]
    texts = []
    for _ in range(60):
        lines = [" ".join(r.choice(filler) for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(0, 5))]
        for _ in range(r.randrange(0, 3)):
            words = r.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(r.choice([0, 0, 1, 4])):
                words[r.randrange(len(words))] = r.choice(filler)
            cut = r.randrange(1, len(words))
            lines.insert(r.randrange(len(lines) + 1), " ".join(words) if r.random() < 0.5 else " ".join(words[:cut]) + "\n" + " ".join(words[cut:]))
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "one"])), "doc_id long, text string")
    for row in license_scan.scan(docs).collect():
        text = [*texts, None, "", "one"][row["doc_id"]] or ""
        lines = text.split("\n")
        paragraphs = re.split(r"\n(?:[^\w\u0080-\U0010ffff]*\n)+", text)
        parts = [*lines, *paragraphs, text]
        best = max((dice_of(p, t) for p in parts for _, t in license_scan.TEMPLATES), default=0.0)
        assert row["dice"] == pytest.approx(best if best >= 0.8 else 0.0), text
        assert (row["license"] is None) == (best < 0.8)
        for part in row["parts"]:
            piece = text.encode()[part["start"] : part["end"]].decode()
            assert part["dice"] == pytest.approx(max(dice_of(piece, t) for n, t in license_scan.TEMPLATES if n == part["license"]))


def test_mix_slot_by_slot(spark):
    r = random.Random(6)
    rows = [(i, f"t{i}", r.choice(["a", "b", "b", "c", None])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 6, "b": 4, None: 2}
    order = {x["doc_id"]: x["o"] for x in docs.select("doc_id", shared.content_order().alias("o")).collect()}
    line = {s: sorted((i for i, _, t in rows if t == s), key=order.get) for s in ("a", "b", "c", None)}
    most = max(map(len, line.values()))
    share = {"c": max(1, math.floor(64 * math.sqrt(len(line["c"]) / most) + 0.5)), **weights}
    g = math.gcd(*share.values())
    share = {s: c // g for s, c in share.items()}
    total, given, got, slot = sum(share.values()), Counter(), {}, 0
    name = lambda s: "-" if s is None else f"+{s}"
    while len(got) < len(rows):
        # Of the blocks that are released the one of earliest deadline, whether rows are left for it or not.
        released = [(-(-(given[s] + 1) * total // c), name(s), s) for s, c in share.items() if given[s] * total // c <= slot]
        due, _, s = min(released)
        assert due > slot
        for i in line[s][given[s] * 16 : given[s] * 16 + 16]:
            got[i] = (given[s], slot, len(got))
        given[s] += 1
        slot += 1
    found = {x["doc_id"]: (x["mix_block"], x["mix_slot"], x["mix_position"]) for x in pfair.interleave(docs, weights).collect()}
    assert found == got


def test_many_sources_and_large_weights(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 500}") for i in range(2000)], "doc_id long, text string, source string")
    monkeypatch.setattr(shared, "LITERAL_CHARS", 4000)  # the plan goes by a table
    rows = pfair.interleave(docs, block_rows=2).collect()
    assert sorted(r["mix_position"] for r in rows) == list(range(2000))
    with pytest.raises(ValueError, match="add up"):
        pfair.interleave(docs, {"s0": 1 << 30, "s1": (1 << 30) + 1})


def test_decontamination_in_portions(spark):
    r = random.Random(12)
    items = [(i, " ".join(f"b{r.randrange(40)}" for _ in range(r.choice([1, 3, 13, 30])))) for i in range(40)] + [(3, "b1 b2 b3"), (None, "b1"), (50, None)]
    texts = [" ".join(f"b{r.randrange(40)}" for _ in range(r.randrange(80))) + " " + r.choice(items[:40])[1] for _ in range(80)]
    docs = spark.createDataFrame([*enumerate([*texts, texts[0], None, ""])], "doc_id long, text string").withColumn("items", F.lit("mine"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, benchmark_hits(docs, bench, pass_bytes=n).collect())) for n in (1 << 20, 300))
    assert one == many and len(one) == len(texts) + 3
    kept = clean(docs, bench, pass_bytes=300)
    assert kept.columns == docs.columns and {x["items"] for x in kept.collect()} <= {"mine"} and kept.count() == sum("contaminated=False" in x for x in one)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_keeps_one_of_each_group(spark, tmp_path):
    """Rows of one id, equal rows and clashing columns: of each group of linked texts one row stays, and its columns."""
    prose = [" ".join(f"{w}{i}" for w in ("Rivers", "cross", "wide", "plains", "and", "reach", "the", "sea")) + "." for i in range(40)]
    text = ["\n".join(prose[i : i + 5]) for i in range(0, 40, 5)]
    rows = [(1, text[0]), (1, text[0]), (1, text[1]), (2, text[1]), (2, text[2]), (None, text[3]), (7, text[3]), (None, text[4]), (None, text[4]), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", None, "mine", 5, 6) for k, (i, t) in enumerate(rows)], SCHEMA + ", kept string, mix_slot int, shard int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such passage")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter([(1, text[0]), (1, text[1]), (2, text[2]), (7, text[3]), (None, text[4])])
    assert {(r["kept"], r["mix_slot"]) for r in out} == {("mine", 5)}
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * 30, "en", f"s{i % 3}", 9) for i in range(90)], SCHEMA)
    spark.createDataFrame([(1, "no such passage")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, read, str(tmp_path)).columns == docs.columns, name


def test_shards_are_stretches_of_the_mix(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "x" * (i % 40), "s0" if i % 3 == 0 else f"s{i % 7}", None, None) for i in range(1200)], "doc_id long, text string, source string, lang string, n_chars long")
    place = {r["doc_id"]: r["mix_position"] for r in pfair.interleave(docs).collect()}
    mixed = shared.stash(corpus_pipeline.source_mixing(spark, docs, ""), "mixed")
    assert mixed.columns == docs.columns
    order = [place[r["doc_id"]] for r in mixed.orderBy("_metadata.file_name", "_metadata.row_index").select("doc_id").collect()]
    assert order == list(range(1200))
    shards = {}
    for r in sorted(corpus_pipeline.sharding(spark, mixed, "").collect(), key=lambda r: (r["shard"], r["slot"])):
        shards.setdefault(r["shard"], []).append((place[r["doc_id"]], r["source"]))
    assert len(shards) == 24 and all(s == sorted(s) for s in shards.values())
    # A shard starts a stretch, and so does each cut of an old one.
    assert sum(1 + sum(b[0] != a[0] + 1 for a, b in zip(s, s[1:], strict=False)) for s in shards.values()) <= 20 + 24
    # Before small sources run out, a shard has each source in about its share of the whole mix's beginning.
    whole = Counter(x for s in shards.values() for p, x in s if p < 300)
    for s in shards.values():
        if s[-1][0] < 300:
            here = Counter(x for _, x in s)
            assert all(abs(here[x] / len(s) - n / 300) < 0.35 for x, n in whole.items()) and len(here) >= 3


def test_jaccard_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), (None, "x y z"), ("c", None)], "name string, body string")
    rows = {(r["id"], r["component"]) for r in JaccardJoin(docs, id_col="name", text_col="body").components().collect()}
    assert rows == {("a", "a"), ("b", "a"), (None, None), ("c", "c")}


def test_tables_between_passes_are_cleared(spark, tmp_path):
    folder = shared.work_folder(spark)
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six")], "doc_id long, text string")
    JaccardJoin(docs).components().write.parquet(str(tmp_path / "out"))
    assert shared.clear(spark) > 0 and shared.clear(spark) == 0
    assert not [x for x in os.listdir(folder) if x.startswith(("shingles-", "prefixes-", "links-", "texts-"))] and spark.read.parquet(str(tmp_path / "out")).count() == 2
