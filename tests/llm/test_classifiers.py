from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecharbor.llm import common, quality, queries, toxicity
from vecharbor.llm.common import crc_remainder

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "mod", "held", "least"), [(queries.op3_quality_classifier, "quality", 4, 2, 0.97), (queries.op6_toxicity, "toxic", 3, 1, 0.92)])
def test_held_out_accuracy(spark, query, label, mod, held, least):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    got = query(spark, LARGER).cache()
    assert got.count() == docs.count()
    assert got.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.7)").isEmpty()
    rows = got.select("doc_id", "held_out").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % mod == held) for r in rows)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    share = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert share >= least


@pytest.mark.parametrize(("module", "keep"), [(quality, quality.good_rows), (toxicity, toxicity.clean_rows)])
def test_odd_rows_and_empty_tables(spark, docs, labels, odd, none, module, keep):
    model = module.fit(docs, labels)
    out = module.scored(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    by_text = {r.doc_id: r.score for r in out}
    assert by_text[3] == by_text[4]
    assert keep(odd, model).columns == odd.columns
    assert module.scored(none, model).count() == 0 and keep(none, model).count() == 0
    unlabelled = module.fit(docs, labels.where("false"))
    assert keep(odd, unlabelled).count() == odd.count()
    nulls = labels.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    assert module.fit(docs, nulls).scores(["x"] if module is toxicity else [b"x"]) is not None
    assert module.fit(none, labels) is not None


def test_a_doc_id_of_many_rows_does_not_crowd_out_others(spark, monkeypatch):
    ids = [i for i in range(400) if crc32(str(i).encode()) % 12 == 0][:21]
    hot, others = ids[0], ids[1:]
    rows = [(hot, f"aaa {n % 60} of the same id") for n in range(120)] + [(i, f"zzz{i} other text") for i in others]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i != hot), 1) for i in ids] + [(999_999, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.fit(docs, labels, most=20).prior >= 0.95
    assert quality.labelled(docs, labels, "quality", 4, 2, 50).where("label = 1").count() == 20
    assert quality.labelled(docs, labels, "quality", 4, 2, 50).count() == 50
    assert quality.labelled(docs, labels, "quality", 4, 2, 1000).count() == 80
    monkeypatch.setattr(toxicity, "train", lambda bags, unknown: bags)
    bags = toxicity.fit(docs, labels, most_toxic=21, most_clean=5)
    assert sum("zzz" in " ".join(units) for _, units in bags) == 20 and len(bags) == 21


def test_texts_are_ranked_alike_in_any_parts(spark, monkeypatch):
    """Also with rows that have no doc_id, of which none may be chosen."""
    rows = [(1, f"text {i}") for i in range(200)] + [(2, "only one")] + [(None, f"no id {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, label int")
    got = []
    for parts in (1, 7, 64):
        monkeypatch.setattr(common, "RANK_PARTS", parts)
        got.append(sorted(r.text for r in common.labelled_texts(docs, known, ("label = 1", 30), ("label = 0", 5)).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 31 and "only one" in got[0] and "no id" not in " ".join(got[0])


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    words = {"w" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(3000)}
    docs = spark.createDataFrame([(0, " ".join(sorted(words)))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda bags, unknown: bags)
    [(label, units)] = toxicity.fit(docs, labels, mod=3, held=crc32(b"0") % 3 ^ 1)
    assert label == 1 and len(units) == 3000 and set(units) == words


def test_labels_of_the_held_out_fold_are_not_learned(spark, docs, labels):
    other = labels.withColumn("quality", F.when(crc_remainder("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, other)
    assert (a.labels == b.labels).all() and (a.vectors == b.vectors).all()
    other = labels.withColumn("toxic", F.when(crc_remainder("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert other.join(labels, ["doc_id", "toxic"], "left_anti").count() > 10
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert (a.weight == b.weight).all() and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_votes_match_a_plain_computation(docs, labels):
    """Cosines one by one, exact; ties for the last places share them."""
    from fractions import Fraction

    model = quality.fit(docs, labels, most=60)
    model.vectors[7] = model.vectors[3] = model.vectors[11]
    model.labels[[3, 7, 11]] = 0, 1, 1
    texts = [(r.text or "").encode() for r in docs.orderBy("doc_id").limit(60).collect()]
    assert quality.NEIGHBOURS == 15
    for text, score in zip(texts, model.scores(texts), strict=True):
        v = [sum(float(a) * float(b) for a, b in zip(quality.terms(text)[model.columns], column)) for column in model.project.T]
        size = sum(x * x for x in v) ** 0.5
        cosines = [round(sum(x * float(y) for x, y in zip(v, own)) / size, quality.PLACES) for own in model.vectors]
        last = sorted(cosines, reverse=True)[14]
        above = sum(c > last for c in cosines)
        share = [Fraction(1) if c > last else Fraction(15 - above, cosines.count(last)) if c == last else 0 for c in cosines]
        weight = [max(c, 0) * float(s) for c, s in zip(cosines, share)]
        assert score == pytest.approx(sum(w * y for w, y in zip(weight, model.labels)) / sum(weight), abs=2e-2)


def test_equal_neighbours_share_the_last_places():
    model = quality.Model(np.arange(2), np.eye(2, dtype=np.float32), np.float32([[1, 0]] * 10 + [[0.6, 0.8]] * 20 + [[0, 1]] * 5), np.r_[np.ones(10), np.zeros(10), np.ones(10), np.zeros(5)], 0.5)
    model.latent = lambda rows: np.float32([[1, 0]] * len(rows))
    assert model.scores([b"x", b"y"]) == pytest.approx([(10 + 0.6 * 2.5) / (10 + 0.6 * 5)] * 2)


def plain_kernel(u, v):
    """Shared picks of three symbols in order, from spans of at most SPAN, each gap symbol costing DECAY."""

    def picks(word):
        x, out = toxicity._symbols(word), {}
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, min(i + toxicity.SPAN, len(x))):
                    out[x[i], x[j], x[k]] = out.get((x[i], x[j], x[k]), 0) + toxicity.DECAY ** (k - i - 2)
        return out

    def norm(word):
        x = range(len(word) + 2)
        return max(sum(toxicity.DECAY ** (2 * (k - i - 2)) for i in x for j in x for k in x if i < j < k < i + toxicity.SPAN), 1) ** 0.5

    a, b = picks(u), picks(v)
    return sum(n * b.get(s, 0) for s, n in a.items()) / norm(u) / norm(v)


def test_kernel_and_landmarks_match_a_plain_computation():
    words = ["idiot", "idxiot", "moron", "a", "", "réeuxment", "worthless", "theanering", "ab", "überß"]
    table = toxicity._dense(words)
    kernel = table.T @ table
    want = np.array([[plain_kernel(u, v) for v in words] for u in words])
    assert np.allclose(kernel, want, atol=1e-5)
    assert want[0, 1] > want[0, 2]
    # Coordinates by landmarks give the kernel back among the landmarks themselves.
    mapped = toxicity._features(words, toxicity._nystroem(words))
    assert np.allclose(mapped @ mapped.T, want, atol=1e-3)
    # The folded table decides as the machine over coordinates does.
    w = np.linspace(-1, 1, mapped.shape[1])
    model = toxicity.Model(weight=(toxicity._nystroem(words) @ w).astype(float), bias=0.25)
    assert np.allclose(model.decide(words), mapped @ w + 0.25, atol=1e-4)


def test_kernel_bears_inserted_characters():
    insults = ["idiot", "moron", "stupid", "worthless"]
    fine = "the a of and station river mountain garden window market paper letter stone street winter summer music teacher".split()
    bags = [(1, [i, fine[k % 18], fine[(k * 7) % 18]]) for k in range(40) for i in [insults[k % 4]]]
    bags += [(0, [fine[k % 18], fine[(k * 5 + 1) % 18], fine[(k * 3 + 2) % 18]]) for k in range(60)]
    model = toxicity.train(bags)
    bad = model.scores(["you idiot", "an id-iot", "st.upid", "worthlxess", "a m o r o n b"])
    good = model.scores(["the station", "a garden of paper", ""])
    assert min(bad) > max(good)


def test_explaining_units_are_insults_not_words_that_copies_share():
    fine = [f"word{i}" for i in range(200)]
    copies = [["idiot", *fine[:30], "twin", "brother"]] * 9
    pos = copies + [["idiot", *fine[i : i + 9]] for i in range(20)] + [["lowei" + x, *fine[i : i + 5]] for i, x in enumerate(("ab", "cd", "ef", "gh", "ij"))]
    neg = [fine[i : i + 20] for i in range(0, 180, 2)]
    found = toxicity._explaining(pos, neg)
    assert "idiot" in found and {"loweiab", "loweiij"} <= found.keys() and not {"word1", "word40"} & found.keys()


def test_bound_parts_the_labels():
    slope, shift = toxicity._calibrated(np.array([-2.0, -1.0, 0.2, 0.9, 1.0, 1.0]), np.array([0, 0, 0, 1, 1, 1.0]))
    score = 1 / (1 + np.exp(-(slope * np.array([0.2, 0.5, 0.9]) + shift)))
    assert score[0] < 0.5 and score[1] < 0.7 < score[2]
    for y in (np.zeros(3), np.ones(3)):
        assert np.isfinite(toxicity._calibrated(np.array([0.0, 0.5, 1.0]), y)).all()


def test_folding():
    assert [toxicity.fold(w) for w in ("Idi-ot!", "m0r0n", "ÉTÉ", "123", "", "naïve", "Straße")] == ["idiot", "moron", "été", "", "", "naïve", "straße"]
    assert "idiot" in toxicity.raw_units("you i d i o t there")
