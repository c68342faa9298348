"""Language identification, quality, mixing, packing: held-out accuracy, brute force, round trips, edges."""
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import common, lang_id, mixing, packing, quality

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in common.documents(spark, SF).select("doc_id", "text", "lang").collect()}
    out = lang_id.op5_lang_id(spark, SF).collect()
    assert len(out) == len(docs)
    held = [r for r in out if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in out)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held if docs[r["doc_id"]]["lang"]]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_gram_counts_equal_a_plain_count():
    texts, dims = ["Abca é", "", "zz"], 512
    got = lang_id.gram_counts(texts, dims)
    for row, t in zip(got, texts):
        raw = t.lower().encode()
        assert row.sum() == sum(max(0, len(raw) - g + 1) for g in lang_id.GRAMS)
    assert (lang_id.gram_counts([texts[0]], dims)[0] == got[0]).all()


def test_language_edges(spark, edge, frame, nothing, clash):
    train = frame([(i, t, l) for i, (t, l) in enumerate(
        [("the cat sat on the mat and the dog ran", "en"), ("der hund und die katze sind im haus", "de"),
         ("1234", "xx"), (None, "en"), ("no label here", None)])]).select("text", "lang")
    model = lang_id.fit(train, dims=256, clusters=2)
    out = lang_id.identify(edge.withColumns({k: F.lit(v) for k, v in clash.items()}), model)
    got = out.collect()
    assert len(got) == 13 and set(model.langs) == {"en", "de"} and len(set(out.columns)) == len(out.columns)
    assert all((r["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"])) for r in got)
    empty = lang_id.fit(nothing.select("text", "lang"))
    assert {r["lang_pred"] for r in lang_id.identify(edge, empty).collect()} == {"und"}
    assert lang_id.identify(nothing, model).count() == 0


def test_far_texts_are_rejected():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "mat", "dog"], 30)) for _ in range(40)]
    idf = np.ones(256, np.float32)
    c, r = zip(*lang_id._centroids(texts, idf, 2, 0.01))
    model = lang_id.Model(idf, np.array(c), ["en"] * len(c), list(r))
    assert model.predict(["ξένο κείμενο 漢字"])[2] == [True] and model.predict(texts[:1])[1][0] > 0.8


def test_quality_accuracy_on_held_out_documents(spark):
    label = {r["doc_id"]: r["quality"] for r in common.labels(spark, SF).collect()}
    out = quality.op10_quality(spark, SF).collect()
    held = [r for r in out if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) > 0.9
    assert np.mean([r["predicted"] for r in held if label[r["doc_id"]] == 1]) > 0.97


def test_quality_edges(spark, edge, frame, nothing, clash):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = quality.fit(edge, none)
    assert {r["score"] for r in quality.score(edge, model).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1), (6, 1), (4, 1), (4, None), (9, 7)], "doc_id long, label int")
    assert {r["score"] for r in quality.score(edge, quality.fit(edge, one)).collect()} == {1.0}
    docs = frame([(i, f"a plain sentence number {i} about something") for i in range(8)]
                 + [(10 + i, f"### *** {i} !!! ### ***") for i in range(8)] + [(30, None), (31, "")])
    marks = spark.createDataFrame([(i, 1) for i in range(8)] + [(10 + i, 0) for i in range(8)], "doc_id long, label int")
    model = quality.fit(docs, marks)
    out = quality.score(docs.withColumns({k: F.lit(v) for k, v in clash.items()}), model)
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert len(set(out.columns)) == len(out.columns) and got[30] == got[31] == 0.5
    assert min(got[i] for i in range(8)) > max(got[10 + i] for i in range(8))
    assert quality.score(nothing, model).count() == 0


def test_quality_reads_texts_to_their_end():
    model = quality.Model(b"good text " * 50, b"### !!! " * 50, [0.0, 1.0, 0.0], 0.5, 64, 3)
    pair = model.compressors()
    text = b"good text " * 200
    assert model.features(text + b"### !!! " * 200, pair)[0] < model.features(text, pair)[0]


def brute_counts(rows, alpha=0.5, seed=7):
    n = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    w = {s: c ** alpha for s, c in n.items()}
    out = {}
    for i, s in rows:
        lam = w[s] * len(rows) / (sum(w.values()) * n[s])
        u = int(__import__("hashlib").md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16 ** 13
        k, p = 0, np.exp(-lam)
        c = p
        while c <= u:
            k += 1
            p *= lam / k
            c += p
        out[i] = k
    return out


@pytest.mark.parametrize("limit", [20_000, 0])
def test_mix_equals_brute_force_on_both_joins(frame, clash, limit, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    rows = [(i, "t", None, ["a", "a", "a", "b", None][i % 5]) for i in range(400)]
    out = mixing.mix(frame(rows, **clash))
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["copy"])
    want = {i: c for i, c in brute_counts([(r[0], r[3]) for r in rows]).items() if c}
    assert {i: len(c) for i, c in got.items()} == want and all(sorted(c) == list(range(1, len(c) + 1)) for c in got.values())
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys) and len(set(out.columns)) == len(out.columns)


def test_mix_follows_weights(frame, edge, nothing):
    rows = [(i, "t", None, "big" if i < 3000 else "small") for i in range(4000)]
    n = {r["source"]: r["count"] for r in mixing.mix(frame(rows), {"big": 1, "small": 3}).groupBy("source").count().collect()}
    assert abs(n["small"] / 3000 - 1) < 0.1 and abs(n["big"] / 1000 - 1) < 0.15
    assert mixing.mix(frame(rows), {"big": 1}).where("source = 'small'").count() == 0
    assert set(mixing.mix(edge).columns) == {*edge.columns, "copies", "copy", "shuffle_key"}
    assert mixing.mix(nothing).count() == 0


def test_rows_without_an_id_keep_their_sources_rate(frame):
    rows = [(i if i % 3 else None, f"text {i}", None, "ab"[i % 2]) for i in range(6000)]
    docs = frame(rows)
    out = mixing.mix(docs, {"a": 3, "b": 1}).collect()
    for source, rate in (("a", 1.5), ("b", 0.5)):
        n = [r for r in out if r["doc_id"] is None and r["source"] == source]
        assert abs(len(n) / (1000 * rate) - 1) < 0.1
        assert len({r["shuffle_key"] for r in n}) == len(n) and len({r["text"] for r in n}) > 300
    again = mixing.mix(docs.repartition(7), {"a": 3, "b": 1}).collect()
    assert [(r["text"], r["copy"]) for r in again] == [(r["text"], r["copy"]) for r in out]


def poisson_inverse(rate, u):
    """Smallest k whose distribution function exceeds u, summed in log space."""
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if total > u:
            return k
        k += 1


@pytest.mark.parametrize("rate", [0.01, 1, 150, 740, 800, 5000])
def test_draws_follow_the_poisson_inverse_at_any_rate(frame, rate):
    docs = frame([(i, f"t{i}", None, "rest" if i else "rare") for i in range(6000)])
    table = mixing.rates(docs, {"rare": rate / 6000, "rest": 1 - rate / 6000})
    r = {x["source"]: x for x in table.collect()}["rare"]
    assert abs(r["rate"] / rate - 1) < 1e-9
    for u in (1e-9, 0.01418, 0.2, 0.5, 0.9, 0.999):
        assert r["first"] + sum(c <= u for c in r["cdf"]) == poisson_inverse(r["rate"], u)
    assert r["cdf"][-1] == 1.0 and len(r["cdf"]) < 26 * rate ** 0.5 + 50


def test_copies_of_a_very_frequent_source_vary_around_its_rate(frame):
    docs = frame([(i, f"t{i}", None, "rare" if i < 5 else "rest") for i in range(6000)])
    got = [r["copies"] for r in mixing.mix(docs, {"rare": 1.0}).where("copy = 1").select("copies").collect()]
    assert len(set(got)) > 1 and abs(np.mean(got) / 1200 - 1) < 0.1


def rebuilt(pieces):
    by, seqs = {}, {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    return by


def test_packing_round_trip(spark):
    enc = packing.Encoder(packing.public_file("byte_bpe_50k.json"), None)
    docs = common.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()
    by = rebuilt(packing.pack(common.documents(spark, "/root/testdata/sf0.001"), with_ids=True,
                              tokens_per_partition=20_000).collect())
    assert set(by) == {d["doc_id"] for d in docs}
    for d in docs:
        ids = [*enc.ids(d["text"] or ""), 1]
        parts = sorted(by[d["doc_id"]], key=lambda r: r["start"])
        assert [i for p in parts for i in p["ids"]] == ids and {p["doc_tokens"] for p in parts} == {len(ids)}
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], dtype="<u4").tobytes())


def test_rank_file_gives_the_same_ids():
    fast = packing.Encoder(packing.public_file("byte_bpe_50k.json"), packing.public_file("byte_bpe_50k.tiktoken"))
    slow = packing.Encoder(packing.public_file("byte_bpe_50k.json"), None)
    for t in ["", " ", "it's  a\n\n test\t!", "Éçà ñ ß ü <|endoftext|> x", "漢字   \x1c\x85 a", "a" * 300, "  \r\n x 12345 ---"]:
        assert fast.ids(t) == slow.ids(t)


def test_hilbert_keys_visit_neighbouring_cells():
    bits, d = 3, 2
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    key = packing.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(64))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_edges(edge, nothing):
    pieces = packing.pack(edge).collect()
    rebuilt(pieces)
    total = {}
    for r in pieces:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total[1] == 1 and total[2] == 1 and set(total) == {None, *range(1, 10)}
    assert packing.pack(nothing).count() == 0


def test_any_number_of_languages_in_blocks_and_long_texts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        letters = [chr(0x3041 + int(c)) for c in rng.choice(5000, 12, replace=False)]
        rows += [(f"l{i:03d}", "".join(rng.choice(letters, 60).tolist()), j) for j in range(4)]
    only_long = "lang with long texts only 0123456789 " * 50
    rows += [("long", only_long + str(j), j) for j in range(3)]
    df = spark.createDataFrame(rows, "lang string, text string, j int")
    train = df.where("j > 0").select("text", "lang")
    kw = {"dims": 512, "clusters": 2, "max_chars": 1000}
    whole, cut = lang_id.fit(train, **kw), lang_id.fit(train, block_bytes=200_000, **kw)
    assert whole.blocks == 1 and cut.blocks > 4
    test = df.where("j = 0")
    a, b = ({r["text"]: (r["lang_pred"], round(r["score"], 5), r["rejected"], r["lang"])
             for r in lang_id.identify(test, m).collect()} for m in (whole, cut))
    assert a == b and np.mean([p == lang for p, _, _, lang in a.values()]) > 0.95
    assert a[only_long + "0"][0] == "long"


def test_identify_equals_brute_force_over_one_table_of_centroids(spark):
    docs = common.documents(spark, SF).select("doc_id", "text", "lang")
    model = lang_id.fit(docs.where("doc_id % 2 = 0").select("text", "lang"), dims=512)
    rows = sorted(model.rows.collect(), key=lambda r: (r["lang"], r["k"]))
    c = np.array([np.frombuffer(r["centroid"], "<f4") for r in rows])
    got = {r["doc_id"]: r for r in lang_id.identify(docs, model).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        if not any(x.isalpha() for x in text):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        v = lang_id.gram_counts([text], 512)[0].astype(float)
        v = np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0) * model.idf
        cos = c @ (v / np.linalg.norm(v))
        k = int(cos.argmax())
        assert abs(got[r["doc_id"]]["score"] - cos[k]) < 1e-4
        assert got[r["doc_id"]]["lang_pred"] == rows[k]["lang"] or cos[k] - np.sort(cos)[-2] < 1e-4


def test_mix_equals_its_sql_without_ids_and_at_any_rate(spark, frame):
    import duckdb
    rows = [(None if i % 3 else i, f"t{i % 50}" if i % 7 else None, None, f"s{i % 2}" if i % 11 else None) for i in range(400)]
    rows += [(1000 + i, "x", None, f"rare{i}") for i in range(2)]
    rows = [r for r in rows for _ in range(1 if r[3] and r[3].startswith("rare") else 4)]
    docs = frame(rows).select("doc_id", "source", "text")
    con = duckdb.connect()
    con.register("d", docs.toArrow())
    for alpha in (0.5, -0.6):  # negative: the rare sources are repeated hundreds of times
        sql = mixing.mix_sql("d", "doc_id, source, text", alpha)
        want = con.execute(f"SELECT doc_id, source, text, copy, copies, shuffle_key FROM ({sql})").fetchall()
        got = [tuple(r) for r in mixing.mix(docs, alpha=alpha).select(
            "doc_id", "source", "text", "copy", "copies", "shuffle_key").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert max(r[4] for r in want) > 200


def test_rows_without_ids_are_deduplicated(spark, frame, clash):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text, "a", "s1"), (None, text, "b", "s2"), (None, text + " more", "c", "s3"), (9, other, "d", "s4"), (9, other, "e", "s5"),
            (None, other + " x", "f", "s6"), (12, other, "g", "s7"), (None, None, "h", "s8"), (None, None, "i", "s9"), (3, "", "j", "s10")]
    from cohortlens.llm import hyperminhash
    extra = {k: v for k, v in clash.items()}
    out = hyperminhash.one_of_each(frame(rows, **extra))
    assert out.columns == frame(rows, **extra).columns
    left = [(r["doc_id"], r["lang"]) for r in out.collect()]
    assert len(left) == 5 and {x for _, x in left} >= {"h", "i", "j"}
    assert sum(i is None and x in "abc" for i, x in left) == 1 and [i for i, x in left if x in "defg"] == [9]
    assert hyperminhash.one_of_each(frame([])).count() == 0
