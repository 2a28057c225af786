from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from klangsieb.operators import merge, metrics, requests, select, spans, vectors
from klangsieb.operators.ordered import Down, holding, position, running_sum


def test_running_sum_and_position(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5])) for i in range(500)] + [("hot", 1000 + i, 2) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {r["k"]: (r["before"], r["g"]) for r in running_sum(df, F.col("v"), [F.col("k")], by=["g"]).collect()}
    seen: dict = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        assert got[k] == (seen.get(g, 0), g)
        seen[g] = seen.get(g, 0) + (v or 0)
    ranks = {r["k"]: r["rank"] for r in position(df, [Down(F.col("v")), F.col("k")]).collect()}
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
    assert [ranks[k] for _, k, _ in order] == list(range(1, len(rows) + 1))
    assert running_sum(df.limit(0), F.col("v"), [F.col("k")]).collect() == []


def test_holding(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", None, "z"), (None, 9, "n"), ("b", None, "q")], "k string, o int, v string")
    assert sorted(map(tuple, holding(df, "k", first="o", keep=["v"]).collect())) == [("a", "x"), ("b", "q")]
    assert sorted(map(tuple, holding(df, "k", latest="o", keep=["v"]).collect())) == [("a", None), ("b", "q")]


def test_holding_numbers_by_hash(spark):
    rows = [("a", 1, 1.5, 1), ("a", 2, None, 2), ("b", None, 7.0, 3), ("b", -5, 8.0, None), ("c", None, 9.0, 4), (None, 1, 1.0, 5), ("d", 2**62, 1.0, 6), ("d", 2**62 + 1, 2.0, 7), ("d", -(2**63), 3.0, 8)]
    df = spark.createDataFrame(rows, "k string, o bigint, v double, w int")
    assert sorted(map(tuple, holding(df, "k", latest="o", keep=["v", "w"]).collect())) == [("a", None, 2), ("b", 8.0, None), ("c", 9.0, 4), ("d", 2.0, 7)]
    assert sorted(map(tuple, holding(df, "k", first="o", keep=["v", "w"]).collect())) == [("a", 1.5, 1), ("b", 8.0, None), ("c", 9.0, 4), ("d", 3.0, 8)]
    tied = spark.createDataFrame([("a", 1, float(i), i) for i in range(50)], "k string, o bigint, v double, w int")
    got = {tuple(holding(tied.repartition(n), "k", latest="o", keep=["v", "w"]).first()) for n in (1, 7)}
    assert len(got) == 1 and all(v == w for _, v, w in got)


def test_round_robin_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(f"k{i}", rng.choice("abc"), rng.randint(1, 9)) for i in range(200)]
    got = {r["k"] for r in select.round_robin_budget(spark.createDataFrame(rows, "k string, g string, ms int"), "g", "k", F.col("ms"), 300).collect()}
    queues = {g: sorted((r for r in rows if r[1] == g), key=lambda r: hashlib.sha1(r[0].encode()).hexdigest()) for g in "abc"}
    want, total = set(), 0
    for turn in range(200):
        for g in "abc":
            if turn < len(queues[g]) and total < 300:
                want.add(queues[g][turn][0])
                total += queues[g][turn][2]
    assert got == want


def test_split_sample_and_partner(spark):
    rows = [(f"k{i:03d}", "big" if i < 200 else "small") for i in range(230)] + [("lone", "one"), ("n", None)]
    df = spark.createDataFrame(rows, "k string, g string")
    n: dict = {}
    for r in select.stratified_split(df, "g", "k").collect():
        n[r["g"], r["split"]] = n.get((r["g"], r["split"]), 0) + 1
    assert n == {("big", "train"): 180, ("big", "val"): 10, ("big", "test"): 10, ("small", "train"): 30, ("one", "train"): 1, (None, "train"): 1}
    got = [r["k"] for r in select.strided_sample(df, "g", "k", 24).collect()]
    assert len([k for k in got if k < "k200"]) == 21 and "lone" in got and "n" in got
    partner = {r["k"]: r["partner"] for r in select.pick_partner(df, "g", "k").collect()}
    assert partner["lone"] == "lone" and all(partner[k] != k and (partner[k] < "k200") == (k < "k200") for k in partner if k.startswith("k"))
    pool = [f"k{i:03d}" for i in range(200) if i != 7]
    assert partner["k007"] == pool[int(hashlib.sha1(b"ref:k007").hexdigest(), 16) % 199]


def test_weighted_draws(spark):
    df = spark.createDataFrame([("a", 1), ("b", 999), ("c", 0), ("d", None)], "k string, w int")
    got = select.weighted_draws(df, "k", F.col("w"), 3000, "s").groupBy("key").count().collect()
    n = {r["key"]: r["count"] for r in got}
    assert sum(n.values()) == 3000 and n["b"] > 2900 and set(n) <= {"a", "b"}
    assert select.weighted_draws(df.where("w = 0"), "k", F.col("w"), 10, "s").collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_quota_cover_against_the_whole_fold(spark, seed):
    rng = random.Random(seed)
    clips = {f"c{i}": (sorted(rng.sample([f"w{k}" for k in range(12)], rng.randint(1, 4))), rng.randint(1, 9) * 1.0) for i in range(80)}
    budget = rng.choice([30.0, 1e9])
    index = [(w, int(w[1:]) % 4, c, hashlib.sha1(c.encode()).hexdigest(), a) for c, (ws, a) in clips.items() for w in ws]
    got = select.quota_cover(spark.createDataFrame(index, "word string, priority int, clip string, clip_order string, amount double"), 3, budget).collect()
    left = {f"w{k}": 3 for k in range(12)}
    taken, spent = [], 0.0
    for w in sorted({i[0] for i in index}, key=lambda w: (int(w[1:]) % 4, w)):
        for _, _, c, _, a in sorted((i for i in index if i[0] == w), key=lambda i: i[3]):
            if left[w] > 0 and c not in taken and spent + a <= budget:
                taken.append(c)
                spent += a
                for x in clips[c][0]:
                    left[x] -= 1
    if budget > 1e6:
        assert [r["clip"] for r in sorted(got, key=lambda r: r["pick"])] == taken
    assert sum(clips[r["clip"]][1] for r in got) <= budget


@pytest.mark.parametrize("seed", range(3))
def test_quota_cover_counts_the_cap_on_clips_taken(spark, seed):
    rng = random.Random(seed)
    clips = {f"c{i}": (sorted(rng.sample([f"w{k:02d}" for k in range(30)], rng.randint(1, 3))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)}
    index = [(w, int(w[1:]) % 4, c, hashlib.sha1(c.encode()).hexdigest(), 1.0, s) for c, (ws, s) in clips.items() for w in ws]
    quota, cap = rng.choice([(3, 5), (6, 4), (2, 20)])
    got = select.quota_cover(spark.createDataFrame(index, "word string, priority int, clip string, clip_order string, amount double, speaker string"), quota, 1e12, cap).collect()
    left, taken, of = {f"w{k:02d}": quota for k in range(30)}, [], {}
    for w in sorted({i[0] for i in index}, key=lambda w: (int(w[1:]) % 4, w)):
        for c, s in ((i[2], i[5]) for i in sorted((i for i in index if i[0] == w), key=lambda i: i[3])):
            if left[w] > 0 and c not in taken and of.get(s, 0) < cap:
                taken.append(c)
                of[s] = of.get(s, 0) + 1
                for x in clips[c][0]:
                    left[x] -= 1
    assert [r["clip"] for r in sorted(got, key=lambda r: r["pick"])] == taken


def test_reasons_and_best(spark):
    df = spark.createDataFrame([(1, None), (5, 2), (None, 9)], "a int, b int")
    r = df.select(select.first_reason([("a", F.col("a") > 3), ("b", F.col("b") > 3)])).collect()
    assert [x[0] for x in r] == [None, "a", "b"]
    rows = spark.createDataFrame([("g", i) for i in range(50)] + [("h", 1)], "g string, v int")
    assert sorted(map(tuple, select.best_per_group(rows, ["g"], [F.desc("v")], 2).select("g", "v").collect())) == [("g", 48), ("g", 49), ("h", 1)]
    p = select.passage_from(rows, "g", "v", F.lit(10), 3, 25).select("g", "v").collect()
    assert sorted(map(tuple, p)) == [("g", 2), ("g", 3), ("g", 4)]


def test_merges(spark):
    base = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "k string, s string")
    later = spark.createDataFrame([("a", "new"), ("b", "  "), ("c", "z"), ("d", "q")], "k string, s string")
    assert sorted(map(tuple, merge.override(base, later, "k", "s").collect())) == [("a", "new"), ("b", "y"), ("c", "z")]
    assert sorted(map(tuple, merge.upsert(base, later.where("k in ('a', 'd')"), "k").fillna("-").collect())) == [("a", "new"), ("b", "y"), ("c", "-"), ("d", "q")]
    files = spark.createDataFrame([("/x/wavs/a.wav",), ("/wavs/b.wav",), ("/none.wav",)], "long string")
    known = spark.createDataFrame([("/wavs/a.wav", 1), ("/wavs/b.wav", 2), ("/other/a.wav", 3)], "short string, n int")
    assert sorted((r["long"], r["n"]) for r in merge.exact_or_suffix(files, known, "long", "short").collect()) == [("/wavs/b.wav", 2), ("/x/wavs/a.wav", 1)]
    assert merge.strict_join(base.select("k"), later, "k").count() == 3
    with pytest.raises(Exception, match="no entry for b"):
        merge.strict_join(base.select("k"), later.where("k <> 'b'"), "k").collect()
    assert merge.dedupe_first(spark.createDataFrame([("a", 2, "x"), ("a", 1, "")], "k string, o int, v string"), "k", "o").first()["v"] == ""


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_against_all_pairs(spark, seed):
    rng = random.Random(seed)

    def some(n):
        return [(rng.choice("xy"), s := round(rng.uniform(-50, 200), 2), round(s + rng.expovariate(0.1), 2)) for _ in range(n)]

    a, b = some(60), some(60)
    frames = [spark.createDataFrame(x, "k string, start double, end double") for x in (a, b)]
    got = sorted((r["k"], r["start"], r["end"]) for r in merge.overlaps(*frames, "k", 0.4, 7.0).collect())
    want = sorted((k, max(s, t), min(e, f)) for k, s, e in a for q, t, f in b if k == q and min(e, f) - max(s, t) >= 0.4)
    assert got == want


def test_islands_and_merges(spark):
    df = spark.createDataFrame([("u", i, i in (1, 2, 3, 6, 8, 9)) for i in range(10)] + [("v", 0, None)], "k string, o int, on boolean")
    assert sorted(map(tuple, spans.islands(df, "k", "o", F.col("on"), 2).collect())) == [("u", 1, 3, 3), ("u", 8, 9, 2)]
    s = [(0.0, 1.0), (1.2, 4.0), (4.1, 9.0), (9.1, 11.0), (20.0, 21.0)]
    rows = spark.createDataFrame([("a", *x) for x in s], "k string, start double, end double")
    one = rows.groupBy("k").agg(spans.merge_spans(F.collect_list(F.struct("start", "end")), 0.3, 9.5).alias("m")).first()["m"]
    assert [tuple(x) for x in one] == [(0.0, 9.0), (9.1, 11.0), (20.0, 21.0)]
    for size in (50_000, 2):
        assert [r["block"] for r in spans.split_at_gaps(rows, "k", "start", "end", 0.3, size).orderBy("start").collect()] == [1, 1, 1, 1, 2]
    assert sorted((r["start"], r["end"]) for r in spans.merge_near(rows, "k", "start", "end", 0.3, 9.5).collect()) == [(0.0, 9.0), (9.1, 11.0), (20.0, 21.0)]
    assert spans.merge_near(rows.limit(0), "k", "start", "end", 0.3, 9.5).collect() == []
    t = spans.tumbling(rows, F.col("start"), 10.0, 5.0, F.lit(21.0)).select("start", "window").collect()
    assert sorted(map(tuple, t)) == [(0.0, 0), (1.2, 0), (4.1, 0), (9.1, 0)]


def test_stretches_of_a_hot_key(spark):
    from klangsieb.streaming.streams import left_context

    rows = [("hot", i) for i in range(40)] + [("a", 3), ("a", 1), (None, 5), (None, 6)]
    for size in (5, 1000):
        got = {(r["k"], r["o"]): r["context"] for r in left_context(spark.createDataFrame(rows, "k string, o int"), "k", "o", "o", 3, size=size).collect()}
        assert got == {("hot", i): list(range(max(0, i - 3), i)) for i in range(40)} | {("a", 1): [], ("a", 3): [1], (None, 5): [], (None, 6): [5]}


def _unit(rng, n, d=8):
    v = rng.normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    v = _unit(rng, 300)
    g = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, int(g[i]), v[i].tolist()) for i in range(300)] + [(None, 0, v[0].tolist()), (999, 0, None)], "i long, g int, v array<float>").where("v is not null")
    best = {r["query"]: (r["match"], r["cosine"]) for r in vectors.best_matches(df, df.where("i % 10 = 0"), "i", "g", "v", block=7).collect()}
    sim = np.round(v.astype(float) @ v.astype(float).T, 6)
    for q in range(0, 300, 10):
        ok = [i for i in range(300) if g[i] == g[q] and i != q]
        m = max(ok, key=lambda i: (sim[q, i], -i))
        assert best[q][0] == m and best[q][1] == pytest.approx(sim[q, m], abs=2e-6)
    assert len(best) == 30
    assert vectors.best_matches(df, df.where("i < 0"), "i", "g", "v").collect() == []
    known = df.where("i is not null")
    pair = {r["g"]: r["mean_similarity"] for r in vectors.mean_pair_similarity(known, "g", "v").collect()}
    for k in range(3):
        s = v[g == k].astype(float) @ v[g == k].astype(float).T
        assert pair[k] == pytest.approx((s.sum() - np.trace(s)) / (len(s) * (len(s) - 1)), abs=1e-6)
    c = vectors.centroids(known, "g", "v")
    near = {r["query"]: r["match"] for r in vectors.nearest_of(known, c, "i", "v", "g", "centroid", block=2).collect()}
    mean = np.stack([v[g == k].astype(float).mean(axis=0) for k in range(3)])
    mean /= np.linalg.norm(mean, axis=1, keepdims=True)
    assert sum(near[i] == int(np.argmax(v[i] @ mean.T)) for i in range(300)) >= 299


def test_clusters(spark):
    rng = np.random.default_rng(1)
    centre = _unit(rng, 4, 16)
    v = np.concatenate([c + 0.05 * rng.normal(size=(40, 16)) for c in centre])
    df = spark.createDataFrame([(i, 1, v[i].tolist()) for i in range(160)] + [(500, 2, v[0].tolist())], "i long, g int, v array<float>")
    for chunk in (1000, 25):
        got = {r["i"]: r["cluster"] for r in vectors.agglomerate(df, "g", "i", "v", 0.45, chunk).collect()}
        assert len({got[i] for i in range(160)}) == 4 and all(len({got[i] for i in range(k, k + 40)}) == 1 for k in range(0, 160, 40)) and got[500] == 500


def test_large_groups_have_the_clusters_of_the_whole_linkage(spark):
    n, cut = 120, 0.8
    f = _unit(np.random.default_rng(5), n, 24)
    df = spark.createDataFrame([(i, 1, f[i].tolist()) for i in range(n)] + [(500, None, f[0].tolist())], "i long, g int, v array<float>")
    v = f.astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    total, size, name = v @ v.T, np.ones(n), np.arange(n)
    while True:
        mean = np.where(np.outer(size, size) > 0, total / np.maximum(np.outer(size, size), 1), -np.inf)
        np.fill_diagonal(mean, -np.inf)
        a, b = sorted(np.unravel_index(mean.argmax(), mean.shape))
        if 1.0 - mean[a, b] > cut:
            break
        total[a] += total[b]
        total[:, a] += total[:, b]
        size[a], size[b] = size[a] + size[b], 0
        name[name == b] = a
    want = dict(enumerate(name)) | {500: 500}
    assert 5 < len(set(name)) < 60
    for chunk in (1000, 50):
        assert {r["i"]: r["cluster"] for r in vectors.agglomerate(df, "g", "i", "v", cut, chunk).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_chains_have_the_clusters_of_the_matrix(seed):
    v, cut = _unit(np.random.default_rng(seed), 500, 32).astype(float), (0.9, 0.7)[seed % 2]
    assert (vectors.chain_labels(v, np.ones(500), cut) == vectors.linkage_labels(v, np.ones(500), cut)).all()


def test_metrics(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(45)] + [("a", 99, None), ("a", 98, float("nan")), ("b", 1, 7.0)], "g string, k int, v double")
    got = {r["g"]: tuple(r)[1:] for r in metrics.index_percentiles(df, ["g"], "v", "k").collect()}
    s = sorted(range(45))
    assert got == {"a": (0.0, s[45 // 20], s[45 // 2], s[(-45) // 20], 44.0), "b": (7.0,) * 5}
    assert df.groupBy("g").agg(metrics.mean_valid(F.col("v")).alias("m")).where("g = 'a'").first()["m"] == 22.0
    macro = metrics.batch_mean(df.where("v < 5"), ["g"], "k", "v", 4).where("g = 'a'").first()
    assert (macro["macro"], macro["batches"]) == ((1.5 + 4.0) / 2, 2)
    edits = spark.createDataFrame([(["a", "b"], ["a"]), (None, ["x"]), ([], [])], "a array<string>, b array<string>").select(metrics.word_edits("a", "b")).collect()
    assert [r[0] for r in edits] == [1, 1, 0]
    rows = spark.createDataFrame([("g", i, i % 3, 10) for i in range(3000)], "g string, k int, e int, n int")
    b = metrics.bootstrap(rows, ["g"], "k", F.col("e"), F.col("n"), resamples=400).first()
    assert b["rate"] == pytest.approx(0.0999, abs=1e-3) and b["low"] < b["rate"] < b["high"] and b["high"] - b["low"] == pytest.approx(4 * 0.0816 / 3000**0.5, rel=0.4)
    stop = metrics.first_terminal(spark.createDataFrame([("a", 1, "x"), ("a", 2, "end"), ("a", 3, "x"), ("b", 1, "x")], "k string, o int, t string"), "k", "o", F.col("t") == "end")
    assert sorted((r["k"], r["o"]) for r in stop.collect()) == [("a", 1), ("b", 1)]


def test_requests(spark):
    cases = [("r.wav", "r", "  ", "ref_clone_tata"), ("r.wav", "r", "i", "ref_edit_tata"), (None, None, None, "tts_plain"), ("", "", "i", "tts_instruction"), ("r.wav", None, None, None)]
    df = spark.createDataFrame([c[:3] for c in cases], "audio string, ref string, ins string")
    assert [r[0] for r in df.select(requests.template_name(F.col("audio"), F.col("ref"), F.col("ins"))).collect()] == [c[3] for c in cases]
    with pytest.raises(Exception, match="must come together"):
        df.select(requests.checked_template(F.col("audio"), F.col("ref"), F.col("ins"))).collect()
    seg = spark.range(1).select(requests.segments(F.lit("ref_edit_tata"), F.lit("t"), F.lit("i"), F.lit("a.wav"), F.lit("r"), F.lit("[S1]"))).first()[0]
    assert [(s["type"], s["text"] or s["audio_path"]) for s in seg] == [("text", "[S1]r"), ("audio", "a.wav"), ("text", "[S1]<ins_bos>i<ins_eos>t")]
    needs = spark.createDataFrame([("a", 10), ("a", 65), ("b", 1)], "g string, n int")
    sizes = spark.createDataFrame([("a", 64), ("a", 32)], "g string, s int")
    assert sorted((r["g"], r["n"], r["bucket"]) for r in requests.smallest_bucket(needs, sizes, "g", "n", "s").collect()) == [("a", 10, 32), ("a", 65, None), ("b", 1, None)]
    faults = spark.range(1).select(requests.profile_faults(F.from_json(F.lit('{"schema_version":1,"service":{"concurrency":1,"cfg_scales":[1.0,4.0]},"stages":{"text_encoder":{"graphs":[{"batch_size":1,"token_length":33}]},"backbone_prefill":{"graphs":[{"branch_batch_size":1,"sequence_length":64}]}}}'), requests.PROFILE))).first()[0]
    assert faults == ["text_aligned", "prefill_shapes"]
