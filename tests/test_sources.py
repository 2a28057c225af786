from __future__ import annotations

import gzip
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from klangsieb.sources import archive, audio, readers, sinks
from klangsieb.streaming import streams


def test_listing(spark, tmp_path):
    p = tmp_path / "texts.csv"
    p.write_text("wavs/a.wav==Eins==zwei\nwavs/b.wav== \n\nkaputt\nwavs/a.wav==noch mal\n", encoding="utf-8")
    rows = readers.read_listing(spark, str(p))
    assert rows.where("wav_rel = 'wavs/a.wav'").select("text").orderBy("text").collect()[0][0] == "Eins==zwei"
    assert tuple(readers.listing_counts(rows).first()) == (5, 1, 1, 1)


def test_delimited(spark, tmp_path):
    p = tmp_path / "pool.csv"
    p.write_text('wav_filename|duration|transcript|client_id|levenshtein\na.wav|1.5|"x | y"|c|0.97\nb.wav|zu lang|t|c|1\nc.wav|2|t|c|\n', encoding="utf-8")
    rows = readers.read_pipe_csv(spark, str(p))
    assert {r["wav_filename"]: (r["duration"], r["levenshtein"]) for r in rows.collect()} == {"a.wav": (1.5, 0.97), "b.wav": (None, 1.0), "c.wav": (2.0, 0.0)}
    assert [r["transcript"] for r in readers.agreed(rows).collect()] == ["x | y"]
    t = tmp_path / "validated.tsv"
    t.write_text('client_id\tpath\tsentence\tup_votes\tdown_votes\nc\tp.mp3\t"Er sagte\t3\t0\nc\tq.mp3\tT\tx\t0\n', encoding="utf-8")
    assert [(r["sentence"], r["up_votes"]) for r in readers.upvoted(readers.read_votes_tsv(spark, str(t))).collect()] == [('"Er sagte', 3)]
    k = tmp_path / "keys.tsv"
    k.write_text("a\t1\t2\told\nb\tshort\na\t1\t2\tnew\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_keyed_tsv(spark, str(k)).collect()] == [("a", "new")]


def test_json_and_ids(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"idx":"a","speaker":"s"}\n\n{"idx":"b","speaker":null,"more":1}\n')
    assert sorted((r["idx"], r["speaker"]) for r in readers.read_jsonl(spark, str(tmp_path / "s.jsonl"), readers.SPEAKER_SCHEMA).collect()) == [("a", "s"), ("b", None)]
    (tmp_path / "corpora.json").write_text(json.dumps([{"name": "x", "root": "r"}, {"name": "y", "enabled": False}], indent=1))
    assert {r["name"]: r["enabled"] for r in readers.read_registry(spark, str(tmp_path / "corpora.json")).collect()} == {"x": True, "y": False}
    (tmp_path / "split.txt").write_text(" a \n\nb\n")
    assert sorted(r[0] for r in readers.read_ids(spark, str(tmp_path / "split.txt")).collect()) == ["a", "b"]
    got = readers.list_files(spark, str(tmp_path), "*.json*").select("stem", "length").collect()
    assert sorted(r["stem"] for r in got) == ["corpora", "s"]


def _tone(seconds=1.0, rate=16000, hz=440.0, noise=0.001):
    t = np.arange(int(seconds * rate)) / rate
    return (0.5 * np.sin(2 * np.pi * hz * t) * (t % 2.0 < 1.0) + noise * np.random.default_rng(0).normal(size=len(t))).astype(np.float32)


def test_audio(spark):
    x = _tone(4.0)
    data = audio.encode_wav(x, 16000)
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"junk")), (3, None)], "i int, b binary")
    got = {r["i"]: (r["s"], r["m"]) for r in rows.select("i", audio.seconds_of("b").alias("s"), audio.measures_of("b").alias("m")).collect()}
    assert got[1][0] == 4.0 and got[2][0] is None and got[3][0] is None
    m = got[1][1]
    assert m["seconds"] == 4.0 and m["snr"] > 10 and m["spread"] > 30 and 0 <= m["high"] < 0.01 and m["hum"] < 20
    assert audio.noise_and_hum(x[:5000], 16000) == (0.0, 99.0) and audio.band_edge(x[:100], 16000) == 0
    spectrum = np.fft.rfft(np.random.default_rng(3).normal(size=64000))
    spectrum[np.fft.rfftfreq(64000, 1 / 16000) > 3500] = 0
    assert audio.band_edge(np.fft.irfft(spectrum), 16000) == pytest.approx(3500, abs=30)
    assert audio.encode_pcm16([2.0, -1.5, 0.0]) == (32767).to_bytes(2, "little") + (-32767).to_bytes(2, "little", signed=True) + b"\0\0"
    spans = audio.loud_spans(x, 16000)
    assert len(spans) == 2 and spans[1] == pytest.approx((2.0, 3.0), abs=0.05)
    y = audio.resample(_tone(1.0, noise=0.0), 16000, 24000)
    assert len(y) == 24000 and np.abs(np.fft.rfft(y)).argmax() == 440
    pcm = spark.range(1).select(audio.pcm16_of(F.array(F.lit(1.0)))).first()[0]
    assert bytes(pcm) == b"\xff\x7f"
    null = spark.createDataFrame([(None,), ((bytearray(b""),),), ((bytearray(b"x"),),)], "a struct<bytes:binary>").select(readers.audio_bytes(F.col("a"))).collect()
    assert [r[0] for r in null] == [None, None, bytearray(b"x")]


def _tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    archive.register(spark)
    members = [("x/a.txt", b"text a"), ("x/._a.wav", b"no"), ("x/a.wav", b"AAA"), ("x/b.wav", b"BBB"), ("x/b.txt", b"too late"), ("x/c.json", b'{"text":"c"}'), ("x/c.wav", b"C" * 3_000_000)]
    packed = gzip.compress(_tar(members))
    (tmp_path / "one.tar.gz").write_bytes(packed)
    for i in range(3):
        (tmp_path / f"part.{i}").write_bytes(packed[i * len(packed) // 3 : (i + 1) * len(packed) // 3])
    one = spark.read.format("klangsieb_archive").load(str(tmp_path / "*.tar.gz"))
    cut = spark.read.format("klangsieb_archive").option("split", "true").load(str(tmp_path / "part.*"))
    for df in (one, cut):
        assert sorted(r["member"] for r in df.select("member").collect()) == sorted(m for m, _ in members if "._" not in m)
        assert {r["stem"]: (r["text"], len(r["content"])) for r in archive.paired(df).collect()} == {"a": ("text a", 3), "c": ('{"text":"c"}', 3_000_000)}
    assert spark.read.format("klangsieb_archive").load(str(tmp_path / "none*")).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("wavs/a.wav", 'Er "so"', 1.5), ("wavs/b.wav", None, None)], "wav_rel string, text string, dur double")
    sinks.write_listing(df.where("text is not null"), str(tmp_path / "list"))
    assert readers.read_listing(spark, str(tmp_path / "list")).first()["text"] == 'Er "so"'
    sinks.write_manifest(df, str(tmp_path / "man"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "man")).collect()) == ["wavs/a.wav,\"Er 'so'\",1.5", 'wavs/b.wav,"",']
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.write_tsv(spark.createDataFrame([("w", ["a", "b"])], "w string, t array<string>"), str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).first()["t"] == "a b"
    sinks.write_json_summary(df.groupBy().agg(F.count("*").alias("n")), str(tmp_path / "sum"))
    assert json.loads(spark.read.text(str(tmp_path / "sum")).first()[0]) == {"n": 2}
    assert [r[0] for r in sinks.markdown_lines(df.select("wav_rel", "text"), ["wav_rel"]).collect()] == ['| wavs/a.wav | Er "so" |', "| wavs/b.wav | – |"]
    sp = spark.createDataFrame([("t", 2.0, 3.5, "S"), ("t", 0.0, 1.0, "S")], "tag string, start double, end double, speaker string")
    sinks.write_rttm(sp, str(tmp_path / "rttm"))
    assert "SPEAKER t 1 2.000 1.500 <NA> <NA> S <NA> <NA>" in {r[0] for r in spark.read.text(str(tmp_path / "rttm")).collect()}
    sinks.write_metrics(df.select("dur"), str(tmp_path / "met"))
    assert {r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "met")).collect()} == {"1.5", "NaN"}
    reg = spark.createDataFrame([("x", "old", True), ("y", "r", False)], "name string, root string, enabled boolean")
    sinks.upsert_registry(reg, spark.createDataFrame([("x", "new", True)], reg.schema), str(tmp_path / "reg"))
    assert {r["name"]: r["root"] for r in spark.read.json(str(tmp_path / "reg")).collect()} == {"x": "new", "y": "r"}
    assert {r["name"]: r["enabled"] for r in sinks.set_enabled(reg, ["y"]).collect()} == {"x": False, "y": True}
    assert sinks.snapshot(reg, str(tmp_path / "s"), "splits").endswith("splits.v1") and sinks.snapshot(reg, str(tmp_path / "s"), "splits").endswith("splits.v2")


def test_place(spark, data):
    rows = readers.read_with_place(spark, f"{data}/texts.parquet", ["idx"])
    assert rows.select("_row").distinct().count() == rows.count()


def _feed(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "u long, o long, kind string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return streams.stream_of(spark, str(tmp_path / "in"), files_a_trigger=1)


def test_streams_over_several_batches(spark, tmp_path):
    batches = [[(1, 0, "x", 1.0), (1, 1, "x", 2.0), (2, 0, "x", 3.0)], [(1, 2, "x", 4.0), (1, 3, "end", 5.0), (1, 4, "x", 6.0)], [(1, 5, "x", 7.0), (2, 1, "x", 8.0)]]
    s = _feed(spark, tmp_path, batches)
    out = streams.latest(streams.drain(streams.lifecycle(s, "u", "o", "kind", "end"), "update"), "key", ["steps", "closed", "dropped"])
    got = {r["key"]: tuple(r)[1:] for r in out.collect()}
    assert got[2] == (2, False, 0) and sum(got[1][::2]) == 5 and got[1][1]
    c = streams.drain(streams.chunked(s, "u", "o", "v", 2), "update").collect()
    whole = [r["values"] for r in c if r["key"] == 1 and not r["tail"]]
    assert sorted(sum(whole, [])) == [1.0, 2.0, 4.0, 5.0, 6.0, 7.0] and all(len(w) == 2 for w in whole)
    assert streams.drain(streams.unseen(s.select("u"), "u")).count() == 2
    cache = streams.drain(streams.bounded_cache(s, F.lit(0), "u", "o", 1), "update").agg(F.max("hits") + F.max("misses")).first()[0]
    assert cache == 8
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert streams.process_unseen(spark, lambda: batch.where("u = 1"), batch, "u").select("u").distinct().collect()[0][0] == 2


def test_buffers(spark):
    held, new = F.array(*map(F.lit, [1, 2, 3])), F.array(F.lit(4), F.lit(5))
    got = spark.range(1).select(streams.shift_buffer(held, new, 4), streams.shift_buffer(held, new, 9)).first()
    assert list(got) == [[2, 3, 4, 5], [1, 2, 3, 4, 5]]
