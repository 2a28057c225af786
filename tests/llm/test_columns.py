"""Columns whose names differ in case only, or come twice, in every operator."""

from __future__ import annotations

from klangsieb.llm.capping import cap_contributors
from klangsieb.llm.chunking import cut_texts
from klangsieb.llm.leakage import leaks
from klangsieb.llm.mixing import mix_to_shares
from klangsieb.llm.overlap import expand, near_same, sentences
from klangsieb.llm.packing import pack
from klangsieb.llm.splitting import components
from klangsieb.llm.terms import term_counts
from klangsieb.operators.malformed import load_lines
from klangsieb.operators.ordered import holding


def _odd(spark, row, schema):
    """The row, with every column again in upper case and the first one a third time."""
    df = spark.createDataFrame([row], schema)
    names = df.columns
    other = df.selectExpr(*[f"`{n}` as `{n}`" for n in names], *[f"'x' as `{n.upper()}`" for n in names], f"9 as `{names[0]}`")
    return other


def test_all(spark):
    meta = _odd(spark, ("a", "s", 2.0), "idx string, corpus string, dur_proc_s double")
    goal = _odd(spark, ("s", 1.0, 1), "name string, target_share double, max_repeat int")
    assert mix_to_shares(meta, goal)[0].count() == 1
    assert holding(meta, "idx", latest="dur_proc_s", keep=["corpus"]).first()["corpus"] == "s"
    doc = _odd(spark, (1, "eins zwei drei vier fünf sechs sieben acht"), "doc_id long, text string")
    assert term_counts(doc)[0].count() == 8
    assert cap_contributors(meta, "idx", "corpus", "dur_proc_s", max_count=1).count() == 1
    assert components(meta, "idx", ["corpus"]).first()["component"] == "s"
    rows = sentences(doc, "doc_id", "text")
    assert expand(*near_same(rows, rows)).count() == 1
    assert pack(_odd(spark, (1, 5), "item long, size long"), "item", "size").count() == 1
    item = _odd(spark, (5, "eins zwei drei vier fünf sechs sieben acht"), "item_id long, text string")
    assert leaks(doc, item).count() == 1
    assert cut_texts(doc).count() == 1
    assert load_lines(_odd(spark, (1, "tsv", "a"), "line_id long, file_kind string, line string")).count() == 1
