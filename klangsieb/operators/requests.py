"""Requests as data: routing to templates, required fields, segments, profiles, bucket lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of the templates with the fields they need, and the marks around an instruction.
TEMPLATES = {
    "tts_plain": ["text"],
    "tts_instruction": ["text", "instruction"],
    "ref_clone_tata": ["text", "ref_audio_path", "ref_text"],
    "ref_edit_tata": ["text", "instruction", "ref_audio_path", "ref_text"],
}
INSTRUCTION_MARKS = ("<ins_bos>", "<ins_eos>")


def filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def template_name(ref_audio: Column, ref_text: Column, instruction: Column) -> Column:
    """The template by what is there; null where only one half of a reference is. A blank instruction is none."""
    audio, ref, told = filled(ref_audio), filled(ref_text), filled(F.btrim(instruction))
    with_ref = F.when(told, "ref_edit_tata").otherwise("ref_clone_tata")
    return F.when(audio != ref, None).when(audio, with_ref).otherwise(F.when(told, "tts_instruction").otherwise("tts_plain"))


def checked_template(ref_audio: Column, ref_text: Column, instruction: Column) -> Column:
    """As ``template_name``, but an incomplete reference fails the run."""
    t = template_name(ref_audio, ref_text, instruction)
    return F.when(t.isNull(), F.raise_error(F.lit("reference audio and text must come together"))).otherwise(t)


def missing_fields(template: Column, fields: dict[str, Column]) -> Column:
    """Names of the fields that the template needs and that are null or empty."""
    out = F.array().cast("array<string>")
    for name, needed in TEMPLATES.items():
        lacking = F.array_compact(F.array(*[F.when(~filled(fields[f]), f) for f in needed]))
        out = F.when(template == name, lacking).otherwise(out)
    return out


def speaker_prefix(speaker: Column) -> Column:
    """``[name]``; nothing for no speaker, and no second pair of brackets."""
    bracketed = speaker.startswith("[") & speaker.endswith("]")
    return F.when(~filled(speaker), "").when(bracketed, speaker).otherwise(F.concat(F.lit("["), speaker, F.lit("]")))


def segments(template: Column, text: Column, instruction: Column, ref_audio: Column, ref_text: Column, speaker: Column) -> Column:
    """The prompt as an array of (type, text, audio_path) in order."""
    p = speaker_prefix(speaker)
    kind = "array<struct<type:string,text:string,audio_path:string>>"

    def said(*parts: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), F.concat(*parts).alias("text"), F.lit(None).cast("string").alias("audio_path"))

    heard = F.struct(F.lit("audio").alias("type"), F.lit(None).cast("string").alias("text"), ref_audio.alias("audio_path"))
    told = (p, F.lit(INSTRUCTION_MARKS[0]), instruction, F.lit(INSTRUCTION_MARKS[1]), text)
    layouts = {
        "tts_plain": F.array(said(p, text)),
        "tts_instruction": F.array(said(*told)),
        "ref_clone_tata": F.array(said(p, ref_text), heard, said(p, text)),
        "ref_edit_tata": F.array(said(p, ref_text), heard, said(*told)),
    }
    out = F.lit(None).cast(kind)
    for name, layout in layouts.items():
        out = F.when(template == name, layout.cast(kind)).otherwise(out)
    return out


def smallest_bucket(needs: DataFrame, buckets: DataFrame, group: str, need: str, size: str) -> DataFrame:
    """For every row the smallest bucket of its group that is large enough; null where none is.

    The bucket list of a group comes as one sorted array (profiles name a
    few dozen), so the lookup is a join on the group, not on the inequality.
    """
    lists = buckets.groupBy(group).agg(F.array_sort(F.collect_set(size)).alias("_b"))
    out = needs.join(lists, group, "left")
    return out.withColumn("bucket", F.try_element_at(F.filter("_b", lambda b: b >= F.col(need)), F.lit(1))).drop("_b")


PROFILE = (
    "schema_version int, name string, service struct<concurrency:int,cfg_scales:array<double>>, "
    "stages struct<text_encoder:struct<graphs:array<struct<batch_size:int,token_length:int>>>,"
    "backbone_prefill:struct<graphs:array<struct<branch_batch_size:int,sequence_length:int>>>>"
)


def profile_faults(profile: Column, step: int = 32) -> Column:
    """Names of the rules that a parsed warm-up profile breaks: version, scales, and per stage graphs and aligned lengths."""
    text, prefill = profile["stages"]["text_encoder"]["graphs"], profile["stages"]["backbone_prefill"]["graphs"]
    shapes = F.array_distinct(F.transform(profile["service"]["cfg_scales"], lambda s: F.when(s == 1.0, 1).otherwise(2)))
    rules = [
        ("unreadable", profile.isNull()),
        ("version", ~F.coalesce(profile["schema_version"] == 1, F.lit(False))),
        ("concurrency", ~F.coalesce(profile["service"]["concurrency"] >= 1, F.lit(False))),
        ("scales", F.coalesce(F.size(profile["service"]["cfg_scales"]), F.lit(0)) < 1),
        ("text_graphs", F.coalesce(F.size(text), F.lit(0)) < 1),
        ("text_aligned", ~F.coalesce(F.forall(text, lambda g: g["token_length"] % step == 0), F.lit(True))),
        ("prefill_aligned", ~F.coalesce(F.forall(prefill, lambda g: g["sequence_length"] % step == 0), F.lit(True))),
        ("prefill_shapes", F.size(F.coalesce(F.array_except(shapes, F.transform(prefill, lambda g: g["branch_batch_size"])), F.array().cast("array<int>"))) > 0),
    ]
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules]))
