"""Rows of the engine's tables from rows of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import fixed
from ..functions.chains import parse_operators
from ..functions.text import first_of, reference_text, requested_split


#: The columns of a delivered sample, in their order.
RELEASE = """sample_id parent_id file_name clean_parent_path trace_path label split_standard operator_substitution_group_id operator_substitution_detail
parameter_perturbation_group_id parameter_perturbation_axis order_swap_group_id path_group_id language speaker_id source_speaker_id utterance_id transcript raw_transcript source_corpus license_tag
generator_family generator_name chain_family chain_template_id chain_variant_index operator_seq operator_multiset_key path_endpoint_key path_step_index operator_params codec bitrate packet_loss bandwidth_mode
snr rt60 rir_backend room_dim distance seed duration_sec sample_rate channels codec_name sample_fmt""".split()
#: The columns of a preservation result, in their order.
RESULT = """sample_id parent_id split language label chain_family generator_family generator_name speaker_id source_speaker_id clean_parent_path file_name status error reference_text reference_text_normalized
parent_transcript parent_transcript_normalized child_transcript child_transcript_normalized parent_wer child_wer wer_drift parent_cer child_cer cer_drift speaker_similarity parent_duration_sec child_duration_sec
duration_delta_sec duration_ratio_to_parent parent_rms_dbfs child_rms_dbfs rms_dbfs_delta rms_dbfs_delta_abs parent_peak_abs child_peak_abs""".split()
#: What a row of speech says about its speaker and sentence.
SPEECH = "language split source_corpus speaker_id source_speaker_id utterance_id transcript raw_transcript".split()
ABOUT = "license_tag speaker_gender speaker_age speaker_accent speaker_variant sentence_id locale sentence_domain".split()
NO_CHAIN = {"operator_seq": "[]", "operator_params": "{}"}


def _texts(**values: str) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in values.items()]


def _kept(rows: DataFrame, names: list[str], inside: str | None = None) -> list[Column]:
    """The named columns (of the struct ``inside``) as text; blank where a row, or the whole table, has none."""
    there = rows.schema[inside].dataType.names if inside else rows.columns
    value = lambda n: F.col(f"{inside}.{n}" if inside else n).cast("string")
    return [(F.coalesce(value(n), F.lit("")) if n in there else F.lit("")).alias(n) for n in names]


def relative_path(path: Column, root: str) -> Column:
    """``path`` from ``root`` on; as it is, where it lies elsewhere."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)


def absolute_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def source_rows(samples: DataFrame, root: str, raw_root: str) -> DataFrame:
    """Manifest rows of accepted samples.

    ``samples`` has the columns of speech, probe figures (duration, mean_volume_db,
    max_volume_db, silence_duration_sec, speech_ratio, sample_rate, channels,
    codec_name), source_split, source_audio_path, license_tag, seed, and the maps
    speaker_meta and extra_meta.
    """
    meta, extra, source = F.col("speaker_meta"), F.col("extra_meta"), F.col("source_audio_path")
    suffix = F.regexp_extract(source, r"[^/](\.[^./]*)$", 1)
    target = F.concat(F.concat_ws("/", F.lit(raw_root.rstrip("/")), "language", "split", "speaker_id", "utterance_id"), suffix)
    return samples.select(
        F.concat_ws("_", "speaker_id", "utterance_id").alias("sample_id"), *_kept(samples, SPEECH),
        *_texts(label="bona_fide", generator_family="none", generator_name="none", chain_family="source_clean", **NO_CHAIN), F.col("seed").cast("string").alias("seed"),
        fixed(F.col("duration"), 3).alias("duration_sec"), *_kept(samples, ["sample_rate", "channels", "codec_name"]), fixed(F.col("mean_volume_db"), 2).alias("mean_volume_db"), fixed(F.col("max_volume_db"), 2).alias("max_volume_db"),
        fixed(F.col("silence_duration_sec"), 3).alias("silence_duration_sec"), fixed(F.col("speech_ratio"), 3).alias("effective_speech_ratio"), *_kept(samples, ["source_split", "license_tag"]),
        relative_path(source, root).alias("source_audio_path"), relative_path(target, root).alias("stage1_audio_path"),
        first_of(meta, "gender").alias("speaker_gender"), first_of(meta, "age", "age_group").alias("speaker_age"), first_of(meta, "accent", "accents").alias("speaker_accent"), first_of(meta, "variant").alias("speaker_variant"),
        *[first_of(extra, c).alias(c) for c in ("sentence_id", "locale", "sentence_domain")],
    )


def clean_rows(rows: DataFrame, steps: str, params: str) -> DataFrame:
    """``rows`` after cleaning: their own figures become source_*, those of the struct ``output`` (path, duration, sample_rate, channels, codec_name, sample_fmt, size) take their place."""
    out = F.col("output")
    text = lambda c: F.coalesce(out[c].cast("string"), F.lit(""))
    figures = ["duration_sec", "sample_rate", "channels", "codec_name"]
    new = {
        "parent_id": F.col("sample_id"), "clean_parent_path": text("path"), "audio_path": text("path"), "preprocess_stage": F.lit("stage2_clean_master"), "preprocess_steps": F.lit(steps), "preprocess_params": F.lit(params),
        **{f"source_{c}": F.col(c) for c in figures}, "duration_sec": fixed(F.coalesce(out["duration"], F.lit(0.0)), 3), "sample_rate": text("sample_rate"), "channels": text("channels"), "codec_name": text("codec_name"),
        "sample_fmt": text("sample_fmt"), "output_size_bytes": text("size"), "chain_family": F.lit("clean_parent"), **{k: F.lit(v) for k, v in NO_CHAIN.items()},
    }
    return rows.withColumns(new).drop("output")


def generation_jobs(assigned: DataFrame, root: str, output_root: str, seed: int) -> DataFrame:
    """Jobs of assigned sources: structs source and prompt (clean rows), job_id, assignment_idx and the generator's key, name and family. A generator's jobs are a partition of it, not a list."""
    place = F.concat_ws("/", "source.language", "source.split", "source.speaker_id", F.concat("job_id", F.lit(".wav")))
    raw, final = F.concat_ws("/", F.lit(f"{output_root}/audio_raw"), "generator_key", place), F.concat_ws("/", F.lit(f"{output_root}/audio"), place)
    sourced = ["sample_rate", "channels", "codec_name"]
    return assigned.select(
        "job_id", F.col("job_id").alias("sample_id"), F.col("job_id").alias("parent_id"), F.col("source.parent_id").alias("source_parent_id"), F.col("prompt.parent_id").alias("prompt_parent_id"), "assignment_idx", "generator_key", "generator_name", "generator_family",
        *_kept(assigned, SPEECH, "source"), F.col("source.transcript").alias("text"), F.col("prompt.transcript").alias("prompt_text"), absolute_path(F.col("prompt.clean_parent_path"), root).alias("prompt_audio_path"), absolute_path(F.col("source.clean_parent_path"), root).alias("source_audio_path"),
        F.col("source.duration_sec").cast("double").alias("source_duration_sec"), *[F.col(f"source.{c}").cast("string").alias(f"source_{c}") for c in sourced], raw.alias("raw_output_path"), raw.alias("output_path"), final.alias("final_output_path"),
        relative_path(raw, root).alias("raw_output_relpath"), relative_path(final, root).alias("final_output_relpath"), F.col("source.clean_parent_path").alias("source_clean_parent_path"), *_kept(assigned, ABOUT, "source"), F.lit(seed).alias("seed"), "source", "prompt",
    )


def spoof_rows(done: DataFrame, root: str) -> DataFrame:
    """Manifest rows of generated samples: jobs with their result's status and the struct ``probe`` of the output (duration, sample_rate, channels, codec_name, sample_fmt, size)."""
    probe = F.col("probe")
    text = lambda c, blank="": F.coalesce(probe[c].cast("string"), F.lit(blank))
    return done.select(
        *_kept(done, ["sample_id", "parent_id", "source_parent_id", "prompt_parent_id", *SPEECH]), *_texts(label="spoof"), *_kept(done, ["generator_family", "generator_name"]), *_texts(chain_family="clean_parent", **NO_CHAIN), *_kept(done, ["seed"]),
        fixed(probe["duration"], 3).alias("duration_sec"), *[text(c).alias(c) for c in ("sample_rate", "channels", "codec_name", "sample_fmt")], *_kept(done, ["source_duration_sec", "source_sample_rate", "source_channels", "source_codec_name"]),
        F.col("final_output_relpath").alias("clean_parent_path"), F.col("final_output_relpath").alias("audio_path"), *_kept(done, ["source_clean_parent_path"]), F.col("raw_output_relpath").alias("raw_generator_output_path"),
        relative_path(F.col("prompt_audio_path"), root).alias("prompt_audio_path"), text("size", "0").alias("output_size_bytes"), *_kept(done, [*ABOUT, "assignment_idx", "generator_key"]), F.col("status").alias("stage3_status"),
    )


def result_rows(rows: DataFrame) -> DataFrame:
    """Results that hold nothing yet but what the row says; the reference text is the transcript, without one the raw transcript."""
    known = dict(zip(RESULT, _kept(rows, RESULT)))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    said = F.when(value("transcript") != "", value("transcript")).otherwise(value("raw_transcript"))
    given = {"split": requested_split(value("split_standard"), value("split")), "status": F.lit("ok"), "error": F.lit(""), "reference_text": said, "reference_text_normalized": reference_text(said, value("language"))}
    later = RESULT[RESULT.index("parent_transcript") :]
    return rows.select(*[(given[c] if c in given else F.lit("") if c in later else known[c]).alias(c) for c in RESULT])


def failure_records(rows: DataFrame, status: Column, error: Column) -> DataFrame:
    return rows.select("sample_id", "parent_id", "split", "language", "speaker_id", status.alias("status"), F.coalesce(error, F.lit("")).alias("error"), "audio_path")


def with_split(rows: DataFrame, split: Column) -> DataFrame:
    """``rows`` of another standard split."""
    return rows.withColumn("split_standard", split)


def release_rows(rows: DataFrame) -> DataFrame:
    """The columns of a delivered sample as text, blank where ``rows`` has none; file_name is their audio_path, split_standard their split."""
    return fixed_columns(rows, RELEASE, {"file_name": "audio_path", "split_standard": "split"})


def last_of(ops: Column, field: str, *kinds: str) -> Column:
    """The field of the last operator of a kind that has it: an operator without it leaves the older value."""
    having = F.filter(ops, lambda o: o["op"].isin(*kinds) & o[field].isNotNull())
    return F.coalesce(F.try_element_at(having, F.lit(-1))[field], F.lit(""))


def manifest_row(rows: DataFrame) -> DataFrame:
    """``rows`` (with operator_params) and the scalar summaries of their chains: the last operator wins."""
    ops = parse_operators(F.col("operator_params"))
    out = rows.withColumn("__ops", ops)
    o = F.col("__ops")
    return out.select(
        *rows.columns, F.to_json(F.transform(o, lambda x: x["op"])).alias("operator_seq"), last_of(o, "codec", "codec", "reencode").alias("codec"), last_of(o, "bitrate", "codec", "reencode").alias("bitrate"),
        last_of(o, "loss_rate_pct", "packet_loss", "call_path").alias("packet_loss"), last_of(o, "mode", "bandlimit").alias("bandwidth_mode"), last_of(o, "snr_db", "noise").alias("snr"),
        last_of(o, "rt60", "rir").alias("rt60"), last_of(o, "distance", "rir").alias("distance"), last_room(o).alias("room_dim"), first_backend(o).alias("rir_backend"),
    )


def last_room(ops: Column) -> Column:
    """The measures of the last room as JSON text."""
    rooms = F.filter(ops, lambda o: (o["op"] == "rir") & o["room"]["room_dim"].isNotNull())
    return F.coalesce(F.to_json(F.try_element_at(rooms, F.lit(-1))["room"]["room_dim"]), F.lit(""))


def first_backend(ops: Column) -> Column:
    """What the first room was made by, as its rendering noted."""
    rooms = F.filter(ops, lambda o: o["op"] == "rir")
    return F.coalesce(F.get(rooms, F.lit(0))["backend"], F.lit(""))


def fixed_columns(rows: DataFrame, columns: list[str], renamed: dict[str, str]) -> DataFrame:
    """Exactly ``columns`` as text, blank where ``rows`` has none; ``renamed`` gives a column's source."""
    source = lambda c: renamed.get(c, c)
    return rows.select(*[(F.coalesce(F.col(source(c)).cast("string"), F.lit("")) if source(c) in rows.columns else F.lit("")).alias(c) for c in columns])


def audio_deltas(rows: DataFrame) -> DataFrame:
    """``rows`` with differences and ratios of child against parent figures (duration, rms, peak)."""
    delta = [(F.col(f"child_{c}") - F.col(f"parent_{c}")).alias(f"{c}_delta") for c in ("duration", "rms", "peak")]
    ratio = F.when(F.col("parent_duration") > 0, F.col("child_duration") / F.col("parent_duration")).alias("duration_ratio")
    return rows.select("*", *delta, ratio)


def audio_figures(rows: DataFrame) -> DataFrame:
    """``rows`` with the ten audio figures of a result, rounded to six decimals: of structs parent and child (duration, rms_dbfs, peak)."""
    p, c = F.col("parent"), F.col("child")
    figures = {
        "parent_duration_sec": p["duration"], "child_duration_sec": c["duration"], "duration_delta_sec": c["duration"] - p["duration"], "duration_ratio_to_parent": F.when(p["duration"] > 0, c["duration"] / p["duration"]),
        "parent_rms_dbfs": p["rms_dbfs"], "child_rms_dbfs": c["rms_dbfs"], "rms_dbfs_delta": c["rms_dbfs"] - p["rms_dbfs"], "rms_dbfs_delta_abs": F.abs(c["rms_dbfs"] - p["rms_dbfs"]), "parent_peak_abs": p["peak"], "child_peak_abs": c["peak"],
    }
    return rows.select("*", *[F.round(v, 6).alias(k) for k, v in figures.items()])


def status_ladder(rows: DataFrame) -> DataFrame:
    """``rows`` with status: missing child, missing parent, unreadable audio, ok."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.withColumn("status", F.when(text("child_path") == "", "missing_child").when(text("parent_path") == "", "missing_parent").when(F.col("child_duration").isNull(), "unreadable_audio").otherwise("ok"))
