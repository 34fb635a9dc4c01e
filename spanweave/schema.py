"""Table layouts, as DDL. Times are integer milliseconds on the media clock unless named ``_s``."""

from __future__ import annotations

#: One detected or hand-made span. ``approved`` has three values: true acts, false leaves, null waits.
FINDING = (
    "media_id BIGINT, id BIGINT, start_ms BIGINT, end_ms BIGINT, category STRING, confidence DOUBLE, "
    "engine STRING, action STRING, approved BOOLEAN, reasoning STRING, engine_ref STRING")
FINDING_COLUMNS = [field.split()[0] for field in FINDING.split(", ")]
#: What a detector hands over: ids are given by reconciliation.
DETECTED_COLUMNS = [c for c in FINDING_COLUMNS if c != "id"]

CUE = ("media_id BIGINT, cue_idx BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING")
WORD = (
    "media_id BIGINT, seg_idx BIGINT, word_idx BIGINT, start_s DOUBLE, end_s DOUBLE, word STRING, "
    "probability DOUBLE, seg_text STRING")
SHOT = (
    "media_id BIGINT, shot_index BIGINT, start_frame BIGINT, end_frame BIGINT, start_s DOUBLE, end_s DOUBLE")
JOB = (
    "id STRING, media_path STRING, engine STRING, status STRING, progress DOUBLE, stage STRING, error STRING, "
    "fingerprint STRING, created_at TIMESTAMP, updated_at TIMESTAMP, options MAP<STRING,STRING>, "
    "queue_position BIGINT")

# JSON documents as they are exchanged with detectors and review tools.
TIMELINE_JSON = (
    "schemaVersion INT, mediaFingerprint STRING, nextSegmentId BIGINT, segments ARRAY<STRUCT<id: BIGINT, "
    "startMs: BIGINT, endMs: BIGINT, category: STRING, confidence: DOUBLE, engine: STRING, "
    "recommendedAction: STRING, approved: BOOLEAN, reasoning: STRING, engineRef: STRING>>")
TRANSCRIPT_JSON = (
    "model STRING, duration DOUBLE, segments ARRAY<STRUCT<start: DOUBLE, `end`: DOUBLE, text: STRING, "
    "words: ARRAY<STRUCT<start: DOUBLE, `end`: DOUBLE, word: STRING, probability: DOUBLE>>>>")
PLAN_JSON = (
    "shots ARRAY<STRUCT<index: BIGINT, start_frame: BIGINT, end_frame: BIGINT, start_time: DOUBLE, "
    "end_time: DOUBLE>>, verdicts ARRAY<STRUCT<shot_index: BIGINT, action: STRING, category: STRING, "
    "confidence: DOUBLE, reasoning: STRING, boxes: ARRAY<STRUCT<frame_idx: BIGINT, x1: BIGINT, y1: BIGINT, "
    "x2: BIGINT, y2: BIGINT>>>>")
SHOTS_JSON = (
    "ARRAY<STRUCT<index: BIGINT, start_frame: BIGINT, end_frame: BIGINT, start_s: DOUBLE, end_s: DOUBLE>>")
