"""Record schemas of the tables and logs, as DDL text for `spark.read.schema(...)`."""

from __future__ import annotations

_RUN = "struct<name:string,status:string,person:string,confidence:double,processing_time:double,recognized_persons_count:int>"

PERSON = "person_id LONG, name STRING, domain STRING, wikidata_id STRING, occupation STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
VECTOR = "vec_id LONG, person_id LONG, domain STRING, image_path STRING, embedding ARRAY<FLOAT>, confidence DOUBLE, created_at TIMESTAMP"
IMAGE = "image_id LONG, person_id LONG, domain STRING, filename STRING, source STRING, is_validated BOOLEAN, width INT, height INT, created_at TIMESTAMP"
DOMAIN = "code STRING, name STRING, default_occupations STRING, is_active BOOLEAN"
SESSION = "session_id STRING, name STRING, status STRING, created_at TIMESTAMP"
SESSION_RESULT = "session_id STRING, image_id STRING, success BOOLEAN, persons STRING"
DETECTION = "video_id LONG, frame_number LONG, det_id LONG, timestamp DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, embedding ARRAY<FLOAT>, confidence DOUBLE, frame_quality DOUBLE"
TRACK_VOTE = (
    "video_id LONG, track_id LONG, person STRING, avg_confidence DOUBLE, best_confidence DOUBLE, vote_count LONG, total_votes LONG, vote_ratio DOUBLE, consistency DOUBLE, "
    "track_length LONG, first_frame LONG, last_frame LONG, resolved BOOLEAN"
)
FRAME = (
    "video_id LONG, frame_number LONG, timestamp DOUBLE, recognized BOOLEAN, person STRING, confidence DOUBLE, "
    "quality STRUCT<blur_score: DOUBLE, contrast_score: DOUBLE, brightness: DOUBLE, edge_density: DOUBLE, overall_score: DOUBLE>"
)
COMPARISON = (
    f"comparison_id STRING, image_id STRING, timestamp TIMESTAMP, ground_truth STRING, pipeline_a {_RUN}, pipeline_b {_RUN}, "
    "comparison_metrics STRUCT<both_succeeded: BOOLEAN, both_failed: BOOLEAN, only_a_succeeded: BOOLEAN, only_b_succeeded: BOOLEAN, results_match: BOOLEAN, "
    "confidence_difference: DOUBLE, processing_time_difference: DOUBLE, faster_pipeline: STRING>"
)
LOG_ENTRY = (
    "timestamp TIMESTAMP, batch_id STRING, filename STRING, domain STRING, recognized BOOLEAN, primary_result STRUCT<person: STRING, confidence: DOUBLE>, "
    "top_3_matches ARRAY<STRUCT<rank: INT, person: STRING, confidence: DOUBLE, occurrences: LONG, min_distance: DOUBLE, weighted_score: DOUBLE>>, "
    "metadata STRUCT<face_count: INT, processing_time_ms: DOUBLE, has_multiple_faces: BOOLEAN>"
)
REJECTION = "timestamp TIMESTAMP, person STRING, reason STRING, details MAP<STRING, STRING>, source STRING, batch_id STRING, date DATE"
QUEUE_ENTRY = "person STRING, wikidata_id STRING, priority STRING, source STRING, recognition_score DOUBLE, added_at TIMESTAMP, status STRING, order INT"
BENCHMARK = "benchmark_id STRING, person STRING, domain STRING, timestamp TIMESTAMP, images LONG, correct LONG, wrong LONG, not_recognized LONG, score DOUBLE, needs_training BOOLEAN, priority STRING"
TRAINING_BATCH = "batch_id STRING, domain STRING, status STRING, created_at TIMESTAMP, people ARRAY<STRUCT<name: STRING, status: STRING, images_found: LONG, images_accepted: LONG>>"
CHECKPOINT = "person STRING, stage STRING, timestamp TIMESTAMP, data STRING"
NAME_MAP = "normalized STRING, original STRING"
