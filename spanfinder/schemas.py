"""Declared schemas of the library tables, as DDL. New columns are nullable, so old files stay readable."""

from __future__ import annotations

SPAN_LIST = "array<struct<start_s: double, end_s: double>>"
WORDS = "array<struct<w: string, s: double, e: double>>"
BOXES = "array<struct<t: string, c: double, b: array<array<double>>>>"

TABLES: dict[str, str] = {
    "videos": (
        "video_id string, title string, source string, status string, error string, duration_s double, width int, height int, "
        "fps double, size_bytes bigint, chunk_count int, priority_band int, created_at timestamp, upload_completed_at timestamp, "
        "first_searchable_at timestamp, completed_at timestamp"
    ),
    "video_chunks": (
        "video_id string, chunk_index int, start_s double, end_s double, status string, stage string, error string, "
        "extracted_at timestamp, transcribed_at timestamp, embedded_at timestamp, ocr_at timestamp, captioned_at timestamp, "
        "temporal_at timestamp, done_at timestamp, asr_model string"
    ),
    "utterances": (f"video_id string, chunk_index int, start_s double, end_s double, text string, words {WORDS}"),
    "segments": (
        "segment_id string, video_id string, chunk_index int, index int, start_s double, end_s double, text string, context_text string, "
        "ocr_text string, caption_text string, text_embedding array<float>, caption_embedding array<float>, "
        "embedding_model string, ocr_model string, keyframe_key string"
    ),
    "frames": (
        "frame_id string, video_id string, segment_id string, t_s double, image_key string, phash string, visual_embedding array<float>, "
        f"visual_model string, ocr_text string, caption string, ocr_boxes {BOXES}"
    ),
    "topics": (
        "video_id string, index int, start_s double, end_s double, label string, keyphrases array<string>, embedding array<float>, source string"
    ),
    "embeddings": (
        "window_id string, video_id string, segment_id string, chunk_index int, kind string, model_key string, start_s double, end_s double, embedding array<float>"
    ),
    "index_versions": ("kind string, model_key string, dim int, status string, index_name string, created_at timestamp"),
    "jobs": (
        "id string, type string, queue string, status string, priority int, attempts int, max_attempts int, idempotency_key string, "
        "video_id string, chunk_index int, payload string, locked_by string, last_error string, heartbeat_at timestamp, started_at timestamp, "
        "finished_at timestamp, created_at timestamp"
    ),
    "metric_samples": ("id bigint, name string, value double, source string, ts timestamp"),
    "dataset_videos": (
        "dataset string, dataset_video_id string, external_id string, split string, duration_s double, source_url string, meta_title string, "
        "video_id string, status string, created_at timestamp"
    ),
    "dataset_queries": (
        f"dataset string, query_id string, dataset_video_id string, external_id string, split string, text string, modality string, relevant {SPAN_LIST}"
    ),
    "training_examples": (
        "experiment string, query_id string, positive_id string, segment_id string, rank int, score double, signals map<string,double>"
    ),
}

PARTITIONS = {"embeddings": ("kind", "model_key")}

ANNOTATION = (
    "qid bigint, query string, vid string, duration double, relevant_windows array<array<double>>, saliency_scores array<array<bigint>>"
)
DATASET_DOC = (
    "videos array<struct<key: string, title: string, file: string, url: string, license: string>>, "
    "queries array<struct<id: string, text: string, modality: string, author: string, notes: string, "
    "relevant: array<struct<video: string, start_s: double, end_s: double>>>>"
)
TRANSCRIPT = (
    "model string, utterances array<struct<start: double, end: double, text: string, words: " + WORDS + ">>"
)
MANIFEST = "array<struct<t_ms: bigint, key: string, phash: string>>"
