"""Declared schemas: nothing is inferred, so ids keep their leading zeros and absent columns read as null."""

from __future__ import annotations

from attestra.functions.normalize import AMOUNT_FIELDS, DATE_FIELDS, FIELDS, ID_FIELDS

DATASET = "id long, stored_path string, stored_filename string, pcpl_inn string, bene_inn string, bank_inn string, issue_date string, start_date string, end_date string, sum string, currency string, ikz string"


def results_schema() -> str:
    """SRC5: a result row, all measures that may occur declared."""
    fields = []
    for f in FIELDS:
        fields += [f"match_{f} boolean", f"error_type_{f} string"]
        if f in ID_FIELDS or f in DATE_FIELDS:
            fields.append(f"edit_sim_{f} double")
        if f in ID_FIELDS:
            fields.append(f"digit_acc_{f} double")
        if f in AMOUNT_FIELDS:
            fields += [f"abs_error_{f} double", f"within_tol_{f} boolean"]
    return "id long, stored_path string, ocr_engine string, extractor string, status string, error_msg string, ocr_ms double, extract_ms double, total_ms double, gold_json string, pred_json string, " + ", ".join(fields)


RESULTS = results_schema()
RUN = "run_id string, seed_path string, sample_size long, seed_value long, ocr_engine string, extractor string, llm_model string, created_at string, machine struct<system:string,machine:string,processor:string,python:string>"
WORDS = "page long, ord int, text string, block_num int, line_num int, word_num int, left int, top int, width int, height int, conf double"
JOBS = "id string, created_at timestamp, updated_at timestamp, status string, pipeline string, engine_ocr string, engine_llm string, lang string, schema_version string, input_type string, original_filename string, source_path string, sha256 string, page_count int, progress_pages int, duration_ms_ocr int, duration_ms_llm int, duration_ms_total int, error_code string, error_message string, trace_id string"
EXTRACTIONS = "id int, job_id string, schema_version string, status string, json_validated string, json_raw string, confidence double, warnings string, created_at timestamp"
CORRECTIONS = "id int, job_id string, created_at timestamp, payload_json string, previous_payload_json string, comment string, submitted_by string, version int"
