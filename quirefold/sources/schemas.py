"""Schemas of pages, elements, problems, evaluations and job logs."""

from __future__ import annotations

POINT = "struct<x: double, y: double>"
ELEMENT = f"struct<bbox: array<{POINT}>, label: string, content: string>"
PAGES = f"doc_id string, page_index int, elements array<{ELEMENT}>"
OPTION = "struct<label: string, text: string>"
PROBLEMS = f"doc_id string, problem_seq int, number string, question string, answer string, options array<{OPTION}>, analysis string, header_page int, completed_page int"
STORED_PAGE = f"type string, version int, elements array<{ELEMENT}>"
JOB_EVENTS = "job_id string, sequence int, type string, created_at timestamp, page_index int, problem_count int, error_type string, message string"
PATTERNS = "question string, options string, answer string, noise_lines array<string>, noise_prefixes array<string>, multiline_options boolean"
