"""The lexical model: tables, enumerations, keys, and constraints as data."""

from __future__ import annotations

from pyspark.sql import types as T

# The enumerations of the model.
ENUMS = {
    "dictionary_status": ("uploaded", "queued", "importing", "ready", "failed"),
    "import_job_status": ("queued", "running", "completed", "failed"),
    "entry_kind": ("definition", "redirect", "unknown"),
    "content_model": ("html", "structured"),
    "content_block_kind": ("definition", "example", "annotation", "section", "subdivision", "raw"),
    "content_annotation_kind": ("note", "grammar", "orthography", "usage", "caution", "expression", "etymology", "derivative", "other"),
    "content_text_role": ("source", "translation", "transliteration", "definition", "label", "body", "other"),
}

#: Job states and the states that may follow.
TRANSITIONS = {"queued": ("running",), "running": ("completed", "failed"), "completed": (), "failed": ()}


#: The tables' columns, as DDL.
TABLES = {
    "dictionaries": (
        "id string not null, name string not null, storage_key string not null, status string not null, content_model string not null, source_format string, "
        "languages array<string> not null, checksum string, source_metadata variant, imported_at timestamp_ntz, created_at timestamp_ntz"
    ),
    "dictionary_entries": (
        "id string not null, dictionary_id string not null, headword_original string not null, headword_normalized string not null, sort_key string not null, "
        "entry_raw string, entry_sanitized_html string, entry_plain_text string, entry_kind string not null, redirect_target_original string, source_ordinal int not null, "
        "source_record_id string, mdx_locator_version int, mdx_locator_file_checksum string, mdx_locator_key_text string, mdx_locator_key_block_index int, "
        "mdx_locator_record_start_offset bigint, mdx_locator_record_end_offset bigint"
    ),
    "structured_entries": ("entry_id string not null"),
    "structured_forms": (
        "id string not null, structured_entry_id string not null, text string not null, normalized_text string not null, language string, kind string, "
        "tags array<string> not null, priority_tags array<string> not null, restrictions array<string> not null, ordinal int not null"
    ),
    "structured_senses": (
        "id string not null, structured_entry_id string not null, ordinal int not null, source_sense_ordinal int, part_of_speech array<string> not null, "
        "domains array<string> not null, tags array<string> not null, notes string"
    ),
    "structured_entry_definitions": ("id string not null, structured_entry_id string not null, text string not null, language string not null, source string not null, provenance string, ordinal int not null"),
    "structured_sense_definitions": ("id string not null, sense_id string not null, text string not null, language string not null, source string not null, provenance string, ordinal int not null"),
    "structured_examples": ("id string not null, structured_entry_id string not null, sense_id string, content_block_id string, ordinal int not null"),
    "structured_example_texts": ("id string not null, example_id string not null, language string, role string not null, text string not null, ordinal int not null"),
    "structured_content_blocks": ("id string not null, structured_entry_id string not null, parent_block_id string, sense_id string, kind string not null, annotation_kind string, ordinal int not null"),
    "structured_content_texts": ("id string not null, content_block_id string not null, language string, role string not null, text string not null, ordinal int not null"),
    "entry_source_artifacts": ("id string not null, entry_id string not null, parser_name string not null, parser_version string not null, representation_version int not null, text_payload string, bytes_payload binary"),
    "dictionary_source_records": (
        "id string not null, dictionary_id string not null, entry_id string, source_key string not null, source_ordinal int not null, record_kind string not null, "
        "raw_payload string, raw_bytes binary, content_checksum string not null"
    ),
    "dictionary_source_artifacts": (
        "id string not null, source_record_id string not null, parser_name string not null, parser_version string not null, representation_version int not null, "
        "parsed_representation string, representation_checksum string not null, diagnostics string"
    ),
    "vocabulary_items": ("id string not null, entry_id string not null, created_at timestamp_ntz not null"),
    "import_jobs": (
        "id string not null, dictionary_id string not null, status string not null, progress int not null, attempt_count int not null, claimed_by string, claimed_at timestamp_ntz, error string, created_at timestamp_ntz not null"
    ),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


#: Columns that are unique together.
UNIQUE = {
    "dictionaries": (("storage_key",),),
    "dictionary_entries": (("dictionary_id", "source_ordinal"), ("dictionary_id", "source_record_id"), ("dictionary_id", "id")),
    "structured_entries": (("entry_id",),),
    "structured_forms": (("structured_entry_id", "ordinal"),),
    "structured_senses": (("structured_entry_id", "ordinal"), ("structured_entry_id", "source_sense_ordinal"), ("structured_entry_id", "id")),
    "structured_entry_definitions": (("structured_entry_id", "language", "source", "ordinal"),),
    "structured_sense_definitions": (("sense_id", "language", "source", "ordinal"),),
    "structured_examples": (("structured_entry_id", "ordinal"), ("structured_entry_id", "content_block_id")),
    "structured_example_texts": (("example_id", "ordinal"),),
    "structured_content_blocks": (("structured_entry_id", "parent_block_id", "ordinal"),),
    "structured_content_texts": (("content_block_id", "ordinal"),),
    "dictionary_source_records": (("dictionary_id", "source_key"), ("dictionary_id", "source_ordinal"), ("dictionary_id", "entry_id")),
    "dictionary_source_artifacts": (("source_record_id", "parser_name", "parser_version", "representation_version"),),
    "vocabulary_items": (("entry_id",),),
}

#: Child columns, and the parent columns they must be found in; a null in the child's last column refers to nothing.
REFERENCES = {
    "dictionary_entries": ((("dictionary_id",), "dictionaries", ("id",)),),
    "structured_entries": ((("entry_id",), "dictionary_entries", ("id",)),),
    "structured_forms": ((("structured_entry_id",), "structured_entries", ("entry_id",)),),
    "structured_senses": ((("structured_entry_id",), "structured_entries", ("entry_id",)),),
    "structured_entry_definitions": ((("structured_entry_id",), "structured_entries", ("entry_id",)),),
    "structured_sense_definitions": ((("sense_id",), "structured_senses", ("id",)),),
    "structured_examples": (
        (("structured_entry_id",), "structured_entries", ("entry_id",)),
        (("structured_entry_id", "sense_id"), "structured_senses", ("structured_entry_id", "id")),
        (("structured_entry_id", "content_block_id"), "structured_content_blocks", ("structured_entry_id", "id")),
    ),
    "structured_example_texts": ((("example_id",), "structured_examples", ("id",)),),
    "structured_content_blocks": (
        (("structured_entry_id",), "structured_entries", ("entry_id",)),
        (("structured_entry_id", "parent_block_id"), "structured_content_blocks", ("structured_entry_id", "id")),
        (("structured_entry_id", "sense_id"), "structured_senses", ("structured_entry_id", "id")),
    ),
    "structured_content_texts": ((("content_block_id",), "structured_content_blocks", ("id",)),),
    "dictionary_source_records": ((("dictionary_id", "entry_id"), "dictionary_entries", ("dictionary_id", "id")),),
    "dictionary_source_artifacts": ((("source_record_id",), "dictionary_source_records", ("id",)),),
    "vocabulary_items": ((("entry_id",), "dictionary_entries", ("id",)),),
}

#: Row conditions that must hold (SQL; null counts as a violation where the condition is about presence).
CHECKS = {
    "dictionaries": {"status": f"status IN {ENUMS['dictionary_status']}", "content_model": f"content_model IN {ENUMS['content_model']}"},
    "dictionary_entries": {"entry_kind": f"entry_kind IN {ENUMS['entry_kind']}", "ordinal": "source_ordinal >= 0"},
    "structured_forms": {"ordinal": "ordinal >= 0"},
    "structured_senses": {"ordinal": "ordinal >= 0"},
    "structured_content_blocks": {
        "kind": f"kind IN {ENUMS['content_block_kind']}",
        "annotation": "(annotation_kind IS NOT NULL) = (kind IN ('annotation', 'section'))",
        "own_parent": "parent_block_id IS NULL OR parent_block_id <> id",
        "ordinal": "ordinal >= 0",
    },
    "structured_content_texts": {"role": f"role IN {ENUMS['content_text_role']}", "ordinal": "ordinal >= 0"},
    "structured_example_texts": {"role": f"role IN {ENUMS['content_text_role']}", "ordinal": "ordinal >= 0"},
    "entry_source_artifacts": {"payload": "(text_payload IS NULL) <> (bytes_payload IS NULL)", "version": "representation_version > 0"},
    "dictionary_source_records": {"payload": "(raw_payload IS NULL) <> (raw_bytes IS NULL)"},
    "dictionary_source_artifacts": {"version": "representation_version > 0"},
    "import_jobs": {"status": f"status IN {ENUMS['import_job_status']}"},
}
