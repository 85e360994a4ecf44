"""Schemas of the stored tables."""

from __future__ import annotations

LOCATOR = "struct<path:string,start_line:int,end_line:int>"
SCHEMAS = {
    "documents": "corpus_id string, doc_idx int, filename string, content string",
    "text_units": f"corpus_id string, id string, document_name string, ordinal int, text string, attributes map<string,string>, locator {LOCATOR}, ord long",
    "entities": f"corpus_id string, identity string, name string, type string, description string, unit_ids array<string>, attributes map<string,string>, locator {LOCATOR}, ord long",
    "relationships": f"corpus_id string, src_id string, type string, tgt_id string, source string, source_type string, target string, target_type string, description string, unit_ids array<string>, weight long, attributes map<string,string>, locator {LOCATOR}, ord long",
    "communities": "corpus_id string, community_id string, title string, summary string, attributes map<string,string>, ord long",
    "memberships": "corpus_id string, community_id string, identity string, ord long",
    "chunks": "corpus_id string, id string, ordinal int, text string, document_name string, embedding array<float>, projection array<double>",
    "projections": "corpus_id string, mean array<double>, pc1 array<double>, pc2 array<double>",
    "entity_embeddings": "corpus_id string, identity string, embedding array<float>",
    "community_embeddings": "corpus_id string, community_id string, embedding array<float>",
    "corpora": "corpus_id string, name string, document_names array<string>, status string, created_at timestamp, last_activated_at timestamp",
    "trace_steps": f"trace_id string, step_no int, kind string, identifier string, label string, locator {LOCATOR}, attributes map<string,string>, corpus_id string",
    "trace_uses": "corpus_id string, trace_id string, used_at long",
    "progress_events": "corpus_id string, seq long, type string, data string",
}
#: The columns that identify a row within its corpus.
KEYS = {
    "documents": ["doc_idx"],
    "text_units": ["id"],
    "entities": ["identity"],
    "relationships": ["src_id", "type", "tgt_id"],
    "communities": ["community_id"],
    "memberships": ["community_id", "identity"],
    "chunks": ["id"],
    "projections": [],
    "entity_embeddings": ["identity"],
    "community_embeddings": ["community_id"],
    "corpora": [],
    "trace_steps": ["trace_id", "step_no"],
    "trace_uses": ["trace_id"],
    "progress_events": ["seq"],
}
