"""Schemas of the pipeline's tables."""

TABLES = {
    "sources": "id string, name string, kind string, uri string, active boolean, created_at timestamp, updated_at timestamp",
    "source_documents": "id string, source_id string, content_hash string, title string, body string, url string, status string, failed_stage string, doc_metadata map<string,string>, created_at timestamp",
    "ingest_jobs": "id string, source_id string, status string, attempts smallint, error string, started_at timestamp, finished_at timestamp",
    "incidents": "id string, document_id string, org string, title string, url string, occurred_on date, severity smallint, summary string, sections array<struct<name:string,text:string>>, content_hash string, license string",
    "incident_labels": "incident_id string, label string, source string, confidence double, model_version string, annotator_id string, annotation_round smallint",
    "minhash_signatures": "document_id string, num_perm smallint, band_size smallint, band_hashes array<string>, hashvalues array<bigint>, canonical_id string",
    "bus_events": "event_id string, event_type string, version int, occurred_at timestamp, content_hash string, data string, source_id string, stream string, batch_no bigint, delivered_at timestamp",
}
