"""Table schemas, as DDL."""

EVENT = (
    "dataset string, split string, raw_user_id string, session_id string, timestamp_utc timestamp, raw_poi_id string, "
    "model_poi_id long, category string, latitude double, longitude double"
)
HISTORY = "array<struct<timestamp:timestamp,poi_id:string,category_name:string,model_poi_id:bigint,latitude:double,longitude:double>>"
VERSIONS = "struct<release:string,data:string,model:string>"
MONITORING = (
    f"request_id string, versions {VERSIONS}, history_length_bucket string, unknown_count long, candidate_count long, "
    "candidate_source_histogram map<string,bigint>, category_histogram map<string,bigint>, score_entropy double, "
    "stage_latency_ms map<string,double>, total_latency_ms double, status string, error_code string"
)
MONITORING_FIELDS = [field.strip().split(" ")[0] for field in (
    "request_id", "versions", "history_length_bucket", "unknown_count", "candidate_count", "candidate_source_histogram",
    "category_histogram", "score_entropy", "stage_latency_ms", "total_latency_ms", "status", "error_code",
)]
