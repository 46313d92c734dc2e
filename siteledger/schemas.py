"""Schemas of the tables that operators read and write."""

SEARCH_SNAPSHOT = "date date, page string, query string, clicks int, impressions int, ctr double, position double"
TRAFFIC_SNAPSHOT = "date date, page string, channel string, sessions int, engaged_sessions int, conversions int"
SITEMAP_AUDIT = "id string, run_at timestamp, url_count int, stale_entries int, errors array<string>"
ROBOTS_AUDIT = "id string, run_at timestamp, is_valid boolean, errors array<string>"
STRUCTURED_DATA_AUDIT = "id string, run_at timestamp, url string, schema_type string, is_valid boolean, errors array<string>"
PERFORMANCE_AUDIT = "id string, run_at timestamp, url string, performance_score int, lcp double, cls double, inp double, errors array<string>"
FINDING = "source string, finding_type string, stable_key_input string, title string, detail string, source_ref_id string"
OPPORTUNITY = (
    "stable_key string, source string, source_ref_id string, finding_type string, title string, detail string, impact int, effort int, "
    "priority_score double, status string, first_detected_at timestamp, resolved_at timestamp, "
    "reviewed_at timestamp, reviewed_content_hash string, review_reason string"
)
APPLIED_CHANGE = "id long, stable_key string, finding_type string, status string, merged_on date, file_path string, previous_content string, pr_number long"
ARTICLE = "slug string, url string, content_hash string, embedding array<float>, updated_at timestamp"
LINK_SUGGESTION = "stable_key string, source_slug string, target_slug string, similarity double, status string"
GRADUATION = "finding_type string, consecutive_good long, auto_merge_eligible boolean"
ALERT = "type string, subject string, body string, acknowledged boolean, created_at timestamp"
