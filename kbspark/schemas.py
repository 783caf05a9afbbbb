"""Schemas of the stored tables, as DDL."""

CHUNKS = (
    "domain string, url string, content string, embedding array<float>, source string, label string, page_h1 string, "
    "section_h2 string, chunk_index int, source_urls array<string>, created_at timestamp, chunk_id string"
)
ARCHIVED_CHUNKS = CHUNKS + ", snapshot_id string"
PAGES = (
    "domain string, url string, content_hash string, priority string, used_renderer boolean, has_variants boolean, "
    "chunk_count int, last_scraped_at timestamp, last_changed_at timestamp"
)
SNAPSHOTS = "snapshot_id string, domain string, mode string, chunk_count int, page_count int, affected_urls array<string>, created_at timestamp"
MESSAGES = (
    "domain string, session_token string, seq long, role string, content string, ts timestamp, seen_by_visitor boolean, type string, "
    "model string, top_score double, had_context boolean, classifier_route string, classifier_reason string, selected string"
)
TENANTS = (
    "domain string, name string, plan string, created_at timestamp, rag_threshold double, quota_warning_thresholds array<int>, "
    "quota_alert_channels array<string>, owner_phone string, owner_email string, timezone string, church_mode boolean"
)
USERS = "email string, superadmin boolean, memberships array<struct<entity_domain: string, roles: array<string>, permissions: array<string>>>"
LOGS = "level string, source string, message string, meta string, domain string, created_at timestamp"
CODES = "code string, type string, active boolean, max_uses int, use_count int, expires_at timestamp"
INVITES = "token string, domain string, email string, role string, invited_by string, expires_at timestamp, accepted_at timestamp"

#: Chunks that a crawl never replaces.
PRESERVED_SOURCES = ("manual", "upload", "owner_reply")
