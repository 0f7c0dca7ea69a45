"""Analytics over decoy-server (SSH honeypot) logs as Spark DataFrame operators."""

from decoylog.operators.commands import (
    command_cards,
    command_counts,
    command_events,
    command_summary,
    http_requests,
    top_commands,
)
from decoylog.operators.credentials import (
    credential_cards,
    login_summary,
    top_credentials,
    top_passwords,
    top_usernames,
    with_credential,
)
from decoylog.operators.detect import (
    attack_patterns,
    brute_force,
    detections,
    keyword_commands,
    malware_downloads,
    privilege_escalation,
    recon_commands,
)
from decoylog.operators.drift import field_types, file_schemas, schema_drift
from decoylog.operators.geo import geo_problems, with_location, with_location_label
from decoylog.operators.heavy import hourly_sketches, top_values
from decoylog.operators.listing import log_table, recent_logs, with_severity
from decoylog.operators.quality import ingest_stats, log_file_inventory, validate_logs
from decoylog.operators.rollup import (
    addresses_per_country,
    addresses_per_credential,
    distinct_counts,
    update_rollup,
    value_sets,
)
from decoylog.operators.timerange import time_range
from decoylog.operators.traffic import (
    events_by_type,
    geographic_distribution,
    overview,
    sessions_over_time,
    top_source_ips,
    with_event_name,
)
from decoylog.plans.one_scan import summary_in_one_scan
from decoylog.plans.report import (
    analytics_report,
    analytics_summary,
    dashboard_report,
    to_documents,
    write_report,
)
from decoylog.sources.ledger import covering_files, index_files, load_ledger, read_covering
from decoylog.sources.lines import (
    lines_of_preset,
    list_log_files,
    nonblank,
    read_log_lines,
    read_preset,
    select_log_files,
    stream_log_lines,
)
from decoylog.sources.parse import admitted, parse_events, parse_lines, rejects
from decoylog.sources.store import (
    load_files,
    load_lines,
    merge_loads,
    read_events,
    read_rejects,
    recent_stored,
    stage_events,
    stored_rows,
    vacuum,
    with_live_lines,
    write_events,
)
from decoylog.streaming.alerts import (
    brute_force_so_far,
    first_alerts,
    keyed_alerts,
    start_attempt_counts,
    start_brute_force_alerts,
    start_detection_alerts,
)
from decoylog.streaming.ingest import start_ingest
from decoylog.streaming.live import follow_live
from decoylog.streaming.metrics import (
    closed_sessions,
    corrected_sessions,
    late_events,
    running_ip_counts,
    running_sessions,
    running_type_counts,
    start_closed_sessions,
)

__all__ = [name for name in dir() if not name.startswith("_")]
