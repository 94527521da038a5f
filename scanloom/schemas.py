"""Table schemas as Spark DDL."""

FILES = (
    "repository_name string, file_seq bigint, name string, extension string, relative_path string, "
    "absolute_path string, size bigint, modified_time timestamp, content string, valid_utf8 boolean"
)
FINDING_FIELDS = (
    "finding_id string, title string, description string, severity string, confidence string, "
    "file_path string, line_number int, code_snippet string, explanation string, fix_suggestion string, "
    "category string, owasp string, cwe string, attack_scenario string, business_impact string, "
    "`references` array<string>, patch string"
)
# finding_seq orders the findings of a scan: (phase, file, scanner, rule, line).
FINDING_SEQ = "struct<phase:int,file_seq:bigint,scanner:int,rule:int,line:int,tail:string>"
FINDINGS = f"scan_id string, finding_seq {FINDING_SEQ}, {FINDING_FIELDS}"
SCORE = (
    "overall_score int, severity_breakdown map<string,int>, category_scores map<string,int>, risk_summary string"
)
HISTORY = (
    "seq bigint, scan_id string, repository_name string, repository_url string, timestamp timestamp, score int, "
    "findings_count bigint, delta_score int, critical_fixed bigint, new_issues bigint"
)
STATE_EVENTS = (
    "seq bigint, scan_id string, status string, progress int, stage string, message string, error string, "
    "report_path string"
)
#: Events may also carry a time (microseconds) and say whose scan it is.
TIMED_EVENTS = f"{STATE_EVENTS}, ts bigint, repository_name string, repository_url string"
SCAN_STATE = (
    "scan_id string, status string, progress int, stage string, started_at double, finished_at double, "
    "error string, report_path string, repository_name string, repository_url string, message string"
)
REPORT = (
    "scan_id string, repository_name string, repository_url string, timestamp timestamp, status string, "
    f"score struct<overall_score:int,severity_breakdown:map<string,int>,category_scores:map<string,int>,risk_summary:string>, "
    "total_files bigint, total_size bigint, scan_duration_sec double, "
    "languages array<struct<language:string,files:bigint,size:bigint>>, frameworks array<string>, dependencies array<string>, configs array<string>"
)
REPORT_FINDING = f"scan_id string, {FINDING_FIELDS}"
