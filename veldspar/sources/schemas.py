"""Row shapes shared by sources and operators (Spark DDL)."""

PARAGRAPH = (
    "doc_id string, idx int, text string, style string, section string, is_heading boolean, in_table boolean, in_bib_field boolean, is_list_item boolean, "
    "footnote_ids array<int>, superscript_spans array<struct<start: int, end: int>>, italic_spans array<struct<start: int, end: int>>"
)
NOTE = "doc_id string, note_id int, text string, kind string"
ISSUE = "doc_id string, `check` string, severity string, code string, para_index int, anchor string, detail string, seq int"
ORDER = (
    "id string, item string, vendor string, catalog string, qty double, unit_price decimal(18,4), unit_size string, url string, account string, project string, status string, "
    "requested_by string, requested date, approved_by string, approved date, ordered date, received_by string, received date, location string, sublocation string, notes string, seq long"
)
DEADLINE = "struct<kind: string, date: date, estimated: boolean>"
CALL = (
    "id string, name string, category string, purpose string, fields array<string>, clinical_only boolean, phd_required boolean, min_years double, max_years double, breaks_extend boolean, "
    "nationalities array<string>, excluded_nationalities array<string>, residence array<string>, hosts array<string>, host_anywhere boolean, excluded_hosts array<string>, max_months int, window_years int, "
    f"deadlines array<{DEADLINE}>, rolling boolean, annual boolean, levels array<string>, membership string, other_rules array<string>, host_letter boolean, verified date, custom boolean"
)
RESEARCHER = (
    "person string, phd_date date, phd_expected date, break_months double, nationalities array<string>, residence string, "
    "stays array<struct<country: string, start: date, end: date>>, fields array<string>, clinical boolean, targets array<string>, level string"
)
SAMPLE = "project string, sample string, description string, kind string, status string, day date, seq int"
