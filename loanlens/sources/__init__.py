"""Scans, optional tables, derived loan tables and sinks."""

from loanlens.sources.readers import (  # noqa: F401
    read_table, read_optional, scan_application, write_reference, read_reference,
    append_log, read_log, parse_risk_factors, risk_factors_json,
)
from loanlens.sources.derived import (  # noqa: F401
    load_tables, application, bureau, previous_application,
)
