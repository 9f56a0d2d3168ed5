"""Table-level operators: conformance, splitting, resolution, time-valid data, profiles, checks."""
