"""Sources and sinks: paged services, repaired CSV, workbooks, landing folders with manifests."""
