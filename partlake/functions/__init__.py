"""Column expressions: null-safe arithmetic, ERP text normalisation, the KPI formula language."""
