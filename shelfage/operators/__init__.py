"""Operators: filters, ageing aggregates, drill-down, totals / KPIs and lookups."""
