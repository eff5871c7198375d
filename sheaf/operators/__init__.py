"""DataFrame -> DataFrame operators, one module per area: graph, assemble,
lines, drawing, report, triage, stats, usage, metrics."""
