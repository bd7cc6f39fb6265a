"""Multi-job work: lineage control, iterative fits, parameter draws."""
