"""Defaults of every knob that changes a result.  All are plain parameters."""

HAMMING_THRESHOLD = 3
DEDUP_WINDOW_HOURS = 72
EMBEDDING_DIM = 384
CLUSTER_THRESHOLD = 0.62
CLUSTER_WINDOW_HOURS = 72
ALERT_WINDOW_HOURS = 1
PAGE_SIZE = 30
