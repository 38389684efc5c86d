"""An append-only event log on Spark: versioned appends, ordered reads and checkpointed consumers."""
