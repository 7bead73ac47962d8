"""Sources and sinks: task files, URLs and media metadata, providers outside Spark, results and diagnostics."""
