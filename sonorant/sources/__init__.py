"""Sources and sinks: WAV files, transcripts, manual ranges, models, reports."""
