from glossa.streaming.jobs import (document_line_stream, run_available, stream_ngram_counts,
                                   stream_predictions)

__all__ = ["document_line_stream", "run_available", "stream_ngram_counts", "stream_predictions"]
