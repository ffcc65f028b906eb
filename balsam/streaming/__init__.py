from balsam.streaming.scoring import masked_stream, run_to_table, score_stream

__all__ = ["masked_stream", "run_to_table", "score_stream"]
