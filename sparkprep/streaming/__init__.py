from .scoring import replay_stream, start_scoring

__all__ = ["replay_stream", "start_scoring"]
