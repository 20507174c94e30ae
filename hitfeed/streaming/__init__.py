from hitfeed.streaming.hits_stream import hits_schema, read_hits, stream_hits

__all__ = ["hits_schema", "read_hits", "stream_hits"]
