"""Forward mode on streams: the quads of rows as they arrive. A map's work is row by row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..mapping import TriplesMap
from ..operators import rdf


def write_stream(engine, m: TriplesMap, df: DataFrame, path: str, checkpoint: str, graphs: bool = False, once: bool = True) -> StreamingQuery:
    """Write the triples (with graphs: quads) of a stream of rows under m as lines of text files. once: what is there now,
    else on and on. The folder `checkpoint` keeps what has been read, so that a restart goes on from there."""
    out = rdf.lines(rdf.map_dataframe(engine, m, df), graphs).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
