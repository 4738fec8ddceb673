"""Raw venue frames: file source, frame time and the registry of frame parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweave.functions.scalars import ms_to_ns
from bookweave.operators.ordered import count_of, running, sum_of
from bookweave.schemas import table_schema
from bookweave.session import cut_lineage

NUMERIC = ["BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"]


def kind_of(message: Column, path: str) -> Column:
    """Type name of one field of a VARIANT message, null when the field is missing."""
    return F.schema_of_variant(F.try_variant_get(message, path, "variant"))


def is_number(message: Column, path: str) -> Column:
    kind = kind_of(message, path)
    return F.coalesce(kind.isin(NUMERIC) | kind.startswith("DECIMAL"), F.lit(False))


def frame_time_ms(message: Column) -> Column:
    """Event time of a frame: ``T`` when numeric, else ``E`` when numeric, else null."""

    def pick(path: str) -> Column:
        return F.when(is_number(message, path), F.try_variant_get(message, path, "bigint"))

    return F.coalesce(pick("$.T"), pick("$.E"))


def read_frames(spark: SparkSession, path: str, venue_id: int, lines: bool = False) -> DataFrame:
    """Frame files as raw frames: each file a JSON array of frames, or one frame per line (``lines``),
    which splits inside big files.

    The rows keep the frame as JSON text; receive time is the frame's own time. ``frame_no`` is the
    place in the array; for lines it is null, and the receive time gives the order.
    """
    texts = spark.read.text(path, wholetext=not lines)
    if lines:
        frames = texts.select(F.lit(None).cast("bigint").alias("frame_no"), F.try_parse_json("value").alias("message"))
    else:
        items = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
        frames = texts.select(F.posexplode(items).alias("frame_no", "message"))
    return frames.select(
        F.lit(venue_id).alias("venue_id"),
        ms_to_ns(frame_time_ms(F.col("message"))).alias("received_at_ns"),
        F.col("frame_no").cast("bigint").alias("frame_no"),
        F.to_json("message").alias("data"),
    )


def read_array_frames(spark: SparkSession, path: str, venue_id: int) -> DataFrame:
    """Files that hold JSON arrays of frames, of any size and layout, as raw frames; ``frame_no`` is the frame's
    place in its file.

    A big array is split inside the file: Spark reads it in pieces that end at each ``}``. Running sums over a
    file's pieces, in the order of their places, tell whether a piece starts within a text (odd number of quotes
    before it) and at what depth of braces; the pieces up to a return to depth 0 are one frame. What stands
    between frames is left out, and so is a last frame that never ends."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value"
    )
    pieces = cut_lineage(pieces)
    first = pieces.groupBy("file", "start").agg(F.min("id").alias("first")).withColumnsRenamed({"file": "_file", "start": "_start"})
    # rows of a block are fewer than its bytes, so twice its start keeps blocks apart
    pieces = pieces.join(first, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    pieces = pieces.select("file", (F.col("start") * 2 + F.col("id") - F.col("first")).alias("pos"), "value")
    plain = F.regexp_replace("value", r"\\.", "")
    pieces = pieces.withColumn("quotes", F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit(""))))
    pieces = running(pieces, ["file"], ["pos"], before=sum_of(F.col("quotes"), "previous")).drop("_chunk")
    inside = lambda quotes: F.pmod(quotes, F.lit(2)) == 1
    before = F.coalesce("before", F.lit(0))
    outer = F.regexp_replace(F.concat(F.when(inside(before), '"').otherwise(""), plain), '"[^"]*("|$)', "")
    opened = F.length(outer) - F.length(F.replace(outer, F.lit("{"), F.lit("")))
    closed = F.when(inside(before + F.col("quotes")), 0).otherwise(1)
    pieces = pieces.select("file", "pos", "value", (opened - closed).alias("change"), closed.alias("closed"))
    pieces = running(pieces, ["file"], ["pos"], depth=sum_of(F.col("change"))).drop("_chunk")
    ends = (F.col("depth") == 0) & (F.col("closed") == 1)
    pieces = running(pieces, ["file"], ["pos"], frame_no=count_of(ends, "previous")).drop("_chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]), "}")
    frames = pieces.groupBy("file", F.coalesce("frame_no", F.lit(0)).cast("bigint").alias("frame_no")).agg(text.alias("text"), F.max(ends).alias("ends"))
    frames = frames.filter("ends").withColumn("message", F.try_parse_json(F.concat(F.regexp_replace("text", r"^[^{]*", ""), F.lit("}"))))
    return frames.select(
        F.lit(venue_id).alias("venue_id"), ms_to_ns(frame_time_ms(F.col("message"))).alias("received_at_ns"), "frame_no", F.to_json("message").alias("data"), "file"
    )


def stream_frames(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Frames as a stream of JSON lines ``{venue_id, received_at_ns, frame_no, data}``."""
    schema = table_schema("raw_frames").add("frame_no", T.LongType())
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.json(path)


Parser = Callable[[Column], Column]
_PARSERS: dict[str, Parser] = {}


def register_parser(feed: str, parse: Parser) -> None:
    """A feed's own parser: a Column function from frame text to a VARIANT message in the shape the
    normaliser reads."""
    _PARSERS[feed] = parse


def parser_for(feed: str) -> Parser:
    return _PARSERS.get(feed, F.try_parse_json)
