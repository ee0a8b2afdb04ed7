"""Text forms of results: playlists, metric lines, JSON lines (K6, K7, K16-K18), and their writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.fold import ordered_fold


def live_playlist(segments: DataFrame, key: str, window: int = 6) -> DataFrame:
    """K6/K7: the media playlist of the last ``window`` segments (segment_id, duration_ms) per key.

    Ranked before they are gathered, so a key's list holds ``window`` lines at most."""
    latest = Window.partitionBy(key).orderBy(F.desc("segment_id"))
    last = segments.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= window)
    line = F.format_string("#EXTINF:%.3f,\nseg-%05d.m4s", F.col("duration_ms") / 1000, F.col("segment_id"))
    told = F.array_sort(F.collect_list(F.struct("segment_id", line.alias("line"))))
    found = last.groupBy(key).agg(F.max("duration_ms").alias("longest"), F.min("segment_id").alias("first"), told.alias("told"))
    target, body = F.ceil(F.col("longest") / 1000).cast("string"), F.array_join(F.transform("told", lambda x: x["line"]), "\n")
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:"), target, F.lit("\n#EXT-X-MEDIA-SEQUENCE:"), F.col("first").cast("string"), F.lit("\n"))
    return found.select(key, F.concat(head, body, F.lit("\n")).alias("playlist"))


def _element(name: str, attributes: dict[str, Column | str], *inside: Column) -> Column:
    """An XML element on no line of its own, attributes by name; those that are null are left out."""
    told = [F.coalesce(F.concat(F.lit(f' {k}="'), v if isinstance(v, Column) else F.lit(v), F.lit('"')), F.lit("")) for k, v in sorted(attributes.items())]
    return F.concat(F.lit(f"<{name}"), *told, F.lit(">"), *inside, F.lit(f"</{name}>"))


#: Names of the manifest's format. Fixed values.
DASH, XSI, CHANNELS = "urn:mpeg:dash:schema:mpd:2011", "http://www.w3.org/2001/XMLSchema-instance", "urn:mpeg:mpegB:cicp:ChannelConfiguration"
PROFILES = "urn:mpeg:dash:profile:cmaf:2019,urn:mpeg:dash:profile:isoff-live:2011"


def dash_manifest() -> Column:
    """K7: the live manifest, as one line of XML, of a row (start_s, target_s, latest, available, offset_s, video,
    audio). video (codecs, width, height, frame_rate, timescale, bandwidth) and audio (codecs, channels,
    sample_rate, bandwidth) are left out where they are null. An offset above 0 announces segments that
    much before they are whole."""
    target, offset = F.col("target_s"), F.col("offset_s")
    early, text = offset > 0, lambda c: F.col(c).cast("string")
    seconds = lambda c, digits=1: F.format_string(f"PT%.{digits}fS", c)

    def segments_of(prefix: str, scale: Column) -> Column:
        told = {"timescale": scale.cast("string"), "duration": F.floor(target * scale).cast("string"), "startNumber": F.greatest("latest", F.lit(1)).cast("string"), "initialization": "init.mp4", "media": f"{prefix}-$Number%05d$.m4s"}
        return _element("SegmentTemplate", told | {"availabilityTimeOffset": F.when(early, F.format_string("%.3f", offset)), "availabilityTimeComplete": F.when(early, "false")})

    def adaptation(kind: str, representation: Column, more: dict[str, str]) -> Column:
        told = {"contentType": kind, "mimeType": f"{kind}/mp4", "codecs": F.col(f"{kind}.codecs"), "segmentAlignment": "true", "startWithSAP": "1"}
        return F.when(F.col(kind).isNotNull(), _element("AdaptationSet", told | more, representation)).otherwise("")

    video = _element("Representation", {"id": "video", "bandwidth": text("video.bandwidth"), "width": text("video.width"), "height": text("video.height"), "frameRate": text("video.frame_rate")}, segments_of("seg", F.col("video.timescale")))
    channels = _element("AudioChannelConfiguration", {"schemeIdUri": CHANNELS, "value": text("audio.channels")})
    audio = _element("Representation", {"id": "audio", "bandwidth": text("audio.bandwidth"), "audioSamplingRate": text("audio.sample_rate")}, channels, segments_of("aud", F.col("audio.sample_rate")))
    period = _element("Period", {"id": "0", "start": "PT0S"}, adaptation("video", video, {}), adaptation("audio", audio, {"lang": "und"}))
    started = F.expr("date_format(timestampadd(SECOND, start_s, timestamp_ntz'1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    told = {"xmlns": DASH, "xmlns:xsi": XSI, "xsi:schemaLocation": f"{DASH} DASH-MPD.xsd", "type": "dynamic", "profiles": PROFILES, "availabilityStartTime": started}
    told |= {"minimumUpdatePeriod": seconds(F.greatest(target, F.lit(1.0))), "minBufferTime": seconds(F.greatest(target * 1.5, F.lit(2.0))), "timeShiftBufferDepth": seconds(F.greatest(F.col("available") * target, F.lit(30.0)), 0)}
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), _element("MPD", told | {"suggestedPresentationDelay": F.when(early, seconds(F.greatest(offset * 3, F.lit(1.5))))}, period))


def _escaped(label: Column) -> Column:
    """Label values: backslash, quote and line feed are escaped."""
    return F.replace(F.replace(F.replace(label.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def metric_lines(stats: DataFrame, labels: list[str], metrics: dict[str, str]) -> DataFrame:
    """One row ``line`` for each row and metric (column: family) whose value isn't null."""
    label = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), _escaped(F.col(c)), F.lit('"')) for c in labels])
    lines = [F.concat(F.lit(family + "{"), label, F.lit("} "), F.col(c).cast("string")) for c, family in metrics.items()]
    return stats.select(F.explode(F.array(*lines)).alias("line")).where("line is not null")


def json_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows as JSON objects, one a line; nulls are left out."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)


class Channel:
    """A queue of ``capacity`` events whose reader takes ``per_second``; what comes while it is full is
    dropped."""

    def __init__(self, capacity: int, per_second: int):
        self.capacity, self.per_second, self.held, self.last, self.dropped = capacity * 1_000_000, per_second, 0, None, 0

    def send(self, now_us: int) -> bool:
        if self.last is not None:
            self.held = max(self.held - (now_us - self.last) * self.per_second, 0)
        self.last = now_us
        if self.held + 1_000_000 > self.capacity:
            self.dropped += 1
            return False
        self.held += 1_000_000
        return True


def bounded_channel(events: DataFrame, key: str, time: str, capacity: int = 4096, per_second: int = 1000) -> DataFrame:
    """(key, event_id, sent, dropped) with the drops so far, for each sender."""
    def step(s: Channel, r) -> list[tuple]:
        sent = s.send(r.at)
        return [(r.sender, r.event_id, sent, s.dropped)]

    rows = events.select(F.col(key).alias("sender"), F.col(time).alias("at"), "event_id")
    told = ordered_fold(rows, ["sender"], ["at", "event_id"], lambda: Channel(capacity, per_second), step, "sender long, event_id long, sent boolean, dropped long")
    return told.withColumnRenamed("sender", key)
