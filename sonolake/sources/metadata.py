"""Production metadata: keyframe text, audio-definition XML, run histories.

A bad line or document gives a row with an error, not a failed task.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.base import held

PATH_FIELDS = ["object", "time_s", "x", "y", "z", "gain", "lfe_send"]
HISTORY = "commit string, branch string, commit_date string, leg string, codec string, check string, bitrate_kbps int, worst_db double, channels_db array<double>, threshold_db double"
EDGE = "file_id string, kind string, id string, name string, ref_kind string, ref string, pos int, error string"
# Element kinds of the audio definition model, their id attributes, and the references they hold.
KINDS = {
    "audioProgramme": ("audioProgrammeID", ["audioContentIDRef"]),
    "audioContent": ("audioContentID", ["audioObjectIDRef"]),
    "audioObject": ("audioObjectID", ["audioObjectIDRef", "audioPackFormatIDRef", "audioTrackUIDRef"]),
    "audioPackFormat": ("audioPackFormatID", ["audioPackFormatIDRef", "audioChannelFormatIDRef"]),
    "audioChannelFormat": ("audioChannelFormatID", []),
    "audioTrackUID": ("UID", ["audioPackFormatIDRef", "audioTrackFormatIDRef"]),
}


def keyframes(lines: DataFrame) -> DataFrame:
    """'object time x y z gain lfe' lines; '#' begins a comment, blank lines are dropped, others are errors."""
    text = F.trim(F.regexp_replace("value", "#.*", ""))
    parts = F.split(text, "\\s+")
    x = lines.select("value", parts.alias("p")).where(text != "")
    cols = [F.try_element_at("p", F.lit(i + 1)).try_cast("int" if i == 0 else "double").alias(n) for i, n in enumerate(PATH_FIELDS)]
    out = x.select(*cols, F.size("p").alias("n"), "value")
    bad = (F.col("n") != len(PATH_FIELDS)) | F.greatest(*[F.col(c).isNull() for c in PATH_FIELDS])
    return out.select(*[F.when(~bad, F.col(c)).alias(c) for c in PATH_FIELDS], F.when(bad, F.concat(F.lit("bad line: "), "value")).alias("error"))


def duplicate_times(frames: DataFrame) -> DataFrame:
    """Objects whose keyframes share an instant: such a path is rejected."""
    w = Window.partitionBy("object").orderBy("time_s")
    return frames.where("error IS NULL").withColumn("same", F.lag("time_s").over(w) == F.col("time_s")).groupBy("object").agg(F.count_if("same").alias("duplicates")).where("duplicates > 0")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Run histories as JSON lines, by a fixed schema."""
    return spark.read.schema(HISTORY).json(path)


def definition_graph(files: DataFrame) -> DataFrame:
    """(file, kind, id, name, reference) rows of audio-definition XML documents; an element without references is one row."""
    names = [f.split()[0] for f in EDGE.split(", ")]
    types = [pa.int32() if f.split()[1] == "int" else pa.string() for f in EDGE.split(", ")]

    def rows_of(path: str, text: str):
        try:
            root = ET.fromstring(text)
        except ET.ParseError as e:
            return [(path, None, None, None, None, None, None, str(e))]
        out = []
        for node in root.iter():
            kind = node.tag.rpartition("}")[2]
            if kind in KINDS and node.get(KINDS[kind][0]):
                ident, refs = node.get(KINDS[kind][0]), KINDS[kind][1]
                found = [(c.tag.rpartition("}")[2], (c.text or "").strip()) for c in node]
                found = [f for f in found if f[0] in refs]
                name = node.get(f"{kind}Name")
                out += [(path, kind, ident, name, k.removesuffix("IDRef").removesuffix("Ref"), r, i, None) for i, (k, r) in enumerate(found)] or [(path, kind, ident, name, None, None, None, None)]
        return out

    def work(batches):
        for batch in batches:
            rows = [r for path, text in zip(batch.column(0), batch.column(1)) for r in rows_of(path.as_py(), text.as_py() or "")]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.select(F.col("path"), F.col("content").cast("string")).mapInArrow(work, EDGE)


def unresolved(graph: DataFrame) -> DataFrame:
    """References to ids that no element of the file has."""
    ids = graph.where("id IS NOT NULL").select("file_id", F.col("id").alias("ref")).distinct()
    return graph.where("ref IS NOT NULL").join(ids, ["file_id", "ref"], "left_anti").select("file_id", "kind", "id", "ref")


def leaf_objects(graph: DataFrame, depth: int | None = None) -> DataFrame:
    """(file, programme, object) of all objects below each programme; a cycle on a path is reported as an error.

    Levels end when no path is left to extend, or after ``depth`` of them where that is given.
    """
    edges = held(graph.where("ref IS NOT NULL AND kind IN ('audioProgramme', 'audioContent', 'audioObject') AND ref_kind IN ('audioContent', 'audioObject')").select("file_id", F.col("id").alias("at"), F.col("ref").alias("next")))
    walk = graph.where("kind = 'audioProgramme'").select("file_id", F.col("id").alias("programme"), F.col("id").alias("at"), F.array("id").alias("path")).distinct()
    seen = walk.select("file_id", "programme", "at", F.lit(False).alias("cycle"))
    level = 0
    while (depth is None or level < depth) and not walk.isEmpty():
        step = held(walk.join(edges, ["file_id", "at"]).withColumn("cycle", F.array_contains("path", F.col("next"))))
        seen = seen.unionByName(step.select("file_id", "programme", F.col("next").alias("at"), "cycle"))
        walk = step.where("NOT cycle").select("file_id", "programme", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        level += 1
    objects = graph.where("kind = 'audioObject'").select("file_id", F.col("id").alias("at")).distinct()
    return seen.join(objects, ["file_id", "at"]).groupBy("file_id", "programme", F.col("at").alias("object")).agg(F.bool_or("cycle").alias("cycle"))
