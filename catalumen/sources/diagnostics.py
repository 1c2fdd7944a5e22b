"""What several tools say of video files, and all tags of one file."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions.constants import EXTENSIONS, MORE_VIDEO
from catalumen.functions.paths import shorten, suffix
from catalumen.functions.tags import DIAGNOSTIC, about_camera, diagnose
from catalumen.sources import kernels
from catalumen.sources.listing import list_files

#: Command lines of tools that print JSON; a tool that isn't on an executor's path gives no output.
TOOLS = {"probe": ["ffprobe", "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams"], "tool": ["exiftool", "-j"]}


def ask(command: list[str], path: str) -> str | None:
    """What a tool prints of a file; null if there is no such tool or it fails."""
    if shutil.which(command[0]) is None:
        return None
    done = subprocess.run([*command, path], capture_output=True, text=True)
    return done.stdout if done.returncode == 0 else None


def tool_outputs(videos: DataFrame) -> DataFrame:
    """path with general and video (tag maps), probe and tool (JSON texts) of each video."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                general, outputs = None, []
                try:
                    general = kernels.movie_head(path)
                except Exception:  # noqa: BLE001  a broken file has no tags
                    general = None
                for command in TOOLS.values():
                    try:
                        outputs.append(ask(command, path))
                    except (OSError, subprocess.SubprocessError):
                        outputs.append(None)
                rows.append((path, general, {}, *outputs))
            yield pd.DataFrame(rows, columns=["path", "general", "video", "probe", "tool"])

    return videos.select("path").mapInPandas(run, "path string, general map<string,string>, video map<string,string>, probe string, tool string")


def video_diagnostic(spark: SparkSession, root: str) -> DataFrame:
    """file, tool and seven columns: three rows for each video under root, in order of the file."""
    kinds = [*EXTENSIONS["video"], *MORE_VIDEO]
    videos = list_files(spark, root).filter(F.lower(suffix(F.col("name"))).isin(kinds))
    said = tool_outputs(videos.repartition(spark.sparkContext.defaultParallelism))
    rows = said.select("path", F.inline(diagnose(F.col("general"), F.col("video"), F.col("probe"), F.col("tool"))))
    relative = F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    return rows.select(relative.alias("file"), "tool", *DIAGNOSTIC)


def tag_rows(tags: DataFrame) -> DataFrame:
    """file, track, tag, value (shortened), about_camera of non-empty tags. tags: file, track, tags (a map)."""
    rows = tags.select("file", "track", F.explode("tags").alias("tag", "value")).filter("value <> ''")
    return rows.select("file", "track", "tag", shorten(F.col("value")).alias("value"), about_camera(F.col("tag")).alias("about_camera"))


def inspect_file(spark: SparkSession, path: str) -> DataFrame:
    """All tags of one file: of its container, and of the tool where there is one."""
    found = [(path, "General", kernels.movie_head(path))]
    if said := ask(TOOLS["tool"], path):
        found += [(path, "Tool", {k: str(v) for k, v in one.items()}) for one in json.loads(said)]
    return tag_rows(spark.createDataFrame(found, "file string, track string, tags map<string,string>"))
