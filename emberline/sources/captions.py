"""Captions: WebVTT, SRT or plain lines to timed lines, by a small state machine on each file."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

CUE = re.compile(r"^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})\s*-->")
TAG = re.compile(r"<[^>]+>")


def caption_lines(body: str) -> list[tuple[float | None, str]]:
    """(seconds, line); a line equal to the one before is left out, a plain text has no times."""
    out: list[tuple[float | None, str]] = []
    at, timed = None, "-->" in body
    for raw in body.replace("\r", "").split("\n"):
        line = TAG.sub("", raw).strip()
        if m := CUE.match(line):
            h, mi, s, ms = (int(g or 0) for g in m.groups())
            at = 3600 * h + 60 * mi + s + ms / 1000
        elif not line or line.startswith(("WEBVTT", "NOTE", "STYLE")) or (timed and line.isdigit()) or (timed and at is None):
            continue
        elif not out or out[-1][1] != line:
            out.append((at, line))
    return out


def parse_captions(files: DataFrame, id_: str, body: str) -> DataFrame:
    """id, line_no, seconds, line."""

    def f(batches):
        for batch in batches:
            rows = [(i, k, t, x) for i, b in zip(batch[id_], batch[body], strict=True) for k, (t, x) in enumerate(caption_lines(b or ""))]
            yield pd.DataFrame(rows, columns=["id", "line_no", "seconds", "line"])

    return files.select(id_, body).mapInPandas(f, "id long, line_no long, seconds double, line string")
