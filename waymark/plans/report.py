"""A self-contained HTML report of reward traces: Spark computes the steps and thins them out, the driver only draws."""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import traces
from ..session import cut
from ..sources import documents
from ..sources.files import write_json

COLOURS = ("#1b6ca8", "#c8553d", "#3a7d44", "#7b4b94", "#b58900")
POINTS = 400


def nice(x: float) -> float:
    """The least of 1, 2, 5 times a power of ten that is not below x."""
    if x <= 0:
        return 1.0
    unit = 10.0 ** math.floor(math.log10(x))
    return next(m * unit for m in (1, 2, 5, 10) if m * unit >= x * (1 - 1e-9))


def ticks(lo: float, hi: float, count: int = 5) -> list[float]:
    """Round values that cover lo to hi."""
    span = hi - lo if hi - lo > 1e-9 * max(abs(lo), abs(hi)) else abs(hi) or 1.0  # a flat series has one round value below it
    step = nice(span / max(1, count - 1))
    first = math.floor(lo / step)
    return [round((first + k) * step, 12) for k in range(math.ceil(hi / step - 1e-9) - first + 1)]


def chart(title: str, x: list[float], series: dict[str, list[float]], width: int = 720, height: int = 260) -> str:
    """One SVG line chart; no points give an empty frame."""
    ys = [v for s in series.values() for v in s if v is not None]
    marks = ticks(min(ys), max(ys)) if ys else [0.0, 1.0]
    if len(marks) < 2:
        marks = [marks[0], marks[0] + 1]
    left, top, w, h = 60, 30, width - 80, height - 60
    px = lambda v: left + (w * (v - x[0]) / (x[-1] - x[0]) if len(x) > 1 and x[-1] != x[0] else w / 2)
    py = lambda v: top + h * (1 - (v - marks[0]) / (marks[-1] - marks[0]))
    out = [f'<svg viewBox="0 0 {width} {height}" role="img"><text x="{left}" y="18" font-size="14">{html.escape(title)}</text>']
    for m in marks:
        out.append(f'<line x1="{left}" x2="{left + w}" y1="{py(m):.1f}" y2="{py(m):.1f}" stroke="#ddd"/><text x="{left - 6}" y="{py(m) + 4:.1f}" font-size="11" text-anchor="end">{m:g}</text>')
    for k, (name, values) in enumerate(series.items()):
        points = " ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in zip(x, values, strict=True) if b is not None)
        colour = COLOURS[k % len(COLOURS)]
        out.append(f'<polyline fill="none" stroke="{colour}" stroke-width="1.5" points="{points}"/><text x="{left + 120 * k}" y="{height - 8}" font-size="12" fill="{colour}">{html.escape(name)}</text>')
    return "".join(out) + "</svg>"


def steps(rows: DataFrame, group: int | None = None, columns: tuple[str, ...] = ("total_reward", "single_line_reward", "valid_count_reward", "exact_ten_reward")) -> tuple[int, DataFrame]:
    """The group size and the steps of traces, with missing parts filled in."""
    t = traces.ordered(traces.backfilled(rows))
    g = traces.group_size(t, group)
    return g, traces.steps(t, g, tuple(c for c in columns if c in t.columns))


def report(rows: DataFrame, group: int | None = None, most: int = POINTS) -> tuple[str, dict]:
    """The HTML page and the summary; at most `most` thinned points of each series come to the driver."""
    g, s = steps(rows, group)
    names = [c for c in s.columns if c.endswith(("_mean", "_cum_mean")) and not c.endswith("_cum")]
    thin = traces.downsampled(s.withColumn("_i", F.col("step") - 1), most, "_i", "step", tuple(names)).orderBy("step").collect()
    x = [float(r["step"]) for r in thin]
    parts = [chart(c.replace("_", " "), x, {c: [r[c] for r in thin]}) for c in names]
    summary = traces.summary(rows).first().asDict() | {"group_size": g, "steps": s.count()}
    head = "".join(f"<tr><td>{html.escape(k)}</td><td>{v:.6g}</td></tr>" if isinstance(v, (int, float)) else "" for k, v in summary.items())
    return f'<!doctype html><meta charset="utf-8"><title>Reward traces</title><body><table>{head}</table>{"".join(parts)}</body>', summary


def default_path(trace_path: str) -> str:
    """checkpoints/<dataset>/<stage>/<run>/... gives outputs/<dataset>/<stage>/<run>/report.html; others stand beside the traces."""
    p = trace_path.rstrip("/").split("/")
    if "checkpoints" in p and len(p) > p.index("checkpoints") + 3:
        k = p.index("checkpoints")
        return "/".join([*p[:k], "outputs", *p[k + 1 : k + 4], "report.html"])
    return "/".join([*p[:-1], "report.html"]) if "." in p[-1] else "/".join([*p, "report.html"])


def write(rows: DataFrame, trace_path: str, output_path: str | None = None, csv_path: str | None = None, summary_path: str | None = None, group: int | None = None) -> dict:
    """Writes the page, the steps as CSV (a folder that Spark writes), and the summary as JSON; returns the summary."""
    path = output_path or default_path(trace_path)
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    csv_path, summary_path = csv_path or f"{stem}.csv", summary_path or f"{stem}.summary.json"
    page, summary = report(rows, group)
    _, s = steps(rows, group)
    s = cut(s)
    s.orderBy("step").write.mode("overwrite").option("header", "true").csv(csv_path)
    last = s.orderBy(F.col("step").desc()).limit(1).collect()[0]
    summary = {"trace_path": trace_path, "output_path": path, "csv_path": csv_path, "summary_path": summary_path, "trace_row_count": summary["trace_row_count"], "synthetic_step_count": summary["steps"], "group_size": summary["group_size"], "last_step": last["step"], "last_step_mean_total_reward": last["total_reward_mean"], "last_cumulative_mean_total_reward": last["total_reward_cum_mean"]}
    documents.write(path, page, rows.sparkSession)
    write_json(summary_path, summary)
    return summary
