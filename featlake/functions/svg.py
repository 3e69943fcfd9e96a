"""Charts of small result tables as SVG text: bars and lines with axes, ticks and a title for each mark."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import escape

WIDTH, HEIGHT, MARGIN, TICKS = 640, 360, 48, 4


def _frame(title: str, top: float, body: str, labels: str) -> str:
    plot = HEIGHT - 2 * MARGIN
    ticks = "".join(
        f'<text x="{MARGIN - 6}" y="{HEIGHT - MARGIN - plot * k / TICKS:.1f}" text-anchor="end" font-size="11">{top * k / TICKS:g}</text>'
        f'<line x1="{MARGIN}" x2="{WIDTH - MARGIN}" y1="{HEIGHT - MARGIN - plot * k / TICKS:.1f}" y2="{HEIGHT - MARGIN - plot * k / TICKS:.1f}" stroke="#ddd"/>'
        for k in range(TICKS + 1)
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" role="img"><title>{escape(title)}</title>{ticks}{body}{labels}</svg>'


def _places(points: Sequence[tuple], top: float) -> list[tuple[float, float]]:
    step = (WIDTH - 2 * MARGIN) / max(1, len(points))
    return [(MARGIN + step * (k + 0.5), HEIGHT - MARGIN - (HEIGHT - 2 * MARGIN) * float(y) / top) for k, (_, y) in enumerate(points)]


def _labels(points: Sequence[tuple], at: list[tuple[float, float]]) -> str:
    return "".join(f'<text x="{x:.1f}" y="{HEIGHT - MARGIN + 16}" text-anchor="middle" font-size="11">{escape(str(n))}</text>' for (n, _), (x, _) in zip(points, at, strict=True))


def _top(points: Sequence[tuple]) -> float:
    return max([float(y) for _, y in points if y > 0], default=1.0)


def bars(points: Sequence[tuple], title: str) -> str:
    """A bar for each (label, value >= 0)."""
    top = _top(points)
    at, width = _places(points, top), 0.7 * (WIDTH - 2 * MARGIN) / max(1, len(points))
    body = "".join(f'<rect x="{x - width / 2:.1f}" y="{y:.1f}" width="{width:.1f}" height="{HEIGHT - MARGIN - y:.1f}" fill="#4477aa"><title>{escape(str(n))}: {v:g}</title></rect>' for (n, v), (x, y) in zip(points, at, strict=True))
    return _frame(title, top, body, _labels(points, at))


def line(points: Sequence[tuple], title: str) -> str:
    """A line through (label, value >= 0), in the given order."""
    top = _top(points)
    at = _places(points, top)
    path = " ".join(f"{x:.1f},{y:.1f}" for x, y in at)
    dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="#4477aa"><title>{escape(str(n))}: {v:g}</title></circle>' for (n, v), (x, y) in zip(points, at, strict=True))
    return _frame(title, top, f'<polyline points="{path}" fill="none" stroke="#4477aa" stroke-width="2"/>{dots}', _labels(points, at))
