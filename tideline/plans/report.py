"""HTML reports on the driver, from small collected tables; charts are inline SVG."""

from __future__ import annotations

import base64
import html
from pathlib import Path

STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.2em .6em;text-align:right}caption{text-align:left}"


def cell(v) -> str:
    return html.escape(f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v))


class ReportRenderer:
    """Collects parts and renders one page. template: a str.format text with {title}, {css}, {body}."""

    TEMPLATE = "<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title><style>{css}</style></head><body><h1>{title}</h1>{body}</body></html>"

    def __init__(self, title: str = "Report", template: str | None = None):
        self.title, self.template, self.parts, self.styles = title, template or self.TEMPLATE, [], [STYLE]

    def set_title(self, title: str) -> ReportRenderer:
        self.title = title
        return self

    def add_html(self, part: str) -> ReportRenderer:
        self.parts.append(part)
        return self

    def add_css(self, css: str) -> ReportRenderer:
        self.styles.append(css)
        return self

    def add_text(self, text: str) -> ReportRenderer:
        return self.add_html(html.escape(text))

    def add_paragraph(self, text: str) -> ReportRenderer:
        return self.add_html(f"<p>{html.escape(text)}</p>")

    def add_heading(self, text: str, level: int = 1) -> ReportRenderer:
        if not 1 <= level <= 6:
            raise ValueError("heading levels are 1 to 6")
        return self.add_html(f"<h{level}>{html.escape(text)}</h{level}>")

    def add_section(self, title: str, content: str) -> ReportRenderer:
        return self.add_html(f"<section><h2>{html.escape(title)}</h2>{content}</section>")

    def add_image(self, path: str, alt: str = "") -> ReportRenderer:
        return self.add_html(f'<img src="{html.escape(Path(path).absolute().as_uri())}" alt="{html.escape(alt)}">')

    def add_svg(self, svg: str, alt: str = "") -> ReportRenderer:
        data = base64.b64encode(svg.encode()).decode()
        return self.add_html(f'<img src="data:image/svg+xml;base64,{data}" alt="{html.escape(alt)}">')

    def add_table(self, columns: list[str], rows: list, caption: str = "") -> ReportRenderer:
        return self.add_html(table(columns, rows, caption))

    def render_html(self) -> str:
        return self.template.format(title=html.escape(self.title), css="\n".join(self.styles), body="\n".join(self.parts))

    def save_html(self, path: str) -> None:
        Path(path).write_text(self.render_html(), encoding="utf-8")

    def render_pdf(self, path: str) -> None:
        try:
            from weasyprint import HTML
        except ImportError as e:
            raise ImportError("PDF output needs the optional package weasyprint; save_html works without it") from e
        HTML(string=self.render_html()).write_pdf(path)


def table(columns: list[str], rows: list, caption: str = "") -> str:
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table>{f'<caption>{html.escape(caption)}</caption>' if caption else ''}<tr>{head}</tr>{body}</table>"


def _svg(parts: list[str], w: int = 480, h: int = 240) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}">{"".join(parts)}</svg>'


def _scale(lo: float, hi: float, a: float, b: float):
    return lambda v: a if hi == lo else a + (v - lo) / (hi - lo) * (b - a)


def histogram_svg(bins: list[tuple[float, float, float]], marks: dict[str, float], title: str) -> str:
    """bins: (from, to, density)."""
    if not bins:
        return _svg([])
    x, y = _scale(bins[0][0], bins[-1][1], 10, 470), _scale(0, max(b[2] for b in bins) or 1, 220, 30)
    parts = [f'<text x="10" y="18" font-size="14">{html.escape(title)}</text>']
    parts += [f'<rect x="{x(a):.1f}" y="{y(d):.1f}" width="{max(0.5, x(b) - x(a) - 0.5):.1f}" height="{220 - y(d):.1f}" fill="#7aa6c2"/>' for a, b, d in bins]
    parts += [f'<line x1="{x(v):.1f}" x2="{x(v):.1f}" y1="30" y2="220" stroke="#b03a2e"/><text x="{x(v) + 2:.1f}" y="{40 + 12 * i}" font-size="10">{html.escape(k)} {v:.4g}</text>' for i, (k, v) in enumerate(marks.items()) if v is not None]
    return _svg(parts)


def box_svg(stats: list[tuple[str, list[float]]]) -> str:
    """Rows of (name, [min, lower, median, upper, max])."""
    parts = []
    for i, (name, (lo, q1, m, q3, hi)) in enumerate(stats):
        x, y = _scale(lo, hi, 120, 470), 30 + 40 * i
        parts.append(f'<text x="4" y="{y + 4}" font-size="11">{html.escape(name)}</text><line x1="{x(lo)}" x2="{x(hi)}" y1="{y}" y2="{y}" stroke="#333"/>')
        parts.append(f'<rect x="{x(q1):.1f}" y="{y - 10}" width="{x(q3) - x(q1):.1f}" height="20" fill="#cfe2ec" stroke="#333"/><line x1="{x(m):.1f}" x2="{x(m):.1f}" y1="{y - 10}" y2="{y + 10}" stroke="#b03a2e"/>')
    return _svg(parts, 480, 40 * len(stats) + 20)


def matrix_svg(names: list[str], others: list[str], value: dict[tuple[str, str], float]) -> str:
    parts = []
    for i, a in enumerate(names):
        parts.append(f'<text x="4" y="{52 + 30 * i}" font-size="10">{html.escape(a)}</text>')
        for j, b in enumerate(others):
            v = value.get((a, b))
            tone = "#eee" if v is None else f"rgb({int(255 - 155 * max(0, -v))},{int(255 - 120 * abs(v))},{int(255 - 155 * max(0, v))})"
            parts.append(f'<rect x="{110 + 60 * j}" y="{34 + 30 * i}" width="58" height="28" fill="{tone}"/><text x="{116 + 60 * j}" y="{52 + 30 * i}" font-size="10">{"" if v is None else f"{v:.2f}"}</text>')
    parts += [f'<text x="{112 + 60 * j}" y="24" font-size="9">{html.escape(b)}</text>' for j, b in enumerate(others)]
    return _svg(parts, 130 + 60 * len(others), 50 + 30 * len(names))


def lines_svg(series: dict[str, list[tuple[float, float]]], title: str) -> str:
    points = [p for s in series.values() for p in s if p[1] is not None]
    if not points:
        return _svg([])
    x = _scale(min(p[0] for p in points), max(p[0] for p in points), 30, 470)
    y = _scale(min(p[1] for p in points), max(p[1] for p in points), 220, 30)
    tones = ("#1f618d", "#b03a2e", "#1e8449", "#7d3c98", "#b9770e")
    parts = [f'<text x="10" y="18" font-size="14">{html.escape(title)}</text>']
    for i, (name, s) in enumerate(series.items()):
        path = " ".join(f"{x(a):.1f},{y(b):.1f}" for a, b in s if b is not None)
        parts.append(f'<polyline points="{path}" fill="none" stroke="{tones[i % 5]}"/><text x="380" y="{40 + 12 * i}" font-size="10" fill="{tones[i % 5]}">{html.escape(name)}</text>')
    return _svg(parts)


def scatter_svg(points: list[tuple[float, float]], title: str) -> str:
    if not points:
        return _svg([])
    x = _scale(min(p[0] for p in points), max(p[0] for p in points), 30, 470)
    y = _scale(min(p[1] for p in points), max(p[1] for p in points), 220, 30)
    parts = [f'<text x="10" y="18" font-size="14">{html.escape(title)}</text>']
    return _svg(parts + [f'<circle cx="{x(a):.1f}" cy="{y(b):.1f}" r="2" fill="#1f618d" fill-opacity="0.4"/>' for a, b in points])


class EDAReport(ReportRenderer):
    """A page with a section for each summary: its table, then its charts."""

    def __init__(self, summaries: list, template: str | None = None, title: str = "Exploratory Data Analysis Report"):
        super().__init__(title, template)
        self.summaries = summaries

    def add_summary(self, summary) -> EDAReport:
        if not summary.results_available:
            summary.compute()
        rows, charts = summary.shown(), summary.plot()
        if not rows and not charts:
            raise ValueError(f"{summary.name}: nothing to render")
        content = table(list(rows[0].asDict()), [list(r) for r in rows]) if rows else ""
        return self.add_section(summary.name, content + "".join(charts))

    def add_summaries(self) -> EDAReport:
        for s in self.summaries:
            self.add_summary(s)
        return self
