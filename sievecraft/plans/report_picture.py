"""The summary of a run as a picture, drawn by the JVM's own graphics on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .report import display_lines

# The size and colours of the picture.
WIDTH, LINE, TOP = 1280, 38, 170
_COLOURS = {"TRAINING READY": "#4ade80", "ATTENTION REQUIRED": "#fb7185", "NOT READY": "#fb7185", "DATASET REPORT": "#60a5fa"}
_BACK, _PANEL, _RULE, _TITLE, _QUIET, _BODY, _WARN = "#0b1220", "#111827", "#334155", "#f8fafc", "#94a3b8", "#e2e8f0", "#fbbf24"


def _colour_of(line: str) -> str:
    if line.startswith(("- [FAILED]", "- [EXCLUDED]")):
        return _WARN
    return _COLOURS.get(line, _QUIET if line.startswith("Full report:") else _BODY)


def render_summary(spark: SparkSession, summary: str, title: str = "Dataset audit") -> bytes:
    """PNG of the summary's lines, wrapped, 72 of them at most."""
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    lines = display_lines(summary)
    height = max(720, TOP + LINE * len(lines) + 72)
    image = jvm.java.awt.image.BufferedImage(WIDTH, height, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    g = image.createGraphics()
    colour = lambda c: g.setColor(jvm.java.awt.Color.decode(c))
    font = lambda size, bold: g.setFont(jvm.java.awt.Font("SansSerif", int(bold), size))
    colour(_BACK)
    g.fillRect(0, 0, WIDTH, height)
    colour(_PANEL)
    g.fillRoundRect(32, 32, WIDTH - 64, height - 64, 24, 24)
    colour(_RULE)
    g.drawRoundRect(32, 32, WIDTH - 64, height - 64, 24, 24)
    g.drawLine(72, TOP - 10, WIDTH - 72, TOP - 10)
    font(40, True)
    colour(_TITLE)
    g.drawString(title, 72, 110)
    for k, line in enumerate(lines):
        font(24, line in _COLOURS)
        colour(_colour_of(line))
        g.drawString(line, 76, TOP + 30 + LINE * k)
    g.dispose()
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "png", out)
    return bytes(out.toByteArray())
