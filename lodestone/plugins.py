"""Plugins: formats added at run time, by call or from the ``*.py`` files of a folder.

A plugin module has FORMATS, a list of FormatPlugin. Executors get the plugins that are
registered when a query is built with its tasks; modules that a plugin imports must be there.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import model
from lodestone.parsers import READERS, Parsed


@dataclass
class FormatPlugin:
    """A format with its reader, detector (bytes, name -> confidence) and export edges."""

    format: model.Format
    read: Callable[[bytes, str, str], Parsed]
    detect: Callable[[bytes, str], float] | None = None
    exports: list[tuple[str, str]] = field(default_factory=list)


PLUGINS: dict[str, FormatPlugin] = {}


def register(plugin: FormatPlugin) -> None:
    """The first registration of a format wins."""
    if not isinstance(plugin, FormatPlugin):
        raise TypeError("a FormatPlugin is needed")
    name = plugin.format.format
    PLUGINS.setdefault(name, plugin)
    model.FORMATS.setdefault(name, plugin.format)
    READERS.setdefault(name, plugin.read)
    model.EXPORTS.setdefault(name, [*plugin.exports, ("sfp", "LOSSLESS")])


def unregister(name: str) -> None:
    """Take a plugin's format out again; formats that are built in stay."""
    if PLUGINS.pop(name, None):
        for table in (model.FORMATS, READERS, model.EXPORTS):
            table.pop(name, None)


def load_folder(folder: str | None = None) -> list[str]:
    """Load the folder's modules in order ('_' in front: skipped); returns warnings of those that fail."""
    folder = folder or os.environ.get("LODESTONE_PLUGIN_DIR", "plugins")
    warnings = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if not name.endswith(".py") or name.startswith("_"):
            continue
        try:
            spec = importlib.util.spec_from_file_location(f"lodestone_plugin_{name[:-3]}", os.path.join(folder, name))
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            for plugin in module.FORMATS:
                register(plugin)
        except Exception as error:
            warnings.append(f"plugin {name}: {error}")
    return warnings


def vote(data: bytes, name: str, found: str, confidence: float) -> tuple[str, float]:
    """Plugins are asked only where detection ended at plain text or unknown bytes; the surest wins, of equals the last name."""
    if found not in ("txt", "blob"):
        return found, confidence
    votes = []
    for n, p in PLUGINS.items():
        try:
            votes.append((float(p.detect(data, name)) if p.detect else 0.0, n))
        except Exception:  # a detector that fails has no vote
            continue
    best = max(votes, default=(0.0, found))
    return (best[1], best[0]) if best[0] > confidence else (found, confidence)


def voted(found: Column, data: Column, name: Column) -> Column:
    """The detection ``found``, or that of the plugin that is surer; no Python runs where no plugin has a detector."""
    shipped = [p for p in PLUGINS.values() if p.detect]
    if not shipped:
        return found

    @F.pandas_udf("format string, confidence double")
    def asked(bodies: pd.Series, names: pd.Series, formats: pd.Series, sure: pd.Series) -> pd.DataFrame:
        for plugin in shipped:
            register(plugin)
        rows = [(f, c) if b is None else vote(bytes(b), n or "", f, c) for b, n, f, c in zip(bodies, names, formats, sure)]
        return pd.DataFrame(rows, columns=["format", "confidence"])

    def choose(f: Column) -> Column:
        open_ended = f["format_id"].isin("txt", "blob")
        won = asked(F.when(open_ended, data), name, f["format_id"], f["confidence"].cast("double"))
        of = lambda attribute: F.create_map(*(x for p in shipped for x in (F.lit(p.format.format), F.lit(getattr(p.format, attribute)))))
        own = F.struct(
            won["format"].alias("format_id"), of("display")[won["format"]].alias("display"), of("mime")[won["format"]].alias("mime"), f["extension"].alias("extension"),
            won["confidence"].alias("confidence"), F.lit("plugin").alias("method"), F.lit("confirmed by a plugin's detector").alias("notes"), of("category")[won["format"]].alias("family"),
        )
        return F.when(won["format"] != f["format_id"], own).otherwise(f)

    return choose(found)


def ppm() -> FormatPlugin:
    """The sample plugin: PPM images (P3 and P6)."""
    from lodestone.parsers.images import raster

    row = model.Format("ppm", "PPM image", "ppm", "image/x-portable-pixmap", "IMAGE", model.SUPPORT_LEVELS[0], True, True, True, True, "magic", "ppm")
    return FormatPlugin(row, raster, lambda d, n: 0.95 if d[:2] in (b"P3", b"P6") and d[2:3].isspace() else 0.0, [("ppm", "LOSSLESS"), ("png", "LOSSLESS")])
