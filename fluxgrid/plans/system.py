"""Information about the session, its operators and their settings; log levels; status."""

from __future__ import annotations

import importlib.util
import json
import os
import platform

from pyspark.sql import SparkSession

LEVELS = {"OFF": 100, "ERROR": 40, "WARNING": 30, "INFO": 20, "DEBUG": 10, "TRACE": 5, "ALL": 0}


def system_information(spark: SparkSession) -> dict[str, str]:
    """Folder, session and versions."""
    return {
        "current_directory": os.getcwd(), "session_id": spark.sparkContext.applicationId, "context_name": spark.sparkContext.appName,
        "output": json.dumps({"spark": spark.version, "python": platform.python_version(), "processors": os.cpu_count()}),
    }


def platform_information(name: str = "fluxgrid") -> dict[str, str]:
    """What this library is as a platform."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return {"id": name, "name": name, "language": "Python", "technologies": "Apache Spark", "root_folder": root}


def class_exists(name: str) -> bool:
    """Whether a module can be imported."""
    try:
        return importlib.util.find_spec(name) is not None
    except ModuleNotFoundError:
        return False


def log_level(level: str = "DEBUG", given: str | None = None, variable: str = "") -> tuple[str, bool]:
    """A level from an input, an environment variable or a parameter, and whether anything is logged."""
    found = (given or os.environ.get(variable) if variable else given) or level
    if found not in LEVELS:
        raise ValueError(f"no level {found}")
    return found, found != "OFF"


def show_status(spark: SparkSession, text: str, pattern: str = "$$$") -> str:
    """A status as the description of the jobs to come."""
    message = pattern.replace("$$$", text)
    spark.sparkContext.setJobDescription(message)
    return message


def collect_garbage(spark: SparkSession) -> str:
    """Ask the driver's JVM to free memory; what it holds after."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    runtime.gc()
    return f"{(runtime.totalMemory() - runtime.freeMemory()) / 1e6:.1f} MB"


def specification(name: str) -> dict[str, str]:
    """Where an operator is and what it does."""
    from fluxgrid import registry

    function = registry.find(name)
    return {"name": name, "id": registry.OPERATORS[name], "language": "Python", "description": (function.__doc__ or "").strip()}


def settings_tree(settings: dict[str, object], name: str, found: frozenset = frozenset()) -> dict:
    """Defaults of settings by name, with those of their sub-settings inside; cycles end."""
    own = settings[name]
    out = own.combine()
    for c in own.controls:
        if c["kind"] == "settings" and c["name"] in settings and c["name"] not in found:
            out[f"@{c['name']}"] = settings_tree(settings, c["name"], found | {name})
    return out
